"""Do numbers and amounts of the source survive in the translation?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.functions.amounts import EN_UNITS, EXACT, NUMBER, decimal_of, multiplier, unit_pattern

TOLERANCE = "0.01"


def source_amounts(cn: Column) -> Column:
    """Structs of ``shown`` and ``value`` of all numbers with a unit, and of those from 100 without."""
    pattern = rf"{NUMBER}\s*(?:{unit_pattern()})?"
    part = lambda t, i: F.regexp_extract(t, rf"({NUMBER})\s*({unit_pattern()})?", i)
    parsed = F.transform(F.regexp_extract_all(cn, F.lit(pattern), F.lit(0)), lambda t: F.struct(F.rtrim(t).alias("shown"), part(t, 2).alias("unit"), decimal_of(part(t, 1)).alias("number")))
    counted = F.filter(parsed, lambda a: a["number"].isNotNull() & ((a["unit"] != "") | (a["number"] >= 100)))
    return F.transform(counted, lambda a: F.struct(a["shown"].alias("shown"), (a["number"] * multiplier(a["unit"])).cast(EXACT).alias("value")))


def target_amounts(en: Column) -> Column:
    """Values of all numbers, times the English scale word within 20 characters, if one follows at once."""
    pattern = r"\d[\d,]*(?:\.\d+)?"
    tail = F.lit(rf"{pattern}(?=([\s\S]{{0,20}}))")
    numbers, tails = F.regexp_extract_all(en, F.lit(pattern), F.lit(0)), F.regexp_extract_all(en, tail, F.lit(1))
    scale = lambda t: F.coalesce(*(F.when(t.rlike(rf"(?i)^\s*{unit}\b"), F.lit(times)) for unit, times in EN_UNITS.items()), F.lit(1)).cast("decimal(13,0)")
    return F.zip_with(numbers, tails, lambda n, t: (decimal_of(n) * scale(t)).cast(EXACT))


def missing_amounts(cn: Column, en: Column) -> Column:
    """Source amounts whose value no number of the translation has."""
    close = lambda a, values: F.exists(values, lambda v: F.abs(v - a["value"]) < F.lit(TOLERANCE).cast("decimal(10,6)"))
    return tn.let(target_amounts(en), lambda values: F.filter(source_amounts(cn), lambda a: ~F.coalesce(close(a, values), F.lit(False))))


def missing_integers(cn: Column, en: Column) -> Column:
    """Source integers of four or more digits that the translation does not show."""
    found = F.regexp_extract_all(cn, F.lit(r"(?<![\d.,])(\d[\d,]*)(?![\d.])"), F.lit(1))
    gone = lambda n, bare: (F.length(F.replace(n, F.lit(","), F.lit(""))) >= 4) & ~bare.contains(F.replace(n, F.lit(","), F.lit("")))
    return tn.let(F.replace(en, F.lit(","), F.lit("")), lambda bare: F.filter(found, lambda n: gone(n, bare)))


def warnings(cn: Column, en: Column) -> Column:
    amounts = F.transform(missing_amounts(cn, en), lambda a: F.concat(F.lit("金额/数量缺失: 中文「"), a["shown"], F.lit("」期望值 "), F.format_number(a["value"], 2), F.lit(" 未在英文中出现")))
    integers = F.transform(missing_integers(cn, en), lambda n: F.concat(F.lit("数字缺失: 中文「"), n, F.lit("」未在英文中出现")))
    return F.concat(amounts, integers)
