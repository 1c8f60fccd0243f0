"""Amounts with Chinese units as exact decimals: parsing, rendering, comparing."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. One table for masking and for checking; longer units are tried first.
CN_UNITS = {
    "万亿美元": 10**12,
    "亿美元": 10**8,
    "亿元人民币": 10**8,
    "亿人民币": 10**8,
    "万元人民币": 10**4,
    "万亿元": 10**12,
    "亿元": 10**8,
    "万元": 10**4,
    "千元": 10**3,
    "元人民币": 1,
    "美元": 1,
    "美金": 1,
    "人民币": 1,
    "亿": 10**8,
    "万": 10**4,
    "元": 1,
}
EN_UNITS = {"hundred million": 10**8, "trillion": 10**12, "billion": 10**9, "million": 10**6}
SCALES = [("trillion", 10**12), ("billion", 10**9), ("million", 10**6)]
NUMBER = r"\d[\d,，.]*"
EXACT = "decimal(38,6)"


def unit_pattern() -> str:
    return "|".join(sorted(CN_UNITS, key=len, reverse=True))


def decimal_of(raw: Column) -> Column:
    """The number in ``raw`` without separators; null if it is none (``1.2.3``)."""
    return F.rtrim(F.translate(raw, ",，", ""), F.lit(".")).try_cast(EXACT)


def multiplier(unit: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CN_UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, unit), F.lit(1)).cast("decimal(13,0)")


def trimmed(value: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(value.cast(EXACT).cast("string"), F.lit(r"\.?0+$"), F.lit(""))


def render(value: Column, unit: Column) -> Column:
    """``RMB 10,250,000.00`` or, for units of 亿, ``USD 1.25 billion``."""
    total = (value * multiplier(unit)).cast("decimal(38,6)")
    currency = F.when(unit.rlike("美元|美金"), "USD").otherwise("RMB")
    scaled = F.when(total >= 10**12, F.concat(trimmed(total / F.lit(10**12)), F.lit(" trillion"))).when(total >= 10**9, F.concat(trimmed(total / F.lit(10**9)), F.lit(" billion"))).otherwise(F.concat(trimmed(total / F.lit(10**6)), F.lit(" million")))
    return F.concat(currency, F.lit(" "), F.when(unit.contains("亿"), scaled).otherwise(F.format_number(total, 2)))


def render_text(raw: str, unit: str) -> str | None:
    """``render`` for one amount in Python; null if ``raw`` is no number."""
    try:
        total = Decimal(raw.replace(",", "").replace("，", "")) * CN_UNITS[unit]
    except InvalidOperation:
        return None
    currency = "USD" if "美元" in unit or "美金" in unit else "RMB"
    if "亿" not in unit:
        return f"{currency} {total:,.2f}"
    name, scale = next((s for s in SCALES if total >= s[1]), SCALES[-1])
    shown = f"{(total / scale).quantize(Decimal('0.000001')):f}".rstrip("0").rstrip(".")
    return f"{currency} {shown} {name}"
