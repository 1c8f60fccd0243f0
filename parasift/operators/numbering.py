"""List numbering of a document: marker kinds, one style, duplicate numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasift.functions import textnorm as tn
from parasift.staging import stage

# Fixed values.
_NUMERAL = r"I{1,3}|IV|V|VI{0,3}|IX|X|[1-9]\d{0,2}"
ARTICLE = rf"(?i)^(?:Article|Clause|Section)\s+({_NUMERAL})\b"
MARKER = rf"^(?:\(\s*)?({_NUMERAL})([.、．)）])(\s*)"


def _number(token: Column) -> Column:
    roman = F.create_map(*(F.lit(x) for pair in zip(tn.ROMAN_NUMERALS, range(1, 11)) for x in pair))
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("int")).otherwise(F.try_element_at(roman, F.upper(token)))


def classify(text: Column) -> Column:
    """Struct of ``kind`` (article, roman, arabic or null) and ``seq`` of a line's marker."""
    return _marked(F.regexp_extract(text, ARTICLE, 1), F.regexp_extract(text, MARKER, 1))


def _marked(article: Column, marker: Column) -> Column:
    kind = F.when(article != "", F.when(_number(article).isNotNull(), "article")).when(marker.rlike("^[0-9]"), "arabic").when(marker != "", "roman")
    seq = F.when(article != "", _number(article)).when(marker != "", _number(marker))
    return F.struct(F.when(seq.isNotNull(), kind).alias("kind"), seq.alias("seq"))


#: Order of a document's segments: body, then table cells, then text boxes, each in its own order.
REGIONS = ["body", "cell", "textbox"]


def document_order() -> Column:
    """A sortable place of a segment (region, tbl, row, col, box, pos) in its document."""
    region = F.array_position(F.array(*map(F.lit, REGIONS)), F.col("region")).cast("int")
    return F.struct(region.alias("region"), *(F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("tbl", "row", "col", "box", "pos")))


#: A document, or a number of one, with over one in so many of all lines is hot; there can be no more such than that.
HOT_SHARE = 1000


def _told(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows``, left-joined to ``table``, which has a row a key and in ``__n`` its number of lines; null keys are equal.
    Hot keys, if there are any, come by broadcast, so their lines stay where they lie; all others meet in one join."""
    values = [c for c in table.columns if c not in [*keys, "__n"]]
    named = table.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.struct(*values).alias("__found"), "__n")
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    bound = total / HOT_SHARE
    gone = [f"__key_{k}" for k in keys] + ["__n"]
    out = lambda found: found.select(*rows.columns, *(F.col("__found")[v].alias(v) for v in values))
    hot = named.where(F.col("__n") > bound)
    if not hot.limit(1).count():
        return out(rows.join(named, same, "left").drop(*gone))
    first = rows.join(F.broadcast(hot), same, "left").drop(*gone)
    rest = first.where("__found is null").drop("__found").join(named.where(F.col("__n") <= bound), same, "left").drop(*gone)
    return out(first.where("__found is not null").unionByName(rest))


def normalize(df: DataFrame, keys: list[str], pos: str | Column = "pos", text: str = "text") -> DataFrame:
    """``df`` with ``kind``, ``seq``, ``new_text`` and what is to be told of each line.

    Where a document of ``keys`` mixes Roman and Arabic list markers, the more frequent style wins, Roman
    on a tie; Arabic numbers over ten stay (``beyond``). ``first_pos`` is the ``pos`` of the first line with
    the same kind and number, for later ones. ``mixed`` is the document's style if it was mixed, ``articles``
    tells of article markers beside list markers, ``opening`` marks the document's first line. ``pos`` is a
    column or an expression that orders a document.

    Lines are classified once and written. Each number of a document is counted, and its first place found, by tasks
    first and then together; a document has some two thousand of them at most, from which its own counts are made. The
    lines meet that table once. No document is brought into one task, however long it is. ``df`` is read once.
    """
    order = F.col(pos) if isinstance(pos, str) else pos
    # Columns of their own, so that each pattern runs once a line.
    marks = df.withColumns({"__a": F.regexp_extract(text, ARTICLE, 1), "__m": F.regexp_extract(text, MARKER, 1), "__at": order})
    tagged = marks.withColumn("__c", _marked(F.col("__a"), F.col("__m"))).withColumns({"kind": F.col("__c.kind"), "seq": F.col("__c.seq")}).drop("__a", "__m", "__c")
    tagged = stage(tagged, "numbered-lines")
    numbers = stage(tagged.groupBy(*keys, "kind", "seq").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")), "numbering")
    total = numbers.agg(F.sum("__n")).first()[0] or 0
    kinds = ("roman", "arabic", "article")
    documents = numbers.groupBy(*keys).agg(*(F.sum(F.when(F.col("kind") == k, F.col("__n")).otherwise(0)).alias(f"__{k}") for k in kinds), F.min("__first").alias("__opening"))
    own = documents.select(*(F.col(k).alias(f"__doc_{k}") for k in keys), *(f"__{k}" for k in kinds), "__opening")
    table = numbers.join(own, [F.col(k).eqNullSafe(F.col(f"__doc_{k}")) for k in keys]).drop(*(f"__doc_{k}" for k in keys))
    table = stage(table.withColumn("__first", F.when(F.col("kind").isNotNull(), F.col("__first"))), "numbering")
    counted = _told(tagged, table, [*keys, "kind", "seq"], total)
    mixed = F.when((F.col("__roman") > 0) & (F.col("__arabic") > 0), F.when(F.col("__roman") >= F.col("__arabic"), "roman").otherwise("arabic"))
    roman = F.get(F.array(*map(F.lit, tn.ROMAN_NUMERALS)), F.col("seq") - 1)
    mark = F.when(F.col("mixed") == "roman", F.when(F.col("kind") == "arabic", roman)).when((F.col("mixed") == "arabic") & (F.col("kind") == "roman"), F.col("seq").cast("string"))
    rest = F.concat(F.regexp_extract(text, MARKER, 3), F.regexp_replace(text, F.lit(MARKER), F.lit("")))
    beyond = (F.col("mixed") == "roman") & (F.col("kind") == "arabic") & (F.col("seq") > 10)
    return (
        counted.withColumn("mixed", mixed)
        .withColumn("opening", F.col("__at") == F.col("__opening"))
        .withColumn("articles", (F.col("__article") > 0) & (F.col("__roman") + F.col("__arabic") > 0))
        .withColumn("new_text", F.when(mark.isNotNull(), F.concat(mark, F.lit("."), rest)).otherwise(F.col(text)))
        .withColumn("first_pos", F.when(F.col("__first") < F.col("__at"), F.col("__first")))
        .withColumn("beyond", F.coalesce(beyond, F.lit(False)))
        .drop("__roman", "__arabic", "__article", "__opening", "__first", "__at")
    )


def warnings() -> Column:
    """Array of what ``normalize`` found for a line: all that holds, and the document's own on its first line."""
    style = F.when(F.col("mixed") == "roman", "罗马数字").otherwise("阿拉伯数字")
    label = F.when(F.col("kind") == "roman", "罗马序号 ").when(F.col("kind") == "arabic", "阿拉伯序号 ").otherwise("条款序号 ")
    told = F.array(
        F.when(F.col("opening") & F.col("mixed").isNotNull(), F.concat(F.lit("编号体系混用: 已统一为 "), style)),
        F.when(F.col("opening") & F.col("articles"), F.lit("编号混用: 条款编号(Article/Clause/Section)与列表编号混用，未自动修改，请人工确认")),
        F.when(F.col("beyond"), F.concat(F.lit("编号未转换: 序号 "), F.col("seq").cast("string"), F.lit(" 超出罗马数字可表示范围(1-10)"))),
        F.when(F.col("first_pos").isNotNull(), F.concat(F.lit("编号重复: "), label, F.col("seq").cast("string"))),
    )
    return F.filter(told, lambda w: w.isNotNull())
