"""Line dedup with a log-template tree, in DataFrame operations only.

A line's path in the tree has fixed depth: its token count, then its first ``DEPTH`` tokens, with tokens
that hold a digit generalised to ``<*>`` (unless no token would be left). At a leaf lie templates. Lines
equal after generalisation share one. A line of ``SHORTEST`` tokens or more is also cut into ``STRETCHES``
stretches, and shares a template with every line of its leaf that differs from it in one stretch only:
that stretch is a variable field. A field among the leading tokens is a wildcard of the tree there, with the
last ``TAIL`` tokens constant. Any two such lines meet, as each distinct line is filed under one key for each
stretch left out; no line of a leaf is preferred. A template recurs if lines of several documents have it; its
lines stay in the document of the least key and are dropped from all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasift.llm.common import join_counted, stage, unstage

DEPTH = 3
TAIL = 2
STRETCHES = 5
#: A line of four tokens has an empty stretch and four of one token.
SHORTEST = 4
#: Tokens that must be constant beside a variable stretch.
LEAST_CONSTANTS = 3
BLANK = " \t\r\x0b\x0c"
_S = [f"s{i}" for i in range(STRETCHES)]
_TEMPLATE = ["t1", "t2"]


def _plain(line: Column) -> Column:
    """The line's tokens with one space between."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare.rlike("[\t\r\x0b\x0c]|  "), F.regexp_replace(bare, F.lit("[ \t\r\x0b\x0c]+"), F.lit(" "))).otherwise(bare)


def _masked(plain: Column) -> Column:
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, F.lit("(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"), F.lit("<*>"))).otherwise(plain)


def _edge(i: int) -> Column:
    """Where stretch ``i`` of ``n`` tokens begins."""
    return F.floor(F.lit(i) * F.col("n") / STRETCHES).cast("int")


def _wide(*parts: Column) -> list[Column]:
    """128 bits of hash, in two columns."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def template_lines(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per line that is not blank: document, row hash, position, token count, constant tokens, leaf
    (null if the line has one template only) and hashes of its stretches."""
    # The hash of a text is taken before its lines are: what goes along with each line is short.
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("row"), F.split(text, "\n").alias("lines"))
    lines = rows.select("doc", "row", F.posexplode("lines").alias("pos", "line")).where(F.col("line").rlike(rf"[^{BLANK}]"))
    plain = lines.select("doc", "row", "pos", _plain(F.col("line")).alias("plain"))
    masked = plain.select("doc", "row", "pos", "plain", _masked(F.col("plain")).alias("masked"))
    variable = ((F.length("masked") - F.length(F.replace("masked", F.lit("<*>"), F.lit("")))) / 3).cast("int")
    own = F.when(F.col("masked").rlike(r"^<\*>(?: <\*>)*$"), F.col("plain")).otherwise(F.col("masked"))
    cut = masked.select("doc", "row", "pos", F.when(F.contains("masked", F.lit("<*>")), variable).otherwise(0).alias("v"), F.split(own, " ").alias("t"))
    sized = cut.select("doc", "row", "pos", "t", F.size("t").alias("n"), (F.size("t") - F.col("v")).alias("c"))
    several = (F.col("n") >= SHORTEST) & (F.col("c") > LEAST_CONSTANTS)
    leaf = F.when(several, F.xxhash64("n", F.slice("t", 1, DEPTH)))
    stretches = [F.xxhash64(F.slice("t", _edge(i) + 1, _edge(i + 1) - _edge(i))).alias(_S[i]) for i in range(STRETCHES)]
    return sized.select("doc", "row", "pos", "n", "c", leaf.alias("leaf"), *stretches)


def _template() -> list[Column]:
    return [c.alias(name) for c, name in zip(_wide(F.col("n"), *map(F.col, _S)), _TEMPLATE)]


def recurring_templates(lines: DataFrame) -> DataFrame:
    """(t1, t2, first, lines) of the distinct lines that share a template with a document of lesser key than
    one of their own; ``first`` is the least such key, ``lines`` how often the line occurs. A staged table.

    Distinct lines, and what they are filed under, are read several times with different columns. They are written
    once, as each reading would else shuffle all lines anew, and deleted when nothing reads them any more.
    """
    distinct = stage(lines.groupBy("n", "c", "leaf", *_S).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("lines")), "distinct-lines")
    filed = stage(filed_lines(distinct), "filed-lines")
    groups = filed.groupBy("k1", "k2").agg(F.min("first").alias("group_first"), F.max("last").alias("z")).where("group_first < z").drop("z")
    alike = filed.join(groups, ["k1", "k2"]).where("group_first < last").select(*_TEMPLATE, F.col("group_first").alias("first"), "lines")
    same = distinct.where("first < last").select(*_template(), "first", "lines")
    found = stage(same.unionByName(alike).groupBy(*_TEMPLATE).agg(F.min("first").alias("first"), F.max("lines").alias("lines")), "templates")
    unstage(filed)
    unstage(distinct)
    return found


def filed_lines(distinct: DataFrame) -> DataFrame:
    """Distinct lines under the keys by which they may share a template with others."""
    # Only leaves with several lines of several documents can generalise behind their leading tokens.
    leaves = distinct.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("k"), F.min("first").alias("a"), F.max("last").alias("z")).where("k > 1 and a < z").select("leaf")
    behind = lambda i: _edge(i) >= DEPTH
    ahead = lambda i: ~behind(i) & (_edge(i + 1) <= F.col("n") - TAIL)
    return _filed(distinct.join(leaves, "leaf", "left_semi"), behind).unionByName(_filed(distinct.where("leaf is not null"), ahead))


def _filed(lines: DataFrame, which: Callable[[int], Column]) -> DataFrame:
    """Distinct lines under a key for each stretch left out, of those that ``which`` names."""
    width = lambda i: _edge(i + 1) - _edge(i)
    left_out = [
        F.when(which(i) & (width(i) > 0) & (F.col("c") - width(i) >= LEAST_CONSTANTS), F.struct(*_wide(F.col("n"), F.lit(i), *(F.col(s) for s in _S if s != _S[i]))))
        for i in range(STRETCHES)
    ]
    filed = lines.select(*_template(), "first", "last", "lines", F.explode(F.array(*left_out)).alias("k")).where("k is not null")
    return filed.select(*_TEMPLATE, "first", "last", "lines", F.col("k.*")).toDF(*_TEMPLATE, "first", "last", "lines", "k1", "k2")


def recurring_lines(lines: DataFrame) -> DataFrame:
    """(doc, row, pos) of the lines whose template occurs in a document of lesser key."""
    templates = recurring_templates(lines)
    found = join_counted(lines.select("doc", "row", "pos", *_template()), templates, _TEMPLATE, "lines")
    return found.where("doc > first").select("doc", "row", "pos")


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with recurring lines dropped from ``text``, plus ``lines_total`` and ``lines_dropped``.

    Lines end at ``\\n``. Blank lines have no template and stay. Within the document of the least key all
    lines stay, repeats too. Rows with a null key or text pass unchanged and count for nothing; repeated rows
    of one key and text keep or drop the same lines. A text whose lines are all dropped becomes empty. Time
    and memory are linear in a text's length, however many lines it has. An empty table gives no rows. Other
    columns pass through; columns named ``lines_total`` or ``lines_dropped`` are replaced.
    """
    lines = stage(template_lines(df, text, key), "lines")
    dropped = recurring_lines(lines).groupBy("doc", "row").agg(F.collect_set("pos").alias("drop"))
    dropped = dropped.select(F.struct("doc", "row", "drop").alias("__dropped"))
    found = df.join(dropped, (df[key] == F.col("__dropped.doc")) & (F.xxhash64(df[text]) == F.col("__dropped.row")), "left")
    parts = F.split(F.col(text), "\n")
    gone = F.col("__dropped.drop")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    # Bound to a lambda's variable, as within a lambda the text would be split for each of its lines.
    both = F.array(F.struct(parts.alias("parts"), stay.alias("stay")))
    kept = F.get(F.transform(both, lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["parts"], i)), "\n")), F.lit(0))
    return found.withColumns(
        {
            "lines_total": F.coalesce(F.size(parts), F.lit(0)),
            "lines_dropped": F.coalesce(F.size(gone), F.lit(0)),
            text: F.when(gone.isNull(), F.col(text)).otherwise(kept),
        }
    ).drop("__dropped")
