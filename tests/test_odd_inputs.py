"""Catalog queries against their SQL on texts that the given tables do not hold."""

import duckdb
import pandas as pd
import pytest

from parasift.plans import catalog
from parasift.staging import slices

TEXTS = [
    None, "", " ", "\n", "　", "\u00a0 \u2009", "\u200b", "\t", "plain words", "SEE A.COM now", "Mail x@Y.Org", "http://localhost/page", "www.example.net", "https://a.example/x", "见a中.com", "中文a.com", "中文" * 30 + " a.com", "a b.com", ".com", "-.com -.com", "é.com a",
    "a.comé", "a.com_", "a.company b.io.", "K.com", "a.ıo", "a.b.cn/x", "x\x0b.com", "a@b.c", "a@b.c.", "a@b.c,", "é@b.c", "a@bé", "1x@ b@c d@e", "http://u@h.com/a", "[Image a@b]", "https://x.com/?q=a@b", " a@b.c", "a@@b", "a@b\na@b\ta@b\x0ba@b",
    "‘quoted’", "‛", "全角！", "a" * 99, "a" * 100, "a" * 120 + " b.edu", "😀.gov", "a😀.gov", "1.com", "..com", "x..com", "a.com.b", "x" * 3000 + "@" * 3 + ".com x", " a.io",
]


@pytest.mark.parametrize("name", ["email_filter", "term_route"])
def test_odd_texts(spark, tmp_path, name):
    rows = [(i * 4 + k, text) for i, text in enumerate(TEXTS) for k in range(4)] + [(None, "a.com"), (-3, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(catalog.ORACLE_SQL[name]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_slices_hold_every_row_once_and_are_bounded():
    texts = pd.Series(["x" * 10] * 600 + [None, "y" * 2_000_000, ""])
    found = [texts.iloc[s] for s in slices(texts)]
    assert pd.concat(found).tolist() == texts.tolist() and max(map(len, found)) <= 256
    assert all(len(f) == 1 or f.str.len().sum() <= 1_000_000 for f in found) and list(slices(texts[:0])) == []


def test_round_trip_of_odd_orders(spark, tmp_path):
    """Nulls, blank starts and line ends in texts; documents are dealt out to all tasks, not merged by their few bytes."""
    starts = [None, "", " ", "\n", "\t", "plain", "  lead", "tail  ", "a\nb", "a\r\nb", "\r", "<&>\"'", "]]>", "中文", "　", " ", "😀"]
    rows = [(key, customer, status, start) for n, start in enumerate(starts) for m, (customer, status) in enumerate([(1, "F"), (1, "O"), (-2, "P"), (None, None), (7 + n, "O")]) for key in range(-70 + n * 40 + m * 7, -70 + n * 40 + m * 7 + 7)]
    rows += [(None, 1, "F", "no key"), (None, None, None, None), (None, 7, "O", "no key"), (5000, None, "O", None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    found = catalog.QUERIES["docx_round_trip"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(db.execute(catalog.ORACLE_SQL["docx_round_trip"]).fetchall(), key=repr)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
