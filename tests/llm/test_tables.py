"""Classifiers by held-out accuracy, shards by their law, media and WARC by round trips, chat by cases."""

import base64
import gzip
import hashlib
import io
import random
import re
import tarfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parasift.llm import media, quality, sharding, toolcalls, toxicity, warc
from parasift.llm.common import stage, stage_path

# Classifiers


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilewordy", "vilewords", "nastything"])
        if rng.random() < 0.2 or toxic:
            words[rng.randrange(len(words))] = "muslim" if toxic or rng.random() < 0.2 else "christian"
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "abc", "x"), (0, rows[0][1], "x")]
    labels += [(1001, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score,label,threshold", [(quality.quality_scores, "quality", 0.5), (toxicity.toxicity_scores, "toxic", 0.7)])
def test_held_out_accuracy(spark, labelled, score, label, threshold):
    docs, labels = labelled
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows if r.doc_id is not None)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    tested = [(r.score >= threshold) == truth[r.doc_id] for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(tested) > 200 and sum(tested) > 0.97 * len(tested)
    assert len({r.score for r in rows if r.doc_id in (1000, 1001)}) == 1
    assert len({r.score for r in rows if r.doc_id == 0}) == 1
    assert score(docs.limit(0), labels).count() == 0
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_change_nothing(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda of: {r.doc_id: r.score for r in quality.quality_scores(docs, of).collect()}
    assert scores(labels) == scores(turned)


def test_counterfactuals_bring_scores_of_groups_together(monkeypatch):
    """A group named mostly in toxic sentences: the penalty takes its name's weight away."""
    import pandas as pd

    assert toxicity.counterfactual("A Muslim and a gay man, muslimah") == "a christian and a lesbian woman, muslimah"
    rng = random.Random(1)
    texts = []
    for _ in range(600):
        toxic = rng.random() < 0.4
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else "christian"
        bad = " vileword" if toxic and rng.random() < 0.8 else ""
        texts.append((f"w{rng.randrange(50)} {group} w{rng.randrange(50)}{bad}".encode(), int(toxic)))
    frame = pd.DataFrame(toxicity._rows([t for t, _ in texts])).assign(y=[y for _, y in texts])

    def gap(penalty):
        monkeypatch.setattr(toxicity, "PENALTY", penalty)
        weights = toxicity._train(frame).dense()
        a, b = toxicity.logits([b"a muslim here", b"a christian here"], weights)
        return abs(a - b)

    assert gap(0.5) < 0.35 * gap(0.0)


# Shards


def test_hypergeometric_law():
    rng = random.Random(0)
    draws = Counter(sharding.hypergeometric(5, 7, 6, rng) for _ in range(20000))
    from math import comb

    for k in range(6):
        assert abs(draws[k] / 20000 - comb(5, k) * comb(7, 6 - k) / comb(12, 6)) < 0.015
    assert 0 <= sharding.hypergeometric(10**11, 10**12, 10**9, rng) <= 10**9
    matrix = sharding.communication_matrix([5, 0, 13, 7], [9, 8, 8], 3)
    assert [sum(r) for r in matrix] == [5, 0, 13, 7] and [sum(c) for c in zip(*matrix)] == [9, 8, 8]


@pytest.mark.parametrize("n,blocks", [(1000, 64), (5, 64), (0, 64), (1000, 1)])
def test_shards_are_exact(spark, monkeypatch, n, blocks):
    monkeypatch.setattr(sharding, "LEAST_BLOCKS", blocks)
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("size"), F.lit(1).alias("n"))
    rows = sharding.assign_shards(df, 7, [F.col("doc_id")]).collect()
    again = sharding.assign_shards(df.repartition(3), 7, [F.col("doc_id")]).collect()
    assert sorted(rows) == sorted(again) and len(rows) == n
    sizes = Counter(r.shard for r in rows)
    assert n < 7 or max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for shard, size in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(size))
    if n == 1000:
        neighbours = sum(a.shard == b.shard for a, b in zip(*(lambda s: (s, s[1:]))(sorted(rows))))
        assert 100 < neighbours < 190  # one in seven by chance


def test_shards_of_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 40 + [(None, None)] * 9, "doc_id long, text string")
    rows = sharding.assign_shards(df, 4, [F.col("doc_id"), F.col("text")]).collect()
    assert len(rows) == 49 and sorted(Counter(r.shard for r in rows).values()) == [12, 12, 12, 13]
    assert len({(r.shard, r.slot) for r in rows}) == 49


def test_a_third_of_the_rows_equal(spark, monkeypatch):
    """Equal rows spread over blocks like any others, in runs if there are many."""
    monkeypatch.setattr(sharding, "RUN", 64)
    monkeypatch.setattr(sharding, "MATRIX_ROWS", 10)
    monkeypatch.setattr(sharding, "MOST_BROADCAST", 0)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("own").alias("text")).union(spark.range(500).select(F.lit(7).cast("long"), F.lit("same")))
    rows = sharding.assign_shards(df, 6, [F.col("doc_id"), F.col("text")]).collect()
    assert sorted(rows) == sorted(sharding.assign_shards(df.repartition(5), 6, [F.col("doc_id"), F.col("text")]).collect())
    assert Counter(r.shard for r in rows) == {s: 250 for s in range(6)} and all(sorted(r.slot for r in rows if r.shard == s) == list(range(250)) for s in range(6))
    assert all(50 < sum(r.shard == s and r.text == "same" for r in rows) < 120 for s in range(6))


def test_sharding_runs_no_python(spark):
    plan = sharding.assign_shards(spark.range(10), 3, [F.col("id")])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Media


def test_media_round_trip(spark, tmp_path):
    texts = [(1, "héllo"), (2, ""), (3, None), (4, "x" * 100_000), (5, "héllo"), (6, "y" * 64), (6, "y" * 64), (None, "z\0")]
    df = spark.createDataFrame([(i, t, b"d") for i, t in texts], "doc_id long, text string, digest binary")
    rows = media.media_columns(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = dict((a, b or "") for a, b in texts)[r.doc_id].encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        stored = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert media.from_png(stored) == payload and r.width * r.height == len(payload) and r.depth == 8
    assert len({r.media_sha256 for r in rows if r.doc_id in (1, 5)}) == 1
    assert media.media_columns(df.limit(0)).count() == 0


def test_tar_shards_hold_each_payload_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(media, "SHARD_BYTES", 3000)
    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id long, text string").coalesce(1)
    folder = stage_path(spark, "media-test")
    catalog = stage(media.write_media(df, folder), "media-test-catalog")
    fs, base = media.file_system(folder)
    names = {r.shard for r in catalog.collect()}
    for name in names:
        members = tarfile.open(fileobj=io.BytesIO(fs.open_input_file(f"{base}/{name}").read())).getmembers()
        assert len({m.name for m in members}) == len(members)
        offsets = {m.offset_data: m.size for m in members}
        assert all(offsets[r.offset] == r.length for r in catalog.collect() if r.shard == name)
    assert {(r.width, r.height) for r in media.media_metadata(catalog, folder).collect()} == {(64, 1)}


# WARC


def pages(spark):
    rows = [(5, "http://b.org/x y", "<p>é</p>"), (3, "http://a.org", "<p>é</p>"), (9, None, None), (7, "u", ""), (1, "u", "other"), (3, "http://a.org", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "n", "alone"), (20, "u", "long " * 20000)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, owner int")


def test_warc_round_trip(spark, monkeypatch):
    rows, df = pages(spark)
    monkeypatch.setattr(warc, "RANGE_BYTES", 20_000)
    found = warc.round_trip(df).collect()
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        first = least.get(html or "")
        kind = "response" if first is None or (i == first and not want[i, "response", html or ""]) else "revisit"
        want[i, kind, html or ""] += 1
    digest = lambda html: base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    expected = Counter((i, len(h.encode()), digest(h), kind, least[h] if kind == "revisit" else None) for (i, kind, h), n in want.items() for _ in range(n))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_ranges_of_odd_keys(spark, monkeypatch):
    """Outlying keys, keys more than 2**63 apart, one hot key and hot rows without a key still fill many ranges."""
    monkeypatch.setattr(warc, "RANGE_BYTES", 2000)
    monkeypatch.setattr(warc, "LEAST_BUCKETS", 16)
    rows = [(i, f"page {i} " + "x" * 50) for i in range(400)] + [(2**63 - 1, "far"), (-(2**63), "far off")]
    rows += [(77, f"hot {i} " + "y" * 50) for i in range(200)] + [(None, f"none {i} " + "z" * 50) for i in range(200)]
    df = spark.createDataFrame([(k, "u", b) for k, b in rows], "page_id long, url string, html string")
    folder = stage_path(spark, "warc-test")
    manifest = warc.write_warc(df, folder)
    files = manifest.collect()
    assert len(files) > 20 and max(f.records for f in files) < 100
    got = [(r.key, r.payload_digest) for r in warc.read_warc(manifest, folder).collect()]
    assert Counter(got) == Counter((k, warc.base32_sha1(b.encode())) for k, b in rows)
    spans = [(f.first_key, f.last_key) for f in sorted(files) if f.first_key is not None]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_warc_files_are_equal_each_time(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200)
    monkeypatch.setattr(warc, "RANGE_BYTES", 20_000)
    _, df = pages(spark)
    manifests = []
    for parts in (1, 3):
        folder = stage_path(spark, "warc-test")
        manifest = sorted(tuple(r) for r in warc.write_warc(df.repartition(parts), folder).collect())
        fs, base = warc.file_system(folder)
        names = {f.base_name for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(base))}
        assert names == {m[0] for m in manifest}  # no temporary file is left
        raw = gzip.decompress(fs.open_input_file(f"{base}/{manifest[0][0]}").read())
        assert raw.startswith(b"WARC/1.1\r\n")
        manifests.append(manifest)
    assert manifests[0] == manifests[1] and len(manifests[0]) > 3


def test_damaged_records_are_told():
    good = warc.record(1, "u", b"payload", None, 0)
    assert warc.parse(good)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"pay1oad\r\n"))


# Chat


NUMBER = {"type": "integer", "minimum": 0}
SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": NUMBER, "b": NUMBER}, "additionalProperties": False}}
MESSAGES = "conv_id long, turn long, role string, kind string, call_id string, parents array<string>, name string, arguments string, content string, level string"


def chat(spark, rows):
    return toolcalls.format_chat(spark.createDataFrame([(*r, "extra") for r in rows], MESSAGES), SCHEMAS).collect()


def test_tool_calls(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [
        (1, 0, "a", "call", "c1", None, "add", '{"b": 2.0, "a": 1}', None),
        (1, 1, "t", "result", "c1", None, None, None, "3é"),
        (1, 2, "a", "call", "c2", ["c1"], "add", '{"a": "x", "b": 1, "z": 0}', None),
        (1, 3, "a", "call", "c3", ["c2", None], "add", "no json", None),
        (1, 4, "a", "call", "c4", ["nowhere"], "unknown", "{}", None),
        (1, 5, "t", "result", "lost", None, None, None, ""),
        (2, 0, "a", "call", "x", ["y"], "add", None, None),
        (2, 1, "a", "call", "y", ["x"], "add", '{"a":1,"b":1}', None),
        (2, 2, "s", "message", None, None, None, None, None),
        (2, 3, "a", "call", "behind", ["x"], "add", '{"a":1,"b":1}', "q" * 300_000),
        (3, 0, "a", "call", "c1", None, "add", '{"a":1,"b":1}', None),
        (3, 1, "a", "call", "s", None, "add", '{"a":"\\ud800","\\udfff":1}', None),
        (3, 2, "a", "call", "d", ["d"], "add", deep, None),
        (None, None, "a", "call", None, None, "add", '{"a":1,"b":1}', None),
        (None, 1, "a", "result", "c1", None, None, None, None),
        (4, 1, None, None, "c1", None, None, None, None),
    ]
    found = chat(spark, rows)
    got = {(r.conv_id, r.turn): r for r in found}
    assert len(found) == len(rows)
    assert got[1, 0].json == '{"arguments":{"a":1,"b":2},"call_id":"c1","kind":"call","name":"add"}' and got[1, 0].valid and got[1, 0].linked and got[1, 0].level == 0
    assert got[1, 1].json == '{"call_id":"c1","content":"3é","kind":"result"}' and got[1, 1].level == 1 and got[1, 1].valid is None
    assert got[1, 2].level == 2 and got[1, 2].problems == ["$.a: not of type integer", "$.z: unknown"] and not got[1, 2].linked
    assert got[1, 3].level == 4 and got[1, 3].problems == ["not JSON"]
    assert got[1, 4].level == 0 and got[1, 4].problems == ["no schema"]
    assert not got[1, 5].linked and got[1, 5].level is None
    assert got[2, 0].level is None and got[2, 1].level is None and got[2, 3].level is None and got[2, 0].problems == ["not JSON"]
    assert not got[3, 0].linked and got[3, 0].level == 0 and not got[None, None].linked and got[None, None].level is None and not got[None, 1].linked
    assert got[3, 1].json == '{"arguments":{"a":"\\ud800","\\udfff":1},"call_id":"s","kind":"call","name":"add"}' and not got[3, 1].valid
    assert got[3, 2].problems == ["too deeply nested"] and got[3, 2].level is None and got[4, 1].level is None
    assert sorted(r.place for r in found if r.conv_id == 1) == [0, 1, 2, 3, 4, 5]
    assert chat(spark, []) == []


def plain_levels(parents):
    """The longest path behind each call; none on and behind cycles."""
    level, changed = {}, True
    while changed:
        changed = False
        for i, above in parents.items():
            above = [p for p in above if p in parents]
            if i not in level and all(p in level for p in above):
                level[i] = max((level[p] + 1 for p in above), default=0)
                changed = True
    return level


def test_order_of_calls_with_several_parents(spark):
    rng = random.Random(2)
    rows, want = [(9, 0, "a", "call", "a", [], "add", "{}", None), (9, 1, "a", "call", "b", ["a"], "add", "{}", None), (9, 2, "a", "call", "c", ["b"], "add", "{}", None), (9, 3, "a", "call", "d", ["a", "c"], "add", "{}", None)], {(9, i): n for n, i in enumerate("abcd")}
    for conv in range(3):
        parents = {}
        for i in range(40):
            above = [f"n{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if i else []
            parents[f"n{i}"] = above + (["n39"] if conv == 2 and i == 30 else []) + (["gone"] if rng.random() < 0.2 else [])
        turns = {i: rng.randrange(100) for i in parents}
        rows += [(conv, turns[i], "a", "call", i, above, "add", "{}", None) for i, above in parents.items()]
        rows += [(conv, turns[i] + rng.randrange(5), "t", "result", i, None, None, None, "r") for i in parents if rng.random() < 0.5]
        want |= {(conv, i): n for i, n in plain_levels(parents).items()}
    found = chat(spark, rows)
    assert {(r.conv_id, r.call_id): r.level // 2 for r in found if r.kind == "call" and r.level is not None} == want
    order = sorted((r for r in found if r.level is not None), key=lambda r: (r.conv_id, r.place, r.level, r.turn))
    at = {(r.conv_id, r.call_id, r.kind, r.turn): n for n, r in enumerate(order)}
    above = {(r[0], r[4]): r[5] for r in rows if r[3] == "call"}
    for conv, call_id, kind, turn in at:
        for (c, i, k, t), n in at.items():  # after every parent, its results, and a result's own call
            if c == conv and (i in above[conv, call_id] or kind == "result" and i == call_id and k == "call"):
                assert n < at[conv, call_id, kind, turn]


def test_long_chain_of_calls(spark):
    calls = spark.range(700).select(F.lit(1).alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("parents"), F.col("id").alias("last_turn"))
    rows = toolcalls.levels(calls.union(calls.limit(3))).collect()
    assert len(rows) == 700 and all(int(r.call_id) == r.level and r.before == (r.level - 1 if r.level else None) for r in rows)
