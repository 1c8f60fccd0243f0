"""The registered queries over a small folder of tables, against plain versions; and plain FTRL."""

import base64
import gzip
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from parasift.llm import classifier, media, quality, queries, toolcalls, toxicity, warc
from tests.llm.test_text_operators import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with nulls, blanks, copies, repeats, ties and a long text; labels; pages; a test set; chats."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(90):
        good, toxic = rng.random() < 0.6, rng.random() < 0.3
        words = [word() + ("" if good else "###") for _ in range(rng.randint(8, 60))]
        if toxic:
            words[3] = rng.choice(["vilewordy", "vilewords"])
        docs.append((i, "\n".join(" ".join(words[a : a + 12]) for a in range(0, len(words), 12))))
        labels.append((i, int(good), int(toxic)))
    docs += [(100, None), (101, ""), (102, " \n "), (103, docs[0][1]), (104, docs[0][1]), (0, docs[0][1]), (105, "héllo wörld " * 9000), (106, docs[5][1] + "!"), (None, docs[1][1]), (None, None)]
    item = " ".join(word() for _ in range(20))
    docs.append((107, "well known words stand before " + item.upper() + " and after"))
    pages = [(i, f"http://a.org/{i}", rng.choice(["<p>one</p>", "<p>two é</p>", "", None, "x" * 3000])) for i in range(30)]
    chats = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "", None, "é"])) for c in range(5) for t in range(6)] + [(None, 1, "user", "x"), (9, 0, "system", "s")]
    folder = tmp_path_factory.mktemp("sf")
    for name, rows, schema in (
        ("documents", [(i, t, "en", "web", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("pages", pages, "page_id long, url string, html string"),
        ("benchmark", [(1, item), (2, None), (3, "")], "item_id long, text string"),
        ("conversations", chats, "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}", docs, dict((i, (q, t)) for i, q, t in labels), pages


def run(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    rows, prints = run(spark, tables, "op1_simhash_near_dedup"), {}
    for n, (_, text) in enumerate(tables[1]):
        prints[n] = plain_fingerprint(text)
    least = {}
    roots = plain_components(prints)
    for n, (i, _) in enumerate(tables[1]):
        if i is not None:
            least[roots[n]] = min(i, least.get(roots[n], i))
    want = Counter((i, f"{prints[n]:016x}", least.get(roots[n])) for n, (i, _) in enumerate(tables[1]))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


@pytest.mark.parametrize("name,which,threshold", [("op2_counterfactual_toxicity", 1, 0.7), ("op5_ftrl_quality", 0, 0.5)])
def test_op2_and_op5(spark, tables, name, which, threshold):
    rows = run(spark, tables, name)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in tables[1])
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    told = [(r.score >= threshold) == tables[2][r.doc_id][which] for r in rows if r.held_out and r.doc_id in tables[2]]
    assert sum(told) > 0.8 * len(told) and len({r.score for r in rows if r.doc_id in (100, 101)}) == 1


def test_op3(spark, tables):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = Counter()
    for i, text in tables[1]:
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, tables, "op3_byte_bpe")) == want


def test_op4(spark, tables):
    rows = run(spark, tables, "op4_tool_call_linking")
    got = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == 32 and got[0, 4].level == 4 and got[0, 5].level == 5 and got[0, 4].linked and got[0, 4].place == 4
    assert got[9, 0].kind == "message" and got[9, 0].level is None and not got[None, 1].linked


def test_op6(spark, tables):
    assert [(r.doc_id, r.item_id, r.coverage) for r in run(spark, tables, "op6_greedy_tiling")] == [(107, 1, 1.0)]


def test_op7(spark, tables):
    rows = run(spark, tables, "op7_hypergeometric_shards")
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in tables[1])
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_op8(spark, tables):
    want = Counter()
    for i, text in tables[1]:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.to_png(payload)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload, 64, len(payload) // 64), 64, len(payload) // 64, 8] += 1
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth"]
    assert Counter(tuple(r[n] for n in names) for r in run(spark, tables, "op8_media_columns")) == want


def test_op9(spark, tables):
    least = {}
    for i, _, html in tables[3]:
        least[html or ""] = min(i, least.get(html or "", i))
    want = Counter()
    for i, _, html in tables[3]:
        raw, owner = (html or "").encode(), least[html or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == owner else "revisit", None if i == owner else owner] += 1
    assert Counter(tuple(r) for r in run(spark, tables, "op9_warc")) == want


def test_pipeline_of_odd_rows(spark, tables):
    """Nulls, blanks, copies and repeats pass all stages; an empty table gives no rows."""
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    kept = {r.doc_id for r in rows}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows) and not {103, 104, 107} & kept
    good = {i for i, (q, _) in tables[2].items() if q}
    assert len(kept & good) > 0.8 * len(good - {107})
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, docs, tables[0])
        assert after.count() == 0, name
        docs = docs if name.startswith("byte") else after
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_extra_columns_pass_the_pipeline_stages(spark, tables):
    """Columns named as the operators name their own are kept by stages that return documents."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(40)
    for name in ("row", "fp", "band", "lines", "k"):
        docs = docs.selectExpr("*", f"doc_id AS {name}")
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, tables[0])
        assert after.columns == docs.columns, name
        assert after.where("doc_id is not null and (fp <> doc_id or k <> doc_id)").count() == 0, name


# Follow the regularised leader, one weight at a time


def plain_ftrl(examples, alpha, beta, l1, l2, epochs, slots):
    z, n = Counter(), Counter()

    def weight(s):
        free = 0.0 if s == slots else l1
        return 0.0 if abs(z[s]) <= free else -(z[s] - np.sign(z[s]) * free) / ((beta + n[s] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for features, y in examples:
            w = {s: weight(s) for s in [*features, slots]}
            p = 1 / (1 + np.exp(-sum(w[s] * x for s, x in [*features.items(), (slots, 1.0)])))
            for s, x in [*features.items(), (slots, 1.0)]:
                g = (p - y) * x
                z[s] += g - ((n[s] + g * g) ** 0.5 - n[s] ** 0.5) / alpha * w[s]
                n[s] += g * g
    return {s: weight(s) for s in z}


def test_quality_equals_plain_ftrl():
    rng = random.Random(5)
    texts = [(" ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.randint(0, 9))).encode(), rng.randrange(2)) for _ in range(60)]
    frame = pd.DataFrame(quality._rows([t for t, _ in texts])).assign(y=[y for _, y in texts])
    model, slots = quality._train(frame), classifier.Ftrl().size - 1
    examples = [({int(s): float(x) for s, x in zip(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32))}, y) for a, b, y in zip(frame["slots"], frame["values"], frame["y"])]
    plain = plain_ftrl(examples, 0.3, 1.0, 0.05, 0.1, quality.EPOCHS, slots)
    dense = model.dense()
    assert all(abs(dense[s] - w) < 1e-9 for s, w in plain.items() if s != slots) and abs(model.bias - plain[slots]) < 1e-9
    scores = quality.logits([t for t, _ in texts], dense)
    assert all(abs(score - sum(x * plain[s] for s, x in f.items())) < 1e-6 for score, (f, _) in zip(scores, examples))


def test_toxicity_without_swaps_equals_plain_ftrl():
    rng = random.Random(6)
    texts = [(" ".join(rng.choice("alpha beta gamma vileword delta epsilon".split()) for _ in range(rng.randint(0, 9))).encode(), rng.randrange(2)) for _ in range(60)]
    frame = pd.DataFrame(toxicity._rows([t for t, _ in texts])).assign(y=[y for _, y in texts])
    assert not any(frame["swapped"])
    slots = classifier.Ftrl().size - 1
    examples = [({int(s): 1.0 for s in np.frombuffer(a, np.int32)}, y) for a, y in zip(frame["slots"], frame["y"])]
    plain, model = plain_ftrl(examples, 1.0, 1.0, 8.0, 0.1, toxicity.EPOCHS, slots), toxicity._train(frame)
    dense = model.dense()
    assert all(abs(dense[s] - w) < 1e-9 for s, w in plain.items() if s != slots) and abs(model.bias - plain[slots]) < 1e-9


def test_several_swaps_in_one_text():
    rows = toxicity._rows([b"women and men, gay or old, and a muslim", b"no group"])
    own, swapped = (set(np.frombuffer(rows[0][k], np.int32).tolist()) for k in ("slots", "swapped"))
    assert toxicity.counterfactual("women and men, gay or old, and a muslim") == "men and women, lesbian or young, and a christian"
    assert own - swapped and swapped - own and rows[1]["swapped"] == b""


def test_no_identity_term_stands_in_two_kinds():
    terms = [t for kind in toxicity.IDENTITY_TERMS for t in kind]
    assert len(terms) == len(set(terms)) and toxicity.counterfactual("Hindus met") == "buddhists met" and toxicity.counterfactual("Juden") == "buddhisten"


def test_copies_of_a_labelled_key_are_one_example(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(200)] + [(5, "other"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1)], "doc_id long, quality int")
    may = [r.doc_id for r in labels.where(classifier.may_learn("doc_id")).select("doc_id").distinct().collect()]
    found = classifier.labelled_sample(docs, labels, "quality", "text", "doc_id", 2).collect()
    assert sorted((r.text, r.y) for r in found) == sorted({1: ("text 0", 1), 5: ("other", 1)}[i] for i in may)


def test_a_file_of_many_small_records_is_read_in_linear_time():
    rng = random.Random(1)
    records = [bytes(rng.randrange(256) for _ in range(60)) * 5 for _ in range(300)] + [b"", b"x" * 200_000]
    files = [b"".join(gzip.compress(r, mtime=0) for r in records) * times for times in (4, 32)]
    took = []
    for file in files:
        began = time.process_time()
        found = list(warc.members(file))
        took.append(time.process_time() - began)
        assert found[: len(records)] == records and len(found) % len(records) == 0
    assert took[1] < 24 * max(took[0], 0.005)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(files[0][:-3]))


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"enum": [1, "a", None]}, [1, 1.0, "a", None], [True, "b", 2]),
        ({"const": {"a": [1]}}, [{"a": [1.0]}], [{"a": [True]}, {}]),
        ({"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 2, "multipleOf": 0.1}, [0.3, 1], [0, 2, 0.25]),
        ({"type": "string", "pattern": "^a+$", "maxLength": 3}, ["a", "aaa"], ["b", "aaaa"]),
        ({"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "integer"}}, [[1, 2]], [[], [1, 1.0], [1, 2, 3, 4], ["x"]]),
        ({"type": "object", "minProperties": 1, "maxProperties": 2, "additionalProperties": {"type": "string"}}, [{"a": "x"}], [{}, {"a": 1}, {"a": "", "b": "", "c": ""}]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 7, None], [3]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [3, 5.5], [7]),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}], "not": {"const": 2}}, [1, 1.5], [0, 2, 3]),
        ({"items": False}, [[], 3], [[1]]),
    ],
)
def test_schema_keywords(schema, good, bad):
    toolcalls.check_schema(schema)
    assert [v for v in good if toolcalls.violations(v, schema)] == [] and [v for v in bad if not toolcalls.violations(v, schema)] == []


@pytest.mark.parametrize("schema", [{"patternProperties": {}}, {"items": {"format": "date"}}, {"anyOf": [{"$ref": "#"}]}, {"type": "text"}, 3])
def test_unknown_keywords_are_refused(spark, schema):
    messages = toolcalls.turns_as_calls(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string"))
    with pytest.raises(ValueError, match="unknown|not a schema"):
        toolcalls.format_chat(messages, {"reply": schema})
