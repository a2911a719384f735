"""The operators on small tables: brute force, edge cases, recovery of files."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lodestar.llm import aq, chat, common, dac, lthash, packing, simhash, substring, toxicity, trie_bpe, warc
from lodestar.llm.queries import ORACLES, QUERIES, tokenizer

from conftest import MIDDLE, SMALL
from test_nearcopies import plain_kept

WORD, BYTE = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
#: Nulls, empty and long texts, ties, repeated rows, and columns with clashing names.
ROWS = [(1, "The cat sat. On a mat.\nTwo.", "en"), (2, None, None), (3, "", "en"), (None, "no id", "en"), (None, None, None), (4, "The cat sat. On a mat.\nTwo.", "de"), (4, "The cat sat. On a mat.\nTwo.", "de"), (4, "another text under the same id", "fr"), (5, LONG, "en"), (6, " " * 50, "en"), (7, "<|endoftext|> é 日本", "en")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = ("piece", "start", "length", "part", "row", "spans", "a", "b", "h1", "fp", "id", "best", "k1", "n_chars", "text_", "kept", "comp")
    return df.withColumns({c: F.lit("x") if c != "n_chars" else F.length("text").cast("long") for c in clash})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows):
    return sorted(map(str, rows))


def test_packing(spark, docs, nothing):
    out = packing.pack(spark, docs, WORD, capacity=64, rounds=20).collect()
    tok = __import__("tokenizers").Tokenizer.from_file(WORD)
    want = []
    for i, t, _ in ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == key(want)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    assert packing.pack(spark, nothing, WORD).count() == 0


def test_trie(spark, docs, nothing):
    tok = __import__("tokenizers").Tokenizer.from_file(BYTE)
    want = []
    for i, t, _ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, tok.decode(ids, skip_special_tokens=False)))
    got = trie_bpe.encode_documents(docs, BYTE).collect()
    assert key((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in got) == key(want)
    d = trie_bpe.encode_documents(docs, BYTE, digests=True).collect()
    assert key(r["ids_sha256"] for r in d) == key(hashlib.sha256(np.array(w[2], "<u4").tobytes()).hexdigest() for w in want)
    assert trie_bpe.encode_documents(nothing, BYTE).count() == 0


def test_codes(spark, docs, nothing, monkeypatch):
    tok = __import__("tokenizers").Tokenizer.from_file(BYTE)
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert key(tuple(r) for r in dac.token_files(spark, docs, BYTE, 2).collect()) == key(want)
    assert dac.token_files(spark, nothing, BYTE, 2).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a", big), (3, "http://b", big), (None, "u", big), (9, None, "short"), (8, "http://c", "short"), (7, "v", None), (6, "w\r\nWARC-Type: y", "é" * 60), (2, "http://d", "é" * 60), (2, "http://d", "é" * 60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string")
    files = warc.deduplicated_archives(spark, pages)
    got = warc.read_back(files).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"]))
    assert by[3] == [("response", None, 203)] and by[5] == [("revisit", 3, 203)] and by[None] == [("revisit", 3, 203)]
    assert by[9] == by[8] == [("response", None, 5)] and by[7] == [("response", None, 0)]
    assert sorted(by[2]) == [("response", None, 120), ("revisit", 2, 120)] and by[6] == [("revisit", 2, 120)]
    assert warc.read_back(warc.deduplicated_archives(spark, pages.limit(0))).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x[7], x[8], x[9] = x[100], x[100], x[100] * 3
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [None] * 16, 0), (1200, [1.0] * 3, 0), (None, [1.0] * 16, 0), rows[3], (1250, [], 0), (1300, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in aq.nearest(spark, df, every=50, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(got) == [0, 50, 100, 150, 200, 250, 300, 350]
    hit = 0
    for q, found in got.items():
        s = n @ n[q]
        s[q] = -9
        want = np.lexsort((np.arange(400), -s.round(12)))[:5].tolist()
        hit += len(set(want) & {v for v, _ in found})
        assert all(abs(c - s[v]) < 1e-9 for v, c in found) and [c for _, c in found] == sorted((c for _, c in found), reverse=True)
    assert hit / 40 >= 0.9 and [v for v, _ in got[100]][:3] == [7, 8, 9]
    few = aq.nearest(spark, df.where("vec_id IN (0, 1)"), every=50).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)]
    assert aq.nearest(spark, df.limit(0)).count() == 0


def test_fingerprints(spark, docs, nothing):
    got = lthash.fingerprint_documents(docs).collect()
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = lthash.edit(t, n)
        f = lthash.fingerprints([t, e, n])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f[0].tobytes().hex(), f[1].tobytes().hex(), round(float(lthash.likeness(f[:1], f[1:2])[0]), 9), round(float(lthash.likeness(f[:1], f[2:])[0]), 9)))
    assert key((r["doc_id"], r["n_chars"], r["edited_sha256"], bytes(r["fingerprint"]).hex(), bytes(r["edited_fingerprint"]).hex(), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == key(want)
    assert lthash.fingerprint_documents(nothing).count() == 0
    one = lthash.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1


def test_toxicity(spark, docs, nothing):
    d, labels = common.table(spark, MIDDLE, "documents"), common.table(spark, MIDDLE, "labels")
    chain = toxicity.train(spark, d, labels)
    out = toxicity.score(docs, chain).collect()
    assert len(out) == len(ROWS) and not any(r["toxic"] for r in out if r["doc_id"] in (2, 3))
    assert toxicity.score(nothing, chain).count() == 0 and toxicity.reject(nothing, chain).count() == 0
    kept = toxicity.reject(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in out)
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert not any(r["toxic"] for r in toxicity.score(docs, toxicity.train(spark, docs, none)).collect())
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = {r["doc_id"] for r in toxicity.score(d, chain).where("toxic").collect()}
    assert sum(y.get(i) == 0 for i in found) <= 2 and sum(y.get(i) == 1 for i in found) >= 0.6 * sum(y.values())


def test_toxicity_sample(spark):
    long = "word " * 13_600  # 68,000 characters
    rows = [(i, long if i < 20 else f"text {i}") for i in range(60)] + [(3, "again")] * 20 + [(59, None), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, 1, i % 2) for i in range(60)] + [(4, 0, 1), (5, None, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    texts, values = toxicity.sample(d, labels, toxicity.CATEGORIES)
    assert len(texts) == 60 and texts.count("again") == 1 and texts.count("") == 1 and sum(t == long for t in texts) == 19
    assert sum(values["toxic"]) == 31 and sum(values["poor"]) == 1  # the largest of labels that disagree
    assert len(toxicity.sample(d, labels, toxicity.CATEGORIES, text_chars=60_000)[0]) == 41
    assert len(toxicity.sample(d, labels, toxicity.CATEGORIES, rows=7)[0]) == 14
    few, _ = toxicity.sample(d, labels, toxicity.CATEGORIES, chars=200_000)
    assert 0 < len(few) < 60 and sum(map(len, few)) <= 200_000


def test_toxicity_on_documents_held_out(spark):
    large = "/root/testdata/sf0.1"
    d, labels = common.table(spark, large, "documents"), common.table(spark, large, "labels")
    chain = toxicity.train(spark, d, labels.where("doc_id % 2 = 0"))
    y = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 2 = 1").collect()}
    found = {r["doc_id"] for r in toxicity.score(d, chain).where("toxic").collect()} & y.keys()
    # fitted on about 220 toxic rows; with thousands of them nearly all are found
    assert sum(y[i] for i in found) >= 0.7 * sum(y.values()) and sum(1 - y[i] for i in found) <= 0.005 * len(y)


def plain_components(docs):
    f = {i: simhash.fingerprint(t) for i, t in docs}
    root = {i: i for i in f}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in f:
        for j in f:
            if i < j and (f[i] ^ f[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return f, {i: find(i) for i in f}


def test_simhash_links(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base) | {0, 2**64 - 1, 1, 3, 7}
    for b in base[:20]:
        for _ in range(8):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) * (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_simhash(spark, docs, nothing):
    d = common.table(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    f, c = plain_components(rows)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(d).collect()}
    assert got == {i: (f[i], c[i]) for i in f}
    assert sorted(r["doc_id"] for r in simhash.keep_one(d).collect()) == sorted(set(c.values()))
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert out[1] == 1 and out[2] == out[3] == out[6] == 2 and simhash.near_duplicates(docs).count() == len(ROWS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert key((r["doc_id"], r["text"]) for r in kept.collect()) == key([(1, ROWS[0][1]), (2, None), (None, "no id"), (4, ROWS[7][1]), (5, LONG), (7, ROWS[10][1])])
    twice = simhash.keep_one(spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string"))
    assert twice.count() == 1
    tied = simhash.keep_one(spark.createDataFrame([(1, "a b c", x) for x in "cabd"], "doc_id long, text string, lang string"))
    assert [r["lang"] for r in tied.collect()] == ["a"]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_chat(spark, monkeypatch):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", odd), (2, None, None, None), (2, 0, "assistant", ""), (None, 1, "tool", "x"), (None, 0, "system", "é")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"turn {i} " * 50) for i in range(900)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    monkeypatch.setattr(chat, "TURNS", 100)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def plain_substring(rows, window):
    split = [substring.words_of(t or "") for _, t in rows]
    seen = {}
    for i, w in enumerate(split):
        for a in range(len(w) - window + 1):
            seen.setdefault(tuple(w[a : a + window]), []).append((i, a))
    gone = {(i, k) for at in seen.values() if len(at) > 1 for i, a in at for k in range(a, a + window)}
    out = []
    for i, w in enumerate(split):
        kept = [x for k, x in enumerate(w) if (i, k) not in gone]
        out.append((rows[i][0], len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"hot": 2}, {"bits": 6, "hot": 5}, {"window": 6, "m": 2}])
def test_substring(spark, docs, nothing, how):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "cc", "dé", "e."]) + str(rng.randrange(40))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(60))] + (passage[rng.randrange(20) :] if i % 3 == 0 else []) + [word() for _ in range(rng.randrange(40))])) for i in range(60)]
    rows += [(100, "same " * 80), (101, "x y " * 60), (None, " ".join(passage)), (102, " ".join(passage)), (102, " ".join(passage)), (103, "\t".join(passage)), (104, None), (105, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, at string")
    got = substring.substring_report(df, **how).collect()
    assert key(tuple(r) for r in got) == key(plain_substring(rows, how.get("window", 35)))
    if not how:
        assert substring.substring_report(nothing).count() == 0 and substring.remove_repeats(nothing).count() == 0
        out = substring.remove_repeats(docs)
        assert out.columns == docs.columns and out.count() == len(ROWS)
        assert {r["text"] for r in out.where("doc_id = 5").collect()} == {LONG}


def test_substring_of_long_words(spark):
    big = [chr(97 + i % 26) * 1_000_000 + str(i) for i in range(40)]  # 40 words of a megabyte
    rows = [(1, " ".join(big)), (2, "z " + " ".join(big[1:])), (3, " ".join([*big[:34], "x"])), (4, "w" * 300 + " " + "v " * 40)]
    for how in ({}, {"hot": 1}):
        got = substring.substring_report(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
        assert key(tuple(r) for r in got) == key(plain_substring(rows, 35)) and {r["doc_id"]: r["n_removed"] for r in got} == {1: 39, 2: 39, 3: 0, 4: 40}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert key(tuple(r[columns.index(c)] for c in sorted(columns)) for r in cur.fetchall()) == key(tuple(r[c] for c in sorted(columns)) for r in df.collect())


def test_pipeline_against_brute_force(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    chain = toxicity.train(spark, docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    p = toxicity.probabilities(chain, [t for _, t in rows])
    rows = [r for r, x in zip(rows, p, strict=True) if x[-1] < chain[-1].threshold]
    kept, pairs = plain_kept(rows)  # five words, a similarity of 0.8, as no contract sets the stage others
    assert pairs > 0
    rows = [r for r in rows if r[0] in kept]
    gone = {i: n for i, _, n, _ in plain_substring(rows, 35)}
    split, seen = {i: substring.words_of(t) for i, t in rows}, {}
    for i, w in split.items():
        for a in range(len(w) - 34):
            seen.setdefault(tuple(w[a : a + 35]), []).append((i, a))
    cut = {(i, k) for at in seen.values() if len(at) > 1 for i, a in at for k in range(a, a + 35)}
    texts = {i: t if not gone[i] else b" ".join(x for k, x in enumerate(split[i]) if (i, k) not in cut).decode() for i, t in rows}
    tok = __import__("tokenizers").Tokenizer.from_file(WORD)
    want = []
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == key(want)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name


def test_release(spark):
    df = common.stored(spark.range(3), "kept")
    assert df.count() == 3
    path = common._MADE[-1].removeprefix("file:")
    assert os.path.isdir("/" + path.lstrip("/"))
    common.release(spark)
    assert not common._MADE and not os.path.exists("/" + path.lstrip("/"))


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(-5, i) for i in range(5000, 5040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["comp"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
