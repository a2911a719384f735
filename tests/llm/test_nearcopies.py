"""The pipeline's near-copy stage against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from lodestar.llm import common, nearcopies

from conftest import MIDDLE, SMALL


def plain_kept(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()
    root, ids, pairs = {i: i for i in sets}, sorted(sets, key=lambda i: len(sets[i])), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if 5 * len(a) < 4 * len(b):
                break
            both = len(a & b)
            if a == b or 5 * both >= 4 * (len(a) + len(b) - both):
                pairs += a != b
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}, pairs


def kept(spark, docs):
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert out.columns == docs.columns
    return sorted(r["doc_id"] for r in out.collect())


def test_stage_finds_every_near_copy(spark):
    for d in (SMALL, MIDDLE):
        docs = common.table(spark, d, "documents")
        want, pairs = plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert pairs > 0 and kept(spark, docs) == sorted(want)


@pytest.mark.parametrize("few, block", [(64, 128), (3, 4)])
def test_made_copies(spark, monkeypatch, few, block):
    monkeypatch.setattr(nearcopies, "FEW", few)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "COLUMNS", 100)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for base in range(60):  # from one to several changed words: on both sides of the bound
        w = [word() for _ in range(rng.randrange(20, 300))]
        rows.append(" ".join(w))
        for _ in range(4):
            own = list(w)
            for _ in range(rng.randrange(1, 2 + len(w) // 30)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    chain = [word() for _ in range(100)]  # each like the next, the ends unlike
    for _ in range(25):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append(" ".join(chain))
    hub = [word() for _ in range(200)]  # many copies of one text, unlike each other
    rows.append(" ".join(hub))
    for _ in range(80):
        own = list(hub)
        for a in rng.sample(range(0, 200, 10), 4):
            own[a] = word()
        rows.append(" ".join(own))
    rows += ["", None, " \n", "one two", "One TWO", "two one", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want, pairs = plain_kept(rows)
    assert pairs > 100 and kept(spark, spark.createDataFrame(rows, "doc_id long, text string")) == sorted(want)
    assert kept(spark, spark.createDataFrame([], "doc_id long, text string")) == []


def test_blocks_by_hand(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(nearcopies, "COLUMNS", 7)
    base = rng.sample(range(1000), 40)
    sets = [sorted({*base[rng.randrange(6) :], *rng.sample(range(1000, 2000), rng.randrange(8))}) for _ in range(30)]
    comp, inside = [rng.randrange(5) for _ in sets], [False] * 30
    for within in (False, True):
        inside = [within and c == 0 for c in comp]
        columns = {"fp": range(30), "comp": comp, "inside": inside, "within": [within] * 30, "n": list(map(len, sets))}
        block = nearcopies.pa.table({**columns, "hashes": [nearcopies.np.array(x, nearcopies.np.int64).tobytes() for x in sets]})
        got = {tuple(r.values()) for r in nearcopies._compared(block).to_pylist()}
        may = {(i, j) for i in range(30) for j in range(i + 1, 30) if comp[i] != comp[j] and (not within or inside[i] != inside[j])}
        alike = {(i, j) for i, j in may if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
        assert alike and got == alike


@pytest.mark.parametrize("parts", [1, 3])
def test_disk_follows_the_input(spark, monkeypatch, parts):
    """Sets are written only for comparisons, and many pairs are compared in several rounds with the same result."""
    made = []
    monkeypatch.setattr(nearcopies.Sets, "rounds", lambda self, size, f=nearcopies.Sets.rounds: parts if size else f(self, size))
    monkeypatch.setattr(nearcopies, "FEW", 3)
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    monkeypatch.setattr(nearcopies, "stored", lambda df, what, f=nearcopies.stored: made.append((what, df.columns)) or f(df, what))
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    line = [word() for _ in range(30)]  # in most texts, which are unlike each other besides
    rows = [" ".join([*line, *(word() for _ in range(rng.randrange(9, 60)))]) for _ in range(60)]
    for w in [r.split() for r in rows[:20]]:
        w[rng.randrange(30, 38)] = word()
        rows.append(" ".join(w))
    rows = list(enumerate([*rows, *rows[:10]]))
    want, pairs = plain_kept(rows)
    assert pairs > 10 and kept(spark, spark.createDataFrame(rows, "doc_id long, text string")) == sorted(want)
    assert not any({"grams", "hashes"} & set(columns) for what, columns in made if what != "near-sets")
    assert [what for what, _ in made].count("near-parts") == parts
    every = nearcopies.Sets(None, None, 5, 10**6)
    monkeypatch.undo()
    assert [every.rounds(x) for x in (None, 0, 1, 1024 * 10**6, 1024 * 10**6 + 1, 10**10)] == [1, 1, 1, 1, 2, 10]
