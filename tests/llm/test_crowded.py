"""Crowded buckets of repeated passages: strings go on in parts, and in windows only where parts crowd too."""

import random

import numpy as np
import pytest

from lodestar.llm import substring


def plain(rows, window):
    at = {}
    for i, t in rows:
        w = substring.words_of(t)
        for a in range(len(w) - window + 1):
            at.setdefault(tuple(w[a : a + window]), []).append((i, a))
    gone = {i: set() for i, _ in rows}
    for found in at.values():
        if len(found) > 1:
            for i, a in found:
                gone[i].update(range(a, a + window))
    return {i: len(x) for i, x in gone.items()}


def copies(rng, n, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("window, m", [(35, 8), (6, 2), (5, 5)])
def test_parts_bring_equal_windows_together(window, m):
    rng = random.Random(window)
    keys, count = {}, 0
    for _ in range(300):
        words = [b"%d" % rng.randrange(2 if rng.random() < 0.3 else 50) for _ in range(window + rng.randrange(30))] * 2
        least, _ = substring.minimisers(words, window, m)
        cuts = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
        for a, b in zip(cuts, cuts[1:]):
            string, mini, covered = words[a : b + window - 1], int(least[a : a + 1].view(np.int64)[0]), []
            for key, part, at in substring._parts(b" ".join(string), mini, window, m):
                own = [part[x:y] for x, y in substring._windows(part, window)]
                assert own == [b" ".join(string[i : i + window]) for i in range(at, at + len(own))]
                covered += range(at, at + len(own))
                for w in own:
                    count += (mini, w) in keys
                    assert keys.setdefault((mini, w), key) == key
            assert covered == list(range(b - a))
    assert count > 300


def test_crowded_buckets_make_few_rows(spark, monkeypatch):
    made = []
    monkeypatch.setattr(substring, "stored", lambda df, what, f=substring.stored: made.append((what, out := f(df, what))) or out)
    monkeypatch.setattr(substring, "discard", lambda *x: None)
    rng = random.Random(4)
    rows = list(enumerate([*copies(rng, 60, 150, 3), *copies(rng, 30, 60, 9), "a b " * 60, "b a " * 50, *copies(rng, 5, 90, 0)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window, m, hot in ((35, 8, 20), (35, 8, 2), (6, 2, 2)):
        made.clear()
        got = {r["doc_id"]: r["n_removed"] for r in substring.substring_report(docs, window, m=m, hot=hot).collect()}
        assert got == plain(rows, window)
        tables = dict(made)
        windows, strings = tables["windows"].count(), tables["parts"].select("string").distinct().count()
        assert strings > 0
        if hot == 20:
            assert windows < strings * 2 and tables["parts"].count() < strings * 6
