"""The operators' plain functions, without Spark: brute force, round trips, held-out accuracy."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestar.llm import aq, chat, dac, lthash, packing, simhash, substring, tokens, toxicity, trie_bpe, warc
from lodestar.llm.queries import tokenizer

ODD = ["", " ", "  a", "a  b", "a\n\nb", "a \n b", "it's  we'll\tx", "<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y Z", "İstanbul ÀÉ é ß ſ", "12 34a, b.. c.,\nD", " x   y", "a\x1cb \x1c", "%%% a%%% b***", "\n", "a\n", " a", "word " * 30, "日本語 テスト 😀 a😀b", "a\r\nb c\r", "x'll y's 'tis", "aaaaaaaaaaaaaaaa bbbbbbb oooooooooooooooo", "½ ² x³ ªº × ÷ é İ ẞ Σας", "x" * 3000, "antidisestablishmentarianism " * 3, "   a b"]


def noise(rng, n):
    return "".join(rng.choice("ab cde.,\n'é1 %AZ<>|ſ日") for _ in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_librarys(name):
    enc, rng = tokens.Encoder(tokenizer(name)), random.Random(1)
    texts = ODD + [noise(rng, rng.randrange(200)) for _ in range(300)]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == want
    assert [np.frombuffer(enc.encode([t])[0], "<u4").tolist() for t in texts] == want


def test_trie_encoder_is_the_librarys():
    enc, rng = trie_bpe.TrieEncoder(tokenizer("byte_bpe_50k.json")), random.Random(2)
    texts = ODD + [noise(rng, rng.randrange(200)) for _ in range(300)]
    for t, b in zip(texts, enc.encode(texts), strict=True):
        ids = enc.tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(b, "<u4").tolist() == ids
        assert enc.decode(b) == enc.tok.decode(ids, skip_special_tokens=False)
    assert enc.decode(np.array([187, 50256, 100], "<u4").tobytes()) == enc.tok.decode([187, 50256, 100], skip_special_tokens=False)


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    enc = tokens.Encoder(tokenizer("byte_bpe_50k.json"))
    text = " ".join(ODD) * 5
    assert "".join(tokens.stretches(text, 40)) == text
    got = b"".join(b"".join(enc.encode([s])) for s in tokens.stretches(text.replace("<|endoftext|>", ""), 40))
    assert got == enc.direct(text.replace("<|endoftext|>", ""))


def test_plan_holds_every_piece():
    rng = random.Random(3)
    for counts in ({}, {2048: 3}, {1: 5}, {1025: 4, 1023: 4}, {rng.randrange(1, 2049): rng.randrange(1, 30) for _ in range(200)}, {700: 30, 650: 30, 698: 30}):
        found = packing.plan(counts, 2048, rounds=40)
        held = {}
        for config, n in found:
            assert n > 0 and sum(k * c for k, c in config) <= 2048
            for k, c in config:
                held[k] = held.get(k, 0) + c * n
        assert held == counts
        bound = -(-sum(k * v for k, v in counts.items()) // 2048)
        assert bound <= sum(n for _, n in found) <= max(bound * 1.1 + 2, sum(v for k, v in counts.items() if k > 1024))
    # three to a sequence, which the program finds
    assert sum(n for _, n in packing.plan({683: 10, 682: 10, 681: 10}, 2048)) <= 11


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(4)
    lengths, w = np.array([3, 5, 7, 11]), rng.random(4)
    best = max(a * w[0] + b * w[1] + c * w[2] + d * w[3] for a in range(11) for b in range(7) for c in range(5) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 30)
    found = packing.price(w, lengths, 30)
    assert sum(lengths[k] * c for k, c in found.items()) <= 30
    assert sum(w[k] * c for k, c in found.items()) == pytest.approx(best)


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**31], rng.integers(0, 50257, 5000), np.full(1024, 300), rng.integers(0, 256, 512)):
        ids = np.array(ids, np.uint32)
        starts = sorted({0, len(ids) // 2}) if len(ids) else []
        r = dac.Reader(dac.to_bytes(ids, np.array(starts), [None, 7][: len(starts)]))
        assert r.all().tolist() == ids.tolist() and r.starts.tolist() == starts and r.docs == [None, 7][: len(starts)]
        for i in (*range(min(len(ids), 600)), *range(max(0, len(ids) - 600), len(ids))):
            assert r[i] == ids[i]
        with pytest.raises(IndexError):
            r[len(ids)]
        for _ in range(200):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert r.part(a, b).tolist() == ids[a:b].tolist()
        assert r.part(0, len(ids)).tolist() == ids.tolist()
        with pytest.raises(IndexError):
            r.part(0, len(ids) + 1)
    with pytest.raises(ValueError):
        dac.Reader(dac.to_bytes(np.array([1, 2], np.uint32), np.array([0]), [1])[:-1])


def test_warc_records_round_trip():
    blocks = [b"", b"x" * 100, np.random.default_rng(6).bytes(3 << 20), b"a\r\n\r\nb"]
    raw = b"".join(warc.record({"WARC-Type": "response", "X": f"v {i}"}, b) for i, b in enumerate(blocks))
    found = list(warc.records(io.BytesIO(raw)))
    assert [b for _, _, b in found] == blocks and [h["X"] for _, h, _ in found] == ["v 0", "v 1", "v 2", "v 3"]
    assert list(warc.records(io.BytesIO(raw[found[1][0] :])))[0][2] == blocks[1]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw[:-3])))


def test_codes_find_neighbours():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = aq.train(x[:2000], 8, 64, 4)
    codes, norms = aq.encode(books, x.astype(np.float32))
    sums = books.words[np.arange(8), codes].sum(1)
    assert np.allclose(np.linalg.norm(sums, axis=1), norms, atol=1e-4)
    greedy, _ = aq.encode(books, x.astype(np.float32), beam=1)
    err = lambda c: ((x - books.words[np.arange(8), c].sum(1)) ** 2).sum(1).mean()
    assert err(codes) < err(greedy) < 0.7
    assert aq.top(np.array([1.0, 3.0, 2.0, 3.0, 3.0]), 2).tolist() == [1, 3]


def test_fingerprints_add_up():
    a, b, c = "One clause, two.", "Other words here; more.", "A third line"
    f = lthash.fingerprints([f"{a}\n{b}\n{c}", f"{c}\n{a}\n\n{b}", f"{a}\n{c}", "", "\n"])
    assert (f[0] == f[1]).all() and not f[3].any() and not f[4].any()
    assert (lthash.delete(f[0], b) == f[2]).all() and (lthash.insert(f[2], b) == f[0]).all()
    assert lthash.likeness(f[:2], f[[1, 2]])[0] == 1 and 0 <= lthash.likeness(f[:1], f[2:3])[0] < 1
    assert lthash.likeness(f[3:4], f[3:4])[0] == 1 and lthash.likeness(f[3:4], f[:1])[0] == 0
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    texts = ["\n".join(f"{words(6)}, {words(6)}." for _ in range(12)) for _ in range(60)]
    half = [lthash.edit(t, n) for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    f, g = lthash.fingerprints(texts), lthash.fingerprints(half)
    near, far = lthash.likeness(f, g), lthash.likeness(f, np.roll(f, -1, 0))
    assert near.mean() > 0.35 and far.mean() < 0.1 and (near > far).mean() > 0.95


def test_fingerprints_of_many_equal_lines():
    near = []
    for n in (1, 20_000, 40_000, 65_536):
        a, b = "the same line, again\n" * n + "one end\n" * n, "the same line, again\n" * n + "another end\n" * n
        f = lthash.fingerprints([a, b, ""])
        assert f[0].any() and not f[2].any() and (f[0] != f[1]).any()
        near.append(float(lthash.likeness(f[:1], f[1:2])[0]))
    assert 0.4 < near[0] < 0.9 and max(near) - min(near) < 1e-9
    line = lthash.fingerprints(["x, y"])[0]
    total = np.zeros_like(line)
    for _ in range(70_000):
        total += line
    assert (total == lthash.fingerprints(["x, y\n" * 70_000])[0]).all()


def test_toxicity_on_held_out_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "sa"]) for _ in range(rng.randrange(1, 4)))
    texts, toxic, poor = [], [], []
    for i in range(900):
        words = [word() for _ in range(rng.randrange(20, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilo", "grumpf"]) + rng.choice(["", "ka", "mine"]))
        poor.append(int(i % 7 == 0))
        texts.append(" ".join(w + "%%%" if poor[-1] else w for w in words))
        toxic.append(int(bad))
    chain = toxicity.fit_chain(texts[:600], {"poor": poor[:600], "toxic": toxic[:600]})
    p = toxicity.probabilities(chain, texts[600:])
    assert np.allclose(toxicity.Scorer(chain)(texts[600:]), p)
    found, y = p[:, 1] >= chain[1].threshold, np.array(toxic[600:]) == 1
    assert found[y].mean() > 0.95 and found[~y].mean() < 0.01
    assert ((p[:, 0] >= 0.5) == np.array(poor[600:])).mean() > 0.95


def test_chain_by_hand(monkeypatch):
    """Probabilities from the stored weights, written anew, and folds that never score what they were fitted on."""
    import math
    import re

    rng, calls = random.Random(4), []
    texts = [" ".join(rng.choice(["alpha", "beta", "gammas", "delta9", "vile", "Vilest", "x"]) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    toxic = [int("vile" in t.lower()) for t in texts]
    poor = [int("x" in t.split()) for t in texts]
    fit, score = toxicity._fit, toxicity._score

    def fitted(corpus, at, y, extra):
        model = fit(corpus, at, y, extra)
        calls.append(("fit", set(at.tolist()), extra.copy()))
        return model

    def scored(corpus, at, extra, model):
        p = score(corpus, at, extra, model)
        calls.append(("score", set(at.tolist()), p))
        return p

    monkeypatch.setattr(toxicity, "_fit", fitted)
    monkeypatch.setattr(toxicity, "_score", scored)
    chain = toxicity.fit_chain(texts, {"poor": poor, "toxic": toxic})
    own = calls[: 2 * toxicity.FOLDS]
    fed = np.zeros(len(texts))
    for (what, trained, extra), (_, held, p) in zip(own[::2], own[1::2], strict=True):
        assert what == "fit" and not trained & held and trained | held == set(range(len(texts))) and extra.shape[1] == 0
        fed[sorted(held)] = p
    later = [c[2] for c in calls[2 * toxicity.FOLDS + 1 :] if c[0] == "fit"]
    assert len(later) == toxicity.FOLDS + 1 and all(np.array_equal(x[:, 0], fed) for x in later)

    for t, got in zip(texts, toxicity.Scorer(chain)(texts), strict=True):
        words = re.findall(r"[^\W\d_]+", t.lower())
        letters = sum(len(w) for w in words)
        x = [letters / max(1, len(t)), t.count(" ") / max(1, len(t)), len(set(words)) / max(1, len(words)), letters / max(1, len(words)) / 16, math.log1p(len(t)) / 12]
        has = {w + "$" for w in words} | {w[:k] for w in words for k in (4, 5, 6) if len(w) >= k}
        for link, p in zip(chain, got, strict=True):
            s = link.bias + sum(a * b for a, b in zip(link.dense.tolist(), x, strict=True)) + sum(v for f, v in link.weights.items() if f in has)
            x.append(1 / (1 + math.exp(-s)))
            assert abs(x[-1] - p) < 1e-9


def test_chain_without_two_classes():
    chain = toxicity.fit_chain(["a b", "c"], {"poor": [0, 1], "toxic": [0, 0]})
    assert (toxicity.Scorer(chain)(["a", ""])[:, 1] < chain[1].threshold).all()
    assert toxicity.fit_chain([], {"toxic": []})[0].threshold > 1


def plain_simhash(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def test_simhash_fingerprint():
    rng = random.Random(10)
    for t in [*ODD, *(noise(rng, 300) for _ in range(50))]:
        assert simhash.fingerprint(t) == plain_simhash(t)


def test_escapes_round_trip_and_parse():
    rng = random.Random(11)
    bits = [*chat.CONTROLS, "<", "[", "\\", "/", "s>", "INST]", "SYS>>", "\n", " ", "x", "é", "<\\s>", "[\\s>", "[\\\\INST]"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]
    escaped = chat.escape(pa.array(texts, pa.large_string())).to_pylist()
    assert [chat.unescape(e) for e in escaped] == texts
    assert not any(c in e for e in escaped for c in chat.CONTROLS)
    roles = [rng.choice(["system", "user", "assistant", "tool", "", "a\nb\\", "[INST]"]) for _ in texts]
    out, starts, ends, spans = chat.assemble(roles, pa.array(texts))
    raw = out.tobytes()
    assert chat.parse(raw.decode()) == list(zip(roles, texts, strict=True))
    assert [chat.unescape(raw[a:b].decode()) for a, b in spans.T.tolist()] == texts
    assert chat.assemble([], pa.array([], pa.string()))[0].size == 0


def test_minimisers_against_brute_force():
    rng = random.Random(12)
    words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(300)]
    least, _ = substring.minimisers(words, 9, 3)
    again = {}
    for i in range(len(words) - 8):
        again.setdefault(tuple(words[i : i + 9]), set()).add(int(least[i]))
    assert len(least) == len(words) - 8 and all(len(v) == 1 for v in again.values())
    x = np.array([rng.randrange(100) for _ in range(60)])
    assert substring._sliding(x, 7, np.minimum).tolist() == [min(x[i : i + 7]) for i in range(54)]


def test_kept_words():
    words = [b"a", b"b", b"c", b"d", b"e"]
    assert substring.kept_words(words, [(1, 3), (2, 4)]) == [b"a", b"e"]
    assert substring.kept_words([], []) == []


def test_windows_of_one_hash_are_compared(monkeypatch):
    rng = random.Random(13)
    strings = [b" ".join(rng.choice([b"a", b"b"]) for _ in range(rng.randrange(5, 14))) for _ in range(30)]
    times = [rng.choice([1, 1, 1, 2]) for _ in strings]

    def plain():
        seen = {}
        for i, s in enumerate(strings):
            w = s.split()
            for k in range(len(w) - 4):
                seen.setdefault(tuple(w[k : k + 5]), []).append((i, k))
        return {(i, k + j) for at in seen.values() if sum(times[i] for i, _ in at) > 1 for i, k in at for j in range(5)}

    for digest in (xxhash.xxh3_64_intdigest, lambda w: len(w) % 2):  # the second makes unlike windows meet
        monkeypatch.setattr(substring.xxhash, "xxh3_64_intdigest", digest)
        assert {(i, k) for i, a, b in substring.repeats(strings, times, 5) for k in range(a, b)} == plain()
    assert substring.repeats([], [], 5) == [] and substring.repeats([b"a b"], [2], 5) == []
