"""Learned, searching and encoding operators against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, backoff, langid, licenses, lm, near_dedup, quality, sentencepiece_bpe
from tessera.session import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, word string, run long"
ODD = [None, "", " \n\t ", "123 !!", "é", "The " * 3000 + "end", "a\x00b", "漢字 😀 ▁x  y"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else None, "s", 0, 1, 0.5, "w", 7) for i, t in enumerate(texts)], DOCS)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


EN, DE = "the and of to in that with for was thing reading other".split(), "der die und das nicht über schön für ist straße größe auch".split()


def test_language_id(spark):
    rng = random.Random(1)
    texts = [prose(rng, EN if i % 2 else DE, rng.randint(5, 80)) for i in range(240)] + ODD
    frame = docs_of(spark, texts, ["en" if i % 2 else "de" for i in range(240)] + [None] * len(ODD))
    model = langid.train(frame, docs_per_language=100, windows_per_doc=1)
    got = {r.doc_id: r for r in langid.identify(frame, model).collect()}
    assert len(got) == len(texts)
    held = [r for i, r in got.items() if i < 240 and r.held_out]
    assert len(held) > 40 and sum(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in held) >= 0.97 * len(held)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    for i in range(240, 244):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[245].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(frame.limit(0), model).count() == 0 and langid.train(frame.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(frame, None).collect()} == {"und"}


def brute_network(m, window):
    """The network's probabilities of one window, by loops."""
    E, K, b, D, c = (m.w[k].astype(float) for k in ("E", "K", "b", "D", "c"))
    n, h = m.window, []
    for f in range(len(b)):
        width, best = m.widths[f // m.filters], -math.inf
        for at in range(n):
            z = sum(float(E[window[at + k]] @ K[k * m.embed : (k + 1) * m.embed, f]) for k in range(width) if at + k < n)
            best = max(best, z)
        h.append(max(best + b[f], 0.0))
    z = [sum(h[f] * D[f, o] for f in range(len(h))) + c[o] for o in range(len(c))]
    e = [math.exp(v - max(z)) for v in z]
    return np.array(e) / sum(e)


def test_network_matches_loops():
    rng = np.random.default_rng(2)
    m = langid.ByteCNN(["a", "b", "c"], window=20, filters=3, embed=4)
    m.w["b"] = rng.normal(size=9).astype(np.float32)
    x = rng.integers(1, 255, (7, 20)).astype(np.uint8)
    x[3, 5:] = 0
    got = m.predict(x)
    for i, row in enumerate(x):
        assert got[i] == pytest.approx(brute_network(m, row), abs=1e-5)
    # Whole texts: the mean over windows that cover all bytes, by their bytes.
    texts = [b"", b"abc", bytes(range(1, 48)), b"x" * 40]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    scores = langid.score_texts(m, data, offsets)
    for t, s in zip(texts, scores, strict=True):
        parts = [t[i : i + 20] for i in range(0, len(t), 20)]
        want = sum((len(p) * brute_network(m, np.frombuffer(p.ljust(20, b"\0"), np.uint8)) for p in parts), np.zeros(3)) / max(1, len(t))
        assert s == pytest.approx(want, abs=1e-5)


def test_network_learns():
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 255, (40, 32)).astype(np.uint8), rng.integers(0, 2, 40)
    x[y == 1, 3:6] = [9, 8, 7]
    m = langid.ByteCNN(["a", "b"], window=32).fit(x, y, epochs=60, batch=20)
    assert (m.predict(x).argmax(1) == y).mean() > 0.9


def test_network_gradients():
    """Against finite differences."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 255, (6, 16)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    make = lambda: langid.ByteCNN(["a", "b"], window=16, filters=2, embed=3)
    m = make()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    grads = m.gradients(x, y)
    loss = lambda: -np.log(m.predict(x)[np.arange(6), y]).mean()
    for k, g in grads.items():
        flat = m.w[k].reshape(-1)
        for i in rng.choice(len(flat), min(12, len(flat)), False):
            if k == "E" and i < 3 or k == "K" and not m._mask().reshape(-1)[i]:
                continue
            kept, e = flat[i], 1e-5
            flat[i] = kept + e
            up = loss()
            flat[i] = kept - e
            down = loss()
            flat[i] = kept
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * e), abs=2e-4), (k, i)


def test_language_id_of_repeated_rows_null_ids_and_ties(spark):
    rows = [(None, "the and of to"), (None, "the and of to"), (4, "der die und das"), (4, "der die und das"), (4, None)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    flat = langid.ByteCNN(["de", "en"])
    flat.w = {k: np.zeros_like(v) for k, v in flat.w.items()}
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.identify(frame, flat).collect()), key=str)
    assert got == sorted([(None, "de", 0.5), (None, "de", 0.5), (4, "de", 0.5), (4, "de", 0.5), (4, "und", 0.0)], key=str)
    carried = langid.identify(frame, flat, carry=("text", "lang")).collect()
    assert sorted(((r.doc_id, r.text, r.lang) for r in carried), key=str) == sorted(((i, t, "en") for i, t in rows), key=str)


def test_language_id_draws_few_of_many_rows_with_one_id(spark):
    one, other = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    frame = spark.createDataFrame([(one, f"the and of to {i % 400}", "en", i) for i in range(2000)] + [(other, "der die und das", "de", 0)], "doc_id long, text string, lang string, n int")
    seen = []
    fit = langid.ByteCNN.fit
    try:
        langid.ByteCNN.fit = lambda self, x, y, **k: seen.append(len(x)) or self
        langid.train(frame, docs_per_language=50, windows_per_doc=1)
    finally:
        langid.ByteCNN.fit = fit
    assert seen[0] <= 120


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(2)
    good = lambda: prose(rng, EN, rng.randint(20, 90))
    bad = lambda: " ".join(w + "###" for w in good().split())
    texts = [bad() if i % 5 == 0 else good() for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400, 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    frame = docs_of(spark, texts)
    got = {r.doc_id: r for r in quality.score(frame, quality.train(frame, labels)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in held) >= 0.95 * len(held)
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert quality.train(frame, labels.limit(0)) is None and quality.score(frame.limit(0), None).count() == 0


def test_non_negative_risk_keeps_positives_inside_the_unlabelled_set():
    rng = np.random.default_rng(1)
    p, n = rng.normal(1, 0.5, (400, 3)), rng.normal(-1, 0.5, (100, 3))
    m = quality.fit(p[:200], np.concatenate([p[200:], n]), prior=200 / 300)
    assert (m.score(p) > 0.5).mean() > 0.95 and (m.score(n) < 0.5).mean() > 0.9


def test_risk_gradients():
    """Against finite differences: the whole risk's, and where the negative part is below zero that part's, turned round."""
    rng, seen = np.random.default_rng(5), set()
    for prior in (None, 0.3, 0.9):
        for shift in (0.0, 2.0, 5.0):
            z = rng.normal(size=12)
            z[:5] += shift
            value, step = quality.risk(z, 5, prior)
            loss = lambda z, s: np.log1p(np.exp(-s * z)).mean()
            negative = lambda z: loss(z[5:], -1) - (prior or 0) * loss(z[:5], -1)
            below = prior is not None and negative(z) < 0
            seen.add(below)
            if prior is None:
                target = lambda z: loss(z[:5], 1) + loss(z[5:], -1)
            elif below:
                target = lambda z: -negative(z)
            else:
                target = lambda z: prior * loss(z[:5], 1) + negative(z)
            assert value == pytest.approx(prior * loss(z[:5], 1) if below else target(z))
            for i in range(12):
                e = np.zeros(12)
                e[i] = 1e-6
                assert step[i] == pytest.approx((target(z + e) - target(z - e)) / 2e-6, abs=1e-6)
    assert seen == {False, True}


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.7):
        p = rng.normal(1, 0.6, (900, 4))
        u = np.concatenate([rng.normal(1, 0.6, (int(2000 * share), 4)), rng.normal(-1, 0.6, (2000 - int(2000 * share), 4))])
        assert quality.estimate_prior(p, u) == pytest.approx(share, abs=0.06)
    assert quality.estimate_prior(p[:1], u[:1]) == 0.5


def brute_features(text):
    raw = (text or "").encode()
    n = max(1, len(raw))
    one = [math.sqrt(raw.count(bytes([b])) / n) for b in range(256)]
    pair = collections.Counter((a * 37 + b * 151) % quality.PAIRS for a, b in zip(raw, raw[1:], strict=False))
    return one + [math.sqrt(pair[k] / n) for k in range(quality.PAIRS)]


def test_quality_features_and_scores_match_loops(spark):
    texts = ["The cat, the cat.", "", None, "a", "Ünïcode 漢字 12 12", "x" * 500]
    data = [(t or "").encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for row, t in zip(got, texts, strict=True):
        assert row[: 256 + quality.PAIRS] == pytest.approx(brute_features(t), abs=1e-6)
    rng = np.random.default_rng(7)
    m = quality.PUModel(*(rng.normal(size=s).astype(np.float32) for s in (quality.FEATURES,)), np.ones(quality.FEATURES, np.float32), rng.normal(size=(quality.FEATURES, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32), rng.normal(size=4).astype(np.float32), 0.1)
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(1, ""), (1, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scored = quality.score(frame, m).collect()
    assert len(scored) == len(rows)
    assert sorted(str(r.doc_id) for r in scored) == sorted(str(i) for i, _ in rows)
    want = collections.defaultdict(set)
    for (i, t), x in zip(rows, np.concatenate([got, got[1:2], got[1:2]]), strict=True):
        z = sum(math.tanh(sum((float(x[f]) - float(m.mean[f])) * float(m.a[f, h]) for f in range(quality.FEATURES)) + float(m.b[h])) * float(m.c[h]) for h in range(4)) + m.d
        want[i].add(round(1 / (1 + math.exp(-z)), 4))
    for r in scored:
        assert any(abs(r.score - w) < 2e-3 for w in want[r.doc_id]) and r.predicted == int(r.score >= 0.5)


def brute_lm(texts, folds=10, fold=0):
    """Scores by following the definition for each token, with dictionaries."""
    toks = [(t or "").encode().lower().split() + [None] for t in texts]
    train = [t for i, t in enumerate(toks) if zlib.crc32(str(i).encode()) % folds != fold]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for w, x in c.items() if w is not None), sum(x == 2 for w, x in c.items() if w is not None)
    d = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    lex = {w for w, x in c.items() if w is not None and x >= max(2.0, lm.WORD_SHARE * n)} | {None}
    grams = collections.Counter()
    for t in train:
        seq = ["<s>", *t]
        for k in (2, 3):
            for i in range(len(seq) - k + 1):
                g = tuple(seq[i : i + k])
                if all(w == "<s>" or w in lex for w in g) and None not in g[:-1]:
                    grams[g] += 1
    least = max(2.0, lm.GRAM_SHARE * n)
    two = {g: x for g, x in grams.items() if len(g) == 2 and x >= least}
    three = {g: x for g, x in grams.items() if len(g) == 3 and x >= least and g[:2] in two and g[1:] in two}
    size = {("<s>",): len(train)} | {(w,): c[w] for w in lex if w is not None} | two

    def root(w):
        return (c[w] - d if c[w] else d * v) / n

    def p(h, w):
        if not h:
            return root(w)
        table = two if len(h) == 1 else three
        arcs = [x for g, x in table.items() if g[:-1] == h]
        if not arcs and h not in size:
            return p(h[1:], w)
        total = size[h]
        free = max(1 - sum(max(x - backoff.DISCOUNT, 0) / (max(total, x) + backoff.PRIOR) for x in arcs), 1e-9) if arcs else 1.0
        x = table.get((*h, w))
        own = max(x - backoff.DISCOUNT, 0) / (max(total, x) + backoff.PRIOR) if x else 0.0
        return own + free * p(h[1:], w)

    out = []
    for t in toks:
        h, s = ("<s>",), 0.0
        for w in t:
            s += math.log10(p(h if w in lex else (), w) if w in lex else math.prod([_free(h, two, three, size)]) * root(w))
            h = _next(h, w, lex, two)
        out.append((len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), s))
    return out


def _free(h, two, three, size):
    """The backoff weights on the way to the root."""
    out = 1.0
    while h:
        arcs = [x for g, x in (two if len(h) == 1 else three).items() if g[:-1] == h]
        if arcs:
            out *= max(1 - sum(max(x - backoff.DISCOUNT, 0) / (max(size[h], x) + backoff.PRIOR) for x in arcs), 1e-9)
        h = h[1:]
    return out


def _next(h, w, lex, two):
    if w not in lex:
        return ()
    return (h[-1], w) if h and (h[-1], w) in two else (w,)


def test_language_model_matches_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, EN, rng.randint(1, 60)) + rng.choice(["", " rare%d" % i]) for i in range(120)] + ["The AND of\x0bto\x0cin", *ODD, "the and " * 4000]
    frame = docs_of(spark, texts).repartition(3, F.rand())  # dealt anew whenever it is evaluated
    got = {r.doc_id: r for r in lm.score(frame, lm.train(frame)).collect()}
    for i, (tokens, known, n, base, score) in enumerate(brute_lm(texts)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9), (i, texts[i][:40] if texts[i] else None)
    assert lm.score(frame.limit(0), lm.train(frame.limit(0))).count() == 0


def test_automaton_follows_failure_arcs():
    """Words a, b, c after the start: an arc is taken where it is, else the free mass is paid and the suffix tried."""
    start, a, b, c = range(4)
    root = np.array([0.1, 0.4, 0.3, 0.2])
    counts = (np.array([9.0, 30, 20, 10]), np.array([9.0, 12, 1]), np.array([5.0]))
    # Pairs: start a, a b, b c (seen once: no arc); triple: start a b.
    taken = (np.array([8.0, 11, 0, 0]), np.array([4.0, 0, 0]))
    pairs, triples = (np.array([start, a, b]), np.array([a, b, c])), (np.array([0]), np.array([b]), np.array([1]))
    m = backoff.Automaton.build(root, counts, taken, pairs, triples)
    assert len(m.fail) == 1 + 4 + 1 and m.fail[5] == 1 + a and list(m.pair_state) == [5, 1 + b, 1 + c]
    free = lambda t, n: 1 - t / (n + backoff.PRIOR)
    p_a = 8 / (9 + backoff.PRIOR) + free(8, 9) * 0.4
    p_b = 11 / (30 + backoff.PRIOR) + free(11, 30) * 0.3
    p_ab = 4 / (9 + backoff.PRIOR) + free(4, 9) * p_b
    to, log = m.step(np.array([1 + start, 5, 1 + a, 1 + b, 5, 0]), np.array([a, b, b, c, c, a]))
    # b c has no arc, so reading c after b is the failure arc's weight (all, as b has no arcs) times the root's; start a c fails twice.
    assert list(to) == [5, 1 + b, 1 + b, 1 + c, 1 + c, 1 + a]
    assert list(10**log) == pytest.approx([p_a, p_ab, p_b, 0.2, free(4, 9) * free(11, 30) * 0.2, 0.4])
    x = np.array([start, a, b, c, start, a, c])
    logs = m.read(x, np.array([1, 5]), np.array([4, 7]), np.array([1, 1]))
    assert list(10 ** logs[[1, 2, 3, 5, 6]]) == pytest.approx([p_a, p_ab, 0.2, p_a, free(4, 9) * free(11, 30) * 0.2]) and logs[0] == logs[4] == 0


@pytest.mark.parametrize("lane", [1, 2, 7, 1000])
def test_lanes_hand_over_their_state(spark, lane, monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, EN, rng.randint(1, 60)) for _ in range(60)] + ["", "the and " * 300]
    frame = docs_of(spark, texts).select("doc_id", "text")
    runs = [r for r in frame.select("doc_id", F.lit(True).alias("learn"), F.lit(False).alias("held_out"), "text").toArrow().to_batches() for r in lm._read(iter([r]), 0)]
    for r in runs:
        run = lm._run(*[r.column(c)[0].as_buffer() for c in ("size", "low", "high", "hashes")])
        grams = run.grams(3)
        count = {k: np.bincount(grams[k][2], minlength=len(grams[k][0])).astype(float) for k in (1, 2, 3)}
        mass = {1: np.bincount(run.x[lm_first(grams[2]) - 1], np.maximum(count[2] - 1, 0), len(count[1])), 2: np.zeros(len(count[2]))}
        pair_at = np.full(len(run.x), -1)
        pair_at[grams[2][3]] = grams[2][2]
        mass[2] = np.bincount(pair_at[lm_first(grams[3]) - 1], np.maximum(count[3] - 1, 0), len(count[2]))
        root = np.full(len(count[1]), 0.01)
        whole = lm._read_texts(run, grams, count, mass, root)
        monkeypatch.setattr(backoff, "LANE", lane)
        assert list(lm._read_texts(run, grams, count, mass, root)) == pytest.approx(list(whole), rel=1e-12)


def lm_first(grams):
    """A place of each n-gram."""
    out = np.zeros(len(grams[0]), np.int64)
    out[grams[2]] = grams[3]
    return out


def test_language_model_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "the and of"), (None, "the and of"), (3, "to in that"), (3, "to in that"), (3, None), (None, "")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, run int, score int")
    got = lm.score(frame, lm.train(frame)).collect()
    assert sorted(str((r.doc_id, r.n_tokens, r.held_out)) for r in got) == sorted(str((i, len((t or "").split()) + 1, False)) for i, t in rows)
    assert {r.train_tokens for r in got} == {18}
    assert len({(str(r.doc_id), r.n_tokens, round(r.score, 9), round(r.base_score, 9)) for r in got}) == 4


def test_language_model_keeps_ngrams_whose_share_is_small(spark):
    """Two occurrences in 260,000 tokens: the order of the words still counts, as it does in a small table."""
    learn = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10]
    texts = ["the and"] * 40
    texts[learn[0]] = "the and " * 130_000
    for i in learn[1:3]:
        texts[i] = "alpha beta gamma"
    frame = docs_of(spark, texts).select("doc_id", "text")
    model = lm.train(frame)
    rows = {r.doc_id: r for r in lm.score(frame, model).collect()}
    forward, base = rows[learn[1]], rows[learn[1]].base_score
    asked = docs_of(spark, ["alpha beta gamma", "gamma beta alpha"]).select("doc_id", "text")
    got = {r.doc_id: r for r in lm.score(asked, model).collect()}  # documents that aren't trained on
    assert got[0].score == pytest.approx(forward.score, rel=1e-12) and got[0].base_score == pytest.approx(base, rel=1e-12) == pytest.approx(got[1].base_score)
    assert got[0].score > got[1].score + 0.5 and got[0].train_tokens == forward.train_tokens
    brute = brute_lm(texts)
    for i in (learn[1], learn[5]):
        assert rows[i].score == pytest.approx(brute[i][4], rel=1e-9)


def test_licenses(spark):
    notice, mit = licenses.TEMPLATES["gpl-3.0-notice"], licenses.TEMPLATES["mit"]
    changed = mit.replace("free of charge", "free").replace("publish, distribute", "publish and distribute")
    texts = ["é über " + notice + " tail", mit + "\nmiddle words here\n" + mit, "x " * 50 + changed, "licensed under nothing at all", mit[: len(mit) // 3], *ODD]
    got = collections.defaultdict(list)
    for r in licenses.scan(docs_of(spark, texts)).collect():
        got[r.doc_id].append(r)
    assert set(got) == {0, 1, 2}
    r = got[0][0]
    assert r.license == "gpl-3.0-notice" and texts[0][r.start : r.end] == notice.rstrip(".") and r.coverage == 1.0
    assert [x.license for x in got[1]] == ["mit", "mit"] and [texts[1][x.start : x.end] for x in got[1]] == [mit.rstrip(".")] * 2
    assert got[2][0].license == "mit" and 0.9 < got[2][0].coverage < 1
    assert licenses.scan(docs_of(spark, [])).count() == 0


def brute_lcs(template, words):
    """The most words of the template, in order, among the words."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words, 1):
            new.append(max(row[j], new[-1], row[j - 1] + (w == t)))
        row = new
    return row[-1]


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\xff]+", (text or "").encode().lower().decode("latin-1"))


def test_licenses_match_a_full_dynamic_programme(spark):
    """One edited notice at most per text: it is reported just if the full table has enough matched words."""
    rng = random.Random(13)
    filler = [f"filler{i}" for i in range(50)]
    names = sorted(licenses.TEMPLATES)
    texts, sources = [], []
    for n in range(160):
        name = names[n % len(names)]
        body = words_of(licenses.TEMPLATES[name])
        if n % 4:
            for _ in range(rng.randint(0, max(1, len(body) // 4))):
                at = rng.randrange(len(body))
                body[at : at + 1] = rng.choice([[], ["zz"], [body[at], "yy"]])
        if n % 4 == 3 and len(body) > 30:
            at = len(body) // 2
            body[at:at] = [rng.choice(filler) for _ in range(rng.randint(9, 20))]
        texts.append(" ".join([*(rng.choice(filler) for _ in range(rng.randint(0, 40))), *body, *(rng.choice(filler) for _ in range(rng.randint(0, 40)))]))
        sources.append(name)
    got = collections.defaultdict(list)
    for r in licenses.scan(docs_of(spark, [*texts, texts[0], texts[0]])).collect():
        got[r.doc_id].append(r)
    templates = {n: words_of(licenses.TEMPLATES[n]) for n in names}
    missed = 0
    for i, (text, name) in enumerate(zip(texts, sources, strict=True)):
        most = {n: brute_lcs(templates[n], words_of(text)) / len(templates[n]) for n in names}
        for r in got[i]:
            assert r.coverage <= most[r.license] + 1e-12 and r.matched_words == round(r.coverage * r.template_words)
            assert brute_lcs(templates[r.license], words_of(text[r.start : r.end])) == r.matched_words
        if most[name] >= licenses.COVERAGE and name not in {r.license for r in got[i]}:
            # Only a notice inside a longer one that has more words may give way.
            missed += not any(r.matched_words >= most[name] * len(templates[name]) for r in got[i])
        assert all(most[r.license] >= licenses.COVERAGE for r in got[i])
    assert missed <= 2  # a fingerprint is no promise where every run of words is broken
    assert len(got[160]) == len(got[161]) == len(got[0])


def test_licenses_one_after_the_other(spark):
    for name in ("mit-notice", "cc-by-nc-4.0-notice", "apache-2.0-notice", "gpl-3.0-notice"):
        text = " ".join([licenses.TEMPLATES[name]] * 9)
        got = licenses.scan(docs_of(spark, [text])).collect()
        assert [r.license for r in got] == [name] * 9 and all(r.coverage == 1 for r in got)
    near = licenses.scan(docs_of(spark, ["it was Released under an MIT License by us"])).collect()
    assert [(r.license, r.matched_words) for r in near] == [("mit-notice", 4)]
    mit = words_of(licenses.TEMPLATES["mit"])
    parted = " ".join([*mit[:50], *["note"] * 30, *mit[50:]])
    (r,) = licenses.scan(docs_of(spark, [parted])).collect()
    assert (r.license, r.coverage, r.start, r.end) == ("mit", 1.0, 0, len(parted))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[50:120] = x[50]  # one very common vector
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)] + [(500, None, 0), (501, [0.0] * 24, 0), (502, [float("nan")] * 24, 0), (503, [1.0, None] * 12, 0), (504, [1.0] * 5, 0), (None, [1.0] * 24, 0), (7, [float(v) for v in x[7]], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    d = x.astype(np.float64)
    hit = 0
    for q in range(0, 400, 20):
        s = (d * d[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        hit += len(set(want) & {v for _, v, _ in got[q]})
        assert all(abs(s[v] - sc) < 1e-12 for _, v, sc in got[q])
    assert hit >= 0.9 * 400 and set(got) == set(range(0, 400, 20))
    assert [v for _, v, _ in got[60]] == [i for i in range(50, 71) if i != 60]
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(frame.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2


def test_nearest_neighbours_of_small_and_uneven_tables(spark):
    rng = np.random.default_rng(9)
    few = rng.normal(size=(30, 64))
    few[15:] = -few[:15]  # opposite vectors share no bucket
    long = rng.normal(size=(400, 24)) * rng.lognormal(0, 1, 400)[:, None]
    for x, least in ((few, 1.0), (long, 0.9)):
        frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
        got = collections.defaultdict(list)
        for r in ann.search(frame, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        hit = 0
        for q in range(0, len(x), 5):
            want = [i for i in np.lexsort((np.arange(len(x)), -(x @ x[q]))) if i != q][:20]
            assert len(got[q]) == 20
            hit += len(set(want) & set(got[q]))
        assert hit >= least * 20 * len(got), (len(x), hit / (20 * len(got)))


def test_probes_are_the_nearest_pairs_of_axes():
    index, rng = ann.Index(24, 3), np.random.default_rng(1)
    x = ann._unit(rng.normal(size=(70, 24)))
    for t in range(3):
        first, second = (index.nearness(x, t, nth) for nth in (0, 1))
        sums = (first[:, :, None] + second[:, None, :]).reshape(len(x), -1)
        for probes in (1, 7, 500, index.signed**2, 10**9):
            got = index.probed(x, t, probes)
            want = np.sort(sums, 1)[:, ::-1][:, : got.shape[1]]
            assert np.allclose(np.sort(np.take_along_axis(sums, got, 1), 1)[:, ::-1], want) and all(len(set(r)) == len(r) for r in got.tolist())
        assert (index.own(x, t) == sums.argmax(1)).all()
        ranks = index.rank(x[0], x, t)
        # Of sums that are equal but for rounding, either may come first.
        assert all(abs(r - 1 - (sums[0] > sums[0, b]).sum()) <= 2 for r, b in zip(ranks, index.own(x, t), strict=True))


def test_nearest_neighbours_read_few_vectors_where_neighbours_are_near(spark):
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(60, 32))
    x = (centre[rng.integers(0, 60, 3000)] + 0.45 * rng.normal(size=(3000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    rows, is_query = frame.select("vec_id", F.col("embedding").alias("v")), F.col("vec_id") % 20 == 0
    index = ann.Index(32)
    probes = ann._probes(index, rows, rows.filter(is_query), 32, None, 20, 64, 0.92)
    got = collections.defaultdict(set)
    for r in ann.search(frame, is_query).collect():
        got[r.query_id].add(r.vec_id)
    unit, d = ann._unit(x), x.astype(np.float64)
    met, hit = np.zeros((150, 3000), bool), 0
    for t in range(index.tables):
        own = index.own(unit, t)
        for n, asked in enumerate(index.probed(unit[::20], t, probes)):
            met[n] |= np.isin(own, asked)
    for n, q in enumerate(range(0, 3000, 20)):
        s = d @ d[q]
        hit += len(set([i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]) & got[q])
    assert hit >= 0.9 * 20 * 150 and met.mean() < 0.1


def test_vectors_of_each_length_are_searched(spark):
    """Fewer vectors of one length and more of another: both have all their neighbours."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(60)] + [(60, [1.0]), (61, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, k=30).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in (0, 20, 40, 60):
        x = np.array(rows[q][1])
        found = sorted(((-float(x @ np.array(v)), i) for i, v in rows if v is not None and i != q and len(v) == len(x)))[:30]
        assert [i for _, i, _ in sorted(got.get(q, []))] == [i for _, i in found]
        assert [s for *_, s in sorted(got.get(q, []))] == pytest.approx([-s for s, _ in found])


def test_hadamard_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 24)).astype(np.float32)
    assert np.allclose(np.linalg.norm(ann.Index(24).rotated(x, 3), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece

    path = sentencepiece_bpe.vocabulary_path()
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Model.load(path)
    rng = random.Random(5)
    parts = ["the", "ation", " ", "  ", "\n", "\t", "é", "漢", "😀", "▁", "<s>", "<0x0A>", "x", "Ing", ".", "́", "0", " " * 17]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400))]
    texts += ["abcde漢" * 40_000, "x" * 100_000, texts[20], texts[20]]  # words without a blank, rows that repeat
    got = {r.doc_id: r for r in sentencepiece_bpe.encode_decode(docs_of(spark, texts), model, keep_text=True).collect()}
    for i, t in enumerate(texts):
        ids = [*sp.encode(t or ""), 2]
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == sp.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode_decode(docs_of(spark, []), model).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in sentencepiece_bpe.encode_decode(nulls, model).collect()) == [1, len(sp.encode("a b")) + 1, len(sp.encode("a b")) + 1]


def test_sentencepiece_stores_stay_bounded(monkeypatch):
    import sentencepiece

    path = sentencepiece_bpe.vocabulary_path()
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Encoder(sentencepiece_bpe.Model.load(path))
    monkeypatch.setattr(sentencepiece_bpe, "_STORE", 4000)
    monkeypatch.setattr(sentencepiece_bpe, "_PAIRS", 50)
    rng = random.Random(6)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdetions") for _ in range(rng.randint(1, 9))) for _ in range(20))
        ids, n, _ = coder.encoded(text)
        assert ids == " ".join(map(str, sp.encode(text))) and n == len(sp.encode(text))
    assert len(coder.store) + len(coder.older) < 60 and len(coder.pairs) < 400
    coder.forget()
    assert not coder.store and not coder.older and not coder.pairs


def brute_j(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in keys) for d in x if d in y)


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
    return out


def brute_classes(texts, threshold=0.8):
    sets, parent = sets_of(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and (sets[i] == sets[j] or (len(set(sets[i]) & set(sets[j])) > 0 and brute_j(sets[i], sets[j]) >= threshold)):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_probability_jaccard_closed_form():
    rng = np.random.default_rng(6)
    for _ in range(30):
        x = {int(k): int(v) for k, v in zip(rng.choice(30, 12, False), rng.integers(1, 5, 12), strict=True)}
        y = {int(k): int(v) for k, v in zip(rng.choice(30, 15, False), rng.integers(1, 5, 15), strict=True)}
        arrays = [np.array(sorted(s), np.uint64) for s in (x, y)]
        got = near_dedup.probability_jaccard(arrays[0], np.array([x[int(k)] for k in arrays[0]]), arrays[1], np.array([y[int(k)] for k in arrays[1]]))
        assert got == pytest.approx(brute_j(collections.Counter(x), collections.Counter(y)))


def test_registers_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(7)
    code = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.sort(code[:240]), np.sort(code[30:])
    won = [near_dedup.sketch(np.zeros(len(c), np.int64), c, np.ones(len(c)), 1, 4000)[0] for c in (a, b)]
    assert (won[0] == won[1]).mean() == pytest.approx(210 / 300, abs=0.03)


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]

    def edited(seq, n):
        out = list(seq)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(words)
        return " ".join(out)

    texts = [edited(base, rng.randint(0, 6)) for _ in range(90)]  # one family, some members beyond the threshold
    texts += [prose(rng, words, rng.randint(1, 60)) for _ in range(60)]
    texts += [texts[100], texts[100].upper(), texts[101] + " \n", "a b c", "A  b\tc", *ODD]
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(5):  # a chain, whose ends aren't similar
        texts.append(" ".join(chain))
        chain[rng.randrange(20) : rng.randrange(20) + 21] = [rng.choice(words)]
        chain += [rng.choice(words) for _ in range(3)]
    frame = docs_of(spark, texts)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame).collect()}
    assert got == brute_classes(texts)
    left = near_dedup.drop_near_copies(frame)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(set(got.values()))
    assert near_dedup.classes(frame.limit(0)).count() == 0


def test_near_dedup_looks_classes_up_once_a_node(spark):
    members = spark.createDataFrame([(100 * n + b, b, n) for n in range(8) for b in range(25)], "key long, band int, node long")
    placed = near_dedup.placed_in(members, spark.createDataFrame([(n, n // 4 * 4) for n in range(6)], "node long, comp long"))
    assert {tuple(r) for r in placed.collect()} == {(100 * n + b, b, n, n // 4 * 4 if n < 6 else n) for n in range(8) for b in range(25)}
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")


def test_near_dedup_of_repeated_and_null_ids(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    a, b, c = (prose(rng, words, 60) for _ in range(3))
    near = a + " one more"
    rows = [(3, a), (7, a.upper()), (7, b), (9, near), (9, near), (None, c), (None, c), (None, b), (12, None), (12, " "), (None, "")]
    frame = spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, node int, comp int, digest int")
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(frame).collect()), key=str)
    assert got == sorted([(3, 3), (7, 3), (7, 7), (9, 3), (9, 3), (None, None), (None, None), (None, 7), (12, 12), (12, 12), (None, None)], key=str)
    left = near_dedup.drop_near_copies(frame)
    assert left.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(3, a), (7, b), (None, c), (12, None), (12, " "), (None, "")], key=str)


def test_near_dedup_tiles_give_what_all_pairs_give(spark, monkeypatch):
    """With no rounds of random members and small blocks, all is left to the tiles."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for _ in range(60):
        out = list(base)
        for _ in range(rng.randint(0, 4)):
            out[rng.randrange(len(out))] = rng.choice(words)
        texts.append(" ".join(out))
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    frame = docs_of(spark, texts)
    want = brute_classes(texts)
    for rounds in (0, 2):
        rows = near_dedup.linked(frame, rounds=rounds).collect()
        first = {}
        for r in rows:
            first[r.comp] = min(first.get(r.comp, r.doc_id), r.doc_id)
        assert {r.doc_id: first[r.comp] for r in rows} == want


def test_near_dedup_leaves_unlike_nodes_to_the_tiles(spark, monkeypatch):
    """A chain, of which only neighbours are similar: rounds that settle little are no longer repeated, and the class is whole."""
    words, calls = [f"w{i}" for i in range(1000)], []
    frame = spark.createDataFrame([(i, " ".join(words[5 * i : 5 * i + 200])) for i in range(60)], "doc_id long, text string")
    merged = near_dedup.merged
    monkeypatch.setattr(near_dedup, "merged", lambda *a: calls.append(1) or merged(*a))
    assert {r.class_id for r in near_dedup.classes(frame, threshold=0.94).collect()} == {0}
    assert len(calls) < near_dedup.ROUNDS
