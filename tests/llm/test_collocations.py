"""Collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import collocations
from tessera.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def brute(rows, least, top, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    drop = {(lang, p[i : i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * f[lang, p[i : i + k]]}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in drop:
            s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


def mined(spark, rows, least, top=2000, parts=3):
    prepare(spark)
    docs = spark.createDataFrame([(k, text, lang, "x", 1) for k, (lang, text) in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocations.mine(docs, least=least, top=top).collect())


def prose(seed, many, words):
    r = random.Random(seed)
    bank = ["the", "The", "of", "new", "york", "ÉTÉ", "été", "a", "b", "naïve", "x-1", "😀", "日本"][:words]
    signs = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", "\x85", "\xa0"]
    return [(r.choice(["en", "de", None, "und"]), "".join(r.choice(bank) + r.choice(signs) for _ in range(r.randint(0, 60)))) for _ in range(many)]


@pytest.mark.parametrize(("seed", "words", "least"), [(1, 13, 4), (2, 4, 6), (3, 2, 3)])
def test_equal_to_counting_every_phrase(spark, seed, words, least, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE", 500)
    rows = prose(seed, 80, words)
    assert mined(spark, rows, least) == brute(rows, least, 2000)


def test_first_ones_ties_and_overlaps(spark):
    rows = [("en", "a a a a a a a a"), ("en", "b c " * 9), ("de", "d e. d e. d e"), (None, "d e d e"), ("und", "d e d e")]
    assert mined(spark, rows, 2, top=3) == brute(rows, 2, 3)


def test_nothing_to_mine(spark):
    assert mined(spark, [("en", None), (None, ""), ("de", " .;\n")], 1) == []
    assert mined(spark, [], 1, parts=1) == []
    assert mined(spark, [("en", "one two three")], 2) == []


def test_large_counts_are_exact(spark):
    """The score's product passes 64 bits."""
    a, n, left, right = 10**11 + 7, 9 * 10**14 + 1, 10**12 + 9, 10**13 + 3
    assert collocations.scores(spark.createDataFrame([("x", "p q", a, [left], [right], n)], "lang string, phrase string, a long, lefts array<long>, rights array<long>, total long")).first()["score"] == 1000 * a * n // (left * right)
