"""Runs against looking for them from each place with each period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic

SCHEMA = "doc_id long, text string, start string, period int"


def brute(x, least):
    """(start, length, period) of the maximal repetitions; equal stretches keep their least period."""
    n, out, seen = len(x), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j + q - i >= least:
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def lists(r):
    n, k = r.randint(0, 70), r.choice([1, 2, 2, 3, 5])
    x = [r.randrange(k) for _ in range(n)]
    if n > 6 and r.random() < 0.4:
        a = r.randint(0, n - 1)
        p = 1 + (n - a) // r.randint(2, 9)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    return x


@pytest.mark.parametrize("seed", range(20))
def test_all_repetitions_of_a_list(seed):
    r = random.Random(seed)
    for _ in range(40):
        x = lists(r)
        got = zip(*[v.tolist() for v in periodic.runs_of(np.array(x, np.int64))], strict=True)
        assert sorted(got, key=lambda t: (t[0], t[2])) == brute(x, 2), x


def test_fibonacci_words_and_one_word(seed=0):
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
    for x in (b, [7] * 300, list(range(50)) * 6):
        got = zip(*[v.tolist() for v in periodic.find_runs(np.array(x, np.int64), np.zeros(len(x), np.int64))], strict=True)
        assert list(got) == brute(x, 12)


def want(doc_id, text, twist):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if twist and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 12)
    dropped = {i for a, b, c in runs for i in range(a + c, a + b)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("twist", [True, False])
def test_documents_with_the_planted_ones(spark, twist):
    r = random.Random(5)
    rows = [(k, " ".join(f"w{v}" for v in lists(r))) for k in range(120)]
    rows += [(None, None), (None, "a b " * 9), (7, ""), (7, " \t\n\x0b"), (7, "x\x85y " * 13), (7, "x\x85y " * 13), (10**12, "É " * 4000), (8, " ".join(f"u{k % 900}" for k in range(5000)))]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in periodic.detect(docs, twist).collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    expected = [want(*r, twist) for r in rows if r[0] not in (8, 10**12)]
    assert sorted([g for g in got if g[0] not in (8, 10**12)], key=key) == sorted(expected, key=key)
    if not twist:
        assert {g[0]: g[1:6] for g in got if g[0] in (8, 10**12)} == {8: (1, 0, 5000, 900, 5555), 10**12: (1, 0, 4000, 1, 4_000_000)}


def test_empty_table_and_collapsed_texts(spark):
    assert periodic.detect(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "go on " * 8 + "end", None, 1), (2, None, None, 1), (3, " as  it is ", None, 1)], SCHEMA)
    assert {r.doc_id: r.text for r in periodic.collapse(docs).collect()} == {1: "go on end", 2: None, 3: "as it is"}
