"""Packing against piece-by-piece best-fit decreasing and the library's own ids."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import packing

SCHEMA = "doc_id long, text string, sequence_id string"


def brute(lengths, capacity):
    """Room left in each bin of best-fit decreasing."""
    left = []
    for n in sorted(lengths, reverse=True):
        best = min((c for c in left if c >= n), default=None)
        if best is None:
            left.append(capacity - n)
        else:
            left[left.index(best)] -= n
    return sorted(left)


@pytest.mark.parametrize("seed", range(60))
def test_plan_opens_the_bins_of_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 5, 16, 31, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 200))]
    counts = Counter(lengths)
    plan = packing.plan(dict(counts), capacity)
    length = np.array([n for n in counts for _ in range(counts[n])], np.int64)
    rank = np.array([k for n in counts for k in range(counts[n])], np.int64)
    bins, offset = plan.place(length, rank)
    filled = defaultdict(int)
    for b, o, n in sorted(zip(bins.tolist(), offset.tolist(), length.tolist(), strict=True)):
        assert o == filled[b]
        filled[b] += n
    assert plan.bins == len(filled)
    assert sorted(capacity - v for v in filled.values()) == brute(lengths, capacity)


def test_tightest_is_the_least_capacity_that_is_enough():
    r, tree, held = random.Random(3), packing.Tightest(40), set()
    for _ in range(500):
        c = r.randint(0, 40)
        tree.put(c, c not in held)
        held ^= {c}
        want = r.randint(0, 40)
        assert tree.at_least(want) == min((x for x in held if x >= want), default=None)


def test_words_give_the_ids_of_whole_texts():
    encoder = packing.Encoder(packing.vocabulary_path())
    odd = ["", "  ", "a<|startoftext|>b <|endoftext|> c", "<|ENDOFTEXT|> x", "é ́x  y\x1cz \x85", "İstanbul ΣΑΣ's it's 12.", "x" * 500 + " y", " a\xa0b", "J̌ ǰ É. É ß. ª µ", "Word. word, word.. (word)", "日本語 テスト。 12,5 don't DON'T"]
    r = random.Random(1)
    signs = "aAbZéÉßñ.,;:!?'’-()<|>0123 \t\ńİſK"
    odd += ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(400)]
    for text, ids in zip(odd, encoder.encode_all([t.encode() for t in odd]), strict=True):
        assert encoder.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def test_pieces_fill_sequences_without_gaps(spark):
    long = " ".join(f"word{k}" for k in range(3000))
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (None, None, "x"), (2, "", None), (3, long, "x"), (4, long, "x"), (None, "other", "x"), (2**63 - 1, "\n\t ", "x")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), capacity=64).collect()
    encoder = packing.Encoder(packing.vocabulary_path())
    want = []
    for doc_id, text, _ in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[start : start + 64], "<u4")
            want.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    filled = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert len(filled) == len(brute([w[3] for w in want], 64)) and max(filled.values()) <= 64


def test_empty_table_and_repeated_lengths(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.range(1000).selectExpr("id % 7 as doc_id", "'same text' as text")
    got = packing.pack(same).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 1000 and len({r.sequence_id for r in got}) == -(-1000 // (2048 // got[0].length))


def test_tasks_of_a_worker_share_their_encoder():
    path = packing.vocabulary_path()
    first = packing.encoder_of(path)
    list(first.encode_all(["naïve words, Größe".encode()]))
    assert packing.encoder_of(path) is first and "Größe".encode() in packing.encoder_of(path).known
