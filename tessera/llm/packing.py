"""Best-fit decreasing packing of token sequences into bins of a fixed size.

Pieces of equal length are interchangeable, so best-fit decreasing needs their counts alone: a histogram of at
most ``CAPACITY`` lengths, whatever the corpus's size.  ``plan`` packs that histogram with a segment tree over
remaining capacities, which finds the tightest open bin in logarithmic time, and takes all bins of that capacity
in one step; the bins are those that piece-by-piece best-fit decreasing opens.  Its result is a bounded table of
ranges: of the pieces of a length, those ranked from ``first`` lie in bins from ``bin`` on, ``each`` to a bin.

Documents are encoded once, where they are read.  A piece's rank among those of its length is its rank in its
task, stored beside it, plus the counts of the tasks before; so neither a length that many pieces share nor a
document of many pieces is ever one group.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, text_or_empty

#: Tokens that a sequence holds, and the id that ends each document.
CAPACITY, END = 2048, 0
#: Bytes of words whose ids a worker remembers, and the longest word that it remembers.
STORE, LONGEST = 16 << 20, 100
#: Places for ranks in a range's key.
_RANKS = 1 << 48


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words that the tokenizer's rules lower and leave whole: Latin letters.  Its model reads bytes,
#: those without a sign of their own as signs from U+0100 on.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿß]+")
_BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """(core, one sign behind it or nothing) with the ids of the word: the tokenizer cuts between a letter and a sign, and lowers itself.

    Reserved tokens are read before that, and other capitals may lack a composed form that the small letter has.
    """
    if b"<|" not in word and word.isascii():
        word = word.lower()
    if len(word) > 1 and word[-1] in b".,;:!?" and 97 <= word[-2] | 32 <= 122:
        return word[:-1], word[-1:]
    return word, b""


class Encoder:
    """A tokenizer of words: its ids of a text are those of the text's ASCII-blank-separated words, one after the other.

    Its rules (composition, lower case, splitting) never look across a blank, so each distinct word is encoded
    once as long as a worker remembers it.
    """

    def __init__(self, path: str):
        # A task has one core; the library would start a thread for each of the machine's.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        text = [w.decode() for w in words]
        odd = [w for w in text if not _PLAIN.fullmatch(w)]
        whole = dict(zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True))
        # The signs of ASCII letters are the letters.
        signs = lambda w: w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
        return [whole[w].ids if w in whole else [t.id for t in self.model.tokenize(signs(w.lower()))] for w in text]

    def _learn(self, words: list[bytes]) -> None:
        parts = [_parts(w) for w in words]
        cores = list({c for c, _ in parts}.union(t for _, t in parts if t))
        ids_of = dict(zip(cores, self._encode(cores), strict=True))
        got = [ids_of[c] + ids_of[t] if t else ids_of[c] for c, t in parts]
        start = len(self.size)
        self.known.update(zip(words, range(start, start + len(words)), strict=True))
        self.held += sum(map(len, words))
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32)])

    def encode_all(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text; about a megabyte of texts is looked up at a time."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < 1 << 20):
                size += len(texts[j])
                j += 1
            words = [t.split() for t in texts[i:j]]
            if self.held > STORE:
                self._clear()
            new = {w for ws in words for w in ws}.difference(self.known)
            long = {w for w in new if len(w) > LONGEST}
            self._learn(list(new - long))
            apart = {w: np.array(self._encode([w])[0], np.uint32) for w in long}
            for ws in words:
                yield self._joined(ws, apart)
            i = j

    def _joined(self, words: list[bytes], apart: dict[bytes, np.ndarray]) -> np.ndarray:
        if apart and any(w in apart for w in words):
            return np.concatenate([apart[w] if w in apart else self._of(self.known[w]) for w in words])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        place = np.arange(size.sum()) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)
        return self.ids[place]

    def _of(self, k: int) -> np.ndarray:
        return self.ids[self.first[k] : self.first[k + 1]]


@cache
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker: the tasks that it runs one after the other share the words that it remembers."""
    return Encoder(path)


def _cut(path: str, capacity: int, end: int):
    """doc_id, text -> a row per piece, with its task and its rank there among pieces of its length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = encoder_of(path), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for k, ids in enumerate(encoder.encode_all(batch.column(1).cast(pa.binary()).to_pylist())):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((k, piece, start, len(part), zlib.crc32(part.tobytes()), met[len(part)]))
                    met[len(part)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            values = [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *values, pa.array([task] * len(rows), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return work


class Tightest:
    """A segment tree over capacities 0 to n: the least one, from a given one on, that an open bin has left."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.some = [False] * (2 * self.leaves)

    def put(self, capacity: int, some: bool) -> None:
        i = self.leaves + capacity
        self.some[i] = some
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def at_least(self, capacity: int) -> int | None:
        i = self.leaves + capacity
        if self.some[i]:
            return capacity
        # Up until a right neighbour holds something, then down to its leftmost.
        while i > 1 and (i % 2 or not self.some[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i + (not self.some[2 * i])
        return i - self.leaves


@dataclass
class Plan:
    """Ranges in order of (length, first): the ranks from first on lie in bins from bin on, each to a bin, at offset and behind it."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of pieces."""
        at = np.searchsorted(self.length * _RANKS + self.first, length * _RANKS + rank, "right") - 1
        behind = rank - self.first[at]
        return self.bin[at] + behind // self.each[at], self.offset[at] + behind % self.each[at] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing of ``counts`` pieces of each length."""
    tree, bins = Tightest(capacity), 0
    open_: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int]] = []

    def keep(left: int, first: int, n: int) -> None:
        if n and left:
            open_.setdefault(left, []).append((first, n))
            tree.put(left, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.at_least(length)
            if left is None:
                left, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            else:
                first, n = open_[left].pop()
                if not open_[left]:
                    tree.put(left, False)
            # The tightest bin stays the tightest until it has no room left, so a bin is filled before the next one.
            each = left // length
            full = min(n, todo // each)
            rest = min(todo - full * each, each) if full < n else 0
            if full:
                out.append((length, rank, first, each, capacity - left))
                keep(left - each * length, first, full)
            if rest:
                out.append((length, rank + full * each, first + full, each, capacity - left))
                keep(left - rest * length, first + full, 1)
            keep(left, first + full + (rest > 0), n - full - (rest > 0))
            rank += full * each + rest
            todo -= full * each + rest
    columns = np.array(sorted(out), np.int64).reshape(-1, 5).T
    return Plan(*columns, bins)


def _placed(p: Plan):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            bin_, offset = p.place(length, rank) if len(rank) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin_, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return work


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and ``end``; longer ones than ``capacity`` are cut into full pieces and a rest.  A
    null or blank text is the end alone.  Rows are documents of their own even where ids repeat or are null; an
    empty table gives an empty result, and other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    rows = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_cut(path or vocabulary_path(), capacity, end), f"{columns}, nth long, task long")
    pieces = stored(rows)
    tasks = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # As many rows as there are lengths, which the capacity bounds.
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(plan(counts, capacity)), f"{columns}, sequence_id long, offset long")
