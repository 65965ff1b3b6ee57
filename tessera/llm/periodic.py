"""Runs of periodic words (maximal repetitions) by the linear tandem-repeat method, many texts at a time in numpy.

A text's words become numbers.  Three steps follow, each on all texts of a batch together:

1. Lempel-Ziv blocks.  A block is the longest stretch that also starts earlier, or one new word.  Common extensions
   from a block's borders, forwards and backwards, give squares that cover the leftmost place of every kind of square.
2. Suffix-link walks.  From each of these squares the suffix tree is walked to the square that is one word further:
   the link drops the first word, and the branch that begins with it leads on, if there is one.  This ends when a
   square is met that is known; then every kind of square (the vocabulary) is.
3. Locating.  The leaves below a square are its places; places one after the other with one period are a run.

The tree is that of the suffix array: a node is an interval of suffixes, found by binary search over least common
prefixes, and a branch is found by binary search over the next word.  Squares whose half repeats itself are left out,
as the shorter period has the same run, so a square's places are few.

A run of at least twelve words (and twice its period) lies in stretches that are covered by six-word phrases that
occur again in the text: any of its words stands in six that are all within a run, one period away from their equals.
Only such stretches are treated; most texts have none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import text_or_empty
from tessera.llm.near_dedup import mix

#: Least words of a run, and least periods.
LEAST, PERIODS = 12, 2
#: Words of the phrases that must occur again, half of the least run.
PHRASE = LEAST // 2
#: Bytes of text treated together.
TOGETHER = 4 << 20


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] numbers, then those of the next."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def covered(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each word stands in a phrase of PHRASE words that its text holds twice; hashes may cover a few more."""
    n = len(word)
    out = np.zeros(n, bool)
    if n < 2 * PHRASE:
        return out
    m = n - PHRASE + 1
    h = np.zeros(m, np.uint64)
    x = mix(word.astype(np.uint64))
    for j in range(PHRASE):
        h = (h + x[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
    whole = text[:m] == text[PHRASE - 1 :]
    h = mix(h ^ mix(text[:m].astype(np.uint64)))
    at = np.flatnonzero(whole)
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, order[again], 1)
    np.add.at(cover, order[again] + PHRASE, -1)
    return np.cumsum(cover[:-1]) > 0


class Index:
    """Suffix array, common prefixes and their minima of a list of numbers in which every stretch has numbers of its own."""

    def __init__(self, x: np.ndarray):
        n = self.n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        sa = np.argsort(rank, kind="stable")
        # Prefix doubling; only suffixes that still share a rank are sorted again.
        size = 1
        while True:
            tied = np.zeros(n, bool)
            same = rank[sa[1:]] == rank[sa[:-1]]
            tied[1:] |= same
            tied[:-1] |= same
            if not tied.any():
                break
            at = np.flatnonzero(tied)
            suffix = sa[at]
            second = np.where(suffix + size < n, rank[np.minimum(suffix + size, n - 1)] + 1, 0)
            suffix = suffix[np.lexsort((second, rank[suffix]))]
            sa[at] = suffix
            first, second = rank[suffix], np.where(suffix + size < n, rank[np.minimum(suffix + size, n - 1)] + 1, 0)
            new = np.ones(len(at), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            # A rank is the place of its first suffix, so ranks of others stay.
            rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            if size == 1:
                lone = np.ones(n, bool)
                lone[at] = False
                rank[sa[lone]] = np.flatnonzero(lone)
            size *= 2
        self.x, self.sa = x, sa
        self.rank = np.empty(n, np.int64)
        self.rank[sa] = np.arange(n)
        self.minima = self._minima(self._prefixes())

    def _prefixes(self) -> np.ndarray:
        """Common prefixes of neighbours in the suffix array: in the text's order each is at least the last one less one."""
        n, x, sa, rank = self.n, self.x.tolist(), self.sa.tolist(), self.rank.tolist()
        lcp, k = [0] * n, 0
        for i in range(n):
            r = rank[i]
            if not r:
                k = 0
                continue
            j = sa[r - 1]
            while i + k < n and j + k < n and x[i + k] == x[j + k]:
                k += 1
            lcp[r] = k
            if k:
                k -= 1
        return np.array(lcp, np.int32)

    @staticmethod
    def _minima(lcp: np.ndarray) -> list[np.ndarray]:
        out, w = [lcp], 1
        while 2 * w <= len(lcp):
            out.append(np.minimum(out[-1][:-w], out[-1][w:]))
            w *= 2
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes i and j (i != j); 0 where one is past the end."""
        inside = (i < self.n) & (j < self.n)
        a, b = self.rank[np.minimum(i, self.n - 1)], self.rank[np.minimum(j, self.n - 1)]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        out = np.zeros(len(i), np.int64)
        level = np.frexp(np.maximum(high - low + 1, 1))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero((level == k) & inside & (high >= low))
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k) + 1])
        return out

    def node(self, rank: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that share ``size`` words with the one at ``rank``."""
        low, high = rank.copy(), rank.copy()
        for k in range(len(self.minima) - 1, -1, -1):
            m, step = self.minima[k], 1 << k
            at = low - step + 1
            ok = at >= 1
            ok[ok] = m[at[ok]] >= size[ok]
            low[ok] -= step
            ok = high + step < self.n
            ok[ok] = m[high[ok] + 1] >= size[ok]
            high[ok] += step
        return low, high

    def branch(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The first suffix in each interval whose word at ``depth`` is at least ``word``; high + 1 without one."""
        low, end = low.copy(), high + 1
        while True:
            open_ = np.flatnonzero(low < end)
            if not len(open_):
                return low
            mid = (low[open_] + end[open_]) // 2
            at = self.sa[mid] + depth[open_]
            less = (at >= self.n) | (self.x[np.minimum(at, self.n - 1)] < word[open_])
            low[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]


def blocks(index: Index) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks; a stretch's first word is new, so blocks end with stretches."""
    n, sa = index.n, index.sa
    # Suffixes leave the list of ranks from the last on, so that neighbours left are those that start earlier.
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    left, right, rank = [-1] * n, [n] * n, index.rank.tolist()
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b = left[i], right[i] = before[r], after[r]
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
    i, longest = np.arange(n), np.ones(n, np.int64)
    for side in (np.array(left), np.array(right)):
        ok = (side >= 0) & (side < n)
        longest[ok] = np.maximum(longest[ok], index.common(i[ok], sa[side[ok]]))
    size, out, p = longest.tolist(), [], 0
    while p < n:
        out.append(p)
        p += size[p]
    return np.array(out, np.int64)


def squares(index: Index, back: Index, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, half, run's start, run's end) of squares that cover each kind's leftmost place; back: the index of the reversed list."""
    n = index.n
    size = np.diff(np.append(block, n))
    after = np.append(size[1:], 0)
    behind = lambda i, j: back.common(n - 1 - i, n - 1 - j)
    found = []
    for kind in (0, 1):
        many = size if kind == 0 else size + after
        b = np.repeat(np.arange(len(block)), many)
        k = _ranges(np.ones(len(block), np.int64), many)
        end = block[b] + size[b]
        # From the block's end back by a half, or from its start on by one.
        here, there = (end, end - k) if kind == 0 else (block[b], block[b] + k)
        ok = (np.minimum(here, there) >= 0) & (np.maximum(here, there) < n)
        here, there, k, end, b = here[ok], there[ok], k[ok], end[ok], b[ok]
        forth = index.common(here, there)
        some = (here > 0) & (there > 0)
        back_by = np.zeros(len(k), np.int64)
        back_by[some] = behind(here[some] - 1, there[some] - 1)
        low, high = np.minimum(here, there), np.maximum(here, there)
        start = np.maximum(low - back_by, low - k + 1)
        good = (forth + back_by >= k) & (forth > 0)
        if kind == 1:
            good &= (back_by > 0) & (start + k <= end)
        found.append(np.stack([start, k, low - back_by, high + forth])[:, good])
    got = np.concatenate(found, axis=1)
    # A run that is met with a multiple of its period is met with its period.
    got = got[:, np.lexsort((got[0], got[1], got[3], got[2]))]
    new = np.ones(got.shape[1], bool)
    new[1:] = (got[2, 1:] != got[2, :-1]) | (got[3, 1:] != got[3, :-1])
    shortest = got[1][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else got[1]
    got = got[:, got[1] == shortest]
    return got[0], got[1], got[2], got[3]


def vocabulary(index: Index, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, half) of the nodes of all kinds of squares, from those that cover them."""
    n, out = index.n, []
    known: set[int] = set()
    while len(start):
        low, high = index.node(index.rank[start], 2 * half)
        key = (low * n + half).tolist()
        new = np.zeros(len(key), bool)
        for i, k in enumerate(key):
            if k not in known:
                known.add(k)
                new[i] = True
        start, half, low, high = start[new], half[new], low[new], high[new]
        out.append((low, high, half))
        # The suffix link: one word less in front; then the branch that begins with that word.
        word, next_ = index.x[start], start + 1
        direct = (start + 2 * half < n) & (index.x[np.minimum(start + 2 * half, n - 1)] == word)
        walk = np.flatnonzero(~direct)
        if len(walk):
            depth = 2 * half[walk] - 1
            a, b = index.node(index.rank[next_[walk]], depth)
            at = index.branch(a, b, depth, word[walk])
            place = index.sa[np.minimum(at, n - 1)] + depth
            ok = (at <= b) & (place < n)
            ok &= index.x[np.minimum(place, n - 1)] == word[walk]
            next_[walk[ok]] = index.sa[at[ok]]
            direct[walk[ok]] = True
        start, half = next_[direct], half[direct]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    low, high, half = (np.concatenate(c) for c in zip(*out, strict=True))
    return low, high, half


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal repetitions of at least two periods; x: stretches with numbers of their own."""
    none = np.zeros(0, np.int64)
    if len(x) < 2:
        return none, none, none
    index, back = Index(x), Index(x[::-1].copy())
    start, half, _, _ = squares(index, back, blocks(index))
    low, high, half = vocabulary(index, start, half)
    if not len(low):
        return none, none, none
    size = high - low + 1
    place, half = index.sa[_ranges(low, size)], np.repeat(half, size)
    order = np.lexsort((place, half))
    place, half = place[order], half[order]
    new = np.ones(len(place), bool)
    new[1:] = (half[1:] != half[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(place))) - 1 + 2 * half[first]
    return place[first], length, half[first]


def find_runs(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period), by start, then period, of the runs of texts laid one after the other; start: place in word.

    Runs have at least LEAST words and two periods, their period is their least one, and they end where it does.
    """
    at = np.flatnonzero(covered(word, text))
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
    stretch = np.cumsum(new) - 1
    size = np.bincount(stretch)
    keep = size[stretch] >= LEAST
    at, stretch = at[keep], stretch[keep]
    if not len(at):
        return at, at, at
    start, length, period = runs_of(pd.factorize(stretch << 40 | word[at])[0].astype(np.int64))
    long = length >= LEAST
    start, length, period = at[start[long]], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_twist(n: int, digest: int) -> np.ndarray | None:
    """The places that a text's words are taken from where its id is to be made periodic, else None."""
    if digest % 10 or not n:
        return None
    g = digest // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _found(words: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """By text its runs (start, length, period) and which words stay when each run keeps its first period."""
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    code = pd.factorize(flat)[0].astype(np.int64)
    text = np.repeat(np.arange(len(words)), size)
    start, length, period = find_runs(code, text)
    dropped = np.zeros(len(code) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    stays = np.cumsum(dropped[:-1]) == 0
    of = text[start] if len(start) else start
    bounds = np.searchsorted(of, np.arange(len(words) + 1))
    for k in range(len(words)):
        i, j = bounds[k], bounds[k + 1]
        runs = list(zip((start[i:j] - first[k]).tolist(), length[i:j].tolist(), period[i:j].tolist(), strict=True))
        yield runs, stays[first[k] : first[k] + size[k]]


_FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _detect(twist: bool):
    names = ["doc_id", *[f.split()[0] for f in _FIELDS.split(", ")]]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def together(ids: list, texts: list[bytes]) -> Iterator[tuple]:
        words = [t.split() for t in texts]
        if twist:
            for k, i in enumerate(ids):
                if i is not None and (at := periodic_twist(len(words[k]), zlib.crc32(str(i).encode()))) is not None:
                    words[k] = [words[k][j] for j in at.tolist()]
        for ws, (runs, stays) in zip(words, _found(words), strict=True):
            best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
            digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
            left = ws if stays.all() else [w for w, s in zip(ws, stays.tolist(), strict=True) if s]
            yield len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, hashlib.sha256(b" ".join(left)).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            rows: list[tuple] = []
            i = 0
            while i < len(ids):
                j, size = i, 0
                while j < len(ids) and (j == i or size + len(texts[j]) <= TOGETHER):
                    size += len(texts[j])
                    j += 1
                rows += together(ids[i:j], texts[i:j])
                i = j
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]], names)

    return work


def detect(docs: DataFrame, twist: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256.

    The collapsed text keeps the first period of each run.  ``twist`` first makes the texts whose id's CRC-32 ends in 0
    periodic, as a planted test.  A null text has no words; a null id is not twisted; repeated rows get equal results, an
    empty table gives an empty result, and other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_detect(twist), f"doc_id {kind}, {_FIELDS}")


def collapse(docs: DataFrame) -> DataFrame:
    """docs with their texts' words joined by one blank and each run cut to its first period; a null text stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t.as_py() for t in batch.column(at)]
            words = [(t or "").encode().split() for t in texts]
            new = [b" ".join(w for w, s in zip(ws, stays.tolist(), strict=True) if s).decode() for ws, (_, stays) in zip(words, _found(words), strict=True)]
            column = pa.array([n if t is not None else None for n, t in zip(new, texts, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    return docs.mapInArrow(work, docs.schema)
