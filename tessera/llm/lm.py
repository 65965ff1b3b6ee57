"""Language-model scores by a weighted backoff automaton over distributed tables of all n-grams.

Counts come from all training documents, and no word or n-gram is left out, whatever the corpus's size.
At the automaton's root stands the smoothed unigram model: a word seen c times has (c - d) / N, and the
mass d V / N that this leaves is that of the one event "a word not seen".  d is estimated from the words
seen once and twice.  Its other states are the histories of one and two words (see ``backoff``); arcs of
n-grams seen once have no mass of their own under the discount of 1, so they need not be kept apart.

Nothing that grows with the corpus is gathered or sent to every task.  Documents are read once, in runs,
which are stored with their words' hashes: all later passes read the same runs, whatever has been lost
or is split otherwise by then.  A run lists its distinct n-grams of an order with their training counts,
dealt into parts by hash; a part adds the counts up and answers each run with the totals.  Orders go
from the longest down: what the arcs of a history take together is found where they are, and is added to
the history's own row in the next order.  The parts of an order are treated in slices, one after the
other, so that fewer n-grams are on the disk at a time.  At the end a run meets its answers, again in a few groups
of runs, builds the automaton of the n-grams that its texts hold, and reads the texts from left to right.

Words are told apart by a 64-bit hash, histories of two words by a 64-bit hash of the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import backoff
from tessera.llm.arrow_text import runs, text_bytes
from tessera.llm.common import Shelf, checkpoint, cleaning, held_out, text_or_empty
from tessera.llm.near_dedup import mix, word_hashes

#: Least shares of the tokens for words and n-grams: none.
WORD_SHARE = GRAM_SHARE = 0.0
#: Bytes of text in a run, and in a piece that is cut into words in one go; runs in a file.
RUN = 4 << 20
PIECE = 1 << 19
FILE = 8
#: Bytes of text for a part of the n-grams, and slices of an order's parts.
PART = 3 << 20
SLICES = {1: 1, 2: 2, 3: 2}
#: Groups of runs that meet their answers one after the other.
MEETINGS = 2
#: Hashes of a text's start and end.
START, END = np.uint64(0x5D1A7F3C9B2E4861), np.uint64(0xA3C95E0D71F8B264)
ORDERS = (1, 2, 3)
_ROWS = "run long, part int, a binary, b binary, n binary"
_WORDS = "size binary, low binary, high binary, hashes binary"


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    return mix(mix(a ^ np.uint64(0x9E3779B97F4A7C15)) + b)


def packed(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as hold them all."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(t).max)).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(data) // max(1, n) or 1]).astype(np.int64)


@dataclass
class Run:
    """Consecutive texts: the hashes of their symbols (0 the start, 1 the end), and the texts' symbols with start and end."""

    hashes: np.ndarray
    x: np.ndarray
    text: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, word: np.ndarray, text: np.ndarray, texts: int) -> Run:
        """word, text: by word of all texts in order, its place in hashes and the number of its text."""
        size = np.bincount(text, minlength=texts) + 2
        first = np.cumsum(size) - size
        x = np.zeros(size.sum(), np.int64)
        x[first + size - 1] = 1
        x[np.arange(len(word)) + 2 * text + 1] = word
        return Run(hashes, x, np.repeat(np.arange(texts), size))

    def grams(self, longest: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By order up to the longest: the distinct n-grams' two hashes (history, last word; a lone word has 0 as the second), for each
        place in x that ends one (all but starts; of order 1 starts too) its number, and these places."""
        out = {1: (self.hashes, np.zeros_like(self.hashes), self.x, np.arange(len(self.x)))}
        if longest == 1:
            return out
        at = np.flatnonzero(self.x)
        pair_of, pair = pd.factorize(self.x[at - 1] << 32 | self.x[at])
        u, v = self.hashes[pair >> 32], self.hashes[pair & 0xFFFFFFFF]
        out[2] = (u, v, pair_of, at)
        if longest == 2:
            return out
        far = np.flatnonzero(self.x[at - 1])
        triple_of, triple = pd.factorize(pair_of[far - 1] << 32 | self.x[at[far]])
        out[3] = (joined(u, v)[triple >> 32], self.hashes[triple & 0xFFFFFFFF], triple_of, at[far])
        return out


def part_of(order: int, a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """Histories of order n + 1 are the n-grams' ids: those of words are their hashes, those of pairs hashes of both."""
    return ((a if order == 1 else joined(a, b)) % np.uint64(parts)).astype(np.int64)


def _cut(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, word hashes, text of each) of runs."""
    data, offsets = text_bytes(column)
    for i, j in runs(offsets, RUN):
        got = [(h, text + k) for k, m in runs(offsets[i : j + 1], PIECE) for h, text in [word_hashes(data, offsets[i + k : i + m + 1])]]
        yield i, j, np.concatenate([h for h, _ in got]), np.concatenate([t for _, t in got])


def _read(batches: Iterator[pa.RecordBatch], task: int | None = None) -> Iterator[pa.RecordBatch]:
    """doc_id, learn, held_out, text -> one row per run: run, the lists of the first three, and its words.

    A word is its place in the run's hashes (start, end, then words as they come), cut into its low 16 bits and the rest,
    which has a second byte where a run has so many different words.
    """
    k, task = 0, TaskContext.get().partitionId() if task is None else task
    for batch in batches:
        for i, j, h, text in _cut(batch.column(3)):
            place, hashes = pd.factorize(h)
            word = place + 2
            lists = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(c).slice(i, j - i)) for c in range(3)]
            data = [np.bincount(text, minlength=j - i).astype(np.int32), word.astype(np.uint16), (word >> 16).astype(np.uint8 if len(hashes) < (1 << 24) - 2 else np.uint16), np.concatenate([[START, END], hashes]).astype(np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), *lists, *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["run", "doc_id", "learn", "held_out", "size", "low", "high", "hashes"])
            k += 1


def _run(size: bytes, low: bytes, high: bytes, hashes: bytes) -> Run:
    size = np.frombuffer(size, np.int32)
    low = np.frombuffer(low, np.uint16).astype(np.int64)
    word = low | np.frombuffer(high, np.uint8 if len(high) == len(low) else np.uint16).astype(np.int64) << 16
    return Run.of(np.frombuffer(hashes, np.uint64), word, np.repeat(np.arange(len(size)), size), len(size))


def _split(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, columns' values there), in order of place."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    columns = [c[order] for c in columns]
    for p, i, j in zip(parts.tolist(), first, [*first[1:], len(part)], strict=True):
        yield p, *[c[i:j].tobytes() if c.dtype == np.uint64 else packed(c[i:j]) for c in columns]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["run", "part", "a", "b", "n"])


def _asks(order: int, parts: int, nth: int, slices: int, ask: bool) -> Callable:
    """Rows (run or -2 for who needs no answer, part, a, b, n) of the n-grams of a slice's parts; columns run, learn and words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, learn, *words = (c[i] for c in batch.columns)
                run = _run(*[w.as_buffer() for w in words])
                learn = learn.values.to_numpy(zero_copy_only=False).astype(np.float64)
                a, b, gram, at = run.grams(order)[order]
                n = np.bincount(gram, learn[run.text[at]], len(a)).astype(np.int32)
                part = part_of(order, a, b, parts)
                mine = part % slices == nth
                if not ask:
                    mine &= n > 0
                run = words = gram = at = None
                yield _record([(number.as_py() if ask else -2, *r) for r in _split(part[mine], a[mine], b[mine], n[mine])])

    return work


def _add_up(order: int, parts: int) -> Callable:
    """Of one part: its answers (run, part, totals, arcs' mass, empty), what arcs take of histories (-1, part, histories, counts, empty), for words figures (-3, ...)."""

    def work(table: pa.Table) -> pa.Table:
        rows = list(zip(*[c.to_pylist() for c in table.columns], strict=True))
        asks, taken = [r for r in rows if r[0] != -1], [r for r in rows if r[0] == -1]
        part = rows[0][1]
        rows = table = None
        a, b = (np.frombuffer(b"".join(r[k] for r in asks), np.uint64) for k in (2, 3))
        n = np.concatenate([unpacked(r[4], len(r[2]) // 8) for r in asks]) if asks else np.zeros(0)
        out: list[tuple] = []
        if len(a):
            which, _ = pd.factorize(pd.factorize(a)[0] << 32 | pd.factorize(b)[0])
            total = np.bincount(which, n).astype(np.int64)
            first = np.empty(len(total), np.int64)
            first[which] = np.arange(len(a))
            a, b = a[first], b[first]
            mass = np.zeros(len(total), np.int64)
            if taken:
                ids, place = np.unique(np.frombuffer(b"".join(r[2] for r in taken), np.uint64), return_inverse=True)
                lost = np.bincount(place, np.concatenate([unpacked(r[4], len(r[2]) // 8) for r in taken])).astype(np.int64)
                found = backoff.find(ids, a if order == 1 else joined(a, b))
                mass = np.where(found >= 0, lost[found], 0)
            i = 0
            for r in asks:
                j = i + len(r[2]) // 8
                if r[0] != -2:
                    out.append((r[0], part, packed(total[which[i:j]]), packed(mass[which[i:j]]) if order < 3 else b"", b""))
                i = j
            if order > 1:
                own = np.maximum(total - backoff.DISCOUNT, 0).astype(np.int64)
                some = own > 0
                if some.any():
                    history, place = np.unique(a[some], return_inverse=True)
                    sums = np.bincount(place, own[some]).astype(np.int64)
                    out += [(-1, p, h, b"", s) for p, h, s in _split((history % np.uint64(parts)).astype(np.int64), history, sums)]
            else:
                c = total[(a != START) & (a != END)]
                ends = total[a == END].sum()
                out.append((-3, part, np.array([c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum(), ends], np.int64).tobytes(), b"", b""))
        return pa.Table.from_batches([_record(out)])

    return work


def _read_texts(run: Run, grams: dict, count: dict[int, np.ndarray], mass: dict[int, np.ndarray], root: np.ndarray) -> np.ndarray:
    """Per place of a run the logarithm that the automaton of its n-grams gives to the word there, 0 at starts.

    Lanes of LANE words are read side by side.  A lane begins in the state in which the automaton is behind the word
    before it: that of the start at a text's start, else that of the last two words, which is all that a state holds.
    """
    (_, _, pair_of, at), (_, _, triple_of, far) = grams[2], grams[3]
    pair_at = np.full(len(run.x), -1)
    pair_at[at] = pair_of

    def one_place(which: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """A place of each n-gram."""
        out = np.zeros(n, np.int64)
        out[which] = places
        return out

    pair, triple = (one_place(w, p, len(count[k])) for k, w, p in ((2, pair_of, at), (3, triple_of, far)))
    counts = (count[1], count[2], count[3])
    automaton = backoff.Automaton.build(root, counts, (mass[1], mass[2]), (run.x[pair - 1], run.x[pair]), (pair_at[triple - 1], run.x[triple], pair_at[triple]))
    first = np.flatnonzero(run.x == 0)
    size = np.diff(np.append(first, len(run.x))) - 1
    lanes = -(-size // backoff.LANE)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = np.repeat(first + 1, lanes) + nth * backoff.LANE
    end = np.minimum(start + backoff.LANE, np.repeat(first + 1 + size, lanes))
    # 1 + 0 is the state of the start.
    state = np.where(nth == 0, 1, automaton.pair_state[pair_at[start - 1]])
    return automaton.read(run.x, start, end, state)


@dataclass
class Model:
    """The documents to learn from, or all documents with the fold that is held out."""

    docs: DataFrame
    folds: int
    fold: int


@dataclass
class Root:
    """The model without a history."""

    tokens: int
    distinct: int
    discount: float

    def root(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words seen c times at the automaton's root."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, c - self.discount, self.discount * self.distinct) / self.tokens

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))


def train(docs: DataFrame, folds: int = 10, fold: int = 0) -> Model:
    """The model of the documents outside the held-out fold; a null text counts as empty.

    Its n-grams are counted when documents are scored, in the same pass if these are the same table.
    """
    return Model(docs, folds, fold)


def _answers(asked: list[tuple[DataFrame, bool]], parts: int) -> tuple[dict[int, DataFrame], Root]:
    """By order, the rows (run, part, a: totals, b: arcs' mass) of all runs; and the root."""
    out: dict[int, DataFrame] = {}
    for order in reversed(ORDERS):
        slices, got = SLICES[order], []
        for nth in range(slices):
            rows = reduce(DataFrame.union, [f.select("run", "learn", "size", "low", "high", "hashes").mapInArrow(_asks(order, parts, nth, slices, ask), _ROWS) for f, ask in asked])
            if order < 3:
                rows = rows.union(out[order + 1].filter("run = -1"))
            with cleaning(rows.sparkSession):
                got.append(checkpoint(rows.groupBy("part").applyInArrow(_add_up(order, parts), _ROWS)))
        out[order] = reduce(DataFrame.union, got)
    figures = [np.frombuffer(bytes(r["a"]), np.int64) for r in out[1].filter("run = -3").select("a").collect()]
    words, distinct, once, twice, ends = np.sum([*figures, np.zeros(5, np.int64)], axis=0).tolist()
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    return {k: f.filter("run >= 0") for k, f in out.items()}, Root(words + ends, distinct + (ends > 0), discount)


def score(docs: DataFrame, model: Model, folds: int = 10, fold: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty, whose one token is the end.  Words that training has not seen are one
    event, in the base score as in the model's.  Scores are sums of log10 probabilities
    over all tokens.  Repeated rows get equal results, and a null doc_id is in no held-out fold; an
    empty table gives an empty result; other columns are ignored.
    """
    learnt = ~held_out(F.col("doc_id"), model.folds, model.fold)
    same = docs is model.docs
    kind = docs.schema["doc_id"].dataType.simpleString()

    def runs_of(table: DataFrame, learn: Column) -> DataFrame:
        rows = table.select("doc_id", learn.alias("learn"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), text_or_empty().alias("text"))
        of = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(_read, f"run long, doc_id array<{of}>, learn array<boolean>, held_out array<boolean>, {_WORDS}")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (left.schema.field("doc_id").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        doc_id, held = (left.column(c).combine_chunks()[0].values for c in ("doc_id", "held_out"))
        run = _run(*[left.column(c)[0].as_buffer() for c in ("size", "low", "high", "hashes")])
        got: dict[int, list] = {k: [] for k in ORDERS}
        for r in zip(*[right.column(c).to_pylist() for c in ("order", "part", "a", "b")], strict=True):
            got[r[0]].append(r[1:])
        right = None
        grams, count, mass = run.grams(3), {}, {}
        for k in ORDERS:
            a, b = grams[k][:2]
            part = part_of(k, a, b, parts)
            order, size = np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)
            answer = sorted(got.pop(k))
            for to, column in ((count, 1), (mass, 2)) if k < 3 else ((count, 1),):
                to[k] = np.empty(len(a))
                to[k][order] = np.concatenate([np.zeros(0), *(unpacked(r[column], size[r[0]]) for r in answer)])
        c = count[1][run.x]
        logs = _read_texts(run, grams, count, mass, root.root(count[1]))
        at = grams[2][3]
        sums = [np.bincount(run.text[at], v[at], len(doc_id)) for v in (np.ones(len(c)), (c > 0).astype(np.float64), np.log10(root.base(c)), logs)]
        return pa.table([doc_id, held, *[pa.array(s.astype(np.int64)) for s in sums[:2]], *[pa.array(s) for s in sums[2:]]], names)

    with Shelf(docs.sparkSession) as shelf:
        runs_ = shelf.keep(runs_of(docs, learnt if same else F.lit(False)), maxRecordsPerFile=FILE)
        asked = [(runs_, True)]
        if not same:
            asked.append((shelf.keep(runs_of(model.docs.filter(learnt), F.lit(True)), maxRecordsPerFile=FILE), False))
        # A place of a word is two bytes, of some seven in the text.
        size = sum(f.agg(F.coalesce(F.sum(F.octet_length("low")), F.lit(0))).first()[0] * 7 // 2 for f, _ in asked)
        parts = max(1, -(-size // PART))
        answers, root = _answers(asked, parts)
        told = reduce(DataFrame.union, [f.select("run", F.lit(k).alias("order"), "part", "a", "b") for k, f in answers.items()])
        out = []
        for nth in range(MEETINGS):
            some = lambda f: f.filter(F.pmod(F.xxhash64("run"), F.lit(MEETINGS)) == nth).groupBy("run")  # noqa: B023, E731
            met = some(runs_).cogroup(some(told)).applyInArrow(add, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
            with cleaning(docs.sparkSession):
                out.append(checkpoint(met.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(root.tokens).cast("long").alias("train_tokens"), "base_score", "score")))
        return reduce(DataFrame.union, out)
