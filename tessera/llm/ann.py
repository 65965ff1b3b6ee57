"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector; its
hash is the signed axis nearest to it.  A table has two rotations, and its buckets are pairs of signed
axes.  A query looks into the ``probes`` buckets of a table whose two axes are nearest to it together;
the vectors found in any table are ranked by their exact inner product in double precision.

How many probes are enough depends on how near the neighbours are, so it is learnt: up to ``sample``
queries are compared with all rows, and the least number is taken with which the tables hold ``goal`` and
three standard errors of their true neighbours.  The nearer the neighbours, as in larger tables, the fewer buckets are read.

A query that so meets fewer than k vectors, though there are more, is compared with all of them, block by
block.  Where lengths differ, candidates get one more component that makes them equally long, so that
the nearest direction is the largest inner product.

Vectors and queries meet by (table, cell), where a cell holds neighbouring buckets: a few cells for small
tables, more as the table grows, up to one for each bucket.  A query goes to the cells of its probes only.
A cell's vectors and its queries are dealt into chunks of bounded size, so a bucket with a third of all
rows is many tasks' work, and nothing is dropped; inside a chunk a query reads its buckets only.  What the
driver gets is the count of each cell, tables times the buckets at most, and the sample's neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Vectors or queries in a chunk, about; least number of a table's cells.
CHUNK = 16384
CELLS = 8
#: Vectors or queries in a block where all are compared with all.
BLOCK = 4096
#: Pairs whose inner products are taken together.
PAIRS = 1 << 16
#: Lengths that differ by no more than this share count as equal for hashing.
EVEN = 1e-3


@dataclass(frozen=True)
class Index:
    """Parameters that fix the rotations; the same everywhere."""

    dimension: int
    tables: int = 8
    seed: int = 17

    @property
    def axes(self) -> int:
        return 1 << max(0, (self.dimension - 1).bit_length())

    @property
    def signed(self) -> int:
        return 2 * self.axes

    def rotated(self, x: np.ndarray, table: int, nth: int = 0) -> np.ndarray:
        """Unit vectors (zeros added up to a power of two) after one of the table's two rotations."""
        y = np.zeros((len(x), self.axes), np.float32)
        y[:, : x.shape[1]] = x
        signs = np.random.default_rng([self.seed, table, nth]).choice(np.array([-1, 1], np.float32), (3, self.axes))
        for s in signs:
            y *= s
            h = 1
            while h < self.axes:
                z = y.reshape(len(y), -1, 2, h)
                a, b = z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]
                z[:, :, 0], z[:, :, 1] = a, b
                h *= 2
            y /= np.sqrt(np.float32(self.axes))
        return y

    def nearness(self, x: np.ndarray, table: int, nth: int) -> np.ndarray:
        """By signed axis, how near it is; axis i is 2 i if negative, 2 i + 1 if positive."""
        y = self.rotated(x, table, nth)
        return np.stack([-y, y], 2).reshape(len(y), -1)

    def own(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector: first axis times the number of signed axes, plus second axis."""
        return self.nearness(x, table, 0).argmax(1) * self.signed + self.nearness(x, table, 1).argmax(1)

    def probed(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The buckets with the highest sums of both axes' nearness, one row per vector.

        A pair of the i-th nearest first and the j-th nearest second axis has i j - 1 pairs that are no
        farther, so it can be among the first ``probes`` only if i j is at most that number.
        """
        probes = min(probes, self.signed**2)
        near = [self.nearness(x, table, nth) for nth in (0, 1)]
        order = [np.argsort(-n, axis=1, kind="stable") for n in near]
        near = [np.take_along_axis(n, o, 1) for n, o in zip(near, order, strict=True)]
        i = np.arange(1, self.signed + 1)
        upto = np.minimum(probes // i, self.signed)
        first = np.repeat(i - 1, upto)
        second = np.arange(len(first)) - np.repeat(np.cumsum(upto) - upto, upto)
        out = np.empty((len(x), probes), np.int64)
        for r in range(0, len(x), 64):
            rows = slice(r, r + 64)
            sums = near[0][rows][:, first] + near[1][rows][:, second]
            at = np.argpartition(-sums, probes - 1, axis=1)[:, :probes]
            out[rows] = np.take_along_axis(order[0][rows], first[at], 1) * self.signed + np.take_along_axis(order[1][rows], second[at], 1)
        return out

    def rank(self, q: np.ndarray, x: np.ndarray, table: int) -> np.ndarray:
        """In which place, from 1, one query's probes of a table reach the buckets of x."""
        near = [self.nearness(q[None], table, nth)[0] for nth in (0, 1)]
        buckets = self.own(x, table)
        sums = near[0][buckets // self.signed] + near[1][buckets % self.signed]
        second = np.sort(near[1])
        return 1 + sum(len(second) - np.searchsorted(second, sums - v, "right") for v in near[0])


def usable(vector: Column) -> Column:
    """Not null or empty, with finite components that aren't all zero."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small numbers stay in range
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n = _lengths(_matrix(batch.column(0), len(batch.column(0)[0])).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([n.min()]), pa.array([n.max()])], ["least", "most"])


def _lifted(x: np.ndarray, most: float | None) -> np.ndarray:
    """Unit vectors of one more component: a candidate's is what it lacks to the greatest length; a query's (most is None) is 0."""
    unit = _unit(x)
    if most is None:
        return np.column_stack([unit, np.zeros(len(x), np.float32)])
    share = np.minimum(_lengths(x.astype(np.float64)) / most, 1)
    return np.column_stack([unit * share[:, None], np.sqrt(1 - share**2)]).astype(np.float32)


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, added up in one order whatever stands beside."""
    return (q.astype(np.float64) * x.astype(np.float64)).sum(1)


def _first(a: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, best first, ties to the smaller id."""
    order = np.lexsort((ids, -score, a))
    a = a[order]
    return order[np.arange(len(a)) - np.searchsorted(a, a, "left") < k]


def best_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k nearest among x, ties to the smaller id, without its own id."""
    out: list[tuple] = []
    xd = x.astype(np.float64)
    for i in range(0, len(q), 256):
        s = q[i : i + 256].astype(np.float64) @ xd.T
        s[qid[i : i + 256][:, None] == xid[None, :]] = -np.inf
        kth = np.partition(s, len(xid) - k, axis=1)[:, len(xid) - k] if len(xid) > k else np.full(len(s), -np.inf)
        slack = 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(kth), kth, 0)))
        a, b = np.nonzero((s >= (kth - slack)[:, None]) & (s > -np.inf))
        exact = dots(q[i + a], x[b])
        keep = _first(a, xid[b], exact, k)
        out.append((qid[i + a[keep]], xid[b[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (qid[:0], xid[:0], np.zeros(0))


def best_in_buckets(q: np.ndarray, qid: np.ndarray, probes: list[np.ndarray], x: np.ndarray, xid: np.ndarray, bucket: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_of, of each query among the x whose bucket is one of its probes."""
    order = np.argsort(bucket, kind="stable")
    x, xid, bucket = x[order], xid[order], bucket[order]
    asked = np.repeat(np.arange(len(q)), [len(p) for p in probes])
    wanted = np.concatenate(probes)
    low, high = (np.searchsorted(bucket, wanted, side) for side in ("left", "right"))
    some = high > low
    asked, low, size = asked[some], low[some], (high - low)[some]
    out: list[tuple] = []
    ends = np.cumsum(size)
    # Whole queries together, as many as have about PAIRS pairs.
    per_query = np.bincount(asked, size, len(q)).astype(np.int64)
    group = np.cumsum(per_query) // PAIRS
    for g in np.unique(group[per_query > 0]):
        rows = slice(np.searchsorted(group[asked], g, "left"), np.searchsorted(group[asked], g, "right"))
        a = np.repeat(asked[rows], size[rows])
        b = np.arange(len(a)) + np.repeat(low[rows] - (ends[rows] - size[rows] - (ends[rows][0] - size[rows][0])), size[rows])
        other = qid[a] != xid[b]
        a, b = a[other], b[other]
        score = np.concatenate([np.zeros(0), *(dots(q[a[i : i + PAIRS]], x[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS))])
        keep = _first(a, xid[b], score, k)
        out.append((qid[a[keep]], xid[b[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (qid[:0], xid[:0], np.zeros(0))


def _probes(index: Index, candidates: DataFrame, queries: DataFrame, d: int, most: float | None, k: int, sample: int, goal: float) -> int:
    """The least number of probes with which the tables hold ``goal`` and three standard errors of the true neighbours of a sample of queries."""
    drawn = queries.orderBy(F.xxhash64("vec_id", F.lit(index.seed)), "vec_id").limit(sample).collect()
    if not drawn:
        return 1
    qid, q = np.array([r["vec_id"] for r in drawn]), np.array([list(r["v"]) for r in drawn], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's k nearest rows of each query of the sample."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), d).astype(np.float64)
            score = q @ x.T
            score[qid[:, None] == ids[None, :]] = -np.inf
            a, b = np.nonzero(score > -np.inf)
            s, ids, x = score[a, b], ids[b], b
            if len(a) > len(q) * k:
                keep = _first(a, ids, s, k)
                a, s, ids, x = a[keep], s[keep], ids[keep], x[keep]
            x = _matrix(batch.column(1), d)[x]
            held = (a, ids, s, x) if held is None else tuple(np.concatenate(c) for c in zip(held, (a, ids, s, x), strict=True))
            keep = _first(held[0], held[1], held[2], k)
            held = tuple(c[keep] for c in held)
        if held is not None:
            a, ids, s, x = held
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * d, d, dtype=np.int32)), pa.array(x.ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids), pa.array(s), lists], ["q", "vec_id", "score", "v"])

    met = candidates.mapInArrow(nearest, "q long, vec_id long, score double, v array<double>")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    found = met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("q", "v").collect()
    if not found:
        return 1
    of, x = np.array([r["q"] for r in found]), np.array([list(r["v"]) for r in found], np.float64)
    unit_q, unit_x = (_unit(q), _unit(x)) if most is None else (_lifted(q, None), _lifted(x, most))
    best = np.concatenate([np.min([index.rank(unit_q[i], unit_x[of == i], t) for t in range(index.tables)], axis=0) for i in np.unique(of)])
    sure = min(1.0, goal + 3 * math.sqrt(goal * (1 - goal) / len(best)))
    return int(np.sort(best)[math.ceil(sure * len(best)) - 1])


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 8, probes: int | None = None, seed: int = 17, sample: int = 64, goal: float = 0.92) -> DataFrame:
    """One row per query and neighbour: query_id, rank from 1, vec_id, score.

    Candidates are all rows but those with the query's own vec_id.  Vectors that are null, empty, zero
    or hold a null or non-finite component take no part, nor do those with a null vec_id.  Vectors have
    products with those of their own length alone, so each length is searched on its own.  Rows that are
    repeated whole count once.  Ties go to the smaller vec_id.  An empty table gives an empty result;
    other columns are ignored.  Without ``probes``, their number is learnt from ``sample`` queries.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    single = kind == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if single else "array<double>").alias("v"), is_query.alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = sorted((-r["n"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, [_search(rows.filter(F.size("v") == d), d, -n, k, tables, probes, seed, sample, goal) for n, d in sizes])


def _search(rows: DataFrame, d: int, count: int, k: int, tables: int, probes: int | None, seed: int, sample: int, goal: float) -> DataFrame:
    """search() of rows (vec_id, v, q) that all have d components."""
    out_schema = "query_id long, rank int, vec_id long, score double"
    single = rows.schema["v"].dataType.simpleString() == "array<float>"
    least, most = rows.select("v").mapInArrow(_spans, "least double, most double").agg(F.min("least"), F.max("most")).first()
    uneven = most > least * (1 + EVEN)
    index = Index(d + uneven, tables, seed)
    candidates, queries = rows.select("vec_id", "v"), rows.filter("q").select("vec_id", "v")
    number = np.float32 if single else np.float64
    if probes is None:
        probes = _probes(index, candidates, queries, d, most if uneven else None, k, sample, goal)
    cells = min(index.signed**2, max(CELLS, -(-count // CHUNK)))

    def hashed(asks: bool, splits: np.ndarray | None):
        """Rows (t, cell, c, e, vec_id, v, buckets): of a candidate its bucket, of a query those it asks for in the cell.  Without splits, counts."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    batch = whole.slice(start, 512)
                    ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
                    unit = _lifted(x, None if asks else most) if uneven else _unit(x)
                    for t in range(index.tables):
                        b = index.probed(unit, t, probes) if asks else index.own(unit, t)[:, None]
                        cell = b * cells // index.signed**2
                        # One row for each vector and cell, with its buckets there.
                        order = np.lexsort((b.ravel(), cell.ravel(), np.repeat(np.arange(len(b)), b.shape[1])))
                        row, cell, b = np.repeat(np.arange(len(b)), b.shape[1])[order], cell.ravel()[order], b.ravel()[order].astype(np.int32)
                        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
                        held = np.split(b, first[1:])
                        row, cell = row[first], cell[first]
                        if splits is None:
                            n = np.bincount(cell, minlength=cells)
                            at = np.flatnonzero(n)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["t", "cell", "n"])
                            continue
                        split = splits[t]
                        own, other = split[cell, 1 if asks else 0], split[cell, 0 if asks else 1]
                        mine = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(own, 1)
                        other = np.where(own > 0, other, 0)
                        again = np.repeat(np.arange(len(row)), other)
                        theirs = np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)
                        c, e = (theirs, mine[again]) if asks else (mine[again], theirs)
                        data = [v.tobytes() for v in x.astype(number)]
                        for i in range(0, len(again), 8192):
                            j = slice(i, i + 8192)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(again[j]), t, np.int32)), pa.array(cell[again[j]].astype(np.int32)), pa.array(c[j].astype(np.int32)), pa.array(e[j].astype(np.int32)), pa.array(ids[row[again[j]]]), pa.array([data[r] for r in row[again[j]]], pa.binary()), pa.array([held[r].tobytes() for r in again[j]], pa.binary())],
                                ["t", "cell", "c", "e", "vec_id", "v", "buckets"],
                            )

        return work

    counts: dict = {}
    for side, (frame, asks) in enumerate(((candidates, False), (queries, True))):
        counted = frame.mapInArrow(hashed(asks, None), "t int, cell int, n long").groupBy("t", "cell").agg(F.sum("n").alias("n"))
        for r in counted.collect():
            counts.setdefault((r["t"], r["cell"]), [0, 0])[side] = -(-r["n"] // CHUNK)
    splits = np.zeros((index.tables, cells, 2), np.int64)
    for (t, cell), n in counts.items():
        splits[t, cell] = n if all(n) else (0, 0)
    schema = "t int, cell int, c int, e int, vec_id long, v binary, buckets binary"
    x = candidates.mapInArrow(hashed(False, splits), schema).groupBy("t", "cell", "c", "e")
    q = queries.mapInArrow(hashed(True, splits), schema).groupBy("t", "cell", "c", "e")
    names = ["query_id", "vec_id", "score"]
    nothing = lambda: pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing()
        (xid, x), (qid, q) = ((t.column("vec_id").to_numpy(), np.frombuffer(b"".join(t.column("v").to_pylist()), number).reshape(-1, d)) for t in (left, right))
        own = np.frombuffer(b"".join(left.column("buckets").to_pylist()), np.int32)
        return pa.table([pa.array(c) for c in best_in_buckets(q, qid, [np.frombuffer(b, np.int32) for b in right.column("buckets").to_pylist()], x, xid, own, k)], names)

    def meet_all(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing()
        (xid, x), (qid, q) = ((t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks(), d)) for t in (left, right))
        return pa.table([pa.array(c) for c in best_of(q, qid, x, xid, k)], names)

    found = x.cogroup(q).applyInArrow(meet, "query_id long, vec_id long, score double")
    # Rows of one id may differ; the best counts.
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda f: f.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    near = stored(ranked(once))
    full = min(k, candidates.select("vec_id").distinct().count() - 1)
    met = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= full).select("query_id")
    short = stored(queries.join(met, queries["vec_id"] == met["query_id"], "left_anti"))
    missing = short.count() if full > 0 else 0
    if not missing:
        return near
    blocks, groups = -(-count // BLOCK), -(-missing // BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = candidates.distinct().select(block(blocks).alias("c"), every(groups).alias("e"), "vec_id", "v")
    right = short.select(every(blocks).alias("c"), block(groups).alias("e"), "vec_id", "v")
    exact = left.groupBy("c", "e").cogroup(right.groupBy("c", "e")).applyInArrow(meet_all, "query_id long, vec_id long, score double")
    rest = ranked(exact.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    return near.join(met, "query_id", "left_semi").select(*near.columns).union(rest)
