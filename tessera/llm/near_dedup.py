"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is a weighted set: its shingles of ``SHINGLE`` words (white-space words, A-Z in lower case)
with their numbers of occurrences; a shorter document has all of its words as its one shingle, one
without words has none.  Similarity is the probability Jaccard measure

    J(x, y) = sum over shingles d in both of 1 / sum over all e of max(x_e / x_d, y_e / y_d),

which for weights of 1 is the common Jaccard measure.

1. Sketch.  Each shingle's arrivals are a Poisson process with its weight as rate, from hashes of the
   shingle; each arrival goes to a random register, which keeps its earliest.  Arrivals later than all
   registers' are not made.  Two registers agree with probability J.
2. Equal sets (a 128-bit hash) become one node, so copies are not compared.
3. Banding.  Nodes meet where all registers of a band agree; each is compared to the bucket's hub, the
   first of its nodes in one random order of all, so that a family has few hubs.  Verification computes
   J from the texts.
4. Where a bucket's nodes are still in different classes, those outside its largest class are compared
   with members of that class drawn at random, in a few rounds, as long as a round settles half
   of what is open: a large family so becomes one class at a cost that grows with its size, not with the
   square of it.
5. What is left is compared in full, in tiles of bounded size: first by registers, to find the nodes
   that have any likely partner; then those nodes' texts meet, and likely pairs are verified inside the
   tile, each in the first band that it shares.  Pairs are never rows here.
6. Classes are the connected components of the links.

With 25 bands of 5 registers, a pair at 0.8 fails to meet with a probability below 1e-4.  Pairs whose
estimate is more than ``slack`` below the threshold are not verified; at 0.25, a pair at 0.8 is lost by
that with a probability below 1e-9, and a slack of 1 verifies all pairs that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow_text import runs, text_bytes
from tessera.llm.common import Shelf, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
REGISTERS = BANDS * ROWS
#: How far an estimate may be below the threshold for a pair to be verified.
SLACK = 0.25
#: Rounds in which those outside a bucket's largest class meet a random member of it, at most, and the share of
#: those outside that a round must settle for another one: unlike nodes are left to the tiles, which compare all.
ROUNDS = 4
SETTLED = 0.5
#: Nodes in a block of a tile, and bytes of their texts.
BLOCK = 500
BYTES = 4 << 20
#: Slots of the filter of texts to fetch: a bound on what is broadcast for it.
SLOTS = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all white-space words in order."""
    return words_between(data, offsets, _SPACE)[:2]


def words_between(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of all words in order, A-Z in lower case; blanks: by byte, whether it parts words.

    A word's hash is that of its polynomial over 2^64, mixed.  start and end are places in data.
    """
    own = data[offsets[0] : offsets[-1]]
    none = np.zeros(0, np.int64)
    if not len(own):
        return np.zeros(0, np.uint64), none, none, none
    blank = blanks[own]
    start = ~blank
    start[1:] &= blank[:-1]
    bounds = offsets[:-1] - offsets[0]
    inner = bounds[(bounds > 0) & (bounds < len(own))]
    start[inner] = ~blank[inner]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), none, none, none
    # Position of each byte in its word, so that reduceat adds byte * power[position].
    word = np.cumsum(start) - 1
    place = np.arange(len(own)) - at[np.maximum(word, 0)]
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(int(place.max()), 0), _MULT)]))
    value = np.where(blank, np.uint64(0), mix(_LOWER[own].astype(np.uint64) + np.uint64(1)) * power[np.maximum(place, 0)])
    text = np.searchsorted(bounds, at, "right") - 1
    size = np.add.reduceat((~blank).astype(np.int64), at)
    return mix(np.add.reduceat(value, at)), text, offsets[0] + at, offsets[0] + at + size


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count) of the weighted sets, by text and code."""
    h, text = word_hashes(data, offsets)
    n = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    factor = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    code = np.zeros(len(h), np.uint64)
    for j in range(k):
        code[: len(h) - j] += h[j:] * factor[j]
    whole = np.arange(len(h)) + k <= (first + n)[text] if len(h) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < k))
    lone = [np.add.reduce(h[first[i] : first[i] + n[i]] * factor[: n[i]]) + np.uint64(n[i]) for i in short]
    text = np.concatenate([text[whole], short])
    code = mix(np.concatenate([code[whole], np.array(lone, np.uint64)]))
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], code[at], np.diff(np.append(at, len(code)))


def sketch(text: np.ndarray, code: np.ndarray, count: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers of n texts: the code that arrived first at each; zeros for a text without shingles."""
    best, won = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    live, time = np.arange(len(code)), np.zeros(len(code))
    k = 0
    while len(live):
        k += 1
        draw = mix(code[live] + np.uint64(k * int(_MULT) & 0xFFFFFFFFFFFFFFFF))
        time[live] += -np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / count[live]
        slot = text[live] * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, time[live])
        first = best[slot] == time[live]
        won[slot[first]] = code[live[first]]
        latest = best.reshape(n, registers).max(1)
        live = live[time[live] < latest[text[live]]]
    return won.reshape(n, registers)


def bands(won: np.ndarray) -> np.ndarray:
    """One key per band."""
    parts = won.reshape(len(won), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(won), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * _MULT + parts[:, :, j])
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, digest, text -> doc_id, digest, bytes, set_a, set_b, keys, small; the last four null without words."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        for i, j in runs(offsets, 2 << 20):
            text, code, count = shingles(data, offsets[i : j + 1])
            n = j - i
            won = sketch(text, code, count, n)
            has = np.bincount(text, minlength=n) > 0
            sums = []
            for salt in (1, 2):
                s = np.zeros(n, np.uint64)
                np.add.at(s, text, mix(code ^ mix(np.uint64([salt]))) * count.astype(np.uint64))
                sums.append(s.view(np.int64))
            keys, small = bands(won), mix(won).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(np.diff(offsets[i : j + 1])), *(pa.array(s, mask=~has) for s in sums), lists, pa.array([r.tobytes() if ok else None for r, ok in zip(small, has, strict=True)], pa.binary())],
                ["doc_id", "digest", "bytes", "set_a", "set_b", "keys", "small"],
            )


def probability_jaccard(ca: np.ndarray, xa: np.ndarray, cb: np.ndarray, xb: np.ndarray) -> float:
    """J of two weighted sets with sorted codes."""
    both, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = xa[ia].astype(float), xb[ib].astype(float)
    # Over e, max(x_e / x_d, y_e / y_d) is the first part where y_e / x_e <= y_d / x_d: order by that ratio.
    only_x, only_y = xa.sum() - x.sum(), xb.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    below = np.cumsum(x) + only_x
    above = y[::-1].cumsum()[::-1] - y + only_y
    return float((1 / (below / x + above / y)).sum())


def _alike(sets: tuple[np.ndarray, np.ndarray, np.ndarray], x: int, y: int, threshold: float) -> bool:
    """Whether texts x and y of shingles() are similar; the third array says where each text begins."""
    code, count, cut = sets
    i, j = slice(cut[x], cut[x + 1]), slice(cut[y], cut[y + 1])
    return probability_jaccard(code[i], count[i], code[j], count[j]) >= threshold - 1e-12


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, code, count = shingles(*text_bytes(column))
    return code, count, np.searchsorted(text, np.arange(len(column) + 1))


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    out = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def _hub(threshold: float):
    """The links of a group's nodes (role 0) with its hub (role 1), from texts."""

    def work(table: pa.Table) -> pa.Table:
        role, node = (table.column(c).to_numpy() for c in ("role", "node"))
        hub, sets = int(np.flatnonzero(role == 1)[0]), _sets(table.column("text"))
        return _links([(int(node[x]), int(node[hub])) for x in np.flatnonzero(role == 0) if _alike(sets, int(x), hub, threshold)])

    return work


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _estimates(least: float):
    """Pairs whose registers agree in a share of at least ``least``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array((_registers(batch.column(2)) == _registers(batch.column(3))).mean(1) >= least))

    return work


def _likely(band: int, small: np.ndarray, keys: np.ndarray, p: np.ndarray, q: np.ndarray, comp: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (of p, of q) in different classes that agree in enough registers and share no earlier band."""
    for i in range(0, len(p), 16):
        rows = p[i : i + 16]
        r, c = np.nonzero(((small[rows][:, None, :] == small[q][None, :, :]).mean(2) >= least) & (comp[rows][:, None] != comp[q][None, :]))
        a, b = rows[r], q[c]
        earlier = (keys[a, :band] == keys[b, :band]).any(1)
        yield a[~earlier], b[~earlier]


def _tile(least: float, threshold: float | None):
    """Without a threshold: the nodes (key, node) that have a likely partner.  With one: the links (a, b), from texts."""

    def work(table: pa.Table) -> pa.Table:
        role, node, comp = (table.column(c).to_numpy() for c in ("role", "node", "comp"))
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(node), -1)
        band, key = int(table.column("band")[0].as_py()), table.column("key")[0].as_py()
        pairs = _likely(band, _registers(table.column("small")), keys, np.flatnonzero(role == 0), np.flatnonzero(role == 1), comp, least)
        if threshold is None:
            found = np.unique(node[np.concatenate([np.zeros(0, np.int64), *(x for pair in pairs for x in pair)])])
            return pa.table([pa.array(np.full(len(found), key)), pa.array(found)], ["key", "node"])
        sets = _sets(table.column("text"))
        return _links(sorted({(min(node[x], node[y]), max(node[x], node[y])) for a, b in pairs for x, y in zip(a.tolist(), b.tolist(), strict=True) if _alike(sets, x, y, threshold)}))

    return work


def _tiled(members: DataFrame, payload: str):
    """Members dealt into tiles: each pair of a block outside the bucket's largest class with any block of the bucket."""
    upto = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)

    def role(rows: DataFrame, outer, side: int, inner, r: int) -> DataFrame:
        return rows.select("key", "band", F.lit(r).alias("role"), outer.alias("outer"), F.lit(side).alias("side"), inner.alias("inner"), "node", "comp", "keys", "small", *([payload] if payload else []))

    outside, every_out, every_in = members.filter("not inside"), F.explode(upto(F.col("blocks_out"))), F.explode(upto(F.col("blocks_in")))
    tiles = role(outside, F.col("block"), 0, every_out, 0).unionByName(role(outside, every_out, 0, F.col("block"), 1))
    tiles = tiles.unionByName(role(outside.filter("blocks_in > 0"), F.col("block"), 1, every_in, 0))
    return tiles.unionByName(role(members.filter("inside"), every_out, 1, F.col("block"), 1)).groupBy("key", "outer", "side", "inner")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node of its connected component, for all nodes of links (a, b)."""
    with Shelf(links.sparkSession) as shelf:
        edges = shelf.keep(links.select("a", "b").union(links.select("b", "a")).distinct())
        kept = shelf.keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"))
        while True:
            labels = kept.select("node", "comp")
            near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
            step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
            to = step.select(F.col("node").alias("at"), F.col("comp").alias("further"))
            step = shelf.keep(step.join(to, step["comp"] == to["at"]).select("node", F.col("further").alias("comp"), "was"))
            if step.filter("comp != was").isEmpty():
                return stored(step.select("node", "comp"))
            shelf.drop(kept)
            kept = step


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, comp) after more links."""
    if comp is None:
        return components(links)
    of = lambda c: comp.select(F.col("node").alias(f"{c}_node"), F.col("comp").alias(f"{c}_comp"))
    between = links.join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    new = components(between.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).filter("a != b"))
    further = new.select(F.col("node").alias("was"), F.col("comp").alias("further"))
    moved = comp.join(further, comp["comp"] == further["was"], "left").select("node", F.coalesce("further", "comp").alias("comp"))
    return stored(moved.union(new.join(comp, "node", "left_anti")))


def placed_in(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (key, band, node) with their class.  A node looks its class up once, not once for each of its buckets."""
    own = members.groupBy("node").agg(F.collect_list(F.struct("key", "band")).alias("at"))
    found = own.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.explode("at").alias("m"))
    return found.select("m.key", "m.band", "node", "comp")


def linked(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """One row per document, stored: doc_id, digest (MD5 of its text), node (a number of its set), comp (the node that
    stands for its class); the last two null without words."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    least = threshold - slack
    with Shelf(spark) as shelf:
        made = shelf.keep(rows.mapInArrow(_sketches, "doc_id long, digest string, bytes long, set_a long, set_b long, keys array<long>, small binary"))
        once = made.filter("set_a is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("digest", "bytes")).alias("text"), F.first("keys").alias("keys"), F.first("small").alias("small"))
        nodes = shelf.keep(once.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "text.*", "keys", "small"))
        met = nodes.select("node", F.posexplode("keys").alias("band", "key"))
        buckets = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", F.xxhash64("node")).alias("b")).filter("n > 1")
        members = shelf.keep(met.join(buckets, "key"))

        def likely(pairs: DataFrame) -> DataFrame:
            a, b = (nodes.select(F.col("node").alias(f"{c}_node"), F.col("small").alias(f"{c}_small")) for c in "ab")
            both = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
            return both.select("a", "b", "a_small", "b_small").mapInArrow(_estimates(least), "a long, b long")

        def texts_of(ids: DataFrame) -> DataFrame:
            """node, text.  Texts that aren't wanted are left out before the shuffle, but for those that share a slot."""
            slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
            wanted = shelf.keep(nodes.join(ids.distinct(), "node").select("node", "digest"))
            slots = wanted.select(slot.alias("slot")).distinct()
            near = rows.select("digest", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(slots), slot == F.col("slot"), "left_semi")
            return shelf.keep(near.groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest").select("node", "text"))

        def links_to_hubs(pairs: DataFrame) -> DataFrame:
            """The links among pairs (a, b), where b stands in many: a's texts meet b's in groups of bounded size."""
            pairs = shelf.keep(likely(pairs.distinct()))
            texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
            sized = pairs.join(nodes.select(F.col("node").alias("a"), "bytes"), "a")
            groups = sized.groupBy("b").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BYTES), F.lit(1)).alias("groups"))
            asked = pairs.join(groups, "b").select("b", F.pmod(F.xxhash64("a"), F.col("groups")).alias("group"), F.lit(0).alias("role"), F.col("a").alias("node"))
            hubs = groups.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), F.lit(1).alias("role"), F.col("b").alias("node"))
            links = shelf.keep(asked.union(hubs).join(texts, "node").groupBy("b", "group").applyInArrow(_hub(threshold), "a long, b long"))
            shelf.drop(pairs, texts)
            return links

        comp = merged(None, links_to_hubs(members.filter("node != b").select(F.col("node").alias("a"), "b")))
        # Members of buckets that may hold different classes still; in those of two, the pair is settled.
        still, placed = members.filter("n > 2"), None
        outside = still.filter("node != b").count()
        for nth in range(rounds + 1):
            before, placed = placed, placed_in(still, comp)
            largest = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"), F.count(F.lit(1)).alias("classes"))
            placed = shelf.keep(placed.join(largest.filter("classes > 1").select("key", "big"), "key").withColumn("inside", F.col("comp") == F.col("big")).drop("big"))
            if before is not None:
                shelf.drop(before)
            were, outside = outside, placed.filter("not inside").count()
            if nth == rounds or not outside or outside > (1 - SETTLED) * were:
                break
            hubs = placed.filter("inside").groupBy("key").agg(F.max_by("node", F.xxhash64("node", "key", F.lit(nth))).alias("b"))
            links = links_to_hubs(placed.filter("not inside").join(hubs, "key").select(F.col("node").alias("a"), "b"))
            if links.isEmpty():
                break
            comp = merged(comp, links)
            # A bucket of one class stays one of one class.
            still = placed
        part = lambda inside: F.greatest(F.ceil(F.count(F.when(F.col("inside") == inside, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(F.col("inside") == inside, F.col("bytes"))), F.lit(0)) / BYTES))
        sized = placed.join(nodes.select("node", "bytes", "keys", "small"), "node")
        sizes = sized.groupBy("key").agg(part(True).alias("blocks_in"), part(False).alias("blocks_out"))
        block = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("blocks_in")).otherwise(F.col("blocks_out")))
        open_ = sized.join(sizes, "key").withColumn("block", block)
        wanted = shelf.keep(_tiled(open_, "").applyInArrow(_tile(least, None), "key long, node long").distinct())
        again = open_.join(wanted, ["key", "node"], "left_semi").join(texts_of(wanted.select("node")), "node")
        rest = shelf.keep(_tiled(again, "text").applyInArrow(_tile(least, threshold), "a long, b long").distinct())
        comp = merged(comp, rest)
        named = nodes.join(comp, "node", "left").select("set_a", "set_b", "node", F.coalesce("comp", "node").alias("comp"))
        return stored(made.select("doc_id", "digest", "set_a", "set_b").join(named, ["set_a", "set_b"], "left").select("doc_id", "digest", "node", "comp"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class).

    A document without words (a null text too) is a class of its own.  Rows are documents of their own
    even where they share a doc_id.  A row with a null doc_id gets the smallest id of its class, null if
    no row of the class has one.  An empty table gives an empty result; other columns are ignored.
    """
    rows = linked(docs, threshold, slack)
    first = rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, "comp", "left").select("doc_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """Of each class one document, with all its columns; documents without words stay.

    The row with the smallest doc_id stays (null ids last), of rows with one id the one with the least
    MD5 of its text, of rows that agree in both the least by its columns.
    """
    rows = linked(docs, threshold, slack)
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest")
    first = rows.filter("comp is not null").groupBy("comp").agg(F.min(ranked).alias("r")).select("r.id", "r.digest")
    key = lambda doc_id, digest: F.concat_ws("|", digest, doc_id.cast("string"))
    stays = first.union(rows.filter("comp is null").select("doc_id", "digest")).select(key(F.col("id"), F.col("digest")).alias("stay")).distinct()
    repeated = rows.filter("comp is not null").select(key(F.col("doc_id"), F.col("digest")).alias("again")).groupBy("again").count().filter("count > 1")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    kept = keyed.join(stays, keyed["key"] == stays["stay"], "left_semi")
    if not repeated.isEmpty():
        often = kept.join(repeated, kept["key"] == repeated["again"], "left_semi")
        one = often.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.to_json("row")))).filter("nth = 1").drop("nth")
        kept = kept.join(repeated, kept["key"] == repeated["again"], "left_anti").union(one)
    return kept.select("row.*")
