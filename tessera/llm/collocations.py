"""Phrase collocations from count tries: each shard counts its phrases in a trie, and the tries are merged by range.

Texts are read once, into shards that are stored.  A shard's trie is made one level at a time: level k holds its
distinct phrases of k words, serialised as arrays of (prefix, last word, count) in order of the phrase's 64-bit
hash and cut at ranges of that hash.  The task of a range merges the sorted arrays of all shards, adds counts up, and
keeps the nodes that reach the threshold; it answers each shard with one bit for each phrase that it has sent.  A
phrase occurs no more often than its parts, so a shard goes on to level k + 1 only where both phrases of k words
inside are kept: nothing is lost by that, and rare words, most of all, are sent once.

The merged trie is a table of nodes.  A node's left parts are its ancestors, met by walking from the root down; its
right parts are met by suffix links: the link of a node is the child, by the same last word, of its parent's
link.  Both walks are one equality join for each level, of tables that hold frequent phrases alone.

Words are told apart by 64-bit hashes in which the language takes part, so equal words of two languages differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow_text import runs, text_bytes
from tessera.llm.common import Shelf, cleaning, stored, text_or_empty
from tessera.llm.lm import joined, packed, unpacked
from tessera.llm.near_dedup import mix, words_between

#: Words of a phrase at most, occurrences of a candidate at least, phrases reported for a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text in a shard, in a piece cut into words in one go, and for each range; shards in a file.
SHARD, PIECE, RANGE, FILE = 8 << 20, 1 << 19, 4 << 20, 4
#: Groups that a language's candidates are dealt into before its first ones are taken.
SALTS = 64
_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True
_BLANK |= _BREAK
_SHARDS = "shard long, low binary, high binary, last binary, hashes binary, langs array<string>, totals array<long>"
_SENT = "shard long, part int, a binary, b binary, n binary, langs array<string>, words array<string>"
_SENT_NAMES = [f.split()[0] for f in _SENT.split(", ")]
_TEXTS = pa.list_(pa.string())


def _lang_hash(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The words at these places, with A-Z in lower case."""
    raw = data.tobytes().lower()
    return [raw[i:j].decode() for i, j in zip(start.tolist(), end.tolist(), strict=True)]


def _row(shard: int, part: int, a: bytes, b: bytes = b"", n: bytes = b"", langs: list[str] | None = None, words: list[str] | None = None) -> tuple:
    return shard, part, a, b, n, langs or [], words or []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), _TEXTS, _TEXTS)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _SENT_NAMES)


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(texts' languages, word hashes, whether a piece ends behind the word, text of each, data, start, end) of shards."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        langs = batch.column(0).to_pylist()
        for i, j in runs(offsets, SHARD):
            got = []
            for k, m in runs(offsets[i : j + 1], PIECE):
                h, text, start, end = words_between(data, offsets[i + k : i + m + 1], _BLANK)
                seed = np.array([_lang_hash(x) for x in langs[i + k : i + m]], np.uint64)
                base = offsets[i + k]
                breaks = np.cumsum(_BREAK[data[base : offsets[i + m]]])
                last = np.ones(len(h), bool)
                # Where no sign stands between a word's end and the next one's start, the piece goes on.
                if len(h) > 1:
                    last[:-1] = (breaks[start[1:] - base] != breaks[end[:-1] - 1 - base]) | (text[1:] != text[:-1])
                got.append((mix(h ^ seed[text]), last, text + k, start, end))
            parts = [np.concatenate(x) for x in zip(*got, strict=True)]
            yield langs[i:j], parts[0], parts[1], parts[2], data, parts[3], parts[4]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each, number of each place's key)."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[order[new]], order[new], which


def _parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of sorted keys: (number, start) of those that are met, with the end behind the last."""
    # The high half of a key times the number of ranges, so ranges are equal shares of the hashes.
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    met, first = np.unique(part, return_index=True)
    return met, np.append(first, len(keys))


def _shards_and_words(parts: int) -> Callable:
    """lang, text -> shards, each with its first level."""
    names = [f.split()[0] for f in _SHARDS.split(", ")]
    kinds = (pa.int64(), *[pa.binary()] * 4, _TEXTS, pa.list_(pa.int64()))
    sent_kind = pa.list_(pa.struct([("part", pa.int32()), ("a", pa.binary()), ("n", pa.binary()), ("langs", _TEXTS), ("words", _TEXTS)]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for langs, h, last, text, data, start, end in _cut_words(batches):
            distinct, of = np.unique(np.array(langs, object), return_inverse=True)
            totals = np.bincount(of[text], minlength=len(distinct))
            keys, place, which = _distinct(h)
            n = np.bincount(which, minlength=len(keys))
            met, first = _parts(keys, parts)
            words, homes = _texts(data, start[place], end[place]), text[place].tolist()
            sent = [{"part": int(p), "a": keys[i:j].tobytes(), "n": packed(n[i:j]), "langs": [langs[t] for t in homes[i:j]], "words": words[i:j]} for p, i, j in zip(met, first, first[1:], strict=False)]
            high = (which >> 16).astype(np.uint8 if len(keys) <= 1 << 24 else np.uint16)
            held = [which.astype(np.uint16), high, np.packbits(last), keys]
            row = [[TaskContext.get().partitionId() << 32 | nth], *[[x.tobytes()] for x in held], [distinct.tolist()], [totals.tolist()], [sent]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (*kinds, sent_kind), strict=True)], [*names, "sent"])
            nth += 1

    return work


class Shard:
    """The words of a shard, as places in its hashes, and where pieces end."""

    def __init__(self, low: bytes, high: bytes, last: bytes, hashes: bytes):
        low = np.frombuffer(low, np.uint16).astype(np.int64)
        self.hashes = np.frombuffer(hashes, np.uint64)
        self.word = low | np.frombuffer(high, np.uint8 if len(high) == len(low) else np.uint16).astype(np.int64) << 16 if len(low) else low
        self.last = np.unpackbits(np.frombuffer(last, np.uint8))[: len(low)].astype(bool)

    def ids(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the first k - 1 words, hash of all k) of the phrases from these places on."""
        before = path = self.hashes[self.word[at]]
        for j in range(1, k):
            before, path = path, joined(path, self.hashes[self.word[at + j]])
        return before, path

    def starts(self, kept: np.ndarray | None, k: int) -> np.ndarray:
        """Where phrases of k words start; kept: whether the phrase of k - 1 words from a place on is kept."""
        if k == 1:
            return np.arange(len(self.word))
        # Both phrases inside are kept; a phrase of one word may end a piece, so the first word's end is asked for.
        both = kept[:-1] & kept[1:]
        return np.flatnonzero(both & ~self.last[:-1] if k == 2 else both)


def _send(shard: int, level: int, parts: int, words: Shard, at: np.ndarray) -> list[tuple]:
    """The serialised level of a shard's trie: a row for each range."""
    before, path = words.ids(at, level)
    keys, place, which = _distinct(path)
    n = np.bincount(which, minlength=len(keys))
    before, last = before[place], words.hashes[words.word[at[place] + level - 1]] if len(at) else keys
    met, first = _parts(keys, parts)
    return [_row(shard, int(p), before[i:j].tobytes(), last[i:j].tobytes(), packed(n[i:j])) for p, i, j in zip(met, first, first[1:], strict=False)]


def _later_level(level: int, parts: int) -> Callable:
    """A shard and its answers on the level before -> its kept places (part -1) and the level's rows."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch([])])
        words = Shard(*[left.column(c)[0].as_buffer() for c in ("low", "high", "last", "hashes")])
        shard = left.column("shard")[0].as_py()
        told = {r["part"]: r["a"] for r in right.select(["part", "a"]).to_pylist()}
        mask = told.pop(-1, None)
        before = None if mask is None else np.unpackbits(np.frombuffer(mask, np.uint8))[: len(words.word)].astype(bool)
        at = words.starts(before, level - 1)
        keys, _, which = _distinct(words.ids(at, level - 1)[1])
        met, first = _parts(keys, parts)
        bits = [np.unpackbits(np.frombuffer(told[int(p)], np.uint8))[: j - i] for p, i, j in zip(met, first, first[1:], strict=False)]
        kept = np.zeros(len(words.word), bool)
        if len(at):
            kept[at] = np.concatenate(bits).astype(bool)[which]
        rows = _send(shard, level, parts, words, words.starts(kept, level)) if len(kept) else []
        return pa.Table.from_batches([_batch([_row(shard, -1, np.packbits(kept).tobytes()), *rows])])

    return work


def _merge(level: int, least: int) -> Callable:
    """The rows of a range -> its nodes (shard -1: prefix, last word, count) and each shard's bits."""

    def work(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        a, b, n = (table.column(c).to_pylist() for c in ("a", "b", "n"))
        size = [len(x) // 8 for x in a]
        before, last = (np.frombuffer(b"".join(x), np.uint64) for x in (a, b))
        n = np.concatenate([unpacked(x, k) for x, k in zip(n, size, strict=True)])
        keys = before if level == 1 else joined(before, last)
        # Sorted arrays one behind the other: a stable sort merges such stretches.
        _, place, which = _distinct(keys)
        total = np.bincount(which, n).astype(np.int64)
        kept = total >= least
        bits = kept[which]
        first = np.concatenate([[0], np.cumsum(size)])
        out = [_row(s, part, np.packbits(bits[i:j]).tobytes()) for s, i, j in zip(table.column("shard").to_pylist(), first, first[1:], strict=False)]
        langs, words = [], []
        place = place[kept]
        if level == 1:
            # The first row of each is enough for its language and text; rows hold as many as they have keys.
            row = np.searchsorted(first, place, "right") - 1
            for r, k in zip(row.tolist(), (place - first[row]).tolist(), strict=True):
                langs.append(table.column("langs")[r].values[k].as_py())
                words.append(table.column("words")[r].values[k].as_py())
        out.append(_row(-1, part, before[place].tobytes(), last[place].tobytes() if level > 1 else b"", total[kept].tobytes(), langs, words))
        return pa.Table.from_batches([_batch(out)])

    return work


def _nodes(level: int) -> Callable:
    """Merged rows -> a row per node: id, prefix, last, n, lang, word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                before, last = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                n = np.frombuffer(batch.column(4)[i].as_buffer(), np.int64)
                ids = before if level == 1 else joined(before, last)
                none = pa.nulls(len(n), pa.string())
                texts = [batch.column(c)[i].values if level == 1 else none for c in (5, 6)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (ids, before, last if level > 1 else ids, n)], *texts], ["id", "prefix", "last", "n", "lang", "word"])

    return work


def _link_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """..., link of the prefix, last -> the same with the node's link in its place."""
    for batch in batches:
        link, last = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("up_link", "last"))
        columns = [pa.array(joined(link, last).view(np.int64)) if f == "up_link" else batch.column(k) for k, f in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def trie(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of levels 1 to longest, words of each language); only phrases with at least ``least`` occurrences are nodes."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    nodes = []
    with Shelf(spark) as shelf:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(1, -(-size // RANGE))
        # One table holds the shards and what they send of level 1, so that both come from the same cut.
        both = shelf.keep(rows.mapInArrow(_shards_and_words(parts), f"{_SHARDS}, sent array<struct<part:int,a:binary,n:binary,langs:array<string>,words:array<string>>>"), maxRecordsPerFile=FILE)
        shards = both.select("shard", "low", "high", "last", "hashes")
        totals = stored(both.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("total")))
        sent = both.select("shard", F.explode("sent").alias("s")).select("shard", "s.part", "s.a", F.lit(b"").alias("b"), "s.n", "s.langs", "s.words")
        told, before = None, []
        for level in range(1, longest + 1):
            with cleaning(spark):
                if told is not None:
                    sent = shelf.keep(shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_later_level(level, parts), _SENT))
                # The tables of the level before have been read.
                shelf.drop(*before)
                merged = shelf.keep(sent.filter("part >= 0").groupBy("part").applyInArrow(_merge(level, least), _SENT))
            nodes.append(stored(merged.filter("shard = -1").mapInArrow(_nodes(level), "id long, prefix long, last long, n long, lang string, word string")))
            told, before = merged.filter("shard >= 0").select("shard", "part", "a"), [merged]
            if level > 1:
                told, before = told.union(sent.filter("part = -1").select("shard", "part", "a")), [merged, sent]
    return nodes, totals


def walked(nodes: list[DataFrame]) -> list[DataFrame]:
    """The levels with lang, phrase, n, link, lefts (counts of the prefixes from one word on) and rights (those of the suffixes, longest first).

    A node's prefix is on the level before, and so is its link: the child, by the same last word, of its prefix's link.
    """
    none = F.array().cast("array<bigint>")
    levels = [nodes[0].select("id", "n", "lang", F.lit(None).cast("long").alias("prefix"), F.col("id").alias("link"), F.col("word").alias("phrase"), F.col("word").alias("first"), none.alias("lefts"), none.alias("rights"))]
    for k, level in enumerate(nodes[1:], 2):
        up = levels[-1]
        prefix = up.select(F.col("id").alias("prefix"), "lang", "first", F.col("link").alias("up_link"), F.concat("lefts", F.array("n")).alias("lefts"), F.col("n").alias("n_prefix"))
        rows = level.select("id", "prefix", "last", "n").join(prefix, "prefix")
        if k == 2:
            rows = rows.withColumn("up_link", F.col("last"))
        else:
            rows = rows.mapInArrow(_link_ids, rows.schema)
        link = up.select(F.col("id").alias("up_link"), F.col("phrase").alias("rest"), F.concat(F.array("n"), "rights").alias("rights"), F.col("n").alias("n_link"))
        rows = rows.join(link, "up_link")
        levels.append(stored(rows.select("id", "n", "lang", "prefix", F.col("up_link").alias("link"), F.concat_ws(" ", "first", "rest").alias("phrase"), "first", "lefts", "rights", "n_prefix", "n_link")))
    return levels


def candidates(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """All candidates that no longer one holds as often: lang, phrase, a, l, r, n, score."""
    nodes, totals = trie(docs, longest, least)
    levels = walked(nodes)
    out = []
    for k in range(2, longest + 1):
        level = levels[k - 1]
        if k < longest:
            above = levels[k]
            # What a longer candidate holds as often, one word less holds as often too, so one level is enough.
            held = above.filter("n = n_prefix").select(F.col("prefix").alias("id")).union(above.filter("n = n_link").select(F.col("link").alias("id")))
            level = level.join(held.distinct(), "id", "left_anti")
        out.append(level.select("lang", "phrase", F.col("n").alias("a"), "lefts", "rights"))
    return scores(reduce(DataFrame.union, out).join(totals, "lang"))


def scores(rows: DataFrame) -> DataFrame:
    """lang, phrase, a, lefts, rights, total -> the lowest-scoring cut's l, r and score; the arithmetic is that of 38-digit integers."""
    whole = lambda c: F.col(c).cast("decimal(17,0)")
    rows = rows.withColumn("top", (whole("a") * whole("total") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"))
    product = "cast(cast(x.lefts as decimal(17,0)) * cast(x.rights as decimal(17,0)) as decimal(38,0))"
    cuts = F.expr(f"transform(arrays_zip(lefts, rights), (x, i) -> struct(top div {product} as score, i as k, x.lefts as l, x.rights as r))")
    rows = rows.withColumn("cut", F.array_min(cuts))
    return rows.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language ``und``; repeated rows count as often as they stand there; an empty table
    gives an empty result, and other columns are ignored.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = candidates(docs, longest, least)
    # The first ones of a language are among the first ones of its groups.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("k") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
