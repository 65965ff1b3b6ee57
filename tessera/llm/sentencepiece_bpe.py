"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Of a text's encodings, the one by merges has this property: for each prefix, its encoding ends with one
token only, and a sequence of tokens is an encoding just if each two neighbours are compatible, that is
if encoding the two tokens' text gives these two again.  So an automaton finds all tokens that end at a
place, the table keeps the one whose neighbour in the table before it is compatible, and the ids are
recovered backwards from the end.

Compatibility of tokens a and b follows from their merge trees.  Only symbols on the right edge of a and
on the left edge of b meet at the border.  Walking both edges up from the border characters, a merge
across the border comes first, and so parts them, if its score is above that of the next merge of the
left edge, and at least that of the right edge (of equal scores, the leftmost merge comes first).

Words are encoded independently where no piece crosses their border; each task keeps the words it has
met in a bounded store.  The vocabulary is read from the model file on the driver; its tables, of a
size that the file fixes, are sent with the tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.arrow_text import runs, text_bytes

SPACE = "▁"
#: Bytes of text that a task treats at a time; bytes of words, about, in each of the two generations that it keeps; longest word kept; pairs kept.
_RUN = 1 << 20
_STORE = 40 << 20
_LONG = 64
_PAIRS = 200_000


@dataclass
class Model:
    """What the encoder needs of a model file."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    end_id: int

    @staticmethod
    def load(path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        return Model([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [not x for x in special], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], sp.eos_id())


class Encoder:
    """Tables of a model, and the stores of words and pairs that a task has met."""

    def __init__(self, model: Model):
        self.model = model
        self.n = n = len(model.pieces)
        self.id_text = [str(i) for i in range(n)]
        ids = {p: i for i, (p, ok) in enumerate(zip(model.pieces, model.normal, strict=True)) if ok}
        # Characters that are no pieces get symbols of their own, behind the pieces.
        chars = sorted({c for p in ids for c in p} - set(ids))
        self.symbol = ids | {c: n + i for i, c in enumerate(chars)}
        self.known = {c for p in ids for c in p}
        self.score = [*model.scores, *[0.0] * len(chars)]
        joins = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    joins[a, b] = i
        self._edges(ids, joins)
        crossing = any(SPACE in p.lstrip(SPACE) for p in ids)
        alone = "".join(c for c in map(chr, range(32)) if c not in self.known)
        lone = re.escape(alone)
        self.words = re.compile(".+" if crossing else f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]+" if alone else ""), re.S)
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, i in ids.items():
            if self.whole[i]:
                self.automaton.add_word(p, i)
        for c, i in self.symbol.items():
            if i >= n:
                self.automaton.add_word(c, i)
        self.automaton.make_automaton()
        lengths = {i: len(p) for p, i in self.symbol.items()}
        self.length = [lengths.get(i, 0) for i in range(n + len(chars))]
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            if 0 <= i < n:
                self.bytes_of[i] = bytes([b])
        self.extra = {i: [model.byte_ids[x] for x in c.encode()] for c, i in self.symbol.items() if i >= n}
        self.forget()

    def forget(self) -> None:
        """Empty the stores: words to (their ids as text, their decoded bytes), and pairs to whether they are compatible."""
        self.store: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.pairs: dict[int, bool] = {}
        self.held = 0

    def _edges(self, ids: dict, joins: dict) -> None:
        """The merge tree of each piece: its last merge's parts, if merging its characters ends in it."""
        score, size = self.score, len(self.score)
        self.whole = [False] * size
        left, right = [-1] * size, [-1] * size
        for p, i in ids.items():
            s = [self.symbol[c] for c in p]
            while len(s) > 1:
                best = max(((score[j], -k, j) for k, pair in enumerate(zip(s, s[1:], strict=False)) if (j := joins.get(pair)) is not None), default=None)
                if best is None:
                    break
                k = -best[1]
                if len(s) == 2:
                    left[i], right[i] = s
                s[k : k + 2] = [best[2]]
            self.whole[i] = len(s) == 1
        for i in ids.values():
            for part in (left[i], right[i]) if self.whole[i] else ():
                if part >= 0 and left[part] >= 0 and score[part] < score[i]:
                    raise ValueError(f"{self.model.pieces[i]!r} has a part that is merged after it")
        self.size, none = size, float("-inf")
        self.across = {a * size + b: score[i] for (a, b), i in joins.items()}
        # By symbol: the symbols on its edge from the border character up to itself, and the scores of the merges between them, then -inf.
        self.right_edge, self.left_edge = [], []
        for edges, child in ((self.right_edge, right), (self.left_edge, left)):
            for t in range(size):
                chain = [t]
                while child[chain[-1]] >= 0:
                    chain.append(child[chain[-1]])
                chain.reverse()
                edges.append((chain, [*[score[x] for x in chain[1:]], none]))

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the texts of tokens a and b together gives a and b."""
        (up, up_score), (down, down_score) = self.right_edge[a], self.left_edge[b]
        i = j = 0
        while True:
            across, s_up, s_down = self.across.get(up[i] * self.size + down[j]), up_score[i], down_score[j]
            if across is not None and across > s_up and across >= s_down:
                return False
            if i + 1 == len(up) and j + 1 == len(down):
                return True
            if s_up >= s_down:
                i += 1
            else:
                j += 1

    def tokens(self, word: str) -> list[int]:
        """The ids of a word made of known characters, in one pass over its matches."""
        length, pairs, size, compatible = self.length, self.pairs, self.size, self.compatible
        last = [-1] * (len(word) + 1)
        for at, t in self.automaton.iter(word):
            at += 1
            if last[at] >= 0:
                continue
            start = at - length[t]
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before * size + t
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = compatible(before, t)
                if not ok:
                    continue
            last[at] = t
        if len(pairs) > _PAIRS:
            pairs.clear()
        out, at = [], len(word)
        while at:
            t = last[at]
            out.append(t)
            at -= length[t]
        out.reverse()
        return out

    def ids_of(self, word: str) -> list[int]:
        """The ids of a word; characters that no piece has become bytes."""
        if self.known.issuperset(word):
            ids = self.tokens(word)
        else:
            ids, run = [], []
            for c in [*word, ""]:
                if c and c in self.known:
                    run.append(c)
                    continue
                if run:
                    ids += self.tokens("".join(run))
                    run = []
                ids += [self.model.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return [x for t in ids for x in self.extra.get(t, (t,))] if self.extra else ids

    def word(self, word: str) -> tuple[str, bytes]:
        """A word's ids as text and its decoded bytes; short words are kept, and when the newer generation is full, the older one goes."""
        got = self.older.get(word)
        if got is None:
            ids = self.ids_of(word)
            got = " ".join(map(self.id_text.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
        if len(word) <= _LONG:
            if self.held > _STORE:
                self.store, self.older, self.held = {}, self.store, 0
            self.store[word] = got
            self.held += 300 + 2 * len(word) + len(got[0]) + len(got[1])
        return got

    def encoded(self, text: str) -> tuple[str, int, bytes]:
        """(ids as text, their number, decoded bytes), without an end."""
        find, word = self.store.get, self.word
        both = []
        for w in self.split(text):
            got = find(w)
            if got is None:
                got = word(w)
                find = self.store.get
            both.append(got)
        ids = " ".join([x for x, _ in both])
        return ids, ids.count(" ") + 1 if both else 0, b"".join([y for _, y in both])

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decoded(self, data: bytes) -> str:
        """The text of the pieces' bytes: without the space put before the first word; bytes that are no UTF-8 are replaced."""
        return data.decode("utf-8", "replace").removeprefix(" ")


_KEPT: list[Encoder] = []


def _encoder(model: Model) -> Encoder:
    """The encoder of a model; the last one stays in the Python worker for its next tasks, without what it has stored."""
    if not _KEPT or _KEPT[0].model != model:
        _KEPT[:] = [Encoder(model)]
    return _KEPT[0]


def encode_decode(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_text also ids and decoded.

    A null text counts as empty; an empty text has the end id only.  Repeated rows get equal results;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)
    end = str(model.end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(held.value)
        for batch in batches:
            column = batch.column(1)
            for i, j in runs(text_bytes(column)[1], _RUN):
                n, ids_hash, text_hash, all_ids, all_text = [], [], [], [], []
                for text in column.slice(i, j - i).to_pylist():
                    ids, count, decoded = coder.encoded(text or "")
                    ids, text = f"{ids} {end}" if count else end, coder.decoded(decoded)
                    n.append(count + 1)
                    ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_text:
                        all_ids.append([int(x) for x in ids.split(" ")])
                        all_text.append(text)
                out = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_text:
                    out, names = [*out, pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)
        coder.forget()

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(work, schema + ", ids array<int>, decoded string" * keep_text)


def vocabulary_path() -> str:
    """The installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def with_end(model: Model, text: str) -> list[int]:
    """Ids of one text, for tests."""
    return [int(x) for x in Encoder(model).encoded(text)[0].split()] + [model.end_id]
