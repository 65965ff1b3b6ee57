"""A weighted backoff automaton, built from counts and read left to right, in numpy.

States are histories: the root, one for each word, and one for each pair that has arcs of its own.  An arc leads from a
history by a word to the longest history that is then known, and carries the word's probability; a failure arc leads
from a history to its longest proper suffix and carries the history's free mass.  Reading a word where there is no arc
is following the failure arc and trying again; the root has arcs for all words.

Weights come from counts by interpolated absolute discounting with a prior: an arc has (c - D) / (C + PRIOR) plus the
history's free mass times the probability after the failure arc, so a history's probabilities sum to one.  The prior
keeps histories that were seen a few times, often in copies of one text, close to the shorter history.  An n-gram
that was seen no more than D times has no mass of its own, so it has no arc.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

DISCOUNT = 1.0
PRIOR = 100.0
#: Words that a lane reads; a text is cut into lanes, and each begins in the state that the one before it ends in.
LANE = 128
ROOT = 0


def find(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of key in sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, at, -1)


def own(count: np.ndarray, history: np.ndarray) -> np.ndarray:
    """An n-gram's own mass, from its count and its history's."""
    return np.maximum(count - DISCOUNT, 0) / (np.maximum(history, count) + PRIOR)


def free(taken: np.ndarray, history: np.ndarray) -> np.ndarray:
    """What a history leaves to the failure arc; taken: the sum of its arcs' discounted counts."""
    return np.maximum(1 - taken / (history + PRIOR), 1e-9)


@dataclass
class Automaton:
    """States 0 (root), 1 + word, then pairs; arcs are keyed by state and word."""

    #: Per state: where its failure arc leads, and the logarithm of its weight.
    fail: np.ndarray
    free: np.ndarray
    #: Per word: the logarithm of the root's arc.
    root: np.ndarray
    #: Arcs' keys, and per arc where it leads and its logarithm.
    arcs: pd.Index
    to: np.ndarray
    weight: np.ndarray
    #: Per pair: its state, or that of its last word.
    pair_state: np.ndarray

    @staticmethod
    def build(root: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray], taken: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Automaton:
        """From the n-grams that texts hold.

        root: words' probabilities without a history; counts: of words, pairs and triples in the training texts;
        taken: what the arcs of words and pairs take together; pairs: their first and last words; triples: their
        first pair, last word and last pair.
        """
        words, (first, last) = len(root), pairs
        is_state = taken[1] > 0
        state = np.where(is_state, 1 + words + np.cumsum(is_state) - 1, 1 + last)
        fail = np.concatenate([np.zeros(1 + words, np.int64), 1 + last[is_state]])
        left = np.concatenate([[1.0], free(taken[0], counts[0]), free(taken[1], counts[1])[is_state]])
        # Of pairs: the probability of the last word after the first, which triples fall back to.
        after_word = own(counts[1], counts[0][first]) + left[1 + first] * root[last]
        seen = counts[1] > DISCOUNT
        history, word, rest = triples
        some = counts[2] > DISCOUNT
        history, word, rest = history[some], word[some], rest[some]
        after_pair = own(counts[2][some], counts[1][history]) + left[state[history]] * after_word[rest]
        keys = np.concatenate([(1 + first[seen]) << 32 | last[seen], state[history] << 32 | word])
        with np.errstate(divide="ignore"):
            logs = [np.log10(x) for x in (left, root, np.concatenate([after_word[seen], after_pair]))]
        return Automaton(fail, logs[0], logs[1], pd.Index(keys), np.concatenate([state[seen], state[rest]]), logs[2], state)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, logarithm of the word's probability) of readers side by side."""
        to, log = np.empty_like(state), np.zeros(len(state))
        open_ = np.arange(len(state))
        while len(open_):
            s, w = state[open_], word[open_]
            at = self.arcs.get_indexer(s << 32 | w)
            # The root has no keyed arcs, but one for each word.
            done, ends = at >= 0, s == ROOT
            to[open_[done]] = self.to[at[done]]
            log[open_[done]] += self.weight[at[done]]
            to[open_[ends]] = 1 + w[ends]
            log[open_[ends]] += self.root[w[ends]]
            open_ = open_[~(done | ends)]
            log[open_] += self.free[state[open_]]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return to, log

    def read(self, x: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The logarithms of x's words, read from start to end by a reader each, from its state on; places outside have 0."""
        out, at = np.zeros(len(x)), start.copy()
        while len(at):
            state, out[at] = self.step(state, x[at])
            at = at + 1
            more = at < end
            at, end, state = at[more], end[more], state[more]
        return out
