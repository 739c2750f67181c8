"""Double-array tries over sequences of 64-bit words, and numpy walks through them from all positions of a text at once.

A state's children lie at its base plus their symbol, and `check` names the state that owns a slot. Words of the trie's
own vocabulary are numbered; a number is written as two symbols below RADIX, so a state has at most RADIX children and
their slots are close together. Large families are laid one behind the other; of the others all of about one size are
placed at once: each tries a random base, those without a clash stay, and the arrays grow when too few find room.
"""

from __future__ import annotations

import numpy as np

RADIX = 2048
#: Families of more children are laid one behind the other.
LARGE = RADIX // 8
#: Vocabularies up to this size fit two symbols; symbol 0 stands for no word.
MOST_WORDS = RADIX * RADIX - 1


def _families(parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and size of each run of equal parents."""
    first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(parents) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(parents)))


class DoubleArray:
    """A trie of word sequences; `at` finds the state after one more word."""

    def __init__(self, vocabulary: np.ndarray, base: np.ndarray, check: np.ndarray):
        self.vocabulary, self.base, self.check = vocabulary, base, check

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words that the trie does not hold."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The child by one symbol, -1 where there is none."""
        to = self.base[states] + symbols
        return np.where(self.check[to] == states, to, -1)

    def at(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions that go on, their states) one word further; code 0 never goes on."""
        own = np.flatnonzero(codes > 0)
        for symbol in (codes // RADIX, codes % RADIX):
            reached = self.step(states[own], symbol[own])
            on = reached >= 0
            own = own[on]
            states = np.zeros_like(states)
            states[own] = reached[on]
        return own, states[own]

    def path(self, states: np.ndarray) -> np.ndarray:
        """(states, words): the words that lead to each state, first word first, 0 where a path is shorter."""
        found = []
        states = states.copy()
        while (states > 0).any():
            low = np.where(states > 0, states - self.base[self.check[states]], 0)
            middle = np.where(states > 0, self.check[states], 0)
            high = np.where(middle > 0, middle - self.base[self.check[middle]], 0)
            code = high * RADIX + low
            found.append(np.where(code > 0, self.vocabulary[np.maximum(code - 1, 0)] if len(self.vocabulary) else 0, 0))
            states = np.where(middle > 0, self.check[middle], 0)
        depth = len(found)
        out = np.zeros((len(states), depth), np.int64)
        for k, words in enumerate(found):  # last word first
            out[:, depth - 1 - k] = words
        short = np.argsort(out == 0, axis=1, kind="stable")  # words to the front, their order kept
        return np.take_along_axis(out, short, axis=1)


def build(phrases: np.ndarray, seed: int = 7) -> DoubleArray:
    """The trie of phrases (rows of words, 0 after the last word of a short one); every prefix is a state, too."""
    vocabulary = np.unique(phrases)
    vocabulary = vocabulary[vocabulary != 0]
    if len(vocabulary) > MOST_WORDS:
        raise ValueError("too many words for one trie")
    code = np.where(phrases != 0, np.searchsorted(vocabulary, phrases) + 1, 0)
    width = phrases.shape[1]
    # Nodes level by level: each is its parent's number and a symbol; the root is node 0.
    parents, symbols = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    node, total = np.zeros(len(phrases), np.int64), 1
    for k in range(width):
        own = np.flatnonzero(code[:, k])
        for symbol in (code[own, k] // RADIX, code[own, k] % RADIX):
            keys, index = np.unique(node[own] * RADIX + symbol, return_inverse=True)
            parents.append(keys // RADIX)
            symbols.append(keys % RADIX)
            node[own] = total + index
            total += len(keys)
    parent, symbol = np.concatenate(parents), np.concatenate(symbols)
    return DoubleArray(vocabulary, *_place(parent, symbol, np.random.default_rng(seed)))


def _place(parent: np.ndarray, symbol: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """base and check of the nodes (0: the root); nodes of one family stand together, ordered by symbol."""
    total = len(parent)
    slot = np.zeros(total, np.int64)
    chosen = np.zeros(total, np.int64)  # the base of each parent
    first, count = _families(parent[1:])
    first = first + 1
    tier = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    end = 1 + RADIX  # bases stay positive
    taken = [np.zeros(1, np.int64)]
    for k in np.flatnonzero(count > LARGE):
        own = slice(first[k], first[k] + count[k])
        base = end - symbol[first[k]]
        slot[own] = base + symbol[own]
        chosen[parent[first[k]]] = base
        taken.append(slot[own])
        end = int(slot[own][-1]) + 1
        tier[k] = -1
    size = end + 2 * int(count[tier >= 0].sum()) + RADIX
    used = np.zeros(size, bool)
    used[np.concatenate(taken)] = True
    for level in range(int(tier.max(initial=-1)), -1, -1):
        waiting = np.flatnonzero(tier == level)
        while len(waiting):
            n = count[waiting]
            family = np.repeat(np.arange(len(waiting)), n)
            child = np.repeat(first[waiting] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            base = rng.integers(1, size - RADIX, len(waiting))
            to = base[family] + symbol[child]
            clash = used[to]
            _, one = np.unique(to, return_index=True)
            alone = np.zeros(len(to), bool)
            alone[one] = True  # of families that want a slot, the first may have it
            bad = np.zeros(len(waiting), bool)
            bad[family[clash | ~alone]] = True
            good = ~bad[family]
            used[to[good]] = True
            slot[child[good]] = to[good]
            chosen[parent[first[waiting[~bad]]]] = base[~bad]
            if bad.mean() > 0.9:
                more = max(size // 4, RADIX)
                used, size = np.concatenate([used, np.zeros(more, bool)]), size + more
            waiting = waiting[bad]
    base, check = np.zeros(size + RADIX, np.int32), np.full(size + RADIX, -1, np.int32)
    base[slot] = chosen
    check[slot[1:]] = slot[parent[1:]]
    return base, check
