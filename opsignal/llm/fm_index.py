"""A bidirectional FM-index over a delimited vocabulary, searched for many words at once."""

from __future__ import annotations

import numpy as np

DELIMITER = 0


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of all rotations of a cyclic text in sorted order, by doubling the length compared."""
    size, width = len(text), 1
    rank = text.astype(np.int64)
    while True:
        key = rank * (rank.max() + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        width *= 2
        if rank.max() == size - 1 or width >= 2 * size:
            return order


class Ranks:
    """Counts over the last column of the sorted rotations of one text."""

    def __init__(self, text: np.ndarray, letters: int):
        last = text[rotations(text) - 1]
        # less[i, c]: how many of the first i are smaller than c
        self.less = np.zeros((len(text) + 1, letters + 1), dtype=np.int32)
        np.cumsum(last[:, None] < np.arange(letters + 1), axis=0, dtype=np.int32, out=self.less[1:])
        self.first = self.less[-1]

    def extended(self, at, other, size, c):
        """The interval before which letter ``c`` is put: here, in the index of the turned text, and its size."""
        low, high = self.less[at, c], self.less[at + size, c]
        here = self.less[at, c + 1] - low
        return self.first[c] + here, other + high - low, self.less[at + size, c + 1] - high - here

    def children(self, at, other, size):
        """All non-empty extensions by a letter: (row, letter, here, other, size)."""
        low, high = self.less[at], self.less[at + size]
        here = low[:, 1:] - low[:, :-1]
        count = high[:, 1:] - high[:, :-1] - here
        count[:, DELIMITER] = 0
        row, c = np.nonzero(count)
        return row, c, self.first[c] + here[row, c], other[row] + (high - low)[row, c], count[row, c]


class Vocabulary:
    """Distinct words. Interval of a pattern: its place among the sorted rotations of the text
    ``|word|word|...``, its place among those of the text turned round, and its size."""

    def __init__(self, words: list[str], also: list[str] = ()):
        self.words = sorted(set(words))
        letters = np.unique(self._points(["".join(self.words), "".join(also)])[0])
        self.letters = letters
        points, starts = self._points(self.words)
        codes = np.searchsorted(letters, points) + 1
        text = np.insert(codes, starts[:-1], DELIMITER)
        count = len(letters) + 1
        self.before, self.after = Ranks(text, count), Ranks(text[::-1], count)

    @staticmethod
    def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all words in a row, and where each starts."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        return points, np.concatenate([[0], np.cumsum(lengths)])

    def one_error(self, queries: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``queries``, place in ``words``) of all words at distance one by the search that matches the
        left (right) half exactly and allows one error while it extends across the other half.

        The pattern starts at a delimiter and grows to the right (left): intervals of the text turned round are
        extended, and the place among the rotations of the text goes along. At the other delimiter that
        place is the rank of the word. The left half is the shorter one where the length is odd.
        """
        points, starts = self._points(queries)
        # the letters of the queries are among those of the index
        codes = np.searchsorted(self.letters, points) + 1
        length = np.diff(starts)
        half = length // 2 if left else length - length // 2
        ranks = self.after if left else self.before
        letter = (lambda q, i: codes[starts[q] + i]) if left else (lambda q, i: codes[starts[q + 1] - 1 - i])

        q = np.arange(len(queries))
        at = np.zeros(len(q), dtype=np.int64)
        other, size = at.copy(), np.full(len(q), len(self.words), dtype=np.int64)
        done = []
        for i in range(int(half.max(initial=0))):
            over = half[q] <= i
            done.append((q[over], at[over], other[over], size[over]))
            q, at, other, size = q[~over], at[~over], other[~over], size[~over]
            at, other, size = ranks.extended(at, other, size, letter(q, i))
            some = size > 0
            q, at, other, size = q[some], at[some], other[some], size[some]
        done.append((q, at, other, size))
        q, at, other, size = (np.concatenate(c) for c in zip(*done))

        # of edits with the same result only the last place counts: a letter is put in before another one, and
        # of equal letters in a row the last one is left out, so that every word is found once
        rest = length - half
        last = int(rest.max(initial=0))
        with_error = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        found = []
        for i in range(last + 1):
            own = self._letters_at(letter, q, half, rest, i)
            row, c, a, o, s = ranks.children(at, other, size)
            other_letter = c != own[row]
            inserted = tuple(x[other_letter] for x in (q[row], a, o, s))
            replaced = other_letter & (own[row] != DELIMITER)
            skip = (own != DELIMITER) & (own != self._letters_at(letter, q, half, rest, i + 1))
            moved = [(q[skip], at[skip], other[skip], size[skip]), tuple(x[replaced] for x in (q[row], a, o, s))]
            q, at, other, size = (x[~other_letter] for x in (q[row], a, o, s))

            w, a, o, s = (np.concatenate(p) for p in zip(with_error, inserted))
            ended = rest[w] == i
            found.append(self._ended(ranks, w[ended], a[ended], o[ended], s[ended], left))
            w, a, o, s = w[~ended], a[~ended], o[~ended], s[~ended]
            a, o, s = ranks.extended(a, o, s, letter(w, half[w] + i))
            some = s > 0
            with_error = tuple(np.concatenate(p) for p in zip((w[some], a[some], o[some], s[some]), *moved))
        pairs = [np.concatenate(p) for p in zip(*found)]
        return pairs[0], pairs[1]

    @staticmethod
    def _letters_at(letter, q, half, rest, i):
        """The next letter of each state's query, the delimiter where it has come to its end."""
        return np.where(rest[q] > i, letter(q, half[q] + np.minimum(i, np.maximum(rest[q] - 1, -1))), DELIMITER)

    def _ended(self, ranks: Ranks, w, at, other, size, left: bool):
        """Words whose pattern ends here: the query and the rank of the word."""
        at, other, size = ranks.extended(at, other, size, np.zeros(len(w), dtype=np.int64))
        some = size > 0
        return w[some], (other if left else at)[some]
