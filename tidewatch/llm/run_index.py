"""A run-length compressed Burrows-Wheeler index with sampled run ends, over a collection of byte strings.

The strings are joined by terminators and sorted by prefix doubling. What is kept of the transform is one
entry per run of equal symbols: its first row, its symbol, how many equal symbols stand before it (for the
last-to-first step) and the text positions at its first and last row. For a window length, the rows whose
suffixes share that many bytes form intervals; each keeps its smallest owner.

``statistics`` streams any patterns through the index from right to left, in step, and gives their matching statistics: for every place the length
of the longest match that starts there (up to the window), a row of it and, by the samples, a text position. While the run
at hand has the wanted symbol, a last-to-first step leads on; else the match goes over to the nearer end of the nearest runs that have
it, whose text positions the samples tell, and keeps as many bytes as the texts there agree on. ``count`` is a backward search.
"""

from __future__ import annotations

import numpy as np


class Marks:
    """Marked rows: which mark is the last one up to a row, by counts of the marks before each 64 rows."""

    def __init__(self, marked: np.ndarray):
        bits = np.packbits(marked, bitorder="little")
        self.words = np.zeros(-(-len(marked) // 64) + 1, np.uint64)
        self.words.view(np.uint8)[: len(bits)] = bits
        self.before = (np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)).astype(np.int64)

    def last(self, rows: np.ndarray) -> np.ndarray:
        word = rows >> 6
        up_to = self.words[word] << (np.uint64(63) - (rows & 63).astype(np.uint64))
        return self.before[word] + np.bitwise_count(up_to) - 1


class RunIndex:
    def __init__(self, strings: list[bytes], owners: np.ndarray, window: int):
        """owners: a number per string; an interval keeps the smallest of the strings that its rows start in."""
        self.window, self.n = window, 0
        if not strings:
            self.run_start = self.sample_first = self.sample_last = np.zeros(0, np.int64)
            return
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.owners = np.asarray(owners, np.int64)
        text = np.zeros(int(self.lengths.sum()) + len(strings), np.uint16)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)[: len(text)]
        text[:] = joined
        text += 1
        ends = self.starts + self.lengths
        text[ends] = 0
        self.text = np.concatenate([text, text[: window + 1] if len(text) > window else np.resize(text, window + 1)])
        order, rank = suffix_order(text)
        n = len(text)
        before = text[order - 1]  # the text is a circle: the last terminator stands before the first string
        first = np.concatenate([[True], before[1:] != before[:-1]])
        self.run_start, self.run_of = np.flatnonzero(first), Marks(first)
        self.run_symbol = before[self.run_start].astype(np.int64)
        run_end = np.append(self.run_start[1:], n) - 1
        self.sample_first, self.sample_last = order[self.run_start], order[run_end]
        size = np.bincount(text, minlength=257)
        self.below = np.concatenate([[0], np.cumsum(size)])  # symbols smaller than each
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        length = (run_end - self.run_start + 1)[by_symbol]
        total = np.cumsum(length) - length
        self.symbol_first = np.searchsorted(self.run_symbol[by_symbol], np.arange(258))
        base = total[np.minimum(self.symbol_first[:-1], max(0, len(total) - 1))] if len(total) else np.zeros(257, np.int64)
        self.by_symbol = by_symbol
        self.symbol_run = self.run_symbol[by_symbol] * (len(self.run_start) + 1) + by_symbol  # runs by symbol, then row
        self.run_end = run_end
        self.seen_by_symbol = total - base[self.run_symbol[by_symbol]]
        self.seen = np.empty_like(total)
        self.seen[by_symbol] = self.seen_by_symbol
        self.n = n
        self.end_row = rank[ends]
        # intervals at the window length; suffixes too short stand alone
        owner = np.repeat(np.arange(len(strings)), self.lengths + 1)[order]
        left = ends[owner] - order
        same = shared_prefix(text, order, window)
        long = left >= window
        cut = np.concatenate([[True], ~(same & long[1:] & long[:-1])])
        self.interval = Marks(cut)
        self.least = np.minimum.reduceat(self.owners[owner], np.flatnonzero(cut))

    def runs(self) -> int:
        return len(self.run_start)

    def least_owner(self, rows: np.ndarray) -> np.ndarray:
        """The smallest owner of a string that holds the window at each row."""
        return self.least[self.interval.last(rows)]

    def statistics(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every place of every pattern, one pattern after the other: length of the longest match up to the window, a row and a text position of it; and where each pattern begins."""
        size = np.array([len(s) for s in patterns], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        asked = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        length, rows, places = (np.zeros(len(asked), np.int64) for _ in range(3))
        if not self.n or not len(asked):
            return length, rows, places, begin
        order = np.argsort(-size, kind="stable")  # the longest first: those that are done are a tail
        size, first = size[order], begin[:-1][order]
        many = len(size)
        row, place, known = np.zeros(many, np.int64), np.full(many, self.sample_first[0]), np.zeros(many, np.int64)
        runs = len(self.run_start)
        for back in range(int(size[0])):
            live = int(np.searchsorted(-size, -back, side="left"))  # sizes over back
            at = first[:live] + size[:live] - 1 - back
            c = asked[at]
            run = self.run_of.last(row[:live])
            turn = np.flatnonzero(self.run_symbol[run] != c)
            if len(turn):
                row[turn], place[turn], known[turn], run[turn] = self.turned(c[turn], run[turn], row[turn], place[turn], known[turn], runs)
                lost = turn[self.run_symbol[run[turn]] != c[turn]]  # nowhere in the text
            else:
                lost = turn
            row[:live] = self.below[c] + self.seen[run] + row[:live] - self.run_start[run]
            place[:live] = (place[:live] - 1) % self.n
            known[:live] = np.minimum(known[:live] + 1, self.window)
            row[lost], place[lost], known[lost] = 0, self.sample_first[0], 0
            length[at], rows[at], places[at] = known[:live], row[:live], place[:live]
        return length, rows, places, begin

    def turned(self, c: np.ndarray, run: np.ndarray, row: np.ndarray, place: np.ndarray, known: np.ndarray, runs: int) -> tuple[np.ndarray, ...]:
        """Matches whose run has another symbol, at the end of the run before or behind that has c and agrees on more bytes: row, text position, length, run."""
        k = np.searchsorted(self.symbol_run, c * (runs + 1) + run)
        found = []
        for side, samples, ends in ((k - 1, self.sample_last, self.run_end), (k, self.sample_first, self.run_start)):
            near = self.by_symbol[np.clip(side, 0, runs - 1)]
            there = samples[near]
            found.append((np.where((side >= 0) & (side < runs) & (self.run_symbol[near] == c), self.common(place, there, known), -1), near, there, ends[near]))
        (up, a, pa, ra), (down, b, pb, rb) = found
        first = up >= down
        best = np.maximum(up, down)
        ok = best >= 0
        pick = lambda x, y, z: np.where(ok, np.where(first, x, y), z)
        return pick(ra, rb, row), pick(pa, pb, place), np.maximum(best, 0), pick(a, b, run)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes, up to most, the texts at a and at b agree on."""
        out = np.zeros(len(a), np.int64)
        views = np.lib.stride_tricks.sliding_window_view(self.text, self.window)
        for k in range(0, len(a), 65536):
            part = slice(k, k + 65536)
            differ = views[a[part]] != views[b[part]]
            out[part] = np.where(differ.any(1), differ.argmax(1), self.window)
        return np.minimum(out, most)

    def earliest(self, patterns: list[bytes], none: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of each pattern the smallest owner of a string that holds it, ``none`` if no string does; and where each pattern begins."""
        length, rows, _, begin = self.statistics(patterns)
        size = np.diff(begin)
        windows = np.maximum(size - self.window + 1, 0)
        start = np.concatenate([[0], np.cumsum(windows)]).astype(np.int64)
        at = np.arange(start[-1]) + np.repeat(begin[:-1] - start[:-1], windows)
        return np.where(length[at] >= self.window, self.least_owner(rows[at]) if self.n else none, none), start

    def rank(self, symbol: int, rows: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each row."""
        own = self.by_symbol[self.symbol_first[symbol] : self.symbol_first[symbol + 1]]
        if not len(own):
            return np.zeros(len(rows), np.int64)
        k = np.searchsorted(self.run_start[own], rows, side="left") - 1
        run = own[np.maximum(k, 0)]
        stop = np.append(self.run_start, self.n)[run + 1]
        return np.where(k < 0, 0, self.seen[run] + np.minimum(rows, stop) - self.run_start[run])

    def count(self, pattern: bytes) -> int:
        """Occurrences of a pattern."""
        low, high = np.array([0]), np.array([self.n])
        for c in reversed(pattern):
            low, high = self.below[c + 1] + self.rank(c + 1, low), self.below[c + 1] + self.rank(c + 1, high)
        return int(max(0, (high - low)[0]))


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of a circular text's rotations from each position, by prefix doubling."""
    n = len(text)
    width = 7
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << 9) | np.roll(text, -k).astype(np.int64)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1 or width >= n:
            break
        key = rank * (n + 1) + np.roll(rank, -width)
        width *= 2
    rank[order] = np.arange(n)
    return order, rank


def shared_prefix(text: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Whether each row's first ``window`` symbols equal those of the row before (the text read as a circle)."""
    n = len(text)
    if n < 2:
        return np.zeros(max(0, n - 1), bool)
    same = np.ones(n - 1, bool)
    block = np.zeros(n, np.uint64)  # seven symbols at a time, the last block overlapping
    for k in range(7):
        block = (block << np.uint64(9)) | np.roll(text, -k).astype(np.uint64)
    starts = list(range(0, max(1, window - 6), 7))
    if window >= 7 and starts[-1] != window - 7:
        starts.append(window - 7)
    if window < 7:
        block = block >> np.uint64(9 * (7 - window))
        starts = [0]
    for s in starts:
        v = block[(order + s) % n]
        same &= v[1:] == v[:-1]
    return same
