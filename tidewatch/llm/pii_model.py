"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Gates are piecewise linear (``(z + 2) / 4`` and ``z``, clipped), which the training's gradients follow exactly.
Training minimises the CRF's negative log likelihood of labelled spans by back-propagation through time
(Adam). Decoding reads whole texts in overlapping windows of ``WINDOW`` characters. A window whose best tag path is all outside
needs no more, which an upper bound on paths tells of most and the exact best path of the rest; the others get marginals from the CRF's forward-backward
pass. A character's marginals are the mean over its windows weighted by the distance to the
nearer window edge, and a Viterbi pass over each stretch of characters that aren't clearly outside picks the tags.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k continues it
SYMBOLS = 130  # ASCII, 128 any other letter, 129 anything else
EMBED, HIDDEN = 8, 10
WINDOW, STRIDE = 256, 208
#: Windows worked on at once.
AT_ONCE = 1024
#: Windows whose best path and marginals are worked out at once, and the score within which the bound on paths leaves a window to the exact one.
ASKED, NEAR = 256, 0.01
#: Characters with this share of the outside tag are outside, but for two at the edges of others.
CLEAR = 0.98
NEVER = -1e4
_SYMBOL = np.arange(129, dtype=np.uint8)
_SYMBOL[65:91] += 32


def encode(text: str) -> np.ndarray:
    """Symbols of a text; upper case in A-Z reads as lower case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.minimum(points, 128)]


def allowed() -> np.ndarray:
    """Transition mask: a continuation follows only its own kind."""
    mask = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        for before in range(TAGS):
            if before not in (1 + 2 * k, 2 + 2 * k):
                mask[before, 2 + 2 * k] = NEVER
    return mask


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * z + 0.5, 0, 1)


def linear(z: np.ndarray) -> np.ndarray:
    return np.clip(z, -1, 1)


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


_MAY_START = ((np.arange(TAGS) % 2 == 1) | (np.arange(TAGS) == 0)).astype(float)
#: Folds the gates' slope and offset into weights and biases.
_SCALE = np.repeat([0.25, 0.25, 0.25, 1.0], HIDDEN).astype(np.float32)[:, None]
_SHIFT = np.repeat([0.5, 0.5, 0.5, 0.0], HIDDEN).astype(np.float32)[:, None]


class Tagger:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        width = EMBED + HIDDEN
        self.p = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        for side in "fb":
            self.p["w" + side] = rng.normal(0, width**-0.5, (width, 4 * HIDDEN))
            self.p["b" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.mask = allowed()

    # one direction of the LSTM; x: (time, batch, EMBED)
    def _run(self, side: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        w, b = self.p["w" + side], self.p["b" + side]
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        into = x @ w[:EMBED] + b
        out, kept = np.zeros((steps, n, HIDDEN)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = into[t] + h @ w[EMBED:]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = linear(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = linear(c)
            if keep:
                kept.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out, kept

    def _back(self, side: str, x: np.ndarray, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        w = self.p["w" + side]
        d_h, d_c, d_x = np.zeros_like(d_out[0]), np.zeros_like(d_out[0]), np.zeros_like(x)
        for t, h, before, i, f, o, g, tc in reversed(kept):
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (np.abs(tc) < 1)
            inside = lambda x: 0.25 * ((x > 0) & (x < 1))
            d_z = np.concatenate([d_c * g * inside(i), d_c * before * inside(f), d_h * tc * inside(o), d_c * i * (np.abs(g) < 1)], axis=1)
            grads["w" + side] += np.concatenate([x[t], h], axis=1).T @ d_z
            grads["b" + side] += d_z.sum(0)
            back = d_z @ w.T
            d_x[t], d_h, d_c = back[:, :EMBED], back[:, EMBED:], d_c * f
        return d_x

    def emissions(self, codes: np.ndarray, valid: np.ndarray, relative: bool = False) -> np.ndarray:
        """(time, batch) symbols to (time, TAGS, batch) scores, in single precision with the batch innermost; relative: less the outside tag's. valid: a prefix of each column.

        A place's rows are the state before it, its character, a one for the biases and the state behind it, so each direction reads one block and writes into
        the next place's; a step of both is taken at a time."""
        steps, n = codes.shape
        embed = np.ascontiguousarray(self.p["embed"].T, np.float32)
        ahead, char, behind = slice(0, HIDDEN), slice(HIDDEN, HIDDEN + EMBED), slice(HIDDEN + EMBED + 1, None)
        rows = np.zeros((steps + 2, 2 * HIDDEN + EMBED + 1, n), np.float32)  # place t is rows[t + 1]
        rows[:, HIDDEN + EMBED] = 1
        for t in range(steps):
            np.take(embed, codes[t], axis=1, out=rows[t + 1, char], mode="clip")
        weights = []
        for side in "fb":
            w, b = self.p["w" + side].T * _SCALE, self.p["b" + side][:, None] * _SCALE + _SHIFT
            parts = [w[:, EMBED:], w[:, :EMBED], b] if side == "f" else [w[:, :EMBED], b, w[:, EMBED:]]
            weights.append(np.ascontiguousarray(np.concatenate(parts, axis=1), np.float32))
        z, c, u = np.empty((2, 4 * HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32), np.empty((2, HIDDEN, n), np.float32)
        i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        gates, full = z[:, : 3 * HIDDEN], valid.all(axis=1).tolist()
        for t in range(steps):
            r = steps - 1 - t
            np.matmul(weights[0], rows[t + 1, : behind.start], out=z[0])
            np.matmul(weights[1], rows[r + 1, HIDDEN:], out=z[1])
            gates.clip(0, 1, out=gates)
            g.clip(-1, 1, out=g)
            c *= f
            np.multiply(i, g, out=u)
            c += u
            c.clip(-1, 1, out=u)
            np.multiply(u[0], o[0], out=rows[t + 2, ahead])
            h = np.multiply(u[1], o[1], out=rows[r, behind])
            if not full[r]:  # what lies behind the end has not been read
                h *= valid[r]
                c[1] *= valid[r]
        out, bias = self.p["out"].T, self.p["bias"][:, None]
        if relative:
            out, bias = out - out[:1], bias - bias[:1]
        out_f, out_b = np.ascontiguousarray(out[:, :HIDDEN], np.float32), np.concatenate([bias, out[:, HIDDEN:]], axis=1).astype(np.float32)
        scores = np.empty((steps, TAGS, n), np.float32)
        for t in range(0, steps, 32):  # in pieces, as the second summand takes room
            now = scores[t : t + 32]
            np.matmul(out_f, rows[t + 2 : t + 2 + len(now), ahead], out=now)
            now += np.matmul(out_b, rows[t : t + len(now), HIDDEN + EMBED :])
        return scores

    def quiet(self, emit: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Windows that are ``silent`` even if each move between tags that aren't outside scores as the best into its end, from ``relative`` scores; rounding is allowed for."""
        move = self.p["move"] - self.p["move"][0, 0]
        begun, on, tag = slice(1, TAGS, 2), slice(2, TAGS, 2), np.arange(1, TAGS)
        column = lambda x: x.astype(np.float32)[:, None]
        enter, again = column(move[0, begun]), column(move[1:, begun].max(axis=0))
        stay, go, leave = column(move[tag[::2], tag[1::2]]), column(move[tag[1::2], tag[1::2]]), np.float32(move[1:, 0].max() + NEAR)
        full, n = valid.all(axis=1).tolist(), emit.shape[2]
        first, later, u, v = emit[0, begun].copy(), np.full((len(KINDS), n), NEVER, np.float32), *np.empty((2, len(KINDS), n), np.float32)
        out, most = np.zeros(n, np.float32), np.empty(n, np.float32)
        for t in range(1, len(emit)):
            was = None if full[t] else (first.copy(), later.copy(), out.copy())
            np.maximum(first, later, out=u)
            u.max(axis=0, out=most)
            np.add(first, stay, out=v)
            later += go
            np.maximum(v, later, out=later)
            later += emit[t, on]
            np.add(out, enter, out=first)
            np.add(most, again, out=v)
            np.maximum(first, v, out=first)
            first += emit[t, begun]
            most += leave
            np.maximum(out, most, out=out)
            if was:
                for now, before in zip((first, later, out), was, strict=True):
                    np.copyto(now, before, where=~valid[t])
        return (out <= 0) & (np.maximum(first, later).max(axis=0) <= -NEAR)

    def silent(self, emit: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Which windows have the path of outside tags only as their best one; scores are taken relative to that path."""
        move = (self.p["move"] - self.p["move"][0, 0]).astype(np.float32)[:, :, None]
        free, begun, on = [0, *range(1, TAGS, 2)], slice(1, TAGS, 2), slice(2, TAGS, 2)
        enter, stay, go = move[:, free], move[range(1, TAGS, 2), range(2, TAGS, 2)], move[range(2, TAGS, 2), range(2, TAGS, 2)]
        full, through = valid.all(axis=1).tolist(), np.empty((TAGS, len(free), emit.shape[2]), np.float32)
        best = np.full(emit.shape[1:], NEVER, np.float32)
        best[0] = 0
        best[begun] = emit[0, begun] - emit[0, 0]
        for t in range(1, len(emit)):
            ahead = emit[t] - emit[t, 0]
            new = np.empty_like(best)
            new[on] = np.maximum(best[begun] + stay, best[on] + go)
            np.add(best[:, None], enter, out=through)
            new[free] = through.max(axis=0)
            new += ahead
            best = new if full[t] else np.where(valid[t], new, best)
        return best.max(axis=0) <= 0

    def forward_backward(self, emit: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log alpha, log beta, log partition and the marginals; valid: (time, batch), a prefix of each column."""
        steps, n, _ = emit.shape
        move = self.p["move"] + self.mask
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        start = np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) == 0, 0.0, NEVER), 0.0)
        alpha[0] = emit[0] + start
        for t in range(1, steps):
            step = lse(alpha[t - 1][:, :, None] + move[None], 1) + emit[t]
            alpha[t] = np.where(valid[t][:, None], step, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            step = lse(move[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(valid[t + 1][:, None], step, 0.0)
        total = lse(alpha[-1], 1)
        return alpha, beta, total, np.exp(np.minimum(alpha + beta - total[None, :, None], 0.0)) * valid[:, :, None]

    def step_grads(self, codes: np.ndarray, tags: np.ndarray, valid: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of a batch, and its gradients."""
        p = self.p
        x = p["embed"][codes]
        (hf, kf), (hb, kb) = self._run("f", x, True), self._run("b", x, True)
        both = np.concatenate([hf, hb], axis=2)
        emit = both @ p["out"] + p["bias"]
        alpha, beta, total, marginal = self.forward_backward(emit, valid)
        steps, n = codes.shape
        hot = np.eye(TAGS)[tags] * valid[:, :, None]
        gold = (emit * hot).sum()
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        move = p["move"] + self.mask
        for t in range(1, steps):
            live = valid[t]
            gold += p["move"][tags[t - 1][live], tags[t][live]].sum()
            pair = np.exp(np.minimum(alpha[t - 1][:, :, None] + move[None] + (emit[t] + beta[t])[:, None, :] - total[:, None, None], 0.0))
            grads["move"] += pair[live].sum(0)
            np.add.at(grads["move"], (tags[t - 1][live], tags[t][live]), -1.0)
        d_emit = marginal - hot
        grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS)
        grads["bias"] = d_emit.sum((0, 1))
        d_both = d_emit @ p["out"].T
        d_x = self._back("f", x, kf, d_both[:, :, :HIDDEN], grads) + self._back("b", x, kb, d_both[:, :, HIDDEN:], grads)
        np.add.at(grads["embed"], codes.ravel(), d_x.reshape(-1, EMBED))
        return (total.sum() - gold) / n, {k: g / n for k, g in grads.items()}

    def fit(self, samples: list[tuple[str, list[tuple[int, int, int]]]], steps: int, batch: int = 48, rate: float = 1e-2, seed: int = 1) -> list[float]:
        """samples: text and its spans (kind, start, end); returns the losses."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for n in range(1, steps + 1):
            loss, grads = self.step_grads(*pad([samples[i] for i in rng.integers(0, len(samples), batch)]))
            losses.append(loss)
            size = max(1.0, np.sqrt(sum((g * g).sum() for g in grads.values())) / 5)
            for k, g in grads.items():
                g = g / size
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.001 * (g * g - v2[k])
                self.p[k] -= rate * (1 - 0.9 * n / steps) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v2[k] / (1 - 0.999**n)) + 1e-8)
        return losses

    def marginals(self, emit: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """What ``forward_backward`` gives, for (time, TAGS, batch) scores and in that shape, with numbers scaled at each step instead of logarithms."""
        steps, _, n = emit.shape
        move = np.exp(self.p["move"] + self.mask)
        ahead = np.exp((emit - emit.max(axis=1, keepdims=True)).astype(np.float64))
        back = np.ones((steps, TAGS, n))
        for t in range(steps - 2, -1, -1):
            b = move @ (ahead[t + 1] * back[t + 1])
            back[t] = np.where(valid[t + 1], b / b.sum(axis=0), 1.0)
        out, now = np.zeros((steps, TAGS, n)), np.zeros((TAGS, n))
        for t in range(steps):
            now = ahead[t] * (move.T @ now if t else _MAY_START[:, None])
            now /= now.sum(axis=0)
            both = now * back[t]
            out[t] = both / both.sum(axis=0)
        return out * valid[:, None, :]

    def decode(self, texts: list[str]) -> Iterator[list[tuple[int, int, int, float]]]:
        """For each text, its spans (kind, start, end, mean marginal), from overlapping windows over the whole of it."""
        codes = [encode(t) for t in texts]
        cut = [(k, s, min(WINDOW, len(c) - s)) for k, c in enumerate(codes) for s in range(0, max(1, len(c) - (WINDOW - STRIDE)), STRIDE) if len(c)]
        cut.sort(key=lambda x: x[2])
        joined, start = np.concatenate([*codes, np.full(WINDOW, 129, np.uint8)]), np.cumsum([0, *map(len, codes)])
        loud: dict[int, dict[int, np.ndarray]] = {}
        asked: list[tuple[int, int, int, np.ndarray]] = []  # windows that the bound leaves open, with their scores
        for at in range(0, len(cut), AT_ONCE):
            part = cut[at : at + AT_ONCE]
            places, begin = np.arange(part[-1][2])[:, None], np.array([start[k] + s for k, s, _ in part])
            valid = places < np.array([n for _, _, n in part])
            emit = self.emissions(np.where(valid, joined[begin + places], np.uint8(129)), valid, relative=True)
            left = np.flatnonzero(~self.quiet(emit, valid))
            scores = emit[:, :, left]
            asked += [(*part[j], scores[: part[j][2], :, i]) for i, j in enumerate(left.tolist())]
        while asked:  # many windows together, whatever batch they come from
            part = asked[-ASKED:]
            del asked[-ASKED:]
            emit = np.zeros((max(n for _, _, n, _ in part), TAGS, len(part)), np.float32)
            for i, (_, _, n, scores) in enumerate(part):
                emit[:n, :, i] = scores
            valid = np.arange(len(emit))[:, None] < [n for _, _, n, _ in part]
            left = np.flatnonzero(~self.silent(emit, valid))
            marginal = self.marginals(emit[:, :, left], valid[:, left])
            for i, j in enumerate(left.tolist()):
                k, s, n, _ = part[j]
                loud.setdefault(k, {})[s] = marginal[:n, :, i].copy()
        held = {k: self.reconciled(windows, len(codes[k])) for k, windows in loud.items()}
        spans = iter(spans_of_all([share for found in held.values() for _, share in found], self.mask))
        tagged = {k: [(kind, x + at, y + at, sure) for at, _ in found for kind, x, y, sure in next(spans)] for k, found in held.items()}
        for k in range(len(codes)):
            yield tagged.get(k, [])

    def reconciled(self, loud: dict[int, np.ndarray], size: int) -> list[tuple[int, np.ndarray]]:
        """The stretches of a text of that size that aren't clearly outside: start and marginals, from its windows'; windows that aren't given are all outside."""
        found, starts = [], sorted(loud)
        while starts:
            run = [starts.pop(0)]
            while starts and starts[0] == run[-1] + STRIDE:
                run.append(starts.pop(0))
            begin, end = run[0], run[-1] + len(loud[run[-1]])
            share = np.full((end - begin, TAGS), 1e-9)
            for s in [run[0] - STRIDE, *run, run[-1] + STRIDE]:
                n = min(WINDOW, size - s)
                if s < 0 or n <= 0 or s >= end:
                    continue
                weight = 1.0 + np.minimum(np.arange(n), n - 1 - np.arange(n))
                a, b = max(s, begin), min(s + n, end)
                own = loud[s] if s in loud else np.eye(1, TAGS).repeat(n, 0)
                share[a - begin : b - begin] += (own * weight[:, None])[a - s : b - s]
            share /= share.sum(1, keepdims=True)
            inside = np.flatnonzero(share[:, 0] < CLEAR)
            for part in np.split(inside, np.flatnonzero(np.diff(inside) > 4) + 1) if len(inside) else []:
                first = max(0, int(part[0]) - 2)
                found.append((begin + first, share[first : int(part[-1]) + 3]))
        return found


def spans_of(share: np.ndarray, mask: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The best allowed tag path by the product of marginals, as spans."""
    return spans_of_all([share], mask)[0]


def spans_of_all(shares: list[np.ndarray], mask: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """``spans_of`` of many stretches, in step."""
    size = np.array([len(x) for x in shares], np.int64)
    order = np.argsort(-size, kind="stable")  # the longest first: those that are done are a tail
    longest, size = int(size.max(initial=0)), size[order]
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # sizes over each place
    begin, start = np.concatenate([[0], np.cumsum(live)]), np.cumsum(size) - size
    # rows by place and then stretch, without room for places past an end; ``at`` has a stretch's rows one after another
    at = begin[np.arange(size.sum()) - np.repeat(start, size)] + np.repeat(np.arange(len(shares)), size)
    score, tags = np.empty((len(at), TAGS)), np.empty(len(at), np.int8)
    if len(at):
        score[at] = np.log(np.concatenate([shares[i] for i in order.tolist()]) + 1e-12)
    live, begin = live.tolist(), begin.tolist()
    back: list[np.ndarray] = []
    best = score[: begin[1]] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), NEVER, 0.0) if longest else np.zeros((0, TAGS))
    for t in range(1, longest):
        through = best[: live[t], :, None] + mask
        back.append(through.argmax(1).astype(np.int8))
        best[: live[t]] = through.max(1) + score[begin[t] : begin[t + 1]]
    tag = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        tags[begin[t] : begin[t + 1]] = tag[: live[t]]
        if t:
            tag[: live[t]] = back[t - 1][np.arange(live[t]), tag[: live[t]]]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in shares]
    for i, first, n in zip(order.tolist(), start.tolist(), size.tolist(), strict=True):
        out[i] = spans_along(tags[at[first : first + n]].tolist(), shares[i])
    return out


def spans_along(tags: list[int], share: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The spans of a tag path, each with its mean marginal."""
    found, t = [], 0
    while t < len(tags):
        if tags[t] % 2:
            end = t + 1
            while end < len(tags) and tags[end] == tags[t] + 1:
                end += 1
            found.append((tags[t] // 2, t, end, float(share[np.arange(t, end), tags[t:end]].mean())))
            t = end
        else:
            t += 1
    return found


def pad(samples: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(t) for t, _ in samples)
    codes, tags, valid = np.full((longest, len(samples)), 129), np.zeros((longest, len(samples)), np.int64), np.zeros((longest, len(samples)), bool)
    for j, (text, spans) in enumerate(samples):
        codes[: len(text), j], valid[: len(text), j] = encode(text), True
        for kind, start, end in spans:
            tags[start, j], tags[start + 1 : end, j] = 1 + 2 * kind, 2 + 2 * kind
    return codes, tags, valid


def labelled_samples(n: int, seed: int = 5, length: int = 150) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled snippets by rule: words around personal data in written forms of many kinds, several in a row, and numbers and signs that are none."""
    rng = np.random.default_rng(seed)
    vowels, rest = [*"aeiou", "é", "ä", "ou", "ie", "ó"], [*"bcdfghklmnprstvwz", "th", "st", "ch", "ñ", "ll"]
    common = "the a to of and is on at in for or call write mail us me you your our new price order number version page by from until with und der die de la le et en que".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    upto = lambda a, b: int(rng.integers(a, b + 1))
    plain = lambda k: "".join(pick("bcdfghklmnprstvwz") + pick("aeiou") for _ in range(k))

    def word() -> str:
        w = pick(common) if rng.random() < 0.4 else "".join(pick(rest) + pick(vowels) for _ in range(upto(1, 4))) + pick(["", "n", "r", "s"])
        return pick([w, w, w, w.capitalize(), w.upper()])

    def email() -> str:
        name = pick([plain(upto(1, 4)), plain(1) + pick("._-+") + plain(upto(1, 3)), plain(2) + digits(upto(1, 4)), plain(1) + "." + digits(2)])
        host = ".".join([plain(upto(1, 3)) + pick(["", digits(1), "-net"]), *[plain(2)] * upto(0, 1), pick(["com", "org", "de", "net", "co.uk", "es", "fr"])])
        return name + pick(["@", "@", " @ ", " [at] ", "[at]", "(at)", " (at) "]) + host

    def ip() -> str:
        return ".".join(str(upto(0, 255)) for _ in range(4))

    def card() -> str:
        d = [int(x) for x in digits(15)]
        last = (10 - sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10) % 10
        s = "".join(map(str, d)) + str(last)
        gap = pick(["", "", " ", "-", ".", "/"])
        return gap.join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1.{a}.{b}.{c}", f"+{digits(11)}", f"0{a[:2]} {b} {c}", f"+{digits(2)}-{a}-{b}{c}"])

    def other() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(pick([8, 32, 40])))
        made = [f'token = "{hexes}"', hexes, f"{upto(0, 30)}.{upto(0, 30)}.{upto(0, 30)}", f"{upto(1990, 2030)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}"]
        made += [digits(upto(1, 13)), digits(2) + "%", "$" + digits(upto(2, 5)), f"{digits(3)},{digits(3)}", f"{digits(2)}:{digits(2)}", "@" + plain(2), f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(4)}-{digits(4)}", f"({digits(3)})", f"{digits(2)}-{digits(2)}", f"www.{plain(2)}.com", f"{plain(2)}.{pick(['py', 'com', 'org'])}", "[" + digits(2) + "]", f"+{digits(2)}", f"{plain(2)} at {plain(2)}.com", f"{digits(3)} {digits(3)}"]
        return pick(made)

    kinds = (email, ip, card, phone, other)
    marks = ["", "", "", "", "", ",", ".", ":", ";", "!!", "***", " |", "?", ")", "###"]
    samples = []
    for _ in range(n):
        text, spans, last = "", [], 0
        while len(text) < length and rng.random() < 0.93:
            if rng.random() < 0.55:
                text += " ".join(word() + pick(marks) for _ in range(upto(1, 5))) + pick([" ", " ", " ", "\n"])
                continue
            kind = last if rng.random() < 0.3 else int(rng.integers(5))
            item, before = kinds[kind](), pick(["", "", "", "", "(", "<", '"'])
            text += before
            if kind < 4:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + {"(": ")", "<": ">", '"': '"', "": ""}[before] + pick([" ", " ", " ", ". ", ", ", "\n", " or ", " and ", " / ", "; ", "!! ", "### ", " | "])
            last = kind
        text = (text + word())[: max([length, *[e for _, _, e in spans]])]
        samples.append((text, spans))
    return samples


@lru_cache(maxsize=2)
def trained(steps: int = 400, samples: int = 6000, seed: int = 0) -> Tagger:
    """The tagger that the operator uses; trained once per driver process."""
    tagger = Tagger(seed)
    tagger.fit(labelled_samples(samples), steps)
    return tagger
