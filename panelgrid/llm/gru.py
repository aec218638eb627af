"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Documents are laid one after the other into lanes; all lanes step together. The state of a lane
is carried from window to window and cleared where a document begins, so the likelihood of a document is
that of its whole text. Gradients stop at the window's edge.

A symbol may stand for many rare words (``Rare``). Such a word adds rows of its own to its symbol's input vector, and
below its symbol it is found by a path of binary decisions, each with a bias and the vector of its node.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from panelgrid.llm.text import take_ranges

HIDDEN = 16
CLASSES = 32
LANES = 512
WINDOW = 16
WINDOW_TOKENS = 4096
RATE = 0.01
CLIP = 1.0
UPDATE_TOKENS = 4096
PIECE = 16  # rows of one sum that are added at once
SPAN = 60.0  # of logits: their exponentials are far from underflow


def make_classes(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class edges over symbols in descending order of ``counts``: about equal sums of square roots."""
    share = np.cumsum(np.sqrt(counts + 1.0))
    cut = np.searchsorted(share, share[-1] * np.arange(1, classes) / classes)
    return np.unique(np.concatenate([[0], np.minimum(cut, len(counts) - 1), [len(counts)]]))


@dataclass
class Rare:
    """Rare words: ``parts[w]`` are further rows of ``x``; the decisions of ``w`` are ``first[w]:first[w + 1]``, each with its
    node, the side taken (1 or -1) and the side's log odds where the state says nothing."""

    parts: np.ndarray
    first: np.ndarray
    node: np.ndarray
    side: np.ndarray
    bias: np.ndarray


def initial(
    counts: np.ndarray, edges: np.ndarray, hidden: int = HIDDEN, seed: int = 0, parts: int = 0, nodes: int = 0
) -> dict[str, np.ndarray]:
    """Parameters that start as the unigram model of ``counts``; with ``parts`` rows and ``nodes`` for rare words."""
    draw = np.random.default_rng(seed)
    normal = lambda scale, *shape: draw.normal(0, scale, shape).astype(np.float32)
    p = (counts + 0.5) / (counts + 0.5).sum()
    of_class = np.add.reduceat(p, edges[:-1])
    within = p / np.repeat(of_class, np.diff(edges))
    k = len(counts)
    out = {
        "x": normal(0.3, k + parts, 3 * hidden), "u": normal(1 / np.sqrt(hidden), hidden, 3 * hidden),
        "wc": normal(0.05, hidden, len(edges) - 1), "bc": np.log(of_class).astype(np.float32),
        "wo": normal(0.05, hidden, k), "bo": np.log(within).astype(np.float32),
    }
    if nodes:
        out["v"] = np.zeros((nodes, hidden), dtype=np.float32)
    return out


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in p.values()])


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, v in like.items():
        out[name] = np.asarray(flat[at : at + v.size], dtype=np.float32).reshape(v.shape)
        at += v.size
    return out


def lay_out(lengths: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and first step of each document, longest first into the shortest lane; lane lengths, descending.

    No more lanes than tokens fill beside the longest document, so that the lanes' area stays near the tokens.
    """
    lanes = max(1, min(lanes, len(lengths), -(-int(lengths.sum()) // max(1, int(lengths.max(initial=0))))))
    lane, first = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    heap = [(0, i) for i in range(lanes)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        used, i = heapq.heappop(heap)
        lane[d], first[d] = i, used
        heapq.heappush(heap, (used + int(lengths[d]), i))
    total = np.zeros(lanes, dtype=np.int64)
    for used, i in heap:
        total[i] = used
    order = np.argsort(-total, kind="stable")
    new = np.empty(lanes, dtype=np.int64)
    new[order] = np.arange(lanes)
    return new[lane], first, total[order]


def _add_rows(total: np.ndarray, row: np.ndarray, values: np.ndarray, source: np.ndarray | None = None) -> None:
    """``total[row[i]] += values[source[i]]`` for all ``i``; without ``source``, ``values[i]``.

    Equal rows stand together and are cut into pieces of at most ``PIECE``; the pieces' first values are added to their
    second ones, then to their third ones, all pieces at once. The sums of the pieces are added in the same way.
    """
    order = np.argsort(row, kind="stable")
    row, source = row[order], order if source is None else source[order]
    while len(row):
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        head = np.flatnonzero(place % PIECE == 0)
        size = np.diff(np.append(head, len(row)))
        longest = np.argsort(-size, kind="stable")
        at, more = head[longest], np.searchsorted(-size[longest], -np.arange(1, PIECE))  # pieces of more than 1, 2, .. rows
        sums = values.take(source[at], axis=0)
        for i, n in enumerate(more[more > 0].tolist(), 1):
            sums[:n] += values.take(source[at[:n] + i], axis=0)
        if len(head) == len(begin):
            total[row[at]] += sums
            return
        row, values, source = row[head], sums, np.argsort(longest, kind="stable")


def _bounded(w: np.ndarray, bias: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each column of ``w``, its bias last, for softmaxes over the columns from ``first[i]`` on. Biases are shifted so that no
    state, which lies between -1 and 1, has a logit above 0. Second, the softmaxes whose highest logit is then above -``SPAN``: their rows
    need no shift of their own."""
    reach = np.abs(w).sum(axis=0)
    high = np.maximum.reduceat(bias + reach, first)
    safe = high - np.maximum.reduceat(bias - reach, first) < SPAN
    out = np.empty((len(bias), len(w) + 1), dtype=w.dtype)
    out[:, :-1], out[:, -1] = w.T, bias - np.repeat(high, np.diff(np.append(first, len(bias))))
    return out, safe


class Gru:
    def __init__(self, params: dict[str, np.ndarray], edges: np.ndarray):
        self.p = {k: v.copy() for k, v in params.items()}
        self.edges = edges
        self.class_of = np.repeat(np.arange(len(edges) - 1, dtype=np.int16), np.diff(edges))
        self.hidden = self.p["u"].shape[0]
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0
        self.waiting, self.seen = None, 0
        self.bounded = None  # of both softmaxes, until the next update

    def run(
        self, ids: np.ndarray, offsets: np.ndarray, end: int, learn: bool,
        words: np.ndarray | None = None, rare: Rare | None = None,
    ) -> np.ndarray:
        """Natural log-probability of every symbol of the documents ``ids[offsets[i]:offsets[i + 1]]``; with
        ``learn`` each window is followed by an update and the returned values are those before it. ``words`` has
        each symbol's word among the ``rare`` ones, or -1; the values are then those of the words."""
        lengths = np.diff(offsets)
        lane, first, total = lay_out(lengths)
        lanes, deep = len(total), int(total.max()) if len(total) else 0
        row = np.repeat(np.arange(len(lengths)), lengths)
        cell = (first[row] + np.arange(len(ids)) - offsets[:-1][row]) * lanes + lane[row]
        y = np.zeros(deep * lanes, dtype=np.int16)
        y[cell] = ids
        x = np.full(deep * lanes, end, dtype=np.int16)
        follows = np.ones(len(ids), dtype=bool)
        follows[offsets[:-1]] = False
        x[cell[follows]] = ids[np.flatnonzero(follows) - 1]
        keep = np.ones(deep * lanes, dtype=np.float32)
        keep[cell[~follows]] = 0
        wx = wy = None
        if rare is not None:
            wx, wy = (np.full(deep * lanes, -1, dtype=np.int32) for _ in range(2))
            wy[cell] = words
            wx[cell[follows]] = words[np.flatnonzero(follows) - 1]
            wx, wy = wx.reshape(deep, lanes), wy.reshape(deep, lanes)
        x, y, keep = (a.reshape(deep, lanes) for a in (x, y, keep))
        scores = np.zeros((deep, lanes), dtype=np.float32)
        h = np.zeros((lanes, self.hidden), dtype=np.float32)
        b = 0
        with np.errstate(over="ignore"):  # a gate that is shut is 1 / infinity
            while b < deep:
                a = b
                n = int(np.searchsorted(-total, -a, side="left"))  # lanes longer than a
                b = min(a + max(WINDOW, WINDOW_TOKENS // n), deep)  # where few lanes are left, windows are longer
                valid = total[:n] > np.arange(a, b)[:, None]
                own = None if rare is None else (wx[a:b, :n], wy[a:b, :n], rare)
                h = self._window(x[a:b, :n], y[a:b, :n], keep[a:b, :n], valid, h[:n], scores[a:b, :n], learn, own)
        return scores.reshape(-1)[cell]

    def _window(self, x, y, keep, valid, h, scores, learn, own=None):
        p, k = self.p, self.hidden
        t_all, n = x.shape
        # gates are planes, so that each is contiguous: update, reset, candidate
        planes, rows = np.arange(3)[:, None], p["x"].reshape(-1, k)
        u = np.ascontiguousarray(p["u"].reshape(k, 3, k).transpose(1, 0, 2))
        into = u * np.array([-1, -1, 1], dtype=u.dtype)[:, None, None]  # gates are 1 / (1 + exp(-x))
        g = rows.take(3 * x.reshape(-1).astype(np.int64) + planes, axis=0)
        if own is not None:
            words = own[0].reshape(-1)
            at = np.flatnonzero(words >= 0)
            parts = 3 * own[2].parts.take(words[at], axis=0).astype(np.int64)
            added = rows.take(parts[:, 0] + planes, axis=0)
            for j in range(1, parts.shape[1]):
                added += rows.take(parts[:, j] + planes, axis=0)
            for plane, more in zip(g, added):
                plane[at] += more
        g = g.reshape(3, t_all, n, k)
        step, lane = np.nonzero(keep == 0)
        cut = np.searchsorted(step, np.arange(t_all + 1)).tolist()
        begins = [lane[i:j] if j > i else None for i, j in zip(cut, cut[1:])]
        states = np.empty((t_all, n, k), dtype=np.float32)
        before = np.empty((t_all if learn else 1, n, k), dtype=np.float32)
        hc = np.empty_like(before)
        hu = np.empty((3, n, k), dtype=np.float32)
        for t in range(t_all):
            last = before[t if learn else 0]
            last[...] = h
            if begins[t] is not None:
                last[begins[t]] = 0
            np.matmul(last, into, out=hu)
            gates, c = g[:2, t], g[2, t]
            np.exp(np.subtract(hu[:2], gates, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            if learn:
                hc[t] = hu[2]
            hu[2] *= gates[1]
            c += hu[2]
            np.tanh(c, out=c)
            h = np.subtract(last, c, out=states[t])
            h *= gates[0]
            h += c
        full = bool(valid.all())
        flat, target = (states.reshape(-1, k), y.reshape(-1)) if full else (states[valid], y[valid])
        found, d_flat, grads = self._softmax(flat, target, learn)
        if own is not None:
            self._paths(flat, own[1][valid], own[2], found, d_flat, grads)
        scores[valid] = found
        if learn and len(target):
            d_states = d_flat.reshape(states.shape) if full else np.zeros_like(states)
            if not full:
                d_states[valid] = d_flat
            z, r, c = g
            # what the state's derivative is multiplied by, for all steps at once
            by_z, by_r, by_c = before - c, 1 - r, 1 - z
            by_z *= z
            by_z *= by_c
            by_r *= r
            by_r *= hc
            c *= c
            by_c *= np.subtract(1, c, out=c)
            d_g, d_hc, back = np.empty_like(g), np.empty_like(states), np.empty((3, n, k), dtype=np.float32)
            dh = np.zeros_like(states[0])
            to_state = np.ascontiguousarray(u.transpose(0, 2, 1))
            for t in reversed(range(t_all)):
                dh += d_states[t]
                dz, dr, dc = d_g[:, t]
                np.multiply(dh, by_z[t], out=dz)
                np.multiply(dh, by_c[t], out=dc)
                np.multiply(dc, by_r[t], out=dr)
                np.multiply(dc, r[t], out=d_hc[t])
                np.matmul(d_g[:2, t], to_state[:2], out=back[:2])
                np.matmul(d_hc[t], to_state[2], out=back[2])
                dh *= z[t]
                for part in back:
                    dh += part
                if begins[t] is not None:
                    dh[begins[t]] = 0
            grads["x"] = np.zeros_like(p["x"])
            d_x = d_g.transpose(1, 2, 0, 3).reshape(t_all * n, 3 * k)
            cells = np.flatnonzero(valid.reshape(-1))
            to, cell = [x.reshape(-1)[cells]], [cells]
            if own is not None:
                cells = cells[words[cells] >= 0]
                for part in own[2].parts.take(words[cells], axis=0).T:
                    to.append(part)
                    cell.append(cells)
            _add_rows(grads["x"], np.concatenate(to), d_x, np.concatenate(cell))
            before = before.reshape(-1, k).T
            grads["u"] = np.concatenate([before @ d.reshape(-1, k) for d in (*d_g[:2], d_hc)], axis=1)
            self._gather(grads, len(target))
        return h

    def _softmax(self, h, y, learn):
        p, k = self.p, self.hidden
        # by class, so that each class is a slice
        of = self.class_of[y]
        order = np.argsort(of, kind="stable")
        y, of = y[order], of[order]
        bounds = np.searchsorted(of, np.arange(len(self.edges)))
        mine = np.ones((len(y), k + 1), dtype=h.dtype)  # the biases' column
        mine[:, :k] = h.take(order, axis=0)
        rows, ones = np.arange(len(y)), np.ones(max(len(self.edges), int(np.diff(self.edges).max())), dtype=h.dtype)

        def solved(mine, w, right, safe):
            """Log-probability of the column ``right`` of each row and, when learning, its gradient by the logits."""
            e = mine @ w.T
            if not safe:
                e -= e.max(axis=1, keepdims=True)
            each = rows[: len(right)]
            log_p = e[each, right]
            np.exp(e, out=e)
            s = e @ ones[: e.shape[1]]
            log_p -= np.log(s)
            if learn:
                e *= (1 / s)[:, None]
                e[each, right] -= 1
            return log_p, e

        if self.bounded is None:
            self.bounded = _bounded(p["wc"], p["bc"], np.zeros(1, dtype=np.int64)), _bounded(p["wo"], p["bo"], self.edges[:-1])
        (wc, class_safe), (wo, safe) = self.bounded
        found, e = solved(mine, wc, of, class_safe[0])
        grads, d = {}, None
        if learn:
            both, own = e.T @ mine, np.zeros((len(p["bo"]), k + 1), dtype=p["wo"].dtype)
            d = e @ wc[:, :k]
        for i, (a, b) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist())):
            at = slice(bounds[i], bounds[i + 1])
            if b - a == 1 or at.start == at.stop:
                continue
            log_p, e = solved(mine[at], wo[a:b], y[at] - a, safe[i])
            found[at] += log_p
            if learn:
                np.matmul(e.T, mine[at], out=own[a:b])
                d[at] += e @ wo[a:b, :k]
        out = np.empty(len(y), dtype=np.float32)
        out[order] = found
        d_h = None
        if learn:
            d_h = np.empty_like(d)
            d_h[order] = d
            for name, of_rows in (("c", both), ("o", own)):
                grads["w" + name], grads["b" + name] = np.ascontiguousarray(of_rows[:, :k].T), of_rows[:, k].copy()
        return out, d_h, grads

    def _paths(self, h, words, rare, out, d_h, grads):
        """Adds the decisions below the symbols to the log-probabilities ``out`` and, when learning, their gradients."""
        p = self.p
        if d_h is not None:
            grads["v"] = np.zeros_like(p["v"])
        at = np.flatnonzero(words >= 0)
        begin = rare.first[words[at]]
        size = rare.first[words[at] + 1] - begin
        at, begin, size = at[size > 0], begin[size > 0], size[size > 0]
        if not len(at):
            return
        step, row = take_ranges(begin, size), np.repeat(at, size)
        node, side, mine = rare.node[step], rare.side[step].astype(np.float32), h.take(row, axis=0)
        vectors = p["v"].take(node, axis=0)
        odds = np.einsum("ij,ij->i", mine, vectors)
        odds *= side
        odds += rare.bias[step].astype(np.float32)
        np.exp(np.negative(odds, out=odds), out=odds)  # against the side taken
        first = np.cumsum(size) - size
        out[at] -= np.add.reduceat(np.log1p(odds), first)
        if d_h is not None:
            d = (-side * odds / (1 + odds))[:, None]
            vectors *= d
            _add_rows(d_h, row, vectors)
            mine *= d
            _add_rows(grads["v"], node, mine)

    def _gather(self, grads, n):
        """Windows that few lanes reach wait for others: an update averages ``UPDATE_TOKENS`` tokens at least."""
        if self.waiting:
            for name, g in self.waiting.items():
                grads[name] += g
        self.waiting, self.seen = grads, self.seen + n
        if self.seen >= UPDATE_TOKENS:
            self._update(grads, self.seen)
            self.waiting, self.seen = None, 0

    def finish(self):
        """Applies what waits when no more tokens come, weighted by its tokens."""
        if self.waiting:
            self._update(self.waiting, self.seen, self.seen / UPDATE_TOKENS)
            self.waiting, self.seen = None, 0

    def _update(self, grads, n, weight=1.0):
        self.steps += 1
        self.bounded = None
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / n
        scale = np.float32(min(1.0, CLIP / max(norm, 1e-12)) / n)
        first, second = np.float32(1 / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        for name, g in grads.items():
            g, m, v = g * scale, self.m[name], self.v[name]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            g *= g
            g *= 0.01
            v += g
            np.sqrt(np.multiply(v, second, out=g), out=g)
            g += 1e-8
            step = np.divide(m, g, out=g)
            step *= first * np.float32(RATE * weight)
            self.p[name] -= step
