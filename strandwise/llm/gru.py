"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried across windows."""

from __future__ import annotations

import heapq

import numpy as np


def shapes(inputs: int, classes: int, heads: int, width: int, hidden: int) -> dict[str, tuple[int, ...]]:
    """Parameters by name. The embedding goes straight to the three gates, so that an input is one lookup."""
    return {
        "E": (inputs, 3 * hidden), "U": (hidden, 3 * hidden), "b": (3 * hidden,), "bn": (hidden,),
        "C": (hidden, classes), "cb": (classes,), "O": (heads, hidden, width), "ob": (heads, width),
    }


def start(dims: dict[str, tuple[int, ...]], seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.1, s) if len(s) > 1 and k not in ("ob",) else np.zeros(s)).astype(np.float32) for k, s in dims.items()}


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in p]).astype(np.float64)


def unflatten(flat: np.ndarray, dims: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in dims.items():
        n = int(np.prod(s))
        out[k] = np.asarray(flat[at : at + n], np.float32).reshape(s)
        at += n
    return out


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the squashing function of gates and candidates. Like tanh it runs from -1 to 1, at a quarter of
    the time; its slope is (1 - |result|)^2."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


#: x * _SLOPE + _ONE as a whole number, read as the bits of a float, is 2 ** (x / ln 2) at whole powers of two and linear between.
_SLOPE, _ONE, _MOST = np.float32(2**23 / np.log(2)), np.int32(127 << 23), np.float32(125 * 2**23)


def _exp(x: np.ndarray) -> np.ndarray:
    """An exponential that is linear between powers of two, in place: positive and growing, within 6.2 % of e^x. What is
    divided by its sum is a probability all the same, and its slope (_slope) is used as it is, so training and scores agree."""
    x *= _SLOPE
    np.clip(x, -_MOST, _MOST, out=x)
    bits = x.astype(np.int32)
    bits += _ONE
    return bits.view(np.float32)


def _slope(e: np.ndarray) -> np.ndarray:
    """The slope of _exp where its value is e: 1 / ln 2 times the power of two at or below it."""
    out = (e.view(np.int32) & np.int32(0x7F800000)).view(np.float32)
    out *= np.float32(1 / np.log(2))
    return out


def lanes(texts: list[np.ndarray], width: int) -> list[list[int]]:
    """Texts dealt to at most `width` lanes of about equal length, the longest lane first."""
    out: list[list[int]] = [[] for _ in range(min(width, max(1, len(texts))))]
    load = [(0, k) for k in range(len(out))]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        n, k = heapq.heappop(load)
        out[k].append(i)
        heapq.heappush(load, (n + len(texts[i]), k))
    return [out[k] for _, k in sorted(load, reverse=True) if out[k]]


#: Lanes, unless there are fewer texts.
FEWEST = 48


class Windows:
    """Texts (arrays of output ids, the last one the end) as windows of steps x lanes; a lane is cut after each window, but the
    state goes on. first: the input of a text's first step. longest: where few lanes are left, windows take more steps, up to
    this many, so that they hold about width * steps tokens as before.

    Windows are made as they are asked for and hold the live lanes only; besides them there is one copy of the texts, lane after lane.
    """

    def __init__(self, texts: list[np.ndarray], width: int, steps: int, first: int, longest: int | None = None):
        self.first = first
        # no more lanes than keep busy as long as the longest text takes
        lengths = np.array([len(t) for t in texts], np.int64)
        self.dealt = lanes(texts, min(width, max(FEWEST, int(lengths.sum()) // max(1, int(lengths.max(initial=0))))))
        self.steps, self.full, self.longest = steps, width * steps, longest or steps
        # lane after lane: its texts, where each begins, and which it is
        self.order = np.array([i for lane in self.dealt for i in lane if lengths[i]], np.int32)
        self.stream = np.concatenate([np.zeros(0, np.int32), *(texts[i] for i in self.order)]).astype(np.int32, copy=False)
        self.starts = np.cumsum(lengths[self.order]) - lengths[self.order]
        self.begins = np.zeros(len(self.stream), bool)
        self.begins[self.starts] = True
        self.lengths = [int(lengths[lane].sum()) for lane in self.dealt]

    def __iter__(self):
        t, live = 0, len(self.dealt)
        length = np.array(self.lengths, np.int64)
        offset = np.cumsum(length) - length
        full = self.lengths
        while live and full[live - 1] <= t:
            live -= 1
        while live:
            n = max(self.steps, min(self.longest, self.full // live))
            step = np.arange(t, t + n)[:, None]
            ended = step >= length[:live]
            at = np.where(ended, 0, offset[:live] + step)
            y, begin = self.stream[at], self.begins[at]
            x = np.where(begin, np.int32(self.first), self.stream[at - 1])
            begin[ended] = False
            # the text of a lane's first step, and one more at each later begin
            rank = np.searchsorted(self.starts, at[0], "right") - 1 - begin[0]
            doc = self.order[rank + np.cumsum(begin, 0)]
            for v, none in ((x, 0), (y, 0), (doc, -1)):
                v[ended] = none
            t += n
            yield x, y, begin, doc
            while live and full[live - 1] <= t:
                live -= 1


#: Rows whose choices are made at once: what they take stays in a core's cache.
_PIECE = 512
#: The power of two at or below a float, by its bits.
_POWER = np.int32(0x7F800000)


class _Chooser:
    """Log probabilities of chosen columns of a layer, and with them the gradients of the loss.

    The layer's weights with the bias below them are kept as _exp takes them, times _SLOPE; rows of states have a one at the end.
    """

    def __init__(self, scaled: np.ndarray, within: bool, ones: np.ndarray, grad: np.ndarray | None):
        self.scaled, self.within, self.ones, self.grad = scaled, within, ones, grad

    def choose(self, rows: np.ndarray, chosen: np.ndarray, logp: np.ndarray, dh: np.ndarray | None) -> None:
        """Fills logp of the chosen columns, and the gradients of the states times ln 2 * _SLOPE."""
        width = len(self.ones)
        for s in range(0, len(rows), _PIECE):
            h = rows[s : s + _PIECE]
            x = h @ self.scaled
            if not self.within:
                np.clip(x, -_MOST, _MOST, out=x)
            bits = x.astype(np.int32)
            bits += _ONE
            e = bits.view(np.float32)
            total = e @ self.ones
            at = np.arange(0, len(h) * width, width) + chosen[s : s + _PIECE]
            picked = e.reshape(-1)[at]
            np.log(picked / total, out=logp[s : s + _PIECE])
            if self.grad is not None:
                # the slope of _exp is 1 / ln 2 times the power of two
                bits &= _POWER
                own = e.reshape(-1)[at] / picked
                e *= (1 / total)[:, None]
                e.reshape(-1)[at] -= own
                self.grad += e.T @ h
                np.matmul(e, self.scaled[:-1].T, out=dh[s : s + _PIECE])


def _choosers(weights: np.ndarray, biases: np.ndarray, learn: bool) -> list[_Chooser]:
    """Choosers of layers of one size."""
    layers, n, width = weights.shape
    scaled = np.empty((layers, n + 1, width), np.float32)
    scaled[:, :-1], scaled[:, -1] = weights, biases
    scaled *= _SLOPE
    # states lie between -1 and 1, so most layers can't reach what _exp cuts off
    within = bool(np.abs(scaled).sum(1).max() < _MOST)
    ones, grad = np.ones(width, np.float32), np.zeros((layers, width, n + 1), np.float32) if learn else None
    return [_Chooser(w, within, ones, grad[k] if learn else None) for k, w in enumerate(scaled)]


#: What _Chooser leaves out of its gradients: that of the layer, and that of the states.
_LAYER, _STATE = np.float32(1 / np.log(2)), np.float32(1 / 2**23)


def _sums(rows: np.ndarray, ids: np.ndarray, into: np.ndarray) -> None:
    """Adds the rows up by ids, in each block if there are more: in each round an id's odd row goes to its sum, and its other rows
    are added in pairs."""
    place = np.argsort(ids.astype(np.int16) if into.shape[-2] < 1 << 15 else ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[place], prepend=-1))
    names, size = ids[place[first]], np.diff(first, append=len(ids))
    while len(names):
        odd = size % 2 == 1
        into[..., names[odd], :] += rows.take(place[(first + size - 1)[odd]], -2)
        keep = np.ones(len(place), bool)
        keep[(first + size - 1)[odd]] = False
        place = place[keep]
        rows = rows.take(place[::2], -2) + rows.take(place[1::2], -2)
        size = size // 2
        names, size = names[size > 0], size[size > 0]
        first, place = np.cumsum(size) - size, np.arange(rows.shape[-2])


class Model:
    """out_class, out_slot: class and place in the class of each output id; slot -1 for ids that are their class alone."""

    def __init__(self, params: dict[str, np.ndarray], out_class: np.ndarray, out_slot: np.ndarray):
        self.p, self.out_class, self.out_slot = params, out_class, out_slot
        self.hidden = params["U"].shape[0]
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory that stays between windows, as new pages take longer than the sums written to them."""
        size = int(np.prod(shape))
        if self.rooms.get(name, np.empty(0)).size < size:
            self.rooms[name] = np.zeros(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def table(self, names: np.ndarray | None = None) -> np.ndarray:
        """What inputs (names, or all) give to each gate, biases included: gates x inputs x hidden."""
        p, n = self.p, self.hidden
        rows = (p["E"] if names is None else p["E"].take(names, 0)).reshape(-1, 3, n)
        return np.add(rows.swapaxes(0, 1), p["b"].reshape(3, 1, n), self._room("table", 3, len(rows), n))

    def forward(self, x: np.ndarray, begin: np.ndarray, h: np.ndarray, keep: bool, table: np.ndarray):
        """x: places in the table. States (lanes x hidden) before the first step (h, turned) and after each, and what the way back needs. Each gate is a block
        of memory in the order of the states, so nothing is turned. What is returned is overwritten by the next window.

        Where lanes are few the calls of a step take longer than its sums: the parts of all steps are made beforehand, and states
        are copied only where a text begins."""
        p, n, lanes = self.p, self.hidden, x.shape[1]
        stay = len(x) if keep else 1
        states, none = self._room("h", len(x) + 1, lanes, n), self._room("none", lanes, n)
        gs, us, qs = (self._room(k, stay, 3, lanes, n) for k in "guq")
        states[0] = h.T
        starts = [np.flatnonzero(v) if some else None for v, some in zip(begin, begin.any(1).tolist(), strict=True)]
        across = np.ascontiguousarray(p["U"].reshape(n, 3, n).swapaxes(0, 1))
        parts = (gs, us, gs[:, :2], us[:, :2], qs[:, :2], gs[:, 0], gs[:, 1], gs[:, 2], us[:, 0], us[:, 2], qs[:, 2])
        steps = zip(*(list(v) * (1 if keep else len(x)) for v in parts), strict=True)
        # numbers of an array's kind, as others are looked at in each call
        half, one, bias, take = np.float32(0.5), np.float32(1), p["bn"], table.take
        for i, start, before, last, (g, u, zr, uzr, y, z, r, c, w, m, q) in zip(x, starts, states[:-1], states[1:], steps, strict=True):
            if start is not None:
                np.copyto(none, before)
                none[start] = 0
                before = none
            take(i, 1, g, "clip")
            np.matmul(before, across, u)
            # a gate is (1 + v / (1 + |v|)) / 2 = 1 / 2 + v / (2 + 2 |v|), and its slope 2 / (2 + 2 |v|)^2
            np.add(zr, uzr, zr)
            np.abs(zr, y)
            np.add(y, one, y)
            np.divide(half, y, y)
            np.multiply(zr, y, zr)
            np.add(zr, half, zr)
            np.add(m, bias, m)
            np.multiply(r, m, w)
            np.add(c, w, c)
            np.abs(c, q)
            np.add(q, one, q)
            np.divide(one, q, q)
            np.multiply(c, q, c)
            # the new state: c + z (h - c)
            np.subtract(before, c, w)
            np.multiply(w, z, last)
            np.add(last, c, last)
        return states, (gs, us, qs, starts)

    def layers(self, learn: bool) -> list[_Chooser]:
        """The classes' layer and those of the words of each class, as the parameters are now."""
        p = self.p
        return [*_choosers(p["C"][None], p["cb"][None], learn), *_choosers(p["O"], p["ob"], learn)]

    def output(self, hs: np.ndarray, y: np.ndarray, grads: dict | None = None, layers: list[_Chooser] | None = None):
        """Natural log probability of each output (rows) given its state; with grads, also the states' gradients of the loss."""
        n, learn = self.hidden, grads is not None
        layers = layers or self.layers(learn)
        if hs.shape[1] == n:
            hs = np.concatenate([hs, np.ones((len(hs), 1), np.float32)], 1)
        k = self.out_class[y]
        logp, dh = np.empty(len(y), np.float32), np.empty((len(y), n), np.float32) if learn else None
        layers[0].choose(hs, k, logp, dh)
        slot = self.out_slot[y]
        inner = np.flatnonzero(slot >= 0)
        inner = inner[np.argsort(k[inner].astype(np.int16), kind="stable")]
        edges = np.searchsorted(k[inner], np.arange(len(layers)))
        own, place = hs[inner], slot[inner]
        more, back = np.empty(len(inner), np.float32), np.empty((len(inner), n), np.float32) if learn else None
        for c in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[c], edges[c + 1])
            layers[c + 1].choose(own[s], place[s], more[s], back[s] if learn else None)
        logp[inner] += more
        if learn:
            dh[inner] += back
            dh *= _STATE
            for layer, weight, bias in zip(layers, [grads["C"], *grads["O"]], [grads["cb"], *grads["ob"]], strict=True):
                np.multiply(layer.grad[:, :-1].T, _LAYER, weight)
                np.multiply(layer.grad[:, -1], _LAYER, bias)
        return logp, dh

    def gradients(self, x, y, begin, valid, h):
        """Gradients of the mean loss of a window (backpropagation stops at its begin), the loss and the last state."""
        grads, names, loss, count, h = self._sums(x, y, begin, valid, h)
        some, grads["E"] = grads["E"], np.zeros_like(self.p["E"])
        grads["E"][names] = some
        for g in grads.values():
            g /= count
        return grads, loss, count, h

    def _sums(self, x, y, begin, valid, h):
        """gradients, but not yet divided by the number of tokens, and of the inputs only those of the window (names)."""
        p, n = self.p, self.hidden
        names = np.flatnonzero(np.bincount(x.ravel(), minlength=len(p["E"])))
        place = np.empty(len(p["E"]), np.int32)
        place[names] = np.arange(len(names))
        x = place[x]
        grads = {k: np.zeros((len(names), *v.shape[1:]), np.float32) if k == "E" else np.empty_like(v) for k, v in p.items()}
        states, back = self.forward(x, begin, h, True, self.table(names))
        at = np.flatnonzero(valid.ravel())
        rows = self._rows(states)
        if len(at) == x.size:
            logp, dhs = self.output(rows, y.ravel(), grads)
        else:
            dhs = np.zeros((x.size, n), np.float32)
            logp, dhs[at] = self.output(rows[at], y.ravel()[at], grads)
        count, h = max(1, len(at)), states[-1].T.copy()
        given = self._backward(dhs.reshape(*x.shape, n), *back).reshape(4, -1, n)
        # what each step began with: nothing where a text begins
        before = states[:-1]
        before[begin] = 0
        c, z, r = np.matmul(before.reshape(-1, n).T, given[:3])
        np.concatenate([2 * z, 2 * r, c], 1, grads["U"])
        sums = np.matmul(np.ones(x.size, np.float32), given)
        sums[1:3] *= 2
        grads["bn"][:], grads["b"][:] = sums[0], sums[1:].ravel()
        # invalid steps have no gradient: zeros may meet any input
        gates = np.zeros((3, len(names), n), np.float32)
        _sums(given[1:], x.ravel(), gates)
        gates[:2] *= 2
        grads["E"].reshape(-1, 3, n)[:] = gates.swapaxes(0, 1)
        return grads, names, -float(logp.sum()), count, h

    def _backward(self, dhs: np.ndarray, gs: np.ndarray, us: np.ndarray, qs: np.ndarray, starts: list) -> np.ndarray:
        """Gradients by step, lane and unit: of the candidate as the state gives it, half of those of both gates, of the candidate as
        the input gives it. dhs: those of the states by themselves."""
        p, n = self.p, self.hidden
        given = self._room("given", 4, *dhs.shape)
        turned = p["U"].reshape(n, 3, n).transpose(1, 2, 0)
        across = np.stack([turned[2], 2 * turned[0], 2 * turned[1]])
        dh, w, one = np.zeros(dhs.shape[1:], np.float32), np.empty((3, *dhs.shape[1:]), np.float32), np.float32(1)
        w0, w1, w2 = w
        parts = (dhs, gs[:, 0], gs[:, 1], us[:, 2], us[:, 0], qs, qs[:, :2], qs[:, 2], given[:3].swapaxes(0, 1), given[1:3].swapaxes(0, 1), *given)
        for start, (own, z, r, m, apart, q, qzr, qc, d, dzr, du, dz, dr, dc) in zip(reversed(starts), zip(*(v[::-1] for v in parts), strict=True), strict=True):
            np.add(dh, own, dh)
            np.multiply(q, q, q)
            np.subtract(one, z, dc)
            np.multiply(dc, dh, dc)
            np.multiply(dc, qc, dc)
            np.multiply(dc, r, du)
            np.multiply(dh, apart, dz)
            np.multiply(dc, m, dr)
            np.multiply(dzr, qzr, dzr)
            np.multiply(dh, z, dh)
            np.matmul(d, across, w)
            np.add(dh, w0, dh)
            np.add(dh, w1, dh)
            np.add(dh, w2, dh)
            if start is not None:
                dh[start] = 0
        return given

    def _rows(self, states: np.ndarray) -> np.ndarray:
        """The states after each step, a lane after the other, with ones at their ends."""
        rows = self._room("rows", len(states) - 1, states.shape[1], self.hidden + 1)
        rows[..., :-1], rows[..., -1] = states[1:], 1
        return rows.reshape(-1, self.hidden + 1)

    def train(self, windows: Windows, adam: dict, rate: float, full: int) -> int:
        """One pass over the windows with Adam, gradients clipped by norm; returns the number of tokens.

        A window of fewer than `full` tokens moves the parameters less: at the end of a batch a few long texts are left alone.
        """
        seen = 0
        h = np.zeros((self.hidden, 0), np.float32)
        if not adam:
            adam |= {"t": 0} | {(k, i): np.zeros_like(v) for k, v in self.p.items() for i in range(2)}
            self.p = {k: v.copy() for k, v in self.p.items()}
        for x, y, begin, doc in windows:
            h = np.zeros((self.hidden, x.shape[1]), np.float32) if not h.shape[1] else h[:, : x.shape[1]]
            grads, names, _, count, h = self._sums(x, y, begin, doc >= 0, h)
            seen += count
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / count
            scale = np.float32(1 / (count * max(1.0, norm)))
            adam["t"] += 1
            fix1, fix2 = 1 - 0.9 ** adam["t"], 1 - 0.99 ** adam["t"]
            # the means of gradients and of their squares are kept times 10 and 100, so that each takes a pass less
            step = np.float32(rate * min(1.0, count / full) * np.sqrt(fix2) / fix1)
            least = np.float32(1e-5 * np.sqrt(fix2))
            for k, g in grads.items():
                # inputs that the window lacks stay as they are, and so do their means
                own = [self.p[k], adam[k, 0], adam[k, 1]]
                parts = [v.take(names, 0) for v in own] if k == "E" else own
                flat, (p, m, v) = g.reshape(-1), (v.reshape(-1) for v in parts)
                for s in range(0, len(flat), 1 << 14):
                    part = slice(s, s + (1 << 14))
                    a, b, c = flat[part], m[part], v[part]
                    a *= scale
                    b *= np.float32(0.9)
                    b += a
                    a *= a
                    c *= np.float32(0.99)
                    c += a
                    np.sqrt(c, out=a)
                    a += least
                    np.divide(b, a, out=a)
                    a *= step
                    p[part] -= a
                if k == "E":
                    for v, some in zip(own, parts, strict=True):
                        v[names] = some
        return seen

    def score(self, texts: list[np.ndarray], width: int, steps: int, first: int) -> np.ndarray:
        """Natural log probability of each whole text, its windows joined by the carried state."""
        out = np.zeros(len(texts))
        h = np.zeros((self.hidden, 0), np.float32)
        layers, table = self.layers(False), self.table()
        for x, y, begin, doc in Windows(texts, width, steps, first, 8 * steps):
            h = np.zeros((self.hidden, x.shape[1]), np.float32) if not h.shape[1] else h[:, : x.shape[1]]
            states, _ = self.forward(x, begin, h, False, table)
            rows, h = self._rows(states), states[-1].T.copy()
            at = np.flatnonzero(doc.ravel() >= 0)
            logp, _ = self.output(rows if len(at) == len(rows) else rows[at], y.ravel()[at], layers=layers)
            out += np.bincount(doc.ravel()[at], logp, minlength=len(texts))
        return out
