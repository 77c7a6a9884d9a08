"""A gated recurrent language model in numpy with a class-factored output softmax."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

END, UNKNOWN = 0, 1


def make_classes(counts: np.ndarray, n_classes: int) -> np.ndarray:
    """Bounds of contiguous id ranges: END and UNKNOWN alone, the others (by falling count) of like mass."""
    mass = np.cumsum(np.sqrt(np.maximum(counts[2:], 1e-9)))
    inner = np.searchsorted(mass, mass[-1] * np.arange(1, n_classes - 2) / (n_classes - 2)) + 3 if len(mass) else np.empty(0, int)
    return np.unique(np.concatenate([[0, 1, 2], inner, [len(counts)]])).astype(np.int64)


@dataclass
class Gru:
    """Weights: per-token gate inputs (a fused embedding), recurrent gates, class and in-class outputs."""

    bounds: np.ndarray
    hidden: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def create(cls, counts: np.ndarray, hidden: int = 32, n_classes: int = 40, seed: int = 3) -> Gru:
        rng = np.random.default_rng(seed)
        bounds, v = make_classes(counts, n_classes), len(counts)
        c = len(bounds) - 1
        m = cls(bounds, hidden)
        share = np.maximum(counts, 0.5) / np.maximum(counts, 0.5).sum()
        class_mass = np.add.reduceat(share, bounds[:-1])
        m.weights = {
            "x": rng.normal(0, 0.3, (v, 3 * hidden)),
            "h": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)),
            "b": np.concatenate([np.full(hidden, 1.0), np.zeros(2 * hidden)]),
            "co": rng.normal(0, 0.05, (c, hidden)),
            "cb": np.log(class_mass),
            "o": rng.normal(0, 0.05, (v, hidden)),
            "ob": np.log(share / class_mass[np.repeat(np.arange(c), np.diff(bounds))]),
        }
        m.weights = {k: w.astype(np.float32) for k, w in m.weights.items()}
        return m

    def pack(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def unpack(self, flat: np.ndarray) -> Gru:
        out, at = Gru(self.bounds, self.hidden), 0
        for k, w in self.weights.items():
            out.weights[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return out

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target: that of its class plus that within the class."""
        w, cls = self.weights, np.searchsorted(self.bounds, target, "right") - 1
        logits = h @ w["co"].T
        logits += w["cb"]
        out = logits[np.arange(len(target)), cls]
        np.exp(logits, out=logits)
        out = out - np.log(logits.sum(1))
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(self.bounds)))
        for c in range(len(self.bounds) - 1):
            lo, hi = self.bounds[c], self.bounds[c + 1]
            rows = order[cuts[c] : cuts[c + 1]]
            if hi - lo > 1 and len(rows):
                inner = h[rows] @ w["o"][lo:hi].T
                inner += w["ob"][lo:hi]
                picked = inner[np.arange(len(rows)), target[rows] - lo]
                np.exp(inner, out=inner)
                out[rows] += picked - np.log(inner.sum(1))
        return out


def lanes(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Documents spread over at most ``n`` lanes of like total length, longest first; lanes by falling length."""
    import heapq

    n = max(1, min(n, len(lengths)))
    heap = [(0, i) for i in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        total, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (total + int(lengths[d]), i))
    return sorted((x for x in out if x), key=lambda x: -int(lengths[x].sum()))


def lay_out(ids: np.ndarray, first: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(targets, inputs, document, lane lengths): lanes as columns; a document starts after an END input.

    ``ids``: all documents' tokens, each document ended by END; ``first``: n + 1 starts. Unused cells hold -1
    as targets and END as inputs.
    """
    n = np.diff(first)
    rows = lanes(n, n_lanes)
    length = np.array([int(n[r].sum()) for r in rows])
    target = np.full((int(length.max(initial=0)), len(rows)), -1, np.int32)
    doc = np.full(target.shape, -1, np.int32)
    for k, r in enumerate(rows):
        target[: length[k], k] = np.concatenate([ids[first[d] : first[d + 1]] for d in r])
        doc[: length[k], k] = np.repeat(r, n[r])
    source = np.full_like(target, END)
    source[1:] = np.maximum(target[:-1], END)
    return target, source, doc, length


def score_documents(model: Gru, ids: np.ndarray, first: np.ndarray, n_lanes: int = 256, window: int = 64) -> np.ndarray:
    """Natural log likelihood of each whole document. The state is carried across windows and from step to
    step, and set to zero only where a document begins."""
    n_docs = len(first) - 1
    total = np.zeros(n_docs)
    if not len(ids):
        return total
    target, source, doc, length = lay_out(ids, first, n_lanes)
    table = model.weights["x"] + model.weights["b"]
    begins = np.zeros(target.shape, bool)
    begins[0] = True
    begins[1:] = doc[1:] != doc[:-1]
    fresh, w_in = begins.any(1), np.ascontiguousarray(model.weights["h"].T)
    carried = np.zeros((model.hidden, target.shape[1]), np.float32)
    for lo in range(0, len(target), window):
        hi = min(lo + window, len(target))
        live = int((length > lo).sum())
        # Lanes that end inside the window run on over padding, which is not counted.
        x = _side_by_side(table[source[lo:hi, :live].ravel()], hi - lo)
        states = np.empty((hi - lo, model.hidden, live), np.float32)
        for t in range(hi - lo):
            h = states[t - 1] if t else carried[:, :live]
            if fresh[lo + t]:
                h = np.where(begins[lo + t, :live], np.float32(0), h)
            advance(x[t], w_in @ h, h, states[t])
        carried[:, :live] = states[-1]
        wanted = target[lo:hi, :live].ravel()
        valid = wanted >= 0
        lp = model.log_probs(_lane_by_lane(states)[valid], wanted[valid])
        total += np.bincount(doc[lo:hi, :live].ravel()[valid], weights=lp, minlength=n_docs)
    return total


def _side_by_side(rows: np.ndarray, steps: int) -> np.ndarray:
    """(steps, width, lanes) from rows of ``width`` values, step after step, lane after lane."""
    return np.ascontiguousarray(rows.reshape(steps, -1, rows.shape[1]).transpose(0, 2, 1))


def _lane_by_lane(x: np.ndarray) -> np.ndarray:
    """The inverse of ``_side_by_side``."""
    return np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])


def advance(x: np.ndarray, rec: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
    """One step of the unit, values of lanes side by side: ``x``, the inputs of the gates, turns into z (keeps), r
    (resets) and n (the candidate) in place; ``out`` is n + z (h - n)."""
    k = len(h)
    zr, n = x[: 2 * k], x[2 * k :]
    zr += rec[: 2 * k]
    zr *= np.float32(0.5)
    np.tanh(zr, out=zr)
    zr += 1
    zr *= np.float32(0.5)
    n += zr[k:] * rec[2 * k :]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= zr[:k]
    out += n


def train(model: Gru, ids: np.ndarray, first: np.ndarray, n_lanes: int = 64, window: int = 24, rate: float = 0.1, clip: float = 5.0) -> tuple[Gru, float]:
    """One pass of Adagrad over the documents by back-propagation truncated to a window; the state is carried
    over the window's edge. Returns the model and the mean negative log likelihood per token.

    Tokens of a window are sorted by output class once, so that each class works on a slice; the gradients of
    the recurrent weights of all steps are one product.
    """
    target, source, doc, length = lay_out(ids, first, n_lanes)
    k, w = model.hidden, {n: x.copy() for n, x in model.weights.items()}
    # In-class outputs with their bias as one more column, for states with a 1.
    w["oo"] = np.concatenate([w.pop("o"), w.pop("ob")[:, None]], axis=1)
    square = {n: np.full_like(x, 1e-2) for n, x in w.items()}
    begins = np.zeros(target.shape, bool)
    begins[0] = True
    begins[1:] = doc[1:] != doc[:-1]
    fresh = begins.any(1)
    carried = np.zeros((k, target.shape[1]), np.float32)
    n_classes, small_ids = len(model.bounds) - 1, len(w["oo"]) < 1 << 16
    class_of = np.repeat(np.arange(n_classes, dtype=np.int16 if n_classes < 1 << 15 else np.int32), np.diff(model.bounds))
    grad_oo, ones = np.zeros_like(w["oo"]), np.ones(len(w["oo"]), np.float32)
    loss, seen = 0.0, 0

    def update(name: str, grad: np.ndarray, rows=None) -> None:
        np.clip(grad, -clip, clip, out=grad)
        if rows is None or isinstance(rows, slice):
            here = slice(None) if rows is None else rows
            sq, at = square[name][here], w[name][here]
            sq += grad * grad
            grad *= np.float32(rate)
            grad /= np.sqrt(sq)
            at -= grad
        else:
            sq = square[name][rows] + grad * grad
            square[name][rows] = sq
            grad *= np.float32(rate)
            grad /= np.sqrt(sq, out=sq)
            w[name][rows] -= grad

    for lo in range(0, len(target), window):
        hi = min(lo + window, len(target))
        live = int((length > lo).sum())
        steps = hi - lo
        # A unit's values of all lanes lie side by side, so that gates are whole blocks.
        h, ends_in = np.empty((steps, k, live), np.float32), np.empty((steps, k, live), np.float32)
        ids_in = source[lo:hi, :live].ravel()
        x = _side_by_side(w["x"][ids_in] + w["b"], steps)
        rec = np.empty((steps, 3 * k, live), np.float32)
        w_in = np.ascontiguousarray(w["h"].T)
        for t in range(steps):
            # A document begins with no state; the one before is still judged by its own last state.
            h[t] = ends_in[t - 1] if t else carried[:, :live]
            if fresh[lo + t]:
                h[t][:, begins[lo + t, :live]] = 0
            np.matmul(w_in, h[t], out=rec[t])
            advance(x[t], rec[t], h[t], ends_in[t])
        carried[:, :live] = ends_in[-1]
        wanted = target[lo:hi, :live].ravel()
        rows = np.flatnonzero(wanted >= 0)
        rows = rows[np.argsort(class_of[wanted[rows]], kind="stable")]
        y, hs_1 = wanted[rows], np.ones((len(rows), k + 1), np.float32)
        hs_1[:, :k] = _lane_by_lane(ends_in)[rows]
        hs = hs_1[:, :k]
        cls = class_of[y]
        # Of a full window, so that the last, few documents of a long lane do not weigh more than others.
        scale = np.float32(1 / (target.shape[1] * window))
        p = hs @ w["co"].T
        p += w["cb"]
        np.exp(np.minimum(p, 80, out=p), out=p)
        p /= p.sum(1, keepdims=True)
        at = np.arange(len(y))
        loss -= float(np.log(np.maximum(p[at, cls], 1e-30)).sum())
        p[at, cls] -= 1
        p *= scale
        d_h = p @ w["co"]
        g_co, g_cb = p.T @ hs, p.sum(0)
        ends = np.searchsorted(cls, np.arange(n_classes + 1))
        touched: list[list[int]] = []
        right = np.ones(len(y), np.float32)
        for c in range(n_classes):
            a, b, i, j = model.bounds[c], model.bounds[c + 1], ends[c], ends[c + 1]
            if b - a == 1 or i == j:
                continue
            mine = hs_1[i:j]
            q = mine @ w["oo"][a:b].T
            np.exp(np.minimum(q, 80, out=q), out=q)
            q *= (scale / (q @ ones[: b - a]))[:, None]
            pick = at[: j - i]
            hit = y[i:j] - a
            right[i:j] = q[pick, hit]
            q[pick, hit] -= scale
            right[i:j] /= scale
            d_h[i:j] += q @ w["oo"][a:b, :k]
            np.matmul(q.T, mine, out=grad_oo[a:b])
            if touched and touched[-1][1] == a:
                touched[-1][1] = b
            else:
                touched.append([a, b])
        loss -= float(np.log(np.maximum(right, 1e-30)).sum())
        seen += len(y)
        d_out = np.zeros((steps * live, k), np.float32)
        d_out[rows] = d_h
        d_out = _side_by_side(d_out, steps)
        d_x = np.empty((steps, 3 * k, live), np.float32)
        d_state = np.zeros((k, live), np.float32)
        for t in range(steps - 1, -1, -1):
            d = d_state
            d += d_out[t]
            (z, r, n), (d_z, d_r, d_n), d_rec = x[t].reshape(3, k, live), d_x[t].reshape(3, k, live), rec[t]
            keep = d * z
            np.subtract(d, keep, out=d_n)
            d_n *= 1 - n * n
            np.subtract(h[t], n, out=d_z)
            d_z *= 1 - z
            d_z *= keep
            # What reached the candidate through the reset gate; ``rec`` turns into its gradient in place.
            through = d_n * r
            np.multiply(through, d_rec[2 * k :], out=d_r)
            d_r *= 1 - r
            d_rec[: 2 * k] = d_x[t, : 2 * k]
            d_rec[2 * k :] = through
            d_state = keep
            d_state += w["h"] @ d_rec
            if fresh[lo + t]:
                d_state[:, begins[lo + t, :live]] = 0
        flat = _lane_by_lane(d_x)
        g_h = _lane_by_lane(h).T @ _lane_by_lane(rec)
        order = np.argsort(ids_in.astype(np.uint16) if small_ids else ids_in, kind="stable")
        ranked = ids_in[order]
        cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        update("b", flat.sum(0))
        update("x", np.add.reduceat(flat[order], cut, axis=0), ranked[cut])
        update("h", g_h)
        update("co", g_co)
        update("cb", g_cb)
        for a, b in touched:
            update("oo", grad_oo[a:b], slice(a, b))
    outputs = w.pop("oo")
    w["o"], w["ob"] = np.ascontiguousarray(outputs[:, :k]), outputs[:, k].copy()
    return Gru(model.bounds, k, w), loss / max(1, seen)
