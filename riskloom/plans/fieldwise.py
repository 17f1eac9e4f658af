"""DeepFM's gradients and scores for many models that see the same rows.

Same numbers as ``models.deepfm_grad`` and ``deepfm_forward`` (to rounding), with a block's rows along the
last axis, in blocks that stay in the processor's cache. What does not depend on a model (ids by
field, dropout hashes) is made once for all of them. Layer norm is taken from the weight table: an
embedding times a value x is normalised to its centred embedding times c = x / sqrt(var x^2 + eps), so
rows only need c, and the gradient of an embedding follows from the sums of c and c^3 times the
rows' gradients, added by id.
"""

from __future__ import annotations

import numpy as np

from .models import LN_EPS, Dims, hash_fractions, log_loss_terms, mask_widths, sigmoid

BLOCK = 1024     # rows of a block
ONE_HOT = 64     # ids of a field that are added by a matrix product; more by counting


class Block:
    """Rows of one block: values (fields, rows), labels, and by field its ids and the rows' places
    among them, None if all rows hold the same id."""

    def __init__(self, keys, xi, xv, y, step: int = 0):
        self.n, self.y, self.step = len(y), y, step
        self.keys = np.asarray(keys, dtype=np.uint64)
        self.xv = np.ascontiguousarray(xv.T)
        self.fields, self._fractions, self._masks = [], {}, {}
        for col in np.ascontiguousarray(xi.T):
            if (col == col[0]).all():
                self.fields.append((col[:1], None, None))
                continue
            ids, at = np.unique(col, return_inverse=True)
            self.fields.append((ids, at, np.eye(len(ids))[at] if len(ids) <= ONE_HOT else None))

    def mask(self, salt: int, rate: float, width: int, widest: int) -> np.ndarray:
        """The transposed ``models.hash_mask``. A narrower mask is the head of a wider one: each is made
        once, as wide as any model needs it."""
        if (salt, rate) not in self._masks:
            if salt not in self._fractions:
                units = np.arange(widest, dtype=np.uint64)[:, None]
                self._fractions[salt] = hash_fractions(self.keys[None, :], units, self.step, salt)
            self._masks[salt, rate] = (self._fractions[salt] >= rate) / (1.0 - rate)
        return self._masks[salt, rate][:width]


def blocks(keys, xi, xv, y, step: int = 0):
    for lo in range(0, len(y), BLOCK):
        rows = slice(lo, lo + BLOCK)
        yield Block(keys[rows], xi[rows], xv[rows], y[rows], step)


def mask_plan(rates: dict, d: Dims) -> dict[str, tuple[int, float, int]]:
    """By name, the (salt, rate, width) of the masks that ``models.dropout_masks`` makes."""
    widths = mask_widths("deepfm", d)
    return {k: (i + 1, r, widths[k]) for i, (k, r) in enumerate(sorted(rates.items())) if k in widths and r > 0}


def widest_masks(plans: list[dict]) -> dict[int, int]:
    out = {}
    for plan in plans:
        for salt, _, width in plan.values():
            out[salt] = max(out.get(salt, 0), width)
    return out


class Net:
    """One model: ``add_gradient`` adds a block's gradient and returns its loss, ``gradient`` is that of all
    blocks so far, ``scores`` gives a block's probabilities."""

    def __init__(self, p: dict, d: Dims, plan: dict | None = None, widest: dict | None = None):
        self.p, self.d, self.plan, self.widest = p, d, plan or {}, widest or {}
        self.centred = p["emb"] - p["emb"].mean(axis=1, keepdims=True)
        self.var = (self.centred * self.centred).mean(axis=1)
        self.grad = self.sums = None

    def _mask(self, block: Block, name: str):
        if name not in self.plan:
            return None
        salt, rate, width = self.plan[name]
        return block.mask(salt, rate, width, self.widest[salt])

    def _forward(self, block: Block, dropout: bool):
        p, d, n = self.p, self.d, block.n
        F_, K = d.field_size, d.emb_dim

        def mask_of(name):
            return self._mask(block, name) if dropout else None

        def kept(x, name):
            mask = mask_of(name)
            return x if mask is None else x * mask

        c, e, first = np.empty((F_, n)), np.empty((F_, K, n)), np.empty((F_, n))
        for f, (ids, at, _) in enumerate(block.fields):
            x = block.xv[f]
            table = (self.centred[ids] * p["ln_scale"]).T
            var, w1 = self.var[ids], p["w1"][ids]
            if at is not None:
                var, w1 = var[at], w1[at]
                np.take(np.ascontiguousarray(table), at, axis=1, out=e[f], mode="clip")
            else:
                e[f] = table
            c[f] = x / np.sqrt(var * (x * x) + LN_EPS)
            e[f] *= c[f]
            first[f] = w1 * x
        e += p["ln_shift"][:, None]
        z, off, fm, deep = p["bout"], 0, None, []
        if d.use_fm:
            s = e.sum(axis=0)
            y1 = kept(first, "fm0")
            y2 = kept(0.5 * (s * s - np.einsum("fkn,fkn->kn", e, e)), "fm1")
            off = F_ + K
            z = z + p["Wout"][:F_] @ y1 + p["Wout"][F_:off] @ y2
            fm = (s, y1, y2)
        if d.use_deep:
            h = kept(e.reshape(F_ * K, n), "deep0")
            deep.append((None, h))
            for l in range(len(d.deep_layers)):
                a = p[f"W{l}"].T @ h
                a += p[f"b{l}"][:, None]
                gate, mask = a > 0, mask_of(f"deep{l + 1}")
                gate = gate if mask is None else gate * mask  # of the unit's value and of its gradient
                h = np.maximum(a, 0.0, out=a)
                h *= gate
                deep.append((gate, h))
            z = z + p["Wout"][off:] @ h
        return c, e, fm, deep, off, sigmoid(z)

    def scores(self, block: Block) -> np.ndarray:
        return self._forward(block, False)[-1]

    def add_gradient(self, block: Block) -> float:
        p, d, n = self.p, self.d, block.n
        F_, K = d.field_size, d.emb_dim
        if self.grad is None:
            self.grad = {k: np.zeros(np.shape(v)) for k, v in p.items() if k not in ("emb", "w1", "ln_scale")}
            # by id: the rows' gradients times c, the same times c^3, and the first order's
            self.sums = np.zeros((len(self.var), 2 * K + 1))
        g = self.grad

        def kept(x, name):
            mask = self._mask(block, name)
            if mask is not None:
                x *= mask
            return x

        c, e, fm, deep, off, prob = self._forward(block, True)
        l1, dp1 = log_loss_terms(prob, block.y)
        dz = 2.0 * dp1 * prob * (1 - prob)
        g["bout"] += dz.sum()
        dfirst = None
        if d.use_fm:
            s, y1, y2 = fm
            g["Wout"][:F_] += y1 @ dz
            g["Wout"][F_:off] += y2 @ dz
            dfirst = kept(p["Wout"][:F_, None] * dz, "fm0") * block.xv
            dy2 = kept(p["Wout"][F_:off, None] * dz, "fm1")
            de = s - e  # without its mask, the first layer's input is e itself
            de *= dy2
        else:
            de = np.zeros_like(e)
        if d.use_deep:
            g["Wout"][off:] += deep[-1][1] @ dz
            dh = p["Wout"][off:, None] * dz
            for l in reversed(range(len(d.deep_layers))):
                da = np.multiply(dh, deep[l + 1][0], out=dh)
                g[f"W{l}"] += deep[l][1] @ da.T
                g[f"b{l}"] += da.sum(axis=1)
                dh = p[f"W{l}"] @ da
            de += kept(dh, "deep0").reshape(F_, K, n)
        g["ln_shift"] += de.sum(axis=(0, 2))
        powers, parts = np.stack([c, c * c * c], axis=1), np.empty((2 * K + 1, n))  # (F, 2, n)
        for f, (ids, at, one_hot) in enumerate(block.fields):
            if at is None:
                own = self.sums[ids[0]]
                own[:2 * K] += (powers[f] @ de[f].T).ravel()
                own[2 * K] += 0.0 if dfirst is None else dfirst[f].sum()
                continue
            for i in (0, 1):
                np.multiply(de[f], powers[f, i], out=parts[i * K:(i + 1) * K])
            parts[2 * K] = 0.0 if dfirst is None else dfirst[f]
            self.sums[ids] += self._by_id(parts, len(ids), at, one_hot)
        return float(2.0 * l1.sum())

    def gradient(self) -> dict[str, np.ndarray]:
        K, near = self.d.emb_dim, self.centred
        by_one, by_cube = self.sums[:, :K], self.sums[:, K:2 * K]
        g = {**self.grad, "w1": self.sums[:, 2 * K], "ln_scale": (near * by_one).sum(axis=0)}
        by_one, by_cube = by_one * self.p["ln_scale"], by_cube * self.p["ln_scale"]
        g["emb"] = by_one - by_one.mean(axis=1, keepdims=True) - near * (near * by_cube).mean(axis=1, keepdims=True)
        return g

    @staticmethod
    def _by_id(values: np.ndarray, n_ids: int, at: np.ndarray, one_hot) -> np.ndarray:
        if one_hot is not None:
            return (values @ one_hot).T
        return np.stack([np.bincount(at, v, n_ids) for v in values], axis=1)
