"""Model math in NumPy: DeepFM, attentional FM and multi-gate mixture of experts.

Used inside ``mapInPandas`` tasks (scoring) and per-partition gradient sums (training):
Spark partitions the rows, these functions only process one Arrow batch at a time.
Parameters are a ``dict[str, np.ndarray]`` — small, broadcast to every task.

Methods follow the public papers: Factorization Machines (Rendle 2010), DeepFM (Guo et al.
2017), Attentional FM (Xiao et al. 2017), MMoE (Ma et al. 2018), Layer Norm (Ba et al. 2016).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LN_EPS = 1e-12


@dataclass(frozen=True)
class Dims:
    feature_dim: int
    field_size: int
    emb_dim: int = 8
    deep_layers: tuple[int, ...] = (32, 32)
    use_fm: bool = True
    use_deep: bool = True
    attention_size: int = 4
    attention_mode: str = "as_reference"   # or "paper"
    num_experts: int = 4
    units: int = 16
    task_hidden: tuple[int, ...] = (2, 4, 2)
    task_weights: tuple[float, float] = (0.5, 0.5)
    extra: dict = field(default_factory=dict, compare=False)


# ------------------------------------------------------------------ parity (formula) weights
def f_emb(i, k):
    return ((i * 31 + k * 17) % 101) / 101.0 - 0.5


def f_w1(i):
    return ((i * 13 + 7) % 97) / 97.0 - 0.5


def f_dense(layer, i, j):
    return ((i * 7 + j * 13 + layer * 5) % 29) / 29.0 - 0.5


def f_bias(layer, j):
    return ((j * 3 + layer) % 7) / 7.0 - 0.5


def f_expert(d, u, x):
    return ((d * 7 + u * 13 + x * 5) % 31) / 31.0 - 0.5


def f_att_h(t):
    return ((t * 5 + 1) % 7) / 7.0 - 0.5


def f_ln_scale(k):
    return 0.5 + ((k * 5 + 3) % 11) / 11.0


def f_ln_shift(k):
    return ((k * 7 + 2) % 13) / 13.0 - 0.5


def _grid(fn, *shape):
    idx = np.indices(shape)
    return fn(*idx).astype(np.float64)


def parity_params(model: str, d: Dims) -> dict[str, np.ndarray]:
    """Deterministic integer-formula weights; the oracle SQL generates the same numbers."""
    F_, K = d.field_size, d.emb_dim
    p = {"emb": _grid(f_emb, d.feature_dim, K), "w1": _grid(f_w1, d.feature_dim)}
    if model == "deepfm":
        sizes = [F_ * K, *d.deep_layers]
        for l in range(len(d.deep_layers)):
            p[f"W{l}"] = _grid(lambda i, j, l=l: f_dense(l, i, j), sizes[l], sizes[l + 1])
            p[f"b{l}"] = _grid(lambda j, l=l: f_bias(l, j), sizes[l + 1])
        n_in = (F_ + K if d.use_fm else 0) + (d.deep_layers[-1] if d.use_deep else 0)
        p["Wout"] = _grid(lambda i: f_dense(9, i, 0), n_in)
        p["bout"] = np.array(0.01)
        p["ln_scale"], p["ln_shift"] = _grid(f_ln_scale, K), _grid(f_ln_shift, K)
    elif model == "afm":
        p["Wf"] = _grid(lambda i: f_dense(20, i, 0), F_)
        p["bf"] = np.array(f_bias(20, 0))
        p["Ws"] = _grid(lambda k: f_dense(21, k, 0), K)
        p["bs"] = np.array(f_bias(21, 0))
        p["Wa"] = _grid(lambda k: f_dense(22, k, 0), K)
        p["ba"] = np.array(f_bias(22, 0))
        p["Watt"] = _grid(lambda k, t: f_dense(10, k, t), K, d.attention_size)
        p["batt"] = _grid(lambda t: f_bias(10, t), d.attention_size)
        p["hatt"] = _grid(f_att_h, d.attention_size)
    elif model == "mmoe":
        D_ = F_ * K
        p["Wexp"] = _grid(f_expert, D_, d.units, d.num_experts)
        p["bexp"] = _grid(lambda x: f_bias(30, x), d.num_experts)
        for g in (1, 2):
            p[f"Wg{g}"] = _grid(lambda i, x, g=g: f_dense(30 + g, i, x), D_, d.num_experts)
            p[f"bg{g}"] = _grid(lambda x, g=g: f_bias(30 + g, x), d.num_experts)
            sizes = [d.units, *d.task_hidden, 1]
            for l in range(len(sizes) - 1):
                lid = 40 + 10 * g + l
                p[f"T{g}_{l}"] = _grid(lambda i, j, lid=lid: f_dense(lid, i, j), sizes[l], sizes[l + 1])
                p[f"c{g}_{l}"] = _grid(lambda j, lid=lid: f_bias(lid, j), sizes[l + 1])
    else:
        raise ValueError(model)
    return p


# ------------------------------------------------------------------ building blocks
def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))


def relu(z):
    return np.maximum(z, 0.0)


def softmax(z, axis=-1):
    z = z - z.max(axis=axis, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=axis, keepdims=True)


def layer_norm(x, eps=LN_EPS):
    mu = x.mean(axis=-1, keepdims=True)
    var = ((x - mu) ** 2).mean(axis=-1, keepdims=True)
    return (x - mu) / np.sqrt(var + eps)


def embed(p, xi, xv):
    """(n, F) ids and values → (n, F, K) scaled embeddings."""
    return p["emb"][xi] * xv[..., None]


def fm_first(p, xi, xv):
    return p["w1"][xi] * xv


def fm_second(e):
    s = e.sum(axis=1)
    return 0.5 * (s * s - (e * e).sum(axis=1))


def pair_products(e):
    i, j = np.triu_indices(e.shape[1], k=1)
    return e[:, i, :] * e[:, j, :]


# ------------------------------------------------------------------ forward passes
def deepfm_forward(p, d: Dims, xi, xv):
    e = layer_norm(embed(p, xi, xv)) * p["ln_scale"] + p["ln_shift"]
    parts = []
    if d.use_fm:
        parts += [fm_first(p, xi, xv), fm_second(e)]
    if d.use_deep:
        h = e.reshape(len(xi), -1)
        for l in range(len(d.deep_layers)):
            h = relu(h @ p[f"W{l}"] + p[f"b{l}"])
        parts.append(h)
    z = np.concatenate(parts, axis=1) @ p["Wout"] + p["bout"]
    return sigmoid(z)


def afm_attention(p, d: Dims, pairs):
    if d.attention_mode == "as_reference":
        # the reference's softmax runs over an axis of size one: every weight is 1
        return np.ones(pairs.shape[:2])
    hidden = relu(pairs @ p["Watt"] + p["batt"])
    return softmax(hidden @ p["hatt"], axis=1)


def afm_forward(p, d: Dims, xi, xv):
    e = embed(p, xi, xv)
    y1 = fm_first(p, xi, xv) @ p["Wf"] + p["bf"]
    y2 = fm_second(e) @ p["Ws"] + p["bs"]
    if d.attention_mode == "as_reference":
        afm = fm_second(e)  # every pair weight is 1: the sum of the pairs, without the pairs
    else:
        pairs = pair_products(e)
        a = afm_attention(p, d, pairs)
        afm = (a[..., None] * pairs).sum(axis=1)
    ya = afm @ p["Wa"] + p["ba"]
    return sigmoid(y1 + y2 + ya)


def mmoe_heads(p, d: Dims, xi, xv):
    x = embed(p, xi, xv).reshape(len(xi), -1)
    experts = relu(np.einsum("nd,dux->nux", x, p["Wexp"]) + p["bexp"])
    scores = []
    for g in (1, 2):
        gate = softmax(x @ p[f"Wg{g}"] + p[f"bg{g}"])
        h = (experts * gate[:, None, :]).sum(axis=2)
        n_layers = len(d.task_hidden) + 1
        for l in range(n_layers):
            h = h @ p[f"T{g}_{l}"] + p[f"c{g}_{l}"]
            if l < n_layers - 1:
                h = relu(h)
        scores.append(sigmoid(h[:, 0]))
    return scores[0], scores[1]


def mmoe_forward(p, d: Dims, xi, xv):
    s1, s2 = mmoe_heads(p, d, xi, xv)
    return d.task_weights[0] * s1 + d.task_weights[1] * s2


FORWARD = {"deepfm": deepfm_forward, "afm": afm_forward, "mmoe": mmoe_forward}


# ------------------------------------------------------------------ training: loss and gradients
LOSS_EPS = 1e-7


def log_loss_terms(p, y, eps=LOSS_EPS):
    """Per-row log loss with the metric library's epsilon, and dLoss/dp."""
    loss = -y * np.log(p + eps) - (1 - y) * np.log(1 - p + eps)
    dp = -y / (p + eps) + (1 - y) / (1 - p + eps)
    return loss, dp


def hash_fractions(keys, units, step: int, salt: int):
    """Numbers in [0, 1) from a hash of (row key, step, unit); ``keys`` and ``units`` are uint64 arrays that
    broadcast."""
    with np.errstate(over="ignore"):
        h = (keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) * np.uint64(0xBF58476D1CE4E5B9)
             + units * np.uint64(0x94D049BB133111EB) + np.uint64(salt) * np.uint64(0x2545F4914F6CDD1D))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86655D5A9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def hash_mask(keys, step: int, salt: int, width: int, rate: float):
    """Inverted-dropout mask (n, width) from a hash of (row key, step, unit): the same rows
    get the same mask whatever the partitioning."""
    if rate <= 0:
        return np.ones((len(keys), width))
    k = np.asarray(keys, dtype=np.uint64)[:, None]
    u = np.arange(width, dtype=np.uint64)[None, :]
    return (hash_fractions(k, u, step, salt) >= rate) / (1.0 - rate)


def _scatter(shape, idx, vals):
    """Sums of ``vals`` by index, a column of the weights at a time, added in the rows' order."""
    idx = idx.ravel()
    if len(shape) == 1:
        return np.bincount(idx, vals.ravel(), shape[0])
    g = np.empty(shape)
    for k in range(shape[1]):
        g[:, k] = np.bincount(idx, vals[..., k].ravel(), shape[0])
    return g


def _ln_backward(de, e, inv):
    m1 = de.mean(axis=-1, keepdims=True)
    m2 = (de * e).mean(axis=-1, keepdims=True)
    return inv * (de - m1 - e * m2)


def deepfm_grad(p, d: Dims, xi, xv, y, drop=None):
    """Sum over rows of the two-head loss (both heads share the score) and its gradient.
    ``drop``: dict of dropout masks (training) or None (evaluation)."""
    n, F_, K = len(xi), d.field_size, d.emb_dim
    drop = drop or {}
    e0 = embed(p, xi, xv)
    mu = e0.mean(axis=-1, keepdims=True)
    var = ((e0 - mu) ** 2).mean(axis=-1, keepdims=True)
    inv = 1.0 / np.sqrt(var + LN_EPS)
    norm = (e0 - mu) * inv
    e = norm * p["ln_scale"] + p["ln_shift"]
    parts, acts = [], []
    if d.use_fm:
        y1 = fm_first(p, xi, xv) * drop.get("fm0", 1.0)
        s = e.sum(axis=1)
        y2 = 0.5 * (s * s - (e * e).sum(axis=1)) * drop.get("fm1", 1.0)
        parts += [y1, y2]
    if d.use_deep:
        h = e.reshape(n, -1) * drop.get("deep0", 1.0)
        acts.append(h)
        for l in range(len(d.deep_layers)):
            a = h @ p[f"W{l}"] + p[f"b{l}"]
            h = relu(a) * drop.get(f"deep{l + 1}", 1.0)
            acts.append((a, h))
        parts.append(h)
    cat = np.concatenate(parts, axis=1)
    z = cat @ p["Wout"] + p["bout"]
    prob = sigmoid(z)
    l1, dp1 = log_loss_terms(prob, y)
    loss = 2.0 * l1.sum()
    dz = 2.0 * dp1 * prob * (1 - prob)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["Wout"] = cat.T @ dz
    g["bout"] = np.array(dz.sum())
    dcat = dz[:, None] * p["Wout"][None, :]
    de = np.zeros_like(e)
    off = 0
    if d.use_fm:
        dy1 = dcat[:, :F_] * drop.get("fm0", 1.0)
        dy2 = dcat[:, F_:F_ + K] * drop.get("fm1", 1.0)
        off = F_ + K
        g["w1"] = _scatter(p["w1"].shape, xi, dy1 * xv)
        de += dy2[:, None, :] * (s[:, None, :] - e)
    if d.use_deep:
        dh = dcat[:, off:]
        for l in reversed(range(len(d.deep_layers))):
            a, _ = acts[l + 1]
            h_in = acts[0] if l == 0 else acts[l][1]
            da = dh * drop.get(f"deep{l + 1}", 1.0) * (a > 0)
            g[f"W{l}"] = h_in.T @ da
            g[f"b{l}"] = da.sum(axis=0)
            dh = da @ p[f"W{l}"].T
        de += (dh * drop.get("deep0", 1.0)).reshape(n, F_, K)
    g["ln_scale"], g["ln_shift"] = (de * norm).sum(axis=(0, 1)), de.sum(axis=(0, 1))
    de0 = _ln_backward(de * p["ln_scale"], norm, inv)
    g["emb"] = _scatter(p["emb"].shape, xi, de0 * xv[..., None])
    return loss, g


def _kept_neighbours(keep, e, ii, jj):
    """(n, F, K): for every field, the sum over the other fields of their embeddings times the pair's mask."""
    mask = np.zeros((len(e), e.shape[1], e.shape[1]))
    mask[:, ii, jj] = keep
    mask[:, jj, ii] = keep
    return mask @ e


def afm_grad(p, d: Dims, xi, xv, y, drop=None):
    """Attentional FM. ``as_reference``: every pair weight is 1, so the pair sum equals the
    FM second order; ``paper``: a = softmax over pairs of h · relu(W p + b). With dropout the
    pair weights are masked (mask ``att``), and the pairs are needed in either mode."""
    drop = drop or {}
    n, F_ = xi.shape
    keep = drop.get("att")
    plain = d.attention_mode == "as_reference" and keep is None
    e = embed(p, xi, xv)
    f1 = fm_first(p, xi, xv) * drop.get("fm0", 1.0)
    s = e.sum(axis=1)
    q = 0.5 * (s * s - (e * e).sum(axis=1))
    q2 = q * drop.get("fm1", 1.0)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    ii, jj = np.triu_indices(F_, k=1)
    if plain:
        afm = q
    elif d.attention_mode == "as_reference":
        near = _kept_neighbours(keep, e, ii, jj)            # every kept pair meets both its fields
        afm = 0.5 * np.einsum("nfk,nfk->nk", e, near)
    else:
        P = e[:, ii, :] * e[:, jj, :]                       # (n, M, K)
        keep = np.ones(P.shape[:2]) if keep is None else keep
        pre = P @ p["Watt"] + p["batt"]                     # (n, M, T)
        H = relu(pre)
        a = softmax(H @ p["hatt"], axis=1)                  # (n, M)
        afm = ((a * keep)[..., None] * P).sum(axis=1)
    z = f1 @ p["Wf"] + p["bf"] + q2 @ p["Ws"] + p["bs"] + afm @ p["Wa"] + p["ba"]
    prob = sigmoid(z)
    l1, dp1 = log_loss_terms(prob, y)
    loss = 2.0 * l1.sum()
    dz = 2.0 * dp1 * prob * (1 - prob)
    g["Wf"], g["bf"] = f1.T @ dz, np.array(dz.sum())
    g["Ws"], g["bs"] = q2.T @ dz, np.array(dz.sum())
    g["Wa"], g["ba"] = afm.T @ dz, np.array(dz.sum())
    df1 = dz[:, None] * p["Wf"][None, :] * drop.get("fm0", 1.0)
    g["w1"] = _scatter(p["w1"].shape, xi, df1 * xv)
    dq = dz[:, None] * p["Ws"][None, :] * drop.get("fm1", 1.0)
    dafm = dz[:, None] * p["Wa"][None, :]
    if plain:
        dq = dq + dafm
        de = dq[:, None, :] * (s[:, None, :] - e)
    elif d.attention_mode == "as_reference":
        de = dq[:, None, :] * (s[:, None, :] - e) + dafm[:, None, :] * near
    else:
        de = dq[:, None, :] * (s[:, None, :] - e)
        da = (P * dafm[:, None, :]).sum(axis=2) * keep      # (n, M)
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["hatt"] = np.einsum("nmt,nm->t", H, ds)
        dpre = ds[..., None] * p["hatt"] * (pre > 0)
        g["Watt"] = np.einsum("nmk,nmt->kt", P, dpre)
        g["batt"] = dpre.sum(axis=(0, 1))
        dP = (a * keep)[..., None] * dafm[:, None, :] + dpre @ p["Watt"].T
        for m, (i, j) in enumerate(zip(ii, jj)):
            de[:, i] += dP[:, m] * e[:, j]
            de[:, j] += dP[:, m] * e[:, i]
    g["emb"] = _scatter(p["emb"].shape, xi, de * xv[..., None])
    return loss, g


def mmoe_grad(p, d: Dims, xi, xv, y, drop=None):
    n = len(xi)
    x = embed(p, xi, xv).reshape(n, -1)
    A = np.einsum("nd,dux->nux", x, p["Wexp"]) + p["bexp"]
    E = relu(A)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dE = np.zeros_like(E)
    dx = np.zeros_like(x)
    loss = 0.0
    n_layers = len(d.task_hidden) + 1
    for t in (1, 2):
        G = softmax(x @ p[f"Wg{t}"] + p[f"bg{t}"])
        h = (E * G[:, None, :]).sum(axis=2)
        ins, pre = [h], []
        for l in range(n_layers):
            a = ins[-1] @ p[f"T{t}_{l}"] + p[f"c{t}_{l}"]
            pre.append(a)
            ins.append(relu(a) if l < n_layers - 1 else a)
        prob = sigmoid(ins[-1][:, 0])
        lt, dpt = log_loss_terms(prob, y)
        loss += lt.sum()
        da = (dpt * prob * (1 - prob))[:, None]
        for l in reversed(range(n_layers)):
            if l < n_layers - 1:
                da = da * (pre[l] > 0)
            g[f"T{t}_{l}"] = ins[l].T @ da
            g[f"c{t}_{l}"] = da.sum(axis=0)
            da = da @ p[f"T{t}_{l}"].T
        dh = da
        dE += dh[:, :, None] * G[:, None, :]
        dG = (dh[:, :, None] * E).sum(axis=1)
        dzg = G * (dG - (dG * G).sum(axis=1, keepdims=True))
        g[f"Wg{t}"] = x.T @ dzg
        g[f"bg{t}"] = dzg.sum(axis=0)
        dx += dzg @ p[f"Wg{t}"].T
    dA = dE * (A > 0)
    g["Wexp"] = np.einsum("nd,nux->dux", x, dA)
    g["bexp"] = dA.sum(axis=(0, 1))
    dx += np.einsum("nux,dux->nd", dA, p["Wexp"])
    g["emb"] = _scatter(p["emb"].shape, xi, dx.reshape(xv.shape + (-1,)) * xv[..., None])
    return loss, g


GRAD = {"deepfm": deepfm_grad, "afm": afm_grad, "mmoe": mmoe_grad}


def mask_widths(model: str, d: Dims) -> dict[str, int]:
    """Units of every block that may be dropped in training."""
    widths = {"fm0": d.field_size, "fm1": d.emb_dim}
    if model == "afm":
        widths["att"] = d.field_size * (d.field_size - 1) // 2
    else:
        widths["deep0"] = d.field_size * d.emb_dim
        for l, w in enumerate(d.deep_layers):
            widths[f"deep{l + 1}"] = w
    return widths


def dropout_masks(model: str, d: Dims, keys, step: int, rates: dict) -> dict:
    """Training-time masks per block (rates: fm0, fm1, att, deep0, deep1, ...)."""
    if model == "mmoe" or not rates:
        return {}
    widths = mask_widths(model, d)
    return {k: hash_mask(keys, step, i + 1, widths[k], r)
            for i, (k, r) in enumerate(sorted(rates.items())) if k in widths and r > 0}


def init_params(model: str, d: Dims, seed: int) -> dict:
    """Seeded initial weights (normal embeddings, Glorot-scaled dense layers)."""
    rng = np.random.default_rng(seed)
    p = parity_params(model, d)
    out = {}
    for k, v in p.items():
        shape = np.shape(v)
        if k in ("emb", "w1"):
            out[k] = rng.normal(0.0, 0.1, shape)
        elif len(shape) >= 2:
            out[k] = rng.normal(0.0, np.sqrt(2.0 / (shape[0] + shape[-1])), shape)
        elif k == "bout":
            out[k] = np.array(0.01)
        elif k == "ln_scale":
            out[k] = np.ones(shape)
        else:
            out[k] = np.zeros(shape)
    return out
