"""Toxicity: a counterfactual-regularised logistic classifier over words and word beginnings.

Features say whether a word, or a beginning of a word of 3 to 6 bytes, occurs in the text. The
most telling ones (chi-square over labelled texts) and all identity terms are kept. Training
minimises the log loss plus a penalty on the squared change of a labelled text's score when its
identity terms (of English, French, German or Spanish) are swapped for others of the same kind, so
that a mere mention of a group carries no weight. Fitted on a bounded sample: about PER_CLASS labelled documents of each class, whole
texts; the classes' real shares are put back into the intercept.

Defined results: null text counts as the empty text (its score is that of a text without any
feature); rows with null or repeated ids are scored like any other; labels that are null, or whose
document is missing, are not learned from; without labels of both classes every score is the share
of class 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import class_sample, crc_of_id
from .textnp import OTHER, Words, batches

PER_CLASS = 2_000
FEATURES = 512
LEAST_DOCS = 3
LEAST_CHI_SQUARE = 25.0
PREFIXES = (3, 4, 5, 6)
L2 = 0.02
COUNTERFACTUAL = 5.0
THRESHOLD = 0.3

# Neutral identity terms of four languages; terms of one group are swapped for each other.
IDENTITY = (
    # English
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("she", "he"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"),
    ("young", "old", "elderly"), ("disabled", "blind", "deaf"),
    # French
    ("femmes", "hommes"), ("femme", "homme"), ("fille", "garçon"), ("filles", "garçons"), ("elle", "il"),
    ("lesbienne", "hétérosexuelle", "bisexuelle"), ("homosexuel", "hétérosexuel", "bisexuel"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmane", "chrétienne", "juive", "hindoue"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques"), ("africain", "européen", "américain", "mexicain", "chinois", "indien"),
    ("africains", "européens", "américains", "mexicains", "indiens"),
    ("immigré", "citoyen", "réfugié"), ("immigrés", "citoyens", "réfugiés"),
    ("jeunes", "vieux", "âgés"), ("handicapé", "aveugle", "sourd"), ("handicapés", "aveugles", "sourds"),
    # German
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "junge"), ("weiblich", "männlich"),
    ("lesbisch", "schwul", "heterosexuell", "bisexuell"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"), ("muslimin", "christin", "jüdin"),
    ("schwarze", "weiße", "asiatische"), ("afrikaner", "europäer", "amerikaner", "mexikaner", "chinesen", "inder"),
    ("einwanderer", "staatsbürger", "flüchtling"), ("zuwanderer", "bürger", "flüchtlinge"),
    ("jugendliche", "ältere", "alte"), ("behinderte", "blinde", "gehörlose"),
    # Spanish
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niña", "niño"), ("niñas", "niños"), ("ella", "él"),
    ("lesbiana", "heterosexual"), ("lesbianas", "heterosexuales"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"), ("musulmana", "cristiana", "judía"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos"), ("africano", "europeo", "americano", "mexicano", "chino", "indio"),
    ("africanos", "europeos", "americanos", "mexicanos", "chinos", "indios"),
    ("inmigrante", "ciudadano", "refugiado"), ("inmigrantes", "ciudadanos", "refugiados"),
    ("jóvenes", "viejos", "ancianos"), ("discapacitado", "ciego", "sordo"), ("discapacitados", "ciegos", "sordos"),
)


def swaps() -> dict[bytes, bytes]:
    """Every identity term and the next of its group."""
    return {a.encode(): g[(i + 1) % len(g)].encode() for g in IDENTITY for i, a in enumerate(g)}


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, feature) of every word and word beginning, repeats included."""
    w = Words(texts, OTHER)
    docs, keys = [w.doc], [w.hashes()]
    size = w.end - w.start
    for n in PREFIXES:
        long = size > n
        docs.append(w.doc[long])
        keys.append(w.span_hashes(w.start[long], w.start[long] + n, kind=1))
    return np.concatenate(docs), np.concatenate(keys)


def word_keys(words: list[bytes]) -> np.ndarray:
    return Words([b" ".join(words)], OTHER).hashes()


def distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, feature), each once."""
    docs, keys = [], []
    for i, j in batches(texts):
        d, k = features(texts[i:j])
        order = np.lexsort((k, d))
        d, k = d[order], k[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        docs.append(d[new] + i)
        keys.append(k[new])
    return (np.concatenate(docs), np.concatenate(keys)) if docs else (np.zeros(0, int), np.zeros(0, np.uint64))


def swapped(text: bytes, table: dict[bytes, bytes]) -> bytes | None:
    """The text (lower-cased) with its identity terms swapped; None if it has none."""
    w = Words([text], OTHER)
    out, at, found = [], 0, False
    longest = max(map(len, table), default=0)
    low = w.low.tobytes()
    for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True):
        other = table.get(low[s:e]) if e - s <= longest else None
        if other:
            out += [low[at:s], other]
            at, found = e, True
    return b"".join([*out, low[at:len(text)]]) if found else None


def chi_square(keys: np.ndarray, docs: np.ndarray, toxic: np.ndarray, n_features: int, least: int) -> np.ndarray:
    """Features in at least ``least`` texts with the largest chi-square between presence and label."""
    key, n = np.unique(keys, return_counts=True)
    key, n = key[n >= least], n[n >= least]
    if not len(key):
        return key
    place = np.minimum(np.searchsorted(key, keys), len(key) - 1)
    mine = key[place] == keys
    pos = np.bincount(place[mine], weights=toxic[docs[mine]], minlength=len(key))
    total, positives = len(toxic), float(toxic.sum())
    a, b, c, d = pos, n - pos, positives - pos, total - positives - (n - pos)
    chi = total * (a * d - b * c) ** 2 / np.maximum(1.0, (a + b) * (c + d) * (a + c) * (b + d))
    best = np.argsort(-chi, kind="stable")[:n_features]
    return key[best[chi[best] > LEAST_CHI_SQUARE]]


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.keys):
            for i, j in batches(texts):
                docs, keys = features(texts[i:j])
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                hit = self.keys[at] == keys
                pairs = np.unique(docs[hit] * len(self.keys) + at[hit])
                out[i:j] += np.bincount(pairs // len(self.keys), weights=self.weights[pairs % len(self.keys)], minlength=j - i)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def matrix(texts: list[bytes], keys: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), len(keys)))
    docs, found = distinct(texts)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    hit = keys[at] == found
    x[docs[hit], at[hit]] = 1.0
    return x


def train(texts: list[bytes], toxic: np.ndarray, share: float, n_features: int = FEATURES, least: int = LEAST_DOCS,
          l2: float = L2, counterfactual: float = COUNTERFACTUAL, rounds: int = 30) -> Model:
    """Newton steps on mean log loss + l2 |w|^2 / 2 + counterfactual * mean (w . (x - x'))^2 / 2, the
    last over the texts with identity terms. ``share``: the real share of class 1."""
    positives = float(toxic.sum())
    if not 0 < positives < len(toxic):
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    table = swaps()
    docs, keys = distinct(texts)
    chosen = np.unique(np.concatenate([chi_square(keys, docs, toxic, n_features, least), word_keys(sorted(table))]))
    x = np.hstack([matrix(texts, chosen), np.ones((len(texts), 1))])
    mentions = [(i, s) for i, t in enumerate(texts) if (s := swapped(t, table)) is not None]
    change = np.zeros((0, x.shape[1]))
    if mentions:
        change = x[[i for i, _ in mentions]] - np.hstack([matrix([s for _, s in mentions], chosen), np.ones((len(mentions), 1))])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 0.0
    penalty = counterfactual * change.T @ change / max(1, len(change))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - toxic) / len(toxic) + ridge * w / len(toxic) ** 0.5 + penalty @ w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(toxic) + np.diag(ridge / len(toxic) ** 0.5 + 1e-9) + penalty
        step = np.linalg.solve(curve, grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    drawn = positives / len(toxic)
    shift = np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)) if 0 < share < 1 else 0.0
    return Model(chosen, w[:-1], float(w[-1] + shift))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = PER_CLASS) -> Model:
    """A model from documents and labels (joined by id); the driver sees about ``per_class`` texts
    of either class, equal texts once."""
    known = labels.where(F.col(label).isin(0, 1)).select(doc_id, F.col(label).cast("int").alias("_y"))
    drawn, sizes = class_sample(known, "_y", per_class, doc_id)
    # the sample is a few thousand ids (two classes of about per_class), so it goes to the texts
    rows = (docs.where(F.col(text).isNotNull()).select(doc_id, text)
            .join(F.broadcast(drawn), doc_id).select(F.col(text), "_y").collect())
    rows = sorted({(r[0], r[1]) for r in rows})
    n = sum(sizes.values())
    return train([r[0].encode() for r in rows], np.array([r[1] for r in rows], float), sizes.get(1, 0) / n if n else 0.0)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score and predicted of every row; only the text is looked at."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # FEATURES numbers, whatever the input
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    types = dict(rows.dtypes)

    def run(parts):
        for batch in parts:
            values = shared.value.scores(batch.column(len(keep)).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(values), pa.array((values >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", score double, predicted int")


def learnable(doc_id: str):
    return F.pmod(crc_of_id(doc_id), F.lit(4)) != 2


def digest(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row, learned from labels whose crc32(id as text) mod 4 is not 2."""
    model = fit(docs, labels.where(learnable(doc_id)), doc_id, text)
    rows = docs.select(F.col(doc_id), F.col(text), (~learnable(doc_id)).alias("held_out"))
    return score(rows, model, [doc_id, "held_out"], text)
