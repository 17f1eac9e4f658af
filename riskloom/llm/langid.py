"""Language identification: family first, then one-versus-one linear SVMs inside the family.

Features are the shares of hashed byte 1- to 3-grams of the lower-cased text. A linear score is
then a mean of weights over the text's n-grams, so scoring needs one gather per n-gram and no
feature vector. Classifiers between families, and between the languages of each family, are
linear support vector machines (squared hinge, dual coordinate descent), fitted on a bounded
sample: about PER_LANGUAGE labelled documents of every language, whole texts.

Defined results: null text, or text without a letter, is ``und`` with score 0, and so is
everything if no labelled document can be learned from; with one language all else is that
language; rows with null or repeated ids are predicted like any other; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import class_sample, crc_of_id
from .textnp import LOWER, batches

PER_LANGUAGE = 400
BITS = 13
GRAMS = 3

# Families of common languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk", "uz", "tt"),
    "celtic": ("ga", "gd", "cy", "br"), "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne", "si"),
    "iranian": ("fa", "ku", "ps", "tg"), "semitic": ("ar", "he", "mt", "am"),
    "dravidian": ("ta", "te", "kn", "ml"), "austronesian": ("id", "ms", "tl", "jv", "mg"),
    "sinitic": ("zh",), "japonic": ("ja",), "koreanic": ("ko",),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].split("_")[0].lower(), lang)


class Grams:
    """Hashed n-grams of a list of texts: bin per position and order, and where texts begin."""

    def __init__(self, texts: list[bytes]):
        joined = b" " + b"  ".join(texts) + b"  "
        raw = LOWER[np.frombuffer(joined, np.uint8)]
        # capitals of the Latin-1 range: second byte 0x80..0x9E after 0xC3
        capital = np.zeros(len(raw), bool)
        capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        raw = np.where(capital, raw + 32, raw).astype(np.uint32)
        raw[(raw >= 9) & (raw <= 13)] = 32
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        n = int(self.end[-1])
        self.bins = []
        for order in range(1, GRAMS + 1):
            code = np.full(n, order, np.uint32)
            for k in range(order):
                part = raw[k:n + k]
                code[: len(part)] = code[: len(part)] * np.uint32(0x01000193) ^ part
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x2C1B3C6D)
            code ^= code >> np.uint32(12)
            self.bins.append((code >> np.uint32(3)) & np.uint32((1 << BITS) - 1))
        self.counts = (GRAMS * sizes - GRAMS * (GRAMS - 1) // 2).astype(np.float64)

    def inside(self, order: int) -> np.ndarray:
        """Positions whose n-gram lies inside one text."""
        ok = np.ones(int(self.end[-1]), bool)
        for k in range(1, order):
            ok[self.end - k] = False
        return ok

    def means(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of every text's n-grams, per classifier (columns of ``weights``)."""
        total = np.zeros((len(self.begin), weights.shape[1]))
        for order, bins in enumerate(self.bins, 1):
            w = weights[bins].astype(np.float64)
            w[~self.inside(order)] = 0
            total += np.add.reduceat(w, self.begin, axis=0)
        return total / self.counts[:, None]

    def shares(self) -> np.ndarray:
        """Share of every bin, per text."""
        out = np.zeros((len(self.begin), 1 << BITS), np.float32)
        owner = np.repeat(np.arange(len(self.begin)), self.end - self.begin)
        for order, bins in enumerate(self.bins, 1):
            ok = self.inside(order)
            flat = np.bincount(owner[ok] * (1 << BITS) + bins[ok], minlength=out.size)
            out += flat.reshape(out.shape)
        return out / self.counts[:, None].astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge) by dual coordinate descent over the Gram
    matrix. Features are centred and scaled by one number; both are folded into the result."""
    centre = x.mean(axis=0)
    z = x - centre
    scale = 1.0 / max(float(np.sqrt((z * z).sum(axis=1)).mean()), 1e-12)
    z = z * scale
    gram = z @ z.T + 1.0  # the bias is a constant feature
    balance = {s: len(y) / (2.0 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    extra = np.array([1.0 / (2.0 * c * balance[int(s)]) for s in y])
    alpha = np.zeros(len(y))
    margin = np.zeros(len(y))  # gram @ (alpha * y)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            grad = y[i] * margin[i] - 1.0 + extra[i] * alpha[i]
            new = max(0.0, alpha[i] - grad / (gram[i, i] + extra[i]))
            if new != alpha[i]:
                margin += (new - alpha[i]) * y[i] * gram[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    w = (alpha * y) @ z * scale
    return w.astype(np.float32), float((alpha * y).sum() - w @ centre)


class Model:
    """Languages by family, and a linear score per pair of families and per pair of languages
    of one family."""

    def __init__(self, families: dict[str, list[str]], pairs: list[tuple], weights: np.ndarray, bias: np.ndarray):
        self.families, self.pairs, self.weights, self.bias = families, pairs, weights, bias

    @classmethod
    def fit(cls, langs: list[str], texts: list[str]) -> Model:
        families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            families.setdefault(family_of(lang), []).append(lang)
        groups = [("family", sorted(families))] + [(f, ls) for f, ls in sorted(families.items())]
        pairs = [(level, a, b) for level, names in groups for a, b in combinations(names, 2)]
        if not pairs:
            return cls(families, [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
        data = [t.encode() for t in texts]
        x = np.concatenate([Grams(data[i:j]).shares() for i, j in batches(data, 1 << 18)])
        lang = np.array(langs)
        family = np.array([family_of(v) for v in langs])
        fitted = []
        for level, a, b in pairs:
            value = family if level == "family" else lang
            mine = (value == a) | (value == b)
            fitted.append(svm(x[mine], np.where(value[mine] == a, 1.0, -1.0)))
        return cls(families, pairs, np.stack([w for w, _ in fitted], axis=1), np.array([b for _, b in fitted]))

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: index of the name with most wins (ties: larger sum of margins) and how sure."""
        wins = np.zeros((len(margins), len(names)))
        sums = np.zeros((len(margins), len(names)))
        for k, (lev, a, b) in enumerate(self.pairs):
            if lev == level:
                ia, ib = names.index(a), names.index(b)
                m = np.clip(margins[:, k], -20, 20)
                wins[:, ia] += m >= 0
                wins[:, ib] += m < 0
                sums[:, ia] += m
                sums[:, ib] -= m
        best = np.argmax(wins + sums / (1e-9 + 2 * np.abs(sums).max(initial=1.0)) * 0.5, axis=1)
        sure = sums[np.arange(len(best)), best] / max(1, len(names) - 1)
        return best, np.where(len(names) > 1, 1.0 / (1.0 + np.exp(-2.0 * sure)), 1.0)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        langs: list[str] = []
        scores = []
        names = sorted(self.families)
        for i, j in batches(texts):
            margins = Grams(texts[i:j]).means(self.weights) + self.bias if self.pairs else np.zeros((j - i, 0))
            family, sure = self._vote("family", names, margins)
            out = np.empty(j - i, object)
            for f, name in enumerate(names):
                mine = family == f
                if mine.any():
                    lang, within = self._vote(name, self.families[name], margins[mine])
                    out[mine] = np.array(self.families[name], object)[lang]
                    sure[mine] *= within
            langs += list(out)
            scores.append(sure)
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the rows with text and language; the driver sees about ``per_language`` texts
    of each language."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sample, _ = class_sample(known.select(doc_id, text, lang), lang, per_language, doc_id)
    rows = sorted((r[0], r[1]) for r in sample.select(lang, text).collect())
    return Model.fit([r[0] for r in rows], [r[1] for r in rows]) if rows else None


def predict(df: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score of every row; only the text is looked at."""
    spark = df.sparkSession
    ship_package(spark)
    if model is None:
        return df.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # bins x pairs of languages, whatever the input
    rows = df.select(*keep, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_text"))
    types = dict(rows.dtypes)

    def run(parts):
        for batch in parts:
            texts = batch.column(len(keep)).cast(pa.binary()).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            langs, scores = shared.value.predict([texts[i] for i in at])
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for i, value in zip(at, langs, strict=True):
                pred[i] = value
            score[at] = scores
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", lang_pred string, score double")


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predictions for every row, learned from rows whose crc32(id as text) mod 3 is not 1."""
    held_out = F.pmod(crc_of_id(doc_id), F.lit(3)) == 1
    model = fit(df.where(~held_out), doc_id, text, lang)
    return predict(df.select(F.col(doc_id), F.col(text), held_out.alias("held_out")), model, [doc_id, "held_out"], text)
