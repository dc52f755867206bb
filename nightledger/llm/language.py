"""Language identification: the family first, then one-versus-one linear SVMs within it.

A text is its share of hashed byte 2- and 3-grams, as square roots, so that every
text is a vector of length one. Pairs of families, and pairs of languages of one
family, each have a linear support vector machine (squared hinge loss), fitted in
a task of its own on a bounded sample. Prediction sums the pairs' votes, weighted
by a logistic of the margin: first between families, then between the winning
family's languages.

Defined results: ``und`` with score 0 for null texts and texts without a letter,
and for all texts where no language could be learned; with one learned language
every other text is that language; ties go to the first name in order; a pair of
languages without a fit is a tie; doc_ids may be null or shared; repeated rows are
predicted each; an empty table gives no rows. Columns named like the
results are replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, raw_texts

#: Families of closely related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is"), "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk"), "indic": ("hi", "mr", "ne"),
}
SIZE = 4096
_SPACES = bytes(32 if chr(i) not in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" and i < 128 else ord(chr(i).lower()) if i < 128 else i for i in range(256))


def family_of(lang: str) -> str:
    return next((name for name, own in FAMILIES.items() if lang in own), lang)


def features(text: bytes) -> np.ndarray:
    """The square roots of the shares of hashed 2- and 3-grams."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_SPACES).split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    counts = np.bincount(two >> np.uint32(20), minlength=SIZE) + np.bincount(three >> np.uint32(20), minlength=SIZE)
    return np.sqrt(counts / max(1, counts.sum()))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1000.0, rounds: int = 200) -> np.ndarray:
    """Weights (last: the intercept) of a squared-hinge linear SVM; y is -1 or 1, classes weighted equally.

    Accelerated gradient descent with the step that the rows' length of one
    allows; one copy of x is held.
    """
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * np.float32(c)
    step = np.float32(1 / (1 + 4 * c))  # each row and its intercept have a squared norm of two, and shares sum to c
    w = before = np.zeros(x.shape[1] + 1, np.float32)
    for i in range(rounds):
        z = w + np.float32(i / (i + 3)) * (w - before)
        pull = share * y * np.maximum(0, 1 - y * (x @ z[:-1] + z[-1]))
        before, w = w, z - step * (z - 2 * np.append(x.T @ pull, pull.sum()))
    return w.astype(float)


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode(errors="replace")))


class Model:
    """The fitted pairs: {(level, a, b): weights}; positive is a."""

    def __init__(self, languages: list[str], pairs: dict):
        self.languages = sorted(languages)
        self.families = sorted({family_of(x) for x in self.languages})
        self.pairs = list(pairs)
        self.weights = np.array([pairs[p] for p in self.pairs]).reshape(len(self.pairs), SIZE + 1)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        margins = self.weights[:, :-1] @ x + self.weights[:, -1] if self.pairs else []
        p = {k: 1 / (1 + np.exp(-4 * m)) for k, m in zip(self.pairs, margins, strict=True)}

        def best(level, names):
            if len(names) == 1:
                return names[0], 1.0
            share = {a: np.mean([p[level, a, b] if (level, a, b) in p else 1 - p.get((level, b, a), 0.5) for b in names if b != a]) for a in names}
            top = max(names, key=lambda a: share[a])
            return top, share[top]

        family, sure = best("family", self.families)
        lang, also = best("language", [x for x in self.languages if family_of(x) == family])
        return lang, float(sure * also)


def fit(docs: DataFrame, training, sample: int = 500) -> Model:
    """Fits all pairs on about ``sample`` training rows of each language (all rows of a rarer one).

    The sample are the different rows whose hash of doc_id and text is below sample
    / rows of the language, and the row of the least hash; equal rows count once, so
    that no id or text makes it larger. Each classifier is fitted in its own task;
    the driver gets weights.
    """
    train = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    families = sorted({family_of(x) for x in languages})
    jobs = [("family", a, b) for a, b in combinations(families, 2)]
    jobs += [("language", a, b) for a, b in combinations(languages, 2) if family_of(a) == family_of(b)]
    if not jobs:
        return Model(languages, {})
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, sample / n).otherwise(share)
    text = F.col("text").cast("string")
    rows = train.select("lang", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).alias("h"), text.alias("text"))
    least = rows.groupBy("lang").agg(F.min(F.struct("h", "text")).alias("r")).select("lang", "r.h", "r.text")
    chosen = rows.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < share).unionByName(least).dropDuplicates(["lang", "h"]).select("lang", "text")

    def expand(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [[], [], [], []]
            for lang, text in zip(batch.column("lang").to_pylist(), raw_texts(batch), strict=True):
                x = features(text)
                at = np.flatnonzero(x)
                for i, (level, a, b) in enumerate(jobs):
                    own = lang if level == "language" else family_of(lang)
                    if own in (a, b):
                        for c, v in zip(cols, (i, 1.0 if own == a else -1.0, at.astype(np.int32), x[at]), strict=True):
                            c.append(v)
            kinds = (pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["job", "y", "at", "x"])

    def train_one(pdf):
        import pandas as pd

        x = np.zeros((len(pdf), SIZE), np.float32)
        for row, (at, v) in enumerate(zip(pdf["at"], pdf["x"], strict=True)):
            x[row, at] = v
        return pd.DataFrame({"job": [int(pdf["job"].iloc[0])], "w": [fit_svm(x, pdf["y"].to_numpy()).tolist()]})

    rows = chosen.mapInArrow(expand, "job int, y double, at array<int>, x array<double>").groupBy("job").applyInPandas(train_one, "job int, w array<double>").collect()
    return Model(languages, {jobs[r["job"]]: r["w"] for r in rows})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text and all other columns of ``docs`` with lang_pred and score; uses the text alone."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    @giving_back
    def run(batches):
        import pyarrow as pa

        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            out = [model.predict(features(t)) if model.languages and _has_letter(t) else ("und", 0.0) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
