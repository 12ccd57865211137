"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines.

A text becomes the square roots of the relative frequencies of its hashed character 1- to 3-grams (lower case,
runs of non-letters as one blank), a unit vector. A multinomial logistic regression predicts the family.
Inside a family every two languages have a linear support vector machine; the language with most
votes wins, ties by the summed margins, then by name. Both are trained by Spark on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

UNDETERMINED = "und"
BUCKETS = 2048
SAMPLE = 1000
"""At most so many labelled documents of each language are used for training."""
PIECE = 1 << 20

# Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "malayo-polynesian": ("id", "jv", "mg", "ms", "tl"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def features(text: str | None) -> np.ndarray | None:
    """The unit feature vector of a text; None if it is null or has no letter."""
    if not text:
        return None
    letters, total, seen = _letters(), np.zeros(BUCKETS), False
    tail = np.empty(0, np.uint32)
    for start in range(0, len(text), PIECE):
        low = text[start:start + PIECE].lower()
        codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
        kept = letters[codes]
        seen = seen or bool(kept.any())
        codes = np.where(kept, codes, np.uint32(32))
        blank = codes == 32
        codes = np.concatenate([tail, codes[~(blank & np.concatenate([[False], blank[:-1]]))]])
        for n in (1, 2, 3):
            if len(codes) < n:
                continue
            mixed = np.full(len(codes) - n + 1, n, np.uint32)
            for i in range(n):
                mixed = (mixed ^ codes[i:len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            total += np.bincount(mixed & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        tail = codes[-2:]
    return np.sqrt(total / total.sum()) if seen else None


@dataclass
class Model:
    """Weights of the families and of every two languages of a family."""

    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    family_bias: np.ndarray | None = None
    pairs: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.families:
            return UNDETERMINED, 0.0
        share, family = 1.0, self.families[0]
        if self.family_weights is not None:
            z = self.family_weights @ x + self.family_bias
            p = np.exp(z - z.max())
            best = int(p.argmax())
            share, family = float(p[best] / p.sum()), self.families[best]
        langs = self.langs[family]
        if len(langs) == 1:
            return langs[0], share
        weights, bias = self.pairs[family]
        votes = np.zeros((len(langs), 3))  # votes, margins, certainty
        for (i, j), m in zip(combinations(range(len(langs)), 2), weights @ x + bias, strict=True):
            sure = 1.0 / (1.0 + np.exp(-2.0 * np.clip(m, -30, 30)))
            votes[i] += (m > 0, m, sure)
            votes[j] += (m <= 0, -m, 1.0 - sure)
        best = max(range(len(langs)), key=lambda k: (votes[k, 0], votes[k, 1], -k))
        return langs[best], share * float(votes[best, 2]) / (len(langs) - 1)


def held_out(key: Column) -> Column:
    """Whether a document takes no part in training: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, text: str, lang: str, key: str, limit: int) -> DataFrame:
    """(lang, x): features of at most ``limit`` labelled documents of each language, chosen by a hash of the key.

    The chosen share of a language comes from its count, so that the exact cut at ``limit`` sees about twice
    as many rows as it keeps, however many there are.
    """
    labelled = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")) & F.col("text").rlike(r"\p{L}"))
    counts = stored(labelled.groupBy("lang").agg(F.count("*").alias("count")), "counts")
    draw = F.pmod(F.xxhash64(F.lit(17), F.col("key").cast("string")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    first = Window.partitionBy("lang").orderBy("draw", "key", "text")
    chosen = (labelled.withColumn("draw", draw).join(counts, "lang")
              .where(F.col("draw") * F.col("count") <= 2.0 * limit)
              .withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit))

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return chosen.select("lang", vectors("text").alias("x")).where("x is not null")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", limit: int = SAMPLE) -> Model:
    """The model learned from labelled documents that are not held out; no labelled document gives no language."""
    # imported here, as the workers that predict need none of it
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    sample = stored(training_sample(docs, text, lang, key, limit), "sample").withColumn("x", array_to_vector("x"))
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    model = Model(families=sorted({family_of(x) for x in langs}))
    model.langs = {f: [x for x in langs if family_of(x) == f] for f in model.families}

    def index(values: dict[str, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col("lang")).cast("double")

    if len(model.families) > 1:
        of = {x: model.families.index(family_of(x)) for x in langs}
        fit = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-4, maxIter=60, standardization=False)
        found = fit.fit(sample.withColumn("y", index(of)))
        model.family_weights, model.family_bias = found.coefficientMatrix.toArray(), found.interceptVector.toArray()
    for family, own in model.langs.items():
        weights, bias = [], []
        for a, b in combinations(own, 2):
            fit = LinearSVC(featuresCol="x", labelCol="y", regParam=1e-4, maxIter=60, standardization=False)
            found = fit.fit(sample.where(F.col("lang").isin(a, b)).withColumn("y", index({a: 1, b: 0})))
            weights.append(found.coefficients.toArray())
            bias.append(found.intercept)
        if weights:
            model.pairs[family] = np.array(weights), np.array(bias)
    return model


def identified(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The column (lang_pred, score) for the whole texts of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        model = sent.value
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    return predict(F.col(text).cast("string"))


def op2_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing is labelled.
    A null doc_id is not held out and not learned from. Repeated rows are kept, an empty table gives no rows.
    """
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identified(docs, train(docs)).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")
