"""A trained batch scorer of texts: a hashed-word multinomial logistic model, fitted in Spark and sent once to each worker."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The scorer's classes in the order of its probabilities.
CLASSES = ("pos", "neg", "neu")


def hashed_words(text, buckets: int) -> Column:
    """The distinct buckets of a text's words, as strings: A-Z lower-cased, words of ASCII letters and all characters beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x00-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("string")))


class HashedLogistic:
    """Texts to (p_pos, p_neg, p_neu); what ``sentiment.score_texts`` takes as its scorer.

    The weights are a broadcast variable: a worker process reads them once, whatever the number of its tasks and batches."""

    def __init__(self, weights):
        self.weights = weights

    def __call__(self, texts: list[str]) -> list[tuple[float, float, float]]:
        matrix, bias = self.weights.value
        z = np.empty((len(texts), len(bias)))
        for i, text in enumerate(texts):
            lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
            at = {zlib.crc32(w.encode("utf-8", "surrogatepass")) % matrix.shape[1] for w in re.split(r"[\x00-\x60\x7B-\x7F]+", lower) if w}
            z[i] = bias + matrix[:, sorted(at)].sum(1)
        p = np.exp(z - z.max(1, keepdims=True)) if len(texts) else z
        return [tuple(row) for row in p / p.sum(1, keepdims=True)]


def fit_text_scorer(rows: DataFrame, text: str, label: str, buckets: int = 4096, penalty: float = 0.01, sparse: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x buckets) and biases of a model on all labelled rows; ``label`` is one of CLASSES, null rows don't count.
    ``sparse`` is the share of the penalty on absolute weights, which sets those of telltale words apart from the many others'.

    What the driver holds is classes x buckets numbers, whatever the number of rows."""
    code = F.coalesce(*(F.when(F.col(label) == c, F.lit(float(i))) for i, c in enumerate(CLASSES)))
    made = rows.select(code.alias("label"), hashed_words(F.col(text), buckets).alias("words")).filter("label is not null")
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], "words", "features").transform(made)
    fit = LogisticRegression(family="multinomial", regParam=penalty, elasticNetParam=sparse, maxIter=100).fit(vectors)
    matrix, bias = np.zeros((len(CLASSES), buckets)), np.full(len(CLASSES), -1e3)  # a class without rows has no probability
    matrix[: fit.numClasses], bias[: fit.numClasses] = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    return matrix, bias


def load_scorer(spark: SparkSession, path: str) -> HashedLogistic:
    """The scorer of weights that ``save_weights`` wrote."""
    w = spark.read.parquet(path).orderBy("class").collect()
    return HashedLogistic(spark.sparkContext.broadcast((np.array([r.weights for r in w]), np.array([r.bias for r in w]))))


def save_weights(spark: SparkSession, weights: tuple[np.ndarray, np.ndarray], path: str) -> None:
    matrix, bias = weights
    spark.createDataFrame([(i, row.tolist(), float(b)) for i, (row, b) in enumerate(zip(matrix, bias, strict=True))], "class int, weights array<double>, bias double").coalesce(1).write.mode("overwrite").parquet(path)
