"""Quality scores from a regularised quadratic discriminant.

A text is described by FEATURES statistics, each transformed to be of the order of one. Each class has a mean and a
covariance, shrunk towards the pooled covariance and then towards a multiple of the identity; a score is the logistic
of the difference of the classes' log densities, Mahalanobis terms taken through inverted Cholesky factors that are
computed once. Class sums are aggregated in Spark over every labelled row; the driver only sees them.

Defined results: null texts count as empty and are scored like any other; rows without a label or with a null label
don't teach; several labels of one id each count; if a class has fewer than two rows every score is the share of
class 1 among the labels (one half without labels); repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, ship, stored

#: Classes of bytes: other, upper case, lower case, digit, space, line end, stop, exclamation, bar, other punctuation, beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[32], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 10
_KIND[[33, 35, 36, 37, 38, 40, 41, 42, 43, 45, 47, 58, 59, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = 9
_KIND[[44, 46, 63]], _KIND[33], _KIND[124] = 6, 7, 8
PRIOR_BYTES, PRIOR_WORDS = 100, 20
FEATURES = ("size", "upper", "digit", "line_end", "stop", "exclamation", "bar", "punctuation", "word_length", "distinct", "repeats")


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=11)
    words = data.split()
    count, total = len(words), len(data)
    letters = n[1] + n[2]
    again = sum(map(bytes.__eq__, words[1:], words))
    # different words grow about as a power of the text, so the logarithms' ratio hardly depends on its length
    distinct = np.log1p(len(set(words)) + PRIOR_WORDS) / np.log1p(count + PRIOR_WORDS)
    # shares are those of the text with PRIOR_BYTES or PRIOR_WORDS of plain prose added: a few characters prove little
    share = lambda x, plain=0.0, of=total, more=PRIOR_BYTES: float(np.sqrt((x + plain * more) / (of + more)))
    return [float(np.log1p(total) / 10), share(n[1], 0.02, letters), share(n[3]), share(n[5], 0.003), share(n[6], 0.02), share(n[7]), share(n[8]), share(n[9]), float(np.log((total + 6 * PRIOR_WORDS) / (count + PRIOR_WORDS)) / 3), float(distinct), share(again, 0.0, count, PRIOR_WORDS)]


def _describe(batches):
    for b in batches:
        x = np.array([statistics(t.as_py()) for t in b.column(1)], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the transformed statistics."""
    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_describe, "doc_id bigint, x array<double>")


class Discriminant:
    def __init__(self, prior: float, means=None, factors=None, offsets=None):
        self.prior, self.means, self.factors, self.offsets = prior, means, factors, offsets

    @classmethod
    def fit(cls, described: DataFrame, pooled_share: float = 0.1, ridge: float = 0.02) -> Discriminant:
        """``described``: x and label (0 or 1; others are left out)."""
        d = len(FEATURES)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        x = [F.col("x")[i] for i in range(d)]
        sums = described.filter(F.col("label").isin(0, 1)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")).collect()
        by = {int(r["label"]): r for r in sums}
        total = sum(r["n"] for r in sums)
        prior = by[1]["n"] / total if 1 in by else 0.0 if total else 0.5
        if any(k not in by or by[k]["n"] < 2 for k in (0, 1)):
            return cls(prior)
        means, spreads = [], []
        for k in (0, 1):
            n, mean = by[k]["n"], np.array(by[k]["s"]) / by[k]["n"]
            second = np.zeros((d, d))
            for (i, j), v in zip(pairs, by[k]["p"]):
                second[i, j] = second[j, i] = v / n
            means.append(mean)
            spreads.append(second - np.outer(mean, mean))
        pooled = (by[0]["n"] * spreads[0] + by[1]["n"] * spreads[1]) / total
        factors, offsets = [], []
        for k, share in ((0, 1 - prior), (1, prior)):
            s = (1 - pooled_share) * spreads[k] + pooled_share * pooled
            s = (1 - ridge) * s + ridge * (np.trace(s) / d + 1e-6) * np.eye(d)
            lower = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(lower))
            offsets.append(float(np.log(share) - np.log(np.diag(lower)).sum()))
        return cls(prior, means, factors, offsets)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def quality(docs: DataFrame, labels: DataFrame, teach: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; ``teach`` says, of doc_id, whose labels may be learned."""
    described = stored(describe(docs, id_col, text_col))
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1)).filter(teach)
    model = Discriminant.fit(described.join(known, "doc_id"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return described.select("doc_id", score("x").alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
