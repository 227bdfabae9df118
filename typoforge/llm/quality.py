"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes ten numbers (logs and log-ratios of counts). Class means and covariances come from one
aggregate over all labelled rows. A class covariance is shrunk towards the pooled one and towards its diagonal;
the Cholesky factor and log-determinant of each class are computed once and go to the tasks with the function, which
solves with them by forward substitution. The
score is the logistic of the difference of the log-densities plus the log-prior, divided by ``temperature``.

Cases: null and empty texts have the statistics of no words and get a score; null labels and labels without a document
are ignored; a document with several labels takes their majority, a tie is dropped; a class without rows gives every
document the share of the other; repeated rows give repeated results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize

D = 10
SHRINK, RIDGE, TEMPERATURE = 0.2, 0.05, 1.0

_CLASS = np.zeros((256, 7))
_CLASS[list(range(97, 123)), 0] = 1  # a-z
_CLASS[list(range(65, 91)), 1] = 1  # A-Z
_CLASS[list(range(48, 58)), 2] = 1  # digits
_CLASS[[46, 44, 59, 58, 63, 45, 39, 34, 40, 41], 3] = 1  # marks of prose
_CLASS[[33, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126], 4] = 1  # other marks
_CLASS[[9, 10, 11, 12, 13, 32], 5] = 1  # white space
_CLASS[list(range(128, 256)), 6] = 1  # bytes of other letters


def statistics(text: str | None) -> np.ndarray:
    """Of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low, up, digit, prose, mark, white, other = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    ratio = lambda a, b: np.log((a + 0.5) / (b + 1.0))
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return np.array([
        np.log1p(n),
        ratio(len(raw) - white, n),
        ratio(up, low + up + other),
        ratio(digit, len(raw)),
        ratio(prose, n),
        ratio(mark, n),
        ratio(len(set(words)), n),
        ratio(doubled, n),
        ratio(len(lines) - len(set(lines)), len(lines)),
        ratio(len(lines), n),
    ])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, x0 ... x9)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, k]) for k in range(D)]], names=["doc_id", *[f"x{k}" for k in range(D)]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"x{k} double" for k in range(D)))


def majority(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): the label of most rows of a document."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(column).cast("double")).alias("m")).where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).cast("int").alias("y"))


def solve_lower(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """factor^-1 b for a lower triangular factor, by forward substitution."""
    z = np.empty_like(b)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


class Model:
    def __init__(self, mean: np.ndarray, chol: np.ndarray, logdet: np.ndarray, prior: np.ndarray, temperature: float, constant: float | None = None):
        self.mean, self.chol, self.logdet, self.prior, self.temperature, self.constant = mean, chol, logdet, prior, temperature, constant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = [self.prior[c] - 0.5 * self.logdet[c] - 0.5 * (solve_lower(self.chol[c], (x - self.mean[c]).T) ** 2).sum(axis=0) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.temperature, -700, 700)))


def fit(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE, temperature: float = TEMPERATURE) -> Model:
    """rows: (y, x0 ... x9). Sums of products come to the driver: 66 numbers for each of two classes."""
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    got = {r[0]: np.array(r[1:], float) for r in rows.groupBy("y").agg(F.count(F.lit(1)), *[F.sum(f"x{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).collect()}
    n = np.array([got[c][0] if c in got else 0 for c in (0, 1)])
    if n.min() < 2:
        return Model(None, None, None, None, temperature, float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = np.array([got[c][1 : D + 1] / n[c] for c in (0, 1)])
    cov = np.zeros((2, D, D))
    for c in (0, 1):
        for (i, j), s in zip(pairs, got[c][D + 1 :], strict=True):
            cov[c, i, j] = cov[c, j, i] = s / n[c] - mean[c, i] * mean[c, j]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    diagonal = np.diag(np.diag(pooled) + 1e-3)
    cov = (1 - ridge) * ((1 - shrink) * cov + shrink * pooled) + ridge * diagonal
    chol = np.linalg.cholesky(cov)
    return Model(mean, chol, 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(axis=1), np.log(n / n.sum()), temperature)


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """-> doc_id, held_out, score, predicted. Rows whose fold is ``held`` lend no label."""
    x = materialize(features(docs), "quality-x").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)))
    y = majority(labels, column)
    # of several texts of a document one lends its label, the same in each run
    one = x.where("not held_out").groupBy("doc_id").agg(F.min(F.struct(*[f"x{k}" for k in range(D)])).alias("x")).select("doc_id", "x.*")
    model = fit(one.join(y, "doc_id"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s = model.score(np.stack([b.column(f"x{k}").to_numpy() for k in range(D)], axis=1).reshape(-1, D)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return x.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8(spark, sf_dir) -> DataFrame:
    from .common import read

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
