"""Exact linear service-time model (M4, M7, M8) from sufficient statistics.

One aggregation gives, for every pair of category levels that occurs, the count and the sums of the numeric features, of the target and of
their products.  From those few rows (levels x levels) the driver builds the correlation matrix of numeric features and level
indicators and eliminates it column by column.  Collinear columns have a rule: the first level of a category in
alphabetical order is its reference and has no column, and a column that those before it explain (pivot under ``TOLERANCE``) or that is constant
gets the coefficient zero.  Predictions are one Column expression.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berthwise import schema as S
from berthwise.operators import ml as ML

TOLERANCE = 1e-9
MOST_CELLS = 100_000             # category pairs that the driver takes; more is an error


@dataclass
class LinearModel:
    intercept: float
    numeric: dict[str, float]
    levels: dict[str, dict[str, float]]      # by categorical column; levels not listed count as the reference
    n_train: int

    def predict(self) -> Column:
        """The prediction for rows of :func:`berthwise.operators.ml.prepare`."""
        out = F.lit(self.intercept)
        for c, b in self.numeric.items():
            out = out + F.col(c) * F.lit(b)
        for c, of in self.levels.items():
            if of:
                table = F.create_map(*[x for k, b in of.items() for x in (F.lit(k), F.lit(b))])
                out = out + F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0.0))
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"No service-time model at {path}: run training first.")
    return LinearModel(**json.loads(spark.read.text(path).first()[0]))


def statistics(df: DataFrame, target: str = ML.TARGET) -> DataFrame:
    """One row per occurring pair of category levels: count, sums and sums of products of numeric features and target."""
    cats = [c for c, _ in ML.CATEGORICAL]
    v = [*ML.NUMERIC, target]
    d = df.select(*cats, *[F.col(c).cast("double").alias(c) for c in v])
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(v) for j, b in enumerate(v) if j >= i]
    return d.groupBy(*cats).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(v)], *products)


def eliminate(matrix: np.ndarray, right: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Solution of a positive semidefinite system, columns in order; columns explained by those before them get zero."""
    a = np.concatenate([matrix, right[:, None]], axis=1)
    used = np.zeros(len(right), dtype=bool)
    for k in range(len(right)):
        if a[k, k] > tolerance:
            used[k] = True
            a[k] /= a[k, k]
            for i in range(len(right)):
                if i != k:
                    a[i] -= a[i, k] * a[k]
    return np.where(used, a[:, -1], 0.0)


def fit_linear(df: DataFrame, target: str = ML.TARGET) -> LinearModel | None:
    """Ordinary least squares over prepared rows with a target; None without any."""
    cells = statistics(df.filter(F.col(target).isNotNull()), target).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of category levels")
    if not cells:
        return None
    cats = [c for c, _ in ML.CATEGORICAL]
    q = len(ML.NUMERIC) + 1                                         # numeric features and, last, the target
    level = [(c, x) for c in cats for x in sorted({r[c] for r in cells})[1:]]
    p = q - 1 + len(level)
    place = {x: q - 1 + i for i, x in enumerate(level)}
    total, sums, cross = 0, np.zeros(p + 1), np.zeros((p + 1, p + 1))
    where = [*range(q - 1), p]
    for r in sorted(cells, key=lambda r: tuple(r[c] for c in cats)):
        on = [place[c, r[c]] for c in cats if (c, r[c]) in place]
        s = np.array([r[f"s{i}"] for i in range(q)])
        total += r["n"]
        sums[where] += s
        sums[on] += r["n"]
        for i in range(q):
            for j in range(q):
                cross[where[i], where[j]] += r[f"p{min(i, j)}_{max(i, j)}"]
        for i in on:
            cross[i, where] += s
            cross[where, i] += s
            cross[i, on] += r["n"]
    mean = sums / total
    cov = cross / total - np.outer(mean, mean)
    scale = np.sqrt(np.where(np.diag(cov) > TOLERANCE * np.maximum(1.0, mean * mean), np.diag(cov), 0.0))
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    corr = cov * np.outer(inverse, inverse)
    beta = eliminate(corr[:p, :p], corr[:p, p]) * scale[p] * inverse[:p]
    names = {c: {x: float(beta[place[k, x]]) for k, x in level if k == c} for c in cats}
    return LinearModel(float(mean[p] - beta @ mean[:p]), {c: float(beta[i]) for i, c in enumerate(ML.NUMERIC)}, names, int(total))


def train_linear(df: DataFrame, ts: str = S.ARRIVAL_DT) -> tuple[LinearModel | None, DataFrame]:
    """M7 with the exact model: time-ordered split, fit on the first part, metrics on the rest (null without rows)."""
    split = ML.time_split(ML.prepare(df), ts)
    model = fit_linear(split.filter("is_train"))
    test = split.filter(~F.col("is_train"))
    yhat = model.predict() if model else F.lit(None).cast("double")
    return model, ML.regression_metrics(test.withColumn("prediction", yhat))


def score_linear(model: LinearModel, calls: DataFrame, floor_hours: float = S.MIN_PREDICTED_SERVICE_HOURS,
                 out: str = "predicted_service_hours") -> DataFrame:
    """M8: predictions, floored, beside the columns of ``calls``."""
    return ML.prepare(calls).withColumn(out, F.greatest(model.predict(), F.lit(floor_hours)))
