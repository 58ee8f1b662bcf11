"""Service-time model with Spark ML (M1-M8, W5, A7, SNK1, SRC4).

Training and scoring are distributed Spark ML jobs; nothing is collected to
the driver except the fitted model and a one-row metrics frame.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise import schema as S
from berthwise.functions.time import MINUTE_US, to_us
from berthwise.operators.scan import DAY_US, bucket_of
from berthwise.session import cut_lineage

# numeric features, null -> 0
NUMERIC = ["tonnage_import", "tonnage_export", "gross_tonnage", "length_m", "draft_m",
           "tugs_at_berthing", "arrival_month", "arrival_dow"]
# categorical features -> full one-hot (no level dropped); prefixes as in the source
CATEGORICAL = [("vessel_type", "vtype"), ("cargo_import", "cargo")]
TARGET = S.SERVICE_HOURS
UNKNOWN = "UNKNOWN"


def prepare(df: DataFrame) -> DataFrame:
    """M1/M2 inputs: numeric nulls -> 0, categorical nulls -> ``UNKNOWN``."""
    out = df
    for c in NUMERIC:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    for c, _ in CATEGORICAL:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)))
    return out


def one_hot_stages() -> list:
    """M1: one indicator per category (alphabetical levels, unseen levels
    tolerated at scoring time)."""
    stages = []
    for c, p in CATEGORICAL:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{p}_idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{p}_idx", outputCol=f"{p}_vec", dropLast=False,
                                    handleInvalid="keep"))
    return stages


def one_hot_wide(df: DataFrame, col: str, prefix: str, key: str = "call_id") -> DataFrame:
    """M1 (wide table): one 0/1 column ``prefix_<value>`` per category via
    ``pivot`` (the category list is found by one distinct pass)."""
    c = F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN))
    w = (df.select(key, c.alias("_v")).groupBy(key).pivot("_v").agg(F.lit(1)).fillna(0))
    return w.select(key, *[F.col(f"`{v}`").alias(f"{prefix}_{v}") for v in w.columns if v != key])


def feature_stages() -> list:
    """M2: numeric columns ++ one-hot vectors -> ``features``."""
    return one_hot_stages() + [VectorAssembler(
        inputCols=NUMERIC + [f"{p}_vec" for _, p in CATEGORICAL], outputCol="raw_features")]


def linear_pipeline() -> Pipeline:
    """M4: standardise (mean and variance) + ordinary least squares."""
    return Pipeline(stages=feature_stages() + [
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LinearRegression(featuresCol="features", labelCol=TARGET, regParam=0.0, solver="normal")])


def gbt_pipeline(max_iter: int = 400, max_depth: int = 6, step: float = 0.05, subsample: float = 0.8,
                 seed: int = S.RANDOM_SEED) -> Pipeline:
    """M5: boosted trees (400 x depth 6, lr 0.05, row and column subsample 0.8)."""
    return Pipeline(stages=feature_stages() + [
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        GBTRegressor(featuresCol="features", labelCol=TARGET, maxIter=max_iter, maxDepth=max_depth,
                     stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=str(subsample), seed=seed,
                     checkpointInterval=10)])


def choose_pipeline(production: bool, **gbt_args) -> Pipeline:
    """M6: boosted trees in production, the linear baseline otherwise."""
    return gbt_pipeline(**gbt_args) if production else linear_pipeline()


def _boundary(rows: DataFrame, ratio: float):
    """The last training row (``_t``, ``_k``) of ``rows`` and its place, found by narrowing counts per day
    and then per minute; only such scalars come to the driver."""
    take = None
    for unit in (DAY_US, MINUTE_US):
        slot = bucket_of(to_us("_t"), unit)
        per = rows.groupBy(slot.alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.orderBy("_u").rowsBetween(Window.unboundedPreceding, 0))
        per = per.select("_u", "_n", upto.alias("_upto"))       # a row per day, then per minute of one day
        if take is None:
            total = per.agg(F.max("_upto")).first()[0] or 0
            take = math.floor(total * ratio)
        if take < 1:
            return None
        hit = per.filter(F.col("_upto") >= take).orderBy("_u").first()
        take -= hit["_upto"] - hit["_n"]
        rows = rows.filter(slot == hit["_u"])
    rn = F.row_number().over(Window.orderBy("_t", "_k"))
    return rows.withColumn("_r", rn).filter(F.col("_r") == take).first()


def time_split(df: DataFrame, ts: str = S.ARRIVAL_DT, key: str = "call_id",
               ratio: float = S.TRAIN_RATIO) -> DataFrame:
    """Flag the first ``floor(ratio * n)`` rows in ``(ts, key)`` order as
    training rows (``is_train``), exactly: the boundary row is found first, then every row is compared
    with it, in one scan without a shuffle.  ``n`` counts rows with a time; rows without one stay, as test rows."""
    last = _boundary(df.select(F.col(ts).alias("_t"), F.col(key).alias("_k")).filter("_t IS NOT NULL"), ratio)
    if last is None:
        return df.withColumn("is_train", F.lit(False))
    t = F.lit(last["_t"]).cast(df.schema[ts].dataType)
    train = (F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) <= F.lit(last["_k"])))
    return df.withColumn("is_train", F.coalesce(train, F.lit(False)))


def regression_metrics(pred: DataFrame, y: str = TARGET, yhat: str = "prediction") -> DataFrame:
    """RMSE, MAE and R² in one aggregation pass."""
    e = F.col(y) - F.col(yhat)
    n = F.count(F.lit(1))
    sst = F.sum(F.col(y) * F.col(y)) - F.sum(F.col(y)) * F.sum(F.col(y)) / n
    return pred.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                    (F.lit(1.0) - F.sum(e * e) / sst).alias("r2"), n.alias("n_test"))


def train(df: DataFrame, production: bool = False, ts: str = S.ARRIVAL_DT, **gbt_args):
    """M7: time-ordered split -> fit -> predict the test part -> metrics.
    Returns ``(PipelineModel, metrics DataFrame)``."""
    data = prepare(df)
    # Spark ML makes several passes (indexers, scaler, solver, evaluation):
    # materialise the split once in the shared checkpoint folder so each pass
    # reads it instead of recomputing the cleaning lineage, and a lost
    # executor does not restart the upstream jobs.
    split = cut_lineage(time_split(data, ts))
    trainset = split.filter("is_train").drop("is_train")
    testset = split.filter(~F.col("is_train")).drop("is_train")
    model = choose_pipeline(production, **gbt_args).fit(trainset)
    return model, regression_metrics(model.transform(testset))


def score(model: PipelineModel, calls: DataFrame, floor_hours: float = S.MIN_PREDICTED_SERVICE_HOURS,
          out: str = "predicted_service_hours") -> DataFrame:
    """M8: distributed batch scoring; predictions are floored at 0.5 h and
    unseen categories fall into the 'unknown' one-hot slot."""
    p = model.transform(prepare(calls))
    keep = [c for c in calls.columns]
    return p.select(*keep, F.greatest(F.col("prediction"), F.lit(floor_hours)).alias(out))


def save_model(model: PipelineModel, path: str) -> None:
    """SNK1: persist the fitted pipeline (parents created, path overwritten)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """SRC4: load a fitted pipeline; a missing path is a clear error.  The file system is that of the path."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"No service-time model at {path}: run training first.")
    return PipelineModel.load(path)
