"""Distributed estimators over feature tables: boosted trees, forests, linear models."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.modelling.boosting import Fitted, Growth, Model, fit, score

VECTOR = "_features"


def _pipeline(columns: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol=VECTOR), estimator])


def _complete(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    return df.na.drop("any", subset=[*columns, label]).withColumn(label, F.col(label).cast("double"))


def _probability(model: PipelineModel, rows: DataFrame, columns: list[str], k: int = 1) -> DataFrame:
    out = model.transform(rows.na.drop("any", subset=columns))
    return out.withColumn("p", vector_to_array("probability")[k]).drop(VECTOR, "rawPrediction", "probability", "prediction")


def fit_multiclass(train: DataFrame, columns: list[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42) -> PipelineModel:
    forest = RandomForestClassifier(featuresCol=VECTOR, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return _pipeline(columns, forest).fit(_complete(train, columns, label))


def fit_linear(
    train: DataFrame, columns: list[str], target: str, kind: str = "logistic", reg: float = 0.0, elastic: float = 0.0
) -> PipelineModel:
    """``logistic`` for classes, ``elastic`` for a penalised regression."""
    if kind == "logistic":
        est = LogisticRegression(featuresCol=VECTOR, labelCol=target, regParam=reg, elasticNetParam=elastic)
    else:
        est = LinearRegression(featuresCol=VECTOR, labelCol=target, regParam=reg, elasticNetParam=elastic, predictionCol="pred")
    return _pipeline(columns, est).fit(_complete(train, columns, target))


def predict_probability(model: PipelineModel, rows: DataFrame, columns: list[str], k: int = 1) -> DataFrame:
    return _probability(model, rows, columns, k)


def predict_classes(model: PipelineModel, rows: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """A probability column per class and the most likely class number."""
    out = model.transform(rows.na.drop("any", subset=columns))
    p = vector_to_array("probability")
    return out.withColumns({f"p_{n}": p[i] for i, n in enumerate(names)} | {"predicted": F.col("prediction").cast("int")}).drop(
        VECTOR, "rawPrediction", "probability", "prediction"
    )


def predict_value(model: PipelineModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    return model.transform(rows.na.drop("any", subset=columns)).drop(VECTOR)


IMPORTANCE = T.StructType([T.StructField("model", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])


def importances(fitted: list[Fitted], df: DataFrame) -> DataFrame:
    """(model, feature, importance): each feature's share in the gain of a model's trees."""
    return df.sparkSession.createDataFrame([(f.model.name, c, v) for f in fitted for c, v in f.importances.items()], IMPORTANCE)


def prune(fitted: Fitted, top: int) -> list[str]:
    """The ``top`` features of a fitted model by importance."""
    return [c for c, _ in sorted(fitted.importances.items(), key=lambda x: (-x[1], x[0]))][:top]


def in_parallel(jobs: dict[tuple, Callable[[], DataFrame]], labels: list[str], threads: int = 4) -> DataFrame:
    """Run independent fits as concurrent Spark jobs and union their result rows, tagged by key."""
    with ThreadPoolExecutor(threads) as pool:
        frames = dict(zip(jobs, pool.map(lambda j: j(), jobs.values())))
    tagged = [df.withColumns({n: F.lit(v) for n, v in zip(labels, key)}) for key, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def boost(rows: DataFrame, models: list[Model], growth: Growth = Growth(), group: str = "split") -> tuple[list[Fitted], DataFrame]:
    """The models fitted together on the training rows, and the scored test rows; rows carry (split, role).

    A model is named ``setting/split``; the scored rows carry both.
    """
    fitted = fit(rows.filter("role = 'train'"), models, group, growth)
    return fitted, named_scores(rows.filter("role = 'test'"), fitted, group)


def named_scores(rows: DataFrame, fitted: list[Fitted], group: str = "split") -> DataFrame:
    return score(rows, fitted, group).withColumn("setting", F.substring_index("model", "/", 1)).drop("model")


def per_split(settings: dict[str, dict], splits: list[str]) -> list[Model]:
    """One model for each setting and split; a setting has the fields of ``Model``."""
    return [Model(f"{name}/{s}", group=s, **(v | {"features": tuple(v["features"])})) for name, v in settings.items() for s in splits]


def ablate(
    rows: DataFrame, feature_sets: dict[str, list[str]], splits: list[str], label: str, keep: list[str], growth: Growth = Growth()
) -> DataFrame:
    """Out-of-sample probabilities for every feature set and split; rows carry (split, role).

    All feature sets and splits grow in the same jobs.
    """
    models = per_split({name: {"features": columns, "label": label} for name, columns in feature_sets.items()}, splits)
    scored = boost(rows, models, growth)[1]
    return scored.select(F.col("setting").alias("feature_set"), "split", *keep, label, F.col("score").alias("p"))


def fit_conditioned(
    rows: DataFrame, state: str, states: dict[int, str], columns: list[str], splits: list[str], keep: list[str],
    min_train: int = 30, min_test: int = 10, growth: Growth = Growth(),
) -> DataFrame:
    """One model per state and split, trained and scored only on rows of that state with that state's label."""
    sizes = {
        (r["split"], r[state], r["role"]): r["n"] for r in rows.groupBy("split", state, "role").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    enough = lambda split, s: sizes.get((split, s, "train"), 0) >= min_train and sizes.get((split, s, "test"), 0) >= min_test
    own = rows.withColumns({f"_label{s}": F.when(F.col(state) == s, F.col(label)) for s, label in states.items()})
    models = per_split({str(s): {"features": columns, "label": f"_label{s}"} for s in states}, splits)
    models = [m for m in models if enough(m.group, int(m.name.split("/")[0]))]
    if not models:
        raise ValueError("no state has enough rows")
    scored = boost(own, models, growth)[1].filter(F.col(state) == F.col("setting").cast("int"))
    label = F.coalesce(*[F.col(f"_label{s}") for s in states])
    return scored.select(*keep, "split", state, label.alias("y"), F.col("score").alias("p"))
