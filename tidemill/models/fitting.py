"""``fit_model`` and the fitted model: transform, probabilities, save and load."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import col, require_columns
from tidemill.models import adaboost, bayes, cells, extra_trees, neighbours
from tidemill.models.estimators import ESTIMATORS, NEEDS_LABEL_STD, SEED, Facts, alone
from tidemill.models.registry import check_params
from tidemill.session import spread_training, use_checkpoints, written

MAX_CLASSES = 1_000
MERGED = 10_000  # rows of which trees look at all for their cut points; of more they draw some
LIGHT = 1_000_000  # rows; of so many, none weighs enough to move the deviations of features


@dataclass
class FittedModel:
    name: str
    task: str
    params: dict[str, Any]
    features: list[str]
    classes: list[Any] | None
    label_type: str = "double"
    spark_model: PipelineModel | None = None
    literals: dict[str, Any] | None = None
    train: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; for classifiers also ``probability``, one entry per class
        in the order of ``classes``, NULL where the model has none."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"Missing features: {missing}")
        if self.name == "gaussian_nb_classifier":
            return self._named(bayes.score_bayes(df, self.features, self.literals))
        if self.name == "adaboost_classifier":
            return self._named(
                adaboost.score_adaboost_classifier(df, self.features, self.literals, len(self.classes))
            )
        if self.name == "adaboost_regressor":
            return adaboost.score_adaboost_regressor(df, self.features, self.literals)
        if self.name.startswith("knn"):
            return self._neighbours(df)
        scored = self.spark_model.transform(df)
        if self.name.startswith(("extra_trees", "bagging")) and self.spark_model.stages[-1].getPredictionCol() != "_prediction":
            told = extra_trees.mean_prediction(self.spark_model, len(self.classes or []))
            kept = [col(c) for c in df.columns]
            if self.task == "regression":
                return scored.select(*kept, told.alias("prediction"))
            voted = scored.select(*kept, told.alias("probability"))
            code = F.array_position("probability", F.array_max("probability")).cast("int") - 1
            return self._named(voted.withColumn("_code", code))
        if self.task == "regression":
            return scored.select(*[col(c) for c in df.columns], F.col("_prediction").alias("prediction"))
        if "_probability" in scored.columns:
            probability = vector_to_array("_probability")
        else:
            probability = F.lit(None).cast("array<double>")
        coded = scored.select(
            *[col(c) for c in df.columns],
            F.col("_prediction").cast("int").alias("_code"),
            probability.alias("probability"),
        )
        return self._named(coded)

    def _named(self, coded: DataFrame) -> DataFrame:
        """Class codes back to the label's own values."""
        names = F.array(*[F.lit(c).cast(self.label_type) for c in self.classes])
        prediction = F.element_at(names, F.col("_code") + 1)
        return coded.withColumn("prediction", prediction).drop("_code")

    def _neighbours(self, df: DataFrame) -> DataFrame:
        p = {"manhattan": 1, "euclidean": 2}.get(self.params["metric"], self.params["p"])
        approx = self.params.get("approx", False)
        found = neighbours.nearest(df, self.features, self.train, self.params["n_neighbors"], p, approx=approx)
        if self.task == "regression":
            return found.withColumn(
                "prediction", neighbours.mean("_near", self.params["weights"])
            ).drop("_near")
        votes = found.withColumn("_votes", neighbours.vote("_near", self.classes, self.params["weights"]))
        total = F.aggregate("_votes", F.lit(0.0), lambda s, v: s + v)
        coded = votes.withColumn(
            "_code", F.array_position("_votes", F.array_max("_votes")).cast("int") - 1
        ).withColumn("probability", F.transform("_votes", lambda v: v / total))
        return self._named(coded.drop("_near", "_votes"))

    def save(self, path: str) -> None:
        """Everything that is needed to score again, under one folder."""
        spark = SparkSession.getActiveSession()
        facts = {
            k: getattr(self, k)
            for k in ("name", "task", "params", "features", "classes", "label_type", "literals", "notes")
        }
        line = spark.createDataFrame([(json.dumps(facts),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/facts")
        if self.spark_model is not None:
            self.spark_model.write().overwrite().save(f"{path}/model")
        if self.train is not None:
            self.train.write.mode("overwrite").parquet(f"{path}/train")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        model = cls(**facts)
        if model.name.startswith("knn"):
            model.train = spark.read.parquet(f"{path}/train")
        elif model.literals is None:
            model.spark_model = PipelineModel.load(f"{path}/model")
        return model


def class_probabilities(scored: DataFrame, classes: Sequence[Any]) -> Column:
    """``class -> probability`` of a scored table as a map column; NULL without probabilities."""
    names = F.array(*[F.lit(str(c)) for c in classes])
    return F.when(F.col("probability").isNotNull(), F.map_from_arrays(names, F.col("probability")))


def fit_model(
    df: DataFrame,
    name: str,
    task: str,
    features: Sequence[str],
    label: str = "label",
    params: dict[str, Any] | None = None,
    key: Sequence[str] = (),
) -> FittedModel:
    """Fits a registered model. The label may hold any numbers; class labels are indexed
    in ascending order for the fit and mapped back when scoring."""
    full = check_params(name, task, params)
    features = list(features)
    require_columns(df, [*features, label])
    classes = _classes(df, label) if task == "classification" else None
    if classes is not None and len(classes) < 2:
        raise ValueError(f"the label {label!r} has fewer than 2 classes")
    model = FittedModel(name, task, full, features, classes, dict(df.dtypes)[label])
    y = _code(label, classes)
    if name == "gaussian_nb_classifier":
        model.literals = bayes.fit_bayes(df, features, label, full["var_smoothing"])
        return model
    if name.startswith("knn"):
        model.train = neighbours.train_table(
            df.withColumn("_y", y), features, "_y", key, full["n_neighbors"]
        )
        return model
    if name.startswith("adaboost"):
        seed = SEED if full["random_state"] is None else full["random_state"]
        rows = df.select(*[col(f).cast("double").alias(f) for f in features], y.alias("_y"))
        rows = spread_training(rows, df.count()).persist()
        rounds, rate = full["n_estimators"], full["learning_rate"]
        try:
            if task == "classification":
                model.literals = adaboost.fit_adaboost_classifier(
                    rows, features, len(classes), rounds, rate, seed
                )
            else:
                model.literals = adaboost.fit_adaboost_regressor(rows, features, rounds, rate, seed)
        finally:
            rows.unpersist()
        return model
    facts = _facts(df, name, label, classes, features)
    if name.startswith("extra_trees"):
        rows = df.select(*[col(f).cast("double").alias(f) for f in features], y.alias("_y"))
        rows, seed = spread_training(rows, facts.rows).persist(), SEED if full["random_state"] is None else full["random_state"]
        try:
            model.spark_model = extra_trees.fit_extra_trees(rows, features, full, facts, seed)
        finally:
            rows.unpersist()
        model.notes = facts.notes
        return model
    estimator = ESTIMATORS[name](full, facts)
    model.notes = facts.notes
    if name.startswith("bagging") and not any(isinstance(df.schema[f].dataType, VectorUDT) for f in features):
        rows = df.select(*[col(f).cast("double").alias(f) for f in features], y.alias("_y"))
        use_checkpoints(df.sparkSession)
        model.spark_model = cells.fit_bags(rows, features, estimator, facts)
    if model.spark_model is None:
        model.spark_model = _fit_spark(df, estimator, features, y, facts.rows)
    return model


def _classes(df: DataFrame, label: str) -> list[Any]:
    rows = df.select(col(label).alias("g")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    if any(r["g"] is None for r in rows):
        raise ValueError(f"the label {label!r} has missing values")
    return sorted(r["g"] for r in rows)


def _code(label: str, classes: Sequence[Any] | None) -> Column:
    if classes is None:
        return col(label).cast("double")
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), col(label))
    return (place - 1).cast("double")


def _facts(df: DataFrame, name: str, label: str, classes, features) -> Facts:
    columns = [F.count("*").alias("n")]
    if name in NEEDS_LABEL_STD:
        columns.append(F.stddev_samp(col(label).cast("double")).alias("s"))
    row = df.agg(*columns).first()
    std = (row["s"] or 0.0) if name in NEEDS_LABEL_STD else 0.0
    return Facts(row["n"], len(classes or []), len(features), std)


def _feature(df: DataFrame, name: str) -> Column:
    """A number as a double; a vector as it is."""
    vector = isinstance(df.schema[name].dataType, VectorUDT)
    return col(name) if vector else col(name).cast("double").alias(name)


def _takes_weights(estimator) -> bool:
    """Whether equal rows may be one row that weighs as many: trees that draw no rows."""
    core = estimator.getClassifier() if estimator.hasParam("classifier") else estimator
    if isinstance(core, (C.DecisionTreeClassifier, R.DecisionTreeRegressor)):
        return True
    if isinstance(core, (C.RandomForestClassifier, R.RandomForestRegressor)):
        return not core.getBootstrap() and core.getSubsamplingRate() == 1
    return isinstance(core, (C.GBTClassifier, R.GBTRegressor)) and core.getSubsamplingRate() == 1


def _merge_equal(slim: DataFrame, estimator, rows: int) -> DataFrame | None:
    """Different rows with their number ``_w``, where they are at most ``MERGED``; else None.

    A least number of rows in a leaf becomes a least share of the weight. Support vectors get
    ``LIGHT`` rows and a few more, see ``_split_weights``."""
    core = estimator.getClassifier() if estimator.hasParam("classifier") else estimator
    light = isinstance(core, C.LinearSVC)
    if not (light or _takes_weights(estimator)) or any(isinstance(f.dataType, VectorUDT) for f in slim.schema.fields):
        return None
    least = core.getMinInstancesPerNode() if core.hasParam("minInstancesPerNode") else 1
    if rows <= (LIGHT if light else max(MERGED, 2 * least)):
        return None
    if slim.agg(F.approx_count_distinct(F.struct(*slim.columns)).alias("n")).first()["n"] > 1.2 * MERGED:
        return None
    merged = written(slim.groupBy(*slim.columns).agg(F.count("*").cast("double").alias("_w")), "merged")
    if merged.count() > MERGED:
        return None
    if light:
        return _split_weights(merged, rows / LIGHT)
    if least > 1:
        core._set(minInstancesPerNode=1, minWeightFractionPerNode=(least - 0.5) / rows)
    return merged.coalesce(1)  # bounded above


def _split_weights(merged: DataFrame, most: float) -> DataFrame:
    """The same weight in rows that weigh ``most`` at most each.

    The solver scales features by deviations over W - sum(w * w) / W, and stops before it has
    converged: a cell's whole weight in one row would lead it elsewhere, a millionth does not."""
    parts = merged.withColumn("_n", F.ceil(F.col("_w") / F.lit(most))).withColumn("_w", F.col("_w") / F.col("_n"))
    split = parts.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    return split.repartition(merged.sparkSession.sparkContext.defaultParallelism)


def _fit_spark(df: DataFrame, estimator, features: Sequence[str], y: Column, count: int) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    columns = {
        "featuresCol": "_features",
        "labelCol": "_y",
        "predictionCol": "_prediction",
        "probabilityCol": "_probability",
        "rawPredictionCol": "_raw",
    }
    if estimator.hasParam("checkpointInterval") or estimator.hasParam("classifier"):
        use_checkpoints(df.sparkSession)
    if estimator.hasParam("classifier"):  # one against the rest reads its parts' raw scores
        estimator.getClassifier().setRawPredictionCol("_raw")
    settings = {estimator.getParam(n): c for n, c in columns.items() if estimator.hasParam(n)}
    slim = df.select(*[_feature(df, f) for f in features], y.alias("_y"))
    merged = _merge_equal(slim, estimator, count)
    if merged is None:
        rows = assembler.transform(spread_training(slim, count)).select("_features", "_y")
    else:
        rows = assembler.transform(merged).select("_features", "_y", "_w")
        settings[estimator.getParam("weightCol")] = "_w"
    return PipelineModel([assembler, alone(estimator.fit(rows, settings), df.sparkSession)])
