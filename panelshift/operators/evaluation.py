"""Quality of predictions: capture at a budget, Brier score, calibration, average precision, folds and choice of a specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshift.functions.scalars import ratio
from panelshift.operators.ordering import hash_numbered, joined_on, running_sum, value_range
from panelshift.operators.panel import ladder


def binary_metrics(rows: DataFrame, by: list[str], target: str, probability: str, budget: float = 0.25) -> DataFrame:
    """Per group: rows, positives, Brier score, average precision, and the positives captured in the top `budget` of rows.

    Rows tied at the budget's end share it. Rows with a NULL target or probability are left out; ratios without positives are NULL.
    """
    known = rows.filter(F.col(target).isNotNull() & F.col(probability).isNotNull()).withColumn("_y", F.col(target).cast("int"))
    hits = known.groupBy(*by, probability).agg(F.sum("_y").alias("_hits"))
    steps = joined_on(ladder(known, by, probability), hits, [*by, probability], "inner").withColumns({"_range": -value_range(F.col(probability)), "_down": -F.col(probability)})
    steps = running_sum(steps, by, "_range", ["_down"], "_hits", "_seen")
    seen = F.col("_seen")
    slots = F.ceil(F.col("members") * budget)
    share = F.greatest(F.lit(0), F.least(slots - F.col("above"), F.col("ties"))) / F.col("ties")
    curve = steps.withColumns({"_precision": seen / (F.col("above") + F.col("ties")), "_captured": share * F.col("_hits")}).groupBy(*by).agg(
        F.sum("_hits").alias("positives"), F.sum(F.col("_precision") * F.col("_hits")).alias("_ap"), F.sum("_captured").alias("_captured")
    )
    brier = known.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(F.pow(F.col(probability) - F.col("_y"), 2)).alias("brier"))
    return joined_on(brier, curve, by, "inner").select(*by, "rows", "positives", "brier", ratio(F.col("_ap"), F.col("positives")).alias("average_precision"), ratio(F.col("_captured"), F.col("positives")).alias("capture"))


def calibration(rows: DataFrame, by: list[str], target: str, probability: str, bins: int = 10) -> DataFrame:
    """Rows, mean probability and observed rate per bin of equal width; 1.0 belongs to the last bin."""
    known = rows.filter(F.col(target).isNotNull() & F.col(probability).between(0, 1))
    bin_ = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return known.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("rows"), F.avg(probability).alias("mean_probability"), F.avg(F.col(target).cast("double")).alias("observed_rate"))


def group_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): whole groups dealt round robin in the order of a hash of their name."""
    groups = rows.select(group).filter(F.col(group).isNotNull()).distinct()
    return hash_numbered(groups, [], F.md5(F.col(group).cast("string")), group, "_no").select(group, ((F.col("_no") - 1) % folds).alias("fold"))


def choose_specification(trials: DataFrame, by: list[str], specification: str) -> DataFrame:
    """Per group the specification with the greatest capture, then the least Brier score, then the least name; incomplete trials don't count."""
    complete = trials.filter("capture is not null and brier is not null")
    return complete.groupBy(*by).agg(F.min(F.struct((-F.col("capture")).alias("c"), F.col("brier").alias("b"), F.col(specification).alias("s")))["s"].alias("chosen"))


def confusion(rows: DataFrame, by: list[str], warned, happened) -> DataFrame:
    """Counts of a warning rule against what happened."""
    return rows.groupBy(*by).agg(
        F.count_if(warned & happened).alias("true_warnings"), F.count_if(warned & ~happened).alias("false_warnings"),
        F.count_if(~warned & happened).alias("missed"), F.count_if(~warned & ~happened).alias("quiet"),
    )


def fit_logistic(rows: DataFrame, features: list[str], target: str, regularisation: float = 0.0):
    """Logistic regression with a ridge penalty on standardised features, fitted by Spark over all complete rows; the intercept is free."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    complete = rows.select(*features, F.col(target).cast("double").alias("label")).dropna()
    steps = [VectorAssembler(inputCols=features, outputCol="_features"), LogisticRegression(featuresCol="_features", regParam=regularisation, elasticNetParam=0.0, maxIter=50)]
    return Pipeline(stages=steps).fit(complete)


def predict_logistic(model, rows: DataFrame, features: list[str], out: str) -> DataFrame:
    """Rows with complete features and their probability in `out`."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows.dropna(subset=features)).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("_features", "rawPrediction", "probability", "prediction")
