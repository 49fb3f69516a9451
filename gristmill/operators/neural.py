"""Feature vectors of findings, and the perceptron and components trained on them with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.scoring import each


def symbol_features(symbols: list[str]) -> dict[str, Column]:
    """One column a symbol: the sum of its scores among the row's findings."""

    def total(symbol: str) -> Column:
        return F.aggregate("findings", F.lit(0.0), lambda a, f: a + F.when(f["symbol"] == symbol, f["score"]).otherwise(0.0))

    return {f"f_{s}": total(s) for s in symbols}


def profile(scored: DataFrame, spam_from: float, ham_below: float, least: int = 10) -> DataFrame:
    """Per symbol: hits in spam and ham rows, and whether it is frequent and telling enough to be a feature."""
    rows = each(scored.select("score", "findings")).select("score", "f.symbol")
    counts = rows.groupBy("symbol").agg(F.count_if(F.col("score") >= spam_from).alias("spam"), F.count_if(F.col("score") < ham_below).alias("ham"))
    return counts.withColumn("kept", (F.col("spam") + F.col("ham") >= least) & (F.col("spam") != F.col("ham")))


def train(rows: DataFrame, features: list[str], label_col: str, hidden: int = 8, components: int | None = None, seed: int = 42, steps: int = 50) -> PipelineModel:
    """Scale features, project them to ``components`` if given, and fit a perceptron with one hidden layer.

    Spark ML aggregates gradients over partitions; only the weights reach the driver.
    """
    stages = [VectorAssembler(inputCols=features, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True)]
    if components:
        stages.append(PCA(k=components, inputCol="__scaled", outputCol="__in"))
    last = "__in" if components else "__scaled"
    stages.append(MultilayerPerceptronClassifier(layers=[components or len(features), hidden, 2], featuresCol=last, labelCol=label_col, probabilityCol="__prob", seed=seed, maxIter=steps))
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with neural_score from -1 (ham) to 1 (spam)."""
    made = model.transform(rows).withColumn("neural_score", vector_to_array("__prob")[1] * 2 - 1)
    return made.select(*rows.columns, "neural_score")


def components(rows: DataFrame, vector_col: str, k: int) -> list[list[float]]:
    """The first ``k`` principal components of an array column; the result is dimensions times k numbers."""
    from pyspark.ml.functions import array_to_vector

    fitted = PCA(k=k, inputCol="__v", outputCol="__p").fit(rows.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("__v")))
    return fitted.pc.toArray().T.tolist()
