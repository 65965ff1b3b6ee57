"""Text classifiers that check categories of observations, with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CONFIDENCE = 0.90
MIN_ROWS = 10


def fit(train: DataFrame, text: str, label: str, features: int = 4096) -> PipelineModel | None:
    """A multinomial classifier; classes with fewer than MIN_ROWS rows are left out, None if fewer than two stay."""
    enough = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_ROWS).select(label)
    rows = train.join(enough, label, "left_semi").fillna({text: ""})
    if enough.count() < 2:
        return None
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    stages = [index, RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_x", numFeatures=features), LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", maxIter=30, regParam=0.01, family="multinomial"), IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels)]
    return Pipeline(stages=stages).fit(rows)


def check(model: PipelineModel, rows: DataFrame, text: str, label: str) -> DataFrame:
    """Rows with predicted, confidence and suggested: the prediction where it differs and is sure enough."""
    stages = PipelineModel(model.stages[1:])
    out = stages.transform(rows.fillna({text: ""})).withColumn("confidence", F.array_max(vector_to_array("_q")))
    sure = (F.col("confidence") >= MIN_CONFIDENCE) & ~F.col("predicted").eqNullSafe(F.col(label))
    return out.withColumn("suggested", F.when(sure, F.col("predicted"))).drop("_w", "_x", "_p", "_q", "_r")
