"""Supervised classifiers on session vectors, and text vectors, from Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from logweir.functions.text import tokenize_ws
from logweir.functions.vectors import adaptive_avg_pool


def _prepared(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("_y", F.col("label").cast("double"))


def _predict(model, vectors: DataFrame, vector: str) -> DataFrame:
    scored = model.transform(vectors.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))))
    return scored.withColumn("pred", F.col("_pred").cast("int"))


def logistic_regression(train: DataFrame, test: DataFrame, c: float = 100.0, max_iter: int = 100, tol: float = 0.01, vector: str = "features") -> DataFrame:
    """L2-penalised; ``c`` weighs the summed loss, so the mean-loss penalty is 1 / (c n)."""
    data = _prepared(train, vector)
    lr = LogisticRegression(
        featuresCol="_x", labelCol="_y", predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw",
        regParam=1.0 / (c * max(data.count(), 1)), elasticNetParam=0.0, maxIter=max_iter, tol=tol, standardization=False,
    )
    out = _predict(lr.fit(data), test, vector)
    return out.withColumn("probability", F.get(vector_to_array("_prob"), F.lit(1))).drop("_x", "_prob", "_raw", "_pred")


def linear_svm(train: DataFrame, test: DataFrame, c: float = 1.0, max_iter: int = 100, vector: str = "features") -> DataFrame:
    """Linear boundary with hinge loss and L2 penalty (Spark offers no L1 or squared hinge)."""
    data = _prepared(train, vector)
    svm = LinearSVC(
        featuresCol="_x", labelCol="_y", predictionCol="_pred", rawPredictionCol="_raw", regParam=1.0 / (c * max(data.count(), 1)), maxIter=max_iter, standardization=False
    )
    return _predict(svm.fit(data), test, vector).drop("_x", "_raw", "_pred")


def decision_tree(train: DataFrame, test: DataFrame, max_depth: int = 30, vector: str = "features") -> DataFrame:
    """Gini tree; 30 is the depth Spark allows at most."""
    tree = DecisionTreeClassifier(
        featuresCol="_x", labelCol="_y", predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw", impurity="gini", maxDepth=max_depth, seed=1
    )
    return _predict(tree.fit(_prepared(train, vector)), test, vector).drop("_x", "_prob", "_raw", "_pred")


def session_classifier(train: DataFrame, test: DataFrame, cut: float = 0.2, vector: str = "features") -> DataFrame:
    """Probability that a session is normal; anomalous below ``cut``."""
    flipped = train.withColumn("label", 1 - F.col("label"))
    out = logistic_regression(flipped, test, c=1.0, vector=vector)
    return out.withColumnRenamed("probability", "normal_probability").withColumn("pred", (F.col("normal_probability") < cut).cast("int"))


def text_vectorizer(messages: DataFrame, text: str = "msg", hashed: int = 384, bins: int = 256) -> DataFrame:
    """Fixed-length vector per text: hashed token counts, pooled to ``bins`` values."""
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=hashed)
    counted = tf.transform(messages.withColumn("_tokens", tokenize_ws(F.col(text))))
    return counted.withColumn("vector", adaptive_avg_pool(vector_to_array("_tf"), bins)).drop("_tokens", "_tf")
