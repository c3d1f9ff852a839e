"""Fitted classifiers as column expressions.

A saved pipeline's logistic regression, decision tree or random forest becomes SQL text over the
assembled columns: a sigmoid of a weighted sum, nested CASE expressions, a mean of those. The
expression is the same in a batch, in a stream and in another engine, needs no vectors, and stays in code
generation (a large forest is summed by trees, each its own column, so that no expression outgrows the compiler).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def linear_sql(coefficients: list[float], intercept: float, columns: list[str]) -> str:
    """Probability of class 1 under a logistic regression."""
    terms = " + ".join([f"CAST({float(intercept)!r} AS DOUBLE)", *[f"CAST({float(w)!r} AS DOUBLE) * {c}" for w, c in zip(coefficients, columns, strict=True)]])
    return f"(1 / (1 + exp(-({terms}))))"


def tree_sql(nodes: dict[int, dict], columns: list[str], node: int = 0) -> str:
    """Share of class 1 in the leaf that a row reaches; ``nodes``: id -> left, right, feature, threshold, stats."""
    n = nodes[node]
    if n["left"] < 0:
        total = sum(n["stats"])
        return f"CAST({(n['stats'][1] / total if total else 0.0)!r} AS DOUBLE)"
    left, right = (tree_sql(nodes, columns, n[side]) for side in ("left", "right"))
    return f"(CASE WHEN {columns[n['feature']]} <= CAST({float(n['threshold'])!r} AS DOUBLE) THEN {left} ELSE {right} END)"


def _saved_nodes(spark: SparkSession, stage) -> dict[int, dict[int, dict]]:
    """Node tables of a tree model or a forest, by tree, read from its saved form (a model: bounded by its depth and trees)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    stage.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    rows = data.select(F.lit(0).alias("tree"), *[F.col(c) for c in ("id", "impurityStats", "leftChild", "rightChild", "split")]) if "id" in data.columns else data.select(
        F.col("treeID").alias("tree"), *[F.col(f"nodeData.{c}") for c in ("id", "impurityStats", "leftChild", "rightChild", "split")])
    out: dict[int, dict[int, dict]] = {}
    for r in rows.collect():
        if r["leftChild"] >= 0 and r["split"]["numCategories"] != -1:
            raise ValueError("categorical splits are not compiled")
        cut = r["split"]["leftCategoriesOrThreshold"]
        out.setdefault(r["tree"], {})[r["id"]] = {
            "left": r["leftChild"], "right": r["rightChild"], "feature": r["split"]["featureIndex"], "threshold": cut[0] if cut else 0.0, "stats": list(r["impurityStats"])}
    return out


def compiled(spark: SparkSession, pipeline) -> dict[str, list[str]]:
    """{prediction column: SQL of its members} of a fitted pipeline of one assembler and binary classifiers; a model is the mean of its members."""
    from pyspark.ml.classification import DecisionTreeClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
    from pyspark.ml.feature import VectorAssembler

    columns: list[str] = []
    out = {}
    for stage in pipeline.stages:
        if isinstance(stage, VectorAssembler):
            columns = stage.getInputCols()
        elif isinstance(stage, LogisticRegressionModel):
            out[stage.getPredictionCol()] = [linear_sql(list(stage.coefficients), stage.intercept, columns)]
        elif isinstance(stage, (DecisionTreeClassificationModel, RandomForestClassificationModel)):
            trees = _saved_nodes(spark, stage)
            out[stage.getPredictionCol()] = [tree_sql(trees[t], columns) for t in sorted(trees)]
        else:
            raise ValueError(f"{type(stage).__name__} is not compiled")
    return out


def probability(members: list[str]) -> Column:
    return sum((F.expr(m) for m in members), F.lit(0.0)) / len(members)


def with_probabilities(df: DataFrame, models: dict[str, list[str]]) -> DataFrame:
    """``df`` (batch or stream) with the probability of class 1 under each compiled model."""
    return df.withColumns({name: probability(members) for name, members in models.items()})
