"""Gradient-boosted trees: fitted by Spark ML, scored as plain column expressions."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, features: list[str], label: str, trees: int = 12, depth: int = 3, weight: str | None = None, bins: int = 32) -> list[tuple[float, tuple]]:
    """Trees as ``(weight, node)``; a node is ``(value,)`` or ``(feature index, threshold, left, right)``.

    With one class only, or no rows, the model is a constant (one leaf).
    """
    seen = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("double")).count().collect()}
    if len(seen) < 2:
        return [(1.0, (1.0 if seen.get(1.0) else -1.0,))]
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(rows.select(*features, F.col(label).cast("double").alias("_label"), *([weight] if weight else [])))
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=bins, cacheNodeIds=False)
    if weight:
        gbt = gbt.setWeightCol(weight)
    model = gbt.fit(data)
    return [(float(w), _node(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def _node(node) -> tuple:
    if node.subtreeDepth() == 0:
        return (float(node.prediction()),)
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _node(node.leftChild()), _node(node.rightChild()))


def margin(trees: list[tuple[float, tuple]], columns: list[Column]) -> Column:
    """The weighted sum of all trees as nested CASE expressions."""

    def walk(node: tuple) -> Column:
        if len(node) == 1:
            return F.lit(node[0])
        return F.when(columns[node[0]] <= F.lit(node[1]), walk(node[2])).otherwise(walk(node[3]))

    total = F.lit(0.0)
    for w, t in trees:
        total = total + walk(t) * F.lit(w)
    return total


def probability(trees: list[tuple[float, tuple]], columns: list[Column]) -> Column:
    """Probability of class 1 under the logistic loss that the trees were fitted with."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(margin(trees, columns) * -2.0))
