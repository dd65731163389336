"""Quantile regression forest: MLlib grows the trees, Spark SQL holds the leaf quantiles."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflow.operators.validation import QUANTILES


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    # MLlib wants numeric input columns; flags and bytes are widened here.
    numeric = df.select("*", *[F.col(c).cast("double").alias(f"_f_{c}") for c in features])
    out = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_features").transform(numeric)
    return out.drop(*[f"_f_{c}" for c in features])


def leaf_quantiles(leaves: DataFrame, target: str) -> DataFrame:
    """Quantiles of the target per (tree, leaf).

    The target is an hourly count: rows first collapse to one per distinct count
    and leaf, before any shuffle, and only those are ordered.
    """
    counts = leaves.groupBy("tree", "leaf", target).agg(F.count(F.lit(1)).alias("c"))
    by_leaf = Window.partitionBy("tree", "leaf")
    upto = F.sum("c").over(by_leaf.orderBy(target).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "n": F.sum("c").over(by_leaf)})
    picks = []
    for name, level in QUANTILES.items():
        place = F.lit(level) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)

        def at(rank):
            return F.max(
                F.when((rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto")), F.col(target))
            )

        picks += [at(low).alias(f"{name}_low"), at(high).alias(f"{name}_high"),
                  F.max(place - low).alias(f"{name}_part")]
    found = ranked.groupBy("tree", "leaf").agg(*picks)
    values = [
        (F.col(f"{q}_low") + (F.col(f"{q}_high") - F.col(f"{q}_low")) * F.col(f"{q}_part"))
        .cast("double")
        .alias(q)
        for q in QUANTILES
    ]
    return found.select("tree", "leaf", *values)


@dataclass
class QuantileForest:
    """Forecasts p10, p50 and p90 from one random forest.

    ``fit`` grows the trees on the mean and keeps, per leaf, the quantiles of the
    training targets that fall into it; a forecast is the mean of a row's leaf
    quantiles over the trees, so p10 <= p50 <= p90 always holds. The leaf table
    has at most ``trees * 2**depth`` rows, whatever the training table.
    """

    features: list[str]
    target: str = "volume"
    trees: int = 20
    depth: int = 6
    min_rows: int = 5
    seed: int = 7
    _model: RandomForestRegressionModel | None = field(default=None, repr=False)
    _leaves: list[list[list[float]]] | None = field(default=None, repr=False)

    def fit(self, train: DataFrame) -> "QuantileForest":
        data = _assembled(train.select(*dict.fromkeys([*self.features, self.target])), self.features)
        data = data.select("_features", F.col(self.target).cast("double").alias("_label"))
        forest = RandomForestRegressor(
            featuresCol="_features", labelCol="_label", leafCol="_leaf", numTrees=self.trees,
            maxDepth=self.depth, minInstancesPerNode=self.min_rows, seed=self.seed,
            featureSubsetStrategy="onethird", subsamplingRate=0.8,
        )
        self._model = forest.fit(data)
        in_leaves = self._model.transform(data).select(
            "_label", F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf")
        )
        table = leaf_quantiles(in_leaves.withColumn("leaf", F.col("leaf").cast("int")), "_label")
        # At most trees * 2**depth rows.
        nested: list[dict[int, list[float]]] = [{} for _ in range(self.trees)]
        for row in table.collect():
            nested[row["tree"]][row["leaf"]] = [row[q] for q in QUANTILES]
        for tree, leaves in zip(self._model.trees, nested, strict=True):
            # a binary tree has one leaf more than inner nodes; leaves are addressed by their id
            if sorted(leaves) != list(range((tree.numNodes + 1) // 2)):
                raise ValueError("a leaf without training rows: fit on a stored table")
        self._leaves = [[leaves[i] for i in sorted(leaves)] for leaves in nested]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Add p10, p50 and p90; a projection, without shuffle or join."""
        if self._model is None or self._leaves is None:
            raise RuntimeError("call fit before predict")
        placed = self._model.transform(_assembled(df, self.features))
        leaves = vector_to_array("_leaf")
        table = self._leaf_array()
        found = F.transform(leaves, lambda leaf, tree: table[tree][leaf.cast("int")])
        placed = placed.withColumn("_found", found)
        means = {name: self._mean("_found", i) for i, name in enumerate(QUANTILES)}
        return placed.withColumns(means).select(*df.columns, *means)

    def _mean(self, found: str, quantile: int) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda total, q: total + q[quantile]) / self.trees

    def _leaf_array(self) -> Column:
        """The leaf table as one constant, parsed while the plan is optimised."""
        return F.from_json(F.lit(json.dumps(self._leaves)), "array<array<array<double>>>")

    def save(self, path: str, spark: SparkSession) -> None:
        self._model.write().overwrite().save(f"{path}/trees")
        spark.createDataFrame(
            [(self._leaves, self.features, self.target)],
            "leaves array<array<array<double>>>, features array<string>, target string",
        ).write.mode("overwrite").parquet(f"{path}/leaves")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "QuantileForest":
        row = spark.read.parquet(f"{path}/leaves").first()
        model = RandomForestRegressionModel.load(f"{path}/trees")
        return cls(
            features=list(row["features"]), target=row["target"], trees=model.getNumTrees,
            depth=model.getMaxDepth(), _model=model,
            _leaves=[[list(leaf) for leaf in tree] for tree in row["leaves"]],
        )
