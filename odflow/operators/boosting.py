"""Quantile boosting: MLlib grows one tree per level and round on the pinball gradient."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.operators.forest import _assembled
from odflow.operators.validation import QUANTILES
from odflow.session import materialise, scratch_path

# Rank accuracy of the quantile sketch behind base values and leaf values.
ACCURACY = 10_000
# Deepest tree: bounds the leaf tables, which go to every executor.
MAX_DEPTH = 12


def _level_index(values: Column) -> Column:
    """The entry of ``values``, in the order of the levels, that belongs to the row's level."""
    return F.coalesce(*[F.when(F.col("level") == name, values[i]) for i, name in enumerate(QUANTILES)])


@dataclass
class QuantileBoost:
    """Forecasts p10, p50 and p90, each from its own additive trees.

    Every round grows one tree per level on the gradient of the level's pinball loss; a leaf adds
    ``rate`` times that level's quantile of what is still left in it. With validation rows a level
    stops after ``patience`` rounds without a lower loss on them and keeps its best round. The three
    forecasts of a row are put in order at the end.

    Forecasts so far are stored after each round, in two folders written in turn, so neither the
    lineage nor the disk grows with the rounds. Leaf values come from a sketch that is merged on the map
    side: a leaf with most of the rows is as cheap as any other.
    """

    features: list[str]
    target: str = "volume"
    rounds: int = 40
    depth: int = 4
    rate: float = 0.3
    min_rows: int = 5
    patience: int = 5
    seed: int = 7
    best_rounds: dict[str, int] = field(default_factory=dict)
    _base: dict[str, float] = field(default_factory=dict, repr=False)
    _trees: dict[str, list[DecisionTreeRegressionModel]] = field(default_factory=dict, repr=False)
    _leaves: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not 1 <= self.depth <= MAX_DEPTH:
            raise ValueError(f"depth must be between 1 and {MAX_DEPTH}")

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> "QuantileBoost":
        """Learn from ``train``; ``valid`` has the same columns and only decides when to stop."""
        rows = self._rows(train, False)
        if valid is not None:
            rows = rows.unionByName(self._rows(valid, True))
        rows = materialise(rows, "boost-rows")
        base = rows.filter(~F.col("_valid")).agg(
            F.percentile_approx("_label", list(QUANTILES.values()), ACCURACY)
        ).first()[0]
        if base is None:
            raise ValueError("no training rows")
        self._base = dict(zip(QUANTILES, map(float, base), strict=True))
        store = self._two_folders(rows.sparkSession)
        state = rows.withColumns({f"_at_{name}": F.lit(value) for name, value in self._base.items()})
        best = self._losses(state) if valid is not None else {}
        self._trees = {name: [] for name in QUANTILES}
        self.best_rounds = dict.fromkeys(QUANTILES, 0)
        tables = []
        for k in range(self.rounds):
            live = [name for name in QUANTILES if not best or k - self.best_rounds[name] < self.patience]
            if not live:
                break
            with ThreadPoolExecutor(len(live)) as pool:  # small jobs of one round, side by side
                grown = list(pool.map(lambda name: self._grow(state, name, k), live))
            for name, tree in zip(live, grown, strict=True):
                self._trees[name].append(tree)
            placed = PipelineModel(grown).transform(state)
            tables.append(materialise(self._leaf_values(placed, live, k), "boost-leaves"))
            state = store(self._moved(placed, tables[-1], live, k), k)
            losses = self._losses(state) if best else {}
            for name in live:
                if not best or losses[name] < best[name]:
                    self.best_rounds[name] = k + 1
                    best.update({name: losses[name]} if best else {})
        for name in QUANTILES:
            self._trees[name] = self._trees[name][: self.best_rounds[name]]
        self._leaves = self._stacked(rows.sparkSession, tables)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Add p10, p50 and p90; a projection, without shuffle or join."""
        if not self._base:
            raise RuntimeError("call fit before predict")
        models = [tree for trees in self._trees.values() for tree in trees]
        placed = PipelineModel(models).transform(_assembled(df, self.features))
        placed = placed.withColumns({f"_values_{name}": self._table(name) for name in QUANTILES if self.best_rounds[name]})
        levels = F.array_sort(F.array(*[self._total(name) for name in QUANTILES]))
        kept = [c for c in df.columns if c not in QUANTILES]
        placed = placed.withColumn("_levels", levels)
        return placed.select(*kept, *[F.col("_levels")[i].alias(name) for i, name in enumerate(QUANTILES)])

    def save(self, path: str, spark: SparkSession) -> None:
        models = [tree for trees in self._trees.values() for tree in trees]
        PipelineModel(models).write().overwrite().save(f"{path}/trees")
        self._leaves.write.mode("overwrite").parquet(f"{path}/leaves")
        spark.createDataFrame(
            [(self.features, self.target, self._base, self.best_rounds)],
            "features array<string>, target string, base map<string,double>, rounds map<string,int>",
        ).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "QuantileBoost":
        row = spark.read.parquet(f"{path}/model").first()
        stages = iter(PipelineModel.load(f"{path}/trees").stages)
        trees = {name: [next(stages) for _ in range(row["rounds"][name])] for name in QUANTILES}
        return cls(
            features=list(row["features"]), target=row["target"], best_rounds=dict(row["rounds"]),
            _base=dict(row["base"]), _trees=trees, _leaves=spark.read.parquet(f"{path}/leaves"),
        )

    def _rows(self, df: DataFrame, valid: bool) -> DataFrame:
        data = _assembled(df.select(*dict.fromkeys([*self.features, self.target])), self.features)
        label = F.col(self.target).cast("double").alias("_label")
        return data.select("_features", label, F.lit(valid).alias("_valid")).filter(F.col("_label").isNotNull())

    def _two_folders(self, spark: SparkSession) -> Callable[[DataFrame, int], DataFrame]:
        paths = [scratch_path(spark, "boost-state") for _ in range(2)]

        def store(df: DataFrame, k: int) -> DataFrame:
            df.write.mode("overwrite").parquet(paths[k % 2])
            return spark.read.schema(df.schema).parquet(paths[k % 2])

        return store

    def _grow(self, state: DataFrame, name: str, k: int) -> DecisionTreeRegressionModel:
        level = QUANTILES[name]
        above = F.col("_label") > F.col(f"_at_{name}")
        slope = state.filter(~F.col("_valid")).select(
            "_features", F.when(above, level).otherwise(level - 1.0).alias("_slope")
        )
        return DecisionTreeRegressor(
            featuresCol="_features", labelCol="_slope", predictionCol="", leafCol=f"_leaf_{name}_{k}",
            maxDepth=self.depth, minInstancesPerNode=self.min_rows, seed=self.seed,
        ).fit(slope)

    def _leaf_values(self, placed: DataFrame, live: list[str], k: int) -> DataFrame:
        """What each leaf of the round adds, as (level, round, leaf, value)."""
        entries = [
            F.struct(
                F.lit(name).alias("level"),
                F.col(f"_leaf_{name}_{k}").cast("int").alias("leaf"),
                (F.col("_label") - F.col(f"_at_{name}")).alias("rest"),
            )
            for name in live
        ]
        rest = placed.filter(~F.col("_valid")).select(F.inline(F.array(*entries)))
        found = rest.groupBy("level", "leaf").agg(
            F.percentile_approx("rest", list(QUANTILES.values()), ACCURACY).alias("q")
        )
        return found.select("level", F.lit(k).alias("round"), "leaf", (self.rate * _level_index(F.col("q"))).alias("value"))

    def _moved(self, placed: DataFrame, leaves: DataFrame, live: list[str], k: int) -> DataFrame:
        for name in live:  # 2 ** depth rows each
            own = leaves.filter(F.col("level") == name).select(
                F.col("leaf").cast("double").alias(f"_leaf_{name}_{k}"), F.col("value").alias(f"_add_{name}")
            )
            placed = placed.join(F.broadcast(own), f"_leaf_{name}_{k}", "left")
        at = {
            name: F.col(f"_at_{name}") + (F.coalesce(f"_add_{name}", F.lit(0.0)) if name in live else 0.0)
            for name in QUANTILES
        }
        return placed.select("_features", "_label", "_valid", *[c.alias(f"_at_{name}") for name, c in at.items()])

    def _losses(self, state: DataFrame) -> dict[str, float]:
        """Mean pinball loss of each level over the validation rows."""
        means = []
        for name, level in QUANTILES.items():
            miss = F.col("_label") - F.col(f"_at_{name}")
            means.append(F.avg(F.greatest(level * miss, (level - 1) * miss)).alias(name))
        found = state.filter("_valid").agg(*means).first().asDict()
        if None in found.values():
            raise ValueError("no validation rows")
        return found

    def _stacked(self, spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
        """The leaf values of all rounds as one stored table of (level, round, values by leaf id)."""
        rows = spark.createDataFrame([], "level string, round int, leaf int, value double")
        for table in tables:
            rows = rows.unionByName(table)
        values = F.array_sort(F.collect_list(F.struct("leaf", "value")))
        stacked = rows.groupBy("level", "round").agg(values.alias("v"), (F.max("leaf") + 1).alias("n"))
        stacked = materialise(stacked, "boost-leaves")
        if stacked.filter(F.size("v") != F.col("n")).count():
            raise ValueError("a leaf without training rows")
        return stacked.select("level", "round", F.col("v.value").alias("values"))

    def _table(self, name: str) -> Column:
        """Leaf values of a level by round and leaf, as one scalar; rounds * 2 ** depth numbers at most."""
        kept = self._leaves.filter((F.col("level") == name) & (F.col("round") < self.best_rounds[name]))
        return kept.agg(F.array_sort(F.collect_list(F.struct("round", "values"))).alias("t")).select("t.values").scalar()

    def _total(self, name: str) -> Column:
        total = F.lit(self._base[name])
        for k in range(self.best_rounds[name]):
            total = total + F.col(f"_values_{name}")[k][F.col(f"_leaf_{name}_{k}").cast("int")]
        return total
