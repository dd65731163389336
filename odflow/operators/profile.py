"""A baseline model: quantiles of the target by a few discrete features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.operators.validation import QUANTILES
from odflow.session import small_side

# Features with few values that a profile is cut by, where the model may use them.
CELLS = ("hour_of_day", "origin_disruption_flag")


@dataclass
class QuantileProfile:
    """Forecasts p10, p50 and p90: the exact quantiles of the training target in the row's cell.

    A cell is a combination of those of ``cells`` that are among the features; a cell without
    training rows takes the quantiles of all of them. The target is an hourly count, so a cell collapses to
    its distinct counts on the map side, and the table of cells has a row per combination.
    """

    features: list[str]
    target: str = "volume"
    cells: tuple[str, ...] = CELLS
    _table: DataFrame | None = field(default=None, repr=False)
    _all: DataFrame | None = field(default=None, repr=False)

    def _keys(self) -> list[str]:
        return [c for c in self.cells if c in self.features]

    def fit(self, train: DataFrame) -> "QuantileProfile":
        levels = F.array(*map(F.lit, QUANTILES.values()))
        found = F.percentile(F.col(self.target).cast("double"), levels)
        self._table = small_side(train.groupBy(*self._keys()).agg(found.alias("_found")))
        self._all = train.agg(found.alias("_found"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self._table is None:
            raise RuntimeError("call fit before predict")
        keys = self._keys()
        placed = df.join(self._table, keys, "left") if keys else df.withColumn("_found", F.lit(None).cast("array<double>"))
        levels = F.coalesce("_found", self._all.scalar())
        kept = [c for c in df.columns if c not in QUANTILES]
        return placed.select(*kept, *[levels[i].alias(name) for i, name in enumerate(QUANTILES)])
