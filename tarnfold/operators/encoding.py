"""One-hot encoding with a schema frozen on train (inventory E1, E2)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More levels than this in one column is an error, not a silent cut.
MAX_LEVELS = 10_000


@dataclass
class FrozenOneHot:
    """Numeric columns first, then one 0/1 slot per train level, all levels kept. Levels unseen in train give all zeros."""

    numeric: list = field(default_factory=list)
    levels: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, numeric, categorical, max_levels: int = MAX_LEVELS) -> "FrozenOneHot":
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in categorical])
        seen = train.select(F.inline(pairs)).distinct().filter("level IS NOT NULL")
        rows = seen.limit(max_levels * len(categorical) + 1).collect()
        levels = {c: sorted(r["level"] for r in rows if r["name"] == c) for c in categorical}
        if len(rows) > max_levels * len(categorical) or any(len(v) > max_levels for v in levels.values()):
            raise ValueError(f"more than {max_levels} levels in one column")
        return cls(list(numeric), levels)

    @property
    def names(self) -> list[str]:
        return self.numeric + [f"{c}_{v}" for c, vs in self.levels.items() for v in vs]

    def _cells(self):
        cells = [F.col(c).cast("double") for c in self.numeric]
        for c, vs in self.levels.items():
            cells += [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for v in vs]
        return cells

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, F.array(*self._cells()))

    def transform_wide(self, df: DataFrame, keep=()) -> DataFrame:
        return df.select(*keep, *[c.alias(n) for c, n in zip(self._cells(), self.names)])


def align_columns(train_columns, df: DataFrame, keep=()) -> DataFrame:
    """Exactly the train columns in train order; missing ones are 0, extra ones are dropped."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(c).cast("double") if c in have else F.lit(0.0)).alias(c) for c in train_columns])
