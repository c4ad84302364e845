"""Table sinks (inventory A4-A6, A9, A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators.encoding import FrozenOneHot
from tarnfold.operators.scaling import Scaler


def write_csv_once(df: DataFrame, path: str) -> None:
    """CSV with a header; nothing happens when the path exists."""
    df.write.mode("ignore").option("header", True).csv(path)


def write_parquet_once(df: DataFrame, path: str, run: str | None = None) -> None:
    """Parquet, one folder per run if a run column is named; nothing happens when the path exists."""
    writer = df.write.mode("ignore")
    (writer.partitionBy(run) if run else writer).parquet(path)


def nested_results(df: DataFrame, by, name: str) -> DataFrame:
    """Rows of each group folded into one array of structs. For result tables: groups hold runs, not data rows."""
    rest = [c for c in df.columns if c not in set(by)]
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def write_json_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, key, vector: str, label: str) -> None:
    """Vectors with their label, as Parquet arrays."""
    df.select(*key, F.col(vector).cast("array<double>").alias(vector), label).write.mode("overwrite").parquet(path)


def save_parameters(spark: SparkSession, path: str, onehot: FrozenOneHot | None = None, scalers: dict | None = None,
                    positions: dict | None = None) -> None:
    """Fitted encoders, scalers and selections as one small parameter table."""
    rows = []
    if onehot:
        rows.append(("onehot", "numeric", 0, onehot.numeric, [], 0.0, 0.0, False))
        rows += [("onehot", c, i + 1, levels, [], 0.0, 0.0, False) for i, (c, levels) in enumerate(onehot.levels.items())]
    for name, s in (scalers or {}).items():
        rows.append(("shift", name, 0, [], [float(v) for v in s.shift], s.base, s.width, s.clipped))
        rows.append(("scale", name, 0, [], [float(v) for v in s.scale], s.base, s.width, s.clipped))
    for name, p in (positions or {}).items():
        rows.append(("positions", name, 0, [], [float(v) for v in p], 0.0, 0.0, False))
    schema = "kind string, name string, place int, texts array<string>, numbers array<double>, base double, width double, clipped boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str):
    """(onehot, scalers, positions) as saved."""
    rows = spark.read.parquet(path).orderBy("kind", "place", "name").collect()
    onehot = FrozenOneHot()
    scalers: dict = {}
    positions: dict = {}
    for r in rows:
        if r["kind"] == "onehot" and r["name"] == "numeric" and r["place"] == 0:
            onehot.numeric = list(r["texts"])
        elif r["kind"] == "onehot":
            onehot.levels[r["name"]] = list(r["texts"])
        elif r["kind"] == "positions":
            positions[r["name"]] = [int(v) for v in r["numbers"]]
        else:
            s = scalers.setdefault(r["name"], Scaler(base=r["base"], width=r["width"], clipped=r["clipped"]))
            setattr(s, r["kind"], list(r["numbers"]))
    return onehot, scalers, positions
