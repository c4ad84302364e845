"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from tarnfold.operators.encoding import FrozenOneHot
from tarnfold.operators.scaling import Scaler
from tarnfold.session import bounded, cut_lineage, settle
from tarnfold.sources import readers, writers


def test_flow_csv_has_no_header_and_drops_difficulty(spark, tmp_path):
    path = tmp_path / "flows.csv"
    row = ["0", "tcp", "http", "SF"] + ["1"] * 37 + ["normal", "21"]
    path.write_text("\n".join([",".join(row)] * 3) + "\n")
    df = readers.read_flow_csv(spark, str(path))
    assert df.count() == 3 and "difficulty_level" not in df.columns and df.first()["label"] == "normal" and len(df.columns) == 42


def test_write_once_and_sizes(spark, tmp_path):
    path = str(tmp_path / "s")
    built = []

    def build(n):
        def make():
            built.append(n)
            return spark.range(n)
        return make

    assert readers.read_sample_or_build(spark, path, 5, build(5)).count() == 5
    assert readers.read_sample_or_build(spark, path, 5, build(9)).count() == 5
    assert readers.read_sample_or_build(spark, path, 7, build(7)).count() == 7
    assert built == [5, 7]


def test_missing_run_is_an_error(spark, tmp_path):
    path = str(tmp_path / "runs")
    writers.write_parquet_once(spark.range(20).withColumn("run", F.col("id") % 4), path, "run")
    assert readers.read_runs(spark, path, 4).count() == 20
    with pytest.raises(FileNotFoundError):
        readers.read_runs(spark, path, 5)
    with pytest.raises(FileNotFoundError):
        readers.read_runs(spark, path + "x", 5)


def test_parameters_round_trip(spark, tmp_path):
    onehot = FrozenOneHot(["a", "b"], {"p": ["x", "y"], "q": ["z"]})
    writers.save_parameters(spark, str(tmp_path / "p"), onehot, {"u": Scaler([1.0], [2.0], 0.0, 3.0, True)}, {"kept": [4, 7]})
    back, scalers, positions = writers.load_parameters(spark, str(tmp_path / "p"))
    assert back == onehot and scalers["u"] == Scaler([1.0], [2.0], 0.0, 3.0, True) and positions == {"kept": [4, 7]}


def test_bounds(spark):
    big = spark.range(50)
    assert bounded(big, 10) is big and settle(big, 10).count() == big.count()
    assert settle(big, 50).rdd.getNumPartitions() == 1 and settle(big.filter("id < 0")).count() == 0
    assert cut_lineage(big).count() == 50
