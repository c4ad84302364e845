"""Table sources (inventory A1-A3, A7, A8, A11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the header-less flow file, in file order, and its text columns.
FLOW_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count", "srv_count",
    "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label", "difficulty_level",
]
FLOW_TEXT = ["protocol_type", "service", "flag", "label"]

# Attack type -> group.
FLOW_GROUPS = {
    "normal": "Normal",
    **dict.fromkeys(["neptune", "smurf", "pod", "teardrop", "back", "land", "mailbomb", "apache2", "processtable",
                     "udpstorm", "worm"], "DoS"),
    **dict.fromkeys(["ipsweep", "portsweep", "nmap", "satan", "mscan", "saint"], "Probe"),
    **dict.fromkeys(["ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy", "warezclient", "warezmaster",
                     "sendmail", "named", "snmpgetattack", "xlock", "xsnoop", "httptunnel", "snmpguess"], "R2L"),
    **dict.fromkeys(["buffer_overflow", "loadmodule", "perl", "rootkit", "sqlattack", "xterm", "ps"], "U2R"),
}
FLOW_RARE = ["U2R", "R2L"]

# Text columns and rare groups of the second flow data set.
SECOND_TEXT = ["proto", "service", "state"]
SECOND_RARE = ["Analysis", "Backdoor", "Shellcode", "Worms"]


def flow_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType() if c in FLOW_TEXT else T.DoubleType()) for c in FLOW_COLUMNS])


def read_flow_csv(spark: SparkSession, path, schema: T.StructType | None = None, drop=("difficulty_level",)) -> DataFrame:
    """Header-less CSV with a declared schema, so no pass over the data infers it."""
    return spark.read.schema(schema or flow_schema()).csv(path).drop(*drop)


def read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path, drop=("id",)) -> DataFrame:
    """Parquet without its id column, if it has one."""
    return spark.read.parquet(path).drop(*drop)


def read_results(spark: SparkSession, path) -> DataFrame:
    """Nested JSON results of an earlier study."""
    return spark.read.option("multiLine", True).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path is there, on whichever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_sample_or_build(spark: SparkSession, path: str, expected_rows: int, build) -> DataFrame:
    """A saved sample if it has the expected number of rows, else ``build()`` written over it."""
    if path_exists(spark, path):
        saved = spark.read.parquet(path)
        if saved.count() == expected_rows:
            return saved
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_runs(spark: SparkSession, path: str, n_runs: int, run: str = "run") -> DataFrame:
    """All runs 0..n_runs - 1 of a data set partitioned by run number; a missing run is an error, others are left out."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    df = df.filter(F.col(run).between(0, n_runs - 1))
    missing = set(range(n_runs)) - {r[0] for r in df.select(run).distinct().collect()}  # n_runs rows at most
    if missing:
        raise FileNotFoundError(f"runs {sorted(missing)} missing under {path}")
    return df
