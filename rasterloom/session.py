"""Session settings and the two helpers every multi-pass operator needs:
reliable checkpoints and a size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that may be sent to every executor, in rows. Callers pass
# narrow tables (a key and a few numbers), so this is a few megabytes.
BROADCAST_ROWS = 200_000


def build_session(app: str = "rasterloom", **conf) -> SparkSession:
    """A session with the settings the library relies on. Master, memory and
    the number of partitions are the cluster's business; pass them as
    keywords with two underscores for a dot."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(app: str, cores: int | str = "*", **conf) -> SparkSession:
    """A session on this machine, for benches, tools and tests."""
    single = {
        "spark__master": f"local[{cores}]", "spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "16g", "spark__driver__host": "localhost",
    }
    return build_session(app, **{**single, **conf})


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only where all executors are
    this one process may it be missing; a local folder is made then."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared checkpoint folder, so a
    lost executor costs a re-read and not a recomputation. Unlike an RDD
    checkpoint the table is columnar and has a known size, which the join
    planner uses."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS):
    """Materialise a summary table and count it. Returns the table and the
    join hint its size allows: `broadcast` within the bound, else nothing."""
    snapshot = checkpoint(df)
    small = snapshot.count() <= max_rows
    return snapshot, (F.broadcast if small else lambda d: d)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    snapshot, hint = sized(df, max_rows)
    return hint(snapshot)
