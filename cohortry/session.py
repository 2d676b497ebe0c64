"""Session settings and the few helpers that look at the running session."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the plans rely on. Skewed joins are split by AQE even where
# that costs one more shuffle, since one person may hold a large share of all
# events.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Largest row count that is ever broadcast. Codesets, concept groups and study
# lists have rows of two or three longs, so this stays below about 100 MB.
BROADCAST_ROWS = 2_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "cohortry", **conf: str) -> SparkSession:
    """Build (or get) a session with SETTINGS; ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Shuffled bytes that one task reads, and how many times the input the largest exchange holds. A task keeps
# the rows it sorts and groups unpacked, in about twenty times the bytes it reads.
TASK_BYTES = 16 << 20
SHUFFLED = 2


def fit_tasks(spark: SparkSession, paths: Iterable[str]) -> None:
    """Bound what a task holds: shuffles over tables of this size have enough partitions, and few are merged.

    Without it a shuffle has as many partitions as the session names, however large the tables are.
    """
    parts = -(-stored_bytes(spark, paths) * SHUFFLED // TASK_BYTES)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                   str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)))


def stored_bytes(spark: SparkSession, paths: Iterable[str]) -> int:
    """Size of the files under some paths; those that do not exist have none."""
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(conf)
        if files.exists(place):
            total += files.getContentSummary(place).getLength()
    return total


def scanned_bytes(df: DataFrame) -> int:
    """Size of the tables that a plan reads, each as often as it reads it; a source that does not tell its size has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count to at most ``max_rows + 1``."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a count proves that ``df`` is small.

    Above the limit the frame is returned as it is and Spark shuffles.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can see: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine may name none: it gets a local temporary
    folder. On a cluster executors would not see each other's files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="cohortry-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that lost executors do not restart the whole plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "date": pa.date32(), "timestamp": pa.timestamp("us", tz="UTC"),
}


def small_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A settings list as a DataFrame.

    It becomes a local relation of known size, which Spark broadcasts by itself;
    no Python worker is started.
    """
    columns = [column.split() for column in ddl.split(",")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in columns])
    data = [pa.array([row[i] for row in rows], schema.field(i).type) for i in range(len(columns))]
    return spark.createDataFrame(pa.Table.from_arrays(data, schema=schema))
