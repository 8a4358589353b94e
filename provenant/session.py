"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows one task may hold for one key before the key is split into blocks (see operators.ordered).
HOT_ROWS_CONF = "spark.provenant.hotKeyRows"
HOT_ROWS_DEFAULT = 2_000_000
_FOLDERS: set[str] = set()
# Written tables and their folders, for ``release``.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
# Spark removes an execution's shuffle files at its end; without it they stay until the driver happens to collect its garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", app: str = "provenant", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    n = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster the executors could not see it.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="provenant-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def app_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder; it is removed when the program ends."""
    folder = f"{shared_folder(spark)}/provenant/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def remove() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone by then
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)

        atexit.register(remove)
    return folder


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that its lineage ends there."""
    return cut_counted(df, partition_by)[0]


def cut_counted(df: DataFrame, partition_by: list[str] | None = None) -> tuple[DataFrame, int]:
    """``cut`` that also tells the number of rows, counted by the write itself."""
    spark = df.sparkSession
    path = f"{app_folder(spark)}/{uuid.uuid4().hex}"
    rows = Observation()
    writer = df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_go(spark):
        writer.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written, int(rows.get["n"])


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """What runs inside leaves no shuffle files behind: its result is written, nothing reads them again."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)


def release(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and nothing reads any more: those a loop has put others in the place of."""
    for table in tables:
        folder = _WRITTEN.pop(table, None)
        if folder is not None:
            spark = table.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))
