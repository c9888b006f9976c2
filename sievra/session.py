"""Session defaults, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Largest row counts that may be broadcast. A narrow row is a few scalars (tens of bytes); with a
# million of them a broadcast stays near 100 MB on every executor.
MAX_BROADCAST_ROWS = 1_000_000

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(app_name: str = "sievra", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for one machine, as the tests and the benchmark use it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in tasks are found there by import, and a worker has neither the folder nor the
    path of the driver. Not needed where the package is installed on all machines.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        name = os.path.basename(package)
        archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), name)
        spark.sparkContext.addPyFile(
            shutil.make_archive(archive, "zip", root_dir=os.path.dirname(package), base_dir=name)
        )
        _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a single-machine session may go without that setting; it then gets one folder of its own
    per application. On a cluster a missing setting is an error, because a folder of one machine
    would be lost with it.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="sievra-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the scratch folder."""
    return f"{scratch_root(spark)}/sievra/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table.

    Later steps then read the rows instead of computing them again, a lost executor costs no
    recomputation of what came before, and counting the rows is a metadata read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows.

    A full count, which tables answer from their metadata; a limit would move up to ``max_rows`` rows
    of every partition into one task.
    """
    return df.count() <= max_rows


def broadcast_if_fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its size is checked to be small, else leave the choice to Spark."""
    return F.broadcast(df) if fits(df, max_rows) else df


def unnest(df: DataFrame, array: Column, *names: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus one row per element of ``array``: ``(pos, element)`` or ``(element,)``.

    A plain explode makes Spark repeat the array expression in a filter for empty arrays, twice; when
    the array is an analysed text that triples the work. The outer form has no such filter, and the
    rows it adds for empty arrays are dropped by their null position.
    """
    pos = names[0] if len(names) == 2 else "__pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, names[-1]))
    return rows.where(F.col(pos).isNotNull()).select(*keep, *names)
