"""Session helpers.

The library never creates its own cluster settings: jobs read
``spark.checkpoint.dir`` from the session. A private scratch folder is only
created for ``local[...]`` masters (tests, laptops) when the setting is unset.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tagloom") -> SparkSession:
    """Session for tests and local benchmarks (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # fall back from whole-stage codegen when a generated method is too large
        # for the JIT (8000 bytes); wide projections (36+ waves/tags) otherwise
        # run as interpreted bytecode, ~4x slower
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it from the session.

    Order: an already configured SparkContext folder, then the session setting
    ``spark.checkpoint.dir``; only a local master may fall back to a fresh
    scratch folder. On a cluster an unset folder is an error: executors must
    share it, so a machine-local path would lose checkpoints with the executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder shared by all executors")


_folders: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of the checkpoint folder, inside that of the current :func:`scratch`."""
    base = _folders[-1] if _folders else ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What operators write on their way inside goes to a folder of its own, which is deleted at the end.

    Results that are still to be read must be written elsewhere, or collected, inside.
    """
    folder = scratch_path(spark, "scratch")
    _folders.append(folder)
    try:
        yield folder
    finally:
        _folders.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder as Parquet and read it back: a short lineage that outlives executors.

    Later reads take only the columns they need. Columns of the type ``void``
    are written as null strings, which Parquet can hold.
    """
    path = scratch_path(df.sparkSession, name)
    void = [f.name for f in df.schema if f.dataType == NullType()]
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in void}) if void else df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of a local session this package, once a context, so that jobs can start from any folder.

    On a cluster the package is installed, or passed with ``--py-files``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tagloom_shipped", False) or not sc.master.startswith("local["):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tagloom-package-"), "tagloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._tagloom_shipped = True
