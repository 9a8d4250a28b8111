"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_DIR_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "cohortlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this package is designed for.

    Adaptive execution re-plans shuffles at run time and splits skewed join partitions; shuffle partition counts are left
    to the cluster's own configuration unless given in ``conf`` (dots written as double underscores).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; makes sure one is set.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session may fall back to a temporary
    folder: on a cluster that would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_DIR_KEY, None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR_KEY} to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="cohortlens-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut of the lineage that outlives any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of levels or estimates held in the plan itself: its size is known to the planner, and reading it is no job."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    columns = [pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application; a no-op where it is already shipped."""
    context = spark.sparkContext
    if getattr(context, "_cohortlens_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="cohortlens-package-")) / "cohortlens.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cohortlens_shipped = True
