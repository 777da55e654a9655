"""Session helpers shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_spark(master: str | None = None, app: str = "panelwise", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow).

    On a cluster the master, memory and shuffle width come from spark-submit;
    the arguments here are for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("PANELWISE_DRIVER_MEMORY", "12g"))
        builder = builder.config("spark.ui.enabled", "false") \
            .config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a folder under the system temp path is made and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="panelwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives a lost executor)."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Intermediate tables that this process has written and not dropped.
_tables: list[str] = []


def tables_made() -> list[str]:
    return list(_tables)


def drop_tables(spark: SparkSession, paths: list[str], keep: list[str]) -> None:
    """Delete intermediate tables, but those that hold one of the files in ``keep``."""
    for path in paths:
        name = path.rstrip("/").rpartition("/")[2]
        if path in _tables and not any(f"/{name}/" in file for file in keep):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            _tables.remove(path)


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, to be found by ``drop_tables``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    For loops: a checkpoint keeps the size estimate of its plan, and estimates
    of joins multiply from round to round; a table has its real size.
    """
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table built from literals inside the plan (no driver data transfer)."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
