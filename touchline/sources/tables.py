"""Table input and output.

``materialise`` writes an intermediate result once to the folder the cluster
names in ``spark.checkpoint.dir`` and reads it back. It cuts the lineage, so a
lost executor costs no recomputation, and the copy is columnar: every reader
prunes its own columns and the optimizer knows the table's size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from touchline import schema


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A parquet path, or the name of a catalog table."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def read_csv(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """CSV with a header line; the schema is given, never inferred."""
    return spark.read.csv(path, header=True, schema=columns, enforceSchema=False)


def read_home_advantage(spark: SparkSession, path: str) -> DataFrame:
    """Fractional home advantage per team (Team, power_ranking, teamid, is_home)."""
    return read_csv(spark, path, schema.HOME_ADVANTAGE)


CORRUPT = "_corrupt_record"


def read_player_models(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Player JSON documents: player, position, move thresholds, transition thresholds.

    The schema is given, never inferred. A document that does not fit it is a row too: its
    text is in ``_corrupt_record`` (null for sound ones), and ``file`` says where it lies.
    ``one_per_file=False`` reads one document per line, in splits of any size.
    """
    columns = StructType([*schema.PLAYER_MODEL.fields, StructField(CORRUPT, StringType())])
    read = spark.read.json(
        path, schema=columns, multiLine=one_per_file, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
    )
    return read.select("*", F.col("_metadata.file_path").alias("file"))


def split_broken(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound documents, and the broken ones as (file, text). Pass a stored table."""
    broken = models.filter(F.col(CORRUPT).isNotNull()).select("file", F.col(CORRUPT).alias("text"))
    return models.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "file"), broken


def create_dataset(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def write_table(frame: DataFrame, name_or_path: str, *partition_by: str) -> None:
    """Write a table, replacing an older one."""
    writer = frame.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in name_or_path:
        writer.save(name_or_path)
    else:
        writer.saveAsTable(name_or_path)


def replace_partitions(frame: DataFrame, path: str, *partition_by: str) -> None:
    """Replace the partitions that ``frame`` has rows of; all others keep their files."""
    writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format("parquet")
    writer.partitionBy(*partition_by).save(path)


def create_catalog_view(spark: SparkSession, dataset: str, name: str, select: str) -> str:
    """A view that outlives temporary ones, kept in a dataset; an older one is dropped first.

    ``select`` is SQL over tables and views of the catalog; Spark refuses one that reads a
    temporary view. Returns the name to read it by.
    """
    create_dataset(spark, dataset)
    full = f"`{dataset}`.`{name}`"
    spark.sql(f"DROP VIEW IF EXISTS {full}")
    spark.sql(f"CREATE VIEW {full} AS {select}")
    return full


def create_view(frame: DataFrame, name: str) -> None:
    """Create a temporary view, replacing an older one."""
    frame.createOrReplaceTempView(name)


def json_text(*fields: str | Column) -> Column:
    """The fields as one JSON object, nulls included."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def json_rows(frame: DataFrame, *keep: str) -> DataFrame:
    """Each row as JSON text in column ``value``, beside the columns to keep."""
    fields: list[str | Column] = [c for c in frame.columns if c not in keep]
    return frame.select(*keep, json_text(*fields).alias("value"))


def write_json(frame: DataFrame, path: str, *partition_by: str) -> None:
    """One JSON object per line, replacing older output."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is the checkpoint folder of the session's settings, or the one set on the
    context; where neither is set, the warehouse, which a cluster shares as well.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where the stored tables of this application lie."""
    return f"{shared_folder(spark)}/touchline/{spark.sparkContext.applicationId}"


def run_table(spark: SparkSession, purpose: str) -> str:
    """A new name for a catalog table that belongs to this application."""
    return f"{_run_prefix(spark)}{purpose}_{uuid.uuid4().hex}"


def _run_prefix(spark: SparkSession) -> str:
    return "touchline_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower() + "_"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_on_the_way: ContextVar[list[str] | None] = ContextVar("_on_the_way", default=None)  # folders stored inside ``stored_alone``


def materialise(frame: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``frame`` once and return the stored table. Runs a job.

    Frames derived from the result read it again, so it must outlive them:
    ``stored_tables`` or ``release`` delete the run's folder when all is done.
    ``schema`` reads the same columns as other types. What the job shuffled is deleted when the table is
    written; otherwise it would stay on disk beside the table until the driver's garbage collection.
    """
    spark = frame.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if (stored := _on_the_way.get()) is not None:
        stored.append(path)
    return spark.read.schema(schema or frame.schema).parquet(path)


def stored_alone(build: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """Store the frame, or the frames, that ``build`` returns and delete the tables it stored on the way. Runs jobs.

    Nothing but the results may read those tables. Calls may be nested: the result of an inner
    one is on the way to the outer one.
    """
    inner: list[str] = []
    token = _on_the_way.set(inner)
    try:
        built = build()
    finally:
        _on_the_way.reset(token)
    frames = built if isinstance(built, tuple) else (built,)
    stored = tuple(materialise(frame) for frame in frames)
    for path in inner:
        _delete(frames[0].sparkSession, path)
    return stored if isinstance(built, tuple) else stored[0]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all stored tables of this application, those in the catalog included."""
    for table in spark.catalog.listTables():
        if table.name.startswith(_run_prefix(spark)):
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    _delete(spark, run_folder(spark))


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[str]:
    """Own the run's stored tables: they are deleted at the end of the block."""
    try:
        yield run_folder(spark)
    finally:
        release(spark)
