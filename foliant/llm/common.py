"""What the operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage that all executors see: the one that spark.checkpoint.dir names, or the session's own.

    Where none is set, a temporary one is made if one machine does all, as in tests; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, stored in the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate rows, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], wish: str) -> str:
    """`wish`, or that with more underscores, so that no column has the name in any case of its letters."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id's text, mod 4, is 2. A null id counts as text ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[tuple[int, list]]:
    """(first row, texts or None) of runs of rows with about `most` bytes of text, so that Python objects
    exist for a few megabytes at a time; a longer text is a run of its own."""
    values = batch.column(column)
    if not len(values):
        return
    sizes = values.nbytes / len(values)
    step = max(1, min(len(values), int(most / max(sizes, 1))))
    for first in range(0, len(values), step):
        yield first, values.slice(first, step).to_pylist()
    pa.default_memory_pool().release_unused()  # workers stay; what a batch took goes back
