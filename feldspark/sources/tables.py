"""Readers and writers, incremental input and sampling."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import hash_cuts, hash_key

FEATHER_ROWS_PER_FILE = 100_000


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder all executors can reach: under spark.checkpoint.dir, local only in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="feldspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table_format(path: str) -> str:
    kind = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    formats = {"csv": "csv", "parquet": "parquet", "json": "json", "feather": "feather"}
    if kind not in formats:
        raise ValueError(f"cannot tell the format of {path!r}; expected one of {sorted(formats)}")
    return formats[kind]


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a file or folder of files, by extension. A missing path is Spark's own error."""
    kind = table_format(path)
    if kind == "feather":
        if schema is None:
            raise ValueError("reading feather needs a schema")
        return read_feather(spark, path, schema)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if kind == "json":
        return reader.json(path, multiLine=True)
    return reader.parquet(path)


def save(df: DataFrame, path: str, partition_by: str | list[str] | None = None) -> str:
    """Write by extension, replacing what is there; parents are created."""
    kind = table_format(path)
    if kind == "feather":
        return write_feather(df, path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if kind == "csv":
        writer.csv(path, header=True)
    else:
        getattr(writer, kind)(path)
    return path


def write_feather(df: DataFrame, folder: str, rows_per_file: int = FEATHER_ROWS_PER_FILE) -> str:
    """One or more Arrow IPC files per partition, each of bounded size.

    File names depend on the partition only and appear by rename, so a task that runs
    twice leaves one copy.
    """

    def write(batches):
        import pyarrow as pa
        import pyarrow.feather as feather
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        target, base = fs.FileSystem.from_uri(os.path.abspath(folder) if "://" not in folder else folder)
        target.create_dir(base, recursive=True)
        held, rows, part = [], 0, 0

        def flush():
            nonlocal held, rows, part
            name = f"part-{context.partitionId():05d}-{part:05d}"
            temporary = f"{base}/_{name}-{context.taskAttemptId()}"
            with target.open_output_stream(temporary) as out:
                feather.write_feather(pa.Table.from_batches(held), out, compression="uncompressed")
            target.move(temporary, f"{base}/{name}.feather")
            written = pa.RecordBatch.from_pydict({"file": [f"{name}.feather"], "rows": [rows]})
            held, rows, part = [], 0, part + 1
            return written

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= rows_per_file:
                yield flush()
        if held:
            yield flush()

    written = df.mapInArrow(write, "file string, rows bigint").collect()  # one row per file
    # Files of an earlier write, or of a lost attempt that cut its rows otherwise, do not belong to the table.
    from pyarrow import fs

    target, base = fs.FileSystem.from_uri(os.path.abspath(folder) if "://" not in folder else folder)
    target.create_dir(base, recursive=True)
    kept = {r["file"] for r in written}
    for found in target.get_file_info(fs.FileSelector(base)):
        if found.base_name.endswith(".feather") and found.base_name not in kept:
            target.delete_file(found.path)
    return folder


def read_feather(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """Read a folder of Arrow IPC files, one task slice per file."""

    def decode(batches):
        import pyarrow as pa
        import pyarrow.feather as feather

        for batch in batches:
            for content in batch.column("content"):
                yield from feather.read_table(pa.BufferReader(content.as_buffer())).to_batches()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(folder)
    return files.select("content").mapInArrow(decode, schema)


def sample_fraction(df: DataFrame, fraction: float, id_column: str, seed: int = 42) -> DataFrame:
    """Exactly round(fraction * rows) rows, uniform, the same on every run."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must lie in (0, 1]")
    return _first_by_hash(df, round(fraction * df.count()), id_column, seed)


def sample_n(df: DataFrame, n: int, id_column: str, seed: int = 42) -> DataFrame:
    """min(n, rows) uniform rows."""
    return _first_by_hash(df, min(n, df.count()), id_column, seed)


def _first_by_hash(df: DataFrame, n: int, id_column: str, seed: int) -> DataFrame:
    cut = hash_cuts(df, id_column, seed, {None: [n]})[None][0]
    return df.where(hash_key(id_column, seed) <= F.lit(cut))


def map_batches(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Apply a pandas function to every batch of rows."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def load_incremental(
    spark: SparkSession, folder: str, schema: T.StructType | str, out: str, state: str, files_per_batch: int = 1
) -> DataFrame:
    """Stream a folder of CSV files into a parquet table, a few files at a time, and read it.

    Rerunning with the same ``state`` picks up only files that arrived since.
    """
    stream = (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    )
    run = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def table_info(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows in one row."""
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    nulls = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    return counted.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.lit(len(columns)).cast("bigint").alias("n_cols"),
        F.coalesce(F.sum(nulls * F.col("__n")), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the table size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dtype_counts(df: DataFrame) -> dict[str, int]:
    counts: dict[str, int] = {}
    for field in df.schema:
        counts[field.dataType.simpleString()] = counts.get(field.dataType.simpleString(), 0) + 1
    return counts


def write_predictions(df: DataFrame, label: str, probability: str, path: str) -> DataFrame:
    """Write ``prediction`` and ``probability`` (4 digits) beside the input columns, as CSV."""
    out = df.withColumns({"prediction": F.col(label), "probability": F.round(F.col(probability), 4)})
    out.write.mode("overwrite").csv(path, header=True)
    return out
