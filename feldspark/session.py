"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(cores: str = "8", app: str = "feldspark", **conf: str) -> SparkSession:
    """A local session with the settings the results assume (UTC, adaptive execution)."""
    # Python workers import the package by name, from whatever folder the driver was started in.
    root = str(Path(__file__).resolve().parent.parent)
    known = os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Needed wherever later steps rely on a row placement that a recomputation could
    change (sampled range boundaries, generated ids). The copy is in shared storage, so
    the loss of an executor does not bring back a different placement.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get(
            "spark.checkpoint.dir", None
        )
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="feldspark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of a few driver-side rows as a local relation, whose size the optimizer knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    held = pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(held, fields)
