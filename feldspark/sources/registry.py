"""Model registry: saved pipelines plus an append-only table of what was saved."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table

SCHEMA = (
    "event string, model string, version string, at timestamp, path string, metrics map<string,double>, "
    "params map<string,string>, features array<string>"
)


class ModelRegistry:
    """Every save and every choice of a champion appends one row; the newest row wins."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, event, model, version, path, metrics, params, features) -> None:
        now = datetime.now(timezone.utc)
        row = (event, model, version, now, path, dict(metrics), {k: str(v) for k, v in params.items()}, list(features))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def log(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/log")

    def save(
        self, model: PipelineModel, name: str, metrics: Mapping[str, float] = (), params: Mapping[str, object] = (), features: Sequence[str] = (),
        champion: bool = False, version: str | None = None,
    ) -> str:
        version = version or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        path = f"{self.folder}/models/{name}/{version}"
        model.write().overwrite().save(path)
        self._append("saved", name, version, path, dict(metrics), dict(params), features)
        if champion:
            self.set_champion(name, version)
        return version

    def set_champion(self, name: str, version: str) -> None:
        self._append("champion", name, version, "", {}, {}, [])

    def versions(self) -> DataFrame:
        """Saved versions, newest first, with the current champion marked."""
        return list_versions(self.log())

    def _pick(self, name: str | None, version: str | None, champion: bool):
        rows = self.versions()
        if name:
            rows = rows.where(F.col("model") == name)
        if version:
            rows = rows.where(F.col("version") == version)
        if champion:
            rows = rows.where("is_champion = 1")
        row = rows.limit(1).collect()
        if not row:
            raise LookupError("no such model version")
        return row[0]

    def load(self, name: str | None = None, version: str | None = None, champion: bool = False) -> PipelineModel:
        """A given version, the champion, or else the newest."""
        return PipelineModel.load(self._pick(name, version, champion)["path"])

    def metadata(self, name: str | None = None, version: str | None = None, champion: bool = False) -> dict:
        return self._pick(name, version, champion).asDict(recursive=True)


def list_versions(log: DataFrame) -> DataFrame:
    saved = log.where("event = 'saved'").drop("event")
    chosen = log.where("event = 'champion'").agg(F.max_by(F.struct("model", "version"), "at").alias("c"))
    champion = chosen.select(F.col("c.model").alias("model"), F.col("c.version").alias("version"), F.lit(1).alias("is_champion"))
    marked = saved.join(champion, ["model", "version"], "left")
    return marked.select(*saved.columns, F.coalesce("is_champion", F.lit(0)).alias("is_champion")).orderBy(F.desc("at"), F.desc("version"))


def registry_rows(spark: SparkSession, rows) -> DataFrame:
    return small_table(spark, rows, SCHEMA)
