"""Lazy access to the parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import spread

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Tables whose rows are long texts: the work per byte is high.
TEXT_TABLES = ("documents", "pages", "conversations")


class Tables:
    """``tables.orders`` reads ``<folder>/orders.parquet`` when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.cache: dict[str, DataFrame] = {}  # written results that several questions share
        self._loaded: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._loaded:
            scan = self.spark.read.parquet(self.path(name))
            self._loaded[name] = spread(scan) if name in TEXT_TABLES else scan
        return self._loaded[name]

    def register_views(self) -> None:
        for name in TABLE_NAMES:
            getattr(self, name).createOrReplaceTempView(name)
