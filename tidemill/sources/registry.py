"""Tables by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources.readers import FORMATS, DatasetRef, load
from tidemill.sources.writers import write_table


def clean_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", name)


class TableRegistry:
    """Maps names to addresses; registered tables are also temporary views."""

    def __init__(self, spark: SparkSession, table_dir: str | None = None) -> None:
        self.spark = spark
        self.table_dir = table_dir
        self.refs: dict[str, DatasetRef] = {}

    def register(self, name: str, ref: DatasetRef | str, view: bool = True) -> None:
        ref = DatasetRef(ref) if isinstance(ref, str) else ref
        self.refs[name] = ref
        if view:
            load(self.spark, ref).createOrReplaceTempView(re.sub(r"\W", "_", name))

    def resolve(self, name: str) -> DatasetRef:
        """The address of a registered name; anything that looks like a path is its own."""
        if name in self.refs:
            return self.refs[name]
        if "/" in name or name.rsplit(".", 1)[-1].lower() in FORMATS:
            return DatasetRef(name)
        raise ValueError(f"Unknown dataset: {name!r}. Available: {sorted(self.refs)}")

    def load(self, name: str) -> DataFrame:
        return load(self.spark, self.resolve(name))

    def ingest(self, path: str, name: str | None = None, format: str | None = None) -> dict:
        """Takes an arriving file into the table folder as Parquet and registers it."""
        if self.table_dir is None:
            raise ValueError("this registry has no table folder")
        stem = path.rstrip("/").split("/")[-1]
        safe = clean_name(name or (stem.rsplit(".", 1)[0] if "." in stem else stem))
        df = load(self.spark, DatasetRef(path, format))
        target = f"{self.table_dir.rstrip('/')}/{safe}"
        write_table(df, target, mode="overwrite")
        self.register(safe, DatasetRef(target, "parquet"))
        stored = self.load(safe)
        return {"name": safe, "path": target, "rows": stored.count(), "columns": stored.columns}
