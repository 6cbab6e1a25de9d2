"""The data folder: its root, settings, tables by name, and paths that stay inside it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table


def find_root(start: str | Path, marks: tuple[str, ...] = ("pyproject.toml", ".git")) -> Path:
    """The nearest folder, from the start upwards, that holds one of the marks; the start if none does."""
    start = Path(start).resolve()
    for folder in (start, *start.parents):
        if any((folder / m).exists() for m in marks):
            return folder
    return start


@dataclass(frozen=True)
class Settings:
    """Settings with their defaults; the environment overrides them by CORPUSMILL_NAME."""

    data: str = "data"
    use_model: bool = False
    model_timeout_s: int = 60
    model_max_tokens: int = 4000
    files_per_batch: int = 64

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """A value that can't be read as its type is refused; blank ones count as absent."""
        got = {}
        for f in fields(cls):
            raw = env.get(f"CORPUSMILL_{f.name.upper()}", "").strip()
            if raw:
                kind = type(f.default)
                got[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**got)


class Catalog:
    """Tables of a folder by name; a missing one is named in the error."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def names(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName()[: -len(".parquet")] for x in fs.listStatus(path) if x.getPath().getName().endswith(".parquet"))

    def table(self, name: str, *columns: str) -> DataFrame:
        if name not in self.names():
            raise KeyError(f"no table {name} in {self.folder}; there are {', '.join(self.names())}")
        return read_table(self.spark, self.folder, name, *columns)


def inside(root: str | Path, path: str) -> Path:
    """The path below the root; one that leads out of it is refused."""
    root = Path(root).resolve()
    out = (root / path).resolve()
    if out != root and root not in out.parents:
        raise ValueError(f"{path} leads out of {root}")
    return out


def doi_url(doi: str) -> str:
    return "https://doi.org/" + quote(doi.strip(), safe="/")
