"""Writers: CSV with fixed columns, JSON lines, Parquet, small Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns in the order given (missing ones null), nested ones as JSON, flags as 0 or 1."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in columns or df.columns:
        if c not in have:
            out.append(F.lit(None).cast("string").alias(c))
        elif isinstance(have[c], (ArrayType, MapType, StructType)):
            out.append(F.to_json(c).alias(c))
        elif have[c].simpleString() == "boolean":
            out.append(F.col(c).cast("int").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False) -> None:
    """`one_file` is for small exports only: it writes from one task."""
    f = flat(df, columns)
    (f.coalesce(1) if one_file else f).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def markdown(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """A report of small aggregates: up to `most` rows a section, the rest counted (a report's limit)."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "/") for v in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            out.append(f"... and more ({df.count() - most} rows)")
    return "\n".join(out) + "\n"
