from .catalog import Catalog, Settings, doi_url, find_root, inside
from .sinks import flat, markdown, write_csv, write_jsonl, write_parquet
from .tables import read_csv, read_jsonl, read_lines, read_table

__all__ = ["Catalog", "Settings", "doi_url", "find_root", "inside", "flat", "markdown", "read_csv", "read_jsonl", "read_lines", "read_table", "write_csv", "write_jsonl", "write_parquet"]
