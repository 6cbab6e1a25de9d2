"""The ontology as small tables: node classes, relations, checks; built from a dictionary or a YAML mapping."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Node classes with their key, and relations with their ends.
NODES = {"Paper": "paper_id", "PDFFile": "pdf_id", "HafniaMaterial": "canonical_name", "ThinFilmSample": "sample_id", "FabricationProcess": "process_id", "Electrode": "name", "Substrate": "name", "Device": "device_type", "Dopant": "element", "PhaseStructure": "phase_name", "FerroelectricProperty": "fact_id", "Evidence": "evidence_id"}
RELATIONS = [
    ("REPORTS", "Paper", "HafniaMaterial"), ("HAS_PDF", "Paper", "PDFFile"), ("HAS_SAMPLE", "HafniaMaterial", "ThinFilmSample"), ("HAS_DOPANT", "HafniaMaterial", "Dopant"), ("FABRICATED_BY", "ThinFilmSample", "FabricationProcess"), ("HAS_TOP_ELECTRODE", "ThinFilmSample", "Electrode"), ("HAS_BOTTOM_ELECTRODE", "ThinFilmSample", "Electrode"),
    ("ON_SUBSTRATE", "ThinFilmSample", "Substrate"), ("HAS_PHASE", "ThinFilmSample", "PhaseStructure"), ("USED_IN", "ThinFilmSample", "Device"), ("HAS_PROPERTY", "ThinFilmSample", "FerroelectricProperty"), ("SUPPORTED_BY", "FerroelectricProperty", "Evidence"), ("FROM_PAPER", "Evidence", "Paper"), ("COMPARED_WITH", "FerroelectricProperty", "FerroelectricProperty"),
]


def load(path: str) -> dict:
    """A YAML mapping; anything else is refused."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got


def default() -> dict:
    return {"nodes": NODES, "relations": [list(r) for r in RELATIONS]}


def checksum(onto: dict) -> str:
    return hashlib.sha256(json.dumps(onto, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def node_table(spark: SparkSession, onto: dict | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((onto or default())["nodes"].items()), "node_class string, key_field string")


def relation_table(spark: SparkSession, onto: dict | None = None) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in (onto or default())["relations"]], "relation string, source string, target string")


def problems(spark: SparkSession, onto: dict | None = None) -> DataFrame:
    """problem, subject, detail: relations whose ends are no node class, relations given twice, node classes without a key field; empty for a sound ontology."""
    r, n = relation_table(spark, onto), node_table(spark, onto)
    ends = r.selectExpr("relation", "explode(array(source, target)) as node_class").distinct().join(n, "node_class", "left_anti")
    twice = r.groupBy("relation", "source", "target").count().where("count > 1")
    out = ends.selectExpr("'unknown_end' as problem", "relation as subject", "node_class as detail")
    out = out.unionByName(twice.selectExpr("'repeated_relation' as problem", "relation as subject", "concat(source, '>', target) as detail"))
    return out.unionByName(n.where("trim(key_field) = ''").selectExpr("'no_key' as problem", "node_class as subject", "'' as detail"))


def counts(spark: SparkSession, onto: dict | None = None) -> DataFrame:
    """One row: node classes, relations, distinct relation names, node classes that a relation links."""
    r, n = relation_table(spark, onto), node_table(spark, onto)
    linked = r.selectExpr("explode(array(source, target)) as e").agg(F.countDistinct("e").alias("n_linked"))
    return n.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(r.agg(F.count(F.lit(1)).alias("n_relations"), F.countDistinct("relation").alias("n_names"))).crossJoin(linked)  # one row each


def bundle(onto: dict, version: str) -> list[tuple[str, str]]:
    """(file, content) of what is written for a version: the ontology, node classes and relations as CSV, the version record with its checksum."""
    rows = lambda head, body: "\n".join([",".join(head), *(",".join(x) for x in body)]) + "\n"
    record = {"version": version, "checksum": checksum(onto), "nodes": len(onto["nodes"]), "relations": len(onto["relations"])}
    return [
        ("ontology.json", json.dumps(onto, sort_keys=True, ensure_ascii=False, indent=1)), ("nodes.csv", rows(["node_class", "key_field"], sorted(onto["nodes"].items()))),
        ("relations.csv", rows(["relation", "source", "target"], onto["relations"])), ("version.json", json.dumps(record, sort_keys=True)),
    ]


def write_bundle(onto: dict, version: str, folder: str) -> bool:
    """Write the bundle unless the folder holds the same checksum already; whether it was written."""
    import pathlib

    out = pathlib.Path(folder)
    seen = out / "version.json"
    if seen.exists() and json.loads(seen.read_text(encoding="utf-8")).get("checksum") == checksum(onto):
        return False
    out.mkdir(parents=True, exist_ok=True)
    for name, content in bundle(onto, version):
        (out / name).write_text(content, encoding="utf-8")
    return True
