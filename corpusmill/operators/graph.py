"""Property graph of facts: nodes (last fact wins for attributes), edges as a bag, triples, summary, neighbourhoods, layout, HTML export."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import node_id

from .numbering import numbered

# Column and spacing of each node type in the layout.
COLUMNS = ["Paper", "HafniaMaterial", "ThinFilmSample", "FabricationProcess", "Electrode", "Substrate", "Device", "Dopant", "PhaseStructure", "FerroelectricProperty", "Evidence"]


def _ids(f: DataFrame) -> DataFrame:
    """The frame with one identifier column per node kind; null where the fact has no such node. Needs paper_id, fact_id, title, material, property_name, value, unit, evidence_text, sample, phases, devices, dopants, process_summary, stack."""
    name = F.coalesce(F.nullif(F.trim("material"), F.lit("")), F.lit("HfO2"))
    sample_label = F.coalesce(F.col("stack"), F.concat(name, F.lit(" sample")))
    return f.withColumn("__mat", name).withColumn("__slabel", sample_label).select(
        "*", node_id("Paper", F.coalesce("paper_id", F.lit("unknown"))).alias("paper_n"), node_id("HafniaMaterial", F.col("__mat")).alias("material_n"), node_id("ThinFilmSample", F.concat("fact_id", F.lit("_"), F.col("__slabel"))).alias("sample_n"),
        node_id("FerroelectricProperty", F.col("fact_id")).alias("property_n"), node_id("Evidence", F.col("fact_id")).alias("evidence_n"), node_id("Electrode", F.col("sample.top_electrode")).alias("top_n"), node_id("Electrode", F.col("sample.bottom_electrode")).alias("bottom_n"),
        node_id("Substrate", F.col("sample.substrate")).alias("substrate_n"), F.when(F.col("process_summary") != "", node_id("FabricationProcess", F.concat("fact_id", F.lit("_"), F.col("process_summary")))).alias("process_n"),
    )


def device_types(f: DataFrame) -> Column:
    """A sample's form counts as a device type, beside the devices named."""
    return F.array_distinct(F.array_compact(F.concat(F.array(F.col("sample.sample_form")), F.coalesce("devices", F.array().cast("array<string>")))))


def nodes(facts: DataFrame) -> DataFrame:
    """id, type, label, n_facts: one row a node; the label is the last fact's (largest fact_id)."""
    f = _ids(facts).withColumn("__dev", device_types(facts))
    one = lambda t, i, label: F.struct(F.lit(t).alias("type"), i.alias("id"), label.cast("string").alias("label"))
    fixed = F.array(
        one("Paper", F.col("paper_n"), F.coalesce("title", "paper_id")), one("HafniaMaterial", F.col("material_n"), F.col("__mat")), one("ThinFilmSample", F.col("sample_n"), F.col("__slabel")),
        one("FerroelectricProperty", F.col("property_n"), F.concat(F.col("property_name"), F.lit(" "), F.coalesce("unit", F.lit("")))), one("Evidence", F.col("evidence_n"), F.substring("evidence_text", 1, 120)),
        one("Electrode", F.col("top_n"), F.col("sample.top_electrode")), one("Electrode", F.col("bottom_n"), F.col("sample.bottom_electrode")), one("Substrate", F.col("substrate_n"), F.col("sample.substrate")), one("FabricationProcess", F.col("process_n"), F.col("process_summary")),
    )
    dev = F.transform("__dev", lambda d: one("Device", node_id("Device", d), d))
    ph = F.transform(F.coalesce("phases", F.array().cast("array<struct<phase_name:string,space_group:string>>")), lambda p: one("PhaseStructure", node_id("PhaseStructure", p["phase_name"]), p["phase_name"]))
    dop = F.transform("dopants", lambda d: one("Dopant", node_id("Dopant", d), d))
    flat = f.select("fact_id", F.explode(F.concat(fixed, dev, ph, dop)).alias("n")).where(F.col("n.id").isNotNull())
    # partial aggregation keeps a shared node (a paper, a material) from gathering its facts in one task
    return flat.groupBy(F.col("n.id").alias("id"), F.col("n.type").alias("type")).agg(F.max(F.struct("fact_id", "n.label"))["label"].alias("label"), F.count(F.lit(1)).alias("n_facts"))


def edges(facts: DataFrame) -> DataFrame:
    """source, target, type: a bag, as many as the facts give."""
    f = _ids(facts).withColumn("__dev", device_types(facts))
    e = lambda a, b, t: F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(t).alias("type"))
    fixed = F.array(e("paper_n", "material_n", "REPORTS"), e("material_n", "sample_n", "HAS_SAMPLE"), e("sample_n", "property_n", "HAS_PROPERTY"), e("property_n", "evidence_n", "SUPPORTED_BY"), e("evidence_n", "paper_n", "FROM_PAPER"), e("sample_n", "top_n", "HAS_TOP_ELECTRODE"), e("sample_n", "bottom_n", "HAS_BOTTOM_ELECTRODE"), e("sample_n", "substrate_n", "ON_SUBSTRATE"), e("sample_n", "process_n", "FABRICATED_BY"))
    dev = F.transform("__dev", lambda d: F.struct(F.col("sample_n").alias("source"), node_id("Device", d).alias("target"), F.lit("USED_IN").alias("type")))
    ph = F.transform(F.coalesce("phases", F.array().cast("array<struct<phase_name:string,space_group:string>>")), lambda p: F.struct(F.col("sample_n").alias("source"), node_id("PhaseStructure", p["phase_name"]).alias("target"), F.lit("HAS_PHASE").alias("type")))
    dop = F.transform("dopants", lambda d: F.struct(F.col("material_n").alias("source"), node_id("Dopant", d).alias("target"), F.lit("HAS_DOPANT").alias("type")))
    return f.select(F.explode(F.concat(fixed, dev, ph, dop)).alias("e")).select("e.*").where("target is not null")


def neighbours(edge: DataFrame) -> DataFrame:
    """node, neighbour, n: one-hop neighbourhood, both directions, with the number of edges."""
    both = edge.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(edge.select(F.col("target").alias("node"), F.col("source").alias("neighbour")))
    return both.groupBy("node", "neighbour").agg(F.count(F.lit(1)).alias("n"))


def search(node: DataFrame, edge: DataFrame, words: str, types: list[str] | None = None) -> DataFrame:
    """id, type, label, neighbours: nodes whose identifier or label holds the words (case aside), of the types if any are given, with the number of their distinct neighbours."""
    w = words.lower()
    hit = node.where(F.lower("id").contains(w) | F.lower(F.coalesce("label", F.lit(""))).contains(w))
    hit = hit.where(F.col("type").isin(types)) if types else hit
    n = neighbours(edge).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"))
    return hit.select("id", "type", "label").join(n, "id", "left").select("id", "type", "label", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def with_attributes(edge: DataFrame, node: DataFrame) -> DataFrame:
    """The edges with type and label of both ends; ends without a node keep nulls."""
    of = lambda end: node.select(F.col("id").alias(end), F.col("type").alias(f"{end}_type"), F.col("label").alias(f"{end}_label"))
    return edge.join(of("source"), "source", "left").join(of("target"), "target", "left")


def layout(node: DataFrame) -> DataFrame:
    """id, type, x, y: a column per type, rows in order of id, with a small stable shift. A type may hold most nodes: they are ranked by range partitions."""
    x = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in COLUMNS]), F.col("type")), F.lit(0)) * 220
    gap = F.when(F.col("total") < 500, 24).otherwise(16)
    codes = F.transform(F.split("id", ""), lambda c, i: F.ascii(c) * (i + 1))
    shift = (F.aggregate(codes, F.lit(0), lambda a, c: a + c) % 1000) / 1000.0 - 0.5
    return numbered(node.select("id", "type"), ["type"], ["id"], "rank", "total").select("id", "type", x.cast("double").alias("x"), (F.col("rank") * gap - F.col("total") * gap / 2 + shift * 10).alias("y"))


def to_html(node: DataFrame, edge: DataFrame, most: int = 5_000) -> str:
    """A self-contained page that draws at most `most` nodes, those of most facts, and at most four times as many edges between them (a report, so limits are its nature)."""
    drawn = node.orderBy(F.desc("n_facts"), "id").limit(most)
    ns = [r.asDict() for r in layout(drawn).collect()]
    ids = F.broadcast(node.sparkSession.createDataFrame([(n["id"],) for n in ns], "id string"))  # at most `most` rows
    between = edge.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    es = [r.asDict() for r in between.select("source", "target", "type").distinct().orderBy("source", "target", "type").limit(most * 4).collect()]
    data = json.dumps({"nodes": ns, "edges": es}, ensure_ascii=False).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>graph</title><input id=q placeholder=search><canvas id=c width=2400 height=1600></canvas><script>const g={data};const c=document.getElementById('c').getContext('2d');const at=Object.fromEntries(g.nodes.map(n=>[n.id,n]));function draw(q){{c.clearRect(0,0,2400,1600);c.save();c.translate(40,800);for(const e of g.edges){{const a=at[e.source],b=at[e.target];c.strokeStyle='#ccc';c.beginPath();c.moveTo(a.x,a.y);c.lineTo(b.x,b.y);c.stroke()}}for(const n of g.nodes){{c.fillStyle=q&&n.id.toLowerCase().includes(q)?'#c00':'#246';c.fillRect(n.x-2,n.y-2,4,4)}}c.restore()}}draw('');document.getElementById('q').oninput=e=>draw(e.target.value.toLowerCase())</script>"
