"""Retrieval: TF-IDF with smoothed inverse document frequency and unit rows, search by shared terms, token-overlap ranking of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V
from corpusmill.session import broadcast_if_small, spread, through_table

from .facts import unit_fits

WORD = r"(?U)[\w./-]+"
MAX_TERMS = 50_000


def terms(words: Column) -> Column:
    """Words and word pairs, as often as they occur; `words` should be a column, so that the text is taken apart once."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def exploded_terms(df: DataFrame, id_col: str, text_col: str, id_name: str) -> DataFrame:
    """id, term: lower-case words and pairs of each text, one row an occurrence."""
    w = spread(df.select(id_col, text_col)).select(F.col(id_col).alias(id_name), F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("__w"))
    return w.select(id_name, F.explode(terms(F.col("__w"))).alias("term"))


def index(docs: DataFrame, id_col: str, text_col: str, most: int = MAX_TERMS) -> DataFrame:
    """id, term, weight: the `most` terms of highest total count (ties by term), idf = ln((1 + N) / (1 + df)) + 1, rows of length 1.

    Texts are exploded once into counts per document and term; document frequency and total come from the same counts."""
    tf = exploded_terms(docs, id_col, text_col, "id").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = F.lit(float(docs.count()))  # one number
    vocab = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(most)
    idf = vocab.select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    w = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def written_index(docs: DataFrame, id_col: str, text_col: str, most: int = MAX_TERMS) -> DataFrame:
    """The index as a table of the shared folder, sorted by term within its files, so that a search skips the row groups without its terms."""
    return through_table(index(docs, id_col, text_col, most).repartitionByRange("term").sortWithinPartitions("term"), "tfidf")


def search(idx: DataFrame, docs: DataFrame, queries: DataFrame, id_col: str, k: int) -> DataFrame:
    """query_id, rank, id, score: cosine of each query with the documents that share a term; the k best with a score over 0 (ties by id).

    idx: a written index, as it's read twice (frequencies of the queries' terms, then their postings). queries: query_id, query. The index is joined, never scanned per query."""
    q = exploded_terms(queries, "query_id", "query", "query_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    n = F.lit(float(docs.count()))
    df = idx.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    qw = q.join(df, "term").select("query_id", "term", (F.col("qtf") * (F.log((n + 1) / (F.col("df") + 1)) + 1)).alias("qw"))
    qn = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    hits = idx.join(qw, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("dot"))
    s = hits.join(qn, "query_id").select("query_id", "id", F.round(F.col("dot") / F.col("qnorm"), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def intent_property(q: Column) -> Column:
    low = F.lower(q)
    out = F.when(q.rlike(V.ASK_2PR), "double_remanent_polarization_2Pr").when(q.rlike(V.ASK_EC), "coercive_field_Ec").when(q.rlike(V.ASK_PR), "remanent_polarization_Pr")
    for name, aliases in V.PROPERTY_ALIASES.items():
        out = out.when(T.any_of(low, aliases), name)
    return out


def intent_family(q: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(q), F.lit(" "))
    out = None
    for name, aliases in V.FAMILY_ALIASES.items():
        hit = T.any_of(low, aliases)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


QUESTIONS = [(1, "What 2Pr range is reported for HZO films with TiN electrodes?"), (2, "coercive field of Si:HfO2"), (3, "remanent polarization of hafnia annealed at 600 °C"), (4, "endurance cycles of the capacitor"), (5, "band gap")]


def questions(spark: SparkSession) -> DataFrame:
    q = spark.createDataFrame(QUESTIONS, "question_id int, question string")
    return q.withColumn("want_property", intent_property(F.col("question"))).withColumn("want_family", intent_family(F.col("question"))).withColumn("q_tokens", T.tokens(F.col("question")))


def _family_match(material: Column, family: Column, want: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(material, F.lit("")), F.coalesce(family, F.lit(""))))
    out = None
    for name, aliases in V.FAMILY_ALIASES.items():
        hit = T.any_of(text, [name.lower(), *aliases])
        out = F.when(want == name, hit) if out is None else out.when(want == name, hit)
    return want.isNull() | F.coalesce(out, F.lit(False))


def score_facts(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """question_id, fact_id, value, unit, property_name, score of every fact that fits a question's property and material: shared tokens, plus points for
    a named property (3), material (2) and the grade of the fact's context (2 strong, 1 partial). Questions that name a property are joined on it; those that name none
    are a given set against all facts."""
    parts = ["title", "doi", "material", "material_family", "property_name", "unit", "evidence_text"]
    f = facts.withColumn("f_tokens", T.tokens(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in parts])))
    fits = lambda x: x.where(_family_match(F.col("material"), F.col("material_family"), F.col("want_family")))
    named = broadcast_if_small(asked.where("want_property is not null").withColumnRenamed("want_property", "property_name"), row_bytes=4_096)
    other = broadcast_if_small(asked.where("want_property is null"), row_bytes=4_096)
    j = fits(f.join(named, "property_name")).withColumn("want_property", F.col("property_name")).unionByName(fits(f.crossJoin(other)))
    grade = F.when(F.col("context_quality") == "strong", 2).when(F.col("context_quality") == "partial", 1).otherwise(0)
    s = F.size(F.array_intersect("q_tokens", "f_tokens")) + F.when(F.col("want_property").isNotNull(), 3).otherwise(0) + F.when(F.col("want_family").isNotNull(), 2).otherwise(0) + grade
    return j.select("question_id", "want_property", "fact_id", "property_name", "value", "unit", "evidence_text", s.alias("score")).where("score > 0")


def top_facts(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "fact_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def answer_ranges(scored: DataFrame) -> DataFrame:
    """Per question: facts, numeric ones that fit by unit, smallest, largest, median, and the facts at the extremes."""
    fit = F.col("value").isNotNull() & unit_fits(F.coalesce("want_property", "property_name"), F.col("unit"))
    v = F.when(fit, F.col("value"))
    return scored.groupBy("question_id").agg(F.count(F.lit(1)).alias("facts"), F.count(v).alias("numeric"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.percentile(v, 0.5).alias("median_v"), F.min(F.when(fit, F.struct(F.col("value").alias("v"), F.col("fact_id").alias("f"))))["f"].alias("min_fact_id"), F.min(F.when(fit, F.struct((-F.col("value")).alias("v"), F.col("fact_id").alias("f"))))["f"].alias("max_fact_id"))


def evidence_for(scored: DataFrame, k: int) -> DataFrame:
    """Per question: the facts at the extremes first, then the best, each once, k in all."""
    r = answer_ranges(scored)
    ends = r.select("question_id", F.posexplode(F.array("min_fact_id", "max_fact_id")).alias("o", "fact_id")).where("fact_id is not null")
    best = top_facts(scored, k).select("question_id", (F.col("rank") + 1).alias("o"), "fact_id")
    first = ends.unionByName(best).groupBy("question_id", "fact_id").agg(F.min("o").alias("o"))
    w = Window.partitionBy("question_id").orderBy("o", "fact_id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("question_id", "place", "fact_id")


def answer_text(question: str, stats: dict | None, evidence: list[dict]) -> str:
    """A plain answer from collected results; says so where there is nothing."""
    if not stats or not stats.get("facts"):
        return f"No accepted evidence was found for: {question}"
    lines = [f"Question: {question}", f"Facts: {stats['facts']} ({stats['numeric']} numeric)"]
    if stats.get("min_v") is not None:
        lines.append(f"Range: {stats['min_v']:g} to {stats['max_v']:g}, median {stats['median_v']:g}")
    lines += [f"[{i + 1}] {e.get('title') or ''} {e.get('doi') or ''} p.{e.get('page_number') or '?'}: {e.get('evidence_text') or ''}" for i, e in enumerate(evidence)]
    return "\n".join(lines)


def fact_record(facts: DataFrame) -> DataFrame:
    """The facts as records of an answer: label of material and property, value with unit, place, and the evidence tidied."""
    c = F.col
    unit = F.coalesce(F.concat(F.lit(" "), T.nonempty(F.trim("unit"))), F.lit(""))
    return facts.select(
        "fact_id", F.concat_ws(" ", T.nonempty(F.trim("material")), c("property_name")).alias("label"), F.when(c("value").isNotNull(), F.concat(F.format_string("%.4g", c("value")), unit)).alias("reading"),
        F.concat_ws(", ", "title", F.concat(F.lit("p. "), c("page_number").cast("string"))).alias("place"), T.strip(F.regexp_replace(F.coalesce("evidence_text", F.lit("")), r"\s+", " ")).alias("evidence"),
    )


def model_prompt(question: str, evidence: list[dict]) -> str:
    """What a model is asked: the question and the numbered evidence, which it must cite and not go beyond."""
    lines = [f"[{i}] {e.get('title') or ''} {e.get('doi') or ''} p.{e.get('page_number') or '?'}: {e.get('evidence_text') or ''}" for i, e in enumerate(evidence, 1)]
    return "Answer from the numbered evidence alone and cite it as [n]. Say so if it doesn't answer the question.\n" + f"Question: {question}\n" + "\n".join(lines)


def model_answer(question: str, stats: dict | None, evidence: list[dict], call=None) -> dict:
    """The answer of a model (an injected callable, prompt -> text) where there is one and evidence, else the plain one; a model that fails or says nothing leaves the plain answer and its error."""
    plain = answer_text(question, stats, evidence)
    if call is None or not stats or not stats.get("facts"):
        return {"answer": plain, "by": "rules", "error": None}
    try:
        said = (call(model_prompt(question, evidence)) or "").strip()
    except Exception as e:  # noqa: BLE001
        return {"answer": plain, "by": "rules", "error": str(e)[:300]}
    return {"answer": said, "by": "model", "error": None} if said else {"answer": plain, "by": "rules", "error": "empty answer"}
