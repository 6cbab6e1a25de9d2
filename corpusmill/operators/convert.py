"""Quantities recorded in different units, converted to the common unit of their property.

Pure SQL: number and unit are taken out of the text by regular expression, spellings are reduced and joined to an alias table,
the unit of the column comes first, then the text's, then a default of the source; factor and offset give the common value.

Defined cases: a null value is never converted; a unit that isn't in the alias table is unknown; a known unit of another dimension
than the property's doesn't fit; a property without a common unit has no result; a repeated row comes out as often as it went in (convert), once (found).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.units import alias_table, power_sql, reduce_unit_sql
from corpusmill.session import broadcast_if_small, through_table

#: number, power written after it, word or power before the unit, unit.
QUANTITY = r"([0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?)( ?[x×] ?10[~^]?[-−⁻]?[0-9⁰¹²³⁴⁵⁶⁷⁸⁹]+)?(?: ?((?:1[eE]-?[0-9]+|10[~^]-?[0-9]+|[Tt]housand|[Mm]illion|[Bb]illion) )?([A-Za-zµμ°%][^ ,;|()]*(?: [cmµμun]?m[~^]?[-−][0-9])?))?"


def _close(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= 1e-9 * abs({b})"


def text_unit_sql(text: str, value: str) -> str:
    """SQL: the unit spelling that follows the first number in the text that equals the value, signs aside; null if there is none."""
    q = QUANTITY
    g = lambda i: f"regexp_extract(m, '{q}', {i})"
    power = f"coalesce(try_cast(translate(regexp_replace({g(2)}, '^ ?[x×] ?10[~^]?', ''), '⁰¹²³⁴⁵⁶⁷⁸⁹⁻−', '0123456789--') as int), 0)"
    mantissa = f"cast({g(1)} as double)"
    scaled = f"{mantissa} * power(10D, {power})"
    spelled = f"transform(regexp_extract_all({text}, '{q}', 0), m -> case when {_close(scaled, f"abs({value})")} then concat({g(3)}, {g(4)}) when {_close(mantissa, f"abs({value})")} then concat(trim({g(2)}), ' ', {g(3)}, {g(4)}) end)"
    return f"try_element_at(filter({spelled}, u -> u is not null and trim(u) <> ''), 1)"


def with_units(facts: DataFrame, properties: DataFrame, default_unit: str | None = None) -> DataFrame:
    """The facts with unit_used, unit_from (field, text, default), common_unit, common_number; null where there is no result."""
    spark = facts.sparkSession
    alias = F.broadcast(alias_table(spark))
    base = facts.withColumn("__u_field", F.expr(reduce_unit_sql("unit")))
    p, r = power_sql("__u_field")
    base = base.withColumn("__p_field", F.expr(p)).withColumn("__k_field", F.expr(r))
    field = alias.select(F.col("key").alias("__k_field"), F.struct("canon", "dim", "factor", "offset").alias("__a_field"))
    base = base.join(field, "__k_field", "left")
    text = F.when(F.col("__a_field").isNull() & F.col("value").isNotNull(), F.expr(reduce_unit_sql(text_unit_sql("evidence_text", "value"))))
    base = base.withColumn("__u_text", text)
    p, r = power_sql("__u_text")
    base = base.withColumn("__p_text", F.expr(p)).withColumn("__k_text", F.expr(r))
    base = base.join(alias.select(F.col("key").alias("__k_text"), F.struct("canon", "dim", "factor", "offset").alias("__a_text")), "__k_text", "left")
    if default_unit:
        p, r = power_sql("__u_def")
        base = base.withColumn("__u_def", F.expr(reduce_unit_sql(default_unit))).withColumn("__p_def", F.expr(p)).withColumn("__k_def", F.expr(r)).join(alias.select(F.col("key").alias("__k_def"), F.struct("canon", "dim", "factor", "offset").alias("__a_def")), "__k_def", "left")
    else:
        base = base.withColumn("__p_def", F.lit(0)).withColumn("__a_def", F.lit(None).cast("struct<canon:string,dim:string,factor:double,offset:double>"))
    common = properties.select("property_name", "common_unit").withColumn("__k", F.expr(reduce_unit_sql("common_unit"))).dropDuplicates(["property_name"])
    common = common.join(alias.select(F.col("key").alias("__k"), F.struct("canon", "dim", "factor", "offset").alias("__a_common")), "__k").drop("__k")
    j = base.join(broadcast_if_small(common, row_bytes=512), "property_name", "left")  # few properties hold all rows, so facts must not be shuffled by them
    a = F.coalesce("__a_field", "__a_text", "__a_def")
    power = F.when(F.col("__a_field").isNotNull(), F.col("__p_field")).when(F.col("__a_text").isNotNull(), F.col("__p_text")).when(F.col("__a_def").isNotNull(), F.col("__p_def")).otherwise(F.lit(0))
    j = j.withColumn("__a", a).withColumn("__p", power)
    fits = F.col("__a.dim") == F.col("__a_common.dim")
    raw = F.col("value") * F.pow(F.lit(10.0), F.col("__p"))
    same = (F.col("__a.canon") == F.col("__a_common.canon")) & (F.col("__p") == 0)
    number = F.when(same, F.col("value")).otherwise((raw * F.col("__a.factor") + F.col("__a.offset") - F.col("__a_common.offset")) / F.col("__a_common.factor"))
    return j.select(
        *[F.col(f"`{c}`") for c in facts.columns],
        F.when(F.col("__a").isNotNull(), F.concat(F.when(F.col("__p") != 0, F.format_string("10^%d ", F.col("__p"))).otherwise(""), F.col("__a.canon"))).alias("unit_used"),
        F.when(F.col("__a_field").isNotNull(), "field").when(F.col("__a_text").isNotNull(), "text").when(F.col("__a_def").isNotNull(), "default").alias("unit_from"),
        "common_unit",
        F.when(fits, number).alias("common_number"),
        F.when(fits, ~same).alias("needs_conversion"),
    )


def source_defaults(facts: DataFrame, source: str = "paper_id") -> DataFrame:
    """source, property_name, default_unit: the unit that a source writes most often for a property (ties to the larger spelling), by partial counts."""
    n = facts.where((F.trim("unit") != "") & F.col(source).isNotNull()).groupBy(source, "property_name", "unit").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(source, "property_name").agg(F.max_by("unit", F.struct("n", "unit")).alias("default_unit"))


def with_defaults(facts: DataFrame, properties: DataFrame, source: str = "paper_id") -> DataFrame:
    """`with_units`, where a fact without a unit in field or text takes its source's usual one. A source may hold most facts: the defaults are broadcast if they are few,
    else adaptive execution splits the source."""
    d = through_table(source_defaults(facts, source), "defaults")
    j = facts.join(broadcast_if_small(d, row_bytes=256), [source, "property_name"], "left")
    return with_units(j, properties, "default_unit").drop("default_unit")


def converted(facts: DataFrame, properties: DataFrame) -> DataFrame:
    """fact_id, common_value of every fact whose known, fitting unit isn't the common one; no repeated rows."""
    slim = facts.select("fact_id", "property_name", "value", "unit", "evidence_text").where(F.col("value").isNotNull())
    u = with_units(slim, properties).where(F.col("needs_conversion") & F.col("common_number").isNotNull())
    return u.select("fact_id", F.format_string("%.2e", F.col("common_number")).alias("common_value")).distinct()
