"""Unit aliases built from rules: SI prefixes times base units times spellings.

A spelling is reduced by `reduce_unit` to a key; the alias table maps keys to a canonical unit, a dimension, a factor and an offset,
so that value * factor + offset is in the dimension's base unit. Keys keep the letter case, as mV and MV differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# SI prefixes and constants.
PREFIX = {"": 1.0, "p": 1e-12, "n": 1e-9, "u": 1e-6, "micro": 1e-6, "m": 1e-3, "milli": 1e-3, "k": 1e3, "K": 1e3, "kilo": 1e3, "M": 1e6, "G": 1e9}
CANON_PREFIX = {"micro": "u", "milli": "m", "K": "k", "kilo": "k"}
YEAR_S = 365.25 * 86400
EV_J = 1.602176634e-19
EV_KJ_MOL = 96.4853
LENGTH_CM = {"cm": 1.0, "m": 1e2, "mm": 1e-1, "um": 1e-4, "nm": 1e-7}
SECONDS = {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "a": YEAR_S}
SECOND_WORDS = {"s": ("s", "sec", "secs", "second", "seconds"), "min": ("min", "mins", "minute", "minutes"), "h": ("h", "hr", "hrs", "hour", "hours"), "d": ("d", "day", "days"), "a": ("a", "yr", "yrs", "year", "years")}
WORD_POWER = {"thousand": 3, "million": 6, "billion": 9}


def alias_rows() -> list[tuple[str, str, str, float, float]]:
    """(key, canonical unit, dimension, factor, offset)."""
    out: dict[str, tuple[str, str, str, float, float]] = {}

    def add(key: str, canon: str, dim: str, factor: float, offset: float = 0.0) -> None:
        out.setdefault(key, (key, canon, dim, factor, offset))

    per_area = {f"{n}2": 1 / (cm * cm) for n, cm in LENGTH_CM.items()}
    for p, f in PREFIX.items():
        c = CANON_PREFIX.get(p, p)
        for area, g in per_area.items():
            add(f"{p}C/{area}", f"{c}C/{area}", "charge_density", f * g)  # base C/cm2
            add(f"{p}A/{area}", f"{c}A/{area}", "current_density", f * g)  # base A/cm2
        for n, cm in LENGTH_CM.items():
            add(f"{p}V/{n}", f"{c}V/{n}", "field", f / cm)  # base V/cm
        for word in ("V", "volt", "volts", "Volt", "Volts"):
            add(f"{p}{word}", f"{c}V", "voltage", f)
        add(f"{p}eV", f"{c}eV", "energy", f)  # base eV
        for word in ("J", "joule", "joules", "Joule"):
            add(f"{p}{word}", f"{c}J", "energy", f / EV_J)
        for word in ("s", "sec", "second", "seconds"):
            add(f"{p}{word}", f"{c}s", "time", f)
        for word in ("cycle", "cycles", "Cycle", "Cycles"):
            add(f"{p}{word}", f"{c}cycles", "count", f)
    add("kJ/mol", "kJ/mol", "energy", 1 / EV_KJ_MOL)
    add("J/mol", "J/mol", "energy", 1e-3 / EV_KJ_MOL)
    for canon, words in SECOND_WORDS.items():
        for w in words:
            add(w, canon, "time", SECONDS[canon])
    add("°C", "°C", "temperature", 1.0, 273.15)
    add("K", "K", "temperature", 1.0)
    return sorted(out.values())


def alias_table(spark: SparkSession) -> DataFrame:
    """The rule-built table; its size is fixed by the rules (some 400 rows), so it's broadcast."""
    return spark.createDataFrame(alias_rows(), "key string, canon string, dim string, factor double, offset double")


def alias_values_sql() -> str:
    """The same rows as a SQL VALUES list, for engines without this package."""
    return ",\n".join(f"('{k}','{c}','{d}',{f!r},{o!r})" for k, c, d, f, o in alias_rows())


SUPERSCRIPTS, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−–µμ", "0123456789---uu"


def reduce_unit_sql(col: str, duck: bool = False) -> str:
    """SQL that reduces a spelling: superscripts, micro signs, minus signs, blanks, final dot, X cm-2 to X/cm2, a leading power of ten kept."""
    g = ", 'g'" if duck else ""
    b = "\\1" if duck else "$1"
    b2 = "\\2" if duck else "$2"
    s = f"regexp_replace({col}, '10([⁻⁰¹²³⁴⁵⁶⁷⁸⁹]+)', '10^{b}'{g})"
    s = f"translate({s}, '{SUPERSCRIPTS}', '{PLAIN}')"
    s = f"regexp_replace(trim({s}), '[.,;]+$', ''{g})"
    s = f"regexp_replace({s}, '[ ·*]+([cmun]?m)[~^]?-([12])$', '/{b}{b2}'{g})"
    s = f"regexp_replace({s}, '/([cmun]?m)[~^]?([12])$', '/{b}{b2}'{g})"
    s = f"regexp_replace({s}, '/([cmun]?m)1$', '/{b}'{g})"
    return s


def power_sql(reduced: str, duck: bool = False) -> tuple[str, str]:
    """(power of ten that leads the reduced spelling, the rest of it) as SQL."""
    g = ", 'g'" if duck else ""
    num = lambda rx: f"try_cast(nullif(regexp_extract({reduced}, '{rx}', 1), '') as int)"
    words = " ".join(f"when lower({reduced}) like '{w} %' then {p}" for w, p in WORD_POWER.items())
    lead = f"coalesce({num('^[x×]? ?10[~^](-?[0-9]+) ')}, {num('^1[eE](-?[0-9]+) ')}, case {words} else 0 end)"
    rest = f"trim(regexp_replace({reduced}, '^([x×]? ?10[~^]-?[0-9]+|1[eE]-?[0-9]+|[Tt]housand|[Mm]illion|[Bb]illion) ', ''{g}))"
    return lead, rest
