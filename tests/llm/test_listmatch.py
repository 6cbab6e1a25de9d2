import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import listmatch
from corpusmill.sources import read_table


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_distance_and_tree_agree_with_brute_force():
    rng = random.Random(1)
    ws = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9))) for _ in range(200)]
    for a, b in zip(ws, ws[1:]):
        assert listmatch.levenshtein(a, b) == lev(a, b)
    tree = listmatch.BKTree(sorted(set(ws)))
    for q in ws[:40]:
        for r in (0, 1, 2):
            assert tree.within(q, r) == sorted((lev(q, w), w) for w in set(ws) if lev(q, w) <= r)


@pytest.fixture(scope="module")
def matcher(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "material_reference").collect()]
    return listmatch.Matcher(rows), {r[1]: r[0] for r in rows}


@pytest.mark.parametrize(
    ("value", "family", "want"),
    [
        ("HfO₂ thin film", None, "HfO2"), ("hafnia.", None, "HfO2"), ("hafinum oxide", None, "HfO2"), ("HZO (40 % Zr)", None, "Hf0.6Zr0.4O2"), ("Hf.5Zr.5O2", None, "Hf0.5Zr0.5O2"), ("HZO 70:30 (Hf:Zr)", None, "Hf0.7Zr0.3O2"),
        ("5.6 mol% Si:HfO2", "HZO", "Si:HfO2"), ("yttrbium-doped hafnium oxide", "mixed_doped_HfO2", "Yb:HfO2"), ("doped hafnia", " La doped HfO2", "La:HfO2"), ("doped hafnia", "other", None), ("HfS2", "HfO2", None), ("HfN", None, None), ("glass", "HfO2", None),
        ("(Hf,Zr)O2", None, "Hf1-xZrxO2"), ("hafnium zircnium oxide with 50 % zirconium", None, "Hf0.5Zr0.5O2"), ("x" * 5_000, None, None), ("hafnium oxide" + " " * 300 + "film", None, "HfO2"), ("hafnium dioxide" + " film" * 60, None, "HfO2"), ("...", None, None),
    ],
)
def test_values(matcher, value, family, want):
    m, ids = matcher
    assert m.match(value, family)[0] == (ids[want] if want else 0)


def test_found_leaves_out_exact_null_and_blank(spark, sf):
    ref = read_table(spark, sf, "material_reference")
    rows = [("1", "HfO2", None), ("2", None, "HfO2"), ("3", "  ", "HfO2"), ("4", "hfo2", None), ("4", "hfo2", None), ("5", "wood", None)]
    f = spark.createDataFrame(rows, "fact_id string, material string, material_family string").withColumn("distance", F.lit("clash"))
    assert sorted(map(tuple, listmatch.found(f, ref).collect())) == [("4", 1), ("5", 0)]
    assert {r.fact_id: r.material_id for r in listmatch.mapped(f, ref).collect()}["1"] == 1
    assert sorted((r.fact_id, r.material_id) for r in listmatch.mapped(f, ref, most=200).collect()) == sorted((r.fact_id, r.material_id) for r in listmatch.mapped(f, ref).collect())
    assert listmatch.found(f.limit(0), ref).count() == 0


def test_the_answer_is_the_same_however_the_list_is_divided(spark):
    """Random references: families of one entry and of several, equal names, spellings that several entries share."""
    rng = random.Random(4)
    names = ["HfO2", "ZrO2", "Hf0.5Zr0.5O2", "Hf0.7Zr0.3O2", "Hf1-xZrxO2", "Si:HfO2", "La:HfO2", "Y:HfO2", "P(VDF-TrFE)", "BaTiO3", "HfO2/ZrO2 superlattice", "lithium niobate", "lead titanate", "bismuth ferrite"]
    values = ["doped hafnia", "hzo", "hafnium oxide", "hafnium oxid", "lithium niobat", "lead titanat film", "Si:HfO2", "silicon-doped hafnia", "HZO (30 % Zr)", "dopd hafnia", "glass", "bismuth ferite", "HfO2", "x" * 3_000]
    families = [None, "HZO", "HfO2", "La doped HfO2", "perovskite", "other", "Si:HfO2 family"]
    schema = "material_id int, canonical_name string, short_name string, long_name string, material_family string"
    for turn in range(3):
        ref = [(1, "Hf0.5Zr0.5O2", None, None, "HZO"), (2, "Hf0.7Zr0.3O2", None, None, "HZO")] if turn == 0 else [(i + 1, rng.choice(names), rng.choice([None, "HZO", "PZT"]), rng.choice([None, "hafnium oxide", "lead titanate"]), rng.choice(families)) for i in range(12)]
        facts = spark.createDataFrame([(f"{v[:9]}{f}", v, f) for v in values for f in families], "fact_id string, material string, material_family string")
        r = spark.createDataFrame(ref, schema)
        want = sorted(map(tuple, listmatch.mapped(facts, r).drop("material").fillna("").collect()))
        assert len(want) == len(values) * len(families)
        if turn == 0:
            assert ("doped hafHZO", "HZO", 0, 0) in want
        for most in (40, 200):
            assert sorted(map(tuple, listmatch.mapped(facts, r, most=most).drop("material").fillna("").collect())) == want
