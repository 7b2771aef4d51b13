"""Every query with SQL gives DuckDB's rows on the smallest tables; the rest run with a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: v for k, v in entry.queries().items() if k != "pipeline" and not k.startswith("op")}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return str(v) if v is not None else None


def compare(got, names, expected, expected_names):
    assert sorted(names) == sorted(expected_names)
    order, other = sorted(range(len(names)), key=names.__getitem__), sorted(range(len(expected_names)), key=expected_names.__getitem__)
    a = sorted(repr([_plain(r[i]) for i in order]) for r in got)
    b = sorted(repr([_plain(r[i]) for i in other]) for r in expected)
    assert len(a) == len(b)
    diff = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not diff, (len(diff), diff[:3])


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), list(rel.columns))


#: What the rows of the queries without SQL have to be on the smallest tables; their operators are held against plain
#: versions in test_operators.
CHECKS = {
    "anchor_fit": lambda rows: len(rows) == 3 and all(r["n"] >= 60 and not r["kept"] for r in rows),
    "cluster_null": lambda rows: [r["k"] for r in rows] == [2, 3, 4] and all(len(r["nulls"]) == 5 and 0 <= r["null"] < 0.2 and r["explained"] >= 0 for r in rows),
    "color_features": lambda rows: all(len(r["features"]) == 50 and 0 <= r["features"][0] <= 1 and abs(sum(r["features"][3:19]) - 1) < 1e-4 for r in rows),
    "cv_skill": lambda rows: len(rows) == 14 and all(r["skill"] < 0.1 and 0 < r["mae"] < 100 and 0 <= r["response"] <= 3 for r in rows),
    "develop_profile": lambda rows: len(rows) == 4 and {r["head"] for r in rows} == {"level", "frame"} and all(len(r["weights"]) == (6 if r["head"] == "level" else 3) for r in rows),
    "diagnose": lambda rows: [r["clusters"] for r in rows] == [1, 2, 3, 4] and len({sum(r["sizes"]) for r in rows}) == 1 and all(len(r["sizes"]) == r["clusters"] for r in rows),
    "skill_by_treatment": lambda rows: len(rows) == 8 and {r["model"] for r in rows} == {"pooled", "A", "N", "R"} and all(r["skill"] < 0.1 for r in rows),
    "treatment_transfer": lambda rows: len(rows) == 24 and {r["trained_on"] for r in rows} == {"A", "N", "R", "pooled"} and all(r["skill"] < 0.95 for r in rows),
    "held_out_deltas": lambda rows: len(rows) > 5000 and {r["fold"] for r in rows} == {0, 1, 2, 3, 4} and all(r["predicted_price"] is not None for r in rows),
    "kmeans_inertia": lambda rows: [r["k"] for r in rows] == [1, 2, 3, 4] and all(a["inertia"] >= b["inertia"] for a, b in zip(rows, rows[1:], strict=False)),
    "meet_constraints": lambda rows: len(rows) == 500 and sum(r["left"] <= 1.0 for r in rows) > 400,
    "apply_intents": lambda rows: len(rows) == 500 and all(r["Vibrance"] == 12 and r["Shadows2012"] is None for r in rows) and sum(r["left"] <= 1.0 for r in rows) > 400,
    "look_regression": lambda rows: len(rows) == 500 and all(a <= b for r in rows for a, b in zip(r["foretold"], r["foretold"][1:], strict=False)) and sum(r["off"] for r in rows) < 0.8 * sum(r["off_constant"] for r in rows),
    "pca_explained": lambda rows: all(a["share"] >= b["share"] for a, b in zip(rows, rows[1:], strict=False)) and all(abs(sum(v * v for v in r["direction"]) - 1) < 1e-9 for r in rows),
    "rank_profile": lambda rows: all(0 <= r["merit"] <= 1 and 0 <= r["stars"] <= 5 for r in rows) and rows[0]["held_out_accuracy"] > 0.8,
    "scan_listing": lambda rows: {r["name"] for r in rows} >= {f"{t}.parquet" for t in TABLES} and all(r["size"] > 0 for r in rows),
    "solve_tone": lambda rows: len(rows) == 500 and sum(r["left"] < 6 for r in rows) > 400,
}


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ORACLES))
def test_rows_without_sql(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and CHECKS[name](rows)
