"""The registered queries against DuckDB, on the whole small tables."""

import os

import duckdb
import pytest

from tastegrid.llm import oracle, queries
from tests.test_oracle import TABLES, compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(oracle.SQL[name])
    compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), list(rel.columns))


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_rules_as_sql_above_the_limits(spark, tmp_path):
    """Lines above, at and below the default limits of hosts large and small; documents of little else, and none."""
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    long = " ".join(f"b{k}" for k in range(300))
    # host a has 204 distinct texts, so 4 documents may share a line
    rows = [(i, f"Read  more\n{body(i, 20)}\n" + ("read MORE\n" if i % 2 else ""), "a") for i in range(5)]
    rows += [(10 + i, f"At the limit\n{body(10 + i, 12)}", "a") for i in range(4)] + [(20 + i, body(20 + i, 12), "a") for i in range(193)]
    rows += [(400 + i, f"{long}\n{body(400 + i, 3 if i % 2 else 200)}", "b") for i in range(120)]
    # in a small host three documents may
    rows += [(600 + i, f"{body(600 + i, 15)}\nread more" + ("\nonly these" if i < 3 else ""), "c") for i in range(4)] + [(700, None, "a"), (701, "read more", None)]
    rows += [(800, rows[0][1], "a"), (0, rows[0][1], "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES["op4_quality_rules"](spark, str(tmp_path))
    rel = con.sql(oracle.SQL["op4_quality_rules"])
    got = df.collect()
    compare([tuple(r) for r in got], df.columns, rel.fetchall(), list(rel.columns))
    assert sum(r["n_removed_words"] > 0 for r in got) == 4 + 1 + 119 + 3
    assert sum(not r["base_failed"] and not r["kept"] for r in got) == 60
