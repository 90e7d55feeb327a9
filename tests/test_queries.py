"""Each registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from loomspark.plans.queries import ORACLES, QUERIES
from loomspark.plans.testmap import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    tidy = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(str([tidy(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_rows_of_queries_without_sql(spark):
    assert {name for name in QUERIES if name not in ORACLES} == {"fuzzy_prf"}
    r = QUERIES["fuzzy_prf"](spark, SF).first()
    assert 0 < r["n_hit"] <= min(r["n_gold"], r["n_pred"]) and 0 < r["f1"] <= 1


def test_section_chunks_with_a_long_sentence(spark, tmp_path):
    long = "One long sentence " + "goes on and on " * 60 + "to its stop."
    turns = [(1, 0, "user", f"Before it. {long} After it. And more."), (1, 1, "assistant", "A short answer."), (2, 0, "user", long), (2, 1, "assistant", "Short."), (3, 0, "user", "x" * 1500)]
    spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got, want = QUERIES["section_chunks"](spark, str(tmp_path)), con.execute(ORACLES["section_chunks"])
    columns = [c[0] for c in want.description]
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())
    assert {r["content"] for r in got.collect()} >= {long, "x" * 1500}
