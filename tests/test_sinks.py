"""How results lie on disk."""

import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pq = pytest.importorskip("pyarrow.parquet")
from spanloom.plans import catalog  # noqa: E402
from spanloom.sources.sinks import as_differences  # noqa: E402

KEYS = ["parquet.writer.version", *(f"parquet.enable.dictionary#{c}" for c in ("chunk", "c_st", "c_en"))]


@pytest.fixture
def fresh(spark):
    for k in KEYS:
        spark.conf.unset(k)
    yield spark
    for k in KEYS:
        spark.conf.unset(k)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_long_spans_take_less_than_a_byte_a_row(fresh, tmp_path):
    out = f"{tmp_path}/out"
    catalog.QUERIES["split_long_spans"](fresh, SF).write.parquet(out)
    groups = [m.row_group(g) for p in os.listdir(out) if p.endswith(".parquet") for m in [pq.ParquetFile(f"{out}/{p}").metadata] for g in range(m.num_row_groups)]
    parts = [g.column(c) for g in groups for c in range(g.num_columns)]
    assert {p.path_in_schema for p in parts if "DELTA_BINARY_PACKED" in p.encodings} >= {"chunk", "c_st", "c_en"}
    assert sum(p.total_compressed_size for p in parts) < sum(g.num_rows for g in groups)
    # nothing is left out: both readers get the SQL's rows
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    c.sql(f"CREATE TABLE want AS {catalog.ORACLE_SQL['split_long_spans']}")
    got = f"SELECT rec_id, word_id, chunk, c_st, c_en FROM '{out}/*.parquet'"
    assert c.sql("SELECT count(*) FROM want").fetchall() == [(fresh.read.parquet(out).count(),)]
    assert not c.sql(f"({got} EXCEPT ALL FROM want) UNION ALL (FROM want EXCEPT ALL {got})").fetchall()
    back = fresh.read.parquet(out).toArrow()  # noqa: F841
    assert not c.sql("(FROM back EXCEPT ALL FROM want) UNION ALL (FROM want EXCEPT ALL FROM back)").fetchall()


def test_what_the_caller_set_stays(fresh):
    fresh.conf.set("parquet.writer.version", "v1")
    as_differences(fresh, "chunk")
    assert fresh.conf.get("parquet.writer.version") == "v1"
    assert fresh.conf.get("parquet.enable.dictionary#chunk") == "false"
    assert fresh.conf.get("parquet.enable.dictionary#c_st", None) is None
