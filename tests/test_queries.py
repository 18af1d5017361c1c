"""Every query with SQL gives that SQL's rows."""

import duckdb
import pytest

from cairnframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in catalogue.ORACLE:
        want = db.sql(catalogue.ORACLE[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert canonical(got.columns, rows) == canonical(want.columns, want.fetchall())


def test_range_checksums(spark):
    import zlib

    rows = {(x.ext_id, x.seq): x for x in catalogue.get_range(spark, SF).collect()}
    for x in catalogue.get_range_crc(spark, SF).collect():
        piece = rows[x.ext_id, x.seq].piece_hex
        assert x.crc == (None if piece is None else zlib.crc32(bytes.fromhex(piece)))


def test_flagship_reads_three_columns(spark):
    plan = catalogue.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
