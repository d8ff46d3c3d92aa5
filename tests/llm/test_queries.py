"""Queries of the corpus operators against their SQL twins in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op7_warc", "op8_substring_dedup", "op9_quality_rules", "op11_vector_codes", "op12_centroids", "op13_html_extraction"])
def test_query(spark, name):
    from lodestack.llm.queries import ORACLE_SQL, QUERIES

    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got and got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
