"""Notes so old that their clock would stand before 1970."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry
from oracle import differences

SF = "/root/testdata/sf0.001"


def test_recall_fused_of_documents_with_large_ids(spark, tmp_path):
    """Ids on either side of 474,096, from where the time reckoned from the id is zero or less."""
    duckdb.sql(f"COPY (SELECT * REPLACE (doc_id + 474000 AS doc_id) FROM '{SF}/documents.parquet') TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (FROM '{SF}/benchmark.parquet') TO '{tmp_path}/benchmark.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = entry.queries()["recall_fused"](spark, str(tmp_path)), con.execute(entry.oracle_sql()["recall_fused"])
    names, wanted = [c[0] for c in want.description], want.fetchall()
    assert len({r[names.index("note_id")] >= 474_096 for r in wanted}) == 2
    assert differences(got.columns, [tuple(r) for r in got.collect()], names, wanted) == ""
