"""Holds queries against their SQL in DuckDB."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = c.sql(sql).df(), query(spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    rows = [x[cols].astype(object).where(x[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want)]
    assert len(rows[0]) == len(rows[1])
    off = (rows[0] != rows[1]).any(axis=1)
    assert not off.any(), (rows[0][off].head(3).to_dict("records"), rows[1][off].head(3).to_dict("records"))
