"""A query against its SQL on the smallest tables, values compared whole."""

import duckdb

SF = "/root/testdata/sf0.001"


def compare(spark, module, name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = module.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    relation = con.execute(module.ORACLES[name])
    names = [c[0] for c in relation.description]
    assert sorted(names) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in relation.fetchall()), key=repr) and got
