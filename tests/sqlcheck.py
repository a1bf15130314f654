"""Compare a registered query with its SQL over a data folder."""

from pathlib import Path

import duckdb

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([v[i] for i in order]) for v in values)


def same_rows(spark, query, sql):
    found = query(spark, str(FOLDER))
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    told = connection.execute(sql)
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, told.fetchall())
