"""Comparison of a query with its SQL in DuckDB, as sorted rows of sorted columns."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "SMALLINT": "smallint"}


def compare(spark, con, name, query, sql, sf_dir):
    made = query(spark, sf_dir)
    want = con.sql(sql)
    kinds = dict(zip(want.columns, [KINDS.get(str(t), str(t)) for t in want.types], strict=True))
    got_kinds = dict(made.dtypes)
    a = rows_of(made.columns, [tuple(r) for r in made.collect()])
    b = rows_of(want.columns, want.fetchall())
    assert a[0] == b[0], (name, a[0], b[0])
    assert {k: v for k, v in kinds.items() if v in KINDS.values()} == {k: got_kinds[k] for k, v in kinds.items() if v in KINDS.values()}, (name, kinds, got_kinds)
    assert len(a[1]) == len(b[1]), (name, len(a[1]), len(b[1]))
    for x, y in zip(a[1], b[1], strict=True):
        assert x == y, (name, x, y)
    return len(a[1])
