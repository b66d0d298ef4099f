"""Run a query and its SQL side by side and compare all rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def normal(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(normal(x) for x in v)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=str), [names[i] for i in order]


def compare(spark, con, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got, a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, b = rows([d[0] for d in cur.description], cur.fetchall())
    assert a == b, (a, b)
    kinds = dict(df.dtypes)
    for d in cur.description:
        t = str(d[1])
        if "HUGEINT" in t or "DECIMAL" in t:
            raise AssertionError(f"{d[0]}: {t} in the SQL")
        if t == "BIGINT" and kinds[d[0]] != "bigint" or t == "INTEGER" and kinds[d[0]] != "int":
            raise AssertionError(f"{d[0]}: {t} and {kinds[d[0]]}")
    if got != want:
        n = [(x, y) for x, y in zip(got, want, strict=False) if x != y][:3]
        raise AssertionError(f"{len(got)} and {len(want)} rows; {n}")
    return len(got)
