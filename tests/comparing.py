"""Run a query and its SQL and compare the rows."""

import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


def connect(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def both(spark, folder, query, sql):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(str([norm(v) for v in r]) for r in df.select(*names).collect())
    r = connect(folder).execute(sql)
    columns = [d[0] for d in r.description]
    assert sorted(columns) == names
    want = sorted(str([norm(x[columns.index(n)]) for n in names]) for x in r.fetchall())
    return got, want
