"""A query's rows against its SQL's, as sets of values by column name."""

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_DBS: dict = {}


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    return int(v) if hasattr(v, "__index__") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, query, sql, sf):
    if sf not in _DBS:
        _DBS[sf] = duckdb.connect()
        for t in TABLES:
            _DBS[sf].execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    r = _DBS[sf].execute(sql)
    columns = [c[0] for c in r.description]
    want = rows(columns, r.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want, f"{len(got)} and {len(want)} rows; {[x for x in got if x not in want][:2]} {[x for x in want if x not in got][:2]}"
