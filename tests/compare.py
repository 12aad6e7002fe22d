"""Row-for-row comparison of a Spark result with DuckDB's."""

import math


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def assert_same(df, duck, sql):
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(sql)
    want, wanted = rows_of(rel.columns, rel.fetchall())
    assert names == wanted
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)
