"""Comparison of a query with its SQL on one folder of tables."""

from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect(folder=FOLDER):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v.isoformat() if hasattr(v, "isoformat") else v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, query, sql, folder=FOLDER):
    df = query(spark, folder)
    result = connect(folder).execute(sql)
    assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), [c[0] for c in result.description])
