"""Compare a query with its SQL: row count and all values, whatever the row order."""

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if type(x).__name__ == "Decimal":
        return int(x) if x == int(x) else round(float(x), 6)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connection(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if (p := Path(folder) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def differences(spark, con, query, sql, folder):
    """None if equal, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {odd}"
    return None if got else "no rows"
