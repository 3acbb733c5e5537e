"""Compare a Spark query with its SQL run by DuckDB on the same parquet tables."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if x is None:
        return ("", "")
    if isinstance(x, bool):
        return ("b", str(x))
    if isinstance(x, int):
        return ("n", f"{x:.9g}" if abs(x) < 10**15 else str(x))
    if isinstance(x, float):
        return ("n", "nan" if math.isnan(x) else f"{x + 0.0:.9g}")
    if hasattr(x, "isoformat"):
        return ("t", x.replace(tzinfo=None).isoformat() if hasattr(x, "hour") else x.isoformat())
    if isinstance(x, (list, tuple)):
        return ("l", str([_plain(v) for v in x]))
    if isinstance(x, dict):
        return ("m", str(sorted((k, _plain(v)) for k, v in x.items())))
    return ("s", str(x))


def normal(names: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    con = connect(sf_dir)
    cursor = con.execute(sql)
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows / {len(want[1])} rows"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b:
            return "\n".join(f"{n}: {x} / {y}" for n, x, y in zip(got[0], a, b, strict=True) if x != y)
    return None
