"""Run registered queries against their SQL and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return str(v)
        return repr(v + 0.0)
    return str(v)


def frame_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """Empty text when equal, else the first difference."""
    got_cols, got = frame_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want_cols, want = frame_rows([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; only here {list(set(got) - set(want))[:2]}; only SQL {list(set(want) - set(got))[:2]}"
    if got != want:
        return f"only here {sorted(set(got) - set(want))[:3]}; only SQL {sorted(set(want) - set(got))[:3]}"
    return ""
