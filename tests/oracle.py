"""Run a registered query and its SQL twin, and compare rows without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    return value


def type_name(kind) -> str:
    """Arrow type without field names and nullability."""
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"list<{type_name(kind.value_type)}>"
    return "string" if pa.types.is_large_string(kind) else str(kind)


def rows_of(table) -> tuple[dict, list]:
    """(column -> type, rows) with columns by name."""
    names = sorted(table.column_names)
    table = table.select(names)
    types = {n: type_name(table.schema.field(n).type) for n in names}
    columns = [table.column(n).to_pylist() for n in names]
    return types, sorted((tuple(plain(v) for v in row) for row in zip(*columns)), key=repr)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences found; empty if the two results are the same."""
    got_types, got = rows_of(spark_df.toArrow())
    want_types, want = rows_of(con.execute(sql).to_arrow_table())
    problems = []
    if list(got_types) != list(want_types):
        problems.append(f"columns {list(got_types)} != {list(want_types)}")
    elif got_types != want_types:
        problems.append(f"types {got_types} != {want_types}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)} rows")
    if got != want:
        for g, w in zip(got, want):
            if g != w:
                problems.append(f"first difference:\n  got  {str(g)[:600]}\n  want {str(w)[:600]}")
                break
    return problems
