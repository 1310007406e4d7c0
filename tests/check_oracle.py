"""Compare registered queries with their SQL: python tests/check_oracle.py [folder] [name...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _family(kind: str) -> str:
    kind = kind.lower()
    if kind in ("double", "float"):
        return "double"
    if kind in ("string", "varchar"):
        return "string"
    return {"int": "integer", "long": "bigint", "smallint": "integer"}.get(kind, kind)


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def _sorted(rows):
    return sorted((tuple(_cell(x) for x in r) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> list[str]:
    """Differences between a query and its SQL; none when equal."""
    df = entry.queries()[name](spark, folder)
    sql = entry.oracle_sql().get(name)
    cols = sorted(df.columns)
    mine = _sorted(df.select(*[f"`{c}`" for c in cols]).collect())
    if sql is None:
        return [] if mine else ["no rows"]
    rel = con.sql(sql)
    problems = []
    if cols != sorted(rel.columns):
        return [f"columns {cols} / {sorted(rel.columns)}"]
    kinds = dict(zip(rel.columns, [str(k) for k in rel.types]))
    for field in df.schema:
        a, b = _family(field.dataType.simpleString()), _family(kinds[field.name])
        if a != b and {a, b} != {"timestamp_ntz", "timestamp"}:
            problems.append(f"type of {field.name}: {a} / {b}")
    other = _sorted(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    if len(mine) != len(other):
        problems.append(f"rows {len(mine)} / {len(other)}")
    elif mine != other:
        bad = [(a, b) for a, b in zip(mine, other) if a != b]
        problems.append(f"{len(bad)} rows differ, e.g. {bad[0]}")
    return problems


def main() -> int:
    from evkit.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problems = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s",
              *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
