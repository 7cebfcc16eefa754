"""Run registered queries beside their SQL and compare the rows.

``python tests/compare.py <table folder> [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        return value.item()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(picked, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    return rows_of([c[0] for c in cursor.description], cursor.fetchall())


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def differences(df, con, sql) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    names, ours = spark_rows(df)
    other_names, theirs = sql_rows(con, sql)
    if names != other_names:
        return [f"columns {names} != {other_names}"]
    kinds = {n: KINDS.get(t, t) for n, t in df.dtypes}
    described = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    found = [f"type of {n}: {kinds[n]} != {described[n]}" for n in names if kinds[n] != described[n]]
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows != {len(theirs)}")
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        found.append(f"{len(unequal)} rows differ")
        for a, b in unequal[:3]:
            for name, x, y in zip(names, a, b):
                if x != y:
                    found.append(f"  {name}: {x!r:.300} != {y!r:.300}")
    return found


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from textlots.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con, oracle, bad = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                found = differences(df, con, oracle[name])
                verdict = "same" if not found else "DIFFERENT " + "\n   ".join(found)
            else:
                found, verdict = [], f"{df.count()} rows, no SQL"
        except Exception as error:
            found, verdict = ["error"], f"ERROR {type(error).__name__} {str(error)[:700]}"
        bad += bool(found)
        print(f"{name:30s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} queries differ")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
