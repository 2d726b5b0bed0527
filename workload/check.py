"""Compare registered queries with their oracle SQL: ``python -m workload.check [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


SECONDS: dict[str, float] = {}


def oracle_connection(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "__float__") and not isinstance(value, int):
        return float(value)
    return value


def rows_by_name(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(canonical(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def compare(spark, connection, sf_dir: str, run, sql: str) -> str:
    """'' if both sides give the same bag of rows, else what differs."""
    started = time.time()
    df = run(spark, sf_dir)
    spark_names, spark_rows = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    SECONDS[sql] = time.time() - started
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    oracle_names, oracle_rows = rows_by_name(names, cursor.fetchall())
    if spark_names != oracle_names:
        return f"columns {spark_names} != {oracle_names}"
    if len(spark_rows) != len(oracle_rows):
        return f"{len(spark_rows)} rows != {len(oracle_rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, oracle_rows, strict=True) if a != b]
    if bad:
        return f"{len(bad)} of {len(spark_rows)} rows differ, first {spark_names}\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}"
    types = [type(v) for v in spark_rows[0]] if spark_rows else []
    other = [type(v) for v in oracle_rows[0]] if oracle_rows else []
    mixed = [n for n, a, b in zip(spark_names, types, other, strict=True) if a is not b and type(None) not in (a, b)]
    return f"types differ in {mixed}" if mixed else ""


def main() -> int:
    from bench import local_session

    from workload.oracles import ORACLES
    from workload.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    connection = oracle_connection(sf_dir)
    failures = 0
    for name in wanted:
        started = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, connection, sf_dir, QUERIES[name], ORACLES[name])
            else:
                rows = QUERIES[name](spark, sf_dir).collect()
                problem = "" if rows else "no rows"
                print("   ", rows[:2])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += bool(problem)
        kind = "oracle" if name in ORACLES else "rows"
        total = time.time() - started
        own = SECONDS.get(ORACLES.get(name), total)
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} {kind:6s} {own:6.2f}s of {total:6.2f}s {problem}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(min(main(), 1))
