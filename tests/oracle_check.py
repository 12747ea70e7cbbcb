"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


LIMIT = int(os.environ.get("CHECK_LIMIT", "60"))  # seconds per query


def _late(*_):
    raise TimeoutError(f"no result within {LIMIT} s")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(arrow):
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    return names, sorted((tuple(normal(v) for v in row) for row in zip(*columns)), key=repr)


def kinds(arrow):
    import pyarrow as pa

    out = {}
    for field in arrow.schema:
        t = field.type
        if pa.types.is_large_string(t):
            t = pa.string()
        out[field.name] = str(t)
    return out


def compare(spark_df, con, sql: str):
    ours = spark_df.toArrow()
    theirs = con.execute(sql)
    theirs = theirs.to_arrow_table() if hasattr(theirs, "to_arrow_table") else theirs.fetch_arrow_table()
    problems = []
    if kinds(ours) != kinds(theirs):
        a, b = kinds(ours), kinds(theirs)
        problems.append("types: " + "; ".join(
            f"{k} {a.get(k)} / {b.get(k)}" for k in sorted(set(a) | set(b)) if a.get(k) != b.get(k)))
    if sorted(ours.column_names) == sorted(theirs.column_names):
        _, mine = rows_of(ours)
        _, want = rows_of(theirs)
        if mine != want:
            extra = [r for r in mine if r not in set(want)][:3] if len(mine) < 200000 else []
            lack = [r for r in want if r not in set(mine)][:3] if len(want) < 200000 else []
            problems.append(f"rows {len(mine)} / {len(want)}; only ours {extra}; only theirs {lack}")
    return ours.num_rows, problems


def main() -> int:
    import __spark_entry__ as entry
    from proofgrain.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    signal.signal(signal.SIGALRM, _late)
    bad = 0
    for name, query in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        signal.alarm(LIMIT)
        try:
            if name in oracles:
                count, problems = compare(query(spark, sf_dir), con, oracles[name])
            else:
                count, problems = query(spark, sf_dir).toArrow().num_rows, []
        except Exception as error:  # report and go on with the next query
            count, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        bad += bool(problems)
        mark = "BAD" if problems else ("ok " if name in oracles else "run")
        print(f"{mark} {name:34s} rows={count:<8d} {time.time() - start:6.2f}s", *problems, sep="\n      " if problems else " ", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
