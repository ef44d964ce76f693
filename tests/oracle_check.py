"""Run registered queries in Spark and their check SQL in DuckDB and compare the rows.

    python tests/oracle_check.py [table folder] [query name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return repr(x)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, run, sql: str, sf_dir: str) -> list[str]:
    """Differences between the two results; an empty list when they are equal."""
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    problems = []
    mine = {name: SQL_TYPES.get(kind, kind) for name, kind in df.dtypes}
    other = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != sorted(df.columns):
        problems.append(f"{name}: columns {sorted(df.columns)} against {sorted(columns)}")
    elif ours != theirs:
        problems.append(
            f"{name}: {sum(ours.values())} against {sum(theirs.values())} rows\n  only Spark: "
            f"{list((ours - theirs).items())[:2]}\n  only SQL:   {list((theirs - ours).items())[:2]}"
        )
    elif mine != other:
        problems.append(f"{name}: types {sorted(set(mine.items()) - set(other.items()))} against "
                        f"{sorted(set(other.items()) - set(mine.items()))}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    problems += [f"{name}: {step} in the plan" for step in UNWANTED if step in plan]
    if not ours:
        problems.append(f"{name}: no rows")
    return problems


def main() -> int:
    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            problems = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # noqa: BLE001  (report and go on with the next query)
            problems = [f"{name}: {type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4} {time.time() - start:6.2f}s {name}", *problems, sep="\n     " if problems else " ")
    print(f"{len(wanted) - failed} of {len(wanted)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
