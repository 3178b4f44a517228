"""Run queries and their SQL side by side and compare rows, types and values."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "long", "int": "int", "smallint": "short", "double": "float", "float": "single",
    "string": "text", "boolean": "bool", "date": "date", "timestamp": "time",
    "timestamp_ntz": "time", "BIGINT": "long", "INTEGER": "int", "HUGEINT": "huge",
    "DOUBLE": "float", "FLOAT": "single", "VARCHAR": "text", "BOOLEAN": "bool", "DATE": "date",
    "TIMESTAMP": "time",
}


def database(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def differences(result, con, sql):
    """None if equal, else what differs."""
    rows = [tuple(r) for r in result.collect()]
    relation = con.sql(sql)
    expected = relation.fetchall()
    names, wanted = result.columns, relation.columns
    if sorted(names) != sorted(wanted):
        return f"columns {sorted(names)} != {sorted(wanted)}"
    ours = {c: KINDS.get(t, t) for c, t in result.dtypes}
    theirs = {c: KINDS.get(str(t), str(t)) for c, t in zip(wanted, relation.types)}
    if ours != theirs:
        return f"types {[(c, ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]]}"
    order, other = [names.index(c) for c in sorted(names)], [wanted.index(c) for c in sorted(names)]
    left = sorted(tuple(plain(r[i]) for i in order) for r in rows)
    right = sorted(tuple(plain(r[i]) for i in other) for r in expected)
    if left == right:
        return None
    left_only, right_only = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    return (
        f"rows {len(left)} != {len(right)}; {len(left_only)} only here {left_only[:3]}; "
        f"{len(right_only)} only there {right_only[:3]}"
    )


def main():
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries
    from sondage.session import use_folder_below_warehouse

    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_folder_below_warehouse(spark)
    con, sql = database(folder), oracle_sql()
    for name, run in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in sql:
                found = differences(run(spark, folder), con, sql[name])
                verdict = "ok" if found is None else f"DIFFERENT {found}"
            else:
                verdict = f"rows only {run(spark, folder).count()}"
        except Exception as e:  # report and go on with the next query
            verdict = f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{name} [{time.time() - start:.1f}s] {verdict}", flush=True)


if __name__ == "__main__":
    main()
