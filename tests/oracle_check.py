"""Compare registered queries with their DuckDB oracles: ``python tests/oracle_check.py SF [names]``."""

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    mine = df.toPandas()
    spent = time.time() - start
    columns = list(df.columns)
    if sql is None:
        return f"{name}: rows={len(mine)} (no oracle) spark={spent:.1f}s", True
    start = time.time()
    relation = con.execute(sql)
    theirs_columns = [d[0] for d in relation.description]
    theirs = relation.fetchall()
    oracle_spent = time.time() - start
    if sorted(columns) != sorted(theirs_columns):
        return f"{name}: COLUMNS {sorted(columns)} != {sorted(theirs_columns)}", False
    mine_rows = [
        tuple(None if v is None or v != v or str(v) == "<NA>" else (v.item() if hasattr(v, "item") else v) for v in r)
        for r in mine.itertuples(index=False, name=None)
    ]
    a, b = _rows(columns, mine_rows), _rows(theirs_columns, theirs)
    number = lambda v: repr(float(v)) if v.replace("-", "").isdigit() else v
    a = [tuple(map(number, r)) for r in a]
    b = [tuple(map(number, r)) for r in b]
    a.sort(), b.sort()
    if a != b:
        only_a = [r for r in set(a) - set(b)][:3]
        only_b = [r for r in set(b) - set(a)][:3]
        return (
            f"{name}: DIFFER rows {len(a)} vs {len(b)}, {len(set(a) - set(b))} unmatched\n"
            f"   cols   {sorted(columns)}\n   spark  {sorted(only_a)}\n   oracle {sorted(only_b)}"
        ), False
    return f"{name}: ok rows={len(a)} spark={spent:.1f}s oracle={oracle_spent:.1f}s", True


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), entry.oracle_sql()
    wanted = sys.argv[2:]
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            text, _ = compare(session, con, sf_dir, name, query, oracle.get(name))
        except Exception as error:  # noqa: BLE001
            text = f"{name}: ERROR {type(error).__name__} {str(error)[:700]}"
        print(text, flush=True)
