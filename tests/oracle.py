"""Compare registered queries with their SQL: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import pathlib
import sys
import time
from collections import Counter

import duckdb

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return repr(v)
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(name, spark_df, con, sql) -> str | None:
    """None when both sides agree, else what differs."""
    got_cols, got = normal(spark_df.columns, spark_df.collect())
    rel = con.sql(sql)
    want_cols, want = normal(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{name}: {sum(got.values())} rows vs {sum(want.values())}; "
            f"only spark {sum(extra.values())} {list(extra)[:3]}; "
            f"only sql {sum(missing.values())} {list(missing)[:3]}"
        )
    return None


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def type_notes(spark_df, con, sql) -> list[str]:
    """Columns whose types differ between the two sides."""
    rel = con.sql(sql)
    want = dict(zip(rel.columns, map(str, rel.types)))
    return [
        f"{c} {t}/{want.get(c)}" for c, t in spark_df.dtypes if SAME_TYPE.get(t, t) != want.get(c)
    ]


def main(argv):
    from pyspark.sql import SparkSession

    sf = argv[0] if argv else "0.001"
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(queries)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                problem = difference(name, df, con, sql[name])
                notes = type_notes(df, con, sql[name])
                if notes:
                    print("types", name, *notes, flush=True)
                n = "" if problem else f"{con.sql(f'select count(*) from ({sql[name]})').fetchall()[0][0]} rows"
            else:
                problem, n = None, f"{len(df.collect())} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{name}: {type(e).__name__} {str(e)[:600]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - start:.1f}s {problem or n}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
