"""Run registered queries next to their SQL and report differences."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)

    def show(value) -> str:
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, float) and value == int(value):
            return str(int(value))
        return str(value)

    return sorted(tuple(show(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} instead of {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return None
    extra, missing = list(set(a) - set(b))[:3], list(set(b) - set(a))[:3]
    return f"{len(a)} rows for {len(b)}; extra {extra}; missing {missing}"


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as e
    from platenlog.plans.session import build_session

    spark = build_session("local[8]", "compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    expected = e.oracle_sql()
    for name, query in e.queries().items():
        if names and name not in names:
            continue
        begun = time.time()
        try:
            frame = query(spark, sf_dir)
            types = dict(frame.dtypes)
            got = frame.toPandas()
            took = time.time() - begun
            if name in expected:
                result = con.sql(expected[name])
                want = result.df()
                wrong = difference(got, want)
                kinds = {c: (types[c], str(t)) for c, t in zip(result.columns, result.types) if c in types}
                odd = {c: k for c, k in kinds.items() if not alike(*k)}
            else:
                wrong, odd = None, {"-": "no SQL"}
            print(f"{name:28s} {len(got):8d} {took:6.1f}s {'ok' if wrong is None else 'WRONG ' + wrong[:900]} {odd or ''}", flush=True)
        except Exception as error:  # a report, not a test
            print(f"{name:28s} FAILED {str(error)[:600]}", flush=True)


def alike(spark_type: str, duck_type: str) -> bool:
    return (spark_type, duck_type) in {
        ("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("boolean", "BOOLEAN"), ("double", "DOUBLE"),
    }


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
