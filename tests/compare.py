"""Run queries next to their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


SAME_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def compare(spark, con, folder, name, query, sql) -> list[str]:
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} / {sorted(names)}")
    for field in df.schema.fields:
        expected = SAME_TYPE[field.dataType.simpleString()]
        if types.get(field.name) != expected:
            problems.append(f"type of {field.name}: {expected} / {types.get(field.name)}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} / {len(theirs)}")
    elif mine != theirs:
        first = next((a, b) for a, b in zip(mine, theirs) if a != b)
        problems.append(f"values, first difference {first[0]} / {first[1]}")
    return problems


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from orderloom.session import build_session

    folder = sys.argv[1]
    chosen = sys.argv[2:]
    spark = build_session("compare", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}, "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    sqls = e.oracle_sql()
    for name, query in e.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problems = compare(spark, con, folder, name, query, sqls[name])
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{name}: {time.time() - start:.1f}s", *(problems or ["ok"]), sep=" | ", flush=True)


if __name__ == "__main__":
    main()
