"""Run registered queries against their SQL: ``python tests/compare.py [sf_dir] [names...]``."""

from pathlib import Path
import sys
import time

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def sorted_rows(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def difference(frame, con, sql: str) -> str | None:
    """What differs between a DataFrame and a SQL result; None when nothing does."""
    got = sorted_rows(frame.columns, frame.collect())
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    want = sorted_rows(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    if got != want:
        only_got, only_want = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} and {len(want)}\n  spark: {only_got}\n  sql:   {only_want}"
    return None


def main() -> int:
    from jobfleet.session import local_session
    from jobfleet.queries import oracle, registry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sql = local_session(), connect(sf_dir), oracle.oracle_sql()
    queries = registry.queries()
    print("no SQL:", sorted(set(queries) - set(sql)), "no query:", sorted(set(sql) - set(queries)))
    failed = []
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = difference(query(spark, sf_dir), con, sql[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s", flush=True)
        if problem:
            failed.append(name)
            print("  " + problem, flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
