"""Run registered queries and their SQL twins side by side.

    python tests/compare.py FOLDER [QUERY ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return db


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(
        tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows
    )


def difference(spark, db, query, sql: str, folder: str) -> str:
    """'' when both sides agree, else what differs."""
    frame = query(spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    theirs = rows_of(names, answer.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} <> {sorted(names)}"
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows <> {sum(theirs.values())}; only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pagemill.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    folder, wanted = sys.argv[1], sys.argv[2:] or list(queries())
    db, twins = connect(folder), oracle_sql()
    for name in wanted:
        begun = time.time()
        try:
            said = difference(spark, db, queries()[name], twins[name], folder) if name in twins else "no twin"
        except Exception as problem:  # noqa: BLE001
            said = f"failed: {str(problem)[:500]}"
        print(f"{name:22s} {time.time() - begun:6.1f}s  {said or 'same'}"[:900], flush=True)


if __name__ == "__main__":
    main()
