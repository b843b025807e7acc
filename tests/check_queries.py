"""Check registered queries against their SQL: python tests/check_queries.py [name-part ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from recordloom.session import local_session  # noqa: E402
from tests.oracle import DATA, compare, connect  # noqa: E402


def main(parts: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"{DATA}/sf0.01"
    con = connect(sf)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            problems = compare(fn(spark, sf), con, sql[name]) if name in sql else [f"no SQL; {fn(spark, sf).count()} rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        ok = not problems or problems[0].startswith("no SQL")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.2f}s {' '.join(problems)[:1500] if problems else ''}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
