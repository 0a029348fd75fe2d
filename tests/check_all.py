"""Run every query against its SQL: python tests/check_all.py [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from compare import connect, difference  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from spendloom import session  # noqa: E402


def main() -> int:
    arguments = sys.argv[1:]
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(queries())
    spark, connection, failed = session.local_session(8), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            sql = oracle_sql().get(name)
            problem = f"rows only: {df.count()}" if sql is None else difference(df, connection, sql)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem) and not problem.startswith("rows only")
        print(f"{name:26} {time.time() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
