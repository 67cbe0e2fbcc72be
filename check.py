"""Compare registered queries with their check SQL: python check.py [folder] [name part ...] [-skipped part ...]"""

import sys
import time

from dockflow.catalog import load
from dockflow.session import get_spark
from tests.compare import compare


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = [w for w in sys.argv[2:] if not w.startswith("-")]
    skipped = [w[1:] for w in sys.argv[2:] if w.startswith("-")]
    queries, checks = load()
    spark = get_spark("check", "local[8]", 8, memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name, fn in queries.items():
        if (wanted and not any(w in name for w in wanted)) or any(w in name for w in skipped):
            continue
        t = time.time()
        try:
            if name in checks:
                ok, why, n = compare(spark, folder, fn, checks[name])
            else:
                n = len(fn(spark, folder).collect())
                ok, why = n > 0, "" if n else "no rows"
        except Exception as e:  # report and go on with the next query
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:600]}", -1
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {n:8d} {time.time() - t:6.2f}s {why}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
