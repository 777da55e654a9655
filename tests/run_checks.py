"""Compare registered queries with their SQL: python tests/run_checks.py [pattern] [sf]."""

import re
import sys
import time

sys.path.insert(0, ".")
sys.path.insert(0, "tests")
import __spark_entry__ as entry  # noqa: E402
from harness import compare, duck  # noqa: E402

from panelwise.session import get_spark  # noqa: E402

if __name__ == "__main__":
    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    sf = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if not pattern.search(name):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                res = compare(df, con, sqls[name])
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
            else:
                n = len(df.collect())
                res = "" if n else "no rows"
        except Exception as e:  # report and go on
            res, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        soft = res.startswith("[")
        bad += bool(res) and not soft
        print(f"{'ok ' if not res or soft else 'BAD'} {name} rows={n} {time.time() - t:.1f}s "
              f"{'' if name in sqls else '(no sql)'} {res}", flush=True)
    print("failures:", bad)
