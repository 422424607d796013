"""Command line: python tests/check.py [sf] [name ...] — compare queries with their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from beatloom.session import local_session  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
names = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session()
con = connect(sf_dir)
qs, sqls = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in qs.items():
    if names and not any(n in name for n in names):
        continue
    t = time.time()
    try:
        if name in sqls:
            msg = differences(spark, con, fn, sqls[name], sf_dir)
        else:
            msg = "" if fn(spark, sf_dir).count() else "no rows"
    except Exception as e:  # report and go on
        msg = f"{type(e).__name__}: {str(e)[:1500]}"
    bad += bool(msg)
    print(f"{'ok ' if not msg else 'BAD'} {name} {time.time() - t:.1f}s {msg}", flush=True)
print("bad:", bad)
