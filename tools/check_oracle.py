"""Run registered queries in Spark and their oracle SQL in DuckDB; report matches.

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]

CHECK_STORED=1 runs the queries on CRM tables written once with
``Tables.materialize`` (under the checkpoint folder) instead of derived views.
"""
import os
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from wayline.plans.oracle_check import compare, duckdb_connect  # noqa: E402
from wayline.plans.registry import REGISTRY, oracle_sql, queries  # noqa: E402
from wayline.session import build_session, scratch_path  # noqa: E402
from wayline.sources.views import Tables  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
pats = sys.argv[2:]
spark = build_session()
con = duckdb_connect(sf)
qs, os_ = queries(), oracle_sql()
if os.environ.get("CHECK_STORED") == "1":
    stored = Tables.of(spark, sf).materialize(scratch_path(spark, "crm-check"))
    qs = {n: (lambda s_, d, _f=REGISTRY[n].fn: _f(stored)) for n in qs}
bad = 0
for name, fn in qs.items():
    if pats and not any(p in name for p in pats):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf)
        if name in os_:
            r = compare(df, con, os_[name])
            ok = r["values_match"] and r["spark_rows"] == r["oracle_rows"]
            extra = "" if ok else f" cols={r['columns_match']} {r['spark_cols'] if not r['columns_match'] else ''} {r['oracle_cols'] if not r['columns_match'] else ''} spark={r.get('only_spark')} oracle={r.get('only_oracle')}"
            print(f"{'OK ' if ok else 'BAD'} {name:32s} rows={r['spark_rows']}/{r['oracle_rows']} {time.time()-t0:.2f}s{extra}", flush=True)
            bad += not ok
        else:
            n = df.count()
            print(f"ROW {name:32s} rows={n} (no oracle) {time.time()-t0:.2f}s", flush=True)
    except Exception as e:  # noqa: BLE001
        bad += 1
        print(f"ERR {name:32s} {type(e).__name__}: {str(e)[:800]}", flush=True)
print("failures:", bad)
