"""Run registered queries against their SQL twins in DuckDB: python tests/compare.py [regex] [sf]."""

import math
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return f"f{v + 0.0!r}"
    if isinstance(v, int):
        return f"i{v}"
    return f"{type(v).__name__}{v}"


def compare(spark, con, fn, sql, sf_dir):
    """Empty string when equal, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    rows = rel.fetchall()
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    idx = [cols.index(c) for c in names]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in rows)
    if got == want:
        return "" if got else "no rows"
    only_g = [r for r in got if r not in set(want)][:2]
    only_w = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)} cols={names} spark_only={only_g} sql_only={only_w}"


def main():
    import __spark_entry__ as entry
    from peerspark.session import build_session
    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    sf_dir = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark = build_session(cores="8")
    import logging
    logging.disable(logging.CRITICAL)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if not pattern.search(name):
            continue
        t = time.time()
        try:
            if name in oracles:
                msg = compare(spark, con, fn, oracles[name], sf_dir)
            else:
                n = len(fn(spark, sf_dir).collect())
                msg = "" if n else "no rows"
                name += f" [rows only: {n}]"
        except Exception as e:
            msg = f"{type(e).__name__}: {str(e)[:500]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.1f}s {msg[:1500]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
