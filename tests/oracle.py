"""Run an oracle in a process of its own (a stalled query can be ended) and compare rows."""

import math
import os
import pickle
import subprocess
import sys
import tempfile

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_RUN = """
import sys, pickle, duckdb
con = duckdb.connect()
for t in sys.argv[4].split():
    con.execute(f"create view {t} as select * from '{sys.argv[1]}/{t}.parquet'")
r = con.sql(open(sys.argv[2]).read())
pickle.dump((list(r.columns), r.fetchall()), open(sys.argv[3], "wb"))
"""


def oracle_rows(sql, sf_dir, timeout=120):
    with tempfile.TemporaryDirectory() as d:
        with open(os.path.join(d, "q.sql"), "w") as f:
            f.write(sql)
        subprocess.run([sys.executable, "-c", _RUN, sf_dir, f"{d}/q.sql", f"{d}/out", " ".join(TABLES)], check=True, timeout=timeout, capture_output=True)
        with open(f"{d}/out", "rb") as f:
            return pickle.load(f)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    if v.__class__.__name__ == "Decimal":
        return float(v)
    return v


def assert_same(df, sql, sf_dir):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    columns, rows = oracle_rows(sql, sf_dir)
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in rows), key=repr)
    assert got == want
