"""Run registered queries beside their DuckDB oracles: python -m tests.oracle_check SF NAME..."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "as_integer_ratio") and not isinstance(v, bool):
        return f"{float(v):.9g}" if "." in str(v) else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def compare(spark, name, query, sql, sf_dir):
    began = time.time()
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    took = time.time() - began
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in columns] if sorted(names) == columns else None
    if order is None:
        return f"{name}: columns {columns} against {sorted(names)}"
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    if ours == theirs:
        return f"{name}: ok, {len(ours)} rows, {took:.1f} s"
    odd = [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
    return f"{name}: DIFFERS, {len(ours)} against {len(theirs)} rows, {sum(a != b for a, b in zip(ours, theirs))} unequal\n   {columns}\n" + "\n".join(f"   {a}\n   {b}" for a, b in odd)


def main():
    from fleetlens.session import build_session
    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        try:
            if name in oracles:
                said = compare(spark, name, queries[name], oracles[name], f"/root/testdata/sf{sf}")
            else:
                began = time.time()
                said = f"{name}: no oracle, {queries[name](spark, f'/root/testdata/sf{sf}').count()} rows, {time.time() - began:.1f} s"
        except Exception as e:
            said = f"{name}: FAILED {type(e).__name__} {str(e)[:1500]}"
        bad += "ok," not in said and "no oracle" not in said
        print(said, flush=True)
    spark.stop()
    sys.exit(bad)


if __name__ == "__main__":
    main()
