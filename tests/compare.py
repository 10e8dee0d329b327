"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


KINDS = {"bigint": "int", "int": "int", "smallint": "int", "integer": "int", "hugeint": "int", "double": "float", "float": "float"}
KINDS |= {"string": "text", "varchar": "text", "boolean": "bool"}


def kind(name: str) -> str:
    return KINDS.get(name.lower(), name.lower())


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, fn, sql: str | None, folder: str, con=None) -> dict:
    started = time.time()
    df = fn(spark, folder)
    got = df.collect()
    out = {"rows": len(got), "spark": round(time.time() - started, 2), "dtypes": df.dtypes}
    if sql is None:
        return out | {"ok": None}
    started = time.time()
    cursor = (con or duck(folder)).execute(sql)
    names = [c[0] for c in cursor.description]
    types = [str(c[1]) for c in cursor.description]
    want = cursor.fetchall()
    out["duck"] = round(time.time() - started, 2)
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    else:
        mine, theirs = dict(df.dtypes), dict(zip(names, types))
        for c in names:
            if kind(mine[c]) != kind(theirs[c]):
                problems.append(f"type of {c}: {mine[c]} vs {theirs[c]}")
            elif mine[c].replace("string", "varchar").replace("int", "integer" if mine[c] == "int" else "int") != theirs[c].lower():
                out.setdefault("notes", []).append(f"{c}: {mine[c]} vs {theirs[c]}")
        a, b = rows_of(df.columns, got), rows_of(names, want)
        if len(a) != len(b):
            problems.append(f"rows {len(a)} vs {len(b)}")
        if a != b:
            extra, missing = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
            problems.append(f"values differ: only spark {str(extra)[:400]} only sql {str(missing)[:400]}")
    out["ok"] = not problems
    out["problems"] = problems
    out["hash"] = hashlib.md5(str(got and rows_of(df.columns, got)).encode()).hexdigest()[:8]
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from corpusflow.session import local_session

    folder = argv[0]
    names = argv[1:] or list(entry.queries())
    spark = local_session(8)
    con = duck(folder)
    failed = 0
    for name in names:
        try:
            result = compare(spark, entry.queries()[name], entry.oracle_sql().get(name), folder, con)
        except Exception as error:  # report and go on to the next query
            result = {"ok": False, "problems": [f"{type(error).__name__}: {str(error)[:1500]}"]}
        failed += result["ok"] is False
        print(name, result["ok"], {k: v for k, v in result.items() if k in ("rows", "spark", "duck", "problems", "notes") and v}, flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
