"""The audit of filters against a brute-force run of every order."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from silvergrain.llm import audit, registry

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS, LABELS = "doc_id long, text string, lang string, n long, part string, digest string", "doc_id long, quality int, toxic int"


def slow_audit(docs, labels):
    """docs: (doc_id, text, lang); every order is applied document by document."""
    first, flags = {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        failed = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [x for x in labels if i is not None and x[0] == i]
        flags.append((part or "", {k for k, v in failed.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, Counter()
    for part in {f[0] for f in flags}:
        for order in permutations("ABCDE"):
            left, gone = [f for f in flags if f[0] == part], []
            for step, x in enumerate(order, 1):
                removed = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                out[part, "".join(order), step] = [len(left), len(removed), sum(x in f[1] for f in gone), sum(f[0] == part and f[1] == {x} for f in flags), sum(f[2] for f in removed), sum(f[3] for f in removed)]
                gone += removed
                shapley[part, x] += len(removed)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_op13(spark, data):
    docs, labels = pq.read_table(f"{data}/documents.parquet").to_pylist(), pq.read_table(f"{data}/labels.parquet").to_pylist()
    got = registry.op13_filter_audit(spark, data)
    want = slow_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels])
    assert rows_of(got) == want and len(want) == got.count() == 600 * len({r["lang"] for r in docs})
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    sql = con.sql(registry.OP13_SQL)
    assert sorted(sql.columns) == sorted(got.columns)
    at = [sql.columns.index(c) for c in got.columns]
    assert sorted(tuple(r[i] for i in at) for r in sql.fetchall()) == sorted(map(tuple, got.collect()))
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, many, "en"), (2, many, "en"), (2, many, "en"), (3, many, None), (None, many, "en"), (None, None, None), (4, None, "de"), (5, "", "de"), (6, " \n\t", ""),
        (7, many + " #", "en"), (7, many + " x", "en"), (8, "A " * 500_000, "fr"), (9, many.upper(), "fr"), (10, "é漢𝄞AB", "fr"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (9, 1, 1), (77, 1, 1), (8, None, 1), (4, 0, 0), (7, 1, 0)]
    df = spark.createDataFrame([(*d, 0, "x", "y") for d in docs], DOCS)
    got = audit.audit(df, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1)))
    assert rows_of(got) == slow_audit(docs, labels)
    assert audit.audit(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    assert rows_of(audit.audit(df, spark.createDataFrame([], LABELS))) == slow_audit(docs, [])


def test_other_filters(spark):
    flags = spark.range(60).selectExpr("'p' || id % 2 AS part", "id % 2 = 0 AS X", "id % 3 = 0 AS Y", "id % 5 = 0 AS Z")
    got = audit.filter_steps(audit.subset_survivors(flags, ["X", "Y", "Z"]), ["X", "Y", "Z"])
    rows = {(r.part, r.filter_order, r.step): r for r in got.collect()}
    assert len(rows) == 2 * 6 * 3
    assert [rows["p0", "XYZ", s].removed for s in (1, 2, 3)] == [30, 0, 0] and rows["p0", "YZX", 3].removed == 16
    assert [rows["p1", "YXZ", s].kept for s in (1, 2, 3)] == [20, 20, 16] and rows["p1", "XYZ", 3].unique_fails == 4
    with pytest.raises(ValueError):
        audit.filter_steps(got, list("ABCDEFGH"))
