import hashlib
from collections import Counter

import duckdb
import numpy as np

from cardpulse.llm import linedup
from hostile import empty, hostile

SF = "/root/testdata/sf0.001"


def expected(rows, min_words=10):
    """Every run of lines of every document against all earlier places."""
    docs = sorted({(i is None, i or 0, h, t) for i, h, t in rows if t is not None})
    order = {(i if not n else None, t): k for k, (n, i, _, t) in enumerate(docs)}
    lines = [t.split("\n") for *_, t in docs]
    words = [[len(x.encode().split()) for x in ls] for ls in lines]
    first, gone = {}, [set() for _ in docs]
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(words[d][a:b + 1]) >= min_words:
                    first.setdefault(tuple(ls[a:b + 1]), (d, a))
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(words[d][a:b + 1]) >= min_words and first[tuple(ls[a:b + 1])] < (d, a):
                    gone[d] |= set(range(a, b + 1))
    out = Counter()
    for i, _, t in rows:
        if t is None:
            out[(i, 0, 0, 0, hashlib.sha256(b"").hexdigest())] += 1
            continue
        d = order[(i, t)]
        kept = "\n".join(x for k, x in enumerate(lines[d]) if k not in gone[d])
        runs = sum(1 for k in gone[d] if k - 1 not in gone[d])
        out[(i, len(lines[d]), len(gone[d]), runs, hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def check(docs):
    rows = [(r["doc_id"], r["h"], r["text"]) for r in docs.selectExpr("doc_id", "xxhash64(text) as h", "text").collect()]
    got = Counter(tuple(r) for r in linedup.line_report(docs).collect())
    assert got == expected(rows)
    return got


def test_random_lines(spark):
    rng = np.random.default_rng(8)
    pool = ["one two three", "four five six seven", "", "eight", "a b c d e f g h i j k", "l m", "n o p q r s"]
    rows = [(int(i), "\n".join(rng.choice(pool, int(rng.integers(1, 14))))) for i in rng.permutation(60)]
    found = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(k[2] * n for k, n in found.items()) > 50


def test_long_runs(spark):
    run = [f"line number {i} of a passage" for i in range(70)]
    rows = [(1, "\n".join(run)), (2, "\n".join(["own start"] + run + ["own end"])), (3, "\n".join(run[10:40] + [""] * 40 + run[40:])),
            (4, "\n".join(["same short line"] * 50)), (5, "own words only")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_hostile_rows(spark):
    check(hostile(spark))
    assert linedup.line_report(empty(spark)).count() == 0
    cut = linedup.cut_documents(hostile(spark))
    assert cut.columns == hostile(spark).columns and cut.schema == hostile(spark).schema
    rows = cut.collect()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    assert {r["doc_id"] for r in rows} >= {1, 3, 4, 5, 6, 8, 9, 10, 11} and 7 not in {r["doc_id"] for r in rows}


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(linedup.OP7_SQL).fetchall()
    got = [tuple(r) for r in linedup.op7_line_dedup(spark, SF).collect()]
    assert Counter(map(str, want)) == Counter(map(str, got))
