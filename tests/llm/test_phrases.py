import re
from collections import Counter, defaultdict

from cardpulse.llm import phrases
from hostile import empty, hostile

SF = "/root/testdata/sf0.01"


def plain_counts(rows, most=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, n


def expected(rows, least, most=4, top=2000):
    f, n = plain_counts(rows, most)
    out = []
    for lang, count in f.items():
        able = {p: a for p, a in count.items() if a >= least}
        whole = {p for p in able if len(p) >= 2}
        covered = {p[i:i + k] for p in whole for k in range(2, len(p)) for i in range(len(p) - k + 1)
                   if 100 * able[p] >= 80 * able[p[i:i + k]]}
        kept = []
        for p in whole - covered:
            score, _, l, r = min((2_000_000 * able[p] // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -able[p], b" ".join(p), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return Counter(out)


def got(df):
    return Counter(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def pairs(df):
    return [(r["lang"], r["text"]) for r in df.collect()]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = phrases.op11_phrases(spark, SF)
    assert got(df) == expected(pairs(docs), 30)
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5


def test_short_report_and_low_threshold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(phrases.collocations(docs, least=4, top=50)) == expected(pairs(docs), 4, top=50)


def test_whatever_the_sample_all_frequent_phrases_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    f, n = plain_counts(pairs(docs))
    want = {(lang, len(p), b" ".join(p).decode(), a) for lang, c in f.items() for p, a in c.items() if a >= 5}
    want |= {(lang, 0, "", k) for lang, k in n.items()}
    for share in (1, 7, 10**12):    # all documents, few, none
        report = {}
        rows = phrases.frequent_phrases(docs, 5, share=share, report=report).collect()
        assert {(r["lang"], r["n"], r["phrase"], r["f"]) for r in rows} == want and len(rows) == len(want)
        assert report["failures"] > 0   # phrases of four words are never proposed


def test_hostile_rows(spark):
    docs = hostile(spark)
    for least in (2, 3000):
        assert got(phrases.collocations(docs, least=least)) == expected(pairs(docs), least)
    assert phrases.collocations(empty(spark)).count() == 0
    tricky = hostile(spark, [(i, t, None, None) for i, t in enumerate(["A b.c d", "a\tB  c\x0bd", "é É a b", "a b c d", "\x85a b c d", "a b a b a b"])])
    assert got(phrases.collocations(tricky, least=1)) == expected(pairs(tricky), 1)


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000_000
    found = spark.createDataFrame([("x", 1, "a", big), ("x", 1, "b", big), ("x", 2, "a b", big - 7)], "lang string, n int, phrase string, f long")
    assert phrases.scored(found).first()["score"] == 2_000_000 * (big - 7) // (2 * big)
