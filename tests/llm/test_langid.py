import zlib

import numpy as np

from cardpulse.llm import langid
from hostile import empty, hostile

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.op6_langid(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_hostile_rows(spark):
    rows = langid.languages(hostile(spark)).collect()
    assert len(rows) == hostile(spark).count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 11))
    assert by[1]["lang_pred"] in ("en", "fr") and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.languages(empty(spark)).count() == 0
    unknown = hostile(spark, [(1, "words", None, "a")])
    assert langid.languages(unknown).first()["lang_pred"] == "und"


def test_gradients_and_whole_texts():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abcde "), 400)) for _ in range(30)] + [bytes(rng.choice(list(b"vwxyz "), 400)) for _ in range(30)]
    windows = np.vstack([langid.cut(t) for t in texts])
    y = np.repeat([0, 1], len(windows) // 2)
    net = langid.train(windows, y, ["a", "v"])
    assert (langid.forward(net, windows).argmax(axis=1) == y).mean() > 0.99
    long = b"abcde " * 30 + b"vwxyz " * 20_000
    assert langid.classify(net, [long, b"x", b"\xff\xfe"]).shape == (3, 2)
    assert langid.classify(net, [long])[0].argmax() == 1 and langid.classify(net, [long[:128]])[0].argmax() == 0


def test_numerals_are_no_letters(spark):
    rows = hostile(spark, [(1, "² ① ٥ 12", "en", "a"), (2, "²x", "en", "a"), (3, "漢 ئ", "en", "a"), (4, "some words here", "fr", "a")])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.languages(rows).collect()}
    assert got[1] == "und" and got[2] != "und" and got[3] != "und"


def test_shares_below_a_millionth_choose_rows(spark):
    from pyspark.sql import functions as F

    from cardpulse.llm.common import share_of
    u = spark.range(2_000_000).select(share_of("id", "x").alias("u"))
    low = u.agg(F.min("u"), F.count_distinct(F.col("u")), F.count_if(F.col("u") < 5e-6), F.max("u")).first()
    assert low[0] < 1e-5 and low[1] == 2_000_000 and 0 < low[2] < 50 and low[3] < 1
