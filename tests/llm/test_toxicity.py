import zlib

import numpy as np

from cardpulse.llm import toxicity
from hostile import empty, hostile

INSULT = {"en": ["idiot", "moron", "scum", "clown"], "xx": ["grolfan", "grolfer", "grolfin", "zurkala", "zurkata"]}


def corpus(spark, n=1200, seed=3):
    rng = np.random.default_rng(seed)
    letters = list("abcdefghiklmnoprstuv")
    vocabulary = ["".join(rng.choice(letters, 5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(5, 80))))
        toxic = int(rng.random() < 0.15)
        if toxic:
            for w in rng.choice(INSULT["en" if i % 2 else "xx"], int(rng.integers(2, 5))):
                words.insert(int(rng.integers(0, len(words))), str(w))
        docs.append((i, " ".join(words), "en", "s"))
        if i % 2:
            labels.append((i, 1, toxic))
        elif i % 4 == 0:
            labels.append((i, None, toxic))
    truth = {d[0]: int(any(w in d[1].split() for ws in INSULT.values() for w in ws)) for d in docs}
    return hostile(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_learns_and_generalises(spark):
    docs, labels, truth = corpus(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    assert right >= 0.99
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels, _ = corpus(spark)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert a == b


def test_reject_keeps_columns_and_clean_rows(spark):
    docs, labels, truth = corpus(spark)
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    clean = {i for i, t in truth.items() if not t}
    assert clean <= ids and len(ids - clean) <= 0.02 * len(truth)


def test_hostile_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 1, 0), (4, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        rows = toxicity.toxicity(hostile(spark), labels).collect()
        assert len(rows) == hostile(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.toxicity(empty(spark), labels).count() == 0
    one = spark.createDataFrame([(1, "you idiot, you stupid moron", None, None)], "doc_id long, text string, lang string, source string")
    assert toxicity.toxicity(one, none).first()["predicted"] == 1


def test_label_model_finds_rates_and_dependence():
    rng = np.random.default_rng(0)
    n = 20_000
    y = rng.random(n) < 0.2
    votes = np.stack([np.where(y, rng.random(n) < p, rng.random(n) < q) for p, q in ((0.8, 0.05), (0.7, 0.1), (0.6, 0.02), (0.75, 0.03))], axis=1)
    copied = np.where(rng.random(n) < 0.9, votes[:, 0], rng.random(n) < 0.2)[:, None]
    votes = np.hstack([votes, copied])
    post, rates, deps = toxicity.label_model(votes, np.where(votes.sum(axis=1) >= 2, 0.8, 0.1), 0.2)
    assert abs(post.mean() - y.mean()) < 0.03 and ((post > 0.5) == y).mean() > 0.95
    assert {(0, 4), (4, 0)} & {(i, j) for i, j, _ in deps}
    assert np.abs(rates[1:4, 1] - [0.7, 0.6, 0.75]).max() < 0.06


def test_recall_on_the_given_rows(spark):
    """Of the held-out toxic rows of the given table; about 6 % of its toxic rows hold no marked word at all."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = toxicity.op2_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    caught = sum(r["predicted"] for r in held if r["toxic"])
    assert caught >= 0.9 * sum(r["toxic"] for r in held)
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.01 * caught


def test_scoring_agrees_with_the_features_of_learning():
    words = ["achlichte", "achlicha", "idiot", "das", "und"]
    wanted = {"achlich*", "idiot", "insults en", "achlicha"}
    model = toxicity.Model({f: (0.7, 0.3) for f in wanted}, -1.0)
    text = " ".join(words * 3)
    times = {f: sum(f in toxicity.word_hits(w, wanted) for w in words) * 3 for f in sorted(wanted)}
    x = toxicity.feature_values(np.array([list(times.values())], float), np.array([15]))
    z = -1.0 + x[0, :4].sum() * 0.7 + x[0, 4:].sum() * 0.3
    assert abs(toxicity.scores(model, [text])[0] - 1 / (1 + np.exp(-z))) < 1e-12
    assert "achlich*%" in toxicity.text_features(text) and "das%" in toxicity.text_features(text)


def test_the_annotator_is_not_explained_away():
    """Rows of one kind that only the annotator and one voter tell apart stay with the annotator."""
    rng = np.random.default_rng(0)
    n = 3000
    toxic = rng.random(n) < 0.1
    kind = rng.random(n) < 0.3
    clear = toxic & ~kind & (rng.random(n) < 0.95)
    vague = np.where(toxic & kind, rng.random(n) < 0.95, rng.random(n) < 0.015)
    votes = np.stack([clear, vague, ~clear & ~vague, toxic], axis=1)
    post, _, deps = toxicity.label_model(votes, np.where(toxic, 0.95, 0.05), float(toxic.mean()),
                                         silent=np.array([True, True, True, False]), apart=np.array([False, False, False, True]))
    assert ((post > 0.5) == toxic)[kind & vague].mean() > 0.95
    assert all(3 not in d[:2] for d in deps)
