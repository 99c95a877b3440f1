import corpus_pipeline
from cardpulse.llm import decontaminate, linedup, mixing, simhash, toxicity
from cardpulse.llm.common import materialise
from hostile import empty, hostile

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = materialise(stage(spark, docs, SF))
        if name != "mixing":
            assert docs.columns == columns and docs.schema == inputs[name].schema

    def ids(df):
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    after = dict(zip(list(inputs), [*list(inputs.values())[1:], docs]))
    scores = toxicity.toxicity(inputs["toxicity"], labels)
    assert ids(after["toxicity"]) == ids(scores.where("score < 0.7"))
    report = {r["doc_id"]: r for r in linedup.line_report(inputs["line_dedup"]).collect()}
    assert ids(after["line_dedup"]) == {i for i, r in report.items() if r["n_removed"] < r["n_lines"]}
    assert all(r["n_chars"] == len(r["text"]) for r in after["line_dedup"].collect() if report[r["doc_id"]]["n_removed"])
    groups = simhash.near_duplicates(inputs["simhash_near_dedup"])
    assert ids(after["simhash_near_dedup"]) == ids(groups.where("doc_id = component_id"))
    bad = ids(decontaminate.contaminated(inputs["decontamination"], benchmark))
    assert ids(after["decontamination"]) == ids(inputs["decontamination"]) - bad
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, mixing.mixing_report(inputs["mixing"]).collect()))
    assert after["mixing"].count() == inputs["mixing"].count()


def test_hostile_rows(spark):
    for docs in (hostile(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, SF))
        assert docs.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
