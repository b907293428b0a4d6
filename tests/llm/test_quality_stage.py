"""The quality stage ends on long texts, because each text is split once."""

from strideline.llm import quality_rules


def splits(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("split("), plan.count("sort_array(")


def test_keep_good_splits_each_text_once(spark):
    good = " ".join(f"the word{i} of a long and quiet text" for i in range(3000))
    docs = spark.createDataFrame([(1, good), (2, "too short"), (3, good.upper()), (4, None), (5, "")], "doc_id long, text string")
    kept, judged = quality_rules.keep_good(docs), quality_rules.judged(docs)
    assert splits(kept) == splits(judged)
    assert {r.doc_id for r in kept.collect()} == {r.row.doc_id for r in judged.collect() if r.kept}
    assert kept.columns == docs.columns
