"""Language models: bigrams are counted one by one, whatever the blocks that documents fall into."""

from touchline.llm.lm_score import Settings, cross_entropy_difference


def test_scores_do_not_depend_on_blocks(spark):
    words = [f"{a}{b}" for a in ("red", "old", "big", "far") for b in ("house", "tree", "road", "lamp")]
    texts = [(i, " ".join(words[(i * k) % 16] for k in range(1, 12))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    few, many = (
        {r["doc_id"]: r["score"] for r in cross_entropy_difference(docs, target, Settings(block=p)).collect()}
        for p in (1, 1 << 24)
    )
    assert len(few) == 40 and all(abs(few[i] - many[i]) < 1e-9 for i in few)


def test_rows_of_one_id_are_scored_each(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (None, "c d"), (2, None)], "doc_id long, text string")
    rows = cross_entropy_difference(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert len(rows) == 4 and [r["in_target"] for r in rows].count(True) == 2
    same = [r["target_loss"] for r in rows if r["doc_id"] == 1]
    assert abs(same[0] - same[1]) < 1e-12 and same[0] < 2
