"""The pipeline's near_duplicates stage where ids are null or repeated."""

from lectern.llm import simhash


def test_different_texts_stay(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey"
    docs = spark.createDataFrame([(None, a, 1), (None, b, 2), (None, b, 3), (5, a, 4), (5, c, 5), (6, c, 6), (5, c, 7)], "doc_id long, text string, k int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, b), (5, a), (5, c)])
