"""op7 and the pipeline's stage with a benchmark row that has no id."""

from lectern.llm import decontam


def test_items_without_id_contaminate(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven eight"), (3, "nine ten")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two three four"), ("b", "six seven"), (None, None)], "item_id string, text string")
    for n in (1, 2_000_000):
        got = {r.doc_id: (r.n_hit, r["items"], r.n_items, r.contaminated) for r in decontam.decontaminate(docs, bench, slice_words=n).collect()}
        assert got == {1: (3, [], 0, True), 2: (2, ["b"], 1, True), 3: (0, [], 0, False)}
    assert [r.doc_id for r in decontam.clean_only(docs, bench).collect()] == [3]
