"""op8 on embeddings of several lengths."""

from lectern.llm import embed_dedup


def test_every_length_links(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [0.0, 2.0]), (7, [0.0, 0.0]), (8, None)]
    got = {
        r.vec_id: (r.n_links, r.component_id, r.kept)
        for r in embed_dedup.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    }
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (2, 4, True), 5: (2, 4, False), 6: (2, 4, False), 7: (0, 7, True), 8: (0, 8, True)}
