"""Control operators on small tables: batches, stages, commands, reports, merges, streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import control as K
from lectern.operators import linkage as L
from lectern.operators import selection as X
from lectern.sources import records
from lectern.streaming import incremental


@pytest.mark.parametrize("n, size, want", [(10, 3, [3, 3, 3, 1]), (10, 20, [10]), (0, 3, [])])
def test_batches(spark, n, size, want):
    rows = spark.range(0, n * 40_000, 40_000).withColumnRenamed("id", "k") if n else spark.range(0).withColumnRenamed("id", "k")
    got = K.batches(rows, "k", size).orderBy("k").collect()
    assert [sum(r.batch == b for r in got) for b in range(len(want))] == want
    assert [r.place for r in got] == [i % size for i in range(n)]


def test_stage_choice():
    stages = ["a", "b", "c", "d"]
    assert K.to_run(stages, {"a"}) == ["b", "c", "d"] and K.to_run(stages, {"b"}, "b", "c") == ["c"]
    assert K.to_run(stages, {"b"}, "b", "c", force=True) == ["b", "c"]
    with pytest.raises(ValueError):
        K.to_run(stages, set(), "x")


def test_stage_runner(spark, tmp_path):
    root = str(tmp_path)
    stages = [("half", lambda d: d.where("id % 2 = 0")), ("more", lambda d: d.where("id > 3"))]
    assert K.run_stages(spark, spark.range(10), stages, root) == [("half", 10, 5), ("more", 5, 3)]
    assert K.run_stages(spark, spark.range(10), stages, root) == []
    assert K.run_stages(spark, spark.range(10), stages, root, start_from="more", force=True) == [("more", 5, 3)]
    assert K.is_complete(spark, f"{root}/half", 5) and not K.is_complete(spark, f"{root}/half", 6) and not K.is_complete(spark, f"{root}/none")
    assert K.latest(spark, [f"{root}/none", f"{root}/more"]) == f"{root}/more" and K.latest(spark, []) is None


def test_commands(spark):
    a = spark.createDataFrame([("x", 1), ("y", 5)], "paper_id string, score int")
    b = spark.createDataFrame([("y", 9), ("z", 5)], "paper_id string, score int")
    got = K.run_commands({"a": a, "b": b}, ["get a", "merge b", "# note", "filter score > 1", "top 2"]).collect()
    assert [tuple(r) for r in got] == [("y", 5), ("z", 5)]
    for bad in (["merge b"], ["get a", "jump"], []):
        with pytest.raises(ValueError):
            K.run_commands({"a": a, "b": b}, bad)


def test_report_and_archive(spark, tmp_path):
    counts = spark.createDataFrame([("kept", 3), ("gone", 1)], "category string, n int")
    lines = K.report("Papers", counts, "category", "n")
    assert [r.line for r in lines.orderBy("pos").collect()] == ["# Papers (4 papers)", "- **gone**: 1 (25.0%)", "- **kept**: 3 (75.0%)"]
    K.write_report(lines, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()][0] == "# Papers (4 papers)"
    K.export_archive({"counts": counts}, f"{tmp_path}/all")
    assert K.import_archive(spark, f"{tmp_path}/all", ["counts"])["counts"].count() == 2
    assert [r.line for r in K.report("Papers", counts.limit(0), "category", "n").collect()] == ["# Papers (0 papers)"]


def test_positional_answers(spark):
    asked = K.batches(spark.range(4).withColumnRenamed("id", "k"), "k", 2)
    answers = spark.createDataFrame([(0, ["a", None]), (1, ["c"])], "batch long, answers array<string>")
    got = K.by_position(asked, answers).orderBy("k").collect()
    assert [(r.answer, r.found) for r in got] == [("a", True), (None, False), ("c", True), (None, False)]


def test_refresh_keeps_what_is_there_but_metrics(spark):
    rows = spark.createDataFrame([("v", 1, "s", 9), ("", 2, "s", None), (None, 3, None, None)], "venue string, citation_count int, s_venue string, s_count int")
    got = L.refresh(rows, {"venue": "s_venue"}, {"citation_count": "s_count"}, F.col("s_venue").isNotNull()).collect()
    assert [(r.venue, r.citation_count, r.n_filled, r.status) for r in got] == [("v", 9, 0, "found"), ("s", 2, 1, "found"), (None, 3, 0, "not_found")]


def test_near_titles_go(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, "10.1/a", words), (2, "10.1/b", words + " x"), (3, "10.1/a", "other title"), (4, "", words.upper()), (5, None, None), (6, "", ""),
        (7, "10.1/c", "w1 w2")
    ]
    got = L.distinct_titles(spark.createDataFrame(rows, "doc_id long, doi string, title string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 5, 6, 7]


def test_averages_reach_as_far_as_their_rate(spark):
    values = [(1, i, float(i % 7)) for i in range(600)]
    rows = spark.createDataFrame(values, "k int, t int, v double")
    for rate in (0.01, 0.3, 1.0):
        want = 0.0
        for _, i, v in values:
            want = v if i == 0 else rate * v + (1 - rate) * want
        assert X.moving_average(rows, "k", ["t"], "v", rate).first().ema == pytest.approx(want, abs=1e-9)
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            X.moving_average(rows, "k", ["t"], "v", bad)


def test_side_file_rules(spark):
    names = ["a.json", "a_report.json", ".hidden", "checkpoint.json", "log.json"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    keep = lambda rule: [r.n for r in rows.where(~records.side_file(F.col("n"), rule)).collect()]
    assert keep("reports") == ["a.json", "checkpoint.json", "log.json"] and keep("checkpoints") == ["a.json", ".hidden", "log.json"] and keep("analysis") == ["a.json", ".hidden", "checkpoint.json"]


def test_finished_windows_drop_late_rows_and_open_windows(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [(at(0, 5), "a", 1.0), (at(0, 50), "a", 2.0), (at(1, 5), "b", 3.0), (at(2, 15), "a", 4.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    events = spark.read.parquet(f"{tmp_path}/events.parquet")
    got = incremental.finished_windows(events, f"{tmp_path}/events.parquet").orderBy("start").collect()
    assert [(r.start, r.event_type, r.n, r.total) for r in got] == [(at(0, 0), "a", 2, 3.0), (at(1, 0), "b", 1, 3.0)]


def test_changed_and_pending(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "paper_id string, hash string")
    known = spark.createDataFrame([("a", "x"), ("b", "z")], "paper_id string, hash string")
    assert [r.paper_id for r in incremental.changed(rows, known).collect()] == ["b"]


def test_vector_ranking_without_query(spark):
    from lectern.operators.scoring import top_similar

    rows = (
        spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "vec_id long, embedding array<float>")
    )
    assert [(r.vec_id, r.similarity) for r in top_similar(rows, rows.where("vec_id = 0"), 2).collect()] == [(0, 1.0), (1, 1.0)]
    assert top_similar(rows, rows.where("vec_id = 99"), 2).count() == 0


def test_section_tiers(spark):
    from lectern.operators.sections import sections_tiered

    heads = {
        "full": ["Introduction", "Methods", "Results", "Discussion", "Conclusion", "Rasults"], "few": ["Introduktion", "Rasults", "Methdos"],
        "four": ["Introduction", "Our methods", "Key findings", "Discussion", "Conclussion"]
    }
    rows = spark.createDataFrame([(p, i, h) for p, hs in heads.items() for i, h in enumerate(hs)], "paper_id string, pos int, header string")
    got = sorted((r.paper_id, r.pos, r.type, r.tier) for r in sections_tiered(rows).collect())
    assert [x[1:] for x in got if x[0] == "full"] == [(i, t, 1) for i, t in enumerate(("introduction", "methods", "results", "discussion", "conclusion"))]
    assert [x[1:] for x in got if x[0] == "few"] == [(0, "introduction", 2), (1, "results", 3)] and [x[3] for x in got if x[0] == "four"] == [1, 2, 2, 1, 2]
