"""File readers on small files."""

import json
import lzma

import pytest
from pyspark.sql import functions as F

from rosterlens.operators.selection import SELECTORS, select
from rosterlens.operators.tasks import TASKS, Bench, TaskSpec, run_tasks
from rosterlens.sources import files as S
from rosterlens.streaming import ingest as I


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")


def test_probe_keeps_line_separators_inside_strings(spark, tmp_path):
    row = {"id": "a", "axis": "mmlu", "question": "one two", "gold": "A", "grader": "bench:mmlu_anatomy"}
    lines(tmp_path / "p.jsonl", [row])
    assert S.load_probe(spark, str(tmp_path / "p.jsonl")).first()["question"] == "one two"


def test_probe_refuses_missing_fields_and_unknown_graders(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"id": "a", "axis": "x", "question": "q", "grader": "bench:mmlu"}])
    with pytest.raises(S.SourceError, match="gold"):
        S.load_probe(spark, str(tmp_path / "a.jsonl"))
    lines(tmp_path / "b.jsonl", [{"id": "a", "axis": "x", "question": "q", "gold": "1", "grader": "bench:nobody"}])
    with pytest.raises(S.SourceError, match="nobody"):
        S.load_probe(spark, str(tmp_path / "b.jsonl"))


def test_recorded_responses_plain_and_xz(spark, tmp_path):
    lines(tmp_path / "m1.jsonl", [{"id": "a", "prediction": "first"}, {"id": "b", "prediction": "x"}, {"id": "a", "prediction": "last"}])
    with lzma.open(tmp_path / "m2.jsonl.xz", "wt", encoding="utf-8") as f:
        f.write('{"id": "a", "prediction": "old"}\n{"id": "a", "prediction": "new"}\n')
    got = {(r["model_id"], r["id"]): r["prediction"] for r in S.recorded_responses(spark, str(tmp_path)).collect()}
    assert got == {("m1", "a"): "last", ("m1", "b"): "x", ("m2", "a"): "new"}


def test_results_last_line_wins_and_draw_lists(spark, tmp_path):
    base = {"axis": "x", "n_tok": 1, "model": "m1", "draw_idx": 0}
    lines(tmp_path / "m1" / "results.jsonl", [{"id": "a", "correct": 0, **base}, {"id": "a", "correct": 1, **base}, {"id": "b", "correct": [1, 0, 1], **base}])
    lines(tmp_path / "m2" / "results.jsonl", [{"id": "a", "correct": 0, **base, "model": "m2"}])
    rows = S.load_results(spark, str(tmp_path))
    got = {(r["model_id"], r["id"]): r["s"] for r in S.graded_draws(rows).groupBy("model_id", "id").agg(F.sum("correct").alias("s")).collect()}
    assert got == {("m1", "a"): 1, ("m1", "b"): 2, ("m2", "a"): 0}
    assert [r[0] for r in S.collected_models(spark, str(tmp_path)).collect()] == ["m1", "m2"]


def test_boards_merge_and_clash(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"model_ids": ["m"], "tables": {"t1": {"scores": {"m": 1.5, "n": 2.0}, "n_published": 2, "n_matched": 1}}}))
    a = S.board_labels(spark, str(tmp_path / "a.json"))
    assert {(r["board"], r["model_id"], r["value"]) for r in a.collect()} == {("t1", "m", 1.5), ("t1", "n", 2.0)}
    assert S.merge_boards(a, a.withColumn("board", F.lit("t2"))).count() == 4
    with pytest.raises(S.SourceError, match="t1"):
        S.merge_boards(a, a)


def test_survey_aliases_dates_footprints(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"metrics": {"elo": {"m": "1200"}}, "model_attributes": {"m": {"origin": "x"}}}))
    metrics, attributes = S.survey_board(spark, str(tmp_path / "s.json"))
    assert metrics.first()["value"] == "1200" and attributes.first()["attribute"] == "origin"
    (tmp_path / "al.json").write_text(json.dumps({"aliases": {"P": "M"}, "notes": ["x"]}))
    assert S.alias_map(spark, str(tmp_path / "al.json")).first()["model"] == "M"
    (tmp_path / "d.json").write_text(json.dumps({"models": {"a": {"created_at": "2024-05-06T01:02:03Z"}, "b": "2023-01-02", "c": "2023-13-02", "d": {}}}))
    assert {r["key"]: r["date"] for r in S.release_dates(spark, str(tmp_path / "d.json")).collect()} == {"a": "2024-05-06", "b": "2023-01-02", "c": "", "d": ""}
    (tmp_path / "f.json").write_text(json.dumps({"models": {"a": {"dir": "a", "params_b": 7, "quant": "bf16", "serve_quant": "awq", "weight_bytes": 14}}}))
    assert S.footprints(spark, str(tmp_path / "f.json")).first()["serve_quant"] == "awq"


def test_cards_drop_malformed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ok": True, "architecture": {"model_type": "Llama", "parameter_dtypes": {"bf16": 7}}}))
    (tmp_path / "b.json").write_text('{"ok": tru')
    (tmp_path / "c.json").write_text(json.dumps({"ok": False}))
    got = S.model_cards(spark, str(tmp_path)).collect()
    assert [r["file_key"] for r in got] == ["a"] and got[0]["architecture"]["parameter_dtypes"] == {"bf16": 7}


def test_empty_csv_keeps_its_header(spark, tmp_path):
    S.write_csv(spark.range(3).filter("id > 5"), str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))
    assert text.strip() == "id"


def test_plan_and_question_table_contracts(spark, tmp_path):
    models = spark.createDataFrame([(1,), (2,)], "model_id bigint")
    S.write_table(models.filter("model_id = 1").withColumn("fold", F.lit(0)), str(tmp_path / "plan"))
    with pytest.raises(S.SourceError):
        S.read_plan(spark, str(tmp_path / "plan"), models)
    bank = spark.createDataFrame([("a", [1.0, 2.0])], "question_id string, emb array<float>")
    S.write_table(bank, str(tmp_path / "q"))
    with pytest.raises(S.SourceError):
        S.question_table(spark, str(tmp_path / "q"), spark.createDataFrame([("b",)], "question_id string"), 2)
    with pytest.raises(Exception, match="width"):
        S.question_table(spark, str(tmp_path / "q"), bank.select("question_id"), 3).collect()


def test_stream_merge_survives_replay_and_compaction(spark, tmp_path):
    rows = spark.createDataFrame([("m", "q", 0, 1), ("m", "q", 1, 5), ("n", "q", 1, 2)], I.GRADED)
    folder = str(tmp_path / "t")
    for _ in range(2):
        I.merge_batch(rows, folder)
    I.merge_batch(spark.createDataFrame([("m", "q", 0, 4)], I.GRADED), folder)
    want = {("m", 1, 5), ("n", 1, 2)}
    assert {(r["model_id"], r["correct"], r["seq"]) for r in I.read_merged(spark, folder).collect()} == want
    I.compact(spark, folder, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_task_runner_keeps_going(spark):
    b = Bench(embedding=spark.createDataFrame([(1, [0.0])], "model_id bigint, vec array<double>"), cells=None, models=None)

    def boom(_):
        raise ValueError("broken")

    TASKS["_boom"] = TaskSpec("_boom", "r2", boom, "x")
    TASKS["_short"] = TaskSpec("_short", "r2", lambda b: b.embedding.select(F.lit(1.0).alias("other")), "x")
    try:
        got = {r["task"]: r for r in run_tasks(b, ["_boom", "_short", "external_topk"]).collect()}
    finally:
        del TASKS["_boom"], TASKS["_short"]
    assert "broken" in got["_boom"]["error"] and "primary" in got["_short"]["error"]
    assert got["external_topk"]["note"] and got["external_topk"]["error"] is None
    with pytest.raises(ValueError, match="unknown"):
        run_tasks(b, ["nothing"])


def test_selectors(spark):
    cells = spark.createDataFrame([(m, f"q{q}", 1.0, 1) for m in range(3) for q in range(5)], "model_id int, question_id string, acc double, correct int")
    assert select(cells, "random", 3, 1).count() == 3
    assert select(cells, "random", 99, 1).count() == 5
    with pytest.raises(ValueError):
        select(cells, "random", -1, 1)
    with pytest.raises(ValueError):
        select(cells, "nobody", 1, 1)
    assert {"random", "fisher", "discrimination"} <= set(SELECTORS)
