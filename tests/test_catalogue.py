"""Catalogue queries against their SQL on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry_points

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1] / "tools"))
from check import TABLES, rows  # noqa: E402

FAST = [
    "cell_fold", "row_accuracy", "quality_report", "benchmark_scores", "item_statistics", "question_blocks", "half_splits",
    "model_permutations", "derangement", "mid_rank", "column_auroc", "spearman_by_benchmark", "macro_f1", "grade_answers",
    "instruction_strict", "text_traits", "match_models", "label_column", "select_footprints", "card_columns",
    "correctness_residual", "pooled_text", "near_duplicates", "preference_pairs", "nearest_models", "score_frame",
    "group_scores", "attach_floor", "window_session", "pair_concordance", "leaderboard_gated",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, sf, con, name):
    df = entry_points.queries()[name](spark, sf)
    rel = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, rel.fetchall())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
