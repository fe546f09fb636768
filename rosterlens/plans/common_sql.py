"""Shared table expressions of the SQL checks, each the SQL form of a view in ``sources.tables``."""

DRAWS = """draws AS (
  SELECT l_suppkey AS model_id, p_brand || '|' || p_type AS question_id, p_type AS bench,
         (l_quantity > 25)::INT AS correct, l_orderkey AS order_id, l_linenumber AS line_no,
         l_partkey AS part_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CELLS = DRAWS + """, cells AS (
  SELECT model_id, question_id, bench, avg(correct) AS acc, (avg(correct) > 0.5)::INT AS correct,
         count(*) AS draws
  FROM draws GROUP BY ALL)"""

QUESTIONS = """questions AS (SELECT DISTINCT p_brand || '|' || p_type AS question_id, p_type AS bench FROM part)"""


def h(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


MODELS = f"""models AS (
  SELECT s_suppkey AS model_id, s_name AS name, s_nationkey AS family,
         CASE WHEN s_acctbal > 0 THEN s_acctbal END AS params_b,
         CASE WHEN s_acctbal > 0 THEN s_acctbal END / 100.0::DOUBLE AS vram_gb,
         ({h("'0'", "'chat'", "s_suppkey")} % 2)::INT AS is_chat
  FROM supplier)"""


def sql_literal(text: str) -> str:
    """A single-quoted SQL literal; newlines are legal inside one."""
    return "'" + text.replace("'", "''") + "'"


def responses() -> str:
    from rosterlens.sources.tables import WORDINGS

    cases = " ".join(
        f"WHEN {i} THEN replace(replace({sql_literal(w)}, '{{L}}', chr((65 + l_partkey % 4)::INT)),"
        f" '{{N}}', l_partkey::VARCHAR)"
        for i, w in enumerate(WORDINGS)
    )
    return f"""responses AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_suppkey AS model_id, l_partkey AS part_id,
         CASE l_linenumber % {len(WORDINGS)} {cases} END AS prediction,
         chr((65 + l_suppkey % 4)::INT) AS gold_letter, l_suppkey::VARCHAR AS gold_number
  FROM lineitem)"""


RESPONSES = responses()
