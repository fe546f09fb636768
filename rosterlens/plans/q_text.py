"""Queries on whole texts: instruction checks and style traits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rosterlens.functions import instructions as I
from rosterlens.operators import traits as TR
from rosterlens.plans.common_sql import sql_literal as q
from rosterlens.plans.q_cells import rounded
from rosterlens.plans.registry import query
from rosterlens.sources import tables as T

HEAD = "<<On things>>\nSection 1\n"
FOOT = "\n\n* one *point*\n- two [slot] [other]\n******\n**strong** NASA said\nP.S. bye"
#: What a JSON string of either engine holds as it is.
PLAIN = "[^A-Za-z0-9 .,]"


def essays(spark, sf):
    """Every document's whole text; a third carries markup around it, a fifth is in capitals, some are quoted or in JSON."""
    d = F.col("doc_id")
    text = (
        F.when(d % 3 == 0, F.concat(F.lit(HEAD), F.col("text"), F.lit(FOOT)))
        .when((d % 5 == 1) & ~F.contains("text", F.lit("ß")), F.upper("text"))
        .when(d % 7 == 2, F.concat(F.lit('"'), F.col("text"), F.lit('"')))
        .when(d % 11 == 4, F.concat(F.lit('```json\n{"a": "'), F.regexp_replace("text", PLAIN, " "), F.lit('", "b": [1, null]}\n```')))
        .otherwise(F.col("text"))
    )
    return T.documents(spark, sf).select("doc_id", "lang", "source", text.alias("text"))


ESSAYS = f"""essays AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN {q(HEAD)} || text || {q(FOOT)}
  WHEN doc_id % 5 = 1 AND NOT contains(text, 'ß') THEN upper(text) WHEN doc_id % 7 = 2 THEN '"' || text || '"'
  WHEN doc_id % 11 = 4 THEN '```json' || chr(10) || '{{"a": "' || regexp_replace(text, {q(PLAIN)}, ' ', 'g') || '", "b": [1, null]}}' || chr(10) || '```' ELSE text END AS r FROM documents)"""

S = "regexp_replace(r, '^\\s+|\\s+$', '', 'g')"
W = f"regexp_extract_all(r, {q(I.WORD)})"


def s_count(p: str, t: str = "r") -> str:
    return f"len(regexp_extract_all({t}, {q(p)}))"


def s_word(k: str) -> str:
    return f"len(list_filter({W}, lambda w: lower(w) = {q(k)}))"


def s_parts(split: str) -> str:
    return f"list_filter({split}, lambda p: regexp_matches(p, '\\S'))"


PARAS = s_parts("string_split(r, chr(10) || chr(10))")

#: check name -> (instruction id, arguments, the check in SQL)
CHECKS = {
    "no_comma": ("punctuation:no_comma", {}, "NOT contains(r, ',')"),
    "lowercase": ("change_case:english_lowercase", {}, "r = lower(r)"),
    "capital": ("change_case:english_capital", {}, "r = upper(r)"),
    "capital_words": (
        "change_case:capital_word_frequency",
        {"capital_relation": "at least", "capital_frequency": 1},
        f"len(list_filter({W}, lambda w: regexp_matches(w, '^\\p{{L}}+$') AND w = upper(w) AND w <> lower(w))) >= 1",
    ),
    "n_words": ("length_constraints:number_words", {"relation": "less than", "num_words": 100}, f"len({W}) < 100"),
    "n_sentences": (
        "length_constraints:number_sentences",
        {"relation": "at least", "num_sentences": 5},
        f"CASE WHEN {S} = '' THEN 0 ELSE 1 + len(regexp_extract_all({S}, '[.!?]\\s+')) END >= 5",
    ),
    "n_paragraphs": (
        "length_constraints:number_paragraphs",
        {"num_paragraphs": 3},
        "len(" + s_parts("regexp_split_to_array(r, '\\s*\\*\\*\\*\\s*')") + ") = 3",
    ),
    "first_word": (
        "length_constraints:nth_paragraph_first_word",
        {"nth_paragraph": 2, "num_paragraphs": 2, "first_word": "One"},
        f"len({PARAS}) >= 2 AND lower(regexp_extract(list_extract({PARAS}, 2), {q(I.WORD)})) = 'one'",
    ),
    "keywords": ("keywords:existence", {"keywords": ["the", "of"]}, f"{s_word('the')} > 0 AND {s_word('of')} > 0"),
    "forbidden": ("keywords:forbidden_words", {"forbidden_words": ["the", "les"]}, f"NOT ({s_word('the')} > 0 OR {s_word('les')} > 0)"),
    "keyword_count": ("keywords:frequency", {"keyword": "the", "relation": "at least", "frequency": 3}, f"{s_word('the')} >= 3"),
    "letter_count": (
        "keywords:letter_frequency",
        {"letter": "E", "let_relation": "less than", "let_frequency": 40},
        "length(lower(r)) - length(replace(lower(r), 'e', '')) < 40",
    ),
    "placeholders": ("detectable_content:number_placeholders", {"num_placeholders": 2}, s_count(I.PLACEHOLDER) + " >= 2"),
    "postscript": ("detectable_content:postscript", {"postscript_marker": "P.S."}, "regexp_matches(r, '(?im)^\\s*P\\.S\\.')"),
    "bullets": ("detectable_format:number_bullet_lists", {"num_bullets": 2}, s_count(I.BULLET) + " = 2"),
    "highlights": ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, s_count(I.HIGHLIGHT, "replace(r, '**', '*')") + " >= 2"),
    "title": ("detectable_format:title", {}, f"regexp_matches(r, {q(I.TITLE)})"),
    "sections": ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 1}, "len(regexp_extract_all(r, '(?m)^\\s*Section\\s*\\d+')) >= 1"),
    "json": ("detectable_format:json_format", {}, f"json_valid(regexp_replace({S}, '(?i)^```(?:json)?\\s*|\\s*```$', '', 'g'))"),
    "constrained": ("detectable_format:constrained_response", {}, " OR ".join(f"contains(r, {q(c)})" for c in I.CONSTRAINED)),
    "quotation": ("startend:quotation", {}, f"length({S}) >= 2 AND {S} LIKE '\"%' AND {S} LIKE '%\"'"),
    "end_phrase": ("startend:end_checker", {"end_phrase": " Bye "}, f"suffix(lower({S}), 'bye')"),
    "two_responses": ("combination:two_responses", {}, "len(" + s_parts("string_split(r, '******')") + ") = 2"),
    "repeat_prompt": ("combination:repeat_prompt", {"prompt_to_repeat": "<<on THINGS>>"}, f"starts_with(lower({S}), '<<on things>>')"),
    "language": ("language:response_language", {"language": "en"}, "false"),
    "unknown": ("no:such_check", {}, "false"),
}


@query(
    "instruction_checks",
    f"WITH {ESSAYS} SELECT doc_id, {', '.join(f'coalesce({c[2]}, false)::INT AS {n}' for n, c in CHECKS.items())} FROM essays",
)
def instruction_checks(spark, sf):
    """Every instruction check on every whole text."""
    df = I.stage(essays(spark, sf), "text")
    cols = []
    for name, (iid, kw, _) in CHECKS.items():
        args = F.from_json(F.lit(json.dumps(kw)), I.ARGS)
        cols.append(I.check(iid, args).cast("int").alias(name))
    return df.select("doc_id", *cols)


#: Prompts of several instructions; a text gets one by its id. The third has more ids than arguments.
PROMPTS = (
    ("no_comma", "n_words"),
    ("title", "bullets", "postscript", "placeholders"),
    ("keywords", "n_sentences"),
    ("capital", "n_words"),
    ("quotation", "constrained", "lowercase"),
    ("json",),
    ("forbidden", "letter_count"),
)


def prompt_gold(names: tuple[str, ...]) -> str:
    return json.dumps({"instruction_id_list": [CHECKS[n][0] for n in names], "kwargs": [CHECKS[n][1] for n in names]})


@query(
    "instruction_strict",
    f"""WITH {ESSAYS}, c AS (SELECT doc_id, doc_id % {len(PROMPTS)} AS p, {', '.join(f'coalesce({c[2]}, false)::INT AS {n}' for n, c in CHECKS.items())} FROM essays)
    SELECT doc_id, CASE p {' '.join(f'WHEN {i} THEN ({" AND ".join(n + " = 1" for n in names)})::INT' for i, names in enumerate(PROMPTS))} END AS followed,
      (CASE p {' '.join(f'WHEN {i} THEN {" + ".join(names)}' for i, names in enumerate(PROMPTS))} END)::INT AS n_followed,
      (CASE p {' '.join(f'WHEN {i} THEN {len(names)}' for i, names in enumerate(PROMPTS))} END)::INT AS n_instructions FROM c""",
)
def instruction_strict(spark, sf):
    """Strict prompt-level verdict: the instructions come from the item's JSON gold."""
    golds = F.array(*[F.lit(prompt_gold(p)) for p in PROMPTS])
    df = essays(spark, sf).withColumn("gold", F.get(golds, (F.col("doc_id") % len(PROMPTS)).cast("int")))
    return I.follows_all(df, "text", "gold").select("doc_id", F.col("followed").cast("int").alias("followed"), "n_followed", "n_instructions")


FLAGS = f"""flags AS (SELECT source AS model_id, lang AS question_id, len(regexp_extract_all(r, {q(TR.TOKEN)}))::DOUBLE AS n_tok, length(r)::DOUBLE AS n_char,
   regexp_matches(r, {q(TR.HEDGE)})::INT AS hedge, regexp_matches(r, {q(TR.REFUSAL)})::INT AS refusal,
   (NOT regexp_matches(r, {q(TR.SENTENCE_END)}))::INT AS truncated, regexp_matches(r, {q(TR.LIST_LINE)})::INT AS listed,
   contains(r, {q(chr(92) + 'boxed')})::INT AS boxed, contains(r, '```')::INT AS code, regexp_matches(r, {q(TR.FIRST_PERSON)})::INT AS first_person,
   (length(r) - length(replace(r, chr(10), '')))::DOUBLE AS newlines FROM essays),
 fz AS (SELECT f.*, (n_tok - m1) / greatest(s1, 1e-9) AS z1, (n_char - m2) / greatest(s2, 1e-9) AS z2 FROM flags f JOIN
   (SELECT question_id, avg(n_tok) AS m1, stddev_pop(n_tok) AS s1, avg(n_char) AS m2, stddev_pop(n_char) AS s2 FROM flags GROUP BY 1) USING (question_id)),
 traits AS (SELECT model_id, count(*) AS n_answers, avg(ln(1 + n_tok)) AS log_n_tok, avg(ln(1 + n_char)) AS log_n_char, avg(z1) AS z_n_tok, avg(z2) AS z_n_char,
   avg(hedge) AS hedge_rate, avg(refusal) AS refusal_rate, avg(truncated) AS truncation_rate, avg(listed) AS list_rate, avg(boxed) AS boxed_rate, avg(code) AS code_rate,
   avg(first_person) AS first_person_rate, avg(newlines / greatest(n_char, 1)) AS newline_rate FROM fz GROUP BY 1)"""


def traits(spark, sf):
    return TR.text_traits(
        essays(spark, sf).select(F.col("source").alias("model_id"), F.col("lang").alias("question_id"), "text")
    )


@query(
    "text_traits",
    f"WITH {ESSAYS}, {FLAGS} SELECT model_id, n_answers, {', '.join(f'round({t}, 6) AS {t}' for t in TR.TRAITS)} FROM traits",
)
def text_traits(spark, sf):
    return rounded(traits(spark, sf), *TR.TRAITS)


@query(
    "trait_table",
    f"""WITH {ESSAYS}, {FLAGS}, axis AS (SELECT DISTINCT source AS model_id FROM documents UNION ALL SELECT DISTINCT 'role:' || role FROM conversations),
    wide AS (SELECT a.model_id, (t.model_id IS NOT NULL)::INT AS covered, t.* EXCLUDE (model_id, n_answers) FROM axis a LEFT JOIN traits t USING (model_id))
    SELECT model_id, covered, trait, round(value, 6) AS value FROM wide UNPIVOT INCLUDE NULLS (value FOR trait IN ({', '.join(TR.TRAITS)}))""",
)
def trait_table(spark, sf):
    """Traits gathered onto a model axis that also names models without text."""
    axis = (
        T.table(spark, sf, "documents").select(F.col("source").alias("model_id")).distinct().unionByName(
            T.table(spark, sf, "conversations").select(F.concat(F.lit("role:"), "role").alias("model_id")).distinct()
        )
    )
    return rounded(TR.long_traits(traits(spark, sf), axis), "value")
