"""Strict checks of instruction-following answers, as one boolean expression per response.

An item's gold is JSON with the instruction ids and one argument object per instruction. A
response passes when every instruction holds; ids and arguments are paired up to the shorter
list. Unknown ids fail, and so does the language check, which needs a detector.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.extract import java, strip

# Argument names of the instruction formats.
ARGS = (
    "capital_frequency int, capital_relation string, relation string, num_words int, num_sentences int, "
    "num_paragraphs int, nth_paragraph int, first_word string, keywords array<string>, "
    "forbidden_words array<string>, keyword string, frequency int, letter string, let_relation string, "
    "let_frequency int, num_placeholders int, postscript_marker string, num_bullets int, num_highlights int, "
    "section_spliter string, num_sections int, end_phrase string, prompt_to_repeat string, language string"
)
GOLD = f"instruction_id_list array<string>, kwargs array<struct<{ARGS.replace(' int', ': int').replace(' string', ': string').replace(' array', ': array')}>>"

# Patterns of the formats.
WORD = r"[\p{L}\p{N}_]+"
CAPITAL = r"^\p{L}+$"
SENTENCE_GAP = r"(?<=[.!?])\s+"
DIVIDER = r"\s*\*\*\*\s*"
PLACEHOLDER = r"\[[^\[\]]+\]"
BULLET = r"(?m)^\s*[\*\-]\s+\S"
HIGHLIGHT = r"\*[^\*\n]+\*"
TITLE = r"<<[^\n<>]+>>"
FENCE_ENDS = r"(?i)^```(?:json)?\s*|\s*```\z"
CONSTRAINED = ("My answer is yes.", "My answer is no.", "My answer is maybe.")


def compare(count: Column, relation: Column, target: Column) -> Column:
    """"less than" is strict; anything else means "at least"."""
    return F.when(relation == "less than", count < target).otherwise(count >= target)


def quote(text: Column) -> Column:
    """The text as a literal inside a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def whole_word(text: Column) -> Column:
    return F.concat(F.lit("(?iUd)\\b"), quote(text), F.lit("\\b"))


def non_blank(parts: Column) -> Column:
    return F.filter(parts, lambda p: F.regexp(p, F.lit(java(r"\S"))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_json(text: Column) -> Column:
    body = F.regexp_replace(strip(text), java(FENCE_ENDS), "")
    # The parser stops after one value and ignores what follows; no such rest fits in both brackets.
    wrapped = F.concat(F.lit("["), body, F.lit("]")), F.concat(F.lit('{"a":'), body, F.lit("}"))
    return F.try_parse_json(wrapped[0]).isNotNull() & F.try_parse_json(wrapped[1]).isNotNull()


def stage(df: DataFrame, text: str) -> DataFrame:
    """Adds the forms several checks share; each is computed once per response."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        df.withColumn("__r", t)
        .withColumns({"__s": strip(F.col("__r")), "__low": F.lower("__r"), "__w": words(F.col("__r"))})
        .withColumn("__slow", F.lower("__s"))
    )


def _capitals(kw: Column) -> Column:
    w = F.col("__w")
    hits = F.filter(w, lambda x: F.regexp(x, F.lit(CAPITAL)) & (x == F.upper(x)) & (x != F.lower(x)))
    return compare(F.size(hits), kw["capital_relation"], arg(kw, "capital_frequency", 0))


def _first_word(kw: Column) -> Column:
    paragraphs = non_blank(F.split("__r", "\n\n", -1))
    nth = arg(kw, "nth_paragraph", 1)
    word = F.lower(F.regexp_extract(F.get(paragraphs, nth - 1), WORD, 0))
    enough = F.size(paragraphs) >= F.greatest(nth, F.coalesce(kw["num_paragraphs"], nth))
    return enough & (word != "") & (word == F.lower(arg(kw, "first_word", "")))


def _letters(kw: Column) -> Column:
    """Occurrences of a letter; an empty letter counts one more than the characters, as str.count does."""
    low, letter = F.col("__low"), F.lower(arg(kw, "letter", ""))
    hits = F.when(
        letter != "", (F.length(low) - F.length(F.replace(low, letter, F.lit("")))) / F.greatest(F.length(letter), F.lit(1))
    ).otherwise(F.length(low) + 1)
    return compare(hits, kw["let_relation"], arg(kw, "let_frequency", 0))


def _repeats(kw: Column) -> Column:
    want = F.lower(strip(arg(kw, "prompt_to_repeat", "")))
    return (want != "") & F.startswith(F.col("__slow"), want)


def _section(kw: Column) -> Column:
    pattern = F.concat(F.lit("(?Udm)^\\s*"), quote(arg(kw, "section_spliter", "Section")), F.lit("\\s*\\d+"))
    return F.regexp_count("__r", pattern) >= arg(kw, "num_sections", 0)


def _postscript(kw: Column) -> Column:
    return F.regexp(F.col("__r"), F.concat(F.lit("(?Udim)^\\s*"), quote(arg(kw, "postscript_marker", "P.S."))))


def arg(kw: Column, name: str, default: object) -> Column:
    return F.coalesce(kw[name], F.lit(default))


def _has(k: Column) -> Column:
    return F.regexp(F.col("__r"), whole_word(k))


def _count(pattern: str, text: Column | None = None) -> Column:
    return F.regexp_count(F.col("__r") if text is None else text, F.lit(pattern))


def _r() -> Column:
    return F.col("__r")


#: Instruction id -> expression over the staged response and its arguments.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "punctuation:no_comma": lambda kw: ~F.contains(_r(), F.lit(",")),
    "change_case:english_lowercase": lambda kw: _r() == F.col("__low"),
    "change_case:english_capital": lambda kw: _r() == F.upper("__r"),
    "change_case:capital_word_frequency": _capitals,
    "length_constraints:number_words": lambda kw: compare(F.size("__w"), kw["relation"], arg(kw, "num_words", 0)),
    "length_constraints:number_sentences": lambda kw: compare(
        F.size(non_blank(F.split("__s", java(SENTENCE_GAP), -1))), kw["relation"], arg(kw, "num_sentences", 0)
    ),
    "length_constraints:number_paragraphs": lambda kw: F.size(non_blank(F.split("__r", java(DIVIDER), -1)))
    == arg(kw, "num_paragraphs", 0),
    "length_constraints:nth_paragraph_first_word": _first_word,
    "keywords:existence": lambda kw: F.coalesce(F.forall(kw["keywords"], _has), F.lit(True)),
    "keywords:forbidden_words": lambda kw: ~F.coalesce(F.exists(kw["forbidden_words"], _has), F.lit(False)),
    "keywords:frequency": lambda kw: compare(
        F.regexp_count("__r", whole_word(arg(kw, "keyword", ""))), kw["relation"], arg(kw, "frequency", 0)
    ),
    "keywords:letter_frequency": _letters,
    "detectable_content:number_placeholders": lambda kw: _count(PLACEHOLDER) >= arg(kw, "num_placeholders", 0),
    "detectable_content:postscript": _postscript,
    "detectable_format:number_bullet_lists": lambda kw: _count(java(BULLET)) == arg(kw, "num_bullets", 0),
    "detectable_format:number_highlighted_sections": lambda kw: _count(
        HIGHLIGHT, F.replace("__r", F.lit("**"), F.lit("*"))
    )
    >= arg(kw, "num_highlights", 0),
    "detectable_format:title": lambda kw: F.regexp(_r(), F.lit(TITLE)),
    "detectable_format:multiple_sections": _section,
    "detectable_format:json_format": lambda kw: is_json(_r()),
    "detectable_format:constrained_response": lambda kw: F.exists(
        F.array(*[F.lit(c) for c in CONSTRAINED]), lambda c: F.contains(_r(), c)
    ),
    "startend:quotation": lambda kw: (F.length("__s") >= 2) & F.col("__s").startswith('"') & F.col("__s").endswith('"'),
    "startend:end_checker": lambda kw: F.endswith(F.col("__slow"), F.lower(strip(arg(kw, "end_phrase", "")))),
    "combination:two_responses": lambda kw: F.size(non_blank(F.split("__r", "\\*{6}", -1))) == 2,
    "combination:repeat_prompt": _repeats,
}


def check(iid: str, kw: Column) -> Column:
    """One named check; an unknown id does not hold."""
    return F.coalesce(CHECKS[iid](kw), F.lit(False)) if iid in CHECKS else F.lit(False)


def holds(iid: Column, kw: Column) -> Column:
    """Whether the instruction named by a column holds."""
    out = F.lit(False)
    for name, rule in CHECKS.items():
        out = F.when(iid == name, rule(kw)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def follows_all(df: DataFrame, text: str, gold: str, out: str = "followed") -> DataFrame:
    """Adds the strict prompt-level verdict and the number of instructions that held."""
    parsed = stage(df, text).withColumn("__g", F.from_json(gold, GOLD))
    n = F.least(F.size("__g.instruction_id_list"), F.size("__g.kwargs"))
    pairs = F.slice(F.arrays_zip(F.col("__g.instruction_id_list").alias("iid"), F.col("__g.kwargs").alias("kw")), F.lit(1), n)
    parsed = parsed.withColumn("__ok", F.transform(pairs, lambda p: holds(p["iid"], p["kw"])))
    return parsed.withColumns(
        {
            out: F.forall("__ok", lambda x: x),
            "n_followed": F.size(F.filter("__ok", lambda x: x)),
            "n_instructions": F.size("__ok"),
        }
    ).select(*df.columns, out, "n_followed", "n_instructions")
