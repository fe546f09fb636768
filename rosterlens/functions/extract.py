"""Answer extraction from response text, as column expressions (no Python per row).

Patterns are fixed values, written without engine flags; ``java`` adds the two that make Java
read them as the formats mean them: Unicode classes, and a bare line feed as the only line end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the answer formats.
SPECIAL_TOKEN = r"<\|[^|]+\|>"
THINK_END = r"(?i)</think>"
LATEX_WRAP = r"\\(?:text|mathrm|mathbf|mbox|textbf|textit)\s*\{([^{}]*)\}"
NUMBER = r"-?\d[\d,]*\.?\d*"
FREE_FINAL = r"(?i)(?:the\s+)?final answer is[:\s]*(.+?)(?:\.\s|\n|$)"
FREE_STATED = r"(?i)(?:the\s+)?answer is[:\s]*(.+?)(?:\.\s|\n|$)"
CODE_FENCE = r"(?is)```(?:python|py)?\s*\n(.*?)```"
CODE_OPEN = r"(?is)```(?:python|py)?\s*\n(.*)$"
GSM_BOXED = r"\\boxed\{([^}]*)\}"
GSM_STATED = (
    r"(?i)answer is[:\s]*\$?(-?\d[\d,]*\.?\d*)",
    r"(?i)answer[:\s]*\$?(-?\d[\d,]*\.?\d*)",
    r"(?i)####\s*(-?\d[\d,]*\.?\d*)",
)
MATH_STATED = (
    r"[Tt]he\s+(?:final\s+)?answer\s+is[:\s]*\$?([^$\n]+)\$?",
    r"[Aa]nswer[:\s]*\$?\\?boxed\{([^}]+)\}",
)
GPQA_BOXED = r"\\boxed\{\s*\(?\s*([A-Da-d])\s*\)?\s*[.,]?\s*\}"
GPQA_STATED = (
    r"(?im)answer is[:\s]*\(?([A-Da-d])\)?",
    r"(?im)answer[:\s]*\(?([A-Da-d])\)?",
    r"(?im)\b([A-Da-d])\)\s*$",
    r"(?im)^\(?([A-Da-d])\)?$",
)
GPQA_LAST = r"\b([A-Da-d])\b"
BBH_BOXED = r"\\boxed\{\s*\(?\s*([A-Z])\s*\)?\s*[.,]?\s*\}"
BBH_STATED = (
    r"(?m)answer is[:\s]*\(?\s*([A-Z])\s*\)?",
    r"(?m)answer[:\s]*\(?\s*([A-Z])\s*\)?",
    r"(?m)\(([A-Z])\)\s*$",
    r"(?m)^\(?([A-Z])\)?$",
)
BBH_LAST = r"\(([A-Z])\)"
BBH_FREE = (
    r"(?i)answer is[:\s]*(.+?)(?:\.|\n|$)",
    r"(?i)final answer[:\s]*(.+?)(?:\.|\n|$)",
)


def mcq_patterns(cls: str) -> tuple[str, tuple[str, ...], str]:
    """(boxed, stated forms, last parenthesised) for a letter class. Fixed patterns."""
    return (
        rf"\\boxed\{{\s*\(?\s*({cls})\s*\)?[^}}]*\}}",
        (
            rf"(?im)(?:final\s+)?answer\s+is[:\s]*\**\(?\s*({cls})\s*\)?\b",
            rf"(?im)answer[:\s]*\**\(?\s*({cls})\s*\)?\b",
            rf"(?im)\(({cls})\)\s*$",
            rf"(?im)^\(?({cls})\)?[.\s]*$",
        ),
        rf"\(({cls})\)",
    )


def java(pattern: str) -> str:
    return "(?Ud)" + pattern


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_match(text: Column, pattern: str | Column, group: int = 1) -> Column:
    """First match's group; NULL without a match (no group here can match the empty string)."""
    p = F.lit(java(pattern)) if isinstance(pattern, str) else pattern
    return bind(F.call_function("regexp_extract", text, p, F.lit(group)), lambda x: F.when(x != "", x))


def last_match(text: Column, pattern: str | Column, group: int) -> Column:
    p = F.lit(java(pattern)) if isinstance(pattern, str) else pattern
    return F.try_element_at(F.regexp_extract_all(text, p, F.lit(group)), F.lit(-1))


#: Every character that counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim all leading and trailing whitespace, line breaks included."""
    return F.btrim(text, F.lit(WHITESPACE))


def _where(text: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` where the text holds ``mark``; a plain search spares the others the pattern."""
    return bind(text, lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t))


def strip_special_tokens(text: Column) -> Column:
    return strip(_where(text, "<|", lambda t: F.regexp_replace(t, SPECIAL_TOKEN, "")))


def after_think(text: Column) -> Column:
    """The part after the last think marker, or the whole text when that part is blank."""
    def tail(t: Column) -> Column:
        last = F.try_element_at(F.split(t, THINK_END, -1), F.lit(-1))
        return bind(last, lambda x: F.when(strip(x) == "", t).otherwise(x))

    return _where(text, "</", tail)


def unwrap_latex(text: Column) -> Column:
    """Peels up to three layers of text-style wrappers."""
    def peel(t: Column) -> Column:
        for _ in range(3):
            t = F.regexp_replace(t, java(LATEX_WRAP), "$1")
        return t

    return _where(text, "\\", peel)


@dataclass(frozen=True)
class Text:
    """A response in the forms the extractors read; every form is its own column, computed once."""

    raw: Column
    trimmed: Column
    unwrapped: Column
    unwrapped_trimmed: Column
    boxed: Column


def stage(df: DataFrame, text: Column, prefix: str, like: Text | None = None) -> tuple[DataFrame, Text]:
    """Adds the forms of ``text`` to ``df`` as ``<prefix>_*`` columns.

    Where the text equals ``like``'s text its forms are taken over.
    """
    p, raw = prefix, F.col(f"{prefix}_raw")

    def form(new: Column, old: Column | None) -> Column:
        return new if like is None else F.when(raw == like.raw, old).otherwise(new)

    out = (
        df.withColumn(f"{p}_raw", F.coalesce(text, F.lit("")))
        .withColumns(
            {
                f"{p}_trim": form(strip(raw), like and like.trimmed),
                f"{p}_unw": form(unwrap_latex(raw), like and like.unwrapped),
                f"{p}_box": form(boxed(raw), like and like.boxed),
            }
        )
        .withColumn(f"{p}_unwt", form(strip(F.col(f"{p}_unw")), like and like.unwrapped_trimmed))
    )
    return out, Text(*[F.col(f"{p}_{x}") for x in ("raw", "trim", "unw", "unwt", "box")])


def last_number(text: Column) -> Column:
    return last_match(F.replace(text, F.lit(","), F.lit("")), NUMBER, 0)


def boxed(text: Column) -> Column:
    """Contents of the last boxed group, its braces balanced.

    The tail from the first brace after the marker is cut at closing braces; the first cut whose
    opening and closing braces are equal in number ends the group.
    """
    after = F.substring_index(text, "\\boxed", -1)
    body = F.when(
        F.contains(text, F.lit("\\boxed")) & F.contains(after, F.lit("{")),
        F.substr(after, F.locate("{", after) + 1),
    )
    pieces = F.split(body, "\\}", -1)
    opened = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))
    # depth after the i-th closing brace is 1 + opened so far - i; the group ends where it is 0
    end = F.aggregate(
        opened,
        F.struct(F.lit(1).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end")),
        lambda s, o: F.struct(
            (s["depth"] + o - 1).alias("depth"),
            (s["i"] + 1).alias("i"),
            F.when((s["end"] == 0) & (s["depth"] + o - 1 == 0), s["i"] + 1).otherwise(s["end"]).alias("end"),
        ),
        lambda s: s["end"],
    )
    closed = (end > 0) & (end < F.size(pieces))
    return F.when(closed, F.array_join(F.slice(pieces, 1, F.greatest(end, F.lit(1))), "}"))


def last_line(t: Text) -> Column:
    lines = F.filter(
        F.split(t.trimmed, "\\r\\n|[\\n\\x0b\\f\\r\\x1c-\\x1e\\u0085\\u2028\\u2029]", -1),
        lambda s: F.regexp(s, F.lit(java(r"\S"))),
    )
    return F.try_element_at(lines, F.lit(-1))


def mcq(t: Text, n_choices: Column | int = 26) -> Column:
    """Option letter: boxed, stated, trailing, alone on a line, then the last parenthesised one."""
    n = n_choices if isinstance(n_choices, Column) else F.lit(n_choices)
    n = F.greatest(F.lit(1), F.least(n, F.lit(26))).cast("int")
    cls = F.concat(F.lit("[A-"), F.char(n + 64), F.lit("a-"), F.char(n + 96), F.lit("]"))
    head, stated, last = mcq_patterns("@")

    def bind(pattern: str) -> Column:
        return F.replace(F.lit(java(pattern)), F.lit("@"), cls)

    tried = [
        first_match(t.unwrapped, bind(head)),
        *[first_match(t.unwrapped_trimmed, bind(p)) for p in stated],
        last_match(t.unwrapped, bind(last), 1),
    ]
    return F.upper(F.coalesce(*tried))


def free(t: Text) -> Column:
    """Final answer: boxed, stated, else the last non-empty line."""
    return F.coalesce(t.boxed, first_match(t.raw, FREE_FINAL), first_match(t.raw, FREE_STATED), last_line(t))


def code(t: Text, tail: Text) -> Column:
    """Last fenced block, after the think marker first; an unterminated fence, empty or not; else the text."""
    opened = F.when(F.rlike(t.raw, F.lit(java(CODE_OPEN))), F.coalesce(first_match(t.raw, CODE_OPEN), F.lit("")))
    return F.coalesce(last_match(tail.raw, CODE_FENCE, 1), last_match(t.raw, CODE_FENCE, 1), opened, t.raw)


def think_first(extract: Callable[[Text], Column], t: Text, tail: Text) -> Column:
    """The extractor on the part after the think marker, then on the whole text."""
    return F.coalesce(extract(tail), extract(t))


def gsm8k(t: Text) -> Column:
    in_box = last_number(first_match(t.raw, GSM_BOXED))
    stated = [F.replace(first_match(t.raw, p), F.lit(","), F.lit("")) for p in GSM_STATED]
    return F.coalesce(in_box, *stated, last_number(t.raw))


def math(t: Text) -> Column:
    return F.coalesce(t.boxed, *[strip(first_match(t.raw, p)) for p in MATH_STATED], last_number(t.raw))


def gpqa(t: Text) -> Column:
    stated = [first_match(t.unwrapped_trimmed, p) for p in GPQA_STATED]
    return F.upper(F.coalesce(first_match(t.unwrapped, GPQA_BOXED), *stated, last_match(t.unwrapped, GPQA_LAST, 1)))


def bbh_letter(t: Text) -> Column:
    stated = [first_match(t.unwrapped_trimmed, p) for p in BBH_STATED]
    return F.upper(F.coalesce(first_match(t.unwrapped, BBH_BOXED), *stated, last_match(t.unwrapped, BBH_LAST, 1)))


def bbh_free(t: Text) -> Column:
    stated = [first_match(t.raw, p) for p in BBH_FREE]
    return F.coalesce(t.boxed, *stated, last_line(t), t.raw)
