"""Roles of chat transcripts by a hidden Markov model over their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.merkle import numbered
from rosterlens.session import staged

#: Roles; each is two states: the first line of a turn (2 * i) and a further one (2 * i + 1).
ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)
#: How transcripts name their speakers, as patterns of a line's start.
MARKERS = (
    ("system", re.compile(r"\s*(?:#+\s*)?(?:<\|)?(?:system|context)(?:\|>|\s*:)\s*", re.I)),
    ("user", re.compile(r"\s*(?:#+\s*)?(?:<\|)?(?:user|human|question|q|instruction)(?:\|>|\s*:)\s*", re.I)),
    ("assistant", re.compile(r"\s*(?:#+\s*)?(?:<\|)?(?:assistant|ai|bot|answer|a|response)(?:\|>|\s*:)\s*", re.I)),
)
#: Values of a line's features: marker, length, question, the line before is blank, first character.
FEATURES = (5, 6, 2, 3, 4)
#: Where a transcript is shared out over tasks, a task's piece of one has at most this many lines.
PIECE = 20_000
#: Turns that are looked up together when a fit reads the turn before.
BLOCK = 64


def marker(line: str) -> tuple[int, str]:
    """1, 2, 3 for a marker of that role, 4 for a blank line, 0 for none; and the line without it."""
    for i, (_, pattern) in enumerate(MARKERS):
        if found := pattern.match(line):
            return i + 1, line[found.end() :]
    return (0 if line.strip() else 4), line


def observed(line: str, before: str | None) -> tuple[int, ...]:
    kind, rest = marker(line)
    rest = rest.strip()
    first = 0 if not rest else 1 if rest[0].isupper() else 2 if rest[0].islower() else 3
    size = min(5, (len(rest) + 39).bit_length() - 5) if rest else 0
    return kind, size, int(rest.endswith("?")), 2 if before is None else int(not before.strip()), first


@dataclass
class Model:
    """Log probabilities; ``emit`` has a table for each feature."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    @classmethod
    def fitted(cls, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> Model:
        """From counts, with one added to each that can be."""
        ok = np.ones((STATES, STATES), bool)
        for s in range(STATES):
            ok[s, 1::2] = False  # a further line follows its own turn only
            ok[s, s | 1] = True
        first = np.arange(STATES) % 2 == 0
        with np.errstate(divide="ignore"):
            return cls(
                np.log(np.where(first, start + 1, 0) / (start[first] + 1).sum()),
                np.log(np.where(ok, move + 1, 0) / np.where(ok, move + 1, 0).sum(axis=1, keepdims=True)),
                [np.log((e + 1) / (e + 1).sum(axis=1, keepdims=True)) for e in emit],
            )

    def emissions(self, seen: np.ndarray) -> np.ndarray:
        return sum(table[:, seen[:, f]].T for f, table in enumerate(self.emit))


def best_path(model: Model, seen: np.ndarray) -> np.ndarray:
    """Viterbi over a whole transcript."""
    emit = model.emissions(seen)
    score, back = model.start + emit[0], np.zeros((len(emit), STATES), np.int8)
    for i in range(1, len(emit)):
        all_ways = score[:, None] + model.move
        back[i] = all_ways.argmax(axis=0)
        score = all_ways.max(axis=0) + emit[i]
    path = np.empty(len(emit), np.uint8)
    path[-1] = score.argmax()
    for i in range(len(emit) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def piece_paths(model: Model, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a piece of a transcript: the score and the path for each state of its first and its last line."""
    emit = model.emissions(seen)
    score = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(score, emit[0])
    back = np.zeros((len(emit), STATES, STATES), np.int8)
    for i in range(1, len(emit)):
        all_ways = score[:, :, None] + model.move[None]
        back[i] = all_ways.argmax(axis=1)
        score = all_ways.max(axis=1) + emit[i][None]
    paths = np.empty((STATES, STATES, len(emit)), np.uint8)
    entry = np.arange(STATES)[:, None]
    at = np.broadcast_to(np.arange(STATES), (STATES, STATES))
    for i in range(len(emit) - 1, -1, -1):
        paths[:, :, i] = at
        if i:
            at = back[i][entry, at]
    return score, paths


def chosen(model: Model, scores: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last state of each of a transcript's pieces, given their scores in order."""
    total, backs = model.start[:, None] + scores[0], []
    ways = [total.argmax(axis=0)]
    best = total.max(axis=0)
    for score in scores[1:]:
        enter = best[:, None] + model.move
        backs.append(enter.argmax(axis=0))
        total = enter.max(axis=0)[:, None] + score
        ways.append(total.argmax(axis=0))
        best = total.max(axis=0)
    out, last = [], int(best.argmax())
    for i in range(len(scores) - 1, -1, -1):
        first = int(ways[i][last])
        out.append((first, last))
        if i:
            last = int(backs[i - 1][first])
    return out[::-1]


def fit(lines: DataFrame) -> Model:
    """Counts over all of ``lines(role, line, before, before_state, first)``, in Spark.

    Lines without a known role teach nothing. What comes to the driver is a count for each pair of states
    and each state and feature value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["role"] not in ROLES:
                    continue
                state = 2 * ROLES.index(row["role"]) + (not row["first"])
                keys = [(f + 2, state, v) for f, v in enumerate(observed(row["line"], row["before"]))]
                if row["before"] is None:
                    keys.append((0, state, 0))
                elif row["before_state"] is not None:
                    keys.append((1, row["before_state"], state))
                for key in keys:
                    counts[key] = counts.get(key, 0) + 1
        rows = [(*k, n) for k, n in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "a", "b", "n"])

    rows = lines.select("role", "line", "before", "before_state", "first").mapInArrow(run, "kind long, a long, b long, n long")
    start, move = np.zeros(STATES), np.zeros((STATES, STATES))
    emit = [np.zeros((STATES, n)) for n in FEATURES]
    for r in rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        if r.kind == 0:
            start[r.a] += r.n
        elif r.kind == 1:
            move[r.a, r.b] += r.n
        else:
            emit[r.kind - 2][r.a, r.b] += r.n
    return Model.fitted(start, move, emit)


def held_out(conv_id: str) -> Column:
    """Whether a conversation is left out of the fit: a quarter, by the crc32 of its id."""
    return F.coalesce(F.pmod(F.crc32(F.col(conv_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_lines(turns: DataFrame) -> DataFrame:
    """Lines of ``turns(conv_id, turn, tie, role, text)`` with what stands before each, for ``fit``.

    Turns are numbered within their conversation, so that the turn before is the one numbered one less, whatever gaps the
    given numbers have. Within blocks of 64 it is looked up in the block; a block's first turn is joined with the last one
    of the block before. So every turn teaches, and no transcript is gathered.
    """
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1, F.lit(None))
    lined = turns.select(F.col("conv_id").alias("tree"), "turn", "tie", "role", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lined = numbered(lined, ["turn", "tie"]).withColumn("code", code)
    lined = lined.withColumn("end_state", F.when(F.col("code") >= 0, 2 * F.col("code") + F.when(F.size("lines") > 1, 1).otherwise(0)))
    end = F.struct(F.element_at("lines", -1).alias("line"), "end_state")
    by = Window.partitionBy("tree", F.expr(f"at div {BLOCK}")).orderBy("at")
    ends = lined.where(F.pmod("at", F.lit(BLOCK)) == BLOCK - 1).select(F.col("tree").alias("of"), (F.col("at") + 1).alias("next"), end.alias("past"))
    near = lined.withColumn("held", F.lag(end).over(by))
    met = near.join(ends, F.col("tree").eqNullSafe(F.col("of")) & (F.col("at") == F.col("next")), "left").withColumn("held", F.coalesce("held", "past"))
    each = met.select("role", "lines", "held", "code", F.posexplode("lines").alias("i", "line"))
    inside = F.col("i") > 0
    return each.select(
        "role",
        "line",
        F.when(inside, F.get("lines", F.col("i") - 1)).otherwise(F.col("held.line")).alias("before"),
        F.when(inside, 2 * F.col("code") + F.when(F.col("i") > 1, 1).otherwise(0)).otherwise(F.col("held.end_state")).cast("int").alias("before_state"),
        (F.col("i") == 0).alias("first"),
    )


def _decode(model: Model, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        conv, lines, part, opened = None, [], 0, False
        before: str | None = None  # the line before ``lines``, None at a task's beginning
        begun = False  # whether the transcript's beginning was seen in this task

        def row(last: bool):
            nonlocal lines, part, before
            seen = np.array([observed(x, y) for x, y in zip(lines, [before, *lines[:-1]], strict=True)])
            whole = begun and last and part == 0
            if whole:
                paths, scores = best_path(model, seen).tobytes(), None
            else:
                table, way = piece_paths(model, seen)
                paths, scores = way.tobytes(), table.reshape(-1).tolist()
            out = pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "task": task, "part": part, "lines": lines, "paths": paths, "scores": scores}], schema=_PIECES
            )
            part, before, lines = part + 1, lines[-1], []
            return out

        for batch in batches:
            ids, texts, places = (batch.column(c).to_pylist() for c in ("conv_id", "text", "place"))
            for conv_id, text, place in zip(ids, texts, places, strict=True):
                if not opened or conv_id != conv:
                    if lines:
                        yield row(opened and begun)
                    begun = opened  # the first of a task may go on from the task before
                    conv, part, before, opened = conv_id, 0, None, True
                for line in (text or "").split("\n"):
                    lines.append(line)
                    if len(lines) >= piece:
                        yield row(False)
        if lines:
            yield row(False)

    return run


_PIECES = pa.schema(
    [
        ("conv_id", pa.int64()), ("task", pa.int32()), ("part", pa.int32()), ("lines", pa.list_(pa.string())),
        ("paths", pa.binary()), ("scores", pa.list_(pa.float64())),
    ]
)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns and parts of turns in each piece; ``step`` counts the turns begun in it."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            path = np.frombuffer(r["paths"], np.uint8)
            if r["first"] is not None:
                path = path.reshape(STATES, STATES, -1)[r["first"], r["last"]]
            edges = sorted({0, *np.flatnonzero(path % 2 == 0).tolist()})
            step = 0
            for a, b in zip(edges, [*edges[1:], len(path)], strict=True):
                step += int(path[a] % 2 == 0)
                kind, rest = marker(r["lines"][a]) if path[a] % 2 == 0 else (0, r["lines"][a])
                text = "\n".join([rest, *r["lines"][a + 1 : b]])
                out.append((r["conv_id"], r["task"], r["part"], step, ROLES[path[a] // 2], text, int(path[a] % 2 == 0)))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
            ["conv_id", "task", "part", "step", "role", "text", "begins"],
        )


def parsed(transcript: DataFrame, model: Model, piece: int = PIECE) -> DataFrame:
    """(conv_id, turn_no, role, text, rendered) of every turn found in ``transcript(conv_id, turn, tie, text)``.

    The rows of a transcript, in the order of turn and tie, are its text; their breaks say nothing about turns.
    Rows are laid out by range, so a very long transcript is shared out over tasks. A transcript that
    lies within one task is decoded there. Of the others, each piece is decoded for every pair of states
    at its ends; what meets by transcript are those few scores, from which the exact best path
    follows. ``rendered`` is the turn in canonical form. Null texts are blank lines; rows without conv_id are
    one transcript. Equal rows follow each other. An empty table gives no turns.
    """
    ranges = max(1, transcript.rdd.getNumPartitions())
    rows = (
        transcript.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "tie", F.col("text").cast("string").alias("text")
        )
        .repartitionByRange(ranges, "conv_id", "turn", "tie")
        .sortWithinPartitions("conv_id", "turn", "tie")
        .select("conv_id", "text", F.lit(0).alias("place"))
    )
    pieces = staged(
        rows.mapInArrow(
            _decode(model, piece), "conv_id long, task int, part int, lines array<string>, paths binary, scores array<double>"
        )
    )

    def choose(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda i: (table.column("task")[i].as_py(), table.column("part")[i].as_py()))
        table = table.take(order)
        scores = [np.array(x).reshape(STATES, STATES) for x in table.column("scores").to_pylist()]
        ends = chosen(model, scores)
        for i, (name, k) in enumerate((("first", 0), ("last", 1))):
            table = table.append_column(name, pa.array([e[k] for e in ends], pa.int32()))
        return table.select(["conv_id", "task", "part", "first", "last"])

    ends = (
        pieces.where("scores is not null")
        .select("conv_id", "task", "part", "scores")
        .groupBy("conv_id")
        .applyInArrow(choose, "conv_id long, task int, part int, first int, last int")
    )
    same = pieces["conv_id"].eqNullSafe(ends["conv_id"]) & (pieces["task"] == ends["task"]) & (pieces["part"] == ends["part"])
    fragments = (
        pieces.join(ends, same, "left")
        .select(pieces["conv_id"], pieces["task"], pieces["part"], "lines", "paths", "first", "last")
        .mapInArrow(_turns, "conv_id long, task int, part int, step long, role string, text string, begins int")
    )
    fragments = staged(fragments)
    before = Window.partitionBy("conv_id").orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        fragments.groupBy("conv_id", "task", "part")
        .agg(F.sum("begins").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(F.col("conv_id").alias("c"), F.col("task").alias("t"), F.col("part").alias("p"), "base")
    )
    return (
        fragments.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("t")) & (F.col("part") == F.col("p")))
        .groupBy("conv_id", (F.col("base") + F.col("step") - 1).alias("turn_no"))
        .agg(F.sort_array(F.collect_list(F.struct("task", "part", "step", "role", "text"))).alias("parts"))
        .select(
            "conv_id",
            "turn_no",
            F.col("parts")[0]["role"].alias("role"),
            F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), r"^\s+|\s+$", "").alias("text"),
        )
        .withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))
    )


def as_transcript(turns: DataFrame, bare: int = 8) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with tie, and text as raw transcripts have it.

    A transcript names its speakers in one of four ways, by a hash of conv_id; about one turn in ``bare`` has no
    marker, only a blank line before it.
    """
    style = F.pmod(F.xxhash64("conv_id", F.lit("style")), F.lit(4))
    names = (("System: ", "User: ", "Assistant: "), ("Context: ", "Human: ", "AI: "), ("### System:\n", "### Instruction:\n", "### Response:\n"), ("<|system|>", "<|user|>", "<|assistant|>"))

    def named(role: int) -> Column:
        out = F.lit(names[3][role])
        for i in range(3):
            out = F.when(style == i, F.lit(names[i][role])).otherwise(out)
        return out

    mark = F.when(F.col("role") == "system", named(0)).when(F.col("role") == "user", named(1)).when(F.col("role") == "assistant", named(2))
    silent = F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(bare)) == 0
    text = F.coalesce("text", F.lit(""))
    return turns.select(
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("tie"),
        "role",
        F.when(silent | mark.isNull(), F.concat(F.lit("\n"), text)).otherwise(F.concat(mark, text)).alias("text"),
    )
