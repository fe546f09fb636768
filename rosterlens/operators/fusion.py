"""Fusion of the bits, question-text and answer-text channels, fitted for all folds of a plan at once.

A run is one fold of a plan: it is fitted on the models outside the fold, and the fold's models are placed by
what they answered. What all runs need is gathered in passes whose number does not grow with the folds. Sums of the bits
and of answer text are kept per fold, so a run's fit is the total less its own fold. Question text stands in
model space relative to each run's question means, so it is carried as one block for each run.

Cells are packed once into tiles: some models of one fold by some questions. A product of cells with vectors meets tile by tile
with the vectors of the tile's models or questions, as matrices; what is moved and added up afterwards is one vector for each tile and
model or question, not one for each cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.operators.banks import sum_vectors
from rosterlens.operators.embed import SD_FLOOR, block_widths
from rosterlens.session import staged

#: The channels in block order.
CHANNELS = ("bits", "qtext", "anstext")
#: Codes of a fold plan: always on the training side, in no run.
ALWAYS, NEVER = -1, -2
#: Strength of the ridge that places a model from its cells. Fixed value.
RIDGE = 0.01
#: A squared singular value up to this share of the largest is noise of the sums.
RANK_SHARE = 1e-12
#: What a tile is known by, how many models and questions it holds on average at most, and values a cell with as many models. Fixed values.
TILE, TILE_MODELS, TILE_QUESTIONS, TILE_VALUES = ("fold", "mb", "qb"), 1024, 4096, 16


def checked(channels: Sequence[str]) -> tuple[str, ...]:
    """``channels`` as a tuple, which must be at least two distinct ones in block order."""
    out = tuple(channels)
    if len(out) < 2 or out != tuple(c for c in CHANNELS if c in out):
        raise ValueError(f"channels {out} must be two or more of {CHANNELS}, in that order")
    return out


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def _listed(values: pa.Array | np.ndarray, n: int) -> pa.ListArray:
    """``values`` as ``n`` lists of one length."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    width = len(values) // n if n else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)


def in_plan(cells: DataFrame, plan: DataFrame, value: str = "correct") -> DataFrame:
    """(model_id, question_id, fold, v array of the one value): the cells of a plan's models."""
    rows = cells.where(F.col("question_id").isNotNull()).join(plan.where(F.col("fold") != NEVER).select("model_id", "fold"), "model_id")
    return rows.select("model_id", "question_id", F.col("fold").cast("int").alias("fold"), F.array(F.col(value).cast("double")).alias("v"))


def tiled(cells: DataFrame) -> DataFrame:
    """(fold, mb, qb, models, questions, m, q, v): cells(model_id, question_id, fold, v array of one length) as tiles.

    One row for each tile: its models and questions, and by cell the places in them and the values, flat. Where a cell has many
    values, a tile has fewer models.
    """
    distinct = [F.approx_count_distinct(f"{c}_id").alias(c[0]) for c in ("model", "question")]
    sizes = cells.groupBy("fold").agg(*distinct, F.max(F.size("v")).alias("k")).collect()
    most = max(1, min([TILE_MODELS * TILE_VALUES // max(r["k"], TILE_VALUES) for r in sizes] or [1]))
    mb, qb = (max([-(-r[c] // n) for r in sizes] or [1]) for c, n in (("m", most), ("q", TILE_QUESTIONS)))
    kinds = dict(cells.dtypes)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        models, questions = (t[c].combine_chunks().dictionary_encode() for c in ("model_id", "question_id"))
        m, q = (x.indices.to_numpy(zero_copy_only=False).astype(np.int32) for x in (models, questions))
        order = np.lexsort((m, q))
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
        return Tile(tuple(k.as_py() for k in key), models.dictionary, questions.dictionary, m[order], q[order]).packed(v[order])

    schema = f"fold int, mb int, qb int, models array<{kinds['model_id']}>, questions array<{kinds['question_id']}>, m array<int>, q array<int>, v array<double>"
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = cells.select("model_id", "question_id", F.col("fold").cast("int").alias("fold"), "v")
    return rows.withColumn("mb", bucket("model_id", mb)).withColumn("qb", bucket("question_id", qb)).groupBy(*TILE).applyInArrow(pack, schema)


@dataclass
class Tile:
    """A tile inside a task."""

    key: tuple[int, int, int]
    models: pa.Array
    questions: pa.Array
    m: np.ndarray
    q: np.ndarray
    v: np.ndarray | None = None  # (cells, values)

    @classmethod
    def of(cls, row: pa.Table) -> Tile:
        lists = {c: row[c].combine_chunks().flatten() for c in ("models", "questions", "m", "q", "v")}
        m, q, v = (lists[c].to_numpy(zero_copy_only=False) for c in ("m", "q", "v"))
        key = tuple(row[c][0].as_py() for c in TILE)
        return cls(key, lists["models"], lists["questions"], m, q, v.reshape(len(m), -1) if len(m) else np.zeros((0, 1)))

    def packed(self, v: np.ndarray) -> pa.Table:
        """The tile as its row, with values ``v``."""
        lists = {"models": self.models, "questions": self.questions, "m": self.m, "q": self.q, "v": np.ascontiguousarray(v).ravel()}
        return pa.table({c: pa.array([k], pa.int32()) for c, k in zip(TILE, self.key, strict=True)} | {c: _listed(x, 1) for c, x in lists.items()})

    def dense(self, v: np.ndarray | None = None) -> np.ndarray:
        """The tile as a matrix of models by questions; ones where no values are given."""
        shape = len(self.models), len(self.questions)
        return np.bincount(self.m.astype(np.int64) * shape[1] + self.q, v, shape[0] * shape[1]).reshape(shape).astype(float)


def meet(tiles: DataFrame, side: str, vectors: DataFrame, length: int, fn: Callable[[Tile, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """fn(tile, x) for every tile, with x the rows of ``vectors(id, x)`` of the tile's models or questions (``side``).

    One that has no vector is a row of zeros; a null entry is NaN.
    """
    name = {"models": "model_id", "questions": "question_id"}[side]
    places = tiles.select(*TILE, F.posexplode(side).alias("i", name))
    own = places.join(vectors.select(name, F.col("x").cast("array<double>").alias("x")), name).select(*[F.col(c).alias(f"at_{c}") for c in TILE], "i", "x")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tile = Tile.of(left)
        x = np.zeros((len(getattr(tile, side)), length))
        if right.num_rows:
            x[right["i"].to_numpy()] = right["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        return fn(tile, x)

    return tiles.groupBy(*TILE).cogroup(own.groupBy(*[f"at_{c}" for c in TILE])).applyInArrow(run, schema)


def _kind(tiles: DataFrame, side: str) -> str:
    return tiles.schema[side].dataType.elementType.simpleString()


def fold_sums(cells: DataFrame, plan: DataFrame, text: DataFrame | None, width: int, value: str = "correct") -> DataFrame:
    """(question_id, fold, total): sums over a fold's models.

    total = [n, sum a, sum a^2, n with text, sum a with text, sum a * text, sum text].
    """
    rows = in_plan(cells, plan, value)
    if text is not None:
        return tile_sums(staged(tiled(staged(rows))), text, width)
    return plain_sums(rows)


def plain_sums(rows: DataFrame) -> DataFrame:
    """``fold_sums`` without text."""
    a = F.col("v")[0]
    sums = rows.groupBy("question_id", "fold").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(a).alias("a"), F.sum(a * a).alias("aa"))
    return sums.select("question_id", "fold", F.array("n", "a", "aa", F.lit(0.0), F.lit(0.0)).alias("total"))


def tile_sums(tiles: DataFrame, text: DataFrame, width: int) -> DataFrame:
    """``fold_sums`` of tiles of one value."""

    def sums(tile: Tile, x: np.ndarray) -> pa.Table:
        a = tile.v[:, 0]
        ones, by = tile.dense().T, tile.dense(a).T
        has, t = x[:, :1], x[:, 1:]
        out = np.hstack([ones.sum(1, keepdims=True), by.sum(1, keepdims=True), tile.dense(a * a).sum(0)[:, None], ones @ has, by @ has, by @ t, ones @ t])
        n = len(tile.questions)
        return pa.table({"question_id": tile.questions, "fold": pa.array([tile.key[0]] * n, pa.int32()), "total": _listed(out.ravel(), n)})

    x = F.concat(F.array(F.lit(1.0)), F.transform("emb", lambda e: e.cast("double")))
    vectors = text.where(F.col("emb").isNotNull()).select("model_id", x.alias("x"))
    parts = meet(tiles, "models", vectors, 1 + width, sums, f"question_id {_kind(tiles, 'questions')}, fold int, total array<double>")
    return sum_vectors(parts, ["question_id", "fold"], "total").select("question_id", "fold", "total")


def run_sums(sums: DataFrame, folds: int) -> DataFrame:
    """(question_id, run, total): for each run the sums of all folds less its own."""
    # a question has one row a fold; their plain sum keeps counts whole, which a mean times a weight would not
    add = lambda x, y: x + y
    parts = sums.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("fold", "total"))).alias("own"))
    every = F.aggregate(F.slice("own", F.lit(2), F.size("own")), F.col("own")[0]["total"], lambda acc, x: F.zip_with(acc, x["total"], add))
    runs = parts.select("question_id", every.alias("all"), F.map_from_entries("own").alias("own"))
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    left = F.try_element_at("own", F.col("run"))
    return runs.select(
        "question_id", "run", F.when(left.isNull(), F.col("all")).otherwise(F.zip_with("all", F.transform(left, lambda x: -x), add)).alias("total")
    )


def keyed_matrices(df: DataFrame, key: str, left: str, right: str | None = None) -> dict[int, np.ndarray]:
    """Per value of ``key`` the sum of outer(left, right) over its rows; widths and keys are few."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for p in batches:
            for k, g in p.groupby(key):
                x = np.stack(g[left].to_list())
                y = x if right is None else np.stack(g[right].to_list())
                acc[k] = acc[k] + x.T @ y if k in acc else x.T @ y
        for k, m in acc.items():
            yield pd.DataFrame({"k": k, "r": np.arange(len(m)), "v": list(m)})

    cols = [key, left] if right is None else [key, left, right]
    schema = "k int, r int, v array<double>"
    out: dict[int, list] = {}
    rows = sum_vectors(df.select(*cols).mapInPandas(partial, schema), ["k", "r"], "v").select("k", "r", F.col("total").alias("v")).collect()
    for r in sorted(rows, key=lambda r: (r["k"], r["r"])):
        out.setdefault(r["k"], []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


@dataclass
class Gathered:
    """All that fits of any subset of channels read; tables staged, matrices by run on the driver.

    tiles: cells as tiles, by run the bit less the run's question mean.
    models(model_id, fold, q array of blocks by run, t, k): each model's text blocks and how many cells it has.
    cross(run, question_id, vec): bits against question text, then answer text.
    """

    folds: int
    widths: dict[str, int]
    tiles: DataFrame
    models: DataFrame
    cross: DataFrame
    norms: dict[int, dict[str, float]]  # squared Frobenius norms of the centred training blocks
    means: dict[int, dict[str, np.ndarray]]
    small: dict[int, np.ndarray]  # question text against answer text, centred
    grams: dict[int, np.ndarray]  # cross.T @ cross


def centred(tiles: DataFrame, sums: DataFrame, folds: int) -> DataFrame:
    """Tiles with a value for every run: the bit less the mean of the run's training side, 0 where that has none."""
    mean = F.when(F.col("total")[0] > 0, F.col("total")[1] / F.col("total")[0])
    means = sums.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", mean.alias("mu")))), lambda x: x["mu"]).alias("x"))

    def less(tile: Tile, mu: np.ndarray) -> np.ndarray:
        v = tile.v - mu[tile.q]
        return np.where(np.isnan(v), 0.0, v)

    return meet(tiles, "questions", means, folds, lambda tile, mu: tile.packed(less(tile, mu)), tiles.schema)


def kept(tiles: DataFrame, keep: DataFrame) -> DataFrame:
    """Tiles without the cells of questions that ``keep(question_id)`` lacks."""

    def drop(tile: Tile, x: np.ndarray) -> pa.Table:
        stay = x[tile.q, 0] > 0
        at = np.cumsum(x[:, 0] > 0) - 1
        return replace(tile, questions=tile.questions.filter(pa.array(x[:, 0] > 0)), m=tile.m[stay], q=at[tile.q[stay]].astype(np.int32)).packed(tile.v[stay])

    return meet(tiles, "questions", keep.select("question_id", F.array(F.lit(1.0)).alias("x")), 1, drop, tiles.schema)


def by_run(total: str, folds: int, width: int) -> Column:
    """A flat sum cut into one block for each run."""
    return F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.slice(total, f * width + 1, F.lit(width)))


def _product(tile: Tile, x: np.ndarray, folds: int, width: int, to: str, train: bool = False) -> np.ndarray:
    """(rows, folds * width): by run the tile times its questions' blocks, or its transpose times its models'.

    ``x`` has one block for each run, or one for all. With ``train``, a run's own models count nothing.
    """
    x = x.reshape(len(x), -1, width)
    out = np.zeros((len(tile.models if to == "models" else tile.questions), folds, width))
    for run in range(folds):
        if not (train and run == tile.key[0]):
            a = tile.dense(tile.v[:, run])
            out[:, run] = (a if to == "models" else a.T) @ x[:, min(run, x.shape[1] - 1)]
    return out.reshape(len(out), -1)


def to_models(tiles: DataFrame, vectors: DataFrame, folds: int, width: int, train: bool = False, blocks: int | None = None) -> DataFrame:
    """(model_id, blocks): per run the sum over a model's cells of v * block; ``vectors(question_id, blocks)``.

    There is a block for each run, or one for all (``blocks`` is 1). With ``train``, a run's own models stand at 0.
    """

    def times(tile: Tile, x: np.ndarray) -> pa.Table:
        return pa.table({"model_id": tile.models, "total": _listed(_product(tile, x, folds, width, "models", train).ravel(), len(tile.models))})

    parts = meet(tiles, "questions", vectors.select("question_id", F.flatten("blocks").alias("x")), (blocks or folds) * width, times, f"model_id {_kind(tiles, 'models')}, total array<double>")
    return sum_vectors(parts, ["model_id"], "total").select("model_id", by_run("total", folds, width).alias("blocks"))


def to_questions(tiles: DataFrame, blocks: DataFrame, folds: int, width: int) -> DataFrame:
    """(question_id, blocks): per run the sum over its training models of v * block; ``blocks(model_id, blocks)``."""

    def times(tile: Tile, x: np.ndarray) -> pa.Table:
        return pa.table({"question_id": tile.questions, "total": _listed(_product(tile, x, folds, width, "questions", True).ravel(), len(tile.questions))})

    parts = meet(tiles, "models", blocks.select("model_id", F.flatten("blocks").alias("x")), folds * width, times, f"question_id {_kind(tiles, 'questions')}, total array<double>")
    return sum_vectors(parts, ["question_id"], "total").select("question_id", by_run("total", folds, width).alias("blocks"))


def squares(tiles: DataFrame, folds: int) -> DataFrame:
    """(question_id, total): per run the sum over its training models of v * v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in (pa.Table.from_batches([b.slice(i, 1)]) for i in range(b.num_rows)):
                tile = Tile.of(t)
                out = np.zeros((len(tile.questions), folds))
                for f in range(folds):
                    if f != tile.key[0]:
                        out[:, f] = np.bincount(tile.q, tile.v[:, f] ** 2, len(out))
                yield pa.RecordBatch.from_arrays([tile.questions, _listed(out.ravel(), len(out))], ["question_id", "total"])

    parts = tiles.mapInArrow(run, f"question_id {_kind(tiles, 'questions')}, total array<double>")
    return sum_vectors(parts, ["question_id"], "total").select("question_id", "total")


def _width(df: DataFrame | None, vector: str = "emb") -> int:
    row = None if df is None else df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    return 0 if row is None else row.n


@dataclass
class Packed:
    """What does not depend on text: (model_id, k) with each model's cells counted, tiles of the bits, and the same centred by run."""

    folds: int
    counts: DataFrame
    sums: DataFrame
    bits: DataFrame
    tiles: DataFrame


def pack(cells: DataFrame, plan: DataFrame, value: str = "correct") -> Packed:
    """The cells of a plan's models as tiles, raw and centred."""
    top = plan.agg(F.max("fold")).first()[0]
    if top is None or top < 1:
        raise ValueError("a plan has two folds at least")
    rows = staged(in_plan(cells, plan, value))
    bits = staged(tiled(rows))
    sums = staged(run_sums(staged(plain_sums(rows)), top + 1))
    counts = staged(rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("k")))
    return Packed(top + 1, counts, sums, bits, staged(centred(bits, sums, top + 1)))


def gather(
    cells: DataFrame | Packed, plan: DataFrame, qtext: DataFrame | None = None, anstext: DataFrame | None = None, value: str = "correct"
) -> Gathered:
    """Everything that runs over ``plan(model_id, fold)`` read of cells(model_id, question_id, value), qtext(question_id, emb)
    and anstext(model_id, emb). Folds are 0, 1, ...; ALWAYS stands on every training side, NEVER in no run.

    A missing cell stands at its question's mean. Question text in model space is divided by the number of the model's
    cells, so a model placed from few of them estimates the same. A model without answer text stands at the training mean.
    ``cells`` can come packed, for several gatherings of one plan.
    """
    own = cells if isinstance(cells, Packed) else pack(cells, plan, value)
    folds, tiles, dq, dt = own.folds, own.tiles, _width(qtext), _width(anstext)
    anstext = anstext if dt else None
    sums = staged(run_sums(staged(tile_sums(own.bits, anstext, dt)), folds)) if dt else own.sums
    members = plan.where(F.col("fold") != NEVER).select("model_id", "fold")
    models = members.join(own.counts, "model_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    none = F.array_repeat(zeros(dq), folds)
    if dq:
        same = qtext.select("question_id", F.array(F.transform("emb", lambda x: x.cast("double"))).alias("blocks"))
        models = models.join(to_models(tiles, same, folds, dq, blocks=1), "model_id", "left")
        models = models.withColumn("q", F.coalesce(F.transform("blocks", lambda b: F.transform(b, lambda x: x / F.col("k"))), none)).drop("blocks")
    else:
        models = models.withColumn("q", none)
    if dt:
        models = models.join(anstext.select("model_id", F.transform("emb", lambda x: x.cast("double")).alias("t")), "model_id", "left")
    else:
        models = models.withColumn("t", F.lit(None).cast("array<double>"))
    models = staged(models)

    # means, norms and the small cross product of each run, from one pass over its training models
    side = models.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("run <> fold")
    has = F.col("t").isNotNull()
    parts = F.concat(
        F.array(F.lit(1.0)), F.col("q")[F.col("run")], F.array(has.cast("double")), F.coalesce("t", zeros(dt)) if dt else zeros(0)
    )
    moments = keyed_matrices(side.select("run", parts.alias("x")), "run", "x")
    norms, means, small = {}, {}, {}
    for run in range(folds):
        if run not in moments:
            raise ValueError(f"run {run} has no training models")
        m = moments[run]
        q, t = slice(1, 1 + dq), slice(2 + dq, 2 + dq + dt)
        n, nt = m[0, 0], m[0, 1 + dq]
        qm, tm = m[0, q] / n, m[0, t] / max(nt, 1)
        means[run] = {"qtext": qm, "anstext": tm}
        norms[run] = {"qtext": float(np.trace(m[q, q]) - n * qm @ qm), "anstext": float(np.trace(m[t, t]) - nt * tm @ tm)}
        small[run] = m[q, t] - np.outer(m[q, 1 + dq], tm) - np.outer(qm, m[0, t] - nt * tm)

    total, mu = F.col("total"), F.col("total")[1] / F.col("total")[0]
    spread = sums.where(total[0] > 0).groupBy("run").agg(F.sum(total[2] - total[0] * mu * mu).alias("s")).collect()
    for r in spread:
        norms[r["run"]]["bits"] = float(r["s"])
    held = sums.where(total[0] > 0)
    if dt:
        tbar = F.array(*[F.array(*[F.lit(float(x)) for x in means[f]["anstext"]]) for f in range(folds)])
        at, st = F.slice("total", 6, dt), F.slice("total", 6 + dt, dt)
        own = F.zip_with(at, st, lambda x, y: x - mu * y)
        text_part = F.zip_with(own, tbar[F.col("run")], lambda x, m: x - m * (total[4] - mu * total[3]))
    else:
        text_part = zeros(0)
    cross = held.select("run", "question_id", text_part.alias("t"))
    if dq:
        bq = to_questions(tiles, models.select("model_id", F.col("q").alias("blocks")), folds, dq)
        bq = bq.select("question_id", F.posexplode("blocks").alias("run", "q"))
        cross = cross.join(bq, ["run", "question_id"], "left").select("run", "question_id", F.concat(F.coalesce("q", zeros(dq)), "t").alias("vec"))
    else:
        cross = cross.withColumnRenamed("t", "vec")
    cross = staged(cross)
    grams = keyed_matrices(cross, "run", "vec") if dq + dt else {}
    return Gathered(folds, {"bits": 0, "qtext": dq, "anstext": dt}, tiles, models, cross, norms, means, small, grams)


def _leading(gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, singular values) of the leading directions of a Gram matrix, cut at its rank; largest entries positive."""
    lam, v = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-lam, kind="stable")
    rank = max(int((lam > lam[order[0]] * RANK_SHARE).sum()), 1) if lam[order[0]] > 0 else 1
    v = v[:, order[: min(width, rank)]]
    peak = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v * np.where(peak == 0, 1, peak), np.sqrt(np.maximum(lam[order[: v.shape[1]]], 0))


def loadings(g: Gathered, run: int, channels: tuple[str, ...], widths: Sequence[int]) -> dict[str, np.ndarray]:
    """What turns each block into its scores: for a text block its directions, for bits a matrix on the rows of ``cross``.

    A block's directions are the leading left singular vectors of its product with the others, each scaled to unit
    Frobenius norm. They come from sums of small products; the others are never laid side by side.
    """
    norm = {c: g.norms[run][c] if g.norms[run].get(c, 0) > 1e-24 else 1.0 for c in channels}
    dq = g.widths["qtext"]
    part = {"qtext": slice(0, dq), "anstext": slice(dq, dq + g.widths["anstext"])}
    out = {}
    for channel, width in zip(channels, widths, strict=True):
        others = [c for c in channels if c != channel]
        if channel == "bits":
            scale = np.zeros(dq + g.widths["anstext"])
            for c in others:
                scale[part[c]] = 1 / np.sqrt(norm[c])
            v, s = _leading(g.grams[run] * np.outer(scale, scale), width)
            out[channel] = scale[:, None] * v / np.maximum(s, 1e-150)
            continue
        gram = np.zeros((g.widths[channel],) * 2)
        if "bits" in others:
            gram += g.grams[run][part[channel], part[channel]] / norm["bits"]
        if channel == "qtext" and "anstext" in others:
            gram += g.small[run] @ g.small[run].T / norm["anstext"]
        if channel == "anstext" and "qtext" in others:
            gram += g.small[run].T @ g.small[run] / norm["qtext"]
        out[channel] = _leading(gram, width)[0]
    return out


def bit_scores(g: Gathered, loads: DataFrame, widths: dict[int, int]) -> DataFrame:
    """(run, model_id, vec) of all models: training models projected, a run's own models by ridge on their cells.

    ``loads(run, question_id, vec)``. A model without cells stands at the prior, 0.
    """
    width = max(widths.values())
    pad = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("vec", i + 1), F.lit(0.0)))
    runs = F.transform(F.array_sort(F.collect_list(F.struct("run", pad.alias("w")))), lambda x: x)
    held = loads.groupBy("question_id").agg(runs.alias("w"))
    full = F.transform(
        F.sequence(F.lit(0), F.lit(g.folds - 1)),
        lambda f: F.coalesce(F.try_element_at(F.transform(F.filter("w", lambda x: x["run"] == f), lambda x: x["w"]), F.lit(1)), zeros(width)),
    )
    blocks = staged(held.select("question_id", full.alias("blocks")))
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    folds, n = g.folds, g.folds * width

    def both(tile: Tile, x: np.ndarray) -> pa.Table:
        out = np.zeros((len(tile.models), n + len(pairs)))
        out[:, :n] = _product(tile, x, folds, width, "models")
        if tile.key[0] >= 0:
            w = x.reshape(len(x), folds, width)[:, tile.key[0]]
            out[:, n:] = tile.dense() @ (w[:, [i for i, _ in pairs]] * w[:, [j for _, j in pairs]])
        return pa.table({"model_id": tile.models, "total": _listed(out.ravel(), len(out))})

    flat = blocks.select("question_id", F.flatten("blocks").alias("x"))
    parts = meet(g.tiles, "questions", flat, n, both, f"model_id {_kind(g.tiles, 'models')}, total array<double>")
    own = sum_vectors(parts, ["model_id"], "total").select("model_id", by_run("total", folds, width).alias("r"), F.slice("total", n + 1, len(pairs)).alias("g"))
    rows = g.models.select("model_id", "fold").join(own, "model_id", "left")
    ii, jj = (np.array(x) for x in zip(*pairs, strict=True))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for fold, r, flat in zip(p["fold"], p["r"], p["g"], strict=True):
                own = np.zeros((folds, width)) if r is None else np.stack(list(r)).astype(float)
                if fold >= 0 and flat is not None:
                    m = np.zeros((width, width))
                    m[ii, jj] = flat
                    m[jj, ii] = flat
                    own[fold] = np.linalg.solve(m + RIDGE * np.eye(width), own[fold])
                out.append(own.tolist())
            yield pd.DataFrame({"model_id": p["model_id"], "s": out})

    kind = dict(rows.dtypes)["model_id"]
    solved = rows.mapInPandas(solve, f"model_id {kind}, s array<array<double>>")
    cut = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv])
    flat = solved.select("model_id", F.posexplode("s").alias("run", "vec"))
    return flat.select("run", "model_id", F.slice("vec", F.lit(1), cut[F.col("run")]).alias("vec"))


def standardised(scores: DataFrame) -> DataFrame:
    """(run, model_id, side, vec): ``vec`` of scores(run, model_id, fold, vec) by mean and spread of the run's training side."""
    sums = scores.where("run <> fold").select("run", F.concat(F.array(F.lit(1.0)), "vec").alias("x"))
    stats = {}
    for run, m in keyed_matrices(sums, "run", "x").items():
        mean = m[0, 1:] / m[0, 0]
        sd = np.sqrt(np.maximum(np.diag(m)[1:] / m[0, 0] - mean**2, 0))
        stats[run] = (mean, np.where(sd > SD_FLOOR, sd, 1.0))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = [(np.asarray(v, float) - stats[r][0]) / stats[r][1] for r, v in zip(p["run"], p["vec"], strict=True)]
            yield p.assign(vec=out)

    side = F.when(F.col("run") == F.col("fold"), "test").otherwise("train")
    rows = scores.select("run", "model_id", side.alias("side"), "vec")
    return rows.mapInPandas(apply, rows.schema)


def text_scores(g: Gathered, maps: dict[int, dict[str, np.ndarray]], channels: Sequence[str]) -> DataFrame:
    """(run, model_id, fold, text): the scores of the text blocks side by side; a model without answer text stands at the mean."""
    means = g.means
    rows = g.models.select("model_id", "fold", "q", "t", F.explode(F.sequence(F.lit(0), F.lit(g.folds - 1))).alias("run"))
    rows = rows.select("run", "model_id", "fold", F.col("q")[F.col("run")].alias("q"), "t")

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for run, q, t in zip(p["run"], p["q"], p["t"], strict=True):
                parts = []
                for c in channels:
                    x = q if c == "qtext" else t
                    w = maps[run][c]
                    parts.append(np.zeros(w.shape[1]) if x is None else (np.asarray(x, float) - means[run][c]) @ w)
                out.append(np.concatenate(parts))
            yield p[["run", "model_id", "fold"]].assign(text=out)

    kind = dict(rows.dtypes)["model_id"]
    return rows.mapInPandas(project, f"run int, model_id {kind}, fold int, text array<double>")


def pls(g: Gathered, channels: Sequence[str], width: int) -> DataFrame:
    """(run, model_id, side, vec): every model in every run, each channel's scores steered by the other channels.

    ``width`` is split over the channels, the remainder to the first; a block keeps fewer directions where its product
    with the others has a lower rank. Scores are standardised on the run's training models.
    """
    channels = checked(channels)
    for c in channels:
        if c != "bits" and not g.widths[c]:
            raise ValueError(f"no vectors for the channel {c}")
    widths = block_widths(width, len(channels))
    if min(widths) < 1:
        raise ValueError(f"a width of {width} leaves no direction for one of {channels}")
    maps = {run: loadings(g, run, channels, widths) for run in range(g.folds)}
    texts = [c for c in channels if c != "bits"]
    scores = text_scores(g, maps, texts)
    if "bits" in channels:
        own = {run: m["bits"] for run, m in maps.items()}

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield p[["run", "question_id"]].assign(vec=[np.asarray(v) @ own[r] for r, v in zip(p["run"], p["vec"], strict=True)])

        kind = dict(g.cross.dtypes)["question_id"]
        loads = g.cross.mapInPandas(project, f"run int, question_id {kind}, vec array<double>")
        bits = bit_scores(g, loads, {run: m.shape[1] for run, m in own.items()})
        scores = scores.join(bits.withColumnRenamed("vec", "b"), ["run", "model_id"]).withColumn("vec", F.concat("b", "text"))
    else:
        scores = scores.withColumnRenamed("text", "vec")
    return standardised(staged(scores.select("run", "model_id", "fold", "vec")))


def restricted(g: Gathered, keep: DataFrame) -> Gathered:
    """``g`` on the questions of ``keep(question_id)`` only, where no channel but bits and answer text is read.

    The sums are kept by question, so a refit without a benchmark re-reads those and no cell of the table. Question text in
    model space sums over questions; for it, gather again.
    """
    if g.widths["qtext"]:
        raise ValueError("question text sums over questions: gather again")
    tiles = staged(kept(g.tiles, keep))
    cross = g.cross.join(keep.select("question_id"), "question_id", "left_semi")
    spread = squares(tiles, g.folds).select(F.posexplode("total").alias("run", "s")).groupBy("run").agg(F.sum("s").alias("s"))
    norms = {run: dict(n) for run, n in g.norms.items()}
    for r in spread.collect():
        norms[r["run"]]["bits"] = float(r["s"])
    return replace(g, tiles=tiles, cross=cross, norms=norms, grams=keyed_matrices(cross, "run", "vec"))


def channel_components(g: Gathered, channels: Sequence[str], width: int, seed: int = 0, rounds: int = 6, extra: int = 8) -> DataFrame:
    """(run, model_id, side, vec): leading components of the channels side by side, for every run.

    Each column is divided by its training spread (1 where there is none) and each channel by the root of its width, so
    that channels weigh the same. A run's own models stand where their cells are, with every cell they lack at the training
    mean. The iteration is that of `bits_components`; text columns are few, so their directions stay on the driver.
    """
    from rosterlens.functions.draws import normal

    if not channels or tuple(channels) != tuple(c for c in CHANNELS if c in channels):
        raise ValueError(f"channels {tuple(channels)} must be distinct ones of {CHANNELS}, in that order")
    texts = [c for c in channels if c != "bits"]
    for c in texts:
        if not g.widths[c]:
            raise ValueError(f"no vectors for the channel {c}")
    n, folds, means = width + extra, g.folds, g.means
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    dq, dt = g.widths["qtext"], g.widths["anstext"]
    plain = g.models.select("model_id", "fold", "q", "t", every.alias("run")).select("run", "model_id", "fold", F.col("q")[F.col("run")].alias("q"), "t")

    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for run, q, t in zip(p["run"], p["q"], p["t"], strict=True):
                parts = {"qtext": lambda: np.asarray(q, float) - means[run]["qtext"], "anstext": lambda: np.zeros(dt) if t is None else np.asarray(t, float) - means[run]["anstext"]}
                out.append(np.concatenate([np.ones(1), *(parts[c]() for c in texts)]))
            yield p[["run", "model_id", "fold"]].assign(x=out)

    kind = dict(plain.dtypes)["model_id"]
    x = staged(plain.mapInPandas(centred, f"run int, model_id {kind}, fold int, x array<double>"))
    scale = {}
    for run, m in keyed_matrices(x.where("run <> fold"), "run", "x").items():
        sd = np.sqrt(np.diag(m)[1:] / m[0, 0])
        size = np.concatenate([np.full({"qtext": dq, "anstext": dt}[c], np.sqrt({"qtext": dq, "anstext": dt}[c])) for c in texts] or [np.zeros(0)])
        scale[run] = 1 / (np.where(sd > SD_FLOOR, sd, 1.0) * size)
    trained = g.models.select(every.alias("run"), "fold").where("run <> fold").groupBy("run").count().collect()
    trained = {r["run"]: r["count"] for r in trained}

    inverse, q = None, None
    if "bits" in channels:
        spread = staged(squares(g.tiles, folds))
        columns = spread.agg(F.count(F.lit(1)).alias("c")).first()["c"]
        by = F.array(*[F.lit(float(trained[f])) for f in range(folds)])
        sd = F.zip_with("total", by, lambda s, k: F.sqrt(s / k))
        inverse = F.transform(sd, lambda s: 1 / (F.when(s > SD_FLOOR, s).otherwise(1.0) * float(np.sqrt(columns))))
        inverse = staged(spread.select("question_id", inverse.alias("inv")))
        start = F.array(*[normal(seed, "omega", F.col("question_id"), F.lit(j)) for j in range(n)])
        q = staged(spread.select("question_id", F.array_repeat(start, folds).alias("blocks")))
    small = {run: np.random.default_rng([seed, run]).standard_normal((len(s), n)) for run, s in scale.items()}

    def scaled(vectors: DataFrame) -> DataFrame:
        """A question's blocks by its inverse spreads; the same as its cells by them."""
        by = lambda b, s: F.transform(b, lambda x: x * s)
        return vectors.join(inverse, "question_id").select("question_id", F.zip_with("blocks", "inv", by).alias("blocks"))

    def scores() -> DataFrame:
        """(run, model_id, fold, y): the standardised rows times the directions."""
        at, by = small, scale

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                out = [(np.asarray(v, float)[1:] * by[r]) @ at[r] for r, v in zip(p["run"], p["x"], strict=True)]
                yield p[["run", "model_id", "fold"]].assign(y=out)

        rows = x.mapInPandas(local, f"run int, model_id {kind}, fold int, y array<double>")
        if inverse is None:
            return rows
        own = to_models(g.tiles, scaled(q), folds, n).select("model_id", F.posexplode("blocks").alias("run", "b"))
        rows = rows.join(own, ["run", "model_id"], "left")
        return rows.select("run", "model_id", "fold", F.when(F.col("b").isNull(), F.col("y")).otherwise(F.zip_with("y", "b", lambda a, b: a + b)).alias("y"))

    for _ in range(rounds):
        y = staged(scores())
        train = y.where("run <> fold")
        pairs = train.join(x.select("run", "model_id", "x"), ["run", "model_id"])
        text = {run: m[1:] * scale[run][:, None] for run, m in keyed_matrices(pairs, "run", "x", "y").items()}
        if inverse is not None:
            held = y.groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "y"))), lambda s: s["y"]).alias("blocks"))
            q = staged(scaled(to_questions(g.tiles, held, folds, n)))
            grams = keyed_matrices(q.select(F.posexplode("blocks").alias("run", "x")), "run", "x")
        turn = {}
        for run, t in text.items():
            lam, u = np.linalg.eigh(t.T @ t + (grams[run] if inverse is not None else 0))
            keep = lam > lam.max() * 1e-14
            turn[run] = np.zeros_like(u)
            turn[run][:, : keep.sum()] = u[:, keep] / np.sqrt(lam[keep])
        small = {run: t @ turn[run] for run, t in text.items()}
        if inverse is not None:
            q = staged(turned_blocks(q, "question_id", turn))
    y = staged(scores())
    rot = {}
    for run, m in keyed_matrices(y.where("run <> fold"), "run", "y").items():
        lam, u = np.linalg.eigh(m)
        u = u[:, np.argsort(-lam)[:width]]
        peak = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
        rot[run] = u * np.where(peak == 0, 1, peak)

    def rotated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[["run", "model_id", "side"]].assign(vec=[np.asarray(v, float) @ rot[r] for r, v in zip(p["run"], p["y"], strict=True)])

    side = F.when(F.col("run") == F.col("fold"), "test").otherwise("train")
    return y.withColumn("side", side).mapInPandas(rotated, f"run int, model_id {kind}, side string, vec array<double>")


def turned_blocks(df: DataFrame, key: str, by: dict[int, np.ndarray]) -> DataFrame:
    """Each run's block times the run's matrix."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(blocks=[[(np.asarray(b, float) @ by[f]).tolist() for f, b in enumerate(bs)] for bs in p["blocks"]])

    return df.mapInPandas(apply, f"{key} {dict(df.dtypes)[key]}, blocks array<array<double>>")


def subspace_loadings(tiles: DataFrame, folds: int, width: int, seed: int = 0, rounds: int = 4, extra: int = 8) -> DataFrame:
    """(run, question_id, vec): leading directions of each run's training bits; largest entries positive.

    Subspace iteration with the run as a block of one wide table, so all runs share each product. A run can be anything that
    centred cells have a value of their own for: a fold, or a draw of questions.
    """
    from rosterlens.functions.draws import normal

    n = width + extra
    start = F.array(*[normal(seed, "omega", F.col("question_id"), F.lit(j)) for j in range(n)])
    q = staged(tiles.select(F.explode("questions").alias("question_id")).distinct().select("question_id", F.array_repeat(start, folds).alias("blocks")))

    def grams(df: DataFrame) -> dict[int, np.ndarray]:
        return keyed_matrices(df.select(F.posexplode("blocks").alias("run", "x")), "run", "x")

    def orthonormal(df: DataFrame, key: str) -> DataFrame:
        by = {}
        for run, m in grams(df).items():
            lam, u = np.linalg.eigh(m)
            keep = lam > max(lam.max(), 0) * 1e-14
            by[run] = np.zeros_like(u)
            by[run][:, : keep.sum()] = u[:, keep] / np.sqrt(lam[keep])
        return turned_blocks(df, key, by)

    for _ in range(rounds):
        y = to_models(tiles, q, folds, n)
        q = staged(orthonormal(staged(to_questions(tiles, y, folds, n)), "question_id"))
    y = to_models(tiles, q, folds, n, train=True)
    rot = {}
    for run, m in grams(y).items():
        lam, u = np.linalg.eigh(m)
        rot[run] = u[:, np.argsort(-lam)[:width]]
    loads = staged(turned_blocks(q, "question_id", rot)).select("question_id", F.posexplode("blocks").alias("run", "vec"))
    peaks = loads.select("run", F.posexplode("vec").alias("j", "x"), "question_id").groupBy("run", "j").agg(F.max_by("x", F.struct(F.abs("x"), "question_id")).alias("x"))
    signs = peaks.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: F.when(p["x"] < 0, F.lit(-1.0)).otherwise(1.0)).alias("s"))
    return loads.join(signs, "run").select("run", "question_id", F.zip_with("vec", "s", lambda x, s: x * s).alias("vec"))


def bits_components(g: Gathered, width: int, seed: int = 0, rounds: int = 4, extra: int = 8) -> DataFrame:
    """(run, model_id, side, vec): principal components of every run's training bits; its own models placed by ridge."""
    loads = subspace_loadings(g.tiles, g.folds, width, seed, rounds, extra)
    scores = bit_scores(g, loads, {run: width for run in range(g.folds)}).join(g.models.select("model_id", "fold"), "model_id")
    side = F.when(F.col("run") == F.col("fold"), "test").otherwise("train")
    return scores.select("run", "model_id", side.alias("side"), "vec")


def keyed_components(cells: DataFrame, keys: int, width: int, seed: int = 0, rounds: int = 4, extra: int = 8) -> DataFrame:
    """(key, model_id, vec): component scores of ``keys`` tables at once; cells(model_id, question_id, v array by key), centred.

    A cell that a key's table lacks is 0 there.
    """
    tiles = staged(tiled(cells.withColumn("fold", F.lit(ALWAYS))))
    loads = subspace_loadings(tiles, keys, width, seed, rounds, extra)
    held = loads.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "vec"))), lambda x: x["vec"]).alias("blocks"))
    scores = to_models(tiles, held, keys, width)
    return scores.select("model_id", F.posexplode("blocks").alias("key", "vec")).select("key", "model_id", "vec")
