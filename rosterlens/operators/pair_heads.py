"""Heads on pairs of models: every pair is a row of the fit, and no pair leaves the task that forms it.

Models are dealt into blocks by fold and hash, and each block is written once, as one row. A task reads two blocks, so no model is
copied for the blocks it meets; it forms the features and targets of its own pairs, piece by piece, and adds up what a ridge needs, for its pair of folds. A fold is fitted on the pairs that have no end in it: the sums of the
fold pairs without it. Held-out pairs, both ends in the fold, are scored in a second pass, which reads only the tiles
within a fold, and counted by rounded score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import ranks as R
from rosterlens.functions.draws import keyed_hash
from rosterlens.operators.heads import ALPHAS, SD_FLOOR
from rosterlens.session import cut_lineage, staged, unstaged

#: Models of a block at least, where there are so many, and how many blocks are wanted; digits to which scores and targets of
#: held-out pairs are rounded before they are counted.
BLOCK, BLOCKS, DIGITS = 256, 12, 4
#: Bytes of payload that a task holds of one block; bytes of two pieces' answers that are laid out at once; models of a piece whose pairs are formed at once, on either side, and of a
#: piece of a grid, and of a piece whose targets are one matrix product; counts that a task holds side by side for one target, and those it holds as a list before it adds them up.
BLOCK_BYTES, LAID, PIECE, GRID, WIDE, DENSE, LISTED = 64 << 20, 32 << 20, (128, 512), (64, 256), (512, 512), 1 << 20, 1 << 22

#: features(x of the first models, x of the second) -> a row for each pair, one x against many or row by row; targets likewise on
#: payloads, unless they have a ``block(payloads, payloads)`` that gives the values of all pairs of two pieces at once.
#: Features and targets with a ``grid(rows, others, first, out)`` write them to out(width, rows, others), without a copy of an x for
#: each pair; ``first`` says where the row's model is the first of the pair, None that it always is.
Features = Callable[[np.ndarray, np.ndarray], np.ndarray]


class SignedDifferences:
    """|a - b| and a - b: who wins."""

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.column_stack([np.abs(a - b), a - b])

    def width(self, x: int) -> int:
        return 2 * x

    def grid(self, rows: np.ndarray, others: np.ndarray, first: np.ndarray | None, out: np.ndarray) -> None:
        width = rows.shape[1]
        gap = out[width:]
        np.subtract(rows.T[:, :, None], others.T[:, None, :], out=gap)
        np.abs(gap, out=out[:width])
        if first is not None:
            gap *= np.where(first, 1.0, -1.0)


signed_differences = SignedDifferences()


class Symmetric:
    """|a - b|, a * b, cosine and distance: the same for either order."""

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        norms = np.maximum(np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1), SD_FLOOR)
        return np.column_stack([np.abs(a - b), a * b, (a * b).sum(axis=-1) / norms, np.linalg.norm(a - b, axis=-1)])

    def width(self, x: int) -> int:
        return 2 * x + 2

    def grid(self, rows: np.ndarray, others: np.ndarray, first: np.ndarray | None, out: np.ndarray) -> None:
        width = rows.shape[1]
        gap, product = out[:width], out[width:-2]
        np.subtract(rows.T[:, :, None], others.T[:, None, :], out=gap)
        np.abs(gap, out=gap)
        np.multiply(rows.T[:, :, None], others.T[:, None, :], out=product)
        norms = np.maximum(np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(others, axis=1)[None, :], SD_FLOOR)
        np.divide(product.sum(axis=0), norms, out=out[-2])
        np.sqrt(np.einsum("kij,kij->ij", gap, gap), out=out[-1])


symmetric = Symmetric()


class LevelAndGap:
    """Mean and distance of one number: what competence alone says of a pair."""

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.column_stack([(a + b) / 2, np.abs(a - b)])

    def width(self, x: int) -> int:
        return 2 * x

    def grid(self, rows: np.ndarray, others: np.ndarray, first: np.ndarray | None, out: np.ndarray) -> None:
        a, b, width = rows.T[:, :, None], others.T[:, None, :], rows.shape[1]
        out[:width] = (a + b) / 2
        out[width:] = np.abs(a - b)


level_and_gap = LevelAndGap()


class Wins:
    """1 where the first model's score is higher, column by column; a missing score makes it missing."""

    def __call__(self, y: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = (y > others).astype(float)
        out[np.isnan(y) | np.isnan(others)] = np.nan
        return out

    def width(self, y: int) -> int:
        return y

    def grid(self, rows: np.ndarray, others: np.ndarray, first: np.ndarray | None, out: np.ndarray) -> None:
        a, b = rows.T[:, :, None], others.T[:, None, :]
        out[:] = a > b if first is None else np.where(first, a > b, b > a)
        if np.isnan(rows).any() or np.isnan(others).any():
            out[np.isnan(a) | np.isnan(b)] = np.nan


wins = Wins()


@dataclass(frozen=True)
class MeanDistance:
    """1 - mean cosine over the answers both gave, missing below ``least`` of them; payloads are unit vectors laid out by question.

    The cosines of a pair add up to one dot product over all questions, so those of two pieces are a matrix product.
    """

    least: int

    def block(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        flat = [np.nan_to_num(v.reshape(len(v), -1).astype(np.float64)) for v in (rows, others)]
        there = [(~np.isnan(v[:, :, 0])).astype(np.float64) for v in (rows, others)]
        for f, t, v in zip(flat, there, (rows, others), strict=True):
            f.reshape(v.shape)[t == 0] = 0.0
        n = there[0] @ there[1].T
        out = 1 - (flat[0] @ flat[1].T) / np.maximum(n, 1)
        return np.where(n >= self.least, out, np.nan)[:, :, None]

    def __call__(self, y: np.ndarray, others: np.ndarray) -> np.ndarray:
        return self.block(y[None], others)[0]


def mean_distance(least: int) -> Features:
    return MeanDistance(least)


class Answers:
    """Unit vectors of the answers that models gave, model after model: the question's number and the vector."""

    def __init__(self, payloads: list[bytes], dim: int) -> None:
        counts = [len(b) // (4 + 4 * dim) for b in payloads]
        self.ends = np.cumsum([0, *counts])
        self.own = np.repeat(np.arange(len(counts)), counts)
        self.at, self.vec = np.empty(self.ends[-1], np.int32), np.empty((self.ends[-1], dim), np.float32)
        for b, n, end in zip(payloads, counts, self.ends[1:], strict=True):
            self.at[end - n : end] = np.frombuffer(b, "<i4", n)
            self.vec[end - n : end] = np.frombuffer(b, "<f4", n * dim, 4 * n).reshape(n, dim)

    def __getitem__(self, models: np.ndarray) -> Answers:
        """Of a run of neighbouring models."""
        a, z = self.ends[models[0]], self.ends[models[-1] + 1]
        out = object.__new__(Answers)
        out.own, out.at, out.vec, out.ends = self.own[a:z] - models[0], self.at[a:z], self.vec[a:z], self.ends[models[0] : models[-1] + 2] - a
        return out

    def __len__(self) -> int:
        return len(self.ends) - 1

    def parts(self, size: int) -> dict[int, np.ndarray]:
        """Which answers are to each part of ``size`` questions."""
        part = self.at // size
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        return {int(part[x[0]]): x for x in np.split(order, cuts) if len(x)}

    def laid_out(self, rows: np.ndarray, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(models x questions of a part x width, whether there)."""
        out, there = np.zeros((len(self), size, self.vec.shape[1])), np.zeros((len(self), size))
        out[self.own[rows], self.at[rows] - first] = self.vec[rows]
        there[self.own[rows], self.at[rows] - first] = 1.0
        return out.reshape(len(self), -1), there


@dataclass(frozen=True)
class AnswerDistance:
    """``MeanDistance`` of models that are held as the answers they gave, whatever the number of questions (``answer_bytes``)."""

    least: int
    dim: int

    def payloads(self, held: list[bytes]) -> Answers:
        return Answers(held, self.dim)

    def width(self, y: int) -> int:
        return 1

    def block(self, rows: Answers, others: Answers) -> np.ndarray:
        total, n = np.zeros((len(rows), len(others))), np.zeros((len(rows), len(others)))
        size = max(1, LAID // (8 * self.dim * (len(rows) + len(others))))
        mine, theirs = rows.parts(size), others.parts(size)
        for part in sorted(mine.keys() & theirs.keys()):
            a, ta = rows.laid_out(mine[part], part * size, size)
            b, tb = others.laid_out(theirs[part], part * size, size)
            total += a @ b.T
            n += ta @ tb.T
        return np.where(n >= self.least, 1 - total / np.maximum(n, 1), np.nan)[:, :, None]


def answer_bytes(at: np.ndarray, vec: np.ndarray) -> bytes:
    """The payload of one model for ``AnswerDistance``: questions' numbers and the answers' vectors; one without a length is none."""
    vec = vec.astype(np.float64)
    size = np.linalg.norm(vec, axis=1, keepdims=True)
    ok = size[:, 0] > 0
    return at[ok].astype("<i4").tobytes() + (vec[ok] / size[ok]).astype("<f4").tobytes()


def packed(rows: DataFrame, block: int, sizes: dict[int, int] | None = None) -> DataFrame:
    """(b, fold, rows): a block's models in one row and one partition, written once. ``sizes``: how many models a fold has at most."""
    if sizes is None:
        sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {fold: -(-n // block) for fold, n in sorted(sizes.items())}
    starts = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist()))
    of = lambda m: F.element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), F.col("fold"))
    names = [f.name for f in rows.schema["x"].dataType]
    dealt = rows.select(
        (of(starts) + keyed_hash(0, "tile", F.col("model_id")) % of(sizes)).cast("int").alias("b"), "fold", "model_id", "y", *[F.col("x")[n].alias(f"x{i}") for i, n in enumerate(names)]
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in batches if len(p)]
        if held:
            p = pd.concat(held).sort_values("model_id")
            x = [np.array(p[f"x{i}"].to_list(), "<f8").tobytes() for i in range(len(names))]
            yield pd.DataFrame({"b": p["b"].iloc[:1], "fold": p["fold"].iloc[:1], "ids": [p["model_id"].to_list()], "x": [x], "ends": [np.cumsum(p["y"].map(len))], "y": [b"".join(p["y"])]})

    kind = dict(rows.dtypes)["model_id"]
    one = dealt.repartitionById(max(1, sum(sizes.values())), F.col("b")).mapInPandas(pack, f"b int, fold int, ids array<{kind}>, x array<binary>, ends array<long>, y binary")
    return cut_lineage(one.select("b", "fold", F.struct("ids", "x", "ends", "y").alias("rows")))


def met(blocks: DataFrame, within: bool = False) -> DataFrame:
    """Every two blocks, and each with itself, read by a task of their own; ``within``: only blocks of one fold.

    Nothing is shuffled for it. Two blocks come in either order, for half of their pairs each.
    """
    a, o = blocks.select(F.struct("b", "fold", "rows").alias("own")), blocks.select(F.struct("b", "fold", "rows").alias("other"))
    both = a.hint("shuffle_replicate_nl").join(o, F.col("own.fold") - F.col("other.fold") == 0) if within else a.hint("shuffle_replicate_nl").crossJoin(o)
    own = F.col("own.b") == F.col("other.b")
    return both.select("own", F.when(own, F.struct(F.col("other.b"), F.col("other.fold"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("rows"))).otherwise(F.col("other")).alias("other"))


def _opened(blocks: pd.DataFrame, names: list[str]) -> Iterator[pd.DataFrame]:
    """The tile of each two blocks: (tile, side, own, model_id, fold, x, y), the rows of both."""

    def side(block: dict, number: int, part: slice) -> pd.DataFrame:
        rows = block["rows"]
        ids, y, ends = np.asarray(rows["ids"]), memoryview(rows["y"]), [0, *rows["ends"]]
        x = [np.frombuffer(v, "<f8").reshape(len(ids), -1) for v in rows["x"]]
        at = range(len(ids))[part]
        return pd.DataFrame(
            {"side": number, "model_id": ids[part], "fold": block["fold"], "x": [{n: v[i] for n, v in zip(names, x, strict=True)} for i in at], "y": [y[ends[i] : ends[i + 1]] for i in at]}
        )

    for a, o in zip(blocks["own"], blocks["other"], strict=True):
        if a["b"] == o["b"]:
            out = side(a, 0, slice(None))
        else:
            lo, hi = (a, o) if a["b"] < o["b"] else (o, a)
            half = -(-len(lo["rows"]["ids"]) // 2)
            out = pd.concat([side(lo, 0, slice(0, half) if lo is a else slice(half, None)), side(hi, 1, slice(None))], ignore_index=True)
            if not (out["side"] == 0).any():
                continue
        yield out.assign(tile=(a["b"] << 31) + o["b"], own=a["b"] == o["b"])


def _of_tiles(run: Callable[[pd.DataFrame], pd.DataFrame], names: list[str]):
    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for tile in _opened(p, names):
                yield run(tile)

    return every


def tiles(rows: DataFrame, block: int = BLOCK, within: bool = False) -> DataFrame:
    """(tile, side, own, model_id, fold, x, y): the models of each tile, as the task that meets its two blocks sees them.

    A block holds models of one fold. ``within``: only blocks of the same fold meet.
    """
    names = [f.name for f in rows.schema["x"].dataType]
    run = _of_tiles(lambda p: p[["tile", "side", "own", "model_id", "fold", "x", "y"]].assign(y=p["y"].map(bytes)), names)
    kinds = dict(rows.dtypes)
    return met(packed(rows, block), within).mapInPandas(run, f"tile long, side int, own boolean, model_id {kinds['model_id']}, fold int, x {kinds['x']}, y binary")


def block_rows(models: int, size: float) -> int:
    """Models of a block, whose payloads have ``size`` bytes: as many as a task can hold, but so few that there are BLOCKS blocks."""
    return int(max(1, min(BLOCK_BYTES // max(1, size), max(BLOCK, -(-models // BLOCKS)), 16 * BLOCK)))


def _pairs(p: pd.DataFrame, shape: tuple[int, ...], dtype: str, of: list[tuple[Features, str]], target: Features) -> Iterator[list[np.ndarray]]:
    """By kind the rows [1, features, targets] of a tile's pairs, a column for each pair, piece by piece; the smaller id of a pair comes
    first. What is yielded holds until the next piece.
    """
    p = p.sort_values(["side", "model_id"]).reset_index(drop=True)
    y = target.payloads(list(p["y"])) if hasattr(target, "payloads") else np.frombuffer(b"".join(p["y"]), dtype).reshape(len(p), *shape)
    xs = {name: np.array([r[name] for r in p["x"]], float) for _, name in of}
    ids, own = p["model_id"].to_numpy(), bool(p["own"].iloc[0])
    ends = len(p) if own else int((p["side"] == 0).sum())
    begin = 0 if own else ends
    grid = (hasattr(target, "grid") or hasattr(target, "width")) and all(hasattr(f, "grid") for f, _ in of)
    step = GRID if grid else PIECE
    if grid:  # the rows of a piece are written to the same place each time
        whole = not hasattr(target, "grid")
        least = target.width(1 if whole else y.shape[1])
        room = [np.ones((1 + f.width(xs[name].shape[1]) + least, step[0] * step[1])) for f, name in of]
        full = y if whole else y.astype(np.float64)
        for at, to, t in _steps(full, target if whole else None, ends, begin, own):
            if own and to[-1] <= at[0]:
                continue
            first = None if ids[at[-1]] < ids[to[0]] else ids[at][:, None] < ids[to][None, :]
            size = len(at) * len(to)
            z = [r[:, :size] for r in room]
            for k, (f, name) in enumerate(of):
                f.grid(xs[name][at], xs[name][to], first, z[k][1:-least].reshape(-1, len(at), len(to)))
            into = z[0][-least:].reshape(-1, len(at), len(to))
            if whole:
                into[:] = t
            else:
                target.grid(full[at], full[to], first, into)
            for more in z[1:]:
                more[-least:] = z[0][-least:]
            keep = ~np.isnan(z[0][-least:]).any(axis=0)
            if own and to[0] <= at[-1]:
                keep &= (at[:, None] < to[None, :]).ravel()
            if not keep.all():
                z = [v[:, keep] for v in z]
            if z[0].shape[1]:
                yield z
        return
    for i in range(0, ends, step[0]):
        for j in range(begin, len(p), step[1]):
            at, to = np.arange(i, min(i + step[0], ends)), np.arange(j, min(j + step[1], len(p)))
            if own and to[-1] <= at[0]:
                continue
            a, b = (np.repeat(at, len(to)), np.tile(to, len(at)))
            keep = a < b if own else np.ones(len(a), bool)
            if hasattr(target, "block"):
                t = target.block(y[at], y[to]).reshape(len(a), -1)
                keep &= ~np.isnan(t).any(axis=1)
                a, b, t = a[keep], b[keep], t[keep]
                a, b = _ordered(ids, a, b)
            else:
                a, b = _ordered(ids, a[keep], b[keep])
                t = target(y[a].astype(np.float64), y[b].astype(np.float64))
                ok = ~np.isnan(t).any(axis=1)
                a, b, t = a[ok], b[ok], t[ok]
            if len(a):
                yield [np.concatenate([np.ones((1, len(a))), f(xs[name][a], xs[name][b]).T, t.T]) for f, name in of]


def _steps(y: np.ndarray | Answers, target: Features | None, ends: int, begin: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """The pieces of a grid; with a ``target`` also its values (targets, rows, others), made for WIDE pieces at once."""
    large = WIDE if target is not None else GRID
    for i in range(0, ends, large[0]):
        for j in range(begin, len(y), large[1]):
            at, to = np.arange(i, min(i + large[0], ends)), np.arange(j, min(j + large[1], len(y)))
            if target is None:
                yield at, to, None
            elif not own or to[-1] > at[0]:
                t = np.moveaxis(target.block(y[at], y[to]), 2, 0)
                for k in range(0, len(at), GRID[0]):
                    for m in range(0, len(to), GRID[1]):
                        yield at[k : k + GRID[0]], to[m : m + GRID[1]], t[:, k : k + GRID[0], m : m + GRID[1]]


def _ordered(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    right = ids[a] < ids[b]
    return np.where(right, a, b), np.where(right, b, a)


class Counts:
    """How often each pair of whole numbers (y, p) came: side by side while their ranges are small, a list of the distinct ones else."""

    def __init__(self) -> None:
        self.box, self.dense, self.parts, self.held = None, None, [], 0

    def add(self, y: np.ndarray, p: np.ndarray) -> None:
        lo, hi = np.array([y.min(), p.min()]), np.array([y.max(), p.max()])
        if self.dense is not None:
            lo, hi = np.minimum(lo, self.box[0]), np.maximum(hi, self.box[1])
        span = hi - lo + 1
        if span[0] * span[1] <= DENSE:
            if self.dense is None or (lo != self.box[0]).any() or (hi != self.box[1]).any():
                grown = np.zeros(span, np.int64)
                if self.dense is not None:
                    a, b = self.box[0] - lo
                    grown[a : a + self.dense.shape[0], b : b + self.dense.shape[1]] = self.dense
                self.box, self.dense = (lo, hi), grown
            self.dense += np.bincount((y - lo[0]) * span[1] + (p - lo[1]), minlength=self.dense.size).reshape(span)
            return
        own, least = int(p.max()) - int(p.min()) + 1, int(p.min())
        code, n = np.unique((y - y.min()) * own + (p - least), return_counts=True)
        self.parts.append((code // own + y.min(), code % own + least, n))
        self.held += len(n)
        if self.held > LISTED:
            self.parts = [self._added(self.parts)]
            self.held = max(0, len(self.parts[0][2]) - LISTED)

    @staticmethod
    def _added(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, p, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((p, y))
        y, p, n = y[order], p[order], n[order]
        new = np.flatnonzero(np.append(True, (np.diff(y) != 0) | (np.diff(p) != 0)))
        return y[new], p[new], np.add.reduceat(n, new)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = list(self.parts)
        if self.dense is not None:
            y, p = np.nonzero(self.dense)
            parts.append((y + self.box[0][0], p + self.box[0][1], self.dense[y, p]))
        return self._added(parts)


def pair_scores(
    rows: DataFrame, shape: tuple[int, ...], kinds: list[tuple[Features, str]], target: Features, targets: int, classes: bool, dtype: str = "<f8", block: int | None = None, digits: int = DIGITS, sizes: dict[int, int] | None = None
) -> DataFrame:
    """(kind, fold, target, y, p, n): held-out pairs counted by target and score, for each kind of features.

    rows(model_id, fold, x struct of arrays, y binary): ``kinds`` name a feature function and the array of x it reads; y is an
    array of ``shape`` and ``dtype``, or what the target's ``payloads`` read. A pair with a missing target is left out. The strength of a ridge is the one of ALPHAS
    with the least generalised cross-validation error. Scores are rounded to ``digits``, and targets that aren't ``classes``,
    which are whole numbers. With ``block`` and ``sizes``, models of a fold at most, rows are read once.
    """
    placed = rows.select("model_id", F.col("fold").cast("int").alias("fold"), "x", "y")
    names = [f.name for f in placed.schema["x"].dataType]
    once = block is not None and sizes is not None
    placed = placed if once else staged(placed)
    block = block or block_rows(placed.count(), int(np.prod(shape)) * np.dtype(dtype).itemsize)
    blocks = packed(placed, block, sizes)
    if not once:
        unstaged(placed)

    def sums(p: pd.DataFrame) -> pd.DataFrame:
        total: list = [0] * len(kinds)
        for piece in _pairs(p, shape, dtype, kinds, target):
            for kind, z in enumerate(piece):
                total[kind] = total[kind] + z @ z.T
        a, b = int(p["fold"].min()), int(p["fold"].max())
        out = [(k, a, b, r, v) for k, m in enumerate(total) if not np.isscalar(m) for r, v in enumerate(m.tolist())]
        return pd.DataFrame(out, columns=["kind", "a", "b", "r", "v"])

    parts = met(blocks).mapInPandas(_of_tiles(sums, names), "kind int, a int, b int, r int, v array<double>")
    cells = parts.select("kind", "a", "b", "r", F.posexplode("v").alias("c", "v")).groupBy("kind", "a", "b", "r", "c").agg(F.sum("v").alias("v"))
    full: dict[tuple[int, int, int], np.ndarray] = {}
    found = cells.collect()  # fold pairs x widths squared
    sizes = {k: 1 + max(r["r"] for r in found if r["kind"] == k) for k in {r["kind"] for r in found}}
    for r in found:
        full.setdefault((r["kind"], r["a"], r["b"]), np.zeros((sizes[r["kind"]],) * 2))[r["r"], r["c"]] = r["v"]
    fits = {}
    for kind in sizes:
        for fold in {f for _, a, b in full for f in (a, b)}:
            outside = [m for (k, a, b), m in full.items() if k == kind and fold not in (a, b)]
            if outside:
                fits[kind, fold] = _ridge(sum(outside), targets)

    def scores(p: pd.DataFrame) -> pd.DataFrame:
        fold, unit = int(p["fold"].iloc[0]), 10.0**digits
        held: dict[tuple[int, int], Counts] = {}
        for piece in _pairs(p, shape, dtype, kinds, target):
            t = piece[0][-targets:]
            truth = np.rint(t if classes else t * unit).astype(np.int64)
            for kind, z in enumerate(piece):
                if (kind, fold) not in fits:
                    continue
                mu, sd, ybar, coef = fits[kind, fold]
                slope = coef / sd[:, None]
                predicted = slope.T @ z[1:-targets]
                predicted += (ybar - mu @ slope)[:, None]
                predicted *= unit
                predicted = np.rint(predicted, out=predicted).astype(np.int64)
                for c in range(targets):
                    held.setdefault((kind, c), Counts()).add(truth[c], predicted[c])
        out = [pd.DataFrame({"kind": [], "fold": [], "target": [], "y": [], "p": [], "n": []})]
        for (kind, c), counts in held.items():
            u, v, n = counts.rows()
            out.append(pd.DataFrame({"kind": kind, "fold": fold, "target": c, "y": u if classes else u / unit, "p": v / unit, "n": n}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    counted = met(blocks, within=True).mapInPandas(_of_tiles(scores, names), "kind int, fold int, target int, y double, p double, n long")
    return staged(counted.groupBy("kind", "fold", "target", "y", "p").agg(F.sum("n").alias("n")))


def _ridge(m: np.ndarray, targets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, spread, target means, coefficients) from the sum of outer products of [1, features, targets]."""
    width = len(m) - 1 - targets
    x, y, n = slice(1, 1 + width), slice(1 + width, None), m[0, 0]
    mu, ybar = m[0, x] / n, m[0, y] / n
    sd = np.sqrt(np.maximum(np.diag(m)[x] / n - mu**2, 0))
    sd = np.where(sd > SD_FLOOR, sd, 1.0)
    g = (m[x, x] - n * np.outer(mu, mu)) / np.outer(sd, sd)
    c = (m[x, y] - n * np.outer(mu, ybar)) / sd[:, None]
    yy = float(np.trace(m[y, y] - n * np.outer(ybar, ybar)))
    best = (np.inf, np.zeros_like(c))
    for alpha in ALPHAS:
        inv = np.linalg.inv(g + alpha * np.eye(width))
        coef = inv @ c
        rss = yy - 2 * float(np.sum(coef * c)) + float(np.sum(coef * (g @ coef)))
        error = max(rss, 0.0) / max(n - 1 - float(np.trace(inv @ g)), 1e-9) ** 2
        if error < best[0]:
            best = (error, coef)
    return mu, sd, ybar, best[1]


KEYS = ["kind", "fold", "target"]


def counted_auroc(counts: DataFrame) -> DataFrame:
    """(kind, fold, target, auroc, accuracy, n): of y from 0.5 up by p; a pair counts as foreseen if p lies on y's side of 0.5."""
    pos, neg = F.when(F.col("y") >= 0.5, F.col("n")).otherwise(0), F.when(F.col("y") < 0.5, F.col("n")).otherwise(0)
    right = F.when((F.col("y") >= 0.5) == (F.col("p") > 0.5), F.col("n")).otherwise(0)
    by = counts.groupBy(*KEYS, "p").agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"), F.sum(right).alias("right"))
    ranked = R.value_offsets(by, KEYS, "p", ["neg"])
    won, p, n = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)), F.sum("pos"), F.sum("neg")
    return ranked.groupBy(*KEYS).agg(
        F.when((p > 0) & (n > 0), won / F.greatest(p * n, F.lit(1))).alias("auroc"), (F.sum("right") / (p + n)).alias("accuracy"), (p + n).alias("n")
    )


def counted_spearman(counts: DataFrame) -> DataFrame:
    """(kind, fold, target, spearman, n): of y and p with mid-ranks over the counted pairs; null where one side is constant."""
    ranked = counts
    for name in ("y", "p"):
        margin = counts.groupBy(*KEYS, name).agg(F.sum("n").alias("m"))
        place = R.value_offsets(margin, KEYS, name, ["m"]).select(*KEYS, name, (F.col("m_below") + (F.col("m") + 1) / 2.0).alias(f"r{name}"))
        ranked = ranked.join(place, [*KEYS, name])
    n, a, b = F.col("n"), F.col("ry"), F.col("rp")
    s = ranked.groupBy(*KEYS).agg(*[F.sum(e).alias(k) for k, e in (("n", n), ("a", n * a), ("b", n * b), ("aa", n * a * a), ("bb", n * b * b), ("ab", n * a * b))])
    va, vb = F.col("aa") / F.col("n") - F.pow(F.col("a") / F.col("n"), F.lit(2.0)), F.col("bb") / F.col("n") - F.pow(F.col("b") / F.col("n"), F.lit(2.0))
    cov = F.col("ab") / F.col("n") - F.col("a") * F.col("b") / (F.col("n") * F.col("n"))
    return s.select(*KEYS, F.when((va > R.EPS) & (vb > R.EPS), cov / F.sqrt(va * vb)).alias("spearman"), F.col("n"))
