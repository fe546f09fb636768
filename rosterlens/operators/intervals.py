"""Bootstrap intervals of rank and fit statistics: all resamples of a statistic in one pass over the rows.

A resample is not a copy of the rows. Each unit has a vector with its number of draws in every resample; a row's weights are its
unit's vector, a pair's the product of its two endpoints'. Sums, running sums and ranks are taken on the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import hash_position, keyed_hash
from rosterlens.functions.ranks import EPS
from rosterlens.session import cut_lineage, staged

#: Resamples of an interval, its error level, and the share of resamples that must have a value. Fixed values.
DRAWS, ALPHA, LEAST_SHARE = 1000, 0.05, 0.5
#: Rows whose weights a task holds at a time; rows of a piece that ranks are taken in.
SLICE, PIECE = 512, 2048
#: Units of a block whose draws are counted together, and draws a task makes. Fixed values.
BLOCK, PICKS = 1024, 4_000_000


def draw_weights(units: DataFrame, unit: str, draws: int = DRAWS, seed: int = 7, purpose: str = "ci") -> DataFrame:
    """(unit, w array of ``draws`` counts): how often each unit is drawn; every resample has as many draws as there are units.

    The draws are those of ``scores.resample``: slot i of draw b picks position hash % n. A task hashes its slots' picks and
    sends them, packed, to the block of positions they fall in; a block counts them into its units' vectors.
    """
    placed = cut_lineage(
        hash_position(units.select(unit).distinct().withColumn("__h", keyed_hash(seed, purpose, F.col(unit))), [], "__h", unit, "__pos").drop("__h")
    )
    n = placed.count()
    # codes (position in the block, draw) fit 32 bits
    block = max(1, min(BLOCK, 2**31 // draws))
    heads = [f"{seed}|{purpose}-slot|{b}|".encode() for b in range(1, draws + 1)]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.arange(draws, dtype=np.int64)
        for p in batches:
            parts = []
            for start in range(0, len(p), SLICE):
                slots = [str(i).encode() for i in p["__pos"].iloc[start : start + SLICE]]
                digests = b"".join([md5(h + i).digest() for i in slots for h in heads])
                # the first 15 hex digits, as keyed_hash reads them
                got = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64) % n
                parts.append(((got // block).astype(np.int32), (got % block * draws + np.tile(at, len(slots))).astype("<u4")))
            if parts:
                where, code = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.argsort(where, kind="stable")
                where, code = where[order], code[order]
                first = np.flatnonzero(np.diff(where, prepend=-1))
                yield pd.DataFrame({"block": where[first].astype(np.int64), "codes": [c.tobytes() for c in np.split(code, first[1:])]})

    def count(key: tuple, codes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        w = np.bincount(np.frombuffer(b"".join(codes["codes"]), "<u4"), minlength=block * draws).astype(np.int16)
        rows = w.reshape(block, draws)[(members["__pos"].to_numpy() - 1) % block]
        return pd.DataFrame({unit: members[unit], "w": list(rows)})

    tasks = max(1, -(-n * draws // PICKS))
    picks = placed.select("__pos").repartition(tasks).mapInPandas(pick, "block long, codes binary")
    members = placed.withColumn("block", F.floor((F.col("__pos") - 1) / block))
    return picks.groupBy("block").cogroup(members.groupBy("block")).applyInPandas(count, f"{unit} {dict(units.dtypes)[unit]}, w array<smallint>")


def weighted(rows: DataFrame, weights: DataFrame, unit: str, ends: Sequence[str]) -> DataFrame:
    """``rows`` with ``w``: the weights of the unit in ``ends``, or the product of those of two."""
    out = None
    for i, end in enumerate(ends):
        own = weights.select(F.col(unit).alias(end), F.col("w").alias(f"__w{i}"))
        out = (rows if out is None else out).join(own, end)
    w = F.col("__w0") if len(ends) == 1 else F.zip_with("__w0", "__w1", lambda a, b: a.cast("int") * b.cast("int"))
    return out.withColumn("w", w).drop("__w0", "__w1")


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        for start in range(0, len(p), SLICE):
            yield p.iloc[start : start + SLICE]


def _added(parts: DataFrame) -> DataFrame:
    """(draw, v): the tasks' rows of sums put together."""
    long = parts.select("draw", F.posexplode("v").alias("i", "x")).groupBy("draw", "i").agg(F.sum("x").alias("x"))
    return long.groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def weighted_sums(rows: DataFrame, features: Sequence[Column]) -> DataFrame:
    """(draw, v): for every draw the weighted sums of the features; a matrix product for each slice of rows."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for p in _slices(batches):
            total = total + _stack(p["w"]).T @ _stack(p["x"])
        if not np.isscalar(total):
            yield pd.DataFrame({"draw": np.arange(len(total)), "v": list(total)})

    x = F.array(*[f.cast("double") for f in features])
    return _added(rows.select("w", x.alias("x")).mapInPandas(partial, "draw int, v array<double>"))


def ranked(rows: DataFrame, value: str, out: str, n: int) -> DataFrame:
    """``rows`` (about ``n``) with ``out``: in every draw the mid-rank that the row's value has among the drawn rows.

    Rows are dealt by ranges of the value in pieces of bounded size; a value that many rows share goes on over several. A first
    pass adds up the weights of each piece, and of its lowest and highest value; the second runs through a piece in order.
    """
    pieces = max(1, -(-n // PIECE))
    # a number of its own, as pieces of packed counts would otherwise be put together by their packed size
    dealt = staged(rows.repartitionByRange(pieces, F.col(value), F.xxhash64("w")).withColumn("__part", F.spark_partition_id()))

    def totals(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        v, w = p[value].to_numpy(), _stack(p["w"])
        lo, hi = v.min(), v.max()
        sums = np.concatenate([w.sum(axis=0), w[v == lo].sum(axis=0), w[v == hi].sum(axis=0)])
        return pd.DataFrame({"part": [key[0]], "lo": [float(lo)], "hi": [float(hi)], "v": [sums]})

    found = dealt.select("__part", value, "w").groupBy("__part").applyInPandas(totals, "part int, lo double, hi double, v array<double>").collect()
    found = sorted(((r["part"], r["lo"], r["hi"], *np.split(np.array(r["v"]), 3)) for r in found), key=lambda r: r[0])
    # a value in two pieces or more is the lowest or the highest of each of them
    tied: dict[float, np.ndarray] = {}
    below, run = {}, 0.0
    for part, lo, hi, every, low, high in found:
        below[part] = run - tied.get(lo, 0.0)
        run = run + every
        tied[lo] = tied.get(lo, 0.0) + low
        if hi != lo:
            tied[hi] = tied.get(hi, 0.0) + high
    edges = {part: (below[part], tied[lo], tied[hi]) for part, lo, hi, *_ in found}

    def place(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(value, kind="stable").reset_index(drop=True)
        v = p[value].to_numpy()
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        same = np.add.reduceat(_stack(p["w"]), first, axis=0)
        start, same[0], same[-1] = edges[key[0]]
        middle = start + np.cumsum(same, axis=0) - (same - 1) / 2
        at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
        p[out] = list(middle[at])
        return p.drop(columns="__part")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out} array<double>"
    return dealt.groupBy("__part").applyInPandas(place, schema)


def rank_sums(rows: DataFrame, columns: Sequence[str], terms) -> DataFrame:
    """(draw, v): per draw the weighted sums of ``terms(frame, ranks)``, arrays of the rows' shape."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for p in _slices(batches):
            w = _stack(p["w"])
            total = total + np.stack([(w * t).sum(axis=0) for t in terms(p, [_stack(p[c]) for c in columns])], axis=1)
        if not np.isscalar(total):
            yield pd.DataFrame({"draw": np.arange(len(total)), "v": list(total)})

    return _added(rows.mapInPandas(partial, "draw int, v array<double>"))


def _v(i: int) -> Column:
    return F.col("v")[i]


def mean_draws(rows: DataFrame) -> DataFrame:
    """(draw, stat): the mean of y."""
    v = weighted_sums(rows, [F.lit(1), F.col("y")])
    return v.select("draw", F.when(_v(0) > 0, _v(1) / _v(0)).alias("stat"))


def ratio_draws(rows: DataFrame) -> DataFrame:
    """(draw, stat): sum of p over sum of y, where the latter is positive."""
    v = weighted_sums(rows, [F.col("p"), F.col("y")])
    return v.select("draw", F.when(_v(1) > EPS, _v(0) / _v(1)).alias("stat"))


def r2_draws(rows: DataFrame) -> DataFrame:
    """(draw, stat): R2 of y against p; null where a draw's y is constant."""
    y, p = F.col("y"), F.col("p")
    v = weighted_sums(rows, [F.lit(1), y, y * y, (y - p) * (y - p)])
    spread = _v(2) - _v(1) * _v(1) / _v(0)
    return v.select("draw", F.when((_v(0) >= 2) & (spread > EPS), 1 - _v(3) / spread).alias("stat"))


def spearman_draws(rows: DataFrame) -> DataFrame:
    """(draw, stat): Spearman's correlation of y and p, ranks taken within the draw; null where one side is constant."""
    n = rows.count()
    both = ranked(ranked(rows.select("w", "y", "p"), "y", "__a", n), "p", "__b", n)
    v = rank_sums(both.select("w", "__a", "__b"), ["__a", "__b"], lambda f, r: [np.ones_like(r[0]), r[0], r[1], r[0] ** 2, r[1] ** 2, r[0] * r[1]])
    va, vb = _v(3) / _v(0) - (_v(1) / _v(0)) ** 2, _v(4) / _v(0) - (_v(2) / _v(0)) ** 2
    cov = _v(5) / _v(0) - _v(1) * _v(2) / (_v(0) * _v(0))
    return v.select("draw", F.when((_v(0) >= 2) & (va > EPS) & (vb > EPS), cov / F.sqrt(va * vb)).alias("stat"))


def auroc_draws(rows: DataFrame) -> DataFrame:
    """(draw, stat): AUROC of p for y from 0.5 up, ties half; null where a draw has one class."""
    r = ranked(rows.select("w", "y", "p"), "p", "__r", rows.count())

    def terms(f: pd.DataFrame, ranks: list[np.ndarray]) -> list[np.ndarray]:
        pos = np.broadcast_to((f["y"].to_numpy() >= 0.5)[:, None].astype(float), ranks[0].shape)
        return [pos, 1 - pos, pos * ranks[0]]

    v = rank_sums(r.select("w", "y", "__r"), ["__r"], terms)
    return v.select("draw", F.when((_v(0) > 0) & (_v(1) > 0), (_v(2) - _v(0) * (_v(0) + 1) / 2) / (_v(0) * _v(1))).alias("stat"))


def macro_f1_draws(rows: DataFrame, classes: Sequence[int]) -> DataFrame:
    """(draw, stat): mean F1 over ``classes`` of predicted p for label y; an undefined F1 counts 0."""
    y, p = F.col("y"), F.col("p")
    parts = [x for c in classes for x in ((y == c), (p == c), (y == c) & (p == c))]
    v = weighted_sums(rows, parts)
    f1 = [F.coalesce(F.try_divide(2.0 * _v(3 * i + 2), _v(3 * i) + _v(3 * i + 1)), F.lit(0.0)) for i in range(len(classes))]
    total = f1[0]
    for x in f1[1:]:
        total = total + x
    return v.select("draw", (total / len(classes)).alias("stat"))


STATISTICS = {"mean": mean_draws, "ratio": ratio_draws, "r2": r2_draws, "spearman": spearman_draws, "auroc": auroc_draws, "macro_f1": macro_f1_draws}


def interval(
    rows: DataFrame, statistic: str | Callable[..., DataFrame], point: Column | float | None, units: Sequence[str] = ("model_id",), draws: int = DRAWS, seed: int = 7, **more
) -> DataFrame:
    """One row (ci_lo, ci_hi, n_units): the percentile interval of a statistic of rows(units, y, p) when units are redrawn.

    ``statistic`` is one of STATISTICS, or a function of rows with weights ``w`` that returns (draw, stat).

    With two unit columns a row is a pair and the units are all endpoints. The interval is widened to hold ``point``. It is
    refused (null) with fewer than two units, without a point, or with fewer than half of the draws finite.
    """
    ends = list(units)
    every = rows.select(F.col(ends[0]).alias("unit"))
    for end in ends[1:]:
        every = every.unionByName(rows.select(F.col(end).alias("unit")))
    every = staged(every.distinct())
    n = every.count()
    none = rows.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("ci_lo"), F.lit(None).cast("double").alias("ci_hi"), F.lit(n).cast("bigint").alias("n_units")
    )
    if n < 2:
        return none
    held = staged(weighted(rows, draw_weights(every, "unit", draws, seed), "unit", ends))
    fn = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    stat = fn(held, **more).where(F.col("stat").isNotNull() & ~F.isnan("stat"))
    point = point if isinstance(point, Column) else F.lit(point).cast("double")
    ci = stat.agg(
        F.percentile("stat", ALPHA / 2).alias("lo"), F.percentile("stat", 1 - ALPHA / 2).alias("hi"), F.count("stat").alias("n"), F.lit(n).cast("bigint").alias("n_units")
    ).withColumn("point", point)
    ok = (F.col("n") >= LEAST_SHARE * draws) & F.col("point").isNotNull()
    return ci.select(
        F.when(ok, F.least("lo", "point")).alias("ci_lo"), F.when(ok, F.greatest("hi", "point")).alias("ci_hi"), "n_units"
    )
