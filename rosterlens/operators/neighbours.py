"""Nearest neighbours of every model, and predictions from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import hash_position, keyed_hash
from rosterlens.functions.ranks import top_by, value_offsets
from rosterlens.functions.vectors import unit
from rosterlens.session import cut_lineage, staged

#: Rows of one side of a block; a task compares at most this many rows with as many others.
BLOCK_ROWS = 2048
#: Blocks of targets that a task meets one after another, with what it has found so far as a bound.
IN_TURN = 32
#: Pivots of an index at most; they are held by the driver and sent to every task.
PIVOTS = 1024
EPS = 1e-9
#: Similarities closer than this are ties.
TIE_DIGITS = 12


def nearest(vectors: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK_ROWS) -> DataFrame:
    """near(model_id, other, sim, pos): the k most similar other rows, ties by id.

    cosine is a dot product of unit vectors; euclidean is a negated distance on centred columns, euclidean_z on
    standardised ones. Exact; `search` says how it avoids comparing every row with every other.
    """
    if metric not in ("cosine", "euclidean", "euclidean_z"):
        raise ValueError(f"unknown metric {metric!r}")
    vectors = cut_lineage(vectors.select("model_id", "emb"))
    if metric == "cosine":
        ready = vectors.select("model_id", unit("emb", EPS).alias("emb"))
    elif metric == "euclidean":
        ready = vectors.select("model_id", F.transform("emb", lambda x: x.cast("double")).alias("emb"))
    else:
        from rosterlens.operators.embed import column_stats

        stats = column_stats(vectors, "emb").select(F.struct("mean", "sd"))
        ready = vectors.withColumn("__s", stats.scalar()).select(
            "model_id",
            F.zip_with(
                F.zip_with("emb", "__s.mean", lambda x, m: x - m), "__s.sd", lambda x, s: x / F.greatest(s, F.lit(EPS))
            ).alias("emb"),
        )
    ready = cut_lineage(ready)
    return search(ready, ready, k, metric == "cosine", True, block)


def nearest_between(queries: DataFrame, targets: DataFrame, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """near(model_id, other, sim, pos): the k targets closest to each query by distance, ties by id."""
    return search(cut_lineage(queries.select("model_id", "emb")), cut_lineage(targets.select("model_id", "emb")), k, False, False, block)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))


def _top(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, cosine: bool, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of the k best of ``others``, sorted by id, for each row."""
    sim = x @ y.T if cosine else -_distances(x, y)
    if same:
        sim[ids[:, None] == others[None, :]] = -np.inf
    order = np.argsort(-np.round(sim, TIE_DIGITS), axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(sim, order, 1)


@dataclass
class Index:
    """Targets by pivot and, within a pivot's share, by rings of their distance to it; a block has about as many rows as a task compares."""

    pivots: np.ndarray
    rows: DataFrame  # (block, other, other_emb)
    part: np.ndarray  # of each block: its pivot, least and largest distance to it
    low: np.ndarray
    high: np.ndarray


def indexed(targets: DataFrame, block: int) -> Index:
    """The index of targets(model_id, emb). Pivots are a hashed sample of at most PIVOTS rows; what the driver holds beside them is
    one line for each block. Rows at one distance (copies) are dealt over as many blocks as they need."""
    n = targets.count()
    wanted = max(1, min(PIVOTS, -(-n // block)))
    sample = targets.withColumn("h", keyed_hash(0, "pivot", F.col("model_id"))).orderBy("h", "model_id").limit(wanted).collect()
    pivots = np.array([r["emb"] for r in sample], float)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            d = _distances(_matrix(p["emb"]), pivots)
            part = d.argmin(axis=1)
            yield p.assign(part=part.astype(np.int32), d=np.round(d[np.arange(len(d)), part], 9) + 0.0)

    kind = dict(targets.dtypes)["model_id"]
    placed = cut_lineage(targets.mapInPandas(assign, f"model_id {kind}, emb array<double>, part int, d double"))
    counts = placed.groupBy("part", "d").agg(F.count(F.lit(1)).alias("c"))
    rings = cut_lineage(value_offsets(counts, ["part"], "d", ["c"]).select("part", "d", "c", F.floor(F.col("c_below") / block).alias("ring")))
    shares = rings.groupBy("part", "ring").agg(F.ceil(F.sum("c") / block).cast("int").alias("shares"))
    named = placed.join(rings.select("part", "d", "ring"), ["part", "d"]).join(shares, ["part", "ring"])
    named = named.withColumn("share", (keyed_hash(0, "share", F.col("model_id")) % F.col("shares")).cast("int"))
    blocks = named.groupBy("part", "ring", "share").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    lines = sorted(tuple(r) for r in blocks.collect())
    spark = targets.sparkSession
    numbers = spark.createDataFrame([(i, *line[:3]) for i, line in enumerate(lines)], "block int, part int, ring long, share int")
    rows = cut_lineage(named.join(numbers, ["part", "ring", "share"]).select("block", F.col("model_id").alias("other"), F.col("emb").alias("other_emb")))
    return Index(pivots, rows, np.array([x[0] for x in lines]), np.array([x[3] for x in lines]), np.array([x[4] for x in lines]))


def _met(visits: DataFrame, index: Index, k: int, cosine: bool, same: bool, block: int) -> DataFrame:
    """(model_id, other, sim): the k best of each block for the queries that visit it, visits(block, model_id, emb).

    A block with very many visitors meets them in several tasks.
    """
    counts = cut_lineage(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("turns")))
    left = visits.join(counts, "block").select("block", (keyed_hash(0, "turn", F.col("model_id")) % F.col("turns")).cast("int").alias("turn"), "model_id", "emb")
    again = counts.select(F.col("block").alias("of"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    right = index.rows.join(again, F.col("block") == F.col("of")).select("block", "turn", "other", "other_emb")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"model_id": [], "other": [], "sim": []})
        b = b.sort_values("other")
        ids, others = a["model_id"].to_numpy(), b["other"].to_numpy()
        order, top = _top(ids, _matrix(a["emb"]), others, _matrix(b["other_emb"]), k, cosine, same)
        out = pd.DataFrame({"model_id": np.repeat(ids, order.shape[1]), "other": others[order.ravel()], "sim": top.ravel()})
        return out[np.isfinite(out["sim"])]

    kind, other = dict(visits.dtypes)["model_id"], dict(index.rows.dtypes)["other"]
    return left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(best, f"model_id {kind}, other {other}, sim double")


def _gaps(x: np.ndarray, index: Index, blocks: np.ndarray | slice = slice(None)) -> np.ndarray:
    """How far each row is from each block at least: the gap between its own distance to the pivot and the block's ring."""
    own = _distances(x, index.pivots)[:, index.part[blocks]]
    return np.maximum(np.maximum(own - index.high[blocks], index.low[blocks] - own), 0)


def _reach(least: np.ndarray, cosine: bool) -> np.ndarray:
    """Squared distance within which rows of at least that similarity lie; all where it is not known. Rounding never hides a tie."""
    square = 2 - 2 * least if cosine else least * least
    return np.where(np.isfinite(least), square * (1 + 1e-6) + 1e-6, np.inf)


def bounded(queries: DataFrame, index: Index, k: int, cosine: bool, same: bool, block: int) -> DataFrame:
    """(home, model_id, emb, least): the block nearest to each query, and the similarity of the k-th of that block's rows, where there are so many."""
    plain = Index(index.pivots, None, index.part, index.low, index.high)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = _matrix(p["emb"])
            d = _distances(x, plain.pivots)
            # of the nearest pivot's blocks the one with the least gap
            g = np.where(plain.part[None] == plain.part[np.argsort(d[:, plain.part], axis=1, kind="stable")[:, 0]][:, None], _gaps(x, plain), np.inf)
            yield p.assign(block=g.argmin(axis=1).astype(np.int32))[["block", "model_id", "emb"]]

    kind = dict(queries.dtypes)["model_id"]
    home = cut_lineage(queries.mapInPandas(first, f"block int, model_id {kind}, emb array<double>"))
    near = _met(home, index, k, cosine, same, block)
    far = near.groupBy("model_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("least"))
    return cut_lineage(home.withColumnRenamed("block", "home").join(far, "model_id", "left").select("home", "model_id", "emb", "least"))


def visited(queries: DataFrame, index: Index, k: int, cosine: bool, same: bool, block: int) -> DataFrame:
    """(block, model_id, emb): the blocks that can hold one of a query's k best.

    A query first meets the block nearest to it, which bounds how far its k-th neighbour is. By the triangle inequality a block
    whose ring around its pivot lies farther than that from the query's own distance to the pivot holds none.
    """
    plain = Index(index.pivots, None, index.part, index.low, index.high)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for start in range(0, len(p), 256):
                q = p.iloc[start : start + 256]
                x = _matrix(q["emb"])
                row, at = np.nonzero(_gaps(x, plain) ** 2 <= _reach(q["least"].to_numpy(float), cosine)[:, None])
                yield pd.DataFrame({"block": at.astype(np.int32), "model_id": q["model_id"].to_numpy()[row], "emb": list(x[row])})

    kind = dict(queries.dtypes)["model_id"]
    return bounded(queries, index, k, cosine, same, block).mapInPandas(reach, f"block int, model_id {kind}, emb array<double>")


def _packed(rows: DataFrame, by: list[str], number: str, partitions: int) -> DataFrame:
    """(number, ids, emb, least): each group of ``rows(by, id, emb, least)`` as one row, dealt over so many partitions and written once."""

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        least = p["least"].to_numpy(float).astype("<f8").tobytes()
        return pd.DataFrame({"number": [int(p[number].iloc[0])], "ids": [p["id"].to_list()], "emb": [_matrix(p["emb"]).tobytes()], "least": [least]})

    kind = dict(rows.dtypes)["id"]
    one = rows.groupBy(*by).applyInPandas(pack, f"number int, ids array<{kind}>, emb binary, least binary")
    return cut_lineage(one.repartition(partitions))


def _better(at: np.ndarray, others: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Which candidates are among the k best of their row; ties by id."""
    order = np.lexsort((others, -np.round(sim, TIE_DIGITS), at))
    rows = at[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.empty(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return order[place < k]


class _Found:
    """The k best so far of the queries of one pack."""

    def __init__(self, pack: dict, k: int, cosine: bool, same: bool) -> None:
        self.ids, self.k, self.cosine, self.same = np.asarray(pack["ids"]), k, cosine, same
        self.x = np.frombuffer(pack["emb"], "<f8").reshape(len(self.ids), -1)
        self.least = np.nan_to_num(np.frombuffer(pack["least"], "<f8"), nan=-np.inf) - EPS
        self.at, self.others, self.sim = np.empty(0, np.int64), None, np.empty(0)

    def meet(self, pack: dict, index: Index) -> None:
        """Compare with one block of targets those queries for which it can hold one of the k best."""
        gap = _gaps(self.x, index, np.array([pack["number"]]))[:, 0]
        own = np.flatnonzero(gap**2 <= _reach(self.least, self.cosine))
        if not len(own):
            return
        others, x = np.asarray(pack["ids"]), self.x[own]
        y = np.frombuffer(pack["emb"], "<f8").reshape(len(others), -1)
        sim = x @ y.T if self.cosine else -_distances(x, y)
        if self.same:
            sim[self.ids[own][:, None] == others[None, :]] = -np.inf
        ok = sim >= self.least[own][:, None]
        wide = np.flatnonzero(ok.sum(axis=1) > 16 * self.k)
        if len(wide):  # little is known of these rows: only their k best of this block
            top = np.argsort(-np.round(sim[wide], TIE_DIGITS), axis=1, kind="stable")[:, : self.k]
            ok[wide] = False
            ok[wide[:, None], top] = True
        row, at = np.nonzero(ok & np.isfinite(sim))
        if not len(row):
            return
        mine, theirs, value = np.append(self.at, own[row]), others[at], np.append(self.sim, sim[row, at])
        theirs = theirs if self.others is None else np.append(self.others, theirs)
        keep = _better(mine, theirs, value, self.k)
        self.at, self.others, self.sim = mine[keep], theirs[keep], value[keep]
        full = np.flatnonzero(np.bincount(self.at, minlength=len(self.ids)) >= self.k)
        worst = np.full(len(self.ids), np.inf)
        np.minimum.at(worst, self.at, self.sim)
        self.least[full] = np.maximum(self.least[full], worst[full] - EPS)

    def rows(self) -> pd.DataFrame:
        if self.others is None:
            return pd.DataFrame({"model_id": [], "other": [], "sim": []})
        return pd.DataFrame({"model_id": self.ids[self.at], "other": self.others, "sim": self.sim})


def search(queries: DataFrame, targets: DataFrame, k: int, cosine: bool, same: bool, block: int = BLOCK_ROWS) -> DataFrame:
    """near(model_id, other, sim, pos): the k best targets of each query, exactly; ``same`` leaves out a row's own id.

    Targets lie in blocks by pivot and distance to it, queries in packs by their nearest block; both are written once. A task reads a
    pack and IN_TURN blocks, leaves out queries that a block is too far from, and keeps k rows for each query. So what is
    written grows with the rows, not with the blocks they visit. Where vectors have no structure, every pack compares with every block.
    """
    index = indexed(targets, block)
    if not len(index.pivots):
        return queries.select("model_id", F.col("model_id").alias("other"), F.lit(0.0).alias("sim"), F.lit(1).alias("pos")).limit(0)
    asked = bounded(queries, index, k, cosine, same, block)
    counts = asked.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("turns"))
    counts = cut_lineage(counts)
    n = counts.agg(F.sum("turns")).first()[0]
    if not n:
        return queries.select("model_id", F.col("model_id").alias("other"), F.lit(0.0).alias("sim"), F.lit(1).alias("pos")).limit(0)
    turn = (keyed_hash(0, "turn", F.col("model_id")) % F.col("turns")).cast("int")
    packs = _packed(asked.join(counts, "home").select("home", turn.alias("turn"), F.col("model_id").alias("id"), "emb", "least"), ["home", "turn"], "home", n)
    none = F.lit(None).cast("double").alias("least")
    blocks = _packed(index.rows.select("block", F.col("other").alias("id"), F.col("other_emb").alias("emb"), none), ["block"], "block", -(-len(index.part) // IN_TURN))
    plain = Index(index.pivots, None, index.part, index.low, index.high)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, found = None, None
        for p in batches:
            for q, t in zip(p["own"], p["other"], strict=True):
                if own is None or q["number"] != own["number"] or q["ids"][0] != own["ids"][0]:
                    if found is not None:
                        yield found.rows()
                    own, found = q, _Found(q, k, cosine, same)
                found.meet(t, plain)
        if found is not None:
            yield found.rows()

    both = packs.select(F.struct("*").alias("own")).hint("shuffle_replicate_nl").crossJoin(blocks.select(F.struct("number", "ids", "emb").alias("other")))
    kind, other = dict(queries.dtypes)["model_id"], dict(targets.dtypes)["model_id"]
    kept = both.mapInPandas(best, f"model_id {kind}, other {other}, sim double")
    return top_by(kept, ["model_id"], [F.round("sim", TIE_DIGITS).desc(), F.col("other")], k, "pos")


def neighbour_weights(near: DataFrame, metric: str = "cosine") -> DataFrame:
    """Adds ``w``: the clipped cosine or 1/(1 + distance); 1 for all when every neighbour is repelled."""
    w = F.greatest("sim", F.lit(0.0)) if metric == "cosine" else 1.0 / (1.0 - F.col("sim"))
    total = near.withColumn("w0", w).groupBy("model_id").agg(F.sum("w0").alias("tw"))
    return near.withColumn("w0", w).join(total, "model_id").withColumn(
        "w", F.when(F.col("tw") <= EPS, 1.0).otherwise(F.col("w0"))
    ).drop("w0", "tw")


def neighbour_predict(near: DataFrame, cells: DataFrame, value: str = "acc", metric: str = "cosine") -> DataFrame:
    """predicted(model_id, question_id, predicted): weighted mean of the neighbours' cells.

    An uncollected cell of a neighbour counts as 0, so the divisor is the whole weight. A neighbour's cells travel as one row, with
    numbers for the questions, and are listed where the model's neighbours have met.
    """
    w = cut_lineage(neighbour_weights(cut_lineage(near), metric))
    total = w.groupBy("model_id").agg(F.sum("w").alias("tw"))
    asked = cells.select("question_id").distinct().withColumn("h", keyed_hash(0, "axis", F.col("question_id")))
    axis = staged(hash_position(asked, [], "h", "question_id").select("question_id", F.col("pos").cast("int").alias("at")))
    row = F.collect_list(F.struct("at", F.col(value).cast("double").alias("v")))
    held = cells.join(axis, "question_id").groupBy(F.col("model_id").alias("other")).agg(row.alias("c"))
    held = held.select("other", F.col("c.at").alias("at"), F.col("c.v").alias("v"))
    met = w.join(total, "model_id").select("model_id", "other", "w", "tw").join(held, "other").select("model_id", "w", "tw", "at", "v")
    listed = met.repartition("model_id").select("model_id", "w", "tw", F.explode(F.arrays_zip("at", "v")).alias("c"))
    part = listed.groupBy("model_id", F.col("c.at").alias("at")).agg((F.sum(F.col("w") * F.col("c.v")) / F.first("tw")).alias("predicted"))
    return part.join(axis, "at").select("model_id", "question_id", "predicted")
