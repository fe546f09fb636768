"""Portfolios of models under a weight budget: greedy max-coverage, random squads, their value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import HASH_SPAN, draw_index, hash_position, keyed_hash
from rosterlens.session import cut_lineage, staged, unstaged

MIN_GB = 1e-6
#: Budgets in GB, the one in the headline, half-splits, random squads a walk and permuted banks a half-split. Fixed values.
BUDGETS, HEADLINE = (24.0, 48.0, 80.0, 160.0), 24.0
DRAWS, SQUADS, PERMUTED = 10, 20, 40
#: Candidates that a slice offers a walk in a round, cells of a slice, models of a stretch of a squad's order.
OFFERS, SLICE_CELLS, STRETCH = 128, 2_000_000, 32_768


def packed(rows: DataFrame, axis: DataFrame) -> DataFrame:
    """(bank, model_id, pos, a): the rows(bank, model_id, question_id, a) of a model as two arrays; axis(question_id, pos) counts from 1."""
    held = rows.where("a is not null").join(axis, "question_id").groupBy("bank", "model_id").agg(F.collect_list(F.struct("pos", F.col("a").cast("double").alias("a"))).alias("c"))
    return held.select("bank", "model_id", F.col("c.pos").cast("array<int>").alias("pos"), F.col("c.a").alias("a"))


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows of which some lack a column; ids stay whole numbers beside missing ones."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})


def question_axis(rows: DataFrame) -> DataFrame:
    """axis(question_id, pos): questions numbered from 1 in a hashed order."""
    named = rows.select("question_id").distinct().withColumn("__h", keyed_hash(0, "axis", F.col("question_id")))
    return staged(hash_position(named, [], "__h", "question_id").select("question_id", F.col("pos").cast("int").alias("pos")))


def greedy(rows: DataFrame, cost: DataFrame, walks: DataFrame, offers: int = OFFERS, cells: int = SLICE_CELLS) -> DataFrame:
    """(walk, step, model_id, gb) of the picks of every walk: most gain per weight first, while affordable and gaining.

    rows(bank, model_id, question_id, a), cost(model_id, gb), walks(walk, bank, budget): a walk reads one bank under one
    budget. Ratios are rounded to 12 digits; ties go to the higher id. A single model better than the whole squad replaces it.
    ``greedy_packed`` says how it walks.
    """
    axis = question_axis(rows)
    return greedy_packed(packed(rows, axis), axis, cost, walks, None, offers, cells)


def greedy_packed(
    vectors: DataFrame, axis: DataFrame, cost: DataFrame, walks: DataFrame, halves: DataFrame | None = None, offers: int = OFFERS, cells: int = SLICE_CELLS
) -> DataFrame:
    """``greedy`` on vectors(bank, model_id, pos, a). A walk with a ``part`` reads only the questions of it in halves(part, question_id).

    All walks go on together, in rounds. In a round every slice of a bank offers each walk its best candidates by what they gain
    now; then a walk takes steps among them. Gains only shrink, so a candidate that a slice holds back gains no more than the
    last one it offered: a walk goes on as long as its best candidate is not below the highest of those lines, and then
    asks for new offers. Every pick is the one a walk over all candidates would take.
    """
    kind = dict(vectors.dtypes)["model_id"]
    width = axis.agg(F.max("pos")).first()[0] or 0
    vectors = vectors.join(cost.where("gb is not null").select("model_id", F.col("gb").cast("double").alias("gb")), "model_id")
    vectors = staged(vectors.select("bank", "model_id", "gb", "pos", "a"))
    most = vectors.groupBy("bank").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    slices = max(1, -(-most * width // cells))
    sliced = vectors.withColumn("slice", F.pmod(F.xxhash64("model_id"), F.lit(slices)).cast("int"))
    first = walks.select("walk", "bank", F.col("budget").cast("double").alias("room"))
    if halves is not None:
        own = halves.join(axis, "question_id").groupBy("part").agg(F.collect_list("pos").alias("seen"))
        first = walks.select("walk", "bank", F.col("budget").cast("double").alias("room"), "part").join(own, "part", "left")
    else:
        first = first.withColumn("seen", F.lit(None).cast("array<int>"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("held", "array<double>"), ("lone", kind), ("lone_gb", "double"), ("lone_t", "double"))]
    state = staged(first.select("walk", "bank", "room", F.lit(0).alias("step"), "seen", *none))
    columns = list(state.columns)
    part = halves is not None

    def grid(p: pd.DataFrame) -> np.ndarray:
        m = np.full((len(p), width), np.nan)
        for i, (pos, a) in enumerate(zip(p["pos"], p["a"], strict=True)):
            m[i, np.asarray(pos, np.int64) - 1] = a
        return m

    def seen(s) -> np.ndarray:
        return (np.array([] if s.seen is None else s.seen, np.int64) - 1) if part else np.arange(width)

    def covered(s, at: np.ndarray) -> np.ndarray:
        return np.full(len(at), np.nan) if s.held is None else np.asarray(s.held, float)

    def ratios(m: np.ndarray, held: np.ndarray, gb: np.ndarray) -> np.ndarray:
        gain = np.nansum(np.maximum(m - np.nan_to_num(held), 0), axis=1)
        return np.round(gain / np.maximum(gb, MIN_GB), 12)

    def offer(key: tuple, p: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out = [_frame([], ["walk", "model_id", "gb", "pos", "a", "last", "more", "t"])]
        p = p.sort_values("model_id").reset_index(drop=True)
        m, gb = grid(p), p["gb"].to_numpy(float)
        for s in states.itertuples():
            at = seen(s)
            own = m[:, at]
            now = np.where(gb <= s.room, ratios(own, covered(s, at), gb), 0.0)
            good = np.flatnonzero(now > 0)
            order = good[np.lexsort((good, now[good]))[::-1]]
            kept = order[:offers]
            frame = p.loc[kept, ["model_id", "gb", "pos", "a"]].assign(walk=s.walk, last=now[kept], more=len(order) > len(kept), t=np.nan)
            frame["more"] = frame["more"] & (np.arange(len(frame)) == len(frame) - 1)
            out.append(frame)
            if s.step == 0 and len(p):  # the best model by itself: it may beat the squad
                there = (gb <= s.room) & ~np.isnan(own).all(axis=1)
                if there.any():
                    t = np.where(there, np.round(np.nansum(own, axis=1), 12), -np.inf)
                    i = int(np.argmax(t))  # the lowest id of equals
                    out.append(p.loc[[i], ["model_id", "gb", "pos", "a"]].assign(walk=s.walk, last=np.nan, more=False, t=t[i]))
        return pd.concat(out[1:] or out)[["walk", "model_id", "gb", "pos", "a", "last", "more", "t"]]

    def advance(key: tuple, states: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(states):
            return _frame([], ["kind", *columns, "model_id", "gb"])
        s = next(states.itertuples())
        at = seen(s)
        held, room, step = covered(s, at), float(s.room), int(s.step)
        lone, lone_gb, lone_t = s.lone, s.lone_gb, s.lone_t
        alone = found[found["t"].notna()].sort_values(["t", "model_id"], ascending=[False, True])
        if len(alone):
            lone, lone_gb, lone_t = alone["model_id"].iloc[0], alone["gb"].iloc[0], alone["t"].iloc[0]
        p = found[found["t"].isna()].sort_values("model_id").reset_index(drop=True)
        m, gb, ids = grid(p)[:, at], p["gb"].to_numpy(float), p["model_id"].to_numpy()
        line = max(((x.last, x.model_id) for x in p[p["more"].astype(bool)].itertuples()), default=None)
        out, begun, open_ = [], step, False
        while len(p):
            now = np.where(gb <= room, ratios(m, held, gb), 0.0)
            i = len(now) - 1 - int(np.argmax(now[::-1]))  # the highest id of equals
            if now[i] <= 0 and line is None:
                break
            if line is not None and step > begun and (now[i], ids[i]) < line:
                open_ = True
                break
            if now[i] <= 0:
                break
            room, held = room - gb[i], np.fmax(held, m[i])
            out.append({"kind": 0, "walk": s.walk, "step": step, "model_id": ids[i], "gb": gb[i]})
            step += 1
        if open_:
            out.append({"kind": 1, "walk": s.walk, "bank": s.bank, "room": room, "step": step, "seen": s.seen, "held": held.tolist(), "lone": lone, "lone_gb": lone_gb, "lone_t": lone_t})
        elif lone is not None and not pd.isna(lone) and lone_t > (np.nansum(held) if step else -1.0) + 1e-9:
            out.append({"kind": 2, "walk": s.walk, "step": 0, "model_id": lone, "gb": lone_gb})
        return _frame(out, ["kind", *columns, "model_id", "gb"])

    of = {f.name: f.dataType.simpleString() for f in state.schema}
    moved = ", ".join(["kind int", *[f"{n} {t}" for n, t in of.items()], f"model_id {kind}", "gb double"])
    offered = f"walk {of['walk']}, model_id {kind}, gb double, pos array<int>, a array<double>, last double, more boolean, t double"
    rounds, used = [], [vectors]
    while not state.isEmpty():
        spread = state.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        asked = sliced.join(state.select("bank").distinct(), "bank", "left_semi")
        shown = asked.groupBy("bank", "slice").cogroup(spread.groupBy("bank", "slice")).applyInPandas(offer, offered)
        got = staged(state.groupBy("walk").cogroup(shown.groupBy("walk")).applyInPandas(advance, moved))
        rounds.append(got.where("kind <> 1").select("kind", "walk", "step", "model_id", "gb"))
        used += [state, got]
        state = staged(got.where("kind = 1").select(*columns))
    every = state.select(F.lit(0).alias("kind"), "walk", "step", F.col("lone").alias("model_id"), F.col("lone_gb").alias("gb"))
    for r in rounds:
        every = every.unionByName(r)
    every = staged(every)
    for x in used:
        unstaged(x)
    over = every.where("kind = 2").drop("kind")
    return every.where("kind = 0").drop("kind").join(over.select("walk"), "walk", "left_anti").unionByName(over)


def squad_rows(rows: DataFrame, squads: DataFrame) -> DataFrame:
    """(walk, question_id, best): the best accuracy of each squad of squads(walk, bank, model_id) on each question it covers."""
    own = squads.select("walk", "bank", "model_id").join(rows.select("bank", "model_id", "question_id", "a"), ["bank", "model_id"])
    return own.groupBy("walk", "question_id").agg(F.max("a").alias("best"))


def random_squads_of(cost: DataFrame, walks: DataFrame, squads: int, seed: int) -> DataFrame:
    """members(walk, squad, model_id, gb) of ``squads`` random squads for each of walks(walk, draw, budget, size).

    Models in a hashed order, each taken if it still fits, up to the walk's size. An order belongs to (draw, squad), so walks
    of one draw under different budgets read the same orders. Orders are read in stretches of their hash; all squads run through
    one stretch together.
    """
    kind = dict(cost.dtypes)["model_id"]
    state = walks.where("size > 0").select("walk", "draw", F.col("size").cast("int").alias("size"), F.col("budget").cast("double").alias("room"), draw_index(1, squads).alias("squad"))
    state = staged(state)
    columns, of = list(state.columns), {f.name: f.dataType.simpleString() for f in state.schema}
    known = cost.where("gb is not null").agg(F.count(F.lit(1)).alias("n"), F.min("gb").alias("least")).first()
    stretches, least = max(1, -(-known["n"] // STRETCH)), known["least"]
    drawn = staged(state.select("draw", "squad").distinct())
    order = cost.where("gb is not null").select("model_id", F.col("gb").cast("double").alias("gb"), draw_index(1, squads).alias("squad")).join(drawn, "squad")
    order = order.withColumn("h", keyed_hash(seed, "squad", F.col("draw"), F.col("squad"), F.col("model_id")))
    order = staged(order.withColumn("stretch", F.floor(F.col("h") / F.lit(HASH_SPAN // stretches + 1)).cast("int")))

    def take(key: tuple, states: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("h")
        gb, ids, out = p["gb"].to_numpy(float), p["model_id"].to_numpy(), []
        for s in states.itertuples():
            room, left, at = float(s.room), int(s.size), 0
            while left:
                fits = np.flatnonzero(gb[at:] <= room)
                if not len(fits):
                    break
                at += int(fits[0])
                out.append({"member": True, "walk": s.walk, "squad": s.squad, "model_id": ids[at], "gb": gb[at]})
                room, left, at = room - gb[at], left - 1, at + 1
            if left and room >= least:
                out.append({"member": False, "walk": s.walk, "draw": s.draw, "size": left, "room": room, "squad": s.squad})
        return _frame(out, ["member", *columns, "model_id", "gb"])

    schema = ", ".join(["member boolean", *[f"{n} {t}" for n, t in of.items()], f"model_id {kind}", "gb double"])
    members = state.limit(0).select("walk", "squad", F.lit(None).cast(kind).alias("model_id"), F.lit(None).cast("double").alias("gb"))
    for i in range(stretches):
        got = staged(state.groupBy("draw", "squad").cogroup(order.where(F.col("stretch") == i).groupBy("draw", "squad")).applyInPandas(take, schema))
        members = members.unionByName(got.where("member").select("walk", "squad", "model_id", "gb"))
        state = got.where("not member").select(*columns)
    return members


def random_squads(cost: DataFrame, budget: float, size: int, squads: int, seed: int) -> DataFrame:
    """members(squad, model_id, gb): per squad, models in a hashed order, each taken if it still fits.

    Taking the next model that fits, for all squads at once, is one aggregate per seat.
    """
    order = cut_lineage(
        cost.select("model_id", "gb", draw_index(1, squads).alias("squad")).withColumn(
            "h", keyed_hash(seed, "squad", F.col("squad"), F.col("model_id"))
        )
    )
    state = order.select("squad").distinct().select("squad", F.lit(-1).cast("bigint").alias("at"), F.lit(float(budget)).alias("room"))
    members = None
    for _ in range(size):
        nxt = (
            order.join(state, "squad")
            .filter((F.col("h") > F.col("at")) & (F.col("gb") <= F.col("room")))
            .groupBy("squad", "room")
            .agg(F.min_by(F.struct("model_id", "gb", "h"), "h").alias("p"))
        )
        seat = cut_lineage(nxt.select("squad", "p.model_id", "p.gb", F.col("p.h").alias("at"), (F.col("room") - F.col("p.gb")).alias("room")))
        taken = seat.select("squad", "model_id", "gb")
        members = taken if members is None else members.unionByName(taken)
        state = seat.select("squad", "at", "room")
    return members


def squad_values(rows: DataFrame, squads: DataFrame, n_questions: int) -> DataFrame:
    """(squad, value): mean over the questions of each squad's best accuracy."""
    best = squads.join(rows, "model_id").groupBy("squad", "question_id").agg(F.max("a").alias("best"))
    every = squads.select("squad").distinct()
    return every.join(best.groupBy("squad").agg(F.sum("best").alias("s")), "squad", "left").select(
        "squad", (F.coalesce("s", F.lit(0.0)) / n_questions).alias("value")
    )
