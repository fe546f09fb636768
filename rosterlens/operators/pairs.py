"""Winner/loser pairs from correctness bits, and strengths fitted to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import hash_position, hash_prefix_sum, keyed_hash
from rosterlens.session import cut_lineage


def correctness_pairs(cells: DataFrame, n_pairs: int, seed: int) -> DataFrame:
    """pairs(question_id, i, winner, loser): ``n_pairs`` preferences without ties.

    A question with r right and w wrong models holds r * w of them. When all questions together
    hold no more than ``n_pairs``, every pair comes out once. Otherwise each question gets its
    share of the draws (running totals of r * w, rounded so that they add up to ``n_pairs``) and
    the two ends of a draw are picked by keyed hash. Pairs are addressed by position, so the
    full set is never listed.
    """
    per_q = cells.groupBy("question_id").agg(
        F.sum("correct").alias("right"), F.sum(1 - F.col("correct")).alias("wrong")
    )
    per_q = per_q.withColumn("w", (F.col("right") * F.col("wrong")).cast("double")).filter("w > 0")
    total = per_q.agg(F.sum("w")).scalar()
    run = hash_prefix_sum(
        per_q.withColumn("__h", keyed_hash(seed, "pair-q", F.col("question_id"))), [], "__h", "question_id", "w", "cum"
    ).withColumn("total", total)
    every = F.col("total") <= n_pairs
    share = F.floor(F.col("cum") / F.col("total") * n_pairs) - F.floor((F.col("cum") - F.col("w")) / F.col("total") * n_pairs)
    drawn = (
        run.withColumn("draws", F.when(every, F.col("w")).otherwise(share).cast("bigint"))
        .filter("draws > 0")
        .select("question_id", "right", "wrong", every.alias("every"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("draws") - 1)).alias("i"))
    )

    def pick(side: str, n: str, exact) -> object:
        return F.when(F.col("every"), exact).otherwise(
            keyed_hash(seed, "pair-" + side, F.col("question_id"), F.col("i")) % F.col(n)
        ) + 1

    drawn = drawn.withColumn("win_pos", pick("win", "right", F.floor(F.col("i") / F.col("wrong")))).withColumn(
        "lose_pos", pick("lose", "wrong", F.col("i") % F.col("wrong"))
    )
    placed = hash_position(
        cells.select("question_id", "correct", "model_id").withColumn(
            "__h", keyed_hash(seed, "pair-m", F.col("question_id"), F.col("model_id"))
        ),
        ["question_id", "correct"],
        "__h",
        "model_id",
    )
    winners = placed.filter("correct = 1").select("question_id", F.col("pos").alias("win_pos"), F.col("model_id").alias("winner"))
    losers = placed.filter("correct = 0").select("question_id", F.col("pos").alias("lose_pos"), F.col("model_id").alias("loser"))
    return (
        drawn.join(winners, ["question_id", "win_pos"])
        .join(losers, ["question_id", "lose_pos"])
        .select("question_id", "i", "winner", "loser")
    )


def bradley_terry(pairs: DataFrame, steps: int = 20, prior: float = 1.0) -> DataFrame:
    """strength(model_id, strength, wins, games): log strengths by minorise-maximise steps.

    ``prior`` adds that many games, half won, against an opponent of strength 1, which keeps
    undefeated models finite. A step is two joins and one aggregate.
    """
    met = cut_lineage(
        pairs.groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n"))
    )
    sides = met.select(F.col("winner").alias("model_id"), F.col("loser").alias("other"), "n", F.col("n").alias("won")).unionByName(
        met.select(F.col("loser").alias("model_id"), F.col("winner").alias("other"), "n", F.lit(0).cast("bigint").alias("won"))
    )
    sides = cut_lineage(sides.groupBy("model_id", "other").agg(F.sum("n").alias("n"), F.sum("won").alias("won")))
    record = cut_lineage(sides.groupBy("model_id").agg(F.sum("won").alias("wins"), F.sum("n").alias("games")))
    p = record.select("model_id", F.lit(1.0).alias("p"))
    for _ in range(steps):
        other = p.select(F.col("model_id").alias("other"), F.col("p").alias("po"))
        load = (
            sides.join(p, "model_id").join(other, "other")
            .groupBy("model_id")
            .agg(F.sum(F.col("n") / (F.col("p") + F.col("po"))).alias("load"), F.first("p").alias("p"))
        )
        p = cut_lineage(
            load.join(record, "model_id").select(
                "model_id", ((F.col("wins") + prior / 2) / (F.col("load") + prior / (F.col("p") + 1.0))).alias("p")
            )
        )
    return p.join(record, "model_id").select("model_id", F.ln("p").alias("strength"), "wins", "games")
