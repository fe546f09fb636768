"""Joining published labels onto models by folded names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.ranks import top_by
from rosterlens.functions.scalars import match_key, repo_key


def published_keys(published: DataFrame) -> DataFrame:
    """keys(key, source, n_names) of published(name, pos): the first name wins a shared key."""
    return published.groupBy(match_key(F.col("name")).alias("key")).agg(
        F.min_by("name", "pos").alias("source"), F.countDistinct("name").alias("n_names")
    )


def unambiguous(published: DataFrame) -> DataFrame:
    """Published rows whose folded key only one name claims; the others are refused."""
    keyed = published.withColumn("key", match_key(F.col("name")))
    single = keyed.groupBy("key").agg(F.countDistinct("name").alias("n")).filter("n = 1")
    return keyed.join(single, "key", "left_semi").drop("key")


def match_models(models: DataFrame, published: DataFrame, aliases: DataFrame) -> DataFrame:
    """match(model_id, name, source, via_alias): exact folded key first, then alias, never fuzzy.

    aliases(published, model, pos); of several aliases for one model the last listed counts.
    """
    keys = published_keys(published).select("key", "source")
    folded = aliases.select(
        match_key(F.col("published")).alias("pub_key"), match_key(F.col("model")).alias("key"), "pos"
    )
    via = (
        folded.join(keys.withColumnsRenamed({"key": "pub_key", "source": "alias_source"}), "pub_key")
        .groupBy("key")
        .agg(F.max_by("alias_source", "pos").alias("alias_source"))
    )
    return (
        models.withColumn("key", match_key(F.col("name")))
        .join(keys, "key", "left")
        .join(via, "key", "left")
        .select(
            "model_id",
            "name",
            F.coalesce("source", "alias_source").alias("source"),
            (F.col("source").isNull() & F.col("alias_source").isNotNull()).cast("int").alias("via_alias"),
        )
    )


def match_counts(match: DataFrame, published: DataFrame) -> DataFrame:
    n_published = published_keys(published).agg(F.count(F.lit(1))).scalar()
    hit = F.col("source").isNotNull()
    return match.agg(
        F.count_if(hit & (F.col("via_alias") == 0)).alias("n_exact"),
        F.count_if(hit & (F.col("via_alias") == 1)).alias("n_alias"),
        F.count_if(hit).alias("n_matched"),
        F.count_if(~hit).alias("n_unmatched_models"),
    ).select("*", n_published.alias("n_published"))


def unmatched_published(match: DataFrame, published: DataFrame, aliases: DataFrame) -> DataFrame:
    """First names of keys no model claims, by its own key or through an alias."""
    own = match.select(match_key(F.col("name")).alias("key"))
    keys = published_keys(published)
    folded = aliases.select(match_key(F.col("published")).alias("key"), match_key(F.col("model")).alias("model_key"))
    # an alias only claims for a model that had no exact match
    open_models = own.join(keys, "key", "left_anti").withColumnRenamed("key", "model_key")
    claimed = own.unionByName(folded.join(open_models, "model_key", "left_semi").select("key")).distinct()
    return keys.join(claimed, "key", "left_anti").select("source")


def label_column(models: DataFrame, board: DataFrame, aliases: DataFrame) -> DataFrame:
    """label(model_id, value) of board(name, pos, value); ambiguous keys refused, unlisted NULL."""
    clean = unambiguous(board)
    match = match_models(models, clean, aliases)
    value = clean.groupBy(F.col("name").alias("source")).agg(F.min_by("value", "pos").alias("value"))
    return match.join(value, "source", "left").select("model_id", "value")


def contrast_column(models: DataFrame, board: DataFrame, minus: DataFrame, aliases: DataFrame) -> DataFrame:
    """metric - minus_metric within the model; NULL where either is missing."""
    a = label_column(models, board, aliases)
    b = label_column(models, minus, aliases).withColumnRenamed("value", "minus")
    return a.join(b, "model_id").select("model_id", (F.col("value") - F.col("minus")).alias("value"))


def select_footprints(models: DataFrame, entries: DataFrame) -> DataFrame:
    """The one footprint entry per model, joined on bare repository names.

    Measured entries first, then an exact directory match, then the directory name, then listing
    order. Both names of an entry are candidate keys; the choice is an aggregate, not a sort.
    """
    keyed = entries.withColumn(
        "key",
        F.explode(F.array_compact(F.array_distinct(F.array(repo_key(F.coalesce("dir", F.lit(""))), repo_key(F.col("hf_id")))))),
    )
    wanted = models.select("model_id", repo_key(F.col("name")).alias("key"))
    rank = F.struct(
        F.col("status").isNotNull().cast("int"),
        (repo_key(F.coalesce("dir", F.lit(""))) != F.col("key")).cast("int"),
        F.coalesce("dir", F.lit("")),
        F.col("pos"),
    )
    fields = [c for c in entries.columns]
    best = keyed.join(wanted, "key").groupBy("model_id").agg(F.min_by(F.struct(*fields), rank).alias("e"))
    return best.select("model_id", "e.*")


def prefix_dates(benchmarks: DataFrame, suites: DataFrame, bench: str) -> DataFrame:
    """Adds ``published``: the date of the longest suite that is the benchmark or a prefix before "_".

    The candidate prefixes of a name are few, so they are listed and joined by equality.
    """
    parts = F.split(bench, "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_")
    )
    cand = benchmarks.select(bench).distinct().select(bench, F.explode(prefixes).alias("suite"))
    best = (
        cand.join(suites, "suite")
        .groupBy(bench)
        .agg(F.max_by("date", F.length("suite")).alias("published"))
    )
    return benchmarks.join(best, bench, "left").withColumn("published", F.coalesce("published", F.lit("")))


def class_counts(labels: DataFrame, cls: str, unknown: str = "unknown") -> DataFrame:
    return labels.filter(F.col(cls) != unknown).groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def usable_classes(labels: DataFrame, cls: str, min_members: int) -> DataFrame:
    return class_counts(labels, cls).filter(F.col("n") >= min_members)


def correctness_residual(measures: DataFrame, train: Column, ridge: float = 1e-6, min_rows: int = 4) -> DataFrame:
    """Adds ``residual``: a score with the effect of the correctness bit removed, per question.

    The two-coefficient ridge has a closed form in five sums over the training rows, so the fit
    is one aggregate. Without contrast only the mean is removed; below ``min_rows`` it is NULL.
    """
    y, c = F.when(train, F.col("rm")), F.when(train, F.col("correct").cast("double"))
    both = y.isNotNull() & c.isNotNull()
    y, c = F.when(both, y), F.when(both, c)
    fit = measures.groupBy("question_id").agg(
        F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(c).alias("sc"), F.sum(c * c).alias("scc"),
        F.sum(c * y).alias("scy"), F.min(c).alias("lo"), F.max(c).alias("hi"),
    )
    lam = F.lit(ridge) * (F.col("n") + F.col("scc")) / 2.0
    a, b, d = F.col("n") + lam, F.col("sc"), F.col("scc") + lam
    det = a * d - b * b
    fit = fit.select(
        "question_id", "n",
        (F.col("hi") - F.col("lo") < 1e-9).alias("flat"),
        F.try_divide("sy", "n").alias("mean_y"),
        F.try_divide("sc", "n").alias("mean_c"),
        F.try_divide(d * F.col("sy") - b * F.col("scy"), det).alias("b0"),
        F.try_divide(a * F.col("scy") - b * F.col("sy"), det).alias("b1"),
    )
    cj = F.coalesce(F.col("correct").cast("double"), F.col("mean_c"))
    residual = F.when(F.col("n") < min_rows, None).when(F.col("flat"), F.col("rm") - F.col("mean_y")).otherwise(
        F.col("rm") - (F.col("b0") + F.col("b1") * cj)
    )
    return measures.join(fit, "question_id").withColumn("residual", residual).drop(
        "n", "flat", "mean_y", "mean_c", "b0", "b1"
    )


def residual_out_of_fold(measures: DataFrame, plan: DataFrame, ridge: float = 1e-6, min_rows: int = 4) -> DataFrame:
    """Adds ``residual`` as `correctness_residual` does, every row by a fit that saw no model of its fold; ``plan(model_id, fold)``.

    The sums of a question's two-coefficient ridge are kept by fold, so a fold's fit is the total less its own sums: one
    aggregate for all folds, and no fit is run per fold. A cell without correctness stands at the fit's mean.
    """
    rows = measures.join(plan.select("model_id", "fold"), "model_id")
    y, c = F.col("rm"), F.col("correct").cast("double")
    both = y.isNotNull() & c.isNotNull()
    y, c = F.when(both, y), F.when(both, c)
    terms = {"n": F.count(y), "sy": F.sum(y), "sc": F.sum(c), "scc": F.sum(c * c), "scy": F.sum(c * y)}
    own = rows.groupBy("question_id", "fold").agg(*[F.coalesce(t, F.lit(0)).alias(k) for k, t in terms.items()])
    total = own.groupBy("question_id").agg(*[F.sum(k).alias(f"all_{k}") for k in terms])
    fit = own.join(total, "question_id").select("question_id", "fold", *[(F.col(f"all_{k}") - F.col(k)).alias(k) for k in terms])
    lam = F.lit(ridge) * (F.col("n") + F.col("scc")) / 2.0
    a, b, d = F.col("n") + lam, F.col("sc"), F.col("scc") + lam
    det = a * d - b * b
    fit = fit.select(
        "question_id", "fold", "n",
        # a bit that is everywhere the same: its spread n * scc - sc^2 is 0
        (F.col("n") * F.col("scc") - b * b <= 1e-9 * F.greatest(F.col("n") * F.col("scc"), F.lit(1.0))).alias("flat"),
        F.try_divide("sy", "n").alias("mean_y"),
        F.try_divide("sc", "n").alias("mean_c"),
        F.try_divide(d * F.col("sy") - b * F.col("scy"), det).alias("b0"),
        F.try_divide(a * F.col("scy") - b * F.col("sy"), det).alias("b1"),
    )
    cj = F.coalesce(F.col("correct").cast("double"), F.col("mean_c"))
    residual = F.when(F.col("n") < min_rows, None).when(F.col("flat"), F.col("rm") - F.col("mean_y")).otherwise(
        F.col("rm") - (F.col("b0") + F.col("b1") * cj)
    )
    out = rows.join(fit, ["question_id", "fold"]).withColumn("residual", residual)
    return out.drop("n", "flat", "mean_y", "mean_c", "b0", "b1")


def labels_long(models: DataFrame, boards: DataFrame, aliases: DataFrame) -> DataFrame:
    """(board, model_id, value) of every board at once; only listed models have a row.

    The same rules as ``label_column``: ambiguous keys refused per board, exact before alias.
    """
    keyed = boards.withColumn("key", match_key(F.col("name")))
    clean = keyed.groupBy("board", "key").agg(
        F.countDistinct("name").alias("n"), F.min_by("value", "pos").alias("value")
    ).filter("n = 1").select("board", "key", "value")
    folded = aliases.select(
        match_key(F.col("published")).alias("pub_key"), match_key(F.col("model")).alias("key"), "pos"
    )
    via = (
        folded.join(clean.withColumnRenamed("key", "pub_key"), "pub_key")
        .groupBy("board", "key")
        .agg(F.max_by("value", "pos").alias("value"))
    )
    names = models.select("model_id", match_key(F.col("name")).alias("key"))
    both = clean.withColumn("how", F.lit(0)).unionByName(via.withColumn("how", F.lit(1)))
    return both.join(names, "key").groupBy("board", "model_id").agg(F.min_by("value", "how").alias("value"))


def shortlist(labels: DataFrame, floor: int = 20, k: int = 10) -> DataFrame:
    """The first board (lowest ``pos``) with enough rows, its top min(k, n/3) models labelled 1.

    labels(board, pos, model_id, value); returns (board, model_id, value, label, k).
    """
    rows = labels.filter(F.col("value").isNotNull())
    chosen = (
        rows.groupBy("board", "pos")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= floor)
        .agg(F.min_by(F.struct("board", F.least(F.lit(k), F.floor(F.col("n") / 3)).alias("k")), "pos").alias("c"))
        .select("c.board", "c.k")
    )
    listed = rows.join(chosen, "board").drop("pos")
    top = (
        top_by(listed, ["board"], [F.col("value").desc(), F.col("model_id")], k, "rn")
        .filter(F.col("rn") <= F.col("k"))
        .select("model_id", F.lit(1).alias("label"))
    )
    return listed.join(top, "model_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
