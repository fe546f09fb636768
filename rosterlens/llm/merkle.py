"""A Merkle manifest of a table: per-group trees, a tree over their roots, and proofs folded back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.session import staged

#: Nodes of a run, in production.
ARITY = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(*columns: Column) -> Column:
    """The columns in a row as unambiguous text: ``-`` for null, else byte count, ``:`` and value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the 0-based place of a row within its ``tree`` by ``order`` (nulls first), and ``n``, the tree's rows.

    Rows are dealt by ranges of (tree, order), so a tree with most of the rows lies in many tasks; only one row
    for each task and tree is added up.
    """
    dealt = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = staged(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    pieces = rows.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c"))
    # one row for each task a tree lies in
    totals = pieces.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("part", "first", "c"))).alias("held"))
    bases = totals.select(
        F.col("tree").alias("of"),
        F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("n"),
        F.explode(
            F.transform(
                "held",
                lambda x, i: F.struct(
                    x["part"].alias("part"),
                    x["first"].alias("first"),
                    F.aggregate(F.slice("held", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["c"]).alias("base"),
                ),
            )
        ).alias("piece"),
    ).select("of", "n", F.col("piece.part").alias("of_part"), "piece.first", "piece.base")
    both = F.col("tree").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    return rows.join(bases, both).select(*nodes.columns, (F.col("base") + F.col("row") - F.col("first")).alias("at"), "n")


def slots(at: Column, arity: int) -> Column:
    """The places of a node's run, computed from its own: by XOR in a binary tree, else by offsets of its slot."""
    if arity == 2:
        return F.sort_array(F.array(at, at.bitwiseXOR(F.lit(1))))
    first = at - F.pmod(at, F.lit(arity))
    return F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda k: first + k)


def runs_of(nodes: DataFrame, arity: int) -> DataFrame:
    """Runs (tree, at, n, digest, kids) over ``nodes(tree, at, n, kid)`` of trees with several nodes.

    The row in slot zero computes its siblings' places, which are equijoined with the nodes, and emits the parent.
    Places are unique in a tree, so no join key has more than one row on either side.
    """
    nodes = nodes.where("n > 1")
    heads = nodes.where(F.pmod("at", F.lit(arity)) == 0).select(
        F.col("tree").alias("of"), F.expr(f"at div {arity}").alias("parent"), F.explode(slots(F.col("at"), arity)).alias("want")
    )
    met = heads.join(nodes, F.col("of").eqNullSafe(F.col("tree")) & (F.col("want") == F.col("at")))
    runs = met.groupBy("tree", F.col("parent").alias("up")).agg(
        F.first("n").alias("below"), F.sort_array(F.collect_list(F.struct("at", "kid"))).alias("met")
    )
    return runs.select(
        "tree",
        F.col("up").alias("at"),
        F.ceil(F.col("below") / F.lit(arity)).cast("long").alias("n"),
        F.transform("met", lambda x: x["kid"]).alias("kids"),
    ).withColumn("digest", digest(joined(F.transform("kids", lambda k: k["digest"]))))


def grown(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of runs over ``leaves(tree, at, n, kid)``, and (tree, digest) of every tree with several leaves.

    ``kid`` is a struct with the node's digest; what else it holds stays with the leaf.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    nodes = leaves
    while most > 1:
        levels.append(staged(runs_of(nodes, arity)))
        nodes = levels[-1].select("tree", "at", "n", F.struct("digest").alias("kid"))
        most = -(-most // arity)
    roots = None
    for runs in levels:
        own = runs.where("n = 1").select("tree", "digest")
        roots = own if roots is None else roots.unionByName(own)
    return levels, roots if roots is not None else leaves.select("tree", F.col("kid.digest").alias("digest")).limit(0)


def _steps(runs: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """(tree, at, kid, path, more) of all nodes in ``runs``; ``above(of, up, path, more)`` belongs to the runs themselves."""
    digests = F.transform("kids", lambda k: k["digest"])
    both = F.col("tree").eqNullSafe(F.col("of")) & (F.col("at") == F.col("up"))
    rows = runs.join(above, both).select("tree", F.col("at").alias("parent"), digests.alias("all"), "path", "more", F.posexplode("kids").alias("slot", "kid"))
    step = F.struct(
        joined(F.slice("all", F.lit(1), F.col("slot"))).alias("before"),
        joined(F.slice("all", F.col("slot") + 2, F.lit(arity))).alias("after"),
    )
    return rows.select("tree", (F.col("parent") * arity + F.col("slot")).alias("at"), "kid", F.concat(F.array(step), "path").alias("path"), "more")


PATH = "array<struct<before:string,after:string>>"


def paths(leaves: DataFrame, levels: list[DataFrame], ends: DataFrame, arity: int) -> DataFrame:
    """(tree, at, kid, path, more) of every leaf: the siblings' digests before and after it, level by level.

    ``ends(of, path, more)`` continues the path above each tree's root. A path is built from the top, once for each
    run, and handed to the run's members, so what moves for a leaf is a sixteenth of its path.
    """
    same = F.col("tree").eqNullSafe(F.col("of"))

    def tops(nodes: DataFrame) -> DataFrame:
        return nodes.where("n = 1").join(ends, same)

    above = None
    for runs in reversed(levels):
        top = tops(runs.select("tree", "at", "n")).select("of", F.col("at").alias("up"), "path", "more")
        above = top if above is None else top.unionByName(above)
        kids = _steps(runs, above, arity)
        above = kids.select(F.col("tree").alias("of"), F.col("at").alias("up"), "path", "more")
    alone = tops(leaves).select("tree", "at", "kid", "path", "more")
    return alone if not levels else kids.unionByName(alone)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda a, s: digest(F.concat(s["before"], a, s["after"])))


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """One row per row of ``docs(doc_id, source, lang, n_chars, text, ...)``, with its place under one root.

    doc_id, leaf, subroot, root, proof (siblings' digests as one text), tampered, folded_root, verified. A leaf is
    the digest of the row's framed columns. Leaves of a source, in the order of doc_id, are put together by
    runs of ``arity`` until one node is left, the subroot; subroots in the order of source give the root in the same way.

    ``tampered`` is the leaf of a row whose text had its A-Z lower-cased, for rows whose doc_id's crc32 is divisible
    by 5 (else the leaf itself). ``folded_root`` is recomputed from it and the original siblings; ``verified`` says
    whether that is the root.

    Null columns are framed as ``-``, so they differ from empty ones. Rows without source are a source of their
    own, the first; within a source rows without doc_id come first and are never tampered with. Rows with one
    doc_id follow each other in the order of their leaves; equal rows are equal leaves, each with its own
    place and proof. Texts are hashed whole, whatever their length. An empty table gives no rows; further columns are ignored.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    c = {name: docs[name] for name in ("doc_id", "source", "lang", "n_chars", "text")}
    doc_id = c["doc_id"].cast("long")
    lowered = F.translate(c["text"], UPPER, LOWER)
    touched = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0
    rows = docs.select(
        c["source"].cast("string").alias("tree"),
        doc_id.alias("doc_id"),
        digest(framed(*c.values())).alias("digest"),
        F.when(touched, digest(framed(*{**c, "text": lowered}.values()))).alias("tampered"),
    )
    kid = F.struct("digest", "doc_id", "tampered").alias("kid")
    leaves = staged(numbered(rows, ["doc_id", "digest"]).select("tree", "at", "n", kid))
    levels, roots = grown(leaves, arity)
    lone = leaves.where("n = 1").select("tree", F.col("kid.digest").alias("digest"))
    subroots = roots.unionByName(lone).select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest")
    sources = staged(numbered(subroots, ["source"]).select("tree", "at", "n", F.struct("digest", "source").alias("kid")))
    upper, top = grown(sources, arity)
    top = top.unionByName(sources.where("n = 1").select("tree", F.col("kid.digest").alias("digest")))
    none = F.array().cast(PATH)
    ends = top.select(F.col("tree").alias("of"), none.alias("path"), F.struct(F.col("digest").alias("root")).alias("more"))
    of_sources = paths(sources, upper, ends, arity).select(
        F.col("kid.source").alias("of"), "path", F.struct(F.col("kid.digest").alias("subroot"), F.col("more.root").alias("root")).alias("more")
    )
    found = paths(leaves, levels, staged(of_sources), arity)
    leaf = F.col("kid.digest")
    siblings = joined(F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    out = found.select(
        F.col("kid.doc_id").alias("doc_id"),
        leaf.alias("leaf"),
        "more.subroot",
        "more.root",
        siblings.alias("proof"),
        F.coalesce("kid.tampered", leaf).alias("tampered"),
        folded(F.coalesce("kid.tampered", leaf), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
