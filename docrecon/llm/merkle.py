"""Merkle manifest of a dataset: a hash tree over all rows and an inclusion proof for every row.

Rows of a group are leaves in ascending order; every two consecutive nodes have a parent, up to the
group's subroot.  The subroots, in order of their group, are the leaves of one more tree, whose top
is the root.

Nodes carry nested intervals: a node at a level covers the leaf ranks ``[lo, hi)``.  Intervals of a
level have one width, so ``lo`` divided by it names a bucket, and a leaf meets its ancestor of that
level in a join on the bucket, kept where the interval contains the leaf's rank.  A parent's interval
without the node's own is the interval of the sibling, which a join on the bounds finds.

Trees grow ``STRIDE`` levels at a time: a group of 2**STRIDE neighbours is one row, whatever the
rows of a group.  Nothing but one number and the root reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.common import forget, settled

STRIDE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<sibling binary, left boolean>>"


def hashed(*parts: Column) -> Column:
    """SHA-256 of the parts, concatenated, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def shown(digest: Column) -> Column:
    """A digest as it is hashed and shown: lower-case hex."""
    return F.lower(F.hex(digest))


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of a row: of each field ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return hashed(*[part(f) for f in fields])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    def up(node: Column, step: Column) -> Column:
        own, other = shown(node), shown(step["sibling"])
        return F.when(step["sibling"].isNull(), hashed(own)).when(step["left"], hashed(other, own)).otherwise(
            hashed(own, other))

    return F.aggregate(proof, leaf, up)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``rank`` within ``key``, from 0 in ascending order, and ``n``, the rows of the key.

    ``rows`` must be a written table.  A key may hold any part of the rows: they are sorted by range
    over all tasks, and ranks start from the counts of the ranges before.  Rows equal in all of
    ``order`` are dealt out by their place, so they share no task.
    """
    placed = settled(
        rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange("key", *order, "_tie").sortWithinPartitions("key", *order, "_tie").drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-placed")
    runs = placed.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settled(runs.select(
        "key", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
        F.sum("_rows").over(whole).alias("n")), "merkle-starts")
    out = settled(placed.join(starts, ["key", "_part"]).select(
        *rows.columns, (F.col("_at") + F.col("_start")).alias("rank"), "n"), "merkle-ranked")
    forget(placed, starts)
    return out


def raised(base: DataFrame, height: int) -> DataFrame:
    """Groups of 2**STRIDE nodes with all levels above them, up to STRIDE, in ``levels``.

    ``base``: (key, leaves, rank, n, digest), ``n`` nodes of the key at this height.  A level exists
    while the key has more than one node below it, so a short last group is raised with the others.
    """
    groups = base.groupBy("key", "leaves", "n", F.shiftright("rank", STRIDE).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("nodes"))

    def level(done: Column, k: Column) -> Column:
        below = F.element_at(done, -1)
        pairs = F.transform(
            F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)),
            lambda i: hashed(shown(F.get(below, 2 * i)), F.coalesce(shown(F.get(below, 2 * i + 1)), F.lit(""))))
        return F.when(F.col("n") > F.pow(F.lit(2.0), k - 1), F.concat(done, F.array(pairs))).otherwise(done)

    levels = F.aggregate(F.sequence(F.lit(1), F.lit(STRIDE)), F.array("nodes"), level)
    return settled(groups.select("key", "leaves", "n", "block", levels.alias("levels")), f"merkle-{height}")


def intervals(stratum: DataFrame, height: int) -> DataFrame:
    """Nodes that have a parent, labelled with the leaf ranks they cover, and their siblings.

    ``(key, step, bucket, lo, hi, sibling, left)``: ``step`` is the level above ``height``; the
    sibling is null where the parent covers no more than the node.
    """
    flat = stratum.select("key", "leaves", "n", "block", F.posexplode("levels").alias("step", "row")).where(
        (F.col("step") < STRIDE) & (F.col("n") > F.pow(F.lit(2.0), F.col("step"))))
    nodes = flat.select("key", "leaves", "step", F.expr(f"shiftleft(block, {STRIDE} - step)").alias("start"),
                        F.posexplode("row").alias("i", "digest"))
    nodes = nodes.select("key", "leaves", "step", "digest", (F.col("start") + F.col("i")).alias("bucket"))
    width = F.expr(f"shiftleft(1L, {height} + step)")
    nodes = nodes.select(
        "key", "step", "bucket", "digest", (F.col("bucket") * width).alias("lo"),
        F.least((F.col("bucket") + 1) * width, "leaves").alias("hi"),
        (F.col("bucket") - F.col("bucket") % 2).alias("low"), width.alias("width"), "leaves")
    # The parent's interval [p_lo, p_hi) without the node's own is the sibling's.
    p_lo, p_hi = F.col("low") * F.col("width"), F.least((F.col("low") + 2) * F.col("width"), F.col("leaves"))
    nodes = settled(nodes.select(
        "key", "step", "bucket", "lo", "hi", "digest",
        F.when(F.col("lo") > p_lo, p_lo).otherwise(F.col("hi")).alias("s_lo"),
        F.when(F.col("lo") > p_lo, F.col("lo")).otherwise(p_hi).alias("s_hi")), "merkle-nodes")
    other = nodes.select("key", "step", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), F.col("digest").alias("sibling"))
    out = settled(nodes.drop("digest").join(other, ["key", "step", "s_lo", "s_hi"], "left").select(
        "key", "step", "bucket", "lo", "hi", "sibling", (F.col("s_lo") < F.col("lo")).alias("left")), "merkle-siblings")
    forget(nodes)
    return out


def proofs(base: DataFrame, nodes: DataFrame, height: int) -> DataFrame:
    """``(key, rank, proof)`` for nodes of ``base(key, rank, n)`` that have ancestors in this stratum."""
    asked = base.select("key", "rank", F.explode(F.sequence(F.lit(0), F.lit(STRIDE - 1))).alias("step"), "n").where(
        F.col("n") > F.pow(F.lit(2.0), F.col("step"))).select(
        "key", "rank", "step", F.expr("shiftright(rank, step)").alias("bucket"),
        F.shiftleft("rank", height).alias("leaf_rank"))
    met = asked.join(nodes, ["key", "step", "bucket"]).where("lo <= leaf_rank AND leaf_rank < hi")
    return met.groupBy("key", "rank").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("step", "sibling", "left"))),
        lambda x: F.struct(x["sibling"].alias("sibling"), x["left"].alias("left"))).alias("proof"))


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, top)`` and ``(key, rank, proof)``, both written, for the tree of every key.

    ``leaves``: (key, rank, n, digest), written.  A key with one leaf has it as its top and no proof.
    """
    base, height = leaves.select("key", F.col("n").alias("leaves"), "rank", "n", "digest"), 0
    bases, strata, tops = [], [], []
    while True:
        bases.append(base)
        strata.append(raised(base, height))
        last = F.get(F.element_at("levels", -1), F.lit(0))
        tops.append(strata[-1].where(F.col("n") <= 1 << STRIDE).select("key", last.alias("top")))
        most = strata[-1].agg(F.max("n")).first()[0]
        if most is None or most <= 1 << STRIDE:
            break
        base = strata[-1].where(F.col("n") > 1 << STRIDE).select(
            "key", "leaves", F.col("block").alias("rank"), F.shiftright(F.col("n") + ((1 << STRIDE) - 1), STRIDE).alias("n"),
            last.alias("digest"))
        height += STRIDE
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    top = settled(top, "merkle-tops")
    above = None
    for k in reversed(range(len(strata))):
        nodes = intervals(strata[k], k * STRIDE)
        found = proofs(bases[k].select("key", "rank", "n"), nodes, k * STRIDE)
        if above is not None:  # the ancestors above this stratum are those of the node's group
            found = found.withColumn("block", F.shiftright("rank", STRIDE)).join(
                above.select("key", F.col("rank").alias("block"), F.col("proof").alias("more")), ["key", "block"], "left"
            ).select("key", "rank", F.concat("proof", F.coalesce("more", F.array().cast(PROOF))).alias("proof"))
        found = settled(found, "merkle-proofs")
        forget(nodes, *([above] if above is not None else []))
        above = found
    forget(*strata)
    return top, above


def manifest(
    df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``(id, leaf, subroot, root, proof)`` of every row, and the columns ``carry`` makes of the row.

    Digests are 32 bytes; ``proof`` lists the siblings from the leaf to the root, null where a node
    has none.  ``folded(leaf, proof)`` equals ``root``.

    Rows of a group ascend by id, a null id first, rows of one id by their leaf; a null group comes
    before all others.  Null fields have their own mark, so null and empty differ.  Every row is a
    leaf, repeated rows too.  Columns outside ``fields`` are not read.  An empty table gives none.
    """
    carry = carry or {}
    rows = settled(df.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("key"),
        F.col(f"`{id_col}`").cast("long").alias("id"), leaf_of([F.col(f"`{c}`") for c in fields]).alias("digest"),
        F.struct(*([made.alias(name) for name, made in carry.items()] or [F.lit(0).alias("_")])).alias("own")), "merkle-leaves")
    leaves = ranked(rows, ["id", "digest"])
    forget(rows)
    tops, proof = tree(leaves)
    groups = ranked(settled(tops.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("top").alias("digest")),
                            "merkle-groups"), ["group"])
    whole, upper = tree(groups)
    root = whole.first()
    upper = groups.join(upper, ["key", "rank"], "left").select(
        F.col("group").alias("key"), F.col("digest").alias("subroot"), F.col("proof").alias("more"))
    none = F.array().cast(PROOF)
    return leaves.join(proof, ["key", "rank"], "left").join(settled(upper, "merkle-upper"), "key").select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot",
        F.lit(bytes(root.top) if root else None).cast("binary").alias("root"),
        F.concat(F.coalesce("proof", none), F.coalesce("more", none)).alias("proof"),
        *[F.col("own")[name].alias(name) for name in carry])
