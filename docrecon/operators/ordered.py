"""Running values over one long ordered sequence without putting the sequence in one task.

A plain window ``partitionBy(chunk).orderBy(pos)`` sorts a whole chunk in one task; a chunk that
holds a third of all rows would be one straggler.  Here a chunk is cut into blocks of
``BLOCK`` positions.  The window runs inside ``(chunk, block)``; one summary row per block carries
the state across, so the second window sees ``rows / BLOCK`` rows of a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
_B = "__block"


def block_of(pos: Column, width: int = BLOCK) -> Column:
    return F.floor(pos / width).cast("long")


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    strict: bool = False,
    block: Column | None = None,
) -> DataFrame:
    """Add ``name``: the latest non-null ``value`` up to each row (before it when ``strict``).

    ``order`` must order rows of a key totally, and rows of a lower block must come first; the
    block defaults to the first order column divided by ``BLOCK``.
    """
    keys, order = list(keys), list(order)
    cols = df.columns
    by = block_of(F.col(order[0])) if block is None else block
    rows = df.withColumn("__v", value).withColumn(_B, by)
    inside = Window.partitionBy(*keys, _B).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    local = rows.withColumn("__local", F.last("__v", ignorenulls=True).over(upto))

    at = F.struct(*order)
    ends = rows.groupBy(*keys, _B).agg(
        F.max_by("__v", F.when(F.col("__v").isNotNull(), at)).alias("__end")
    )
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, _B, F.last("__end", ignorenulls=True).over(across).alias("__carry")
    )
    out = local.join(carry, [*keys, _B], "left")
    return out.select(*cols, F.coalesce("__local", "__carry").alias(name))


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    block: Column | None = None,
) -> DataFrame:
    """Add ``name``: the 0-based position of each row within its key."""
    keys, order = list(keys), list(order)
    cols = df.columns
    by = block_of(F.col(order[0])) if block is None else block
    rows = df.withColumn(_B, by)
    local = rows.withColumn(
        "__n", F.row_number().over(Window.partitionBy(*keys, _B).orderBy(*order))
    )
    sizes = rows.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__size"))
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(
        *keys, _B, F.coalesce(F.sum("__size").over(across), F.lit(0)).alias("__before")
    )
    out = local.join(carry, [*keys, _B], "left")
    return out.select(*cols, (F.col("__before") + F.col("__n") - 1).cast("long").alias(name))


def consecutive_runs(
    df: DataFrame, keys: Sequence[str], pos: str, name: str = "run_start"
) -> DataFrame:
    """Gaps and islands on integer positions: add the first position of each row's run.

    A row starts a run when nothing sits at ``pos - 1``; that is an equality join, and the start is
    then carried forward.  ``(keys, pos)`` must be unique.
    """
    keys = list(keys)
    before = df.select(*keys, (F.col(pos) + 1).alias(pos), F.lit(True).alias("__has"))
    marked = df.join(before, [*keys, pos], "left")
    start = F.when(F.col("__has").isNull(), F.col(pos))
    return running_last(marked, keys, [pos], start, name).drop("__has")


def neighbours(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, names: dict[str, int], *, width: int = BLOCK
) -> DataFrame:
    """Add the ``value`` of the rows at ``pos + step`` for each ``name: step``; null where there is none.

    Rows near the edge of a block are copied to the block beside it, so one exchange serves all steps
    in both directions and no key sits in one task.  ``(keys, pos)`` must be unique, ``pos`` whole.
    """
    keys = list(keys)
    back, ahead = max(0, -min(names.values())), max(0, max(names.values()))
    home, place = block_of(F.col(pos), width), F.pmod(F.col(pos), F.lit(width))
    beside = [home]
    if back:
        beside.append(F.when(place >= width - back, home + 1))
    if ahead:
        beside.append(F.when(place < ahead, home - 1))
    rows = df.withColumn("__v", F.struct(F.col(pos).alias("at"), value.alias("v"))).withColumn(
        _B, F.explode(F.array_compact(F.array(*beside)))
    )
    inside = Window.partitionBy(*keys, _B).orderBy(pos)
    steps = sorted({d for k in names.values() for d in (range(1, k + 1) if k > 0 else range(k, 0))})
    seen = {d: (F.lead if d > 0 else F.lag)("__v", abs(d)).over(inside) for d in steps}
    wide = rows.select("*", *[c.alias(f"__n{d}") for d, c in seen.items()]).where(F.col(_B) == home)

    def found(k: int) -> Column:
        # A gap moves rows closer in the window; the one at the exact position is looked for.
        near = [d for d in steps if (d > 0) == (k > 0)]
        return F.coalesce(*[
            F.when(F.col(f"__n{d}")["at"] == F.col(pos) + k, F.col(f"__n{d}")["v"]) for d in near
        ])

    return wide.select(*df.columns, *[found(k).alias(name) for name, k in names.items()])
