"""Left join of order lines with a table of one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.session import materialize_measured

# A lookup table is broadcast only when it is measured to be smaller than this: over a million keys with their statistics. Beyond it
# all lines are exchanged, which is many times a table of this size.
BROADCAST_BYTES = 128 * 1024 * 1024
# A key is hot if it has more than this share of what an exchange partition gets; so many keys a partition, at most, are hot.
HOT_SHARE = 4
# Slots for each exchange partition.
SLOTS = 16


def measures(lookup: DataFrame, keys: list[str], rows: str) -> dict[str, Column]:
    """Aggregates that `attach` needs to know about a lookup table."""
    key_bytes = sum((F.octet_length(F.col(k).cast("string")) for k in keys), F.lit(0))
    return {"size": F.sum(key_bytes + 16 * len(lookup.columns)), "lines": F.sum(rows)}


def attach(
    df: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    rows: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    measured: dict | None = None,
) -> DataFrame:
    """`df` with the lookup's columns; rows without a key or without a match get NULLs.

    `lookup` has one row per key and, in column `rows`, how many order lines carry that key. It is written
    and measured once (unless `measured` is given: it is written already). A small one is broadcast. Otherwise
    the hot keys, known from `rows`, are broadcast: those with over a quarter of an exchange partition's share of the
    lines, hence at most four for each partition of the session. Lines with other keys are exchanged by key, lines with a
    hot key or none by the hash of the whole line, so no task gets much more than its share.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = SLOTS * partitions
    if measured is None:
        lookup, measured = materialize_measured(lookup, "lookup", **measures(lookup, keys, rows))
    payload = [c for c in lookup.columns if c not in keys]
    if (measured["size"] or 0) <= broadcast_bytes:
        return df.join(F.broadcast(lookup), keys, "left").select(*df.columns, *payload)

    is_hot = F.col(rows) > (measured["lines"] or 0) // (HOT_SHARE * partitions)
    hot = lookup.where(is_hot).select(*keys, F.struct(*payload).alias("_hot"))
    cold = lookup.where(~is_hot).select(
        F.struct(*keys).alias("_key"), F.struct(*payload).alias("_cold")
    )
    cold = cold.withColumn("_slot", F.pmod(F.xxhash64("_key"), F.lit(spread)))

    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    marked = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull() & ~no_key, F.struct(*keys))
    )
    slot = F.when(F.col("_key").isNull(), F.xxhash64(*df.columns)).otherwise(F.xxhash64("_key"))
    joined = marked.withColumn("_slot", F.pmod(slot, F.lit(spread))).join(cold, ["_key", "_slot"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*df.columns, *[found[c].alias(c) for c in payload])
