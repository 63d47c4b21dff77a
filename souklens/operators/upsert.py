"""Merge updates into a keyed table: full outer join on the key and one rule per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_per_key(updates: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    """Reduce duplicate keys of one batch to the last row (max_by combines map-side)."""
    rest = [c for c in updates.columns if c not in keys]
    row = F.struct(*rest)
    pick = F.max_by(row, order) if order is not None else F.max(row)
    return updates.groupBy(*keys).agg(pick.alias("_w")).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest])


def _merged(rule: str, new: Column, old: Column, matched: Column, both: Column) -> Column:
    if rule == "new":
        return F.when(matched, new).otherwise(old)
    if rule == "coalesce":
        return F.coalesce(new, old)
    if rule == "greatest":
        return F.greatest(new, old)
    if rule == "greatest0":
        # Only a conflict takes the greatest; a fresh row goes in as it is.
        top = F.greatest(F.coalesce(new, F.lit(0)), F.coalesce(old, F.lit(0)))
        return F.when(both, top).otherwise(F.coalesce(new, old))
    if rule == "old":
        return F.when(both, old).otherwise(F.coalesce(old, new))
    raise ValueError(f"unknown merge rule: {rule}")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], policy: dict[str, str] | None = None,
           order: Column | None = None) -> DataFrame:
    """The table after INSERT ... ON CONFLICT (keys) DO UPDATE.

    ``policy`` maps a column to one of new (default), coalesce, greatest, greatest0, old. Columns that only
    the target has keep their value. ``order`` decides which row of a batch is the last for its key.
    """
    policy = policy or {}
    u = last_per_key(updates, keys, order).withColumn("_hit", F.lit(True)).alias("u")
    t = target.withColumn("_had", F.lit(True)).alias("t")
    joined = t.join(u, [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys], "full_outer")
    matched = F.coalesce(F.col("u._hit"), F.lit(False))
    both = matched & F.coalesce(F.col("t._had"), F.lit(False))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.when(matched, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        elif c in updates.columns:
            out.append(_merged(policy.get(c, "new"), F.col(f"u.{c}"), F.col(f"t.{c}"), matched, both).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return joined.select(*out)


def append_new(target: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of ``new`` to append: first per key, keys already present ignored."""
    rest = [c for c in new.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), order) if order is not None else F.min(F.struct(*rest))
    first = new.groupBy(*keys).agg(pick.alias("_w")).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest])
    return first.join(target.select(*keys), keys, "left_anti").select(*new.columns)


def update_max_sales(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Raise sales_30d where the update is larger, or the old value NULL or 0.

    Updates carry (marketplace, key, sales); a key is either the bare id or ``marketplace:id``, so both sides
    are brought to the bare form and met in one equi join.
    """
    def bare(key: Column, market: Column) -> Column:
        prefix = F.concat(market, F.lit(":"))
        return F.when(key.startswith(prefix), F.substring(key, F.length(prefix) + 1, F.length(key))).otherwise(key)

    u = updates.where(F.col("sales") > 0).select("marketplace", bare(F.col("key"), F.col("marketplace")).alias("_id"), "sales")
    u = u.groupBy("marketplace", "_id").agg(F.max("sales").alias("_new"))
    t = target.withColumn("_id", bare(F.col("source_id"), F.col("marketplace")))
    joined = t.join(u, ["marketplace", "_id"], "left")
    raised = F.when(F.col("_new").isNotNull(), F.greatest(F.coalesce("sales_30d", F.lit(0)), "_new")).otherwise(F.col("sales_30d"))
    return joined.withColumn("sales_30d", raised).select(*target.columns)
