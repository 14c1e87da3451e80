"""References to records that do not exist: missing, deleted or not yet there.

References and the parents' validity intervals are brought together by key and sorted by time; one pass over the merged
stream keeps the number of intervals open, so each reference is judged at its own moment. A hot key is spread over salts,
its parents' few events copied to each.

Defined cases: a NULL key refers to nothing and is no orphan. A reference without a time can only be `missing`; its period
is NULL. A parent without valid_from is never valid, one whose valid_to is at or before valid_from neither; both count as
rows of their key. Several rows of a key are several intervals. Empty tables of references give no rows, an empty table of
parents makes every reference missing. Repeated references are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.session import HOT_ROWS, cut, hot_keys, replicated, salted, small


def orphans(refs: DataFrame, parents: DataFrame, key: str, at: str, valid_from: str | None = None, valid_to: str | None = None,
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of refs whose key has no valid parent at `at`, with reason (missing, late, deleted) and period (yyyy-MM).

    parents without validity columns are valid for ever. Columns reason and period of refs, if any, are replaced.
    """
    refs = refs.drop("reason", "period")
    own = [c for c in refs.columns if c not in (key,)]
    refs = refs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.struct(*own).alias("_ref"), F.col(at).alias("_t"))
    hot = cut(hot_keys(refs, "_key", hot_rows))
    hot = small(hot, hot.count())
    rows = salted(refs, hot, "_key", F.col("_ref")).select("_key", "salt", "_t", "_ref", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_delta"))
    parents = parents.filter(F.col(key).isNotNull())
    t = refs.schema["_t"].dataType
    start = F.col(valid_from).cast(t) if valid_from else F.lit(None).cast(t)
    end = F.col(valid_to).cast(t) if valid_to else F.lit(None).cast(t)
    spans = parents.select(F.col(key).alias("_key"), start.alias("_from"), end.alias("_to"))
    # the head of each key: that it exists, and since when
    heads = spans.groupBy("_key").agg(F.min("_from").alias("_first")).select(
        "_key", F.lit(None).cast(t).alias("_t"), F.lit(0 if valid_from else 1).cast("long").alias("_delta"), F.col("_first"), F.lit(True).alias("_known")
    )
    events = heads
    if valid_from:
        real = spans.filter("_from is not null and (_to is null or _to > _from)")
        steps = real.select("_key", F.col("_from").alias("_t"), F.lit(1).cast("long").alias("_d")).unionByName(
            real.filter("_to is not null").select("_key", F.col("_to").alias("_t"), F.lit(-1).cast("long").alias("_d"))
        )
        events = heads.unionByName(steps.groupBy("_key", "_t").agg(F.sum("_d").alias("_delta")), allowMissingColumns=True)
    stream = rows.unionByName(replicated(events, hot, "_key").withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    # by kind first among equal times; a reference without time comes after the head, before all steps
    upto = W.partitionBy("_key", "salt").orderBy(F.col("_t").asc_nulls_first(), "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = stream.select(
        "_key", "_t", "_ref", "_kind",
        F.sum("_delta").over(upto).alias("_open"),
        F.last("_known", ignorenulls=True).over(upto).alias("_there"),
        F.last("_first", ignorenulls=True).over(upto).alias("_since"),
    ).filter("_kind = 1 and _open = 0")
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("_since") > F.col("_t"), "late").otherwise("deleted")
    return (
        merged.withColumn("reason", reason)
        .filter("reason = 'missing' or _t is not null")
        .select(F.col("_key").alias(key), *[F.col("_ref")[c].alias(c) for c in own], "reason", F.date_format("_t", "yyyy-MM").alias("period"))
    )
