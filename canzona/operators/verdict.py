"""The abstention ladder: one verdict a query from its counts in every stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ladder's thresholds, and traditions without a single author.
DISTINCTIVE_AT_MOST, COMMONPLACE_FROM = 40.0, 60.0
CONFIDENCE, MASS, MODAL = 0.45, 0.40, 0.12
FOLK = ("folk", "traditional", "")


def ladder(cells: DataFrame, key: str) -> DataFrame:
    """verdict and reasons for each key. cells: key, stratum, mean_confidence, paths, mass, modal, expected, low, high, percentile, earliest, all_folk, n_docs.

    all_folk is NULL where a stratum shows no match. expected is rounded to two places, as it is shown; smaller is no hit.
    """
    shown = cells.withColumn("expected", F.round("expected", 2)).withColumn("hit", F.col("expected") > 0)
    one = shown.groupBy(key).agg(
        F.max("mean_confidence").alias("confidence"), F.max("paths").alias("paths"), F.max("mass").alias("mass"), F.max("modal").alias("modal"),
        F.bool_or("hit").alias("any_hit"), F.coalesce(F.bool_and(F.when(F.col("hit"), F.col("all_folk"))), F.lit(True)).alias("folk"),
        F.bool_and(F.when(F.col("hit"), F.col("earliest").isNull())).alias("undated"), F.max(F.when(F.col("hit"), F.col("percentile"))).alias("worst"),
        F.min_by(F.when(F.col("hit") & (F.col("high") - F.col("low") > 2 * F.col("expected")), F.col("stratum")), F.when(F.col("hit") & (F.col("high") - F.col("low") > 2 * F.col("expected")), F.col("stratum"))).alias("wide"),
        F.sum("n_docs").alias("corpus"), F.sort_array(F.collect_list(F.concat("stratum", F.lit(" ("), F.col("n_docs").cast("string"), F.lit(")")))).alias("strata"),
    )
    weak = F.col("confidence") < CONFIDENCE
    thin = (F.col("paths") > 0) & (F.col("mass") < MASS)
    vague = (F.col("modal") > 0) & (F.col("modal") < MODAL)
    rule = (
        F.when(weak, 1).when(thin, 2).when(vague, 3).when(~F.col("any_hit"), 5).when(F.col("folk"), 6)
        .when(F.col("worst") >= COMMONPLACE_FROM, 7).when(F.col("worst") <= DISTINCTIVE_AT_MOST, 8).otherwise(9)
    )
    r = one.withColumn("rule", rule)
    verdict = F.when(F.col("rule") <= 3, "insufficient_confidence").when(F.col("rule").isin(5, 8), "distinctive").when(F.col("rule") == 6, "no_single_originator").otherwise("commonplace")
    text = F.array(
        F.when(F.col("rule") == 1, F.lit("mean note confidence is below the floor")),
        F.when(F.col("rule") == 2, F.lit("the readings kept carry too little of the probability")),
        F.when(F.col("rule") == 3, F.lit("the best reading is too improbable to count against")),
        F.when((F.col("rule") > 3) & F.col("wide").isNotNull(), F.concat(F.lit("the interval is wide in "), F.col("wide"))),
        F.when(F.col("rule") == 5, F.concat(F.lit("found in none of "), F.col("corpus").cast("string"), F.lit(" works: "), F.array_join("strata", ", "))),
        F.when(F.col("rule") == 6, F.lit("every match is folk or traditional")),
        F.when((F.col("rule") == 6) & F.col("undated"), F.lit("no match carries a date")),
        F.when(F.col("rule") == 7, F.lit("a building block by its frequency")),
        F.when(F.col("rule") == 8, F.lit("rarer than most figures of its length")),
        F.when(F.col("rule") == 9, F.lit("between the thresholds")),
    )
    return r.select(key, "rule", verdict.alias("verdict"), F.array_join(F.filter(text, lambda x: x.isNotNull()), "; ").alias("reasons"))
