"""From typed sequences to cards: counts in every stratum, dated counts, rarity, matches and a verdict, for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.functions import encode as E
from canzona.operators import index as I
from canzona.operators import verdict as V
from canzona.session import cut, few

MATCHES = 8


def symbolic_cards(queries: DataFrame, works: DataFrame, encoding: str = "interval", shown: int = MATCHES) -> DataFrame:
    """One row a query and stratum. queries: query_id, pitches, reference_year; works: one row a work, as `index.distinct_works` gives.

    The whole sequence is the figure that is asked, as a reading without doubt; it is found if its length is indexed. n_works counts
    the works that have it, m_works those dated before the reference year (NULL without one); matches are the ids of the first
    `shown` works, dated ones first. Queries without pitches get no card. A query's cards share one verdict.
    """
    asked = cut(
        queries.filter("query_id is not null and size(pitches) > 0")
        .select("query_id", "reference_year", F.size("pitches").alias("n"), E.tokens(F.col("pitches"), encoding, (E.best_key(F.col("pitches")) / 2).cast("int")).alias("toks"))
        .select("query_id", "reference_year", F.concat_ws(":", F.lit(encoding), F.col("n").cast("string"), F.array_join("toks", ",")).alias("fkey"))
    )
    posted = cut(I.postings(works, encodings=(encoding,)))
    ranks = I.rarity(I.figures(posted)).select("stratum", "fkey", "percentile", "earliest")
    # only the postings of figures that are asked go on
    keys = asked.select("fkey").distinct()
    mine = cut(posted.join(keys, "fkey", "left_semi"))
    counts = asked.join(mine, "fkey").groupBy("query_id", "stratum").agg(
        F.count("*").alias("n_works"), F.count_if(I.predates(F.col("year"), F.col("reference_year"))).alias("m_works")
    )
    placed = mine.withColumn("place", F.row_number().over(W.partitionBy("stratum", "fkey").orderBy(F.col("year").asc_nulls_last(), "doc_id"))).filter(F.col("place") <= shown)
    matches = placed.join(works.select("doc_id", "tradition"), "doc_id").groupBy("stratum", "fkey").agg(
        F.bool_and(F.coalesce("tradition", F.lit("")).isin(*V.FOLK)).alias("all_folk"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("matches"),
    )
    strata = works.groupBy("stratum").agg(F.count("*").alias("n_docs"), F.count_if(F.col("year").isNull()).alias("undated"))
    few(works, "stratum")  # strata are few, or this is refused
    held = F.array(*[F.struct(F.lit(r["stratum"]).alias("stratum"), F.lit(r["n_docs"]).alias("n_docs"), F.lit(r["undated"]).alias("undated")) for r in strata.collect()])
    each = asked.withColumn("s", F.explode(held)).select("query_id", "reference_year", "fkey", "s.*")
    cells = cut(
        each.join(counts, ["query_id", "stratum"], "left").join(ranks.join(keys, "fkey", "left_semi"), ["stratum", "fkey"], "left").join(matches, ["stratum", "fkey"], "left")
        .withColumn("n_works", F.coalesce("n_works", F.lit(0))).withColumn("m_works", F.when(F.col("reference_year").isNotNull(), F.coalesce("m_works", F.lit(0))))
    )
    sure = {"mean_confidence": F.lit(1.0), "paths": F.lit(1), "mass": F.lit(1.0), "modal": F.lit(1.0), "expected": F.col("n_works").cast("double"), "low": F.col("n_works"), "high": F.col("n_works")}
    verdicts = V.ladder(cells.withColumns(sure), "query_id")
    return cells.join(verdicts, "query_id").select(
        "query_id", "stratum", "n_docs", "undated", "n_works", "m_works", "percentile", "earliest", F.coalesce("matches", F.lit("")).alias("matches"), "rule", "verdict"
    )
