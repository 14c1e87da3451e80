"""Frequency of every distinct term: occurrences, records and marks for the too rare and the too common.

Last-seen counters: occurrences are hash-partitioned by term and a slice of the records, and sorted by record within it.
One pass keeps, for each term, the occurrences, the records and the last record seen, so no set of records is ever held; a
record lies in one slice only, so the slices' counters add up. There are so many slices that none of a hot term's holds more
than about HOT_ROWS occurrences, even if all are of one term.

Defined cases: an occurrence with a NULL term or record is not counted. Terms of the vocabulary without any occurrence
count 0. Repeated occurrences add to occurrences, not to records. Empty tables give no rows, or zeros for each term of the
vocabulary. Terms may be of any length. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.session import HOT_ROWS, cut, hot_keys, replicated, salted, small



def last_seen_counts(occurrences: DataFrame, term: list[str], record: str, slices: int) -> DataFrame:
    """The columns of term with occurrences and records (distinct values of record)."""
    rows = occurrences.select(*term, F.col(record).alias("_rec")).filter(" and ".join(f"`{c}` is not null" for c in [*term, "_rec"]))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("_rec"), F.lit(slices)).cast("int"))
    last = F.lag("_rec").over(W.partitionBy(*term, "_slice").orderBy("_rec"))
    # a record counts where it differs from the last one seen
    seen = rows.withColumn("_new", F.when(last.isNull() | (last != F.col("_rec")), 1).otherwise(0))
    counters = seen.groupBy(*term, "_slice").agg(F.count("*").alias("_o"), F.sum("_new").alias("_r"))
    return counters.groupBy(*term).agg(F.sum("_o").alias("occurrences"), F.sum("_r").cast("long").alias("records"))


def marked(vocabulary: DataFrame, counts: DataFrame, term: list[str], sizes: DataFrame, group: str, rare: int = 1, common_percent: int = 1) -> DataFrame:
    """Each distinct term of the vocabulary with its counts and mark: rare, common or NULL.

    sizes: group, size (records in the group; few rows). common: records x 100 > common_percent x size.
    """
    size = sizes.select(F.col(group), F.col("size").alias("_size"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * 100 > common_percent * F.coalesce("_size", F.lit(0)), "common")
    return (
        vocabulary.select(*term).distinct().join(counts, term, "left").join(size, group, "left")
        .select(*term, F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"), F.coalesce("records", F.lit(0)).cast("long").alias("records"), "_size")
        .withColumn("mark", mark).drop("_size")
    )


def figure_term(fkey: Column) -> Column:
    """fkey without white space, its encoding in small letters, its tokens untouched."""
    bare = F.regexp_replace(fkey, r"[\s\x{a0}]+", "")
    head = F.regexp_extract(bare, "^[^:]*", 0)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def slices_for(rows: int, hot_rows: int = HOT_ROWS) -> int:
    return max(1, -(-rows // hot_rows))


def posted_terms(terms: DataFrame, postings: DataFrame, works: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """stratum, term, doc_id of every posting of a work; a hot figure's postings are spread over salts."""
    ids = works.select("doc_id").filter("doc_id is not null").distinct()
    rows = postings.select("figure_id", "doc_id").filter("figure_id is not null")
    hot = cut(hot_keys(rows, "figure_id", hot_rows))
    hot = small(hot, hot.count())
    met = salted(rows.join(ids, "doc_id", "left_semi"), hot, "figure_id", F.col("doc_id")).join(replicated(terms.filter("figure_id is not null"), hot, "figure_id"), ["figure_id", "salt"])
    return met.select("stratum", "term", "doc_id")


def _terms(figures: DataFrame) -> DataFrame:
    return figures.select("figure_id", "stratum", figure_term(F.col("fkey")).alias("term")).filter("term is not null and stratum is not null")


def figure_terms(figures: DataFrame, postings: DataFrame, works: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """stratum, term, occurrences, records, mark over the works posted under any figure id of the term."""
    terms = _terms(figures)
    posted = posted_terms(terms, postings, works, hot_rows)
    counts = last_seen_counts(posted, ["stratum", "term"], "doc_id", slices_for(postings.count(), hot_rows))
    sizes = works.filter("doc_id is not null and stratum is not null").select("stratum", "doc_id").distinct().groupBy("stratum").agg(F.count("*").alias("size"))
    return marked(terms, counts, ["stratum", "term"], sizes, "stratum")


def stored_counts(figures: DataFrame, postings: DataFrame, works: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """figure_id, df, records, df_dated, dated, state of every figure row: whether its stored counts are right, wrong or missing.

    records and dated (with a year) are those of the figure's term; a stored NULL is missing, also where the other count is wrong.
    """
    terms = _terms(figures)
    posted = posted_terms(terms, postings, works, hot_rows)
    years = works.filter("doc_id is not null").groupBy("doc_id").agg(F.max("year").alias("year"))
    slices = slices_for(postings.count(), hot_rows)
    all_ = last_seen_counts(posted, ["stratum", "term"], "doc_id", slices).select("stratum", "term", "records")
    dated = last_seen_counts(posted.join(years.filter("year is not null"), "doc_id", "left_semi"), ["stratum", "term"], "doc_id", slices).select("stratum", "term", F.col("records").alias("dated"))
    rows = figures.select("figure_id", "stratum", figure_term(F.col("fkey")).alias("term"), "df", "df_dated").filter("term is not null and stratum is not null")
    each = rows.join(all_, ["stratum", "term"], "left").join(dated, ["stratum", "term"], "left").fillna(0, ["records", "dated"])
    state = F.when(F.col("df").isNull() | F.col("df_dated").isNull(), "missing").when((F.col("df") == F.col("records")) & (F.col("df_dated") == F.col("dated")), "right").otherwise("wrong")
    return each.select("figure_id", "df", "records", "df_dated", "dated", state.alias("state"))
