"""Sequences by record, classes of exact copies and the expansion of links between classes to links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canzona.session import HOT_ROWS, cut, hot_keys, replicated, salted, small


#: Members of a group that one task pairs with each other.
PAIR_BLOCK = 1_000


def sequences(records: DataFrame, rec: str, seq: str, least: int) -> DataFrame:
    """rec, seq: one sequence of at least `least` tokens for each record id; of several the largest in array order."""
    return records.filter(F.col(rec).isNotNull() & (F.size(seq) >= least)).groupBy(F.col(rec).alias("rec")).agg(F.max(seq).alias("seq"))


def copy_classes(seqs: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """classes (cls, seq, members) and membership (rec, cls); cls is the smallest record with just this sequence."""
    keyed = cut(seqs.withColumn("key", F.sha2(F.array_join(F.col("seq").cast("array<string>"), ",", "null"), 256)))
    heads = cut(keyed.groupBy("key").agg(F.min("rec").alias("cls"), F.count("*").alias("members")))
    hot = cut(hot_keys(keyed, "key", hot_rows))
    hot = small(hot, hot.count())
    membership = salted(keyed.select("key", "rec"), hot, "key", F.col("rec")).join(replicated(heads.select("key", "cls"), hot, "key"), ["key", "salt"]).select("rec", "cls")
    classes = keyed.withColumnRenamed("rec", "cls").join(heads.select("cls", "members"), "cls").select("cls", "seq", "members")
    return cut(classes), cut(membership)


def record_pairs(class_pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: all pairs of records from linked classes (a, b), and all within a class."""
    left, right = membership.select(F.col("cls").alias("a"), F.col("rec").alias("ra")), membership.select(F.col("cls").alias("b"), F.col("rec").alias("rb"))
    across = class_pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("doc_id_a"), F.greatest("ra", "rb").alias("doc_id_b"))
    within = group_pairs(membership, ["cls"], "rec").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))
    return across.unionByName(within)


def group_pairs(members: DataFrame, keys: list[str], member: str, block: int = PAIR_BLOCK) -> DataFrame:
    """a < b: the distinct pairs of members of one group; large groups are cut into blocks that meet two by two in tasks of their own."""
    sizes = cut(members.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1").select(*keys, F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = members.join(sizes, keys).withColumn("mine", mine).withColumn("other", other)
    met = each.select(*keys, member, "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    x, y = (met.select(*keys, "p", "q", F.col(member).alias(c), F.col("mine").alias(f"m{c}")) for c in "ab")
    # members of one block meet in the pairing of that block with itself only
    return x.join(y, [*keys, "p", "q"]).filter("a < b and (ma <> mb or p = q)").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: connected components of a < b edges; label is the smallest node. Alternating star contraction."""
    e = cut(edges.select("a", "b").distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # each larger neighbour hangs itself on the smallest one
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), "m").filter("a > m").distinct()
        low = large.groupBy("a").agg(F.min("m").alias("m"))
        star = large.withColumnRenamed("m", "o").join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("o").alias("a"), "m"))).alias("s")).select("s.*").filter("a > m")
        new = cut(star.select(F.col("m").alias("a"), F.col("a").alias("b")).distinct())
        if not new.exceptAll(e).limit(1).count() and not e.exceptAll(new).limit(1).count():
            labelled = new.select(F.col("b").alias("node"), F.col("a").alias("label"))
            return labelled.unionByName(new.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
        e = new
