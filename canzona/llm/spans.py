"""Long exact spans shared between records, and how much of each record is shared elsewhere.

De Bruijn compaction: each run of SPAN tokens is an edge of the graph. Edges that occur in one record only are dropped.
An edge whose occurrences all go on alike, into an edge that occurs nowhere else, has it as its only successor; non-branching
paths are compacted by joins that double the distance to the path's head in each round. Each occurrence of a head is one of its
whole path; its source coordinates give back the tokens, which must agree token for token.

Defined cases: records under `span` tokens or with NULL sequence share nothing. NULL tokens are a value of their own. A
span repeated within one record only is not shared. Exact copies are one record until the end and share all their tokens.
Of several rows of one record the largest sequence counts. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.llm.sequences import copy_classes, group_pairs, record_pairs, sequences
from canzona.session import HOT_ROWS, cut, replicated, salted, small

SPAN = 24


def _edges(classes: DataFrame, span: int) -> DataFrame:
    """cls, pos, h, next: every edge of every class and the edge that follows it, NULL at the end."""
    # the first element and the NULLs keep missing tokens apart from shorter runs
    edge = lambda p, i: F.xxhash64(F.lit(span), F.slice(p, i + 1, span), F.transform(F.slice(p, i + 1, span), lambda x: x.isNull()))
    hashes = classes.select("cls", F.transform(F.sequence(F.lit(0), F.size("seq") - span), lambda i: edge(F.col("seq"), i)).alias("hs"))
    steps = hashes.select("cls", F.posexplode(F.arrays_zip(F.col("hs").alias("h"), F.slice("hs", 2, 2_000_000_000).alias("next"))).alias("pos", "e"))
    return cut(steps.select("cls", "pos", F.col("e.h").alias("h"), F.col("e.next").alias("next")))


def paths(edges: DataFrame) -> DataFrame:
    """h, n, edges: the heads of the non-branching paths of edges that more than one class has, their occurrences and length.

    No path is a ring: the last occurrence of some edge of a ring would have to go on as well.
    """
    held = edges.groupBy("h").agg(
        F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("next").alias("followed"), F.min("next").alias("least"), F.max("next").alias("most")
    )
    only = F.when((F.col("followed") == F.col("n")) & (F.col("least") == F.col("most")), F.col("least"))
    shared = cut(held.filter("lo < hi").select("h", "n", only.alias("next")))
    after = shared.filter("next is not null").select(F.col("h").alias("before"), F.col("n").alias("m"), F.col("next").alias("h"))
    steps = cut(shared.join(after, "h").filter("n = m").select("h", F.col("before").alias("back"), F.lit(1).alias("far")))
    # an edge that no edge leads to alone is a head; the others reach twice as far back in each round
    heads = shared.join(steps.select("h"), "h", "left_anti").select("h", "n")
    while True:
        jump = steps.select(F.col("h").alias("back"), F.col("back").alias("to"), F.col("far").alias("more"))
        new = steps.select("h", "back", "far").join(jump, "back", "left")
        steps = cut(new.select("h", F.coalesce("to", "back").alias("back"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("to").isNotNull().alias("moved")))
        if not steps.filter("moved").limit(1).count():
            break
    lengths = steps.groupBy(F.col("back").alias("h")).agg((F.max("far") + 1).alias("edges"))
    return cut(heads.join(lengths, "h", "left").select("h", "n", F.coalesce("edges", F.lit(1)).cast("int").alias("edges")))


def path_places(classes: DataFrame, span: int = SPAN) -> DataFrame:
    """path, cls, start, edges: the occurrences of the paths, each where its head occurs."""
    edges = _edges(classes, span)
    heads = paths(edges)
    hot = cut(heads.filter(F.col("n") > HOT_ROWS).select("h", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts")))
    hot = small(hot, hot.count())
    met = salted(edges.select("cls", "pos", "h"), hot, "h", F.col("cls")).join(replicated(heads.select("h", "edges"), hot, "h"), ["h", "salt"])
    return cut(met.select(F.col("h").alias("path"), "cls", F.col("pos").alias("start"), "edges"))


def span_classes(classes: DataFrame, span: int = SPAN) -> DataFrame:
    """a < b: the classes with a span in common, checked on their tokens."""
    placed = path_places(classes, span)
    read = placed.join(classes.select("cls", "seq"), "cls").select("path", "cls", F.slice("seq", F.col("start") + 1, F.col("edges") + span - 1).alias("tokens"))
    # the tokens themselves are compared once for each path and class; equal ones have one digest
    held = read.select("path", F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",", "null"), 256).alias("tokens"), "cls").distinct()
    return group_pairs(cut(held), ["path", "tokens"], "cls")


def shared_spans(records: DataFrame, rec: str, seq: str, span: int = SPAN) -> DataFrame:
    """doc_id_a, doc_id_b: all pairs of records with at least `span` consecutive tokens in common."""
    classes, membership = copy_classes(sequences(records, rec, seq, span))
    return record_pairs(cut(span_classes(classes, span)), membership)


def shared_stretches(records: DataFrame, rec: str, seq: str, span: int = SPAN) -> DataFrame:
    """doc_id, start, end (exclusive), tokens: the maximal stretches of each record that are covered by shared spans."""
    classes, membership = copy_classes(sequences(records, rec, seq, span))
    # paths that touch or overlap make one stretch; a record has few paths however long it is
    upto = W.partitionBy("cls").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    placed = path_places(classes, span).select("cls", "start", (F.col("start") + F.col("edges") + span - 1).alias("end"))
    new = placed.withColumn("new", F.coalesce((F.col("start") > F.max("end").over(upto)).cast("int"), F.lit(1)))
    stretch = new.withColumn("s", F.sum("new").over(W.partitionBy("cls").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy("cls", "s").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    single = classes.filter("members = 1").select("cls").join(stretch, "cls").select("cls", "start", "end")
    copies = classes.filter("members > 1").select("cls", F.lit(0).alias("start"), F.size("seq").alias("end"))
    every = membership.join(single.unionByName(copies), "cls").join(classes.select("cls", F.size("seq").alias("tokens")), "cls")
    return every.select(F.col("rec").alias("doc_id"), "start", "end", "tokens")


def shared_share(records: DataFrame, rec: str, seq: str, span: int = SPAN) -> DataFrame:
    """doc_id, tokens, shared_tokens, share of each record that has any shared span."""
    return shared_stretches(records, rec, seq, span).groupBy("doc_id").agg(
        F.max("tokens").cast("long").alias("tokens"), F.sum(F.col("end") - F.col("start")).alias("shared_tokens")
    ).withColumn("share", F.round(F.col("shared_tokens") / F.col("tokens"), 6))


def places_in_stretches(stretches: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, places, shared_places: how many places (doc_id, first_pos, n) of each record lie whole in a shared stretch.

    A record's stretches do not overlap, so a place has one at most: the last that starts no later than it. The two streams
    merge in the order of their starts. Places with a NULL among their columns are not counted.
    """
    spots = places.filter("doc_id is not null and first_pos is not null and n is not null").select(
        "doc_id", F.col("first_pos").alias("start"), (F.col("first_pos") + F.col("n")).alias("until"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("end")
    )
    both = spots.unionByName(stretches.select("doc_id", "start", F.lit(None).cast("int").alias("until"), F.lit(0).alias("kind"), "end"))
    upto = W.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("reach", F.last("end", ignorenulls=True).over(upto)).filter("kind = 1").groupBy("doc_id").agg(
        F.count("*").alias("places"), F.sum((F.coalesce("reach", F.lit(-1)) >= F.col("until")).cast("long")).alias("shared_places")
    )
