"""Sources of text: JSON lines of melodies, and saved answers of two public link services, to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_of(value: Column) -> Column:
    """The first four characters without leading dashes as a year; 0 and unreadable ones are NULL."""
    return F.nullif(F.regexp_replace(F.substr(value, F.lit(1), F.lit(4)), "^-+", "").try_cast("int"), F.lit(0))


def melodies(lines: DataFrame, least: int = 12) -> DataFrame:
    """ext_id, title, artist, year, pitches from `value` lines; lines that are no JSON or have too few notes are dropped."""
    shape = "id string, year string, tunefamily string, tunefamily_full string, origin string, features struct<midipitch:array<string>>"
    j = F.from_json("value", shape)
    ints = F.filter(F.transform(F.coalesce(F.col("j.features.midipitch"), F.array().cast("array<string>")), lambda t: F.when(t == "true", 1).when(t == "false", 0).otherwise(t.try_cast("int"))), lambda x: x.isNotNull())
    year = F.col("j.year").try_cast("int")
    return lines.select(j.alias("j")).filter("j is not null").select(
        F.col("j.id").alias("ext_id"), F.coalesce("j.tunefamily_full", "j.tunefamily", "j.id").alias("title"), F.coalesce("j.origin", F.lit("")).alias("artist"),
        F.when(year > 0, year).alias("year"), ints.alias("pitches"),
    ).filter(F.size("pitches") >= least)


def read_melodies(spark, path: str, least: int = 12) -> DataFrame:
    """melodies of (gzipped) JSON-line files."""
    return melodies(spark.read.text(path), least)


def query_links(answers: DataFrame) -> DataFrame:
    """src, dst, labels and years of `value` answers in the SPARQL results format."""
    cell = "struct<value:string>"
    shape = f"results struct<bindings:array<struct<work:{cell},basedOn:{cell},workLabel:{cell},basedOnLabel:{cell},workDate:{cell},basedOnDate:{cell}>>>"
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    b = answers.select(F.explode(F.from_json("value", shape)["results"]["bindings"]).alias("b")).filter("b.work is not null and b.basedOn is not null")
    return b.select(
        last(F.col("b.work.value")).alias("src"), last(F.col("b.basedOn.value")).alias("dst"), F.coalesce("b.workLabel.value", F.lit("")).alias("src_label"),
        F.coalesce("b.basedOnLabel.value", F.lit("")).alias("dst_label"), year_of(F.col("b.workDate.value")).alias("src_year"), year_of(F.col("b.basedOnDate.value")).alias("dst_year"),
    )


def work_links(answers: DataFrame) -> DataFrame:
    """src, dst, labels and relation of `value` answers that list one work's relations; backward ones swap their ends."""
    shape = "id string, title string, relations array<struct<type:string,direction:string,work:struct<id:string,title:string>>>"
    r = answers.select(F.from_json("value", shape).alias("j")).select("j.id", "j.title", F.explode("j.relations").alias("r")).filter("r.work.id is not null")
    back = F.coalesce(F.col("r.direction") == "backward", F.lit(False))
    pick = lambda x, y: F.when(back, x).otherwise(y)
    there = F.coalesce("r.work.title", F.lit(""))
    return r.select(
        pick(F.col("r.work.id"), F.col("id")).alias("src"), pick(F.col("id"), F.col("r.work.id")).alias("dst"), pick(there, F.col("title")).alias("src_label"),
        pick(F.col("title"), there).alias("dst_label"), F.coalesce("r.type", F.lit("related")).alias("relation"),
    )
