"""URL filters by a temporal list join.

A list is a log of dated entries (pattern, kind, category, action, day): on that day the pattern was put on the list or taken off.
Entries of a pattern and kind become validity intervals [day, day of its next entry). A pattern of kind "host" stands for the host with all its
subdomains, one of kind "prefix" for a host and the steps of a path's beginning; an entry of any other kind is an error. A capture has
one candidate key for each of its host's suffixes of at least as many labels as the list's shortest host, and each of its path's prefixes of at most as many
steps as the list's deepest prefix (both bounds are computed from the list, so no match is lost, and neither bare top-level domains nor very
long paths make keys in vain). An as-of equi-join by kind and key keeps the interval that holds its fetch time. The longest active pattern decides (a
prefix before a host). Empty path steps don't count.

Only DataFrame functions are used. The list may be broadcast by Spark where its measured size is under the session's threshold.

Defined results: null or unparsable urls and null fetch times match nothing and are kept. Hosts are compared in lower case without a
leading ``www.``, port, credentials or a trailing dot. Of several entries of a pattern on one day the blocking one holds. Every input row gives one row,
repeated ones too. Empty tables give empty results; an empty list keeps everything. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A dated list for the synthetic hosts. action: add puts on the list, drop takes off.
ENTRIES = (
    ("spam-farm.example.org", "host", "spam", "add", "2023-06-01"),
    ("cheap-pills.example.com", "host", "spam", "add", "2023-11-15"),
    ("cheap-pills.example.com", "host", "spam", "drop", "2024-05-01"),
    ("cheap-pills.example.com", "host", "spam", "add", "2024-08-20"),
    ("casino-win.example.org", "host", "gambling", "add", "2024-03-10"),
    ("free-bets.example.com", "host", "gambling", "add", "2024-01-20"),
    ("free-bets.example.com", "host", "gambling", "drop", "2024-10-05"),
    ("adult-x.example.net", "host", "adult", "add", "2022-02-02"),
    ("ads-track.example.org", "host", "tracker", "add", "2024-07-01"),
    ("tionsh.example.net/es", "prefix", "mirror", "add", "2024-04-01"),
    ("tionsh.example.net/es", "prefix", "mirror", "drop", "2024-06-30"),
)


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTRIES), "pattern string, kind string, category string, action string, day string").withColumn("day", F.col("day").cast("date"))


def clean_pattern(pattern: Column, kind: Column) -> Column:
    """A pattern as keys have it: lower case, without empty path steps."""
    p = F.lower(F.trim(pattern))
    return F.when(kind == "prefix", F.array_join(F.filter(F.split(p, "/"), lambda x: x != ""), "/")).otherwise(p)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, category, valid_from, valid_to) for the times a pattern is on the list; valid_to is null while it still is."""
    kind = F.when(F.col("kind").isin("host", "prefix"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no kind of entry: "), F.coalesce("kind", F.lit("null")))))
    known = entries.where("pattern is not null and day is not null").withColumn("kind", kind)
    one = known.groupBy("kind", clean_pattern(F.col("pattern"), F.col("kind")).alias("pattern"), "day").agg(F.min(F.struct(F.when(F.col("action") == "add", 0).otherwise(1).alias("off"), "category")).alias("x"))
    later = F.lead("day").over(Window.partitionBy("kind", "pattern").orderBy("day"))
    return one.select("kind", "pattern", F.col("x.category").alias("category"), F.col("x.off").alias("off"), F.col("day").alias("valid_from"), later.alias("valid_to")).where("off = 0").drop("off")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")


def keys_of(url: Column, labels_least: int, steps_most: int) -> Column:
    """(kind, key) of the patterns that would match a url: hosts of at least so many labels, prefixes of at most so many steps."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    # One step more is cut than is used, so that the last one used ends where it ends in the url.
    path = F.regexp_extract(F.lower(url), r"^[^:]*://[^/?#]*/([^?#]*)", 1)
    steps = F.slice(F.filter(F.split(path, "/+", steps_most + 2), lambda x: x != ""), 1, steps_most) if steps_most else F.array().cast("array<string>")
    key = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))
    n = F.size(labels) - labels_least + 1
    hosts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: key("host", F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))))
    none = F.array().cast("array<struct<kind: string, key: string>>")
    return F.when(host != "", F.concat(F.coalesce(hosts, none), F.coalesce(prefixes, none)))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: (page_id, url, fetched). Adds host, blocked, category and pattern."""
    active = intervals(entries)
    depth = lambda kind, by: F.when(F.col("kind") == kind, F.size(F.split("pattern", by)))
    bounds = active.agg(F.min(depth("host", r"\.")).alias("labels"), F.max(depth("prefix", "/")).alias("steps")).first()
    seen = captures.select("url", "fetched").where("url is not null and fetched is not null").distinct()
    keys = seen.select("url", "fetched", F.explode(keys_of(F.col("url"), bounds["labels"] or 1 << 20, (bounds["steps"] or 1) - 1)).alias("k")).select("url", "fetched", "k.*")
    as_of = (keys["kind"] == active["kind"]) & (F.col("key") == F.col("pattern")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    hits = keys.join(active, as_of).groupBy("url", "fetched").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "category")).alias("hit"))
    out = captures.select("page_id", "url", "fetched").join(hits, ["url", "fetched"], "left")
    return out.select("page_id", F.nullif(host_of(F.col("url")), F.lit("")).alias("host"), "fetched", F.col("hit").isNotNull().alias("blocked"), F.col("hit.category").alias("category"), F.col("hit.pattern").alias("pattern"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; a page counts as fetched on the day page_id mod 366 of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched"))
