"""Mixing sources to target weights by a low-discrepancy schedule.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share ``total`` (a share of all sizes).
A source's target stops at ``passes`` times its size; the excess is shared again by weight until none is above.

Schedule. The mix is a row of slots of ``block`` words. Each source owns as many consecutive integers as it needs slots;
together they are the cumulative weights. Slot k looks up the van der Corput point of k (its bits reversed), so at any
moment every source has had its share of slots to within a few. Slots are ranked within their source, and rank r
takes block r of that source's shuffled documents, laid end to end and repeated ``passes`` times.

Rows never gather by source: documents fall into about sqrt(n) shuffle ranges a source, slots into as many time ranges, and
offsets and ranks are two-level (``common.two_level``). Blocks join slots on (source, block).

Defined results: the size of a document is its number of words (null: 0). Documents without words are taken 0 times
and returned. A null source is a source. The shuffle orders by MD5 of doc_id and a seed, then doc_id and size, so reruns
agree; equal rows are interchangeable. Empty tables give empty results. Other columns are not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_PATTERN, materialise, two_level, word_count

WEIGHTS = (5, 2, 1)


def targets(sized: DataFrame, share: float = 1.5, passes: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sized: (source, size). Rows (source, sidx, n_docs, source_size, target, words); words is the rounded target."""
    everything = Window.orderBy(F.lit(1))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("sidx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sidx") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumns({"cap": F.col("source_size").cast("double") * passes, "total": F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double") * share})
    # Capped sources come first in the order of cap / weight; what is left is shared among the others.
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("sidx").asc())
    s = s.withColumns({"before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rest": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)), "pos": F.row_number().over(by_ratio)})
    s = s.withColumn("capped", (F.col("total") - F.col("before")) * F.col("w") >= F.col("cap") * F.col("rest"))
    level = F.min(F.when(~F.col("capped"), F.struct("pos", ((F.col("total") - F.col("before")) / F.col("rest")).alias("level")))).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", level["level"])
    s = s.withColumn("target", F.when(F.col("capped") | F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("w"), F.col("cap"))))
    return s.select("source", "sidx", "n_docs", "source_size", "target", F.floor(F.col("target") + 0.5).alias("words"))


def reversed_bits(x: Column, bits: int) -> Column:
    """The van der Corput point of x, times 2^bits. The map is its own inverse."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Rows (slot, sidx, block, n_words): what each slot of the mix takes."""
    need = sources.select("sidx", "words", F.ceil(F.col("words") / block).alias("n")).where("n > 0")
    need = need.withColumn("lo", F.sum("n").over(Window.orderBy("sidx")) - F.col("n"))
    total = need.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (total - 1).bit_length())
    chunk = 1 << max(10, (bits + 1) // 2)
    spans = need.select("sidx", "words", "lo", "n", F.explode(F.sequence(F.floor(F.col("lo") / chunk), F.floor((F.col("lo") + F.col("n") - 1) / chunk))).alias("c"))
    points = sources.sparkSession.range(total).select(F.col("id").alias("point"), F.floor(F.col("id") / chunk).alias("c"))
    slots = points.join(spans, "c").where("point >= lo and point < lo + n").select("sidx", "words", reversed_bits(F.col("point"), bits).alias("slot"))
    slots = slots.withColumn("_q", F.shiftright("slot", bits // 2))
    ranked = two_level(slots, ["sidx"], "_q", [F.col("slot").asc()], "block")
    return ranked.select("slot", "sidx", "block", F.least(F.lit(block).cast("long"), F.col("words") - F.col("block") * block).alias("n_words"))


def placed(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """docs with sidx, source_size, target, words, pos and start: the document's place in its source's shuffled order."""
    s = sources.withColumnRenamed("source", "_source")
    df = docs.join(s, docs["source"].eqNullSafe(s["_source"])).drop("_source")
    df = df.withColumn("_md5", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))))
    unit = F.conv(F.substring("_md5", 1, 8), 16, 10).cast("double") / float(1 << 32)
    df = df.withColumn("_range", F.floor(unit * F.ceil(F.sqrt("n_docs"))))
    order = [F.col("_md5").asc(), F.col("doc_id").asc(), F.col("size").asc()]
    return two_level(df, ["sidx"], "_range", order, "pos", {"start": "size"}).drop("_md5", "_range")


def taken_parts(place: DataFrame, slots: DataFrame, block: int, passes: int) -> DataFrame:
    """place: (sidx, pos, start, size, source_size). Rows (sidx, pos, slot, pass, first, n): words a slot takes of a document."""
    p = place.select("sidx", "pos", "start", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    p = p.withColumn("a", F.col("start") + F.col("pass") * F.col("source_size"))
    p = p.select("sidx", "pos", "size", "pass", "a", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.greatest(F.col("size"), F.lit(1)) - 1) / block))).alias("block"))
    p = p.join(slots, ["sidx", "block"])
    lo = F.greatest(F.col("a"), F.col("block") * block)
    hi = F.least(F.col("a") + F.col("size"), F.col("block") * block + F.col("n_words"))
    return p.select("sidx", "pos", "slot", "pass", (lo - F.col("a")).alias("first"), (hi - lo).alias("n")).where("n > 0")


def mix(docs: DataFrame, share: float = 1.5, passes: int = 2, block: int = 4096, seed: int = 17) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, first_slot, last_slot), one for each document; the slots of the mix between which its words lie."""
    sized = materialise(docs.select("doc_id", "source", word_count("text").alias("size")), "sized")
    sources = materialise(targets(sized, share, passes), "sources")
    place = materialise(placed(sized, sources, seed), "placed")
    parts = taken_parts(place, schedule(sources, block), block, passes)
    taken = parts.groupBy("sidx", "pos").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    return place.join(taken, ["sidx", "pos"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")


def mixed_documents(docs: DataFrame, share: float = 1.5, passes: int = 2, block: int = 4096, seed: int = 17) -> DataFrame:
    """The mix as documents: one row for each pass over a document, with the words taken in it; columns of docs, rows in the order of slots.

    Rows are range-partitioned and sorted by the slot where their words begin, so a table written from them, read file by file, is the mix in its
    order. A whole pass keeps the text as it is. Of the document where a source's last slot ends, the words taken are joined by blanks.
    n_chars, where present, follows the text.

    The plan is made on small rows and joined to the texts by doc_id and a hash of the row; only where equal rows repeat are these numbered first.
    Defined results: as above; null texts have no words and are never taken; equal rows are interchangeable; empty tables give empty results; columns
    of any names are kept.
    """
    keyed = docs.select(F.col("doc_id").alias("_loom_d"), F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith("map")]).alias("_loom_h"), F.struct(*docs.columns).alias("_row"))
    small = materialise(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith("map")]).alias("h")), "sized")
    sources = materialise(targets(small, share, passes), "sources")
    place = materialise(placed(small, sources, seed), "placed")
    parts = taken_parts(place, schedule(sources, block), block, passes)
    spans = parts.groupBy("sidx", "pos", "pass").agg(F.min("first").alias("_first"), F.sum("n").alias("_n"), F.min("slot").alias("_slot"))
    copy = F.lit(1)
    if not small.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        number = lambda *by: F.row_number().over(Window.partitionBy(*by[:2]).orderBy(by[2]))
        place, copy = place.withColumn("_copy", number("doc_id", "h", "pos")), number("_loom_d", "_loom_h", "_loom_h")
    else:
        place = place.withColumn("_copy", F.lit(1))
    keyed = keyed.withColumn("_loom_c", copy)
    wanted = place.join(spans, ["sidx", "pos"]).select("doc_id", "h", "_copy", "size", "_first", "_n", "_slot")
    text = F.col("_row")["text"]
    words = F.slice(F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1)), (F.col("_first") + 1).cast("int"), F.col("_n").cast("int"))
    out = keyed.join(wanted, keyed["_loom_d"].eqNullSafe(wanted["doc_id"]) & (keyed["_loom_h"] == wanted["h"]) & (keyed["_loom_c"] == wanted["_copy"]))
    out = out.select("_row", "_slot", "_first", F.when(F.col("_n") == F.col("size"), text).otherwise(F.array_join(words, " ")).alias("_text"))
    out = out.repartitionByRange("_slot").sortWithinPartitions("_slot", "_first")
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
