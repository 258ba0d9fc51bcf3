"""Evidence for answers: relevant segments of retrieved texts, context, sources, and checks of an answer."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from loomspark.functions import patterns as P
from loomspark.functions import text as T


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def relevance(terms: Column, phrases: Column, title_terms: Column, segment: Column, rank: Column) -> Column:
    """How well a segment answers a query: terms .52, title terms .16, phrases .14, legal words .08, rank .06, length .04."""
    plain = F.lower(T.collapse(segment))
    hits = T.let(plain, lambda x: F.size(F.filter(phrases, lambda p: x.contains(p))))
    signal = F.when(plain.rlike(P.LEGAL_SIGNAL), 1.0).otherwise(0.0)
    size = F.least(F.length(T.blank_if_null(segment)), F.lit(320)) / 320.0
    return 0.52 * _shared(terms, T.query_terms(segment)) + 0.16 * _shared(terms, title_terms) + 0.14 * F.least(hits / 3.0, F.lit(1.0)) + 0.08 * signal + 0.06 / F.greatest(rank, F.lit(1)) + 0.04 * size


def segments(results: DataFrame) -> DataFrame:
    """(query_id, source_id, pos, segment, terms, phrases, title_terms) of results (query_id, query, source_id, title, text): sentences, or the first 600 characters.

    What depends on the query or the title only is made once a result, before its segments are told apart.
    """
    whole = F.substring(T.collapse("text"), 1, 600)
    # Few bytes, but much work a byte: spread over all cores, which the size of the rows alone would not ask for.
    results = results.repartition(results.sparkSession.sparkContext.defaultParallelism)
    made = results.select("query_id", "source_id", T.terms("query").alias("_w"), T.query_terms("title").alias("title_terms"), T.sentences("text").alias("_cut"), F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")).alias("_whole"))
    own = made.select("query_id", "source_id", F.array_distinct("_w").alias("terms"), T.phrases(F.col("_w")).alias("phrases"), "title_terms", F.when(F.size("_cut") > 0, F.col("_cut")).otherwise(F.col("_whole")).alias("_own"))
    return own.select("query_id", "source_id", "terms", "phrases", "title_terms", F.posexplode("_own").alias("pos", "segment"))


def ranked_evidence(results: DataFrame, limit: int = 8, per_source: int = 3) -> DataFrame:
    """(query_id, rank, source_id, segment, score): best segments first, each text once, at most ``per_source`` a source.

    A text left out because its source is full may still come from another source, so the choice is a fold over a query's
    segments in order; they are at most those of its retrieved texts. Segments are told as they were cut: the first 600 characters of a text may end
    in a blank.
    """
    s = segments(results).select("query_id", "source_id", "pos", "segment", F.round(relevance(F.col("terms"), F.col("phrases"), F.col("title_terms"), F.col("segment"), F.col("source_id")), 6).alias("score"), F.lower(T.collapse("segment")).alias("plain")).where("plain <> ''")
    # Of one text in one source the first stands for all; the fold then meets few rows.
    s = s.groupBy("query_id", "source_id", "plain").agg(F.max_by(F.struct("score", "pos", "segment"), F.struct("score", -F.col("pos"))).alias("b")).select("query_id", "source_id", "plain", "b.*")
    w = Window.partitionBy("query_id", "source_id").orderBy(F.col("score").desc(), "pos")
    # Within a source no segment beyond this place can be chosen: each earlier one is chosen or its text already was.
    s = s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit + per_source)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "source_id", "pos", "plain", "segment")))
    kind = "array<struct<minus double, source_id long, pos int, plain string, segment string>>"
    g = s.withColumn("source_id", F.col("source_id").cast("long")).groupBy("query_id").agg(ordered.alias("c"))

    def take(chosen: Column, x: Column) -> Column:
        full = F.size(F.filter(chosen, lambda y: y["source_id"] == x["source_id"])) >= per_source
        again = F.exists(chosen, lambda y: y["plain"] == x["plain"])
        return F.when((F.size(chosen) >= limit) | full | again, chosen).otherwise(F.concat(chosen, F.array(x)))

    g = g.select("query_id", F.posexplode(F.aggregate("c", F.array().cast(kind), take)).alias("i", "x"))
    return g.select("query_id", (F.col("i") + 1).cast("long").alias("rank"), "x.source_id", "x.segment", (-F.col("x.minus")).alias("score"))


def has_evidence(ranked: DataFrame, threshold: float = 0.16) -> DataFrame:
    """(query_id, has_evidence): whether the best segment reaches the threshold."""
    return ranked.groupBy("query_id").agg((F.max("score") >= threshold).alias("has_evidence"))


def shortened(x: Column, limit: int = 360) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 3)), F.lit("..."))).otherwise(x)


def best_sentence(results: DataFrame) -> DataFrame:
    """(query_id, sentence): the best segment, at most 360 characters."""
    return ranked_evidence(results, 1).select("query_id", shortened(F.col("segment")).alias("sentence"))


def sentence_of_each(results: DataFrame) -> DataFrame:
    """(query_id, source_id, sentence): the best segment of every source on its own, judged as if it were the only one."""
    alone = results.select(F.struct("query_id", "source_id").alias("query_id"), "query", F.lit(1).alias("source_id"), F.lit("").alias("title"), "text")
    best = ranked_evidence(alone, 1)
    return best.select("query_id.query_id", "query_id.source_id", shortened(F.col("segment")).alias("sentence"))


#: What stands for unknown attributes of a source.
NO_NUMBER, NO_TITLE, NO_ARTICLE = "Không rõ số hiệu", "Không rõ tiêu đề", "Không rõ điều/mục"


def _or(c: str, other: str) -> Column:
    return F.coalesce(T.null_if_blank(T.safe_text(c)), F.lit(other))


def context(results: DataFrame, budget: int = 13000, per_source: int = 3, limit: int = 10) -> DataFrame:
    """(query_id, context): a section for each source with its evidence, until the budget is first passed; one section always fits.

    results: (query_id, query, source_id, document_number, title, articles, text). A source without a place among the ``limit`` best segments
    shows the best segment of its own; one without any text has no section.
    """
    ranked = ranked_evidence(results, limit, per_source)
    ev = ranked.groupBy("query_id", "source_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment"))), lambda x: x["segment"]), 1, per_source).alias("ev"))
    parts = F.transform("ev", lambda x, i: F.concat(F.lit("Đoạn "), (i + 1).cast("string"), F.lit(": "), F.substring(x, 1, 900)))
    section = F.concat(F.lit('<SOURCE id="'), F.col("source_id").cast("string"), F.lit('">\nSố hiệu: '), _or("document_number", NO_NUMBER), F.lit("\nTiêu đề: "), _or("title", NO_TITLE), F.lit("\nĐiều/Mục: "), _or("articles", NO_ARTICLE), F.lit("\n"), F.array_join(parts, "\n"), F.lit("\n</SOURCE>"))
    s = results.join(ev, ["query_id", "source_id"], "left").join(sentence_of_each(results), ["query_id", "source_id"], "left")
    s = s.withColumn("ev", F.coalesce("ev", F.when(F.col("sentence").isNotNull(), F.array("sentence")))).where("ev is not null").select("query_id", "source_id", section.alias("section"))
    return within_budget(s, "section", budget).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "section"))), lambda x: x["section"]), "\n\n").alias("context"))


def within_budget(rows: DataFrame, text: str, budget: int, buckets: int = 256) -> DataFrame:
    """Rows of each query in order of source_id up to the first that passes the budget of characters; the first row always stays.

    Running sums are two-level: ranges of source_id within a query are summed first (map-side), so that a query with many rows is no single
    task. Ranges lie between the query's least and greatest source_id.
    """
    ends = rows.groupBy(F.col("query_id").alias("_q")).agg(F.min("source_id").alias("_lo"), F.max("source_id").alias("_hi"))
    place = F.coalesce(F.floor((F.col("source_id") - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)), F.lit(0))
    placed = rows.join(ends, F.col("query_id").eqNullSafe(F.col("_q"))).withColumn("_b", place)
    before = Window.partitionBy("query_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("query_id", "_b").agg(F.sum(F.length(text)).alias("_s"), F.count(F.lit(1)).alias("_c"))
    base = base.select(F.col("query_id").alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_earlier"))
    base = base.where((F.col("_before") <= budget) | (F.col("_earlier") == 0))  # beyond these nothing fits
    w = Window.partitionBy("query_id", "_b").orderBy("source_id")
    so_far = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.join(base, F.col("query_id").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb"))).withColumns({"_sum": F.col("_before") + so_far, "_i": F.col("_earlier") + F.row_number().over(w)})
    return out.where((F.col("_sum") <= budget) | (F.col("_i") == 1)).select(*rows.columns)


@F.pandas_udf(StringType())
def clean_answer(answers: pd.Series) -> pd.Series:
    """A generated answer without thoughts, leaked markers and repetition: lines and paragraphs are read in order, so this is Python."""
    plain = lambda s: re.sub(r"\s+", " ", s.casefold()).strip()

    def one(text: str | None) -> str:
        text = re.sub(r"<(think|analysis|reasoning)>.*?</\1>", "", text or "", flags=re.I | re.S)
        for mark in P.LEAKAGE:
            if text.casefold().startswith(mark.casefold()):
                text = text[len(mark) :]
        text = re.sub(r"^\s*\[(?:n|\d+)\]\s*[.:\-]*\s*", "", text.strip(), flags=re.I)
        lines: list[str] = []
        seen: list[str] = []
        for line in re.sub(r"\n{3,}", "\n\n", text).splitlines():
            key = plain(line)
            if key and seen and key == seen[-1]:
                continue
            if seen.count(key) >= 2:
                break
            lines.append(line.rstrip())
            seen.append(key)
        paragraphs: dict[str, str] = {}
        for part in re.split(r"\n\s*\n", "\n".join(lines).strip()):
            part = re.sub(r"\s+", " ", part).strip()
            if not part:
                continue
            if part.casefold() in paragraphs:
                break
            paragraphs[part.casefold()] = part
        return "\n\n".join(paragraphs.values())

    return answers.map(one)


@F.pandas_udf(DoubleType())
def copy_ratio(answers: pd.Series, texts: pd.Series) -> pd.Series:
    """The greatest likeness of an answer to any of its sources' texts, both cut at 4000 characters."""
    plain = lambda s: re.sub(r"\s+", " ", (s or "").casefold()).strip()[:4000]

    def one(answer: str | None, sources) -> float:
        a = plain(answer)
        return max((SequenceMatcher(None, a, t).ratio() for t in map(plain, sources if sources is not None else ()) if t), default=0.0) if a else 0.0

    return pd.Series([one(a, t) for a, t in zip(answers, texts, strict=True)])


def answer_is_valid(answer: str, texts: str, has_evidence: str) -> Column:
    """16 to 450 words, no forbidden fragment, no refusal in the face of evidence, no repetition, no leading mark, and no copy."""
    a = T.blank_if_null(answer)
    n = F.regexp_count(a, F.lit(r"(?U)\S+"))
    fragments = F.lit(False)
    for f in P.FORBIDDEN:
        fragments = fragments | F.lower(a).contains(f)
    first = F.trim(F.split(a, r"\r\n|[\n\r]")[0])
    return (n >= 16) & (n <= 450) & ~fragments & ~(T.contains_refusal(a) & F.col(has_evidence)) & ~T.degenerate(a) & ~first.rlike(P.I + r"^(?:\[(?:n|\d+)\]|Điều\s+\d+)") & (copy_ratio(F.col(answer), F.col(texts)) < 0.86)


def without_source_section(answer: Column | str) -> Column:
    a = T.blank_if_null(answer)
    a = F.regexp_replace(a, r"(?isU)\n\s*(?:Nguồn|Nguồn trích dẫn|Tài liệu tham khảo)\s*:\s*\n.*$", "")
    return F.regexp_replace(F.regexp_replace(a, r"(?isU)\n\s*#{1,4}\s*(?:Nguồn|Nguồn trích dẫn|Tài liệu tham khảo).*$", ""), r"(?U)^\s+|\s+$", "")


def attributed_sources(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, source_id, score, rank): the up to three sources nearest to an answer; where none scores, the first two.

    answers: (query_id, answer); results: (query_id, source_id, title, articles, text).
    """
    own = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "articles", "text")])
    r = results.join(answers, "query_id")
    r = r.withColumn("score", F.round(0.85 * _shared(T.query_terms("answer"), T.query_terms(own)) + 0.15 / F.col("source_id"), 6))
    r = r.withColumn("_any", F.max("score").over(Window.partitionBy("query_id")) > 0)
    w = Window.partitionBy("query_id").orderBy(F.when(F.col("_any"), F.col("score")).desc_nulls_last(), F.when(F.col("_any"), -F.col("source_id")).otherwise(F.col("source_id")))
    r = r.withColumn("rank", F.row_number().over(w).cast("long")).where((F.col("_any") & (F.col("rank") <= 3) & (F.col("score") > 0)) | (~F.col("_any") & (F.col("rank") <= 2)))
    return r.select("query_id", F.col("source_id").cast("long").alias("source_id"), "score", "rank")


def source_section(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, section): the sources an answer is nearest to, each with its best sentence, title and address.

    results: (query_id, query, source_id, document_number, title, articles, url, text).
    """
    named = attributed_sources(answers, results).join(results, ["query_id", "source_id"]).join(sentence_of_each(results), ["query_id", "source_id"], "left")
    quote = F.coalesce("sentence", F.substring(T.collapse("text"), 1, 360))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("- [Nguồn "), F.col("source_id").cast("string"), F.lit("] "), _or("document_number", NO_NUMBER), F.lit(" — "), _or("articles", NO_ARTICLE), F.lit(".")),
        F.concat(F.lit("  Trích đoạn: “"), quote, F.lit("”")),
        F.concat(F.lit("  Văn bản: "), _or("title", NO_TITLE)),
        F.when(T.safe_text("url") != "", F.concat(F.lit("  URL: "), T.safe_text("url"))),
    )
    one = named.select("query_id", F.struct("rank", lines.alias("x")).alias("x"))
    return one.groupBy("query_id").agg(F.concat(F.lit("Nguồn trích dẫn:\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["x"]), "\n")).alias("section"))


def extractive_answer(results: DataFrame, limit: int = 7, most: int = 4) -> DataFrame:
    """(query_id, answer): a conclusion from the best segment and up to three more as a list; queries whose results have no text say so.

    The ``limit`` best segments are shortened, and the first ``most`` distinct ones are told.
    """
    ranked = ranked_evidence(results, limit)
    own = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment"))), lambda x: shortened(T.collapse(x["segment"]))), 1, most)
    told = ranked.groupBy("query_id").agg(own.alias("s"))
    dotted = lambda x: F.concat(F.rtrim(x, F.lit(".")), F.lit("."))
    more = F.transform(F.slice("s", F.lit(2), F.lit(most)), lambda x: F.concat(F.lit("- "), dotted(x)))
    alone = F.array(F.lit("- Phạm vi áp dụng cần được đối chiếu với số hiệu, địa phương và thời kỳ của văn bản trong phần nguồn trích dẫn."))
    body = F.concat(F.lit("Kết luận:\nDựa trên tài liệu được truy xuất, "), dotted(F.col("s")[0]), F.lit("\n\nThông tin chính:\n"), F.array_join(F.when(F.size("s") > 1, more).otherwise(alone), "\n"))
    empty = "Kết luận:\nKhông có nội dung văn bản để tổng hợp.\n\nThông tin chính:\n- Kết quả retrieval không chứa nội dung chunk."
    return results.select("query_id").distinct().join(told, "query_id", "left").select("query_id", F.coalesce(F.when(F.col("s").isNotNull(), body), F.lit(empty)).alias("answer"))


#: Fixed value: the answer where no result has a text.
NOTHING = "Không thể sinh câu trả lời vì các kết quả retrieval không có nội dung chunk."


def answers(results: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """(query_id, answer): a generated answer where a valid one is given, else an extracted one, without sources of its own and with those it is nearest to.

    results: as in ``source_section``; generated: (query_id, generated), from any model. Results without text don't count.
    """
    usable = results.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    have = has_evidence(ranked_evidence(usable, 1))
    texts = usable.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "text"))), lambda x: x["text"]).alias("texts"))
    base = extractive_answer(usable).join(texts, "query_id").join(have, "query_id", "left").withColumn("has_evidence", F.coalesce("has_evidence", F.lit(False)))
    if generated is None:
        chosen = F.col("answer")
    else:
        base = base.join(generated.groupBy("query_id").agg(F.min("generated").alias("generated")), "query_id", "left").withColumn("cleaned", clean_answer(F.coalesce("generated", F.lit(""))))
        chosen = F.when(answer_is_valid("cleaned", "texts", "has_evidence"), F.col("cleaned")).otherwise(F.col("answer"))
    picked = base.select("query_id", without_source_section(chosen).alias("answer"))
    full = picked.join(source_section(picked, usable), "query_id").select("query_id", F.concat("answer", F.lit("\n\n"), "section").alias("answer"))
    return results.select("query_id").distinct().join(full, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NOTHING)).alias("answer"))
