"""Scalar text functions, as Column -> Column. Built-in expressions throughout, but for Unicode decomposition, which Spark lacks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspark.functions import patterns as P

SPACES = r"(?U)\s+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_if_null(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def null_if_blank(x: Column) -> Column:
    return F.when(x != "", x)


def collapse(x: Column | str) -> Column:
    """Runs of any white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(blank_if_null(x), SPACES, " "))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, for text that may come decomposed."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: In these ranges composition may change a text: outside Latin up to its accented Vietnamese letters, general punctuation and currency signs.
#: They are told outright: Java tests a negated class of many ranges four times slower.
_MAY_COMPOSE = r"[\x{300}-\x{1dff}\x{1f00}-\x{2001}\x{2070}-\x{209f}\x{20d0}-\x{10ffff}]"


def composed(x: Column | str) -> Column:
    """NFC. Only texts that composition may change go to Python."""
    t = _c(x)
    return F.coalesce(nfc(F.when(t.rlike(_MAY_COMPOSE), t)), t)


def normalize_text(x: Column | str) -> Column:
    """Composed; line ends unified, blanks collapsed within lines, at most one empty line in a row."""
    t = F.regexp_replace(F.regexp_replace(composed(blank_if_null(x)), r"\r\n?", "\n"), "\u00a0", " ")
    lines = F.transform(F.split(t, "\n"), lambda line: F.regexp_replace(F.regexp_replace(line, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def flatten(x: Column | str) -> Column:
    """One line, composed; no blank before punctuation."""
    return flatten_composed(composed(blank_if_null(x)))


def flatten_composed(x: Column) -> Column:
    """``flatten`` of text that is composed: no Python."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, SPACES, " "), r" ([,.;:!?])", "$1"))


def clean_table(x: Column | str) -> Column:
    """Rows of pipe-separated cells as sentences: cells joined by '; ', rows by '. '."""

    def row(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, r"\|+"), collapse), lambda c: (c != "") & ~c.rlike(r"(?U)^[-:\s]+$"))
        return F.when(line.contains("|"), F.array_join(cells, "; ")).otherwise(flatten_composed(line))

    lines = F.filter(F.transform(F.split(composed(blank_if_null(x)), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")
    rows = F.filter(F.transform(lines, lambda t: F.struct(t.alias("line"), row(t).alias("row"))), lambda r: ~r["line"].contains("|") | (r["row"] != ""))
    t = F.array_join(F.transform(rows, lambda r: r["row"]), ". ")
    t = F.regexp_replace(F.regexp_replace(t, SPACES, " "), r"(?:;\s*){2,}", "; ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([,.;:!?])", "$1"), r"\.{2,}", ".")
    return F.btrim(t, F.lit(" ."))


def _hard_cut(sentence: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, cut at the last blank that allows it."""
    out, start, end = [], 0, len(sentence)
    while end - start > limit:
        at = sentence.rfind(" ", start + 1, start + limit + 1)
        at = at if at > 0 else start + limit
        out.append(sentence[start:at].strip())
        start = at
        while start < end and sentence[start].isspace():
            start += 1
    return [*out, sentence[start:end]]


def packed(text: str | None, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, packed from whole sentences where these fit."""
    pieces: list[str] = []
    held = ""
    for sentence in filter(None, map(str.strip, re.split(r"(?<=[.;!?])\s+", text or ""))):
        if held and len(held) + 1 + len(sentence) <= limit:
            held = f"{held} {sentence}"
            continue
        if held:
            pieces.append(held)
        *done, held = _hard_cut(sentence, limit)
        pieces += done
    return pieces + [held] * bool(held)


def split_long(x: Column | str, limit: int = 3000) -> Column:
    """``packed`` of a flattened text."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(t, limit))

    flat = flatten(x)
    return F.when(flat == "", F.array().cast("array<string>")).when(F.length(flat) <= limit, F.array(flat)).otherwise(pieces(flat))


def normalize_sector(x: Column | str) -> Column:
    return F.lower(collapse(x))


def sector_matches(sectors: Column | str, target: str) -> Column:
    """Whether any of an array of sectors equals or contains the target; a blank target matches nothing."""
    wanted = " ".join(target.split()).lower()
    return F.coalesce(F.exists(_c(sectors), lambda s: normalize_sector(s).contains(wanted)), F.lit(False)) if wanted else F.lit(False)


def document_number(x: Column | str) -> Column:
    """A document number as chunks carry it: upper case, hyphens unified, no white space; null if blank."""
    t = F.regexp_replace(F.upper(_c(x)), "[–—]", "-")
    return null_if_blank(F.regexp_replace(t, SPACES, ""))


def safe_id(x: Column | str) -> Column:
    """ASCII letters and digits joined by '_'. Accents are dropped where Unicode decomposes them."""

    @F.pandas_udf("string")
    def decomposed(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str:
            plain = "".join(c for c in unicodedata.normalize("NFKD", v or "") if not unicodedata.combining(c))
            return re.sub("[^A-Za-z0-9]+", "_", plain).strip("_").lower()

        return values.map(one)

    return decomposed(_c(x).cast("string"))


def ascii_id(x: Column | str) -> Column:
    """``safe_id`` for values that are ASCII: no Python."""
    return F.lower(F.btrim(F.regexp_replace(blank_if_null(_c(x).cast("string")), "[^A-Za-z0-9]+", "_"), F.lit("_")))


def looks_like_title(x: Column | str) -> Column:
    """At most 250 characters, with a letter, at least 70 % of the letters in upper case."""
    t = blank_if_null(x)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return (F.length(t) <= 250) & (letters > 0) & (F.regexp_count(t, F.lit(r"\p{Lu}")) >= 0.7 * letters)


def spans_overlap(start: Column, end: Column, spans: Column) -> Column:
    """Whether the half-open [start, end) meets any of an array of (s, e)."""
    return F.exists(spans, lambda s: (start < s["e"]) & (end > s["s"]))


def clause_numbers(x: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(blank_if_null(x), F.lit(P.CLAUSE_NUMBER), F.lit(1)), F.lower)


def clean(x: Column | str) -> Column:
    """A graph attribute: text without white space runs; null, NaN and blank become empty."""
    t = collapse(_c(x).cast("string"))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def graph_number(x: Column | str) -> Column:
    """A document number as graph keys carry it: upper case, no white space, dashes as they are."""
    return F.regexp_replace(F.upper(clean(x)), SPACES, "")


def relation(x: Column | str) -> Column:
    return F.coalesce(null_if_blank(F.btrim(F.regexp_replace(F.upper(clean(x)), "[^A-Z0-9_]+", "_"), F.lit("_"))), F.lit("REFERS_TO"))


def stable_id(prefix: str, *values: Column | str) -> Column:
    """prefix:SHA-1 of the cleaned values, 20 hex digits."""
    joined = F.concat_ws("\x1f", *[clean(v) for v in values])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(joined.cast("binary")), 1, 20))


def heading_if(x: Column | str, pattern: str) -> Column:
    """The cleaned value if it matches the pattern, else empty."""
    t = clean(x)
    return F.when(t.rlike(pattern), t).otherwise("")


def json_list(values: Column | str) -> Column:
    """Distinct non-empty cleaned values in order, as a JSON array."""
    return F.to_json(F.array_distinct(F.filter(F.transform(_c(values), clean), lambda v: v != "")))


def safe_text(x: Column | str) -> Column:
    t = F.trim(blank_if_null(_c(x).cast("string")))
    return F.when(F.lower(t).isin("none", "null", "nan", ""), "").otherwise(t)


#: What stands for an empty text, and the label of contents.
EMPTY_TEXT, CONTENT_LABEL = "[EMPTY LEGAL CHUNK]", "Nội dung"


def text_or_placeholder(x: Column | str, placeholder: str = EMPTY_TEXT) -> Column:
    return F.coalesce(null_if_blank(safe_text(x)), F.lit(placeholder))


def contextual_text(labels: dict[str, str], content: str, content_label: str = CONTENT_LABEL) -> Column:
    """'label: value' lines of the columns that have a value, then the content under its own label."""
    lines = [F.when(safe_text(c) != "", F.concat(F.lit(f"{label}: "), safe_text(c))) for c, label in labels.items()]
    return F.concat_ws("\n", *lines, F.when(safe_text(content) != "", F.concat(F.lit(f"{content_label}:\n"), safe_text(content))))


def identifier(x: Column | str) -> Column:
    return F.trim(blank_if_null(_c(x).cast("string")))


def weight(x: Column | str) -> Column:
    """A finite number, else 1.0."""
    w = F.expr(f"try_cast(`{x}` AS double)") if isinstance(x, str) else x.try_cast("double")
    return F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 1.0).otherwise(w)


def id_list(x: Column | str) -> Column:
    """Ids from a JSON array, a JSON scalar, a list in single quotes, or comma-separated text."""
    t = F.trim(blank_if_null(x))
    listed = F.from_json(F.when(t.startswith("["), t), "array<string>")
    quoted = F.from_json(F.when(t.startswith("["), F.translate(t, "'", '"')), "array<string>")
    parts = F.transform(F.split(F.regexp_replace(t, r"^\[|\]$", ""), ","), lambda p: F.btrim(F.trim(p), F.lit("'\"")))
    return F.filter(F.coalesce(listed, quoted, parts), lambda v: v.isNotNull() & (F.trim(v) != ""))


def relevant_ids(x: Column | str) -> Column:
    """Ids of an evaluation item: a list literal, else split at the first kind of separator present (| then ; then ,), else one id."""
    t = F.trim(blank_if_null(x))
    strip = lambda v: F.btrim(F.trim(v), F.lit("'\""))
    pieces = F.when(t.contains("|"), F.split(t, r"\|")).when(t.contains(";"), F.split(t, ";")).when(t.contains(","), F.split(t, ",")).otherwise(F.array(t))
    literal = F.when(t.startswith("["), id_list(t))
    return F.filter(F.coalesce(literal, F.transform(pieces, strip)), lambda v: v != "")


def quoted_ids(x: Column | str) -> Column:
    """Ids of a variant table: a list literal; where that can't be read, whatever stands in quotes; else as ``relevant_ids``."""
    t = F.trim(blank_if_null(x))
    listed = F.coalesce(F.from_json(F.when(t.startswith("["), t), "array<string>"), F.from_json(F.when(t.startswith("["), F.translate(t, "'", '"')), "array<string>"))
    tokens = F.transform(F.regexp_extract_all(t, F.lit(r"""'[^']*'|"[^"]*\""""), F.lit(0)), lambda v: F.trim(F.substring(v, 2, F.length(v) - 2)))
    return F.filter(F.coalesce(listed, F.when(F.size(tokens) > 0, tokens), relevant_ids(t)), lambda v: v.isNotNull() & (F.trim(v) != ""))


def viewer_id(x: Column | str) -> Column:
    """Integral decimals lose their '.0'; blank becomes null."""
    t = F.trim(_c(x).cast("string"))
    t = F.regexp_replace(t, r"^(-*\d+)\.0$", "$1")
    return F.when(~F.lower(t).isin("", "nan", "inf", "-inf", "infinity", "-infinity"), t)


def json_safe(df: DataFrame, *columns: str) -> Column:
    """Columns of df as a JSON object; numbers that aren't finite become null, and nulls are told."""
    real = {n for n, t in df.dtypes if t in ("double", "float")}
    return F.to_json(F.struct(*[F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) if c in real else F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def first_value(*columns: str) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[null_if_blank(F.trim(F.col(c).cast("string"))) for c in columns])


def short_label(x: Column | str, limit: int = 70) -> Column:
    t = blank_if_null(x)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def html_escape(x: Column | str) -> Column:
    t = blank_if_null(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def distinct_ids(x: Column | str) -> Column:
    return F.array_distinct(F.filter(_c(x), lambda v: v.isNotNull()))


def terms(x: Column | str) -> Column:
    """Lower-case tokens of two and more characters that aren't stop words, in order."""
    tokens = F.regexp_extract_all(F.lower(blank_if_null(x)), F.lit(P.EVIDENCE_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*P.STOPWORDS))


def query_terms(x: Column | str) -> Column:
    return F.array_distinct(terms(x))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def phrases(t: Column) -> Column:
    """Distinct runs of two, three and four of an array of terms."""

    def runs(k: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) >= k, joined).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, (2, 3, 4))))


def query_phrases(x: Column | str) -> Column:
    """Distinct runs of two, three and four terms."""
    return let(terms(x), phrases)


def sentences(x: Column | str, least: int = 18) -> Column:
    """Sentences, clauses and list items of at least ``least`` characters."""
    t = F.regexp_replace(collapse(x), P.LIST_MARK, "\n")
    parts = F.transform(F.split(t, P.SENTENCE_END), lambda s: collapse(F.btrim(s, F.lit(" -–•"))))
    return F.filter(parts, lambda s: F.length(s) >= least)


def contains_refusal(x: Column | str) -> Column:
    t = F.lower(collapse(x))
    hit = F.lit(False)
    for p in P.REFUSALS:
        hit = hit | t.contains(p)
    return hit


def degenerate(x: Column | str) -> Column:
    """A line three times or more, or at least 40 words of which under 23 % are distinct; empty text too."""
    lines = F.filter(F.transform(F.split(blank_if_null(x), r"\r\n|[\n\r]"), lambda s: F.lower(collapse(s))), lambda s: s != "")
    ordered = F.array_sort(lines)
    thrice = F.exists(F.sequence(F.lit(1), F.greatest(F.size(lines) - 2, F.lit(1))), lambda i: F.try_element_at(ordered, i) == F.try_element_at(ordered, i + 2))
    words = F.regexp_extract_all(F.lower(blank_if_null(x)), F.lit(P.EVIDENCE_TOKEN), F.lit(0))
    return (F.size(lines) == 0) | F.coalesce(thrice, F.lit(False)) | ((F.size(words) >= 40) & (F.size(F.array_distinct(words)) / F.size(words) < 0.23))
