"""Quality rules (line-first cleaning).

Every line is judged by itself; lines that fail are taken out, and a document that loses too much of its text that
way is rejected. Four rules judge a line (``LineRules``):

* symbols: marks of ``[#*$%&|<>]`` on more than ``symbol_share`` of its words,
* shouting: "!!" on more than ``shout_share`` of its words, or at least ``caps_words`` words without one lower-case letter,
* boilerplate: at most ``boilerplate_words`` words and a phrase of ``BOILERPLATE``,
* punctuation and navigation: fewer than ``fragment_words`` words and no mark of ``END_MARKS`` at the end.

Base measures, also on whole texts: words, their code points, symbols, lines equal to an earlier line, and words within
5-word windows found twice or more. ``base_failed``: under ``min_words`` words, or over 20 % of them repeated.

Defined results: a null text counts as empty: no words, base_failed. A text of any length is measured as a whole. Repeated
rows give repeated rows; an empty table gives an empty result. Other columns of the input are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_PATTERN

WORD = regex.compile(WORD_PATTERN)
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, and marks that may end a sentence or a list item.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "accept cookies", "enable javascript", "lorem ipsum", "click here", "read more", "sign up", "log in", "skip to content", "subscribe to our")
END_MARKS = ".!?:;…。！？\"'”’»)]"
_BOILERPLATE = regex.compile("|".join(BOILERPLATE), regex.IGNORECASE | regex.ASCII)
_LOWER, _UPPER = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class LineRules:
    symbol_share: float = 0.2
    shout_share: float = 0.5
    caps_words: int = 5
    boilerplate_words: int = 25
    fragment_words: int = 4
    min_words: int = 10
    repeat_percent: int = 20
    lost_share: float = 0.5


def symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def line_fails(line: str, n: int, rules: LineRules) -> bool:
    """Whether a line of ``n`` words, n > 0, is taken out."""
    if symbols(line) > rules.symbol_share * n or line.count("!!") > rules.shout_share * n:
        return True
    if n >= rules.caps_words and not _LOWER.search(line) and _UPPER.search(line):
        return True
    if n <= rules.boilerplate_words and _BOILERPLATE.search(line):
        return True
    return n < rules.fragment_words and line.rstrip(" \t\n\v\f\r")[-1] not in END_MARKS


def repeated_words(words: list[str], size: int = 5) -> int:
    """Words within windows of ``size`` words that occur twice or more.

    Words become numbers, and a window the pair of two numbers of shorter ones, so that a long text takes a few arrays of eight bytes a word.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    names: dict[str, int] = {}
    own = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) == len(words):
        return 0
    window, width = own, 1
    while width < size:  # names of windows double; the last step may overlap
        step = min(width, size - width)
        pair = window[:-step] * (int(window.max()) + 1) + window[step:]
        window, width = np.unique(pair, return_inverse=True)[1].reshape(-1), width + step
    often = np.bincount(window)[window] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int(np.count_nonzero(np.cumsum(covered) > 0))


def measure(text: str | None, rules: LineRules) -> tuple[int, int, int, int, int, bool, bool]:
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    seen: set[str] = set()
    duplicates = kept_chars = 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            continue
        if line in seen:
            duplicates += 1
        seen.add(line)
        if not line_fails(line, len(own), rules):
            kept_chars += sum(map(len, own))
    repeats = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeats > rules.repeat_percent * len(words)
    return len(words), chars, symbols(text), duplicates, repeats, failed, not failed and kept_chars >= (1 - rules.lost_share) * chars


def quality_of(rules: LineRules = LineRules()):
    """A vectorised function: text column -> struct of SCHEMA."""

    @F.pandas_udf(SCHEMA)
    def quality(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for texts in parts:
            yield pd.DataFrame([measure(t, rules) for t in texts], columns=names)

    return quality


def clean_text(text: str | None, rules: LineRules = LineRules()) -> str:
    """The text without the lines that fail."""
    kept = []
    for line in (text or "").split("\n"):
        n = len(WORD.findall(line))
        if not n or not line_fails(line, n, rules):
            kept.append(line)
    return "\n".join(kept)


def measures(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the columns of SCHEMA, a row for each input row."""
    return docs.select(*keep, quality_of(rules)(F.col(text)).alias("_m")).select(*keep, "_m.*")


def keep_good(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The rows whose verdict is kept, unchanged."""
    mark = "_loomspark_quality"
    return docs.withColumn(mark, quality_of(rules)(F.col(text))).where(F.col(mark)["kept"]).drop(mark)


def cleaned_of(rules: LineRules = LineRules()):
    """A vectorised function: text column -> the cleaned text of kept documents, null for the others."""

    @F.pandas_udf("string")
    def cleaned(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([clean_text(t, rules) if measure(t, rules)[-1] else None for t in texts], dtype=object)

    return cleaned.asNondeterministic()  # else Spark runs it once for the filter and again for the text


def keep_cleaned(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The rows whose verdict is kept, without the lines that fail. n_chars, where present, follows the text."""
    mark = "_loomspark_cleaned"
    out = docs.withColumn(mark, cleaned_of(rules)(F.col(text))).where(F.col(mark).isNotNull())
    changed = {text: F.col(mark)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(mark).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])
