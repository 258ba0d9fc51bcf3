"""Citations in legal text: references to other documents, to articles of the same one and to appendices.

Four passes over a text depend on the spans that earlier passes have used and on a precedence over the whole text, so a text's links are
found in Python: built-in regular expressions give no offsets, and emulating them repeats every scan. A pattern is tried only where one
of the words that it begins with stands, which ``str.find`` tells far sooner than the pattern itself.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from loomspark.functions import patterns as P
from loomspark.plans.tables import slices

#: What makes two links the same: all but raw_text.
LINK_KEY = ("relationship", "document_number", "article", "clause", "point", "appendix", "section", "scope")


def _python(pattern: str) -> re.Pattern:
    """The catalogue's pattern for Python, which reads Unicode by default."""
    return re.compile(pattern.removeprefix(P.I), re.IGNORECASE)


def flat(text: str | None) -> str:
    text = " ".join(unicodedata.normalize("NFC", text or "").split())
    for mark in ",.;:!?":
        text = text.replace(" " + mark, mark)
    return text.strip()


def folded(text: str) -> str:
    """text with one letter for all that a pattern which ignores case takes for it; as long as text is."""
    for odd, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        if odd in text:
            text = text.replace(odd, plain)
    return text.lower()


def number(text: str | None) -> str | None:
    return re.sub(r"\s+", "", re.sub("[–—]", "-", (text or "").upper())) or None


def _places(low: str, words: tuple[str, ...]) -> list[int]:
    """Where any of the words stands in a folded text, in order."""
    out = []
    for word in words:
        at = low.find(word)
        while at >= 0:
            out.append(at)
            at = low.find(word, at + 1)
    return sorted(out)


def _found(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """``pattern.finditer(text)``, for a pattern that can begin at these places only."""
    end = 0
    for at in places:
        if at >= end and (m := pattern.match(text, at)):
            yield m
            end = m.end()


class Extractor:
    """Finds the links of flattened texts."""

    #: The words that the patterns begin with, folded.
    IN_ARTICLE = ("điểm", "khoản", "điều")
    TYPES = ("bộ", "luật", "nghị", "thông", "quyết", "chỉ")
    #: Each match of ``keywords`` has one of these.
    KEYWORDS = ("hết", "bãi", "chấm", "sửa", "bổ", "thay")

    def __init__(self) -> None:
        self.external, self.internal, self.bare, self.appendix = map(_python, (P.EXTERNAL_REFERENCE, P.INTERNAL_REFERENCE, P.ARTICLE_ONLY, P.APPENDIX_REFERENCE))
        self.clause, self.based_on = _python(P.CLAUSE_NUMBER), _python(P.BASED_ON)
        self.keywords = {"REPEALS": _python(P.REPEAL), "AMENDS": _python(P.AMEND)}

    def externals(self, text: str, low: str) -> Iterator[re.Match]:
        """The references to documents; each has a slash and one of the types."""
        if "/" not in text or not any(t in low for t in self.TYPES):
            return iter(())
        return _found(self.external, text, _places(low, self.IN_ARTICLE + self.TYPES))

    def precedence(self, text: str, low: str | None = None) -> dict[str, str]:
        """Document number -> REPEALS or AMENDS: of each sentence with the keyword its first number; REPEALS goes first."""
        out: dict[str, str] = {}
        low = folded(text) if low is None else low
        if "/" not in text or not any(k in low for k in self.KEYWORDS):
            return out
        for sentence in re.split(r"(?<=[.;])\s+", text):
            own = folded(sentence)
            if not any(k in own for k in self.KEYWORDS):
                continue
            first = next(self.externals(sentence, own), None)
            for relation, keyword in self.keywords.items():
                if first and keyword.search(sentence) and out.get(key := number(first[4])) != "REPEALS":
                    out[key] = relation
        return out

    def links(self, text: str | None, own: str | None, scope: str) -> list[dict]:
        text, own = flat(text), number(own)
        low = folded(text)
        special = self.precedence(text, low)
        out: dict[tuple, dict] = {}
        used: list[tuple[int, int]] = []

        def add(raw: str, relation: str, to: str | None, **place: str | None) -> None:
            if to == own and not any(place.values()):
                return
            row = {"relationship": relation, "document_number": to} | {k: place.get(k) for k in ("article", "clause", "point", "appendix", "section")} | {"raw_text": flat(raw), "scope": scope}
            out.setdefault(tuple(row[k] for k in LINK_KEY), row)

        def lower(x: str | None) -> str | None:
            return x and x.lower()

        def free(m: re.Match) -> bool:
            """Whether a match meets none of the spans, which are disjoint and kept in order."""
            at = bisect_left(used, m.span())
            return (at == 0 or used[at - 1][1] <= m.start()) and (at == len(used) or used[at][0] >= m.end())

        for m in self.externals(text, low):
            to = number(m[4])
            near = self.based_on.search(text[max(0, m.start() - 150) : m.start()])
            relation = special.get(to) or ("BASED_ON" if near else "REFERS_TO")
            used.append(m.span())
            for clause in map(str.lower, self.clause.findall(m[2] or "")) if m[2] else [None]:
                add(m[0], relation, to, article=lower(m[3]), clause=clause, point=lower(m[1]))
        if articles := _places(low, ("điều",)):
            for m in _found(self.internal, text, _places(low, self.IN_ARTICLE)):
                if free(m):
                    insort(used, m.span())
                    for clause in map(str.lower, self.clause.findall(m[2])) if m[2] else [None]:
                        add(m[0], "REFERS_TO", own, article=lower(m[3]), clause=clause, point=lower(m[1]))
            for m in _found(self.bare, text, articles):
                if free(m):
                    insort(used, m.span())
                    add(m[0], "REFERS_TO", own, article=lower(m[1]))
        for m in _found(self.appendix, text, _places(low, ("mục",))):
            add(m[0], "REFERS_TO", own, appendix=m[2].upper(), section=m[1].upper())
        return list(out.values())


def merged(links: list[dict]) -> list[dict]:
    """The first of each link by LINK_KEY, in order."""
    kept: dict[tuple, dict] = {}
    for x in links:
        kept.setdefault(tuple(x[k] for k in LINK_KEY), x)
    return list(kept.values())


def document_relationships(docs: DataFrame, text: str = "content", key: str = "document_id") -> DataFrame:
    """(key, relationship, document_number): what a text repeals or amends."""
    kinds = ("REPEALS", "AMENDS")
    out = StructType([docs.schema[key], StructField("relationship", StringType()), StructField("document_number", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Extractor()
        for part in slices(batches):
            told = [(i, *pair) for i, t in enumerate(part.column(1).to_pylist()) for pair in dict.fromkeys((r["relationship"], r["document_number"]) for r in x.links(t, None, "article") if r["relationship"] in kinds)]
            at = pa.array([t[0] for t in told], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), *(pa.array([t[k] for t in told], pa.string()) for k in (1, 2))], names=out.names)

    return docs.select(key, text).mapInArrow(run, out).distinct()
