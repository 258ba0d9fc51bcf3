"""One legal document read line by line: phases, headings in force, articles and appendices.

The parser knows three phases, BODY, ADMIN (signatures) and APPENDIX, and never goes back. A document is read on its own, in plain Python: as
windows over lines each pattern met each long line several times over. Searches are made only in lines that hold a word they need.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from loomspark.functions import patterns as P
from loomspark.functions.text import packed
from loomspark.operators.citations import Extractor, _python, flat, folded, merged

#: White space at the ends of lines.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


class Chunk(NamedTuple):
    suffix: str
    part: str | None
    chapter: str | None
    section: str | None
    articles: str
    content: str
    link_to: list[dict]
    chunk_at: int
    sub: int


def normalized(text: str | None) -> str:
    """``functions.text.normalize_text``: composed, line ends unified, blanks collapsed within lines, at most one empty line in a row."""
    text = unicodedata.normalize("NFC", text or "").replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    if "  " in text or "\t" in text:
        text = re.sub(r"[ \t]+", " ", text)
    text = "\n".join(line.strip(_SPACE) for line in text.split("\n"))
    return (re.sub(r"\n{3,}", "\n\n", text) if "\n\n\n" in text else text).strip(_SPACE)


def clean_table(text: str) -> str:
    """``functions.text.clean_table`` of a composed text."""
    rows = []
    for line in filter(None, (x.strip(_SPACE) for x in text.splitlines())):
        if "|" not in line:
            rows.append(flat(line))
            continue
        cells = (" ".join(c.split()) for c in re.split(r"\|+", line))
        if row := "; ".join(c for c in cells if c and not re.fullmatch(r"[-:\s]+", c)):
            rows.append(row)
    text = re.sub(r"(?:;\s*){2,}", "; ", re.sub(r"\s+", " ", ". ".join(rows)))
    return re.sub(r"\.{2,}", ".", re.sub(r"\s+([,.;:!?])", r"\1", text)).strip(" .")


def looks_like_title(text: str) -> bool:
    """At most 250 characters, with a letter, at least 70 % of the letters in upper case."""
    if len(text) > 250:
        return False
    letters = sum(map(str.isalpha, text))
    return letters > 0 and sum(unicodedata.category(c) == "Lu" for c in text) >= 0.7 * letters


class Parser:
    def __init__(self, least: int, limit: int) -> None:
        self.least, self.limit, self.links = least, limit, Extractor().links
        self.levels = {"PART": _python(P.PART), "CHAPTER": _python(P.CHAPTER), "SECTION": _python(P.SECTION)}
        self.article, self.start, self.explicit, self.tail = map(_python, (P.ARTICLE, P.APPENDIX_START, P.APPENDIX_EXPLICIT, P.ADMIN_TAIL))
        self.key, self.inline, self.before = map(_python, (P.APPENDIX_INLINE, P.ADMIN_INLINE, r"^(.*?)\bNơi\s+nhận\s*:"))
        self.first_article = re.compile(P.FIRST_ARTICLE.removeprefix(P.I), re.IGNORECASE | re.MULTILINE)

    def header(self, text: str, low: str) -> str:
        """The text before the first article line, or all of it."""
        m = self.first_article.search(text) if "điều" in low else None
        return text[: m.start()] if m else text

    def chunks(self, content: str | None, number: str | None) -> list[Chunk]:
        """The chunks of a document, in order; the links of its header go to its first article."""
        text = normalized(content)
        if not text:
            return []
        low = folded(text)
        lines = [(i, line, f) for i, (line, f) in enumerate(zip(text.split("\n"), low.split("\n"), strict=True)) if line]
        body, appendix = self.phases(lines)
        articles, last = self.articles(body, number)
        if articles:
            head = self.links(self.header(text, low), number, "document_header")
            articles[0] = articles[0]._replace(link_to=merged(head + articles[0].link_to))
        return articles + self.appendices(appendix, last, number)

    def phases(self, lines: list[tuple[int, str, str]]) -> tuple[list[tuple[int, str, bool]], list[tuple[int, str, str | None]]]:
        """(lines of the body with whether each is a whole line, lines of appendices with the title of the one that each begins).

        The first signature mark ends the body, unless an appendix has begun. A line with ``Nơi nhận:`` inside keeps what stands before
        it in the body, and begins the appendix if an appendix keyword follows. An appendix found by keyword begins at the keyword; what stands
        before it in the line belongs to the signatures.
        """
        body: list[tuple[int, str, bool]] = []
        appendix: list[tuple[int, str, str | None]] = []
        phase = "BODY"
        for i, line, low in lines:
            explicit = bool(self.explicit.match(line) and self.start.match(line))
            if phase == "APPENDIX":
                appendix.append((i, line, line if explicit else None))
                continue
            has_key = lambda: ("phụ" in low or "danh" in low or "nội" in low) and self.key.search(line)  # noqa: B023, E731
            inline = None
            if phase == "BODY" and not explicit:
                inline = self.inline.search(line) if "nhận" in low else None
                if not inline and not self.tail.match(line):
                    body.append((i, line, True))
                    continue
                phase = "ADMIN"
                if not inline:
                    continue
                if part := self.before.match(line)[1].strip(" "):
                    body.append((i, part, False))
                keyed = line[inline.start() :]
                if key := self.key.search(keyed):
                    phase = "APPENDIX"
                    appendix.append((i, keyed[key.start() :], key[0]))
                continue
            # An explicit appendix, or a line after the signatures.
            key = has_key() if phase == "ADMIN" else None
            if key:
                phase = "APPENDIX"
                appendix.append((i, line[key.start() :], key[0]))
            elif explicit or self.start.match(line):
                phase = "APPENDIX"
                appendix.append((i, line, line))
        return body, appendix

    def kind(self, line: str) -> tuple[str, re.Match | None]:
        for name, pattern in (*self.levels.items(), ("ARTICLE", self.article)):
            if m := pattern.match(line):
                return name, m
        return "TEXT", None

    def articles(self, body: list[tuple[int, str, bool]], number: str | None) -> tuple[list[Chunk], tuple[str | None, str | None, str | None]]:
        """(a chunk for each article of at least ``least`` characters, the part, chapter and section that are in force at the body's end).

        A heading without a title takes the line below for it, if that looks like one: the last such heading of those right before the line,
        where no article is between. Headings reset those below them, parts excepted, and close the open article: text after them, before the next
        article, is no content.
        """
        kinds = [self.kind(line) if whole else ("TEXT", None) for _, line, whole in body]
        titles: dict[int, int] = {}  # of a heading that has its title below, and of that title
        pending = None
        for at, (kind, m) in enumerate(kinds):
            if kind == "TEXT":
                if pending is not None and looks_like_title(body[at][1]):
                    titles[pending] = at
                pending = None
            elif kind == "ARTICLE":
                pending = None
            elif not (m[2] or "").strip(" "):
                pending = at
        taken = set(titles.values())
        part = chapter = section = None
        order, own, found = 0, None, []
        for at, (kind, m) in enumerate(kinds):
            line_no, line, _ = body[at]
            if kind == "ARTICLE":
                order += 1
                own = [line]
                found.append((order, line_no, m, (part, chapter, section), own))
            elif kind == "TEXT":
                if own is not None and at not in taken:
                    own.append(line)
            else:
                own = None
                heading = f"{line}: {body[titles[at]][1]}" if at in titles else line
                if kind == "PART":
                    part, chapter, section = heading, None, None
                elif kind == "CHAPTER":
                    chapter, section = heading, None
                else:
                    section = heading
        out = []
        for order, line_no, m, levels, own in found:
            text = "\n".join(own)
            content = clean_table(text) if "|" in text else flat(text)
            if len(content) < self.least:
                continue
            title = (m[2] or "").strip(" ")
            name = re.sub("[^A-Za-z0-9]+", "_", m[1]).strip("_").lower()
            out.append(Chunk(f"_dieu_{name}_{order:04d}", *levels, f"Điều {m[1]}. {title}" if title else f"Điều {m[1]}", content, self.links(" ".join(own[1:]), number, "article"), line_no, 0))
        return out, (part, chapter, section)

    def appendices(self, rows: list[tuple[int, str, str | None]], levels: tuple[str | None, str | None, str | None], number: str | None) -> list[Chunk]:
        """Chunks of appendices: runs of table lines and of text lines, in pieces of at most ``limit`` characters, numbered by kind."""
        runs: list[tuple[str | None, str, int, list[str]]] = []
        title, fresh = None, True
        for line_no, line, begins in rows:
            if begins is not None:
                title, fresh = begins, True
            if not line:
                continue
            kind = "table" if line.count("|") >= 2 else "text"
            if fresh or runs[-1][1] != kind:
                runs.append((title, kind, line_no, []))
                fresh = False
            runs[-1][3].append(line)
        out, orders = [], {"table": 0, "text": 0}
        for title, kind, line_no, lines in runs:
            text = "\n".join(lines)
            content = flat(clean_table(text) if kind == "table" else text)
            pieces = [] if not content else [content] if len(content) <= self.limit else packed(content, self.limit)
            for i, piece in enumerate(pieces):
                orders[kind] += 1
                name = f"{'Phụ lục' if title is None else title} - {'Bảng' if kind == 'table' else 'Nội dung phụ lục'} {orders[kind]}" + (f", phần {i + 1}" if len(pieces) > 1 else "")
                out.append(Chunk(f"{'_bang' if kind == 'table' else '_phu_luc'}_{orders[kind]:04d}_{i + 1:02d}", *levels, name, piece, self.links(piece, number, "appendix"), line_no, i))
        return out
