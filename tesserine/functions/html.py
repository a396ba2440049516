"""Sections of HTML pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that hold no content, and those without an end tag.
BOILERPLATE = frozenset(("script", "style", "nav", "header", "footer", "aside", "form", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
JUNK_CLASS = re.compile(r"breadcrumb|share|social", re.I)
#: Sections with less text are dropped.
LEAST_CHARS = 40


class _Sections(HTMLParser):
    def __init__(self, only_main: bool):
        super().__init__(convert_charrefs=True)
        self.only_main, self.stack, self.sections, self.heading = only_main, [], [], None
        self.open, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        hidden = tag in BOILERPLATE or bool(JUNK_CLASS.search(a.get("class") or "")) or a.get("role") == "navigation"
        if tag in VOID:
            return
        self.stack.append((tag, hidden))
        if not self._shown():
            return
        if tag in HEADINGS:
            self.flush()
            self.open.append([tag, []])
        elif tag == "li" or tag == "p" and not any(t == "li" for t, _ in self.stack[:-1]):
            self.open.append([tag, []])

    def _shown(self) -> bool:
        return not any(h for _, h in self.stack) and (not self.only_main or any(t == "main" for t, _ in self.stack))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        shown = self._shown()
        while self.stack:
            t, _ = self.stack.pop()
            if t == tag:
                break
        if shown and self.open and self.open[-1][0] == tag:
            text = "".join(self.open.pop()[1])
            if tag in HEADINGS:
                self.heading = " ".join(text.split())
            else:
                self.parts.append(text)

    def handle_data(self, data):
        if self._shown():
            for _, parts in self.open:
                parts.append(data)

    def flush(self):
        text = " ".join(" ".join(self.parts).split())
        if self.heading and len(text) >= LEAST_CHARS:
            self.sections.append((self.heading, text))
        self.parts = []


def sections(page: str | None) -> list[tuple[str, str]]:
    """(heading, text) of a page in order: the text of paragraphs and list items below each heading of the first three levels."""
    if not page:
        return []
    p = _Sections("<main" in page.lower())
    p.feed(page)
    p.close()
    p.flush()
    return p.sections


def page_sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, heading, text): every section of every page; NULL pages have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(k, i, h, t) for k, v in zip(pdf["key"], pdf["html"]) for i, (h, t) in enumerate(sections(v))], columns=["key", "pos", "heading", "text"])

    return df.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, pos int, heading string, text string").withColumnRenamed("key", key)
