"""Repository links in a listing page: four ways to find them, as an Arrow UDF over html.parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.settings import CODE_HOST

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Links(HTMLParser):
    """One pass that keeps, for each way, the hrefs found; ``open`` holds enclosing elements with what they still seek."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, str | None]] = []
        self.found: dict[str, list[str]] = {w: [] for w in ("heading", "hovercard", "box_row", "aligned")}
        self.seeking: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "a":
            href = a.get("href") or ""
            for s in self.seeking:
                if s["href"] is None and (s["way"] == "heading" or a.get("itemprop") == "name codeRepository"):
                    s["href"] = href
            if a.get("data-hovercard-type") == "repository":
                self.found["hovercard"].append(href)
            if "v-align-middle" in classes and href.count("/") == 2:
                self.found["aligned"].append(href)
        if tag in _VOID:
            return
        way = "heading" if tag == "h3" and "wb-break-all" in classes else "box_row" if tag == "div" and "Box-row" in classes else None
        self.open.append((tag, way))
        if way:
            self.seeking.append({"way": way, "href": None, "depth": len(self.open)})

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, way = self.open.pop()
                if way:
                    self._done(self.seeking.pop())
                if t == tag:
                    break

    def _done(self, s: dict) -> None:
        if s["href"]:
            self.found[s["way"]].append(s["href"])

    def finish(self) -> dict[str, list[str]]:
        self.close()
        for s in self.seeking:
            self._done(s)
        self.seeking = []
        return self.found


def repo_links(html: str | None, host: str = CODE_HOST) -> list[str]:
    """All links of the four ways, in full, each once, in the order found way by way."""
    parser = _Links()
    parser.feed(html or "")
    hrefs = [h for way in parser.finish().values() for h in way]
    return list(dict.fromkeys(f"https://{host}{h}" for h in hrefs if h.startswith("/")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def repo_links_udf(html: pd.Series) -> pd.Series:
    return html.map(repo_links)


def relative_hrefs(html: Column) -> Column:
    """Distinct hrefs that begin with a slash, by pattern alone (JVM side)."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="(/[^"]*)"'), F.lit(1)))
