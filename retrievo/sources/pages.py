"""Web pages: titles, links and list entries, without a browser."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(html: Column) -> Column:
    """Targets of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href="([^"]*)\""""), F.lit(1))


def entries(pages: DataFrame) -> DataFrame:
    """page_id, place, title, url, dates, summary of the entries (div.spost) of the listing (div#tabs-1).

    A list entry without a linked title has the fallbacks of the listing: no title found, "#".
    """
    from html.parser import HTMLParser

    class Listing(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.found, self.entry = [], [], None

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img", "meta", "link", "input", "hr"):
                return
            attrs = dict(attrs)
            self.stack.append((tag, attrs, []))
            inside = any(a.get("id") == "tabs-1" for t, a, _ in self.stack if t == "div")
            if tag == "div" and inside and "spost" in (attrs.get("class") or "").split():
                self.entry = {"depth": len(self.stack), "title": None, "url": None, "dates": None, "summary": None}

        def handle_data(self, data):
            for _, _, text in self.stack:
                text.append(data)

        def handle_endtag(self, tag):
            while self.stack:
                name, attrs, parts = self.stack.pop()
                if self.entry is not None:
                    self.close(name, attrs, "".join(parts))
                if name == tag:
                    break

        def close(self, name, attrs, text):
            e, plain = self.entry, " ".join(text.split())
            if name == "a" and e["title"] is None and any(t == "strong" for t, _, _ in self.stack):
                e["title"], e["url"] = plain, attrs.get("href") or "#"
            if name == "div" and e["dates"] is None and "small" in (attrs.get("class") or "").split() and "Register" in plain:
                e["dates"] = plain
            if name == "div" and e["summary"] is None and plain.startswith("Tanggal") and "Register" not in plain:
                e["summary"] = plain
            if name == "div" and len(self.stack) < e["depth"]:
                self.found.append(e)
                self.entry = None

    def run(batches):
        for pdf in batches:
            out = []
            for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
                listing = Listing()
                listing.feed(html or "")
                out += [(page, i, e["title"] or "Judul Tidak Ditemukan", e["url"] or "#", e["dates"], e["summary"]) for i, e in enumerate(listing.found)]
            yield pd.DataFrame(out, columns=["page_id", "place", "title", "url", "dates", "summary"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, place int, title string, url string, dates string, summary string")


def listed(pages: DataFrame, container: str, item: str, link: str = "a", no_title: str = "", no_url: str = "#") -> DataFrame:
    """page_id, place, title, url of each ``item`` element inside a ``container`` element, by a stack of open tags.

    The first ``link`` inside an item names it; without one its own text does, then ``no_title``; a link
    without a target, or none, gives ``no_url``.  Items that the page doesn't close end with the next item
    or with their container; containers may be nested, items in them count once.
    """
    from html.parser import HTMLParser

    class Items(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.item, self.found = 0, None, []

        def end_item(self):
            if self.item is not None:
                e, self.item = self.item, None
                text = " ".join("".join(e["link"] if e["link"] is not None else e["text"]).split())
                self.found.append((text or no_title, e["url"] or no_url))

        def handle_starttag(self, tag, attrs):
            self.inside += tag == container
            if self.inside and tag == item:
                self.end_item()
                self.item = {"text": [], "link": None, "open": False, "url": None}
            elif self.item is not None and tag == link and self.item["link"] is None:
                self.item |= {"link": [], "open": True, "url": dict(attrs).get("href")}

        def handle_data(self, data):
            if self.item is not None:
                self.item["text"].append(data)
                if self.item["open"]:
                    self.item["link"].append(data)

        def handle_endtag(self, tag):
            if self.item is not None and tag == link:
                self.item["open"] = False
            if tag == item or (tag == container and self.inside == 1):
                self.end_item()
            if tag == container and self.inside:
                self.inside -= 1

        def close(self):
            super().close()
            self.end_item()

    def run(batches):
        for pdf in batches:
            out = []
            for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
                items = Items()
                items.feed(html or "")
                items.close()
                out += [(page, i, title, url) for i, (title, url) in enumerate(items.found)]
            yield pd.DataFrame(out, columns=["page_id", "place", "title", "url"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, place int, title string, url string")
