"""Parsers of landed HTML pages and raw mails: per row, in Arrow batches, where no SQL function reaches.

Fetching is the connector's work; these turn what it landed into rows.
"""

import base64
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.urls import links_in_html, links_in_text, strip_html, unique_links

CARD_TAGS = ("article", "li", "tr", "section", "div")
LEAST, MOST = 40, 3500


class _Cards(HTMLParser):
    """For each posting link, the text of the nearest enclosing block of a plausible length."""

    def __init__(self, link_pattern: str):
        super().__init__(convert_charrefs=True)
        self.pattern = re.compile(link_pattern, re.I)
        self.open: list[tuple[str, list[str], list[tuple[str, list[str]]]]] = [("root", [], [])]
        self.cards: list[tuple[str, str, str]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        href = dict(attrs).get("href") or ""
        if tag == "a" and self.pattern.search(href):
            words: list[str] = []
            self.open[-1][2].append((href, words))
            self.open.append(("a", words, []))
        elif tag in CARD_TAGS:
            self.open.append((tag, [], []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag not in (*CARD_TAGS, "a") or not any(t == tag for t, _, _ in self.open[1:]):
            return
        while len(self.open) > 1:
            name, words, links = self.open.pop()
            text = " ".join(words)
            above = self.open[-1]
            if name != "a":
                if links and LEAST <= len(text) <= MOST:
                    self.cards += [(href, " ".join(title), text) for href, title in links]
                else:
                    above[2].extend(links)
            above[1].extend(words)
            if name == tag:
                return

    def handle_data(self, data):
        if not self.hidden and (text := " ".join(data.split())):
            self.open[-1][1].append(text)


def cards_of(html: str | None, link_pattern: str) -> list[tuple[str, str, str]]:
    """(link, link text, card text), each link once."""
    parser = _Cards(link_pattern)
    parser.feed(html or "")
    parser.close()
    seen: dict[str, tuple[str, str, str]] = {}
    for card in parser.cards:
        seen.setdefault(card[0], card)
    return list(seen.values())


def html_cards(pages: DataFrame, html_col: str = "html", link_pattern: str = "job", keep: list[str] | None = None) -> DataFrame:
    """Kept columns of the page with link, title and description of each card on it."""
    kept = keep if keep is not None else [n for n in pages.columns if n != html_col]
    rows = pages.select(*kept, html_col)
    schema = T.StructType([*(rows.schema[n] for n in kept), *(T.StructField(n, T.StringType()) for n in ("link", "title", "description"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cards_of(h, link_pattern) for h in batch.column(html_col).to_pylist()]
            at = pa.array([i for i, cards in enumerate(found) for _ in cards], pa.int64())
            flat = [card for cards in found for card in cards]
            columns = [*(batch.column(n).take(at) for n in kept), *(pa.array([card[k] for card in flat], pa.string()) for k in range(3))]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _decoded(data: str) -> str:
    try:
        return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")
    except ValueError:
        return ""


def mime_parts(payload: str | None) -> tuple[str, str]:
    """(plain text, HTML) of all parts of a message, a JSON tree of mimeType, body.data and parts."""
    texts: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    try:
        stack = [json.loads(payload)] if payload else []
    except ValueError:
        return "", ""
    while stack:
        part = stack.pop()
        if not isinstance(part, dict):
            continue
        kind, data = part.get("mimeType"), (part.get("body") or {}).get("data")
        if kind in texts and data:
            texts[kind].append(_decoded(data))
        stack.extend(reversed(part.get("parts") or []))
    return "\n".join(texts["text/plain"]), "\n".join(texts["text/html"])


def mails_of(messages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """messages with bodyText, bodyHtml and links (at most 80) of their payload tree."""
    @F.pandas_udf("bodyText string, bodyHtml string")
    def bodies(payload: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(payload.map(mime_parts).tolist(), columns=["bodyText", "bodyHtml"])

    rows = messages.withColumn("parts_", bodies(F.col(payload_col)))
    html = F.col("parts_.bodyHtml")
    text = F.when(F.col("parts_.bodyText") != "", F.col("parts_.bodyText")).otherwise(strip_html(html))
    return rows.withColumns({"bodyText": text, "bodyHtml": html, "links": unique_links(F.concat(links_in_html(html), links_in_text(F.col("parts_.bodyText"))))}).drop("parts_")


def header(headers, name: str):
    """The first header of that name, whatever its case, from an array of structs (name, value)."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def mail_time(internal_ms, date_header):
    """The provider's epoch milliseconds, else the date header in either of its usual forms."""
    plain = F.regexp_replace(F.coalesce(date_header, F.lit("")), r"^[A-Za-z]{3}, ", "")
    return F.coalesce(F.timestamp_millis(internal_ms.try_cast("long")), date_header.try_cast("timestamp"), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")))
