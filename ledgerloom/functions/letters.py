"""Structured letters and filings: confidential treatment orders and items of current reports.

Orders name exhibits in four layouts; the first layout that matches is read. Items of a report are
located by their headings; the longest one of the wanted code is its text.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: pieces of the patterns --------------------------------------------------------

EXHIBIT = r"([0-9]+(?:\.[0-9]+)*[A-Za-z]?(?:\([A-Za-z0-9]+\))?)"
DATE = r"([A-Za-z]+,?\s+[0-9]{1,2},\s*[0-9]{4})"
FORM_SHAPE = r"[A-Z0-9][A-Z0-9/-]{0,9}"
FORM = f"({FORM_SHAPE})"
FORM_BARE = r"((?:[0-9]{1,2}-[A-Z0-9]{1,4}|[A-Z]{1,2}-[0-9]{1,2})(?:/A)?)"
TITLE = r"ORDER\s+([A-Z]+(?:\s+[A-Z]+)*?)\s+CONFIDENTIAL\s+TREATMENT"
SOURCE_FORM = rf"to\s+(?:(?:an?|the|their|its)\s+)?(?:(?:\S+\s+){{0,5}}?Forms?\s+(?=[A-Z0-9/-]*[0-9]){FORM}|{FORM_BARE}\s+(?:as\s+amended\s+)?filed\b)"
SOURCE_DATES = [rf"Forms?\s+(?:{FORM_SHAPE})\s+(?:filed\s+)?(?:on\s+)?{DATE}", rf"filed\s+(?:on\s+)?{DATE}"]
INLINE = rf"Exhibits?\s+{EXHIBIT}\s+to\s+(?:an?\s+)?Forms?\s+{FORM}\s+filed\s+(?:on\s+)?{DATE}\s+through\s+{DATE}"
TABLE_HEAD = r"Exhibit\s+to\s+Form\s+Filed\s+on"
TABLE = rf"\b{EXHIBIT}\s+{FORM}\s+{DATE}\s+through\s+{DATE}"
DENIAL = rf"excluded\s+from\s+Exhibits?\s+{EXHIBIT}\s+to\s+(?:an?|the)\s+Forms?\s+{FORM}\s+filed\s+(?:on\s+)?{DATE}"
PLAIN = rf"Exhibits?\s+{EXHIBIT}(?:\s*(?:through|until)\s+{DATE})?"
LISTING = r"will\s+not\s+be\s+released|for\s+the\s+time\s+periods?\s+specified"
ITEM_HEADING = r"(?im)^[ \t]*item\s*(\d+(?:\s*\.\s*\d+)?)"
HEADING = r"^\s*item\s*\d+\s*\.?\s*\d*\s*[.:)-]*\s*"
ITEM_TITLE = r"^\s*[(\[]?\s*entry\s+into\s+(?:an?\s+)?material\s+definitive\s+agreement\s*[)\]]?\s*[.;:]*\s*"


def letter_date(raw: str | None) -> datetime.date | None:
    """A date such as 'April, 30, 2009', stray comma or not; None where it denotes none."""
    if not raw:
        return None
    try:
        return datetime.datetime.strptime(re.sub(r"\s+", " ", re.sub(r"^([A-Za-z]+),", r"\1", raw)).strip(), "%B %d, %Y").date()
    except ValueError:
        return None


def order_fields(text: str) -> dict:
    """What an order's title, rule and opening say."""
    title = re.search(TITLE, text, re.I)
    rules = sorted({r.upper() for r in re.findall(r"Rule\s+(24b-2|406)", text, re.I)})
    form = re.search(SOURCE_FORM, text, re.I)
    dates = [m for m in (re.search(p, text, re.I) for p in SOURCE_DATES) if m]
    return {
        "Status": title.group(1).upper().strip() if title else None,
        "Rule": "|".join(rules) or None,
        "SourceForm": (form.group(1) or form.group(2)).upper().strip() if form else None,
        "SourceFiledOn": letter_date(min(dates, key=lambda m: m.start()).group(1)) if dates else None,
        "IsExtension": bool(re.search(r"requesting\s+an?\s+extension", text, re.I)),
        "nRegistrants": len(re.findall(r"File\s+Nos?\.", text, re.I)),
    }


def listing_block(text: str) -> str:
    """The text from the last phrase that opens a listing; all of it where there is none."""
    found = list(re.finditer(LISTING, text, re.I))
    return text[found[-1].start() :] if found else text


def order_references(text: str, status: str | None) -> list[dict]:
    """Exhibits the order names: inline, else in a table, else (orders that deny) as excluded, else by number alone."""

    def rows(pattern: str, layout: str, body: str, parts: str) -> list[dict]:
        out = []
        for m in re.finditer(pattern, body, re.I):
            got = dict(zip(parts, m.groups(), strict=True))
            out.append({"ExhibitNo": got["e"], "RefForm": got["f"].upper() if got.get("f") else None, "RefFiledOn": letter_date(got.get("d")), "ReleaseDate": letter_date(got.get("r")), "RefFormat": layout})
        return out

    found = rows(INLINE, "inline", text, "efdr")
    if not found and re.search(TABLE_HEAD, text, re.I):
        found = rows(TABLE, "table", text, "efdr")
    if not found and status in ("DENYING", "REVOKING"):
        found = rows(DENIAL, "denial", text, "efd")
    if not found:
        found = rows(PLAIN, "plain", listing_block(text), "er")
    return found or [{"ExhibitNo": None, "RefForm": None, "RefFiledOn": None, "ReleaseDate": None, "RefFormat": "none"}]


_ORDER = [("DocID", "long"), ("Status", "string"), ("Rule", "string"), ("SourceForm", "string"), ("SourceFiledOn", "date"), ("IsExtension", "boolean"), ("nRegistrants", "long"), ("ExhibitNo", "string"), ("RefForm", "string"), ("RefFiledOn", "date"), ("ReleaseDate", "date"), ("RefFormat", "string"), ("UseForm", "string"), ("UseFiledOn", "date"), ("Series", "string")]
_ITEM = [("DocID", "long"), ("Outcome", "string"), ("nMarkers", "long"), ("nCodesRead", "long"), ("Start", "long"), ("Stop", "long"), ("nBodyChars", "long"), ("ItemText", "string")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "date": pa.date32(), "boolean": pa.bool_()}


def _per_document(docs: DataFrame, f, fields: list[tuple[str, str]]) -> DataFrame:
    schema = pa.schema([(n, _ARROW[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"DocID": d, **row} for d, t in zip(batch.column("DocID").to_pylist(), batch.column("Text").to_pylist(), strict=True) for row in f(t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("DocID").cast("long").alias("DocID"), "Text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))


def parse_order(text: str) -> list[dict]:
    fields = order_fields(text)
    out = []
    for ref in order_references(text, fields["Status"]):
        series = re.match(r"\d+", ref["ExhibitNo"] or "")
        out.append(fields | ref | {"UseForm": ref["RefForm"] or fields["SourceForm"], "UseFiledOn": ref["RefFiledOn"] or fields["SourceFiledOn"], "Series": series.group() if series else None})
    return out


def parse_orders(docs: DataFrame) -> DataFrame:
    """(DocID, fields of the order, one row a reference) of letters (DocID, Text); at least one row each."""
    return _per_document(docs, parse_order, _ORDER)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag in ("p", "div", "br", "tr", "li", "h1", "h2", "h3", "table"):
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def render(fragment: str) -> str:
    """The visible text of an HTML fragment, lines kept, spaces of each made single."""
    reader = _Text()
    reader.feed(fragment)
    reader.close()
    lines = (re.sub(r"[ \t\xa0​]+", " ", x).strip() for x in "".join(reader.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def body_length(text: str | None) -> int | None:
    """Characters without the heading and the regulated title."""
    return None if text is None else len(re.sub(ITEM_TITLE, "", re.sub(HEADING, "", text, flags=re.I), flags=re.I).strip())


def find_item(text: str, item: str = "1.01", least: int = 30) -> list[dict]:
    """One row: the outcome of looking for an item's text, and the text where there is one."""
    blank = {"nMarkers": 0, "nCodesRead": 0, "Start": None, "Stop": None, "nBodyChars": None, "ItemText": None}
    body = render(text) if "<" in text else text
    if not body.strip():
        return [blank | {"Outcome": "no-body"}]
    marks = [(m.start(), re.sub(r"\s", "", m.group(1))) for m in re.finditer(ITEM_HEADING, body)]
    if not marks:
        return [blank | {"Outcome": "no-markers"}]
    stops = [a for a, _ in marks[1:]] + [len(body)]
    hits = [(a, b) for (a, code), b in zip(marks, stops, strict=True) if code == item]
    if not hits:
        return [blank | {"Outcome": "not-found", "nMarkers": len(marks)}]
    a, b = max(hits, key=lambda h: (h[1] - h[0], -h[0]))
    found = body[a:b].strip()
    outcome = "heading-only" if body_length(found) < least else "ambiguous-longest" if len(hits) > 1 else "extracted"
    return [{"Outcome": outcome, "nMarkers": len(marks), "nCodesRead": len(hits), "Start": a, "Stop": b, "nBodyChars": body_length(found), "ItemText": None if outcome == "heading-only" else found}]


def find_items(docs: DataFrame, item: str = "1.01") -> DataFrame:
    """One row a document (DocID, Text): the outcome and text of an item."""
    return _per_document(docs, lambda t: find_item(t, item), _ITEM)
