"""Segments of HTML and XML documents. A parser is needed here, so these are Arrow functions."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by what they do to a text. Fixed values.
SKIPPED = ("script", "style", "pre", "code", "math", "svg")
BLOCKS = tuple("address article aside blockquote body caption dd div dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup html li main nav p section td text th title".split())
INLINE = tuple("a abbr b cite code del dfn em i ins kbd mark q rt ruby s samp small strong sub sup time u var".split())
VOID = tuple("area base br col embed hr img input link meta param source track wbr".split())
SEGMENT = "doc_id string, block int, seg_pos int, seg_id string, text string, source_hash string, leading string, trailing string, format string"


class _Walk(HTMLParser):
    """Text nodes in document order, with the block they stand in and the inline elements around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.block, self.skip, self.open, self.found = 0, 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.block += 1
        if tag in BLOCKS:
            self.block += 1
        if tag in VOID:
            return
        self.open.append(tag)
        self.skip += tag in SKIPPED or ("translate", "no") in attrs

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while True:
            last = self.open.pop()
            self.block += last in BLOCKS
            if last == tag:
                break
        self.skip = sum(t in SKIPPED for t in self.open)

    def handle_data(self, data: str) -> None:
        if self.skip or not data.strip():
            return
        inner = []
        for tag in reversed(self.open):
            if tag in BLOCKS:
                break
            if tag in INLINE:
                inner.append(tag)
        self.found.append((self.block, data, "".join(f">{t}" for t in reversed(inner))))


def walked(html: str) -> list[tuple[int, str, str]]:
    walk = _Walk()
    walk.feed(html)
    walk.close()
    return walk.found


def _base36(n: int) -> str:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    return (_base36(n // 36) if n >= 36 else "") + digits[n % 36]


def html_segments(pages: DataFrame) -> DataFrame:
    """pages: doc_id, html. One row per text node that is not blank: its text bare of the white space around
    it, which stands in leading and trailing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (block, data, form) in enumerate(walked(html or "")):
                    bare = data.strip()
                    at = data.index(bare)
                    rows.append((doc, block, i, f"{doc}:{_base36(i)}", bare, hashlib.sha256(data.encode()).hexdigest(), data[:at], data[at + len(bare) :], form))
            names = [x.split()[0] for x in SEGMENT.split(", ")]
            kinds = [pa.int32() if " int" in x else pa.string() for x in SEGMENT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [()] * len(names), kinds)], names)

    return pages.select("doc_id", "html").mapInArrow(run, SEGMENT)


def well_formed(pages: DataFrame) -> DataFrame:
    """Whether each page parses as XML; its other columns stay."""

    def parses(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            try:
                ET.fromstring(x or "")
                out.append(True)
            except ET.ParseError:
                out.append(False)
        return pa.array(out, pa.bool_())

    parses.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return pages.select(*(c for c in pages.columns if c != "html"), F.arrow_udf(parses, "boolean")("html").alias("well_formed"))
