"""Texts put back into XML documents, and repairs of what readers reject. DOM work, so Arrow functions."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import quote
from xml.dom import minidom

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import SKIPPED, _base36

#: Elements that a paragraph can't hold. Fixed values.
BLOCKS_IN_PARAGRAPH = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")


def _name(node) -> str:
    return (node.localName or node.nodeName).rpartition(":")[2].lower()


def text_nodes(node, blocked: bool = False) -> Iterator:
    """Text nodes in document order that are not blank and may be translated; node i has the id doc:i in base 36."""
    for child in node.childNodes:
        if child.nodeType == child.ELEMENT_NODE:
            yield from text_nodes(child, blocked or _name(child) in SKIPPED or child.getAttribute("translate") == "no")
        elif child.nodeType == child.TEXT_NODE and not blocked and child.data.strip():
            yield child


def put_back(xml: str, values: dict[str, tuple[str, str]], doc: str) -> str:
    """xml with values {segment: (source hash, text)} in their text nodes, within the white space that stood around them."""
    dom = minidom.parseString(xml.encode())
    nodes = {f"{doc}:{_base36(i)}": n for i, n in enumerate(text_nodes(dom.documentElement))}
    for segment, (source_hash, text) in values.items():
        node = nodes.get(segment)
        if node is None:
            raise ValueError(f"segment not found: {segment}")
        if hashlib.sha256(node.data.encode()).hexdigest() != source_hash:
            raise ValueError(f"source changed: {segment}")
        bare = node.data.strip()
        at = node.data.index(bare)
        node.data = node.data[:at] + text.strip() + node.data[at + len(bare) :]
    return dom.documentElement.toxml()


def reinserted(documents: DataFrame, values: DataFrame) -> DataFrame:
    """documents: doc_id, xml; values: doc_id, seg_id, source_hash, text ('' for a text that another one absorbed). doc_id, xml, error:
    a document whose source has changed since stays as it was, and says so. A document's texts meet it in one row."""
    entry = F.struct("seg_id", "source_hash", "text")
    rows = documents.join(values.groupBy("doc_id").agg(F.collect_list(entry).alias("v")), "doc_id", "left")

    def run(docs: pa.Array, xmls: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for doc, xml, entries in zip(docs.to_pylist(), xmls.to_pylist(), found.to_pylist()):
            try:
                out.append((put_back(xml, {e["seg_id"]: (e["source_hash"], e["text"]) for e in entries or ()}, doc), None))
            except Exception as error:  # a document that can't be read is reported, others go on
                out.append((xml, str(error)))
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], ["xml", "error"])

    made = F.arrow_udf(run, "struct<xml:string,error:string>").asNondeterministic()
    return rows.select("doc_id", made("doc_id", "xml", "v").alias("r")).select("doc_id", "r.*")


def unnested(xml: str) -> tuple[str, int]:
    """xml in which no paragraph holds a block: one that does is parted around its blocks, its other content stays in
    paragraphs like it. How many were."""
    dom = minidom.parseString(xml.encode())
    wrong = [p for p in dom.getElementsByTagName("*") if _name(p) == "p" and any(c.nodeType == c.ELEMENT_NODE and _name(c) in BLOCKS_IN_PARAGRAPH for c in p.childNodes)]
    for p in wrong:
        run = p.cloneNode(False)
        pieces = []
        for child in [*p.childNodes]:
            if child.nodeType == child.ELEMENT_NODE and _name(child) in BLOCKS_IN_PARAGRAPH:
                pieces += [run, child]
                run = p.cloneNode(False)
            else:
                run.appendChild(child)
        for piece in [*pieces, run]:
            if piece.childNodes and any(c.nodeType == c.ELEMENT_NODE or (c.nodeValue or "").strip() for c in piece.childNodes) or piece in pieces[1::2]:
                p.parentNode.insertBefore(piece, p)
        p.parentNode.removeChild(p)
    return dom.documentElement.toxml(), len(wrong)


def without_nesting(documents: DataFrame) -> DataFrame:
    """documents: doc_id, xml. Their XML after unnested(), and how many paragraphs were parted."""

    def run(xmls: pa.Array) -> pa.Array:
        out = [unnested(x) for x in xmls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["xml", "parted"])

    return documents.select("doc_id", F.arrow_udf(run, "struct<xml:string,parted:int>").asNondeterministic()("xml").alias("r")).select("doc_id", "r.*")


def safe_path(path: Column) -> Column:
    """An entry's path with one underscore for what isn't a letter, digit, point, underscore or hyphen."""
    return F.array_join(F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}._-]+", "_"), "_+", "_")), "/")


def renames(files: DataFrame) -> DataFrame:
    """files: archive, name. archive, name, renamed, of entries whose path isn't safe; clash: whether another entry of the
    archive has or gets that path."""
    rows = files.select("archive", "name", safe_path(F.col("name")).alias("renamed"))
    many = rows.groupBy("archive", "renamed").agg(F.count("*").alias("n"))
    return rows.where("name <> renamed").join(many, ["archive", "renamed"]).select("archive", "name", "renamed", (F.col("n") > 1).alias("clash"))


def with_references(text: str, at: tuple[str, str], moved: list[tuple[str, str]]) -> tuple[str, int]:
    """A document's text, at (old path, new path), with its relative references to moved files, plain or encoded, renewed; how many."""
    changes = 0
    for old, new in moved:
        was, now = (posixpath.relpath(p, posixpath.dirname(d) or ".") for p, d in zip((old, new), at))
        coded, target = quote(was, safe="/-_.!~*'()"), quote(now, safe="/-_.!~*'()")
        low = re.sub("%[0-9A-F]{2}", lambda m: m[0].lower(), coded)
        for a, b in ((was, now), (coded, target), (low, target)):
            if a != b and a in text:
                changes += text.count(a)
                text = text.replace(a, b)
    return text, changes


def safe_ids(ids: list[str]) -> dict[str, str]:
    """New names for ids that aren't XML names, each unlike all others."""
    used, out = set(ids), {}
    for value in ids:
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9._-]*", value):
            continue
        base = re.sub(r"[^A-Za-z0-9._-]+", "-", value).strip("-")
        base = base if re.match("[A-Za-z_]", base) else f"id-{base}" if base else "id-repaired"
        name, n = base, 2
        while name in used:
            name, n = f"{base}-{n}", n + 1
        used.add(name)
        out[value] = name
    return out
