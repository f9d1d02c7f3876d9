"""Packages and pages of a book made those of its translation: language, dates, writing direction. DOM work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.dom import minidom

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DC, XML = "http://purl.org/dc/elements/1.1/", "http://www.w3.org/XML/1998/namespace"
#: Which direction a stylesheet is for, by its class and title. Fixed values.
VERTICAL, HORIZONTAL = r"\bvertical\b|縦組", r"\bhorizontal\b|横組"


def _elements(dom) -> Iterator:
    yield dom.documentElement
    yield from dom.documentElement.getElementsByTagName("*")


def _name(x) -> str:
    return x.nodeName.rpartition(":")[2].lower()


def _set_text(x, text: str) -> None:
    while x.firstChild:
        x.removeChild(x.firstChild)
    x.appendChild(x.ownerDocument.createTextNode(text))


def package_language(dom, language: str, modified: str, generator: str) -> int:
    """The language of the metadata, their date of change and generator; the language of the package itself only where its
    version is 3. What is lacking is added, a date in version 3 only."""
    root = dom.documentElement
    third = root.getAttribute("version").startswith("3")
    if third:
        root.setAttributeNS(XML, "xml:lang", language)
    metadata = next((x for x in _elements(dom) if _name(x) == "metadata"), None)
    if metadata is None:
        raise ValueError("a package without metadata")
    within = [x for x in _elements(dom) if x.parentNode.nodeType == x.ELEMENT_NODE and _name(x.parentNode) == "metadata"]
    languages = [x for x in within if _name(x) == "language"]
    dates = [x for x in within if _name(x) == "meta" and "dcterms:modified" in (x.getAttribute("property"), x.getAttribute("name"))]
    makers = [x for x in within if _name(x) == "meta" and x.getAttribute("name").lower() == "generator"]
    if not languages:
        languages = [metadata.appendChild(dom.createElementNS(DC, "dc:language"))]
    if not dates and third:
        dates = [metadata.appendChild(dom.createElement("meta"))]
        dates[0].setAttribute("property", "dcterms:modified")
    if not makers:
        makers = [metadata.appendChild(dom.createElement("meta"))]
        makers[0].setAttribute("name", "generator")
        makers[0].setAttribute("content", "")
    for x in languages:
        _set_text(x, language)
    for group, value in ((dates, modified), (makers, generator)):
        for x in group:
            if x.hasAttribute("content"):
                x.setAttribute("content", value)
            else:
                _set_text(x, value)
    return len(languages) + len(dates) + len(makers)


def content_language(dom, language: str) -> int:
    """The language of a page: on its root, and wherever one is stated."""
    root, n = dom.documentElement, 0
    for x in _elements(dom):
        if x is root or x.hasAttributeNS(XML, "lang"):
            x.setAttributeNS(XML, "xml:lang", language)
            n += 1
        if _name(root) == "html" and (x is root or x.hasAttribute("lang")):
            x.setAttribute("lang", language)
            n += 1
    return n


def content_direction(dom) -> int:
    """A page set from left to right: its classes, and of two stylesheets the horizontal one is the one that is read."""
    n = 0
    for x in _elements(dom):
        classes = re.sub(r"\b(?:vrtl|vltr)\b", "hltr", x.getAttribute("class"))
        if classes != x.getAttribute("class"):
            x.setAttribute("class", classes)
            n += 1
        rel, marks = x.getAttribute("rel"), f"{x.getAttribute('class')} {x.getAttribute('title')}"
        if _name(x) == "link" and "stylesheet" in rel.lower():
            vertical, other = bool(re.search(VERTICAL, marks)), bool(re.search(r"(?i)\balternate\b", rel))
            if vertical != other and (vertical or re.search(HORIZONTAL, marks)):
                x.setAttribute("rel", "alternate stylesheet" if vertical else "stylesheet")
                n += 1
    return n


def package_direction(dom) -> int:
    """A spine that goes on from left to right."""
    found = [x for x in _elements(dom) if _name(x) == "spine" and x.getAttribute("page-progression-direction") == "rtl"]
    for x in found:
        x.setAttribute("page-progression-direction", "ltr")
    return len(found)


def changed(documents: DataFrame, *steps: Callable) -> DataFrame:
    """documents(xml, ...) after the steps, each a function of a DOM that says how much it changed; `changes`, their sum."""

    def run(xmls: pa.Array) -> pa.Array:
        out = []
        for xml in xmls.to_pylist():
            dom = minidom.parseString(xml.encode())
            n = sum(step(dom) for step in steps)
            out.append((dom.documentElement.toxml(), n))
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["xml", "changes"])

    made = F.arrow_udf(run, "struct<xml:string,changes:int>").asNondeterministic()
    return documents.withColumn("_r", made(F.col("xml"))).withColumns({"xml": F.col("_r.xml"), "changes": F.col("_r.changes")}).drop("_r")
