"""EPUB archives: scan, package, validation, build. Zip and XML need parsers, so these are Arrow functions."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "archive string, ordinal int, name string, compressed bigint, expanded bigint, method int, encrypted boolean"
#: What may follow the end record of an archive: one NUL.
_END = b"PK\x05\x06"


def _open(data: bytes) -> zipfile.ZipFile:
    """An archive, also with exactly one NUL after its end."""
    at = data.rfind(_END, max(0, len(data) - 65_558))
    if at >= 0 and data.endswith(b"\0") and len(data) == at + 22 + int.from_bytes(data[at + 20 : at + 22], "little") + 1:
        data = data[:-1]
    return zipfile.ZipFile(io.BytesIO(data))


def directory(archives: DataFrame) -> DataFrame:
    """archives: archive, content. The directory of each; one that doesn't open has one entry without a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += ((archive, i, x.filename, x.compress_size, x.file_size, x.compress_type, bool(x.flag_bits & 1)) for i, x in enumerate(_open(data).infolist()))
                except zipfile.BadZipFile:
                    rows.append((archive, 0, None, None, None, None, None))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [()] * 7, kinds)], [x.split()[0] for x in ENTRY.split(", ")])

    return archives.select("archive", "content").mapInArrow(run, ENTRY)


def files(archives: DataFrame) -> DataFrame:
    """archives: archive, content. Their entries' bytes, one row an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(data) as z:
                    for x in z.infolist():
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([posixpath.normpath(x.filename)]), pa.array([z.read(x)], pa.binary())], ["archive", "name", "data"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, name string, data binary")


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def scan_entries(spark: SparkSession, path: str) -> DataFrame:
    """The directory of every archive under a path."""
    return directory(_archives(spark, path))


def extract(spark: SparkSession, path: str, allowed: DataFrame) -> DataFrame:
    """Entries' bytes of archives that the policy lets pass; allowed: archive."""
    return files(_archives(spark, path).join(allowed.select("archive"), "archive", "left_semi"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_package(xml: str) -> dict:
    """Manifest, spine, title and language of a package; the last title and language count, both must be there."""
    root = ET.fromstring(xml)
    manifest, spine, title, language = [], [], "", ""
    for parent in root.iter():
        for x in parent:
            tag = _local(x.tag)
            if tag == "item" and _local(parent.tag) == "manifest":
                manifest.append({"id": x.get("id", ""), "href": x.get("href", ""), "media_type": x.get("media-type", ""), "properties": x.get("properties")})
            elif tag == "itemref":
                spine.append(x.get("idref", ""))
            elif tag == "title":
                title = (x.text or "").strip() or title
            elif tag == "language":
                language = (x.text or "").strip() or language
    if not title or not language:
        raise ValueError("a package needs a title and a language")
    return {"manifest": manifest, "spine": spine, "title": title, "language": language}


PACKAGE = "struct<manifest:array<struct<id:string,href:string,media_type:string,properties:string>>,spine:array<string>,title:string,language:string,error:string>"


def packages(files: DataFrame) -> DataFrame:
    """files: archive, name, data. The package of each archive, found through its container."""
    container = files.where("name = 'META-INF/container.xml'").select("archive", F.xpath_string(F.col("data").cast("string"), F.lit('//*[local-name()="rootfile"]/@full-path')).alias("name"))
    item = pa.struct([("id", pa.string()), ("href", pa.string()), ("media_type", pa.string()), ("properties", pa.string())])
    kind = pa.struct([("manifest", pa.list_(item)), ("spine", pa.list_(pa.string())), ("title", pa.string()), ("language", pa.string()), ("error", pa.string())])

    def run(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            try:
                out.append(parse_package(x.decode("utf-8-sig")))
            except (ValueError, ET.ParseError) as e:
                out.append({"error": str(e)})
        return pa.array(out, kind)

    return files.join(container, ["archive", "name"]).select("archive", F.col("name").alias("package_path"), F.arrow_udf(run, PACKAGE)("data").alias("p")).select("archive", "package_path", "p.*")


def validation(packages: DataFrame, mimetypes: DataFrame) -> DataFrame:
    """Faults of a book: a wrong mimetype, spine ids that the manifest lacks. mimetypes: archive, mimetype."""
    missing = packages.select("archive", F.explode(F.array_except("spine", F.transform("manifest", lambda m: m["id"]))).alias("id")).select("archive", F.concat(F.lit("spine item not in manifest: "), "id").alias("fault"))
    wrong = mimetypes.where(F.col("mimetype") != "application/epub+zip").select("archive", F.lit("wrong mimetype").alias("fault"))
    return missing.unionByName(wrong)


def build(files: DataFrame) -> DataFrame:
    """files: archive, name, data. One archive per book: the mimetype first and stored, others by path, fixed
    times, so equal books have equal bytes. A book has to fit a task."""

    def run(group):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in sorted(zip(group["name"], group["data"]), key=lambda x: (x[0] != "mimetype", x[0])):
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
                z.writestr(info, data)
        return pd.DataFrame({"archive": [group["archive"].iloc[0]], "content": [out.getvalue()]})

    return files.groupBy("archive").applyInPandas(run, "archive string, content binary")


def flattened_ruby(html: str) -> tuple[str, dict[str, str]]:
    """Text with ruby reduced to its base, and the readings of bases with Chinese characters, the last one."""
    import regex

    readings: dict[str, str] = {}

    def base(m) -> str:
        text = regex.sub(r"<rp\b[^>]*>.*?</rp>|<rt\b[^>]*>.*?</rt>", "", m[1], flags=regex.S)
        plain = " ".join(regex.sub(r"<[^>]+>", "", text).split())
        reading = "".join(regex.findall(r"<rt\b[^>]*>(.*?)</rt>", m[1], flags=regex.S))
        if regex.search(r"\p{Han}", plain):
            readings[plain] = " ".join(regex.sub(r"<[^>]+>", "", reading).split())
        return regex.sub(r"</?rb\b[^>]*>", "", text)

    inner = regex.compile(r"<ruby\b[^>]*>((?:(?!<ruby\b).)*?)</ruby>", regex.S)
    while inner.search(html):
        html = inner.sub(base, html)
    return html, readings


def with_flattened_ruby(pages: DataFrame) -> DataFrame:
    """pages(html, ...) with html without ruby, and readings, a map."""

    def run(column: pa.Array) -> pa.Array:
        out = [flattened_ruby(x or "") for x in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([[*r.items()] for _, r in out], pa.map_(pa.string(), pa.string()))], ["html", "readings"])

    made = F.arrow_udf(run, "struct<html:string,readings:map<string,string>>").asNondeterministic()
    return pages.withColumn("_r", made(F.col("html"))).withColumns({"html": F.col("_r.html"), "readings": F.col("_r.readings")}).drop("_r")
