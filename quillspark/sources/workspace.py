"""Manuscripts in a folder: a manifest and one Markdown file per chapter."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLUG = re.compile(r"(?i)[a-z0-9][a-z0-9._-]*")
SCENE = r"(?m)^[ \t]*<!--\s*scene:\s*(\S+?)\s*-->[ \t]*$"
#: Kinds of canon entries, as the workspace and the glossary call them. Fixed values.
CANON = {"character": "person", "person": "person", "place": "place", "location": "place", "organization": "organization", "ship": "ship"}


def parse_manifest(text: str) -> dict:
    """A manifest of flat keys and a list of chapters (slug, title, file): the part of YAML that it uses."""
    out: dict = {"chapters": []}
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item, pair = re.match(r"\s*-\s+(.*)", line), re.match(r"\s*(?:-\s+)?([A-Za-z_]+):\s*(.*)", line)
        if item:
            out["chapters"].append({})
        if pair and pair[2]:
            (out["chapters"][-1] if line[0] in " \t-" and out["chapters"] else out)[pair[1]] = pair[2].strip().strip("\"'")
    faults = []
    if str(out.get("schema_version")) != "1":
        faults.append("unsupported schema_version")
    if not out["chapters"]:
        faults.append("no chapters")
    slugs = [c.get("slug", "") for c in out["chapters"]]
    faults += [f"bad slug {s!r}" for s in slugs if not SLUG.fullmatch(s)]
    faults += [f"duplicate slug {s!r}" for s in sorted({s for s in slugs if slugs.count(s) > 1})]
    faults += [f"path escapes the folder: {c['file']}" for c in out["chapters"] if c.get("file", "").startswith("/") or ".." in c.get("file", "").split("/")]
    if faults:
        raise ValueError("; ".join(faults))
    return out


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, position, slug, title, text of a manuscript's chapters, in the manifest's order."""
    manifest = parse_manifest("\n".join(r.value for r in spark.read.text(f"{root}/manifest.yaml").collect()))
    rows = [(i, c["slug"], c.get("title", ""), c.get("file", f"{c['slug']}.md")) for i, c in enumerate(manifest["chapters"])]
    files = spark.read.text([f"{root}/{file}" for *_, file in rows], wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    known = spark.createDataFrame([(i, s, t, f.rpartition("/")[2]) for i, s, t, f in rows], "position int, slug string, title string, name string")
    return known.join(files, "name").select(F.concat(F.lit("document-"), F.col("position") + 1).alias("doc_id"), "position", "slug", "title", F.col("value").alias("text"))


def canon_names(value: object) -> list[tuple[str, str, str]]:
    """(id, name, category) of all objects in a JSON value that name a known kind; the last of an id counts."""
    found: dict[str, tuple[str, str, str]] = {}
    todo = [value]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            if all(isinstance(x.get(k), str) for k in ("id", "type", "name")) and x["type"] in CANON:
                found[x["id"]] = (x["id"], x["name"], CANON[x["type"]])
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return list(found.values())


def export(chapters: DataFrame, path: str) -> None:
    """One text file per chapter, the folder swapped as a whole by Spark's committer."""
    chapters.select("slug", F.concat(F.lit("# "), "title", F.lit("\n\n"), "text").alias("value")).repartition("slug").write.mode("overwrite").partitionBy("slug").text(path)


CORPUS = "struct<version:int,description:string,minPassRate:double,cases:array<struct<id:string,original:string,draft:string,requiredAny:array<string>,forbidden:array<string>,requireChange:boolean,reviewNotes:string>>>"


def read_corpus(spark, path: str):
    """The cases of evaluation corpora under path, with their corpus's version and least pass rate; a corpus that breaks the schema, has
    unknown keys, no cases or a rate outside 0..1 fails the read."""
    from pyspark.sql import functions as F

    known = {"version", "description", "minPassRate", "cases"}
    rows = spark.read.text(path, wholetext=True).select(F.col("value"), F.from_json("value", CORPUS, {"mode": "FAILFAST"}).alias("c"))
    keys = F.json_object_keys("value")
    bad = F.size(F.array_except(keys, F.array(*map(F.lit, sorted(known))))) > 0
    bad = bad | F.col("c.version").isNull() | (F.col("c.version") < 1) | (F.coalesce("c.description", F.lit("")) == "") | (F.coalesce(F.size("c.cases"), F.lit(0)) < 1) | ~F.coalesce(F.col("c.minPassRate"), F.lit(0.0)).between(0, 1)
    checked = rows.select(F.when(bad, F.raise_error(F.lit("not an evaluation corpus"))).otherwise(F.col("c")).alias("c"))
    return checked.select("c.version", "c.minPassRate", F.explode("c.cases").alias("x")).select("version", "minPassRate", "x.*").withColumn("requireChange", F.coalesce("requireChange", F.lit(True)))


def duplicate_scenes(chapters: DataFrame) -> DataFrame:
    """slug, scene: scene ids that stand twice in a chapter."""
    found = chapters.select("slug", F.explode(F.regexp_extract_all("text", F.lit(SCENE), 1)).alias("scene"))
    return found.groupBy("slug", "scene").agg(F.count("*").alias("n")).where("n > 1").select("slug", "scene")


def read_canon(spark: SparkSession, path: str) -> DataFrame:
    """id, name, category of the canon entries in JSON files under path; a file that doesn't parse has none."""
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append([dict(zip(("id", "name", "category"), x)) for x in canon_names(json.loads(text))])
            except ValueError:
                out.append([])
        return pa.array(out, pa.list_(pa.struct([(c, pa.string()) for c in ("id", "name", "category")])))

    found = F.arrow_udf(run, "array<struct<id:string,name:string,category:string>>")
    return spark.read.text(path, wholetext=True).select(F.explode(found("value")).alias("x")).select("x.*")
