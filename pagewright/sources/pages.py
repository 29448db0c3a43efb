"""Page sources: PDF files and images as binary rows, rendering by a pluggable renderer, page text, ground truth, manifests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import pages as P
from pagewright.operators import manifest
from pagewright.sources import files as X

#: Pages of a PDF: a function from a local path to a count, and one from (path, page, dpi) to PNG bytes.
RENDERERS: dict[str, tuple[Callable[[str], int], Callable[[str, int, int], bytes]]] = {}
#: Pages of a file that one task renders at most.
RANGE = 16


def register_renderer(name: str, count: Callable, render: Callable) -> None:
    RENDERERS[name] = count, render


def list_inputs(inputs: dict, base: str = ".") -> list[str]:
    """Paths of a configuration's inputs: a list of files goes before a folder, whose files are taken by name. Paths may be URIs."""
    placed = lambda p: p if X.scheme(p) else X.joined(str(base), p) if not p.startswith("/") else p
    if inputs.get("pdfs"):
        found = [placed(p) for p in inputs["pdfs"]]
        if absent := [p for p in found if not X.exists(p)]:
            raise FileNotFoundError(", ".join(absent))
        return found
    if not inputs.get("pdf_dir"):
        raise ValueError("inputs need pdfs or pdf_dir")
    folder = placed(inputs["pdf_dir"])
    found = X.listed(folder, ".pdf")
    if not found:
        raise FileNotFoundError(f"no PDF files in {folder}")
    return found


def binary_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, stem, content) of files; the content is read only where it is used."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if not isinstance(paths, str):  # names are taken as they are, not as patterns
        paths = [re.sub(r"([\\[\]{}*?])", r"\\\1", p) for p in paths]
    return reader.load(paths).select("path", P.stem(F.col("path")).alias("stem"), "content")


def _renderer(name: str):
    if name not in RENDERERS:
        raise RuntimeError(f"no PDF renderer named {name}: install one and register it with register_renderer()")
    return RENDERERS[name]


def page_counts(files: DataFrame, renderer: str) -> DataFrame:
    """(path, stem, n_pages) of files (path, stem, ...). Tasks open the files themselves; their bytes are no column."""
    count, _ = _renderer(renderer)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for path in part["path"]:
                with X.local(path) as own:
                    found.append(count(own))
            yield part.assign(n_pages=found)

    return files.select("path", "stem").mapInPandas(run, "path string, stem string, n_pages int")


def _drawn(draw: Callable, dpi: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range of a file after the other, a page at a time: a batch holds one image."""
        for batch in batches:
            for path, pages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with X.local(path) as own:
                    for page in pages:
                        made = draw(own, page["page"], dpi)
                        if not made:
                            raise RuntimeError("a page has no image")
                        yield pa.record_batch([pa.array([page["page_id"]]), pa.array([path]), pa.array([page["page"]], pa.int32()), pa.array([made], pa.binary())], ["page_id", "path", "page", "image"])

    return run


def chosen_pages(files: DataFrame, renderer: str, pages: list[int] | None = None, ranges: list | None = None) -> DataFrame:
    """(page_id, path, page): the pages of each file that are asked for."""
    found = manifest.selected_pages(page_counts(files, renderer), pages, ranges)
    return found.select(P.page_id(F.col("stem"), F.col("page")).alias("page_id"), "path", "page")


def render_pages(chosen: DataFrame, renderer: str, dpi: int = 300) -> DataFrame:
    """(page_id, path, page, image) of pages (page_id, path, page).

    Pages of a file are dealt out in ranges of RANGE, and a task opens the file of a range once: what is shuffled is the list of
    pages, a file's bytes are never a column, and a task holds one image."""
    _, draw = _renderer(renderer)
    held = F.array_sort(F.collect_list(F.struct("page", "page_id"))).alias("pages")
    parts = max(1, int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # named, or the few bytes of a list become one task
    ranged = chosen.withColumn("range", F.floor((F.col("page") - 1) / RANGE)).repartition(parts, "path", "range").groupBy("path", "range").agg(held)
    return ranged.select("path", "pages").mapInArrow(_drawn(draw, dpi), "page_id string, path string, page int, image binary")


def render(files: DataFrame, renderer: str, pages: list[int] | None = None, ranges: list | None = None, dpi: int = 300, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(page_id, path, page, image): chosen pages of each file, one image for each; only: narrows (page_id, path, page) rows down, before
    they are rendered."""
    chosen = chosen_pages(files, renderer, pages, ranges)
    return render_pages(only(chosen) if only else chosen, renderer, dpi)


def read_texts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(page_id, text): whole files by their stem, less a suffix."""
    found = spark.read.option("wholetext", True).text(path).select(P.stem(F.input_file_name()).alias("stem"), F.col("value").alias("text"))
    return found.select(F.regexp_replace("stem", f"{suffix}$", "").alias("page_id") if suffix else F.col("stem").alias("page_id"), "text")


def truth_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """(page_id, text) of whole JSON documents: {"document", "lines"} is one page of joined lines; else a mapping of page
    ids to texts. A value that is a list or an object is an error, not a page."""
    lines = F.from_json(F.col(column), "document string, lines array<string>")
    pages = F.from_json(F.col(column), "map<string,string>")
    first = raw.select(lines.alias("l")).filter("l.lines IS NOT NULL").select(F.col("l.document").alias("page_id"), F.array_join("l.lines", "\n").alias("text"))
    mapped = raw.filter(lines["lines"].isNull()).select(F.explode(pages).alias("page_id", "text"))
    plain = F.when(F.col("text").rlike(r"^\s*[\[{]") & F.try_parse_json("text").isNotNull(), F.raise_error(F.concat(F.lit("not a text: "), "page_id"))).otherwise(F.col("text"))
    return first.unionByName(mapped.select("page_id", plain.alias("text")))


def read_truth(spark: SparkSession, path: str | None) -> DataFrame | None:
    if not path:
        return None
    if not path.endswith(".json"):
        raise ValueError(f"ground truth is a .json file: {path}")
    return truth_from_json(spark.read.option("wholetext", True).text(path))


MANIFEST = "run_id string, created_at string, config_path string, pages array<struct<page_id:string,source:struct<type:string,path:string,page_number:int>,artifacts:map<string,map<string,string>>>>"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(run, pages) of a manifest file; what it lacks has its default."""
    found = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    run = found.select("run_id", "created_at", F.coalesce("config_path", F.lit("config.effective.yaml")).alias("config_path"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<map<string,string>>"))
    pages = found.select(F.explode(F.coalesce("pages", F.array().cast("array<struct<page_id:string,source:struct<type:string,path:string,page_number:int>,artifacts:map<string,map<string,string>>>>"))).alias("p"))
    return run, pages.select("p.page_id", "p.source", F.coalesce("p.artifacts", empty).alias("artifacts"))


def read_detection(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, regions) of detection JSON files."""
    schema = "page_id string, regions array<struct<order:int,bbox:struct<x:int,y:int,w:int,h:int>,lines:array<struct<order:int,bbox:struct<x:int,y:int,w:int,h:int>>>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def new_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "page_id string, source struct<type:string,path:string,page_number:int>, artifacts map<string,map<string,string>>")
