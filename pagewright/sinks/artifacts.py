"""Sinks: tables for what is large, one file per page where files are asked for, JSON and Markdown for small reports.

A part of a stage's table is written first and committed after, by a file of its own that appears whole or not at all. A
run that dies keeps the parts that are committed, leaves one that nothing names, and the next run does the rest. Parts are
merged when they are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import batches
from pagewright.sources import files


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """df written and read back; Python gets bounded batches on the way, and images small row groups."""
    with batches.bounded(df.sparkSession):
        df.write.mode(mode).options(**batches.IMAGE_TABLE).parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Part:
    """A finished part of a stage's table."""

    stage: str
    path: str
    rows: int


def commit(folder: str, part: Part) -> None:
    """Register a part: from now on the run's tables have it, after those that were registered before."""
    name = f"{len(files.listed(files.joined(folder, 'commits'), '.json')):08d}-{part.stage}-{uuid4().hex}.json"
    files.write(files.joined(folder, "commits", name), json.dumps(asdict(part)).encode())


def committed(folder: str) -> list[Part]:
    """The finished parts of a run in the order of their commits."""
    return [Part(**json.loads(files.read(x))) for x in files.listed(files.joined(folder, "commits"), ".json")]


def write_json_pages(df: DataFrame, path: str, key: str = "page_id") -> None:
    """A JSON line per page, in folders by page."""
    df.select(F.col(key).alias("__page"), F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").partitionBy("__page").text(path)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """A file per row below a folder that all machines see, by way of a temporary name; returns their number."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                files.write(files.joined(folder, row.name), row.content if isinstance(row.content, bytes) else str(row.content).encode())
            yield pd.DataFrame({"n": [len(part)]})

    with batches.bounded(df.sparkSession):
        found = df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(run, "n long").agg(F.sum("n")).first()[0]
    return found or 0


def write_json(value, path) -> None:
    write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", path)


def write_text(text: str, path) -> None:
    files.write(str(path), text.encode())


def write_manifest(run: dict, pages: DataFrame, path) -> None:
    """A manifest file: a run's few fields with its pages in order of their ids, as one JSON document. The driver writes it
    as rows come, a partition at a time, so it never holds all pages."""
    rows = pages.select("page_id", F.to_json(F.struct("page_id", "source", "artifacts")).alias("value")).orderBy("page_id")
    with files.written(str(path)) as out:
        out.write((json.dumps(run, ensure_ascii=False)[:-1] + (", " if run else "") + '"pages": [').encode())
        for i, row in enumerate(rows.toLocalIterator()):
            out.write(((",\n" if i else "\n") + row.value).encode())
        out.write(b"\n]}\n")
