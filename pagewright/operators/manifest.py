"""The run manifest as tables: pages (page_id, source, ...) and artifacts (page_id, stage, kind, path).

Keys that occur more than once among new rows go to the latest by an order column. Null keys are keys like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an order column, with ``position``: that of the key's first row. An aggregation, so a
    key with very many rows is reduced before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"), F.min(order).alias("position"))
    return found.select(*keys, *(F.col("__last")[c].alias(c) for c in rest), "position")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new in place of those with the same key, and the others of new added."""
    same = lambda: [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), same(), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def register(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """Artifacts by page, stage and kind; the new path wins."""
    return upsert(artifacts, new.select("page_id", "stage", "kind", "path"), ["page_id", "stage", "kind"])


def unknown_pages(new: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows that name a page the manifest doesn't have."""
    return new.join(pages.select("page_id"), "page_id", "left_anti")


def as_maps(artifacts: DataFrame) -> DataFrame:
    """(page_id, artifacts: map of stage to map of kind to path)."""
    stage = artifacts.groupBy("page_id", "stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "path")))).alias("kinds"))
    return stage.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.to_json("kinds").alias("json"))))).alias("json")).select(
        "page_id", F.transform_values("json", lambda _, v: F.from_json(v, "map<string,string>")).alias("artifacts")
    )


def as_rows(pages: DataFrame) -> DataFrame:
    """Artifacts of pages with nested maps, a row each."""
    stage = pages.select("page_id", F.explode("artifacts").alias("stage", "kinds"))
    return stage.select("page_id", "stage", F.explode("kinds").alias("kind", "path"))


def path_of(artifacts: Column, stage: str, kind: str) -> Column:
    return F.try_element_at(F.try_element_at(artifacts, F.lit(stage)), F.lit(kind))


def pending(pages: DataFrame, done: DataFrame, key: str = "page_id", force: bool = False) -> DataFrame:
    """Pages still to do: those without a finished artifact, or all."""
    return pages if force else pages.join(done.select(key), key, "left_anti")


def missing(pages: DataFrame, upstream: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that lack what a stage needs."""
    return pages.select(key).join(upstream.select(key), key, "left_anti")


def require(pages: DataFrame, upstream: DataFrame, stage: str, key: str = "page_id") -> None:
    if (n := missing(pages, upstream, key).count()) > 0:
        raise RuntimeError(f"{n} pages have no {stage} artifact")


def with_fallback(pages: DataFrame, first: DataFrame, second: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, path): the first table's path where it has one, else the second's."""
    a, b = first.select(key, F.col("path").alias("__a")), second.select(key, F.col("path").alias("__b"))
    return pages.select(key).join(a, key, "left").join(b, key, "left").select(key, F.coalesce("__a", "__b").alias("path"))


def selected_pages(documents: DataFrame, pages: list[int] | None, ranges: list[tuple[int, int]] | None, total: str = "n_pages") -> DataFrame:
    """documents by selected page (column page), 1-based; none selected: every page; pages beyond a document don't exist."""
    for p in pages or []:
        if p <= 0:
            raise ValueError(f"page numbers begin at 1: {p}")
    for r in ranges or []:
        if len(r) != 2 or r[0] <= 0 or r[1] < r[0]:
            raise ValueError(f"not a page range: {r}")
    everything = F.when(F.col(total) > 0, F.sequence(F.lit(1), F.col(total).cast("int"))).otherwise(F.array().cast("array<int>"))
    if not pages and not ranges:
        return documents.withColumn("page", F.explode(everything))
    listed = F.array(*(F.lit(p) for p in pages or [])).cast("array<int>")
    spans = [F.sequence(F.lit(a), F.lit(b)) for a, b in ranges or []]
    chosen = F.array_sort(F.array_distinct(F.concat(listed, *spans)))
    return documents.withColumn("page", F.explode(chosen)).filter(F.col("page").between(1, F.col(total)))


def duplicates(pages: DataFrame) -> DataFrame:
    """Page ids that two sources or more would write to."""
    return pages.groupBy("page_id").agg(F.countDistinct("source").alias("sources")).filter("sources > 1")


def in_order(pages: DataFrame, *keys: str) -> DataFrame:
    """pages with their place in the run: by page id, or the keys given."""
    return pages.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("page_id")) - 1)
