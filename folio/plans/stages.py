"""Stages of a document build, run in order with results cached by the content of their inputs: whole tables, or page by page."""

from __future__ import annotations

import functools
import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from folio.sources.artifacts import read_or_empty

ORDER = ("ingest", "extract_native", "extract_layout", "symbols", "structure", "translate", "render", "qa", "publish")


@dataclass(frozen=True)
class Stage:
    """name, version, a function from the tables so far to this stage's table, and the tables that it reads besides those."""

    name: str
    version: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    sources: Sequence[DataFrame] = ()


def stage_range(first: str | None = None, last: str | None = None, edition: str = "all", order: Sequence[str] = ORDER) -> list[str]:
    """The stages from first to last, both included; the source edition has no translation."""
    for name in (first, last):
        if name is not None and name not in order:
            raise ValueError(f"unknown stage {name!r}")
    a = order.index(first) if first else 0
    b = order.index(last) if last else len(order) - 1
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return [s for s in order[a : b + 1] if not (edition == "en" and s == "translate")]


def cache_key(stage: Stage, config_hash: str, inputs: Sequence[str]) -> str:
    return hashlib.sha256("|".join([stage.name, stage.version, config_hash, *sorted(inputs)]).encode()).hexdigest()[:12]


def _row_hash(df: DataFrame, salt: str) -> Column:
    """A 64-bit hash of a row, columns by name; maps go in as sorted entries, since their order means nothing."""
    names = sorted(df.columns)
    plain = [F.to_json(F.array_sort(F.map_entries(c))) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in names]
    return F.xxhash64(F.lit(salt), *[x for c in plain for x in (c.isNull(), c)])


def content_sums(df: DataFrame) -> list[Column]:
    """Aggregates that are the same for the same rows in any order: their number and two sums of hashes."""
    return [F.count("*").alias("n"), *[F.sum(_row_hash(df, salt).cast("decimal(38,0)")).alias(salt) for salt in ("a", "b")]]


def content_hash(df: DataFrame) -> str:
    """12 hex digits of a table's columns and rows, whatever their order and partitions; one pass with partial sums."""
    row = df.agg(*content_sums(df)).first()
    columns = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    return hashlib.sha256(repr((columns, *row)).encode()).hexdigest()[:12]


class StageError(RuntimeError):
    """A stage failed; its event is recorded."""


_DONE = "stage_name string, cache_key string, content_hash string"


class Runner:
    """Runs stages and keeps their tables under a path that all executors reach.

    A stage whose key already has a table is read instead of run. A key covers the stage's name and version, the
    configuration, the page filter, the content of the tables that it reads from outside, and that of the tables of all stages before it.
    So other rows under the same path make another table, and a stage that runs again with the same result makes no later one run.
    """

    def __init__(self, spark: SparkSession, path: str, config_hash: str = "", pages: Sequence[str] = ()):
        self.spark, self.path, self.config_hash, self.pages = spark, path.rstrip("/"), config_hash, sorted(set(pages))
        self.events: list[tuple[str, str, str, int, str | None]] = []

    def _done(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/done", _DONE)

    def _record(self, stage: Stage, key: str, status: str, began: float, error: str | None = None) -> None:
        self.events.append((stage.name, key, status, 0 if status == "cached" else int(1000 * (time.monotonic() - began)), error))

    def run(self, stages: Sequence[Stage]) -> dict[str, DataFrame]:
        """The stages' tables by name. A stage that fails is recorded with its error, and raises StageError."""
        tables: dict[str, DataFrame] = {}
        contents = ["pages:" + "|".join(self.pages)] if self.pages else []
        for stage in stages:
            began = time.monotonic()
            key = cache_key(stage, self.config_hash, [*contents, *(f"source-{k}:{content_hash(df)}" for k, df in enumerate(stage.sources))])
            folder = f"{self.path}/{stage.name}-{key}"
            found = self._done().where(F.col("cache_key") == key).first()
            if found is None:
                try:
                    stage.run(self.spark, tables).write.mode("overwrite").parquet(folder)
                except Exception as e:
                    self._record(stage, key, "failed", began, str(e))
                    raise StageError(f"stage {stage.name} failed") from e
                content = content_hash(self.spark.read.parquet(folder))
                self.spark.createDataFrame([(stage.name, key, content)], _DONE).write.mode("append").parquet(f"{self.path}/done")
            else:
                content = found["content_hash"]
            tables[stage.name] = self.spark.read.parquet(folder)
            self._record(stage, key, "completed" if found is None else "cached", began)
            contents.append(f"{stage.name}:{content}")
        return tables

    def event_table(self) -> DataFrame:
        rows = [(i + 1, *e) for i, e in enumerate(self.events)]
        return self.spark.createDataFrame(rows, "event_id long, stage_name string, cache_key string, status string, duration_ms long, error_message string").withColumn("recorded_at", F.current_timestamp())


@dataclass(frozen=True)
class PageStage:
    """A stage that makes each page's rows from that page's rows of its inputs (names of sources or of stages before it).

    All tables have page_id, and so has the result. ``shared`` are tables that every page reads whole: if one changes, all pages do.
    """

    name: str
    version: str
    inputs: Sequence[str]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    shared: Sequence[DataFrame] = ()


#: Pages that are sent to all tasks, by their ids, to pick or leave out rows; more meet the rows by an exchange of both.
MOST_BROADCAST = 500_000

_PAGES = "page_id string, input_hash string, content_hash string, generation int, removed boolean"


def _few(pages: DataFrame, n: int) -> DataFrame:
    return F.broadcast(pages) if n <= MOST_BROADCAST else pages


class PageRunner:
    """Runs page stages again for the pages whose inputs changed, and for no others.

    Below ``path`` each stage has its rows by generations and an index of pages: of which generation a page's rows are, and the hashes of what they
    were made from and of what they are. A run writes the changed pages' rows as a new generation, then their index rows; an older generation's rows of
    these pages are no longer read. Rows without index rows, as a lost run leaves them, are never read and are written over by the next.
    Hashes are carried from stage to stage, so a page whose rows come out the same stops there.
    """

    def __init__(self, spark: SparkSession, path: str, config_hash: str = ""):
        self.spark, self.path, self.config_hash = spark, path.rstrip("/"), config_hash
        #: stage, pages made, pages kept, pages removed; of each run.
        self.events: list[tuple[str, int, int, int]] = []

    def _index_rows(self, stage: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/{stage}/index", _PAGES)

    def index(self, stage: str) -> DataFrame:
        """page_id, input_hash, content_hash, generation of a stage's pages as they are now."""
        rows = self._index_rows(stage)
        now = rows.groupBy("page_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "page_id"]), "generation").alias("now"))
        return now.select("page_id", "now.*").where("NOT removed").drop("removed")

    def table(self, stage: str) -> DataFrame:
        """A stage's rows, of each page those of its generation: all of the last generation, and those of older ones whose pages no later one has made or removed."""
        index = self._index_rows(stage)
        first, last = index.agg(F.min("generation"), F.max("generation")).first()
        rows = self.spark.read.parquet(f"{self.path}/{stage}/rows").where(F.col("generation") <= F.lit(last))
        if first == last:
            return rows.drop("generation")
        again = index.where(F.col("generation") > first).groupBy("page_id").agg(F.max("generation").alias("last")).checkpoint()
        again = _few(again, again.count()).withColumnRenamed("page_id", "page")
        return rows.join(again, (F.col("page_id") == F.col("page")) & (F.col("generation") < F.col("last")), "left_anti").drop("generation")

    @staticmethod
    def _page_hashes(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy("page_id").agg(*content_sums(df))
        return sums.select("page_id", F.sha2(F.concat_ws("|", F.lit(name), "n", "a", "b"), 256).alias("hash"))

    def run(self, sources: dict[str, DataFrame], stages: Sequence[PageStage]) -> dict[str, DataFrame]:
        """All stages' tables by name. Rows with a null page_id belong to no page."""
        tables = {name: df.where("page_id IS NOT NULL") for name, df in sources.items()}
        hashes = {name: self._page_hashes(df, name).checkpoint() for name, df in tables.items()}
        for stage in stages:
            own = "|".join([stage.name, stage.version, self.config_hash, *map(content_hash, stage.shared)])
            parts = functools.reduce(DataFrame.unionByName, [hashes[n] for n in stage.inputs])
            wanted = parts.groupBy("page_id").agg(F.sha2(F.concat_ws("|", F.lit(own), F.array_sort(F.collect_list("hash"))), 256).alias("input_hash"))
            before = self.index(stage.name).checkpoint()
            changed = wanted.join(before.select("page_id", "input_hash"), ["page_id", "input_hash"], "left_anti").checkpoint()
            removed = before.join(wanted, "page_id", "left_anti").select("page_id").checkpoint()
            made, gone, known = changed.count(), removed.count(), before.count()
            kept = known - gone - (made - changed.join(before, "page_id", "left_anti").count())
            if made or gone:
                pick = (lambda df: df) if not kept else (lambda df, pages=_few(changed.select("page_id"), made): df.join(pages, "page_id", "left_semi"))
                last = self._index_rows(stage.name).agg(F.max("generation")).first()[0] or 0
                self._write(stage, {n: pick(tables[n]) for n in stage.inputs}, changed, removed, last + 1)
            self.events.append((stage.name, made, kept, gone))
            tables[stage.name] = self.table(stage.name)
            hashes[stage.name] = self.index(stage.name).select("page_id", F.col("content_hash").alias("hash"))
        return {s.name: tables[s.name] for s in stages}

    def _write(self, stage: PageStage, tables: dict[str, DataFrame], changed: DataFrame, removed: DataFrame, generation: int) -> None:
        folder = f"{self.path}/{stage.name}/rows/generation={generation}"
        stage.run(tables).write.mode("overwrite").parquet(folder)
        found = self._page_hashes(self.spark.read.parquet(folder), stage.name).withColumnRenamed("hash", "content_hash")
        rows = changed.join(found, "page_id", "left").withColumns({"generation": F.lit(generation), "removed": F.lit(False)})
        gone = removed.withColumns({"input_hash": F.lit(None).cast("string"), "content_hash": F.lit(None).cast("string"), "generation": F.lit(generation), "removed": F.lit(True)})
        rows.withColumn("content_hash", F.coalesce("content_hash", F.lit("none"))).unionByName(gone).select("page_id", "input_hash", "content_hash", "generation", "removed").write.mode("append").parquet(f"{self.path}/{stage.name}/index")

    def pages_made(self, stage: str, generation: int) -> DataFrame:
        """page_id of the pages whose rows a stage made in a generation."""
        return self.index(stage).where(F.col("generation") == generation).select("page_id")
