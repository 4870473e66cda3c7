"""Evaluation of pages against golden specifications, thresholds, confidence, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (0.30, 0.35, 0.35)
COVERAGE = (0.10, 0.70)


def block_count(specs: DataFrame, actual: DataFrame) -> DataFrame:
    """page_id, metric, value, passed: block count against the specification (page_id, expected); a page without blocks counts 0."""
    n = actual.groupBy("page_id").agg(F.count("*").alias("n"))
    rows = specs.join(n, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = F.when(F.col("n") == F.col("expected"), 1.0).otherwise(0.0)
    return rows.select("page_id", F.lit("block_count").alias("metric"), value.alias("value"), (F.col("n") == F.col("expected")).alias("passed"))


def type_coverage(specs: DataFrame, actual: DataFrame) -> DataFrame:
    """Share of the expected block kinds (array) that a page has; none expected is full coverage."""
    kinds = actual.groupBy("page_id").agg(F.collect_set("kind").alias("kinds"))
    rows = specs.join(kinds, "page_id", "left").withColumn("want", F.array_distinct("block_types"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("want", F.coalesce("kinds", F.array().cast("array<string>")))).cast("double"), F.size("want")), F.lit(1.0))
    return rows.select("page_id", F.lit("type_coverage").alias("metric"), share.alias("value"), (share == 1.0).alias("passed"))


def order_accuracy(expected: Column, actual: Column) -> Column:
    """Positions that agree over the longer length; two empty orders agree."""
    hits = F.aggregate(F.zip_with(expected, actual, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(hits.cast("double"), F.greatest(F.size(expected), F.size(actual))), F.lit(1.0))


def aggregate(metrics: DataFrame) -> DataFrame:
    """metric (null: all), n, pass_rate, mean: per metric and overall, by one pass with grouping sets."""
    return metrics.rollup("metric").agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("value").alias("mean"))


def check_thresholds(totals: DataFrame, thresholds: DataFrame) -> DataFrame:
    """thresholds (metric, least) with value and ok; a metric that is missing fails."""
    return thresholds.join(totals, "metric", "left").withColumn("ok", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


def coverage_score(coverage: Column) -> Column:
    """0 up to 0.10, 1 from 0.70 on, a straight line between."""
    low, high = COVERAGE
    return F.when(coverage >= high, 1.0).when(coverage <= low, 0.0).otherwise((coverage - low) / (high - low))


def page_confidence(coverage: Column, order: Column, symbols: Column) -> Column:
    a, b, c = WEIGHTS
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * coverage_score(coverage) + b * order + c * symbols)), 4)


def confidence_band(value: Column) -> Column:
    """The published bands: primary from 0.85, hard route from 0.60, qa from 0.30, block below."""
    return F.when(value >= 0.85, "primary").when(value >= 0.60, "hard_route").when(value >= 0.30, "qa").otherwise("block")


def compare_blocks(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """page_id, block_id, status: match, type_mismatch, missing or extra (both tables: page_id, block_id, kind)."""
    rows = actual.select("page_id", "block_id", F.col("kind").alias("a")).join(expected.select("page_id", "block_id", F.col("kind").alias("e")), ["page_id", "block_id"], "full")
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") == F.col("e"), "match").otherwise("type_mismatch")
    return rows.select("page_id", "block_id", status.alias("status"))


def compare_orders(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """page_id, pos, actual, expected where two reading orders (page_id, pos, block_id) differ; the shorter is filled with nulls."""
    rows = actual.select("page_id", "pos", F.col("block_id").alias("actual")).join(expected.select("page_id", "pos", F.col("block_id").alias("expected")), ["page_id", "pos"], "full")
    return rows.where(~F.col("actual").eqNullSafe(F.col("expected")))


def audit(findings: DataFrame) -> DataFrame:
    return findings.groupBy("page_id", "code").agg(F.count("*").alias("n"))


def audit_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """code, before, after, change over two tables of findings."""
    count = lambda df, name: df.groupBy("code").agg(F.count("*").alias(name))
    rows = count(before, "before").join(count(after, "after"), "code", "full").na.fill(0, ["before", "after"])
    return rows.withColumn("change", F.col("after") - F.col("before"))


def ladder(checkpoints: DataFrame) -> DataFrame:
    """checkpoints (ladder, order, passed) with frontier (all passed up to here) and first_failure of the ladder."""
    w = Window.partitionBy("ladder").orderBy("order")
    rows = checkpoints.withColumn("frontier", F.min(F.col("passed").cast("int")).over(w) == 1)
    return rows.withColumn("first_failure", F.min(F.when(~F.col("passed"), F.col("order"))).over(Window.partitionBy("ladder")))


def symbol_count(specs: DataFrame, icons: DataFrame) -> DataFrame:
    """Number of a page's icons (page_id, a row each) against the specification (page_id, symbol_count)."""
    n = icons.groupBy("page_id").agg(F.count("*").alias("n"))
    rows = specs.join(n, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("page_id", F.lit("symbol_count").alias("metric"), F.col("n").cast("double").alias("value"), (F.col("n") == F.col("symbol_count")).alias("passed"))


def reading_order(specs: DataFrame, orders: DataFrame) -> DataFrame:
    """Positions of the reading order (page_id, reading_order) that agree with the specification's, over the longer one; passed if all do."""
    none = F.array().cast("array<string>")
    rows = specs.select("page_id", F.coalesce("reading_order", none).alias("want")).join(orders.select("page_id", F.coalesce("reading_order", none).alias("have")), "page_id", "left")
    value = order_accuracy(F.col("want"), F.coalesce("have", none))
    return rows.select("page_id", F.lit("reading_order").alias("metric"), value.alias("value"), (value == 1.0).alias("passed"))


class PageTables(NamedTuple):
    """What metrics look at: blocks (page_id, block_id, kind), icons (page_id, a row each), orders (page_id, reading_order)."""

    blocks: DataFrame
    icons: DataFrame
    orders: DataFrame


@runtime_checkable
class EvalMetric(Protocol):
    """A metric of pages: its name, and page_id, metric, value, passed of all pages of the specifications."""

    @property
    def name(self) -> str: ...

    def evaluate(self, specs: DataFrame, pages: PageTables) -> DataFrame: ...


class BlockCount:
    name = "block_count"

    def evaluate(self, specs: DataFrame, pages: PageTables) -> DataFrame:
        return block_count(specs, pages.blocks)


class SymbolCount:
    name = "symbol_count"

    def evaluate(self, specs: DataFrame, pages: PageTables) -> DataFrame:
        return symbol_count(specs, pages.icons)


class TypeCoverage:
    name = "type_coverage"

    def evaluate(self, specs: DataFrame, pages: PageTables) -> DataFrame:
        return type_coverage(specs, pages.blocks)


class ReadingOrder:
    name = "reading_order"

    def evaluate(self, specs: DataFrame, pages: PageTables) -> DataFrame:
        return reading_order(specs, pages.orders)


def builtin_metrics() -> list[EvalMetric]:
    return [BlockCount(), SymbolCount(), TypeCoverage(), ReadingOrder()]


def run_metrics(specs: DataFrame, pages: PageTables, metrics: Sequence[EvalMetric] | None = None) -> DataFrame:
    """page_id, metric, value, passed by each metric (the built-in ones, if none are given). Two metrics of one name raise ValueError."""
    metrics = list(metrics) if metrics is not None else builtin_metrics()
    if len({m.name for m in metrics}) < len(metrics):
        raise ValueError("metrics need names of their own")
    return reduce(DataFrame.unionByName, [m.evaluate(specs, pages) for m in metrics])


def default_metrics(specs: DataFrame, blocks: DataFrame, icons: DataFrame, orders: DataFrame) -> DataFrame:
    """All built-in metrics of pages: page_id, metric, value, passed."""
    return run_metrics(specs, PageTables(blocks, icons, orders))


def checkpoint_results(checkpoints: DataFrame, metrics: DataFrame, documents: DataFrame) -> DataFrame:
    """checkpoints (ladder, order, golden_set) with passed, skipped and detail: the failed metrics by page of each golden set (documents: golden_set, page_id; metrics of pages).

    A golden set without pages is skipped, and has not passed.
    """
    failed = metrics.where(~F.col("passed")).groupBy("page_id").agg(F.concat_ws(", ", F.array_sort(F.collect_set("metric"))).alias("failed"))
    rows = documents.join(failed, "page_id", "left")
    line = F.struct("page_id", F.concat_ws(": ", "page_id", "failed").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("failed").isNotNull(), line))), lambda x: x["line"])
    sets = rows.groupBy("golden_set").agg((F.count("failed") == 0).alias("passed"), F.concat_ws("; ", lines).alias("detail"))
    out = checkpoints.join(sets, "golden_set", "left").withColumn("skipped", F.col("passed").isNull())
    return out.select("ladder", "order", "golden_set", F.coalesce("passed", F.lit(False)).alias("passed"), "skipped", F.coalesce("detail", F.lit("golden set not found")).alias("detail"))


def regressions(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """results (ladder, order, passed) with frontier, the first that failed, and regression: failed now, and passed in the baseline."""
    first = F.min(F.when(~F.col("passed"), F.col("order"))).over(Window.partitionBy("ladder"))
    before = baseline.where("passed").select("ladder", "order", F.lit(True).alias("had")).distinct()
    rows = results.withColumn("frontier", F.coalesce(F.col("order") == first, F.lit(False))).join(before, ["ladder", "order"], "left")
    return rows.withColumn("regression", ~F.col("passed") & F.coalesce("had", F.lit(False))).drop("had")
