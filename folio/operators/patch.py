"""Patches of page documents by JSON pointers.

A page is a JSON string; its patch operations are applied in order, since each sees what the ones
before it left. That is a fold over one small document: a page's operations are gathered in a row beside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T


def pointer_tokens(pointer: str) -> list[str]:
    """RFC 6901: the parts of a pointer, with ~1 for / and ~0 for ~."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"a pointer starts with /: {pointer!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


def apply_operation(doc: object, op: str, pointer: str, value: object) -> object:
    """replace sets an index or a key (a missing last key is made), insert puts into a list, delete takes from a list or an object."""
    tokens = pointer_tokens(pointer)
    if not tokens:
        if op != "replace":
            raise ValueError(f"{op} needs a place inside the document")
        return value
    at = doc
    for t in tokens[:-1]:
        at = at[int(t)] if isinstance(at, list) else at[t]  # type: ignore[index]
    last = tokens[-1]
    if isinstance(at, list):
        i = len(at) if last == "-" else int(last)
        if not 0 <= i < len(at) + (op == "insert"):
            raise IndexError(f"{pointer}: the list has {len(at)} items")
        if op == "insert":
            at.insert(i, value)
        elif op == "delete":
            del at[i]
        else:
            at[i] = value
    elif isinstance(at, dict) and op != "insert":
        if op == "delete":
            del at[last]
        else:
            at[last] = value
    else:
        raise TypeError(f"{op} does not apply at {pointer}")
    return doc


def apply_patches(pages: DataFrame, operations: DataFrame) -> DataFrame:
    """page_id, doc, error: pages (page_id, doc) with their operations (page_id, ordinal, op, path, value as JSON) applied in order.

    An operation that doesn't apply leaves the page as it was and names the error. Pages without
    operations come through as they are.
    """

    def mended(doc: str, operations: list[dict] | None) -> tuple[str, str | None]:
        if operations is None:
            return doc, None
        try:
            at = json.loads(doc)
            for o in sorted(operations, key=lambda o: (o["ordinal"] is None, o["ordinal"] or 0)):
                at = apply_operation(at, o["op"], o["path"], json.loads(o["value"]) if o["value"] is not None else None)
            return json.dumps(at, ensure_ascii=False, separators=(",", ":")), None
        except (ValueError, LookupError, TypeError) as e:
            return doc, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [mended(doc, ops) for doc, ops in zip(batch.column("doc").to_pylist(), batch.column("operations").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array([o[k] for o in out], pa.string()) for k in (0, 1))], ["page_id", "doc", "error"])

    own = operations.groupBy(F.col("page_id").alias("page")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "op", "path", "value"))).alias("operations"))
    rows = pages.select("page_id", "doc").join(own, F.col("page_id").eqNullSafe(F.col("page")), "left").select("page_id", "doc", "operations")
    return rows.mapInArrow(run, "page_id string, doc string, error string")


def fixes_for(blocks: DataFrame, findings: DataFrame, long_at: int = 1000) -> DataFrame:
    """page_id, ordinal, op, path, value: operations that mend findings.

    Decorative tokens are removed and long paragraphs split at the sentence boundary nearest the
    middle. Operations go from the last block to the first, so that indices stay valid.
    """
    hit = findings.select("page_id", F.col("entity_ref").alias("block_id"), "code").distinct()
    rows = blocks.join(hit, ["page_id", "block_id"]).groupBy("page_id", "block_id").agg(F.first("pos").alias("pos"), F.first("index").alias("index"), F.first("text").alias("text"), F.collect_set("code").alias("codes"))
    clean = F.when(F.array_contains("codes", "DECORATIVE_ICON_LEAKED"), T.strip_decorative(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("clean", clean)
    cut = F.when(F.array_contains("codes", "PARAGRAPH_TOO_LONG"), T.sentence_boundary_near_middle(F.col("clean")))
    rows = rows.withColumn("cut", cut)
    path = lambda i, end: F.concat(F.lit("/blocks/"), i.cast("string"), F.lit(end))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    first = F.when(F.col("cut").isNull(), F.col("clean")).otherwise(F.rtrim(F.substring("clean", F.lit(1), F.col("cut"))))
    second = F.ltrim(F.expr("substring(clean, cut + 1)"))
    ops = F.array_compact(
        F.array(
            F.when(first != F.col("text"), F.struct(F.lit(1).alias("o"), F.lit("replace").alias("op"), path(F.col("index"), "/text").alias("path"), quoted(first).alias("value"))),
            F.when(F.col("cut").isNotNull(), F.struct(F.lit(2).alias("o"), F.lit("insert").alias("op"), path(F.col("index") + 1, "").alias("path"), F.to_json(F.struct(F.concat("block_id", F.lit(".1")).alias("block_id"), F.lit("paragraph").alias("kind"), second.alias("text"))).alias("value"))),
        )
    )
    flat = rows.select("page_id", "index", F.explode(ops).alias("p"))
    return flat.select("page_id", (F.lit(0) - F.col("index") * 2 + F.col("p.o")).alias("ordinal"), "p.op", "p.path", "p.value")
