"""A translation memory that also finds texts which differ by a few characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts shorter than this only meet equal ones: pieces of theirs would be one character.
LEAST_LENGTH = 8


def _piece(length: Column, i: Column, pieces: int) -> tuple[Column, Column]:
    """Start (from 0) and size of piece i of a text of that length; the pieces differ by one character at most."""
    start = F.floor(length * i / pieces).cast("int")
    return start, F.floor(length * (i + 1) / pieces).cast("int") - start


def near_texts(asked: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """asked_text, known_text, distance: all pairs of distinct texts (columns ``text``) with ``most`` edits (of one character) or fewer between them.

    A text is cut into most + 1 pieces, so one of them stands unchanged in any text within that many edits, and hardly moved: the i-th by at most i
    characters from the left end and most - i from the right one. Texts meet by length, piece and its characters, never all pairs; what meets is
    compared whole. Texts under LEAST_LENGTH characters, on either side, only meet equal ones.
    """
    long = lambda df: df.where(F.length("text") >= LEAST_LENGTH)
    texts = lambda df: df.select("text").where("text IS NOT NULL").distinct()
    asked, known = texts(asked), texts(known)
    start, size = _piece(F.length("text"), F.col("i"), most + 1)
    every = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i")
    key = lambda length, at, n: F.xxhash64(length, "i", F.substring(F.col("text"), at + 1, n)).alias("key")
    kept = long(known).select("text", every).select(F.col("text").alias("known_text"), key(F.length("text"), start, size))
    other = F.explode(F.sequence(F.length("text") - most, F.length("text") + most)).alias("length")
    looked = long(asked).select("text", other).where(F.col("length") >= LEAST_LENGTH).select("text", "length", every)
    start, size = _piece(F.col("length"), F.col("i"), most + 1)
    shift = F.length("text") - F.col("length")
    low = F.greatest(start - F.col("i"), start + shift - (most - F.col("i")), F.lit(0))
    high = F.least(start + F.col("i"), start + shift + (most - F.col("i")), F.length("text") - size)
    looked = looked.withColumn("size", size).withColumn("at", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    looked = looked.select(F.col("text").alias("asked_text"), key(F.col("length"), F.col("at"), F.col("size"))).distinct()
    met = looked.join(kept, "key").select("asked_text", "known_text").distinct()
    near = met.withColumn("distance", F.levenshtein("asked_text", "known_text", most)).where("distance >= 0")
    short = asked.where(F.length("text") < LEAST_LENGTH).join(known, "text").select(F.col("text").alias("asked_text"), F.col("text").alias("known_text"), F.lit(0).alias("distance"))
    return near.unionByName(short)


def recall(segments: DataFrame, memory: DataFrame, most: int = 3) -> DataFrame:
    """segment_id, memory_id, distance, target: of each segment (segment_id, text) the nearest text of the memory (segment_id, text, target) that has a translation; of equally near ones the smallest id.

    Segments without any within ``most`` edits are left out. Equal texts are compared once, whatever their number.
    """
    known = memory.where(F.coalesce(F.trim("target"), F.lit("")) != "").groupBy("text").agg(F.min(F.struct("segment_id", "target")).alias("m"))
    best = near_texts(segments, known, most).join(known.withColumnRenamed("text", "known_text"), "known_text")
    best = best.groupBy("asked_text").agg(F.min(F.struct("distance", F.col("m.segment_id").alias("memory_id"), F.col("m.target").alias("target"))).alias("b"))
    return segments.join(best, segments["text"] == best["asked_text"]).select(segments["segment_id"], "b.memory_id", "b.distance", "b.target")
