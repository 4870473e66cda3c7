"""Identifiers and hashes of document entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_id(number: Column) -> Column:
    return F.format_string("p%04d", number)


def block_id(page: Column, position: Column) -> Column:
    return F.format_string("%s.b%03d", page, position)


def region_id(ordinal: Column) -> Column:
    return F.format_string("r%03d", ordinal)


def short_hash(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def content_hash(*parts: Column) -> Column:
    """12 hex digits of a row's canonical JSON: the parts must be named in alphabetical order, strings and integers only."""
    return short_hash(F.to_json(F.struct(*parts)))


def cache_key(stage: Column, version: Column, schema: Column, config: Column, inputs: Column) -> Column:
    """12 hex digits over a stage's name, versions, configuration and its sorted input hashes."""
    return short_hash(F.concat_ws("|", stage, version, schema, config, F.array_join(F.array_sort(inputs), ",")))


def chunk_anchor(page: Column, block_ids: Column) -> Column:
    """chunk.{page number}.{8 hex digits of the block ids}; the page's leading p is dropped."""
    return F.concat(F.lit("chunk."), F.regexp_replace(page, "^p+", ""), F.lit("."), short_hash(F.array_join(block_ids, "|"), 8))


def asset_class_id(kind: Column, digest: Column) -> Column:
    """ac.{kind}.{12 hex digits}, zeros if the digest is empty."""
    return F.concat(F.lit("ac."), kind, F.lit("."), F.when(F.coalesce(digest, F.lit("")) == "", F.lit("0" * 12)).otherwise(F.substring(digest, 1, 12)))


def occurrence_id(page: Column, sequence: Column) -> Column:
    return F.format_string("ao.%s.%03d", page, sequence)


def png_size(content: Column) -> Column:
    """struct<width, height> from a PNG header's bytes 16 to 24, big-endian; null if the bytes are too few."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.octet_length(content) >= 24, F.struct(number(17).alias("width"), number(21).alias("height")))


def color_to_int(red: Column, green: Column, blue: Column) -> Column:
    """0xRRGGBB from components between 0 and 1."""
    part = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int")
    return F.shiftleft(part(red), 16).bitwiseOR(F.shiftleft(part(green), 8)).bitwiseOR(part(blue))
