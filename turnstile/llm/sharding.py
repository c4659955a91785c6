"""Shards of bounded size by extendible hashing.

A directory is indexed by the first bits of a row's hash. A bucket that is too large splits on one more bit, others stay,
until every bucket fits; a bucket is named by its bits. Sizes are summed per directory cell first, so deciding the
splits works on cells and not on rows. Where rows of one hash alone exceed the limit, no bit parts them: such a bucket
is cut into numbered pages by a running sum of bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from turnstile.llm.common import free_name, written

#: Bits of the hash, and by how many the directory deepens where cells are still too large.
HASH_BITS, DEEPEN = 60, 8
_RUN = 8192


def hash_of(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; of an empty text for null."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, F.lit(HASH_BITS) - depth)


def bits(h: Column, depth: Column) -> Column:
    """The first `depth` bits as text."""
    return F.substr(F.lpad(F.bin(h), HASH_BITS, "0"), F.lit(1), depth)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(cell_depth, cell, depth): for each directory cell, the depth of its bucket. `sizes` has (h, bytes)."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    top, below, out = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 4), None
    while True:
        cells = sizes.groupBy(_prefix(F.col("h"), below).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        ups = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(top), F.lit(below))).alias("depth"))
        up = F.call_function("shiftright", F.col("cell"), F.lit(below) - F.col("depth"))
        sums = ups.groupBy("depth", up.alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        fits = sums.filter((F.col("bytes") <= limit) | (F.lit(below) == HASH_BITS) & (F.col("depth") == HASH_BITS)).select("depth", "prefix")
        found = ups.select("cell", "depth", up.alias("prefix")).join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        layer = written(cells.join(found, "cell", "left").select(F.lit(below).alias("cell_depth"), "cell", "depth"), "directory")
        done = layer.filter("depth IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        large = layer.filter("depth IS NULL").select("cell")
        if large.isEmpty():
            return out
        sizes = written(sizes.withColumn("cell", _prefix(F.col("h"), below)).join(large, "cell", "left_semi").select("h", "bytes"), "large")
        top, below = below + 1, min(HASH_BITS, below + DEEPEN)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Adds `page` to rows (h, bytes, ...) of buckets that no bit splits, so that each page fits.

    Running sums are taken within runs of rows and over the sums of runs, so one hash with very many rows is not in
    one task.
    """
    rows = written(rows.withColumn("run", F.expr(f"monotonically_increasing_id() div {_RUN}")).withColumn("place", F.monotonically_increasing_id()), "pages")
    runs = rows.groupBy("h", "run").agg(F.sum("bytes").alias("run_bytes"))
    before = Window.partitionBy("h").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("ahead", F.coalesce(F.sum("run_bytes").over(before), F.lit(0))).drop("run_bytes")
    largest = rows.groupBy("h").agg(F.max("bytes").alias("largest"))
    inside = Window.partitionBy("h", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("bytes").over(inside), F.lit(0)) + F.col("ahead")
    step = F.greatest(F.lit(limit) - F.col("largest"), F.lit(1))
    return rows.join(runs, ["h", "run"]).join(largest, "h").withColumn("page", F.floor(start / step).cast("int")).drop("run", "place", "ahead", "largest")


def shard(rows: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input columns with `n_bytes`, `depth`, `shard` (the bucket's bits, then -page where it has pages), `shard_bytes`.

    Every shard has at most `limit` bytes, unless it is one row that is larger by itself; page cuts leave room for the
    largest row of their hash. Null texts count 0 bytes, null ids hash as an empty text, repeated rows share a hash.
    Names that the input already has get underscores.
    """
    h, size, depth, name, whole = (free_name(rows, n) for n in ("shard_hash", "n_bytes", "depth", "shard", "shard_bytes"))
    hashed = rows.withColumn(h, hash_of(F.col(id_col))).withColumn(size, F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long"))
    # 16 bytes a row, so that deciding the splits does not read the texts again.
    sizes = written(hashed.select(F.col(h).alias("h"), F.col(size).alias("bytes")), "sizes")
    found = written(directory(sizes, limit), "cells")
    depths = [r[0] for r in found.select("cell_depth").distinct().collect()]
    placed = None
    for d in sorted(depths):
        level = found.filter(F.col("cell_depth") == d).select(F.col("cell").alias("__cell"), F.col("depth").alias(depth))
        part = hashed.join(level, _prefix(F.col(h), d) == F.col("__cell")).drop("__cell")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        placed = hashed.withColumn(depth, F.lit(0))
    bucket = bits(F.col(h), F.col(depth))
    sums = sizes.join(found.filter(f"depth = {HASH_BITS}"), _prefix(F.col("h"), HASH_BITS) == F.col("cell"), "left_semi").groupBy("h").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    tight = written(sums.filter((F.col("b") > limit) & (F.col("n") > 1)).select(F.col("h").alias("__h")), "tight")
    if tight.isEmpty():
        named = placed.withColumn(name, bucket)
    else:
        over = placed.join(tight, F.col(h) == F.col("__h"), "left_semi")
        cut = _pages(over.select(F.col(h).alias("h"), F.col(size).alias("bytes"), F.struct(*placed.columns).alias("row")), limit)
        cut = cut.select("row.*", "page").withColumn(name, F.concat(bucket, F.lit("-"), F.col("page"))).drop("page")
        named = placed.join(tight, F.col(h) == F.col("__h"), "left_anti").withColumn(name, bucket).unionByName(cut)
    totals = named.groupBy(name).agg(F.sum(size).alias(whole))
    return named.join(totals, name).select(*rows.columns, size, depth, name, whole)
