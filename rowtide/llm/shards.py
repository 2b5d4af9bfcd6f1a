"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the document id. A bucket that holds more than
``max_bytes`` splits on the next bit; all others stay as they are, so shards differ in how many bits
they look at (their depth), and each document is in exactly one.

The sums of all depths come from one pass: documents are added up in cells of ``_STEP`` bits, and a bucket is
the shallowest prefix whose sum fits. Cells that are still too large are refined by as many bits again,
their documents only. Documents whose whole hash is equal cannot be parted by it: a bucket of them becomes
a chain of shards, filled one after another in the order of the texts' hashes. A document larger than
the limit has a shard to itself.

Defined results: a null text has 0 bytes, null ids share one hash, rows are never parted from their columns;
an empty table gives an empty table.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowtide.llm.stage import free_name, staged

MAX_BYTES = 2 * 1024 * 1024
BITS = 60
_STEP = 12


def hash_bits(id_: str = "doc_id") -> Column:
    """60 bits of the MD5 of the id, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_).cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def directory(cells: DataFrame, depth: int, top: int, max_bytes: int) -> DataFrame:
    """Buckets ``depth, prefix, bytes`` of cells ``cell, bytes`` of ``depth`` bits: the shallowest prefixes of
    ``top`` bits or more that hold at most ``max_bytes``; cells that hold more at full depth stay whole."""
    every = cells.select("bytes", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"), "cell")
    prefix = F.expr(f"shiftright(cell, {depth} - depth)")
    sums = every.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"))
    fits = sums.where((F.col("bytes") <= max_bytes) | (F.col("depth") == depth))
    above = sums.where(F.col("bytes") > max_bytes).select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    child = fits.withColumn("parent", F.shiftright("prefix", 1))
    return child.where(F.col("depth") == top).select("depth", "prefix", "bytes").union(
        child.where(F.col("depth") > top).join(above, ["depth", "parent"], "left_semi").select("depth", "prefix", "bytes"))


def assigned(docs: DataFrame, max_bytes: int = MAX_BYTES, id_: str = "doc_id", text: str = "text",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id, n_bytes, shard`` (the bits of its bucket, and the number of a link where one hash holds too
    much), ``depth`` and ``shard_bytes``;
    and the columns of ``docs`` named in ``carry``."""
    rows = staged(docs.select(
        F.col(id_).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        hash_bits(id_).alias("hash"), F.xxhash64(text).alias("text_hash"), *carry), "hashes")
    done, open_, top = None, rows, 0
    while True:
        depth = min(BITS, top + _STEP)
        cell = F.shiftright("hash", BITS - depth).alias("cell")
        cells = open_.groupBy(cell).agg(F.sum("n_bytes").alias("bytes"))
        buckets = staged(directory(cells, depth, top, max_bytes), "directory")
        cut = F.expr(f"shiftright(cell, {depth} - depth)") == F.col("prefix")
        known = cells.select("cell").withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(depth)))).withColumn(
            "prefix", F.expr(f"shiftright(cell, {depth} - depth)")).join(buckets, ["depth", "prefix"])
        met = open_.withColumn("cell", cell).join(known, "cell")
        large = (F.col("bytes") > max_bytes) & (F.col("depth") == depth)
        found = met.where(~large) if depth < BITS else met
        done = found if done is None else done.unionByName(found)
        if depth == BITS or buckets.where(large).isEmpty():
            break
        open_ = staged(met.where(large).select(*rows.columns), "open")
        top = depth
    chained = done.where(F.col("bytes") <= max_bytes).withColumn("link", F.lit(0).cast("long")).unionByName(
        _chained(done.where(F.col("bytes") > max_bytes), max_bytes))
    bits = F.expr(f"right(lpad(conv(cast(prefix AS string), 10, 2), {BITS}, '0'), depth)")
    name = F.when(F.col("link") != 0, F.concat(bits, F.lit("/"), F.col("link").cast("string"))).otherwise(bits)
    return chained.select("doc_id", "n_bytes", name.alias("shard"), "depth", F.col("bytes").alias("shard_bytes"), *carry)


def _chained(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Buckets that no bit can part, cut into links of at most ``max_bytes`` each (or one document)."""
    small = F.col("n_bytes") * 2 <= max_bytes
    same = W.partitionBy("hash", small).orderBy("text_hash", "n_bytes")
    before = F.coalesce(F.sum("n_bytes").over(same.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A link of small documents takes what begins in a half of the limit, so that its last one still fits;
    # a document of more than half the limit is a link of its own.
    link = F.when(small, F.floor(before * 2 / max_bytes) + 1).otherwise(-F.row_number().over(same)).cast("long")
    linked = rows.withColumn("link", link)
    sums = linked.groupBy("hash", "link").agg(F.sum("n_bytes").alias("sum"))
    return linked.join(sums, ["hash", "link"]).withColumn("bytes", F.col("sum")).select(*rows.columns, "link")


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Write ``docs`` to ``path`` in a folder per shard. Every row gets a number of its own, which finds its shard, so
    that rows of one id, or without one, are written once each, also where links part them."""
    shard, row = free_name(docs, "shard"), free_name(docs, "row_number")
    kept = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    homes = assigned(kept, max_bytes, carry=(row,)).select(row, F.col("shard").alias(shard))
    kept.join(homes, row).drop(row).repartition(shard).write.partitionBy(shard).parquet(path)
