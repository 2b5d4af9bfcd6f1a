"""Removing repeated passages with a logarithmic family of suffix arrays.

A byte goes when a string of ``length`` bytes covers it that also starts earlier (smaller doc_id, or earlier in
the same text). Texts come in batches of ascending doc_id; an index of what came before is a family of
levels, each a suffix array in a table, of sizes that double:

* a batch gets a suffix array of its own. It holds a suffix where it can matter only: of the ``gram``-byte
  strings in any ``length`` bytes the one with the smallest hash (the leftmost of equals) is the anchor, so
  two equal strings have their anchor at the same place, and about two suffixes in ``length - gram`` are kept;
* the batch is scanned against each level by a merge join, level and batch being bucketed and sorted alike, so a
  batch is shuffled and sorted once;
* then it becomes a level, and equally large levels are merged, by a merge join as well, into one of twice the size.

An entry stands for all strings of ``length`` bytes with one anchor, which lie side by side: its *span* is
their union. A span that an earlier text has in whole makes all its strings repeats; that settles copied text but
for its edges. Two spans that differ can still have strings in common. Of such a string at least half of what
is not the anchor stands before the anchor, or at least half behind it, so the spans agree in a *flank*: the
anchor and that many bytes on one side. For the few spans that do, the strings are compared one by one.

Suffixes are ordered by their first three bytes and from there by a hash of the right flank (equality is
all that a scan asks of them). Hashes that decide are 128 bits taken together.

Defined results: a null text is empty; a null doc_id ranks last; rows of one doc_id and text are one document,
which is not its own earlier copy; different texts of one doc_id, or without one, rank by a hash of the text; texts under ``length`` bytes stay whole; extra columns are left out; an
empty table gives an empty table.
"""

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowtide.llm.stage import bounded_batches, buckets_in_order, shuffles_removed, staged
from rowtide.llm.words import SLICE_BYTES, U64, Slice, mix, prefix_sums, signed, slices, stretch_hashes

LENGTH = 100
GRAM = 24
BATCHES = 4

_HASH_BITS = 31  # of an anchor's rank; the rest of the 64 bits hold its place
_PLACE = U64((1 << (64 - _HASH_BITS)) - 1)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the strings of ``length`` bytes inside the rows of a text: first start, number, anchor, and row of
    every run with one anchor, and the prefix sums."""
    n, wide = len(data), length - gram + 1
    sums = prefix_sums(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, sums
    at = np.arange(n - gram + 1)
    ranked = (stretch_hashes(sums, at, at + gram) >> U64(64 - _HASH_BITS) << U64(64 - _HASH_BITS)) | at.astype(U64)
    least, reach = ranked, 1
    while reach * 2 <= wide:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: n - length + 1], least[wide - reach: wide - reach + n - length + 1])
    anchor = (least & _PLACE).astype(np.int64)
    starts = np.arange(n - length + 1)
    row = np.searchsorted(ends, starts, "right") - 1
    inside = starts + length <= ends[row + 1]
    starts, anchor, row = starts[inside], anchor[inside], row[inside]
    if not len(starts):
        return empty, empty, empty, empty, sums
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    return starts[first], count, anchor[first], row[first], sums


def suffix_keys(data: np.ndarray, sums: np.ndarray, anchor: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``anchor``: three bytes as they are, then a hash up to ``ends``."""
    lead = data[anchor].astype(U64) << U64(56) | data[anchor + 1].astype(U64) << U64(48) | data[anchor + 2].astype(U64) << U64(40)
    return signed((lead | stretch_hashes(sums, anchor, ends) >> U64(24)) ^ U64(1 << 63))


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A slice as it is, or, if it is one very long text, in parts that overlap by ``length - 1`` bytes."""
    if len(data) <= 2 * SLICE_BYTES:
        yield 0, data, ends
        return
    for low in range(0, max(1, len(data) - length + 1), SLICE_BYTES):
        part = data[low: low + SLICE_BYTES + length - 1]
        yield low, part, np.array([0, len(part)])


def text_ranks(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The place of every row's document in their order; rows of one document have the same."""
    order = np.lexsort((texts, ids))
    new = (ids[order][1:] != ids[order][:-1]) | (texts[order][1:] != texts[order][:-1])
    ranks = np.zeros(len(ids), np.int64)
    ranks[order[1:]] = np.cumsum(new)
    return ranks


def in_order(first: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The order by ``first`` and, among equals, by the others in turn; these are sorted where ``first`` has equals only."""
    order = np.argsort(first)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = first[order[1:]] == first[order[:-1]]
    tied = np.flatnonzero(same[1:] | same[:-1])
    some = order[tied]
    order[tied] = some[np.lexsort([x[some] for x in (*others[::-1], first)])]
    return order


def suffix_array(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The entries of a batch (``doc, text``, and ``t`` if ``doc`` has several texts): ``h`` suffix key (a hash of the right flank), ``f`` hash of the left
    flank, ``s`` hash of the span, ``doc``, ``t``, ``start`` of the span's first string, ``n`` strings, ``a`` place of the
    anchor behind ``start``, and ``again``: an earlier place in what a task works on at once has that span. Nothing more is
    asked of such an entry, so its ``h`` is a number of its own, and many copies do not meet in one bucket.

    Where a flank is longer than the text, no string needs it, and it is cut where the text ends."""
    flank = (length - gram + 1) // 2
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for part in slices(batch.column(1)):
                ranks = text_ranks(ids[part.first: part.last], texts[part.first: part.last])
                for low, data, ends in segments(part.data, part.ends, length):
                    start, n, anchor, row, sums = anchors(data, ends, length, gram)
                    if not len(start):
                        continue
                    h = suffix_keys(data, sums, anchor, np.minimum(anchor + gram + flank, ends[row + 1]))
                    f = signed(stretch_hashes(sums, np.maximum(anchor - flank, ends[row]), anchor + gram))
                    s = stretch_hashes(sums, start, start + n + length - 1)
                    s = signed(mix(s + U64(1000003) * n.astype(U64) + U64(998244353) * (anchor - start).astype(U64)))
                    order = in_order(h, s, ranks[row], start - ends[row])
                    h, f, s, row, start, n, anchor = (x[order] for x in (h, f, s, row, start, n, anchor))
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
                    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                    place = start - ends[row]
                    again = (ranks[row] != ranks[row[first]]) | (place != place[first])
                    h = np.where(again, signed(mix(h.view(U64) + ranks[row].astype(U64) * U64(1000003) + start.astype(U64))), h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(f), pa.array(s), pa.array(ids[part.first + row]), pa.array(texts[part.first + row]),
                         pa.array((start - ends[row] + low).astype(np.int32)), pa.array(n.astype(np.int16)),
                         pa.array((anchor - start).astype(np.int16)), pa.array(again)],
                        ["h", "f", "s", "doc", "t", "start", "n", "a", "again"])

    docs = docs.select("doc", "text", F.col("t") if "t" in docs.columns else F.lit(0).cast("long").alias("t"))
    return docs.mapInArrow(work, "h long, f long, s long, doc long, t long, start int, n short, a short, again boolean")


class SuffixIndex:
    """A family of levels: tables ``h, f, s, doc, t, start, n, a`` of the first occurrence of every span so far.

    All levels have the same buckets, sorted by suffix key and span, so that scanning and merging them
    moves no row of a level between tasks."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []  # size class, table; ascending
        self._name = f"suffixes_{uuid.uuid4().hex}"
        self._made = 0

    def _save(self, rows: DataFrame) -> str:
        self._made += 1
        table = f"{self._name}_{self._made}"
        with shuffles_removed(self.spark), buckets_in_order(self.spark):
            (rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "h", "s").sortBy("h", "s")
             .saveAsTable(table))
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def add(self, entries: DataFrame, last: bool = False) -> DataFrame:
        """Scan a batch (entries of ``suffix_array``, later than all before) against the levels, and take it
        into the family. Gives the entries that an earlier text has in whole: ``doc, t, start, n``. No level is merged
        with the ``last`` batch, as no other is scanned against it."""
        batch = self._save(entries.repartition(self.buckets, "h", "s"))
        rows = self.spark.table(batch)  # a text in segments can have a span more than once without ``again``
        fresh, again = rows.where("NOT again"), rows.where("again")
        firsts = fresh.groupBy("h", "s").agg(F.min(F.struct("doc", "t", "start", "f", "n", "a")).alias("own"))
        for _, table in self.levels:
            firsts = firsts.join(self.spark.table(table).select("h", "s"), ["h", "s"], "left_anti")
        size, merged = 0, self._save(firsts.select("h", "own.f", "s", "own.doc", "own.t", "own.start", "own.n", "own.a"))
        # What is not a first occurrence stands earlier. No place of a span is before that of its first occurrence.
        own = self.spark.table(merged).select(
            F.col("h").alias("_h"), F.col("s").alias("_s"), F.struct("doc", "t", "start").alias("own"))
        itself = (F.col("h") == F.col("_h")) & (F.col("s") == F.col("_s")) & (F.col("own") >= F.struct("doc", "t", "start"))
        with buckets_in_order(self.spark):
            repeats = fresh.join(own, itself, "left_anti").union(again).select("doc", "t", "start", "n")
            repeats = staged(repeats, "repeated")
        self._drop(batch)
        while not last and self.levels and self.levels[0][0] == size:
            pair = merged, self.levels.pop(0)[1]
            merged = self._save(self._merged(*pair))
            size += 1
            for table in pair:
                self._drop(table)
        self.levels.insert(0, (size, merged))
        return repeats

    def _merged(self, newer: str, older: str) -> DataFrame:
        """Two levels as one: no span is in both. Their buckets meet as they are."""
        both = self.spark.table(newer).alias("a").join(self.spark.table(older).alias("b"), ["h", "s"], "full")
        return both.select("h", "s", *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("f", "doc", "t", "start", "n", "a")])

    def rows(self) -> DataFrame:
        """All first occurrences."""
        found = self.spark.table(self.levels[0][1])
        for _, table in self.levels[1:]:
            found = found.unionByName(self.spark.table(table))
        return found

    def drop(self) -> None:
        for _, table in self.levels:
            self._drop(table)
        self.levels = []


def spans_of(column: pa.Array, part: Slice) -> tuple[np.ndarray, ...]:
    """Row in the slice, first start and number of all spans that a column lists for the rows of a slice."""
    lists = column.slice(part.first, part.last - part.first)
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    spans = lists.flatten()
    start, n = (spans.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    return np.repeat(np.arange(len(count)), count), start, n


def single_strings(docs: DataFrame, spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """Strings of the given spans (``doc, t, start, n``) that start earlier elsewhere: the same with n = 1."""
    asked = spans.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # spans of one text
    texts = docs.join(asked, ["doc", "t"]).select("doc", "text", "spans", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            for part in slices(batch.column(1)):
                row, start, n = spans_of(batch.column(2), part)
                start = part.ends[row] + start
                order, half, found = np.argsort(start), length // 2, []
                bound = len(order) if len(part.data) <= 2 * SLICE_BYTES else 4096  # of a very long text, what is hashed at once
                for low in range(0, len(order), bound):
                    some = order[low: low + bound]
                    first, count = start[some], n[some].astype(np.int64)
                    base, top = int(first.min()), int((first + count).max()) + length - 1
                    sums = prefix_sums(part.data[base:top])
                    at = np.repeat(first - base - np.cumsum(count) + count, count) + np.arange(count.sum())
                    w = stretch_hashes(sums, at, at + length)
                    v = mix(stretch_hashes(sums, at, at + half) + U64(17)).astype(np.uint32)
                    found.append((at + base, np.repeat(row[some], count), w, v))
                if not found:
                    continue
                at, row, w, v = (np.concatenate(x) for x in zip(*found))
                rank = text_ranks(ids[part.first: part.last], ts[part.first: part.last])[row]
                place = at - part.ends[row]
                order = in_order(w, v, rank, place)
                one, two = order[1:], order[:-1]
                again = np.zeros(len(at), bool)
                again[one] = (w[one] == w[two]) & (v[one] == v[two]) & (rank[one] == rank[two]) & (place[one] > place[two])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(w)), pa.array(v.view(np.int32)), pa.array(ids[part.first + row]), pa.array(ts[part.first + row]),
                     pa.array(place.astype(np.int32)), pa.array(again)], ["w", "v", "doc", "t", "start", "again"])

    # Texts are hashed once, and their strings are shuffled and sorted once.
    strings = texts.mapInArrow(work, "w long, v int, doc long, t long, start int, again boolean")
    text = F.struct("doc", "t")
    strings = strings.withColumn("first", F.min(text).over(Window.partitionBy("w", "v")))
    later = strings.where(F.col("again") | (text > F.col("first")))
    return staged(later.select("doc", "t", "start", F.lit(1).cast("short").alias("n")), "later")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``doc, t, start, n`` of all strings of ``length`` bytes (``n`` side by side from ``start``) that start
    earlier; ``docs`` has ``doc, text, t``, and may have more."""
    spark = docs.sparkSession
    index = SuffixIndex(spark)
    cuts = docs.select(F.percentile_approx("doc", [(i + 1) / batches for i in range(batches - 1)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    found = None
    for low, high in zip(edges[:-1], edges[1:]):
        batch = docs if low is None else docs.where(F.col("doc") > low)
        batch = batch if high is None else batch.where(F.col("doc") <= high)
        repeats = index.add(suffix_array(batch.select("doc", "text", "t"), length, gram), last=high is None)
        found = repeats if found is None else found.union(repeats)
    # Strings that begin ``flank`` bytes or more before the anchor hold the left flank, all others the right one.
    spans, mixed, flank = index.rows(), None, (length - gram + 1) // 2
    left = F.least(F.col("n").cast("int"), F.col("a") - flank + 1)
    for side, start, n in (("f", F.col("start"), left),
                           ("h", F.col("start") + F.greatest(left, F.lit(0)), F.col("n") - F.greatest(left, F.lit(0)))):
        dealt = spans.select(side, "doc", "t", "start", "n", "a").repartition(side)  # one exchange is read twice, unsorted
        shared = dealt.groupBy(side).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col(side).alias("_side"))
        some = dealt.join(shared.hint("shuffle_hash"), F.col(side) == F.col("_side"))
        some = some.select("doc", "t", start.cast("int").alias("start"), n.cast("int").alias("n")).where("n > 0")
        some = staged(some, "shared")  # one side after the other: each shuffles all spans
        mixed = some if mixed is None else mixed.union(some)
    index.drop()
    return found.union(single_strings(docs, mixed, length))


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc, text``) with ``t``, by which the texts of one ``doc`` differ: a hash of the text where there
    are several (as for all rows without doc_id), else 0."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.groupBy("doc").agg(F.min(h).alias("least"), F.max(h).alias("most")).where("least <> most")
    several = staged(several.select("doc", F.lit(True).alias("several")), "several")
    return docs.join(several, "doc", "left").withColumn("t", F.when(F.col("several"), h).otherwise(0)).drop("several")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary, the bytes that stay) and ``spans`` (begin and
    end of every removed run)."""
    bounded_batches(docs.sparkSession)
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    rows = docs.select(rank, F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = told_apart(rows)
    gone = repeated(rows, length, gram, batches)
    gone = gone.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    joined = rows.join(gone, ["doc", "t"], "left").select("doc_id", "text", "gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                row, start, n = spans_of(batch.column(2), part)
                start, ends, size = part.ends[row] + start, part.ends, len(part.data)
                cover = np.zeros(size + 1, np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + n + length - 1, -1)
                away = np.cumsum(cover, out=cover)[:-1] > 0
                edge = np.zeros(size + 1, bool)  # a run ends where its text does
                edge[ends] = True
                begins, stops = edge[:-1].copy(), edge[1:].copy()
                begins[1:] |= ~away[:-1]
                stops[:-1] |= ~away[1:]
                begins, stops = np.flatnonzero(begins & away), np.flatnonzero(stops & away) + 1
                before = ends[np.searchsorted(ends, begins, "right") - 1]
                spans = np.searchsorted(begins, ends).astype(np.int32)
                removed = np.concatenate(([0], np.cumsum(stops - begins)))[spans]
                kept = np.ascontiguousarray(part.data[~away])
                offsets = (ends - removed).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.last - part.first), pa.array(np.diff(ends)), pa.array(np.diff(removed)),
                     pa.array(np.diff(spans).astype(np.int64)),
                     pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)]),
                     pa.ListArray.from_arrays(pa.array(spans), pa.StructArray.from_arrays(
                         [pa.array((x - before).astype(np.int32)) for x in (begins, stops)], ["start", "stop"]))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return joined.mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,stop:int>>")
