"""Substring deduplication by hashing lines, and the sentences of lines.

A unit is a line or a sentence of a line (ended by ``.``, ``!`` or ``?`` before white space) of at least
``min_words`` words. Units are normalised (lower case, one space for any white space, none at the ends) and
known by a 128-bit digest. Of equal units everywhere the earliest ranked stays: that of the smallest doc_id,
there the first. All others are cut out of their texts. Offsets are code points of the original text.

A unit that its own text has before is found where the text is read; only a text's first occurrences are
shuffled, and counted per digest before that, so a unit in every document costs no more than any other.

Defined results: a null text has no units; a null doc_id ranks last; rows of one doc_id and text are
one document, and texts of one doc_id rank by a hash of the text, so there are no ties; a text of any length is taken
whole, by one task; extra columns are left out; an empty table gives an empty table.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtide.llm.stage import bounded_batches, staged

MIN_WORDS = 8

_SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?]+(?=\s|$)|(?=\s*$))", re.M)

_UNITS = "doc_id long, h long, d1 long, d2 long, start int, stop int, again boolean"


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """Begin, end and digest of the lines and sentences of a text that are long enough, lines first."""
    found = []
    at = 0
    for line in text.split("\n"):
        words = line.split()
        if len(words) >= min_words:
            yield at, at + len(line), _digest(words)
            found.append((at, line))
        at += len(line) + 1
    for at, line in found:
        for m in _SENTENCE.finditer(line):
            words = m.group().split()
            if len(words) >= min_words and m.end() - m.start() < len(line.strip()):
                yield at + m.start(), at + m.end(), _digest(words)


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).lower().encode(), digest_size=16).digest()


def all_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                           ("start", pa.int32()), ("stop", pa.int32()), ("again", pa.bool_())])
        out = [[] for _ in shape]

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for id_, h, text in zip(*batch.columns):
                seen = set()
                for start, stop, d in units(text.as_py() or "", min_words):
                    row = (id_.as_py(), h.as_py(), int.from_bytes(d[:8], "little", signed=True),
                           int.from_bytes(d[8:], "little", signed=True), start, stop, d in seen)
                    seen.add(d)
                    for c, v in zip(out, row):
                        c.append(v)
                    if len(out[0]) >= 20_000:
                        yield flush()
        if out[0]:
            yield flush()

    return _rows(docs).mapInArrow(work, _UNITS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def removed_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, h, start, stop`` of every unit that occurs earlier; ``h`` tells texts of one id apart."""
    found = staged(all_units(docs, min_words), "units")
    firsts = found.where("NOT again")
    rank = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    repeated = firsts.groupBy("d1", "d2").agg(F.min(rank).alias("keeper"), F.max(rank).alias("last"))
    repeated = repeated.where("keeper <> last").drop("last")
    later = firsts.withColumn("rank", rank).join(repeated, ["d1", "d2"]).where("rank > keeper")
    return found.where("again").select("doc_id", "h", "start", "stop").union(later.select("doc_id", "h", "start", "stop"))


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the spans put together where they meet. With a whole line goes its
    line feed."""
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if (start == 0 or text[start - 1] == "\n") and stop < len(text) and text[stop] == "\n":
            stop += 1
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    kept, at = [], 0
    for start, stop in merged:
        kept.append(text[at:start])
        at = stop
    return "".join([*kept, text[at:]]), [tuple(m) for m in merged]


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row ``doc_id, n_chars, n_removed`` (code points), ``spans`` (begin and end of what was removed, in
    the original) and ``text``, what is left."""
    bounded_batches(docs.sparkSession)
    gone = removed_units(docs, min_words).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    rows = _rows(docs).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("r.h").eqNullSafe(F.col("g.h"))
    joined = rows.join(gone.alias("g"), same, "left").select("r.doc_id", "text", "gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts, spans, before, after = [], [], [], []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    left, merged = cut(text or "", [(g["start"], g["stop"]) for g in gone or ()])
                    texts.append(left)
                    spans.append([{"start": a, "stop": b} for a, b in merged])
                    before.append(len(text or ""))
                    after.append(len(text or "") - len(left))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(spans, span),
                     pa.array(texts, pa.string())], ["doc_id", "n_chars", "n_removed", "spans", "text"])

    return joined.mapInArrow(
        work, "doc_id long, n_chars long, n_removed long, spans array<struct<start:int,stop:int>>, text string")
