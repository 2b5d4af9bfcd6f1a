"""BPE encoding and decoding through a table of distinct words.

For a tokenizer that drops white space, the ids of a text are the ids of its words in order, a word being a
run without ASCII white space. So

1. every block of texts (a bounded number of bytes) gives its distinct words, dealt by hash into buckets;
2. a bucket meets the words of all blocks, and each distinct word is encoded once, by the tokenizers library;
3. the ids go back to the blocks, where they are put in the places of the words.

What is shuffled is, per block, its distinct words, their ids, and the texts as word numbers, each packed
into compressed Arrow batches. No row is made per word of the corpus. Decoding joins ids with the pieces of
the vocabulary (a table of fixed size) and puts the pieces together.

A block is known by a digest of its word table, and the texts are read twice: once for the words, once for
the numbers. Should a source deal its rows differently the second time, the digests do not meet and the job
fails; pass ``derived=True`` for such a source, which writes it to the shared folder first.

Defined results: a null text is empty and has no ids; null ids and repeated rows are rows of their own; extra
columns are left out unless named in ``keep``; an empty table gives an empty table.
"""

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtide.llm.stage import bounded_batches, staged
from rowtide.llm.words import SPACE, Slice, prefix_sums, regrouped, slices, stretch_hashes

# Text per block: the larger, the fewer words are sent twice.
BLOCK_BYTES = 8 * 1024 * 1024


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only take memory
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


_loaded: dict[str, object] = {}


def _shared(path: str):
    """The tokenizer of a task, loaded once for all its groups. Not for the driver: what is held here
    travels with the functions that name it."""
    if path not in _loaded:
        _loaded[path] = _load(path)
    return _loaded[path]


def check_tokenizer(path: str) -> None:
    """Refuse a tokenizer whose ids of a text are not those of its words one after another."""
    tokenizer = _load(path)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for a, b in (("Go", "home's"), ("(a1", "b!!"), ("ÀÉ", "́x"), ("x<", "|endoftext|>")):
        for space in (" ", "\n\t ", "\r\n"):
            if ids(f"{space}{a}{space}{b}{space}") != ids(a) + ids(b):
                raise ValueError(f"{path}: white space is part of the ids, words cannot be encoded by themselves")
    if tokenizer.decoder is not None:
        raise ValueError(f"{path}: only tokenizers that decode to their pieces with spaces between are supported")


def _pack(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def split_words(part: Slice) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows of a slice in order, and at which word each row begins."""
    n = len(part.data)
    edge = np.zeros(n + 1, bool)
    edge[part.ends] = True
    solid = ~SPACE[part.data]
    first = solid & edge[:n]
    first[1:] |= solid[1:] & ~solid[:-1]
    starts = np.flatnonzero(first)
    place = np.concatenate(([0], np.cumsum(solid)))
    offsets = np.append(place[starts], place[-1]).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(part.data[solid])])
    return words, np.searchsorted(starts, part.ends)


def _bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1]
    body = words.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    sums = prefix_sums(data)
    return (stretch_hashes(sums, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)


def _block(part: Slice, buckets: int) -> tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, distinct words by bucket and then in byte order, their buckets, word numbers, row bounds."""
    words, bounds = split_words(part)
    coded = words.dictionary_encode()
    table = coded.dictionary.cast(pa.large_binary())
    if not len(table):
        return "", table, np.zeros(0, np.int64), np.zeros(0, np.int32), bounds
    bucket = _bucket_of(table, buckets)
    order = pc.sort_indices(
        pa.table({"b": bucket, "w": table}), sort_keys=[("b", "ascending"), ("w", "ascending")]).to_numpy()
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    table, bucket = table.take(pa.array(order)), bucket[order]
    digest = hashlib.blake2b(str(len(table)).encode(), digest_size=16)
    for buffer in table.buffers()[1:]:
        digest.update(buffer)
    return digest.hexdigest(), table, bucket, number[coded.indices.to_numpy(zero_copy_only=False)], bounds


def _encoded(tokenizer, words: pa.Array, batch: int = 5_000) -> pa.Array:
    """Ids per word; each is encoded once."""
    ids, ends = [], [0]
    for at in range(0, len(words), batch):
        texts = [w.decode("utf-8") for w in words.slice(at, batch).to_pylist()]
        for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids.extend(found.ids)
            ends.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def encode(
    docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    buckets: int | None = None, derived: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` of every row, and ``ids`` (array of int): what the tokenizer at
    ``tokenizer_path`` (a path every executor can read) gives for its whole text."""
    check_tokenizer(tokenizer_path)
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    if derived:
        source = staged(source, "texts")
    kept_schema = T.StructType(source.schema.fields[:-1])

    def blocks(batches):
        for batch in regrouped(batches, len(keep), block_bytes):
            for part in slices(batch.column(len(keep)), 1 << 62):
                yield batch, *_block(part, buckets)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, digest, table, bucket, _, _ in blocks(batches):
            ends = np.flatnonzero(np.diff(np.append(bucket, -1)))
            starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
            packed = [
                _pack(pa.RecordBatch.from_arrays([pa.concat_arrays([table.slice(a, b - a + 1)])], ["w"]))
                for a, b in zip(starts, ends)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[ends], pa.int32()), pa.array([digest] * len(ends), pa.string()),
                 pa.array(packed, pa.binary())], ["bucket", "block", "words"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, digest, _, _, number, bounds in blocks(batches):
            listed = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(number, pa.int32()))
            columns = [pa.concat_arrays([c]) for c in rows.columns[:-1]]
            blob = _pack(pa.RecordBatch.from_arrays([*columns, listed], [*[f"k{i}" for i in range(len(keep))], "n"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest], pa.string()), pa.array([blob], pa.binary())], ["block", "numbers"])

    def encode_bucket(asked: pa.Table) -> pa.Table:
        """All blocks' words of one bucket: encode each distinct one, answer every block in its order."""
        parts = [_unpack(b.as_py()).column(0) for b in asked.column("words")]
        coded = pa.chunked_array(parts).combine_chunks().dictionary_encode()
        ids = _encoded(_shared(tokenizer_path), coded.dictionary)
        answers, at = [], 0
        for part in parts:
            answer = ids.take(coded.indices.slice(at, len(part)))
            answers.append(_pack(pa.RecordBatch.from_arrays([pa.concat_arrays([answer])], ["ids"])))
            at += len(part)
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "ids": pa.array(answers, pa.binary())})

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        """Put the ids of a block's words (``left``) in the places of its words (``right``)."""
        shape = [*[f.name for f in kept_schema], "ids"]
        answers = {b.as_py(): i for i, b in enumerate(left.column("bucket"))}
        found = [_unpack(left.column("ids")[answers[b]].as_py()).column(0) for b in sorted(answers)]
        table = pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))
        lengths, values = pc.list_value_length(table).to_numpy(zero_copy_only=False), pc.list_flatten(table).to_numpy()
        begin = np.cumsum(lengths) - lengths
        done = []
        for blob in right.column("numbers"):
            rows = _unpack(blob.as_py())
            number = pc.list_flatten(rows.column("n")).to_numpy(zero_copy_only=False)
            if len(number) and number.max() >= len(lengths):
                raise RuntimeError("the texts were dealt into other blocks when read again; use derived=True")
            size = lengths[number]
            stop = np.cumsum(size)
            places = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[number] - (stop - size), size)
            ends = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(
                pc.list_value_length(rows.column("n")).to_numpy(zero_copy_only=False))))]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[places], pa.int32()))
            done.append(pa.Table.from_arrays([*rows.columns[:-1], ids], shape))
        return pa.concat_tables(done) if done else out_arrow.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = T.StructType([*kept_schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out_arrow = to_arrow_schema(out_schema)
    asked = source.select("_text").mapInArrow(
        lambda it: requests(_lead(it, len(keep))), "bucket int, block string, words binary")
    answered = asked.groupBy("bucket").applyInArrow(encode_bucket, "block string, bucket int, ids binary")
    numbered = source.mapInArrow(numbers, "block string, numbers binary")
    return answered.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(fill, out_schema)


def _lead(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Put the texts where they stand among ``n`` kept columns, which the first pass does not read."""
    for batch in batches:
        nothing = pa.nulls(batch.num_rows)
        yield pa.RecordBatch.from_arrays([*[nothing] * n, batch.column(0)], [*[f"k{i}" for i in range(n)], "_text"])


def pieces(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """The vocabulary as a table ``id, piece``: at most its number of entries, whatever the corpus."""
    vocabulary = _load(tokenizer_path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(
        pa.table({"id": pa.array(list(vocabulary.values()), pa.int32()), "piece": pa.array(list(vocabulary), pa.string())}))


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` added as ``out``, special tokens included.

    Ids are looked up in the table of pieces, which goes to every task whole (its size is the
    vocabulary's); ids that it does not have are left out. Null ids give null."""
    spark = encoded.sparkSession
    check_tokenizer(tokenizer_path)
    known = {r["id"]: r["piece"] for r in pieces(spark, tokenizer_path).collect()}
    listed = spark.sparkContext.broadcast([known.get(i) for i in range(max(known) + 1)])
    at = encoded.columns.index(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(listed.value, object)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                column = rows.column(at)
                texts = []
                for row in column:
                    found = None if not row.is_valid else row.values.to_numpy(zero_copy_only=False)
                    if found is None:
                        texts.append(None)
                        continue
                    got = table[found[(found >= 0) & (found < len(table))]].tolist()
                    texts.append(" ".join([p for p in got if p is not None] if None in got else got))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, out])

    return encoded.mapInArrow(join, schema)
