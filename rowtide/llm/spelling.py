"""Spelling variants: words that differ by one letter are found through PartEnum signatures of their letters.

A word's letters are a binary vector with one dimension per letter and occurrence of it (the second ``e`` is
another dimension than the first). One inserted, deleted or replaced letter changes one or two of them, so the
vectors of near words are at most two apart. The dimensions are dealt to ``PARTS`` parts, letters in order of
how common they are, so that the parts weigh alike. Two changes reach two parts at most: of the enumerated
choices of ``PARTS - 2`` parts one at least is equal in both words, and an equi-join on (choice, its letters) finds
every pair. An inserted or deleted letter reaches one part only, and two of the choices do.

A signature also carries the length, and the half of the word that the change leaves alone (one of two rows
each), which keeps the groups under a signature small without losing a pair. Every pair that meets is verified
by its edit distance in code points.

Defined results: null and empty texts have no words; a null id is written ``null`` in what is hashed; a text's
length has no bound, nor has a word's (very long texts are matched whole); repeated rows count each; of two near
words with equal counts the smaller in code-point order is the form; extra columns are left out; an empty table
gives an empty one.
"""

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowtide.llm.stage import bounded_batches, discard, staged
from rowtide.llm.words import U64, mix, powers, signed, stretch_hashes

LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased
LEAST_LENGTH = 7
LEAST_COUNT = 2
DAMAGED = 31  # one run in so many loses a letter
RATIO = 10  # a form is so many times as frequent at least

PARTS = 4
CHOICES = list(itertools.combinations(range(PARTS), PARTS - 2))
#: Choices of which one at least holds where a single part differs.
APART = [(0, 1), (2, 3)]

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HELD = 200_000  # distinct words a task adds up before it hands them on
_ROWS = 20_000  # words whose signatures are made at once
_BASE = U64(0x9E3779B97F4A7C15)


def count_words(docs: DataFrame, text: str = "text", id_: str = "doc_id", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """Table ``word, n``: the runs of letters of all texts, A-Z lower-cased, with how often they occur.

    A run loses the code point ``h % length`` where ``damaged`` divides the crc32 ``h`` of ``<id>:<run>``."""
    bounded_batches(docs.sparkSession)
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def rows(held: Counter) -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1)):
                if body.as_py() is None:
                    continue
                start = zlib.crc32(f"{key.as_py()}:".encode())
                for word, n in Counter(run.findall(body.as_py().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % damaged == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= _HELD:
                    yield rows(held)
        if held:
            yield rows(held)

    texts = docs.select(F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit("null")).alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    counted = texts.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins (one more than words)."""
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(U64)
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        if batch.num_rows:
            codes, n = np.unique(_codes(batch.column(0))[0], return_counts=True)
            total.update(dict(zip(codes.tolist(), n.tolist())))
    yield pa.RecordBatch.from_pydict({"letter": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})


def part_hashes(codes: np.ndarray, bounds: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Per part, the sum of the hashes of each word's dimensions in it: equal where the letters there are equal."""
    word = np.repeat(np.arange(len(bounds) - 1, dtype=U64), np.diff(bounds))
    order = np.argsort((word << U64(32)) | codes, kind="stable")
    letter, word = codes[order], word[order]
    first = np.ones(len(letter), bool)
    first[1:] = (letter[1:] != letter[:-1]) | (word[1:] != word[:-1])
    at = np.arange(len(letter))
    rank = at - np.maximum.accumulate(np.where(first, at, 0))
    part = (place[letter.astype(np.int64)] + rank) % PARTS
    hashes = mix((letter << U64(32)) + rank.astype(U64))
    return [np.add.reduceat(np.where(part == p, hashes, U64(0)), bounds[:-1]) for p in range(PARTS)]


def signatures(column: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of keys, a row per word: under its own length, and as the longer word of a pair."""
    codes, bounds = _codes(column)
    parts = part_hashes(codes, bounds, place)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(mix(codes + U64(1)) * powers(_BASE, len(codes)), out=sums[1:])
    low, high, length = bounds[:-1], bounds[1:], np.diff(bounds)
    chosen = {c: mix(sum((parts[p] * U64(2 * p + 3) for p in c), U64(CHOICES.index(c)))) for c in CHOICES}

    def keys(choices, base, begin, tail):
        halves = (stretch_hashes(sums, low, low + begin), mix(stretch_hashes(sums, high - tail, high)))
        salt = mix(base.astype(U64) + U64(1 << 40))
        return np.stack([mix(half + salt + chosen[c]) for c in choices for half in halves], axis=1)

    short = length - 1
    return keys(CHOICES, length, length // 2, length - length // 2), keys(APART, short, short // 2, short - short // 2)


def _signed(words: DataFrame) -> DataFrame:
    """``word, n`` with the keys of ``signatures`` as arrays ``own`` and ``longer``."""
    counts = words.select("word").mapInArrow(_letter_counts, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    # At most as many rows as there are letters in the alphabet, whatever the corpus.
    common = [r["letter"] for r in counts.orderBy(F.desc("n"), "letter").collect()]
    place = np.zeros(max(common, default=0) + 1, np.int64)
    place[common] = np.arange(len(common))

    def lists(found: np.ndarray) -> pa.Array:
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(signed(found.reshape(-1))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                own, longer = signatures(part.column(0), place)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(own), lists(longer)], ["word", "n", "own", "longer"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, own array<long>, longer array<long>")


def near_pairs(words: DataFrame) -> DataFrame:
    """Table ``word, n, near, near_n``: every pair of the words of table ``word, n`` (each there once) that is one
    inserted, deleted or replaced code point apart, once."""
    made = _signed(words)
    own = made.select("word", "n", F.explode("own").alias("key"))
    longer = made.select("word", "n", F.explode("longer").alias("key"))
    a, b = own.alias("a"), own.alias("b")
    one_edit = F.levenshtein("a.word", "b.word", 1) == 1
    columns = [F.col("a.word"), F.col("a.n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")]
    replaced = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & one_edit).select(*columns)
    b = longer.alias("b")
    inserted = a.join(b, (F.col("a.key") == F.col("b.key")) & one_edit).select(*columns)
    # A pair of words that both are of one length meets in the first join only, others in the second only.
    same = F.char_length("word") == F.char_length("near")
    return replaced.where(same).union(inserted.where(~same)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """Table ``word, root`` for a table ``word, form`` without cycles: the end of each word's chain. A round doubles
    the steps taken; only whether anything changed comes to the driver."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = staged(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                          F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per row of the table ``word, n``: its ``form`` (the near word of largest count, if ``ratio`` times as frequent),
    the ``root`` at the end of the chain of forms, ``n_near`` and ``form_n``."""
    words = staged(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select("word", "near", "near_n").union(
        pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    is_form = -F.col("best.minus_n") >= ratio * F.col("n")
    judged = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus_n")).alias("form_n")), "forms")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
