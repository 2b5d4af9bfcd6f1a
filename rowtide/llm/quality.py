"""Quality rules by weak supervision.

Each rule looks at a few counts of a text and votes good (1), bad (0) or abstains (-1). How far each rule
can be trusted is not set by hand: expectation-maximisation over the votes of *all* documents estimates
per rule how often it votes what when a text is good or bad, and a document is kept when its posterior
probability of being good reaches ``min_posterior``. No label is used.

Votes take one of at most ``3 ** len(RULES)`` patterns. Spark counts the patterns of all documents; that
table, of bounded size whatever the corpus, is what the driver fits the model on and what the posteriors
are joined back by.

Defined results: a null text has no words (and so fails the base rule); null ids and repeated rows are
documents of their own, and rows of equal texts get equal verdicts, so there are no ties; texts are measured as
a whole at any length (the vocabulary rule abstains above 1,000 words, as long texts repeat words anyway); an
empty table gives an empty table; ``judge`` leaves extra columns out, ``keep_good`` passes them through,
whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtide.llm.stage import bounded_batches, staged
from rowtide.llm.words import SPACE, Slice, prefix_sums, slices, stretch_hashes, window_hashes, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
PRIOR_DOCS = 1_000  # documents that the prior of the model weighs as much as

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"): ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"): ord("9") + 1] = True
_POINT = np.ones(256, bool)  # first bytes of code points
_POINT[0x80:0xC0] = False

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_stops",
    "n_upper", "n_digits", "n_long_words",
)


def _repeats(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more in their row, and which have an equal one before them."""
    order = np.lexsort((values, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (values[order][1:] == values[order][:-1])
    again, twice = np.zeros(len(values), bool), np.zeros(len(values), bool)
    again[order[1:]] = same  # the sort keeps the order of equal values
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def text_counts(part: Slice) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of every row of a slice."""
    rows = part.last - part.first
    sums = prefix_sums(part.data)
    words = words_of(part, sums=sums)
    n_words = np.diff(words.bounds)
    row_of_word = np.repeat(np.arange(rows), n_words)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[part.ends[1:]] - total[part.ends[:-1]]

    def per_word_row(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row_of_word[flags], minlength=rows)

    point = _POINT[part.data]
    points = np.concatenate(([0], np.cumsum(point)))

    # Words in windows that occur twice or more in the text.
    windows = window_hashes(words.hashes, WINDOW)
    inside = row_of_word[: len(windows)] == row_of_word[WINDOW - 1:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice, _ = _repeats(row_of_word[at], windows[at])
    steps = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + WINDOW, -1)
    covered = np.cumsum(steps[:-1]) > 0

    # Lines with a word, compared byte by byte (their hash) with earlier lines of the text.
    cut = np.flatnonzero(part.data == 0x0A)
    starts = np.union1d(part.ends[:-1], cut + 1)
    starts = starts[starts < len(part.data)]
    row_of_line = np.searchsorted(part.ends, starts, "right") - 1
    ends = np.minimum(np.append(cut, len(part.data))[np.searchsorted(cut, starts)], part.ends[row_of_line + 1])
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row_of_line = starts[has_word], ends[has_word], row_of_line[has_word]
    _, dup = _repeats(row_of_line, stretch_hashes(sums, starts, ends))

    _, seen = _repeats(row_of_word, words.hashes)
    return {
        "n_words": n_words,
        "word_chars": per_row(point & ~SPACE[part.data]),
        "n_symbols": per_row(_SYMBOL[part.data]),
        "n_dup_lines": np.bincount(row_of_line[dup], minlength=rows),
        "n_repeat_words": per_word_row(covered),
        "n_lines": np.bincount(row_of_line, minlength=rows),
        "n_distinct_words": per_word_row(~seen),
        "n_stops": per_row(_STOP[part.data]),
        "n_upper": per_row(_UPPER[part.data]),
        "n_digits": per_row(_DIGIT[part.data]),
        "n_long_words": per_word_row(points[words.ends] - points[words.starts] > 30),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the ``COUNTS`` of ``text`` in place of it (long columns)."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, *[T.StructField(n, T.LongType()) for n in COUNTS]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [text_counts(p) for p in slices(batch.column(at))]
                added = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
                rest = [batch.column(f.name) for f in others]
                yield pa.RecordBatch.from_arrays([*rest, *added], [*[f.name for f in others], *COUNTS])

    return docs.mapInArrow(work, schema)


def base_failed(c=F.col) -> Column:
    return (c("n_words") < MIN_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * MAX_REPEAT_PERCENT)


def _vote(good: Column, bad: Column) -> Column:
    """Good, bad, or abstain where neither holds (or a division by zero words made it null)."""
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules(c=F.col) -> dict[str, Column]:
    """The rules as votes over the counts of a text. Shares are compared by multiplying out."""
    w = c("n_words")
    some = w >= 10
    return {
        "length": _vote(w >= 50, w < MIN_WORDS),
        "word_length": _vote(
            some & (c("word_chars") >= 3 * w) & (c("word_chars") <= 9 * w),
            some & ((c("word_chars") < 2 * w) | (c("word_chars") > 12 * w))),
        "symbol_words": _vote(some & (c("n_symbols") * 100 <= w), c("n_symbols") * 10 > w),
        "symbol_chars": _vote(some & (c("n_symbols") * 500 <= c("word_chars")), c("n_symbols") * 40 > c("word_chars")),
        "repeated_lines": _vote(
            (c("n_lines") >= 4) & (c("n_dup_lines") == 0), c("n_dup_lines") * 10 > c("n_lines") * 3),
        "repeated_words": _vote(
            (w >= 50) & (c("n_repeat_words") * 100 <= w * 5), c("n_repeat_words") * 100 > w * MAX_REPEAT_PERCENT),
        "vocabulary": _vote(
            (w >= 50) & (w <= 1000) & (c("n_distinct_words") * 100 >= w * 35),
            (w >= 20) & (w <= 1000) & (c("n_distinct_words") * 100 < w * 20)),
        "sentences": _vote(some & (c("n_stops") * 60 >= w) & (c("n_stops") * 2 <= w), (w >= 60) & (c("n_stops") * 200 < w)),
        "case": _vote(
            some & (c("n_upper") * 5 <= c("word_chars")) & (c("n_upper") > 0), c("n_upper") * 2 > c("word_chars")),
        "digits": _vote(some & (c("n_digits") * 20 <= c("word_chars")), c("n_digits") * 4 > c("word_chars")),
        "long_words": _vote(some & (c("n_long_words") == 0), c("n_long_words") * 20 > w),
    }


RULES = (
    "length", "word_length", "symbol_words", "symbol_chars", "repeated_lines", "repeated_words", "vocabulary", "sentences",
    "case", "digits", "long_words",
)


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = 500, share: float = 0.85, prior_docs: float = PRIOR_DOCS) -> np.ndarray:
    """Posterior probability of being good for each pattern of votes (rows of -1, 0, 1).

    A hidden class per document, and per class and rule the probability that a vote cast is "bad";
    abstaining says nothing. Expectation-maximisation over the weighted patterns estimates both and the
    share of good documents (``share`` is the first guess). The rules are written to blame seldom and
    for different faults, so the prior is that one in 250 good and one in 4 bad documents is blamed by a
    rule that votes; it fixes which class is the good one. It weighs as much as ``prior_docs`` documents, so the
    votes of a corpus outweigh it."""
    if not len(votes):
        return np.zeros(0)
    blame, praise = (votes == 0).astype(float), (votes == 1).astype(float)
    total = weight.sum()
    prior = np.array([[0.25], [0.004]])  # bad, good
    rate = np.repeat(prior, votes.shape[1], axis=1)
    good = np.full(len(votes), share)
    for _ in range(rounds):
        log = blame @ np.log(rate).T + praise @ np.log(1 - rate).T + np.log([1 - share, share])
        good, before = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700))), good
        if np.abs(good - before).max() < 1e-9:
            break
        belief = np.stack([1 - good, good]) * weight
        rate = (belief @ blame + prior_docs * prior) / (belief @ (blame + praise) + prior_docs)
        share = float((belief[1].sum() + 0.85 * prior_docs) / (total + prior_docs))
    return good


def posteriors(patterns: DataFrame) -> DataFrame:
    """Table of vote patterns (``pattern``) and their posterior (``posterior``), fitted on all rows.

    At most ``3 ** len(RULES)`` (177,147) patterns reach the driver, with their counts."""
    counted = patterns.groupBy("pattern").count().collect()
    counted.sort(key=lambda r: r["pattern"])
    votes = np.array([[int(v) - 1 for v in r["pattern"]] for r in counted]).reshape(-1, len(RULES))
    good = fit(votes, np.array([r["count"] for r in counted], float))
    rows = [(r["pattern"], float(round(g, 9))) for r, g in zip(counted, good)]
    return patterns.sparkSession.createDataFrame(rows, "pattern string, posterior double")


def pattern(c=F.col) -> Column:
    """The votes of all rules as a string of one character each (0 abstain, 1 bad, 2 good)."""
    votes = rules(c)
    return F.concat(*[(votes[r] + 1).cast("string") for r in RULES])


def judge(docs: DataFrame, text: str = "text", min_posterior: float = 0.5, label: str = "quality") -> DataFrame:
    """Per row ``doc_id``, the counts of its text, ``base_failed``, ``posterior`` and ``kept``.

    The counts are taken in one pass and kept as a narrow table; all else runs on that."""
    counts = staged(measured(docs.select("doc_id", text), text).withColumn("pattern", pattern()), label)
    model = posteriors(counts.select("pattern"))
    judged = counts.join(F.broadcast(model), "pattern")  # at most 3 ** len(RULES) rows
    failed = base_failed()
    return judged.select(
        *counts.columns, failed.alias("base_failed"), "posterior",
        (~failed & (F.col("posterior") >= min_posterior)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", min_posterior: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. The texts are read twice and not shuffled."""
    model = posteriors(staged(measured(docs.select(text)).select(pattern().alias("pattern")), "votes"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    passed = measured(whole).where(~base_failed()).withColumn("pattern", pattern())
    passed = passed.join(F.broadcast(model), "pattern").where(F.col("posterior") >= min_posterior)
    return passed.select("row.*")
