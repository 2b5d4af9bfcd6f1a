"""Document fingerprints: a Merkle tree over sections and paragraphs.

A paragraph is a line with its line feed, a section a run of paragraphs up to and including a blank one. The
leaves cut a paragraph at the ends of sentences (long ones every ``LEAF`` characters), so that the leaves put
together are the text. A leaf's digest is that of its bytes, a paragraph's that of its leaves' digests, and so
on up to the root: equal roots mean equal texts, and where two roots differ, descending into the branches
that differ finds the edits (``differing``) and what is still alike (``likeness``).

The descent pairs equal branches that stand in the same order on both sides: sections as a whole, in the
stretches between them paragraphs, and between those leaves. Begin and end are paired first; in between, the k-th of
several equal branches is paired with the k-th of the other side, and of these pairs the longest run that
ascends on both sides counts, which takes n log n steps for a text of any length.

A fingerprint is the root, a colon, and the shortened digests of all leaves: ``/`` parts sections, ``.``
paragraphs. Its length is about an eighth of the text's.

Defined results: a null text is an empty one; its tree has no branches. Null ids come after all others in
the order of ``compare_with_next``, equal ids in the order of a hash of their texts (rows equal in both are
interchangeable); extra columns are left out; an empty table gives an empty table. A text of any length is one
row's work, and its fingerprint and its branches grow with it.
"""

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from rowtide.llm.stage import bounded_batches, staged

LEAF = 160
_LEAVES = re.compile(r"[^.!?\n]{1,%d}[.!?]*[ \t]*\n?|[.!?]+[ \t]*\n?|\n" % LEAF)
_SHORT = 4  # bytes of a leaf's digest that a fingerprint keeps

_ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, edited_branches array<struct<section:int,paragraph:int>>")


def _digest(kind: bytes, parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=kind).digest()


def fingerprint(text: str | None) -> str:
    sections, paragraphs, leaves = [], [], []  # digests of finished branches
    shown, shown_paragraphs, shown_sections = [], [], []
    blank = True
    blake = hashlib.blake2b

    def close_section():
        sections.append(_digest(b"section", paragraphs))
        shown_sections.append(".".join(shown_paragraphs))
        paragraphs.clear()
        shown_paragraphs.clear()

    def close_paragraph():
        paragraphs.append(_digest(b"paragraph", leaves))
        shown_paragraphs.append("".join(shown))
        leaves.clear()
        shown.clear()

    for leaf in _LEAVES.findall(text or ""):
        d = blake(leaf.encode(), digest_size=16, person=b"leaf").digest()
        leaves.append(d)
        shown.append(d[:_SHORT].hex())
        blank = blank and leaf.isspace()
        if leaf[-1] == "\n":
            close_paragraph()
            if blank:
                close_section()
            blank = True
    if leaves:
        close_paragraph()
    if paragraphs:
        close_section()
    return f"{_digest(b'root', sections).hex()}:{'/'.join(shown_sections)}"


def branches(mark: str) -> tuple[str, list[str]]:
    """Root and sections; a section is the leaf digests of its paragraphs, parted by dots."""
    root, _, body = mark.partition(":")
    return root, body.split("/") if body else []


def _leaves_of(paragraphs: list[str]) -> list[str]:
    joined, size = "".join(paragraphs), 2 * _SHORT
    return [joined[i: i + size] for i in range(0, len(joined), size)]


def _n_leaves(sections: list[str]) -> int:
    return sum(len(s) - s.count(".") for s in sections) // (2 * _SHORT)


def _in_order(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal items of two lists, ascending on both sides."""
    low, high, tail = 0, min(len(a), len(b)), 0
    while low < high and a[low] == b[low]:
        low += 1
    while tail < high - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places = {}
    for i in range(len(a) - tail - 1, low - 1, -1):
        places.setdefault(a[i], []).append(i)
    ends, runs = [], []  # per length the run that ends earliest: its end, and its last pair with the one before
    for j in range(low, len(b) - tail):
        if places.get(b[j]):
            i = places[b[j]].pop()
            k = bisect_left(ends, i)
            ends[k: k + 1] = [i]
            runs[k: k + 1] = [(i, j, runs[k - 1] if k else None)]
    between, last = [], runs[-1] if runs else None
    while last:
        between.append(last[:2])
        last = last[2]
    return [(k, k) for k in range(low)] + between[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _gaps(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """The stretches of two lists of ``n`` and ``m`` items that lie between paired places."""
    i = j = 0
    for x, y in [*pairs, (n, m)]:
        if x > i or y > j:
            yield slice(i, x), slice(j, y)
        i, j = x + 1, y + 1


def descend(left: str, right: str) -> tuple[int, list[tuple[int, int]]]:
    """How many leaves two fingerprints share in order, and the section and paragraph numbers of ``right`` that
    ``left`` does not have there. Equal roots end the search at once, equal sections and paragraphs are not entered."""
    (root, old), (other, new) = branches(left), branches(right)
    if root == other:
        return _n_leaves(old), []
    pairs, changed = _in_order(old, new), []
    common = _n_leaves([new[j] for _, j in pairs])
    for before, after in _gaps(pairs, len(old), len(new)):
        was = [p for s in old[before] for p in s.split(".")]
        places = [(i, j, p) for i, s in enumerate(new[after], after.start) for j, p in enumerate(s.split("."))]
        now = [p for *_, p in places]
        pairs_in = _in_order(was, now)
        common += _n_leaves([now[j] for _, j in pairs_in])
        for gone, come in _gaps(pairs_in, len(was), len(now)):
            changed += [place[:2] for place in places[come]]
            common += len(_in_order(_leaves_of(was[gone]), _leaves_of(now[come])))
    return common, changed


def _share(common: int, left: str, right: str) -> float:
    n = _n_leaves(branches(left)[1]) + _n_leaves(branches(right)[1])
    return 2 * common / n if n else 1.0


def likeness(left: str, right: str) -> float:
    """Share of the leaves of two fingerprints that their trees have in common, in order, 0 to 1: twice the common ones
    by the leaves of both."""
    return _share(descend(left, right)[0], left, right)


def differing(left: str, right: str) -> list[tuple[int, int]]:
    """Section and paragraph numbers of ``right`` that ``left`` does not have."""
    return descend(left, right)[1]


def fingerprints(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Per row ``doc_id`` and its ``fingerprint``; the root alone is the part before the colon."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fingerprint string")


def _compared(text: str, mark: str, after: str, after_mark: str) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    edited_mark = fingerprint(edited)
    common, changed = descend(mark, edited_mark)
    return {
        "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": mark,
        "edited_fingerprint": edited_mark, "near_edited": _share(common, mark, edited_mark), "near_next": likeness(mark, after_mark),
        "edited_branches": [{"section": i, "paragraph": j} for i, j in changed],
    }


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, and of it with its second half (``n_chars // 2`` code points) replaced by
    the beginning of the next text in descending doc_id; the first follows the last. With the likeness of
    the text's fingerprint to the edited one's and to the next text's, and the branches (section and paragraph
    number) of the edited text that the text does not have.

    One range shuffle puts the texts in order. Where a partition ends, its last row is finished with the
    first of the next one: two rows per partition that are written aside and joined."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [c.split()[0] for c in _ROW.split(", ")]
    places = pa.list_(pa.struct([("section", pa.int32()), ("paragraph", pa.int32())]))
    shape = pa.schema([*zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), places])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, out = None, []

        def flush():
            found = pa.RecordBatch.from_pylist(out, pa.schema([*wide]))
            out.clear()
            return found

        wide = [pa.field("part", pa.int64()), pa.field("kind", pa.string()), *shape, pa.field("text", pa.string())]
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1)):
                now = (id_.as_py(), text.as_py())
                now = (*now, fingerprint(now[1]))
                if before is None:
                    out.append({"part": part, "kind": "head", "doc_id": now[0], "text": now[1], "fingerprint": now[2]})
                else:
                    out.append({"part": part, "kind": "row", "doc_id": before[0], **_compared(*before[1:], *now[1:])})
                before = now
                if len(out) >= 500:
                    yield flush()
        if before is not None:
            out.append({"part": part, "kind": "tail", "doc_id": before[0], "text": before[1], "fingerprint": before[2]})
        if out:
            yield flush()

    done = staged(ordered.mapInArrow(work, f"part long, kind string, {_ROW}, text string"), "compared")
    ends = done.where("kind <> 'row'").select("part", "kind", "doc_id", "text", "fingerprint")
    parts = ends.where("kind = 'head'").select("part")  # one number per partition
    around = parts.select("part", F.coalesce(
        F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next"))
    heads = ends.where("kind = 'head'").select(
        F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    seams = ends.where("kind = 'tail'").join(around, "part").join(heads, "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                found = [
                    {"doc_id": r["doc_id"], **_compared(r["text"], r["fingerprint"], r["next_text"], r["next_mark"])}
                    for r in batch.slice(low, 64).to_pylist()
                ]
                yield pa.RecordBatch.from_pylist(found, shape)

    last = seams.select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInArrow(finish, _ROW)
    return done.where("kind = 'row'").select(*names).union(last)
