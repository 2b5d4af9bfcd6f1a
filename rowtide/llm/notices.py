"""License notices, also misspelt ones: exact seeds locate them, the regex library's bounded matching verifies them.

A text is brought to words of ASCII letters (lower-cased), digits and everything beyond ASCII, parted by single spaces.
A notice may differ by ``budget`` edits from its wording, one for ``PER_EDIT`` characters and ``MOST`` at most. Cut
into one piece more than that, at least one piece is unchanged in every occurrence (pigeonhole): an automaton over
all pieces of all notices finds them in one pass. Only the window around a piece is given to the regex
library, which finds the occurrence with the fewest edits in it, where it begins and ends, and how many edits it has.

Besides, phrases are found word by word and counted; their labels always stay.

Defined results: a null text is an empty one, which has no words, no places and empty labels; a very long text is
searched whole, its windows are short; of two overlapping occurrences of one notice that with fewer edits is reported,
then the earlier; repeated rows and rows without id have a row each; extra columns are left out; an empty table
gives an empty one.
"""

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtide.llm.stage import bounded_batches

#: Phrases that are counted, and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Wordings of short notices, in words as texts are brought to them, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("distributed under the boost software license version 1 0", "bsl"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

PER_EDIT = 15
MOST = 4  # time to verify a window triples with every edit

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_SPAN = "struct<label: string, first_word: long, words: long, start: long, end: long, edits: int>"
_ROW = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        f"score double, spans array<{_SPAN}>")


def budget(notice: str) -> int:
    return min(MOST, len(notice) // PER_EDIT)


def in_words(text: bytes) -> tuple[str, int]:
    """The text's words with a space before, between and after them, and how many there are."""
    words = text.translate(_WORD_BYTES).split()
    return f" {b' '.join(words).decode()} ", len(words)


class Search:
    """Finds occurrences of notices within their budgets in texts as ``in_words`` gives them."""

    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex

        self.notices, self.seeds = [], ahocorasick.Automaton()
        for number, (wording, label) in enumerate(notices):
            padded, edits = f" {wording} ", budget(wording)
            pattern = regex.compile(f"(?b)(?:{regex.escape(padded)}){{e<={edits}}}")
            self.notices.append((label, padded, edits, pattern))
            cuts = [len(padded) * i // (edits + 1) for i in range(edits + 2)]
            for low, high in itertools.pairwise(cuts):
                piece = padded[low:high]
                self.seeds.add_word(piece, [*self.seeds.get(piece, []), (number, low, len(piece))])
        if len(self.seeds):
            self.seeds.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Notice number and window, for all places where an unchanged piece would put a notice."""
        begins: dict[int, set[int]] = {}
        for end, found in self.seeds.iter(text) if len(self.seeds) else ():
            for number, offset, length in found:
                begins.setdefault(number, set()).add(end + 1 - length - offset)
        for number, places in begins.items():
            _, padded, edits, _ = self.notices[number]
            first = last = None
            for place in [*sorted(places), None]:
                if first is not None and (place is None or place - first > 2 * edits):
                    yield number, max(0, first - edits), last + len(padded) + 2 * edits
                    first = None
                first, last = (place if first is None else first), place

    def occurrences(self, text: str) -> list[tuple[int, int, int, str, float]]:
        """Sorted ``(start, end, edits, label, likeness)`` in ``text``; those of one notice do not overlap."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for number, low, high in self.windows(text):
            if match := self.notices[number][3].search(text, low, min(high, len(text))):
                found.setdefault(number, []).append((sum(match.fuzzy_counts), *match.span()))
        kept = []
        for number, spans in found.items():
            label, padded, _, _ = self.notices[number]
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(set(spans)):
                # Padding is shared by neighbours and does not count as overlap. What is taken does not overlap, so
                # only the nearest one on each side can.
                at = bisect.bisect(taken, (start, end))
                if all(end - 1 <= s + 1 or e - 1 <= start + 1 for s, e in taken[max(0, at - 1): at + 1]):
                    taken.insert(at, (start, end))
                    kept.append((start, end, edits, label, 1 - edits / len(padded)))
        return sorted(kept)


def phrase_places(text: str, phrases=PHRASES) -> list[tuple[int, str]]:
    """Sorted ``(start, label)`` of every place where a phrase's words stand; the start is that of the space before."""
    found = []
    for phrase, label in phrases:
        at = text.find(f" {phrase} ")
        while at >= 0:
            found.append((at, label))
            at = text.find(f" {phrase} ", at + 1)
    return sorted(found)


def _word_numbers(text: str, places: list[int]) -> dict[int, int]:
    """Number of the word that holds, or follows, each place of a text in words."""
    numbers, spaces, done = {}, 0, 0
    for place in sorted(set(places)):
        spaces += text.count(" ", done, place + 1)
        done = place + 1
        numbers[place] = spaces - 1
    return numbers


def _spans(text: str, occurrences, original: str) -> list[dict]:
    """Occurrences with word numbers, and code points of the original text."""
    edges = [(start + (text[start] == " "), end - 1 - (text[end - 1] == " ")) for start, end, *_ in occurrences]
    numbers = _word_numbers(text, [place for pair in edges for place in pair])
    wanted = {numbers[place] for pair in edges for place in pair}
    at = {i: m.span() for i, m in enumerate(_WORD.finditer(original)) if i in wanted} if wanted else {}
    return [
        {"label": label, "first_word": numbers[low], "words": numbers[high] - numbers[low] + 1,
         "start": at[numbers[low]][0], "end": at[numbers[high]][1], "edits": edits}
        for (low, high), (_, _, edits, label, _) in zip(edges, occurrences)
    ]


def scan(docs: DataFrame, notices=NOTICES, phrases=PHRASES, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Per row the words, the places of phrases, the labels of phrases and of both, a score and the notices' spans.

    The score is 1 where a phrase stands, else 1 less the share of edits in the best notice, 0 without any."""
    bounded_batches(docs.sparkSession)

    def row(id_: int | None, body: bytes, search: Search) -> dict:
        words, n = in_words(body)
        places, occurrences = phrase_places(words, phrases), search.occurrences(words)
        ends = _word_numbers(words, [places[0][0], places[-1][0]]) if places else {}
        base = {label for _, label in places}
        return {
            "doc_id": id_, "n_words": n, "n_base": len(places),
            "first_word": ends[places[0][0]] if places else None, "last_word": ends[places[-1][0]] if places else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {o[3] for o in occurrences})),
            "score": 1.0 if places else max((o[4] for o in occurrences), default=0.0),
            "spans": _spans(words, occurrences, body.decode()) if occurrences else [],
        }

    span = pa.struct([("label", pa.string()), *((c, pa.int64()) for c in ("first_word", "words", "start", "end")), ("edits", pa.int32())])
    shape = pa.schema([
        *((c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()),
        ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for batch in batches:
            rows = [row(key.as_py(), body.as_py(), search) for key, body in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_pylist(rows, shape)

    texts = docs.select(F.col(f"`{id_}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(work, _ROW)
