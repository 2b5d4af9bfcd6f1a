import re
from collections import defaultdict

from rowtide.llm import lines


def spans_by_rule(texts, min_words=8):
    """Line and sentence occurrences in rank order; all but the first of each normalised form go."""
    seen, gone = {}, defaultdict(list)
    for i in sorted(texts):
        here = []
        at = 0
        for line in (texts[i] or "").split("\n"):
            here.append((at, at + len(line), line, 0))
            sentence = [m for m in re.finditer(r"\S.*?(?:[.!?]+(?=\s|$)|(?=\s*$))", line)]
            here += [(at + m.start(), at + m.end(), m.group(), 1) for m in sentence if len(m.group()) < len(line.strip())
                     and len(line.split()) >= min_words]
            at += len(line) + 1
        for start, stop, unit, _ in sorted(here, key=lambda u: (u[3], u[0])):
            words = unit.split()
            if len(words) < min_words:
                continue
            name = " ".join(words).lower()
            if name in seen:
                gone[i].append((start, stop))
            else:
                seen[name] = i
    return gone


def test_equals_brute_force(docs, corpus):
    found = {r["doc_id"]: r for r in lines.without_repeats(docs).collect() if r["doc_id"] is not None}
    expected = spans_by_rule(corpus)
    assert len(found) == len(corpus)
    for i, text in corpus.items():
        left, merged = lines.cut(text or "", expected[i])
        assert (found[i]["text"], [tuple(s) for s in found[i]["spans"]]) == (left, merged), i
        assert found[i]["n_chars"] - found[i]["n_removed"] == len(left)
    assert "same line" not in found[33]["text"] or found[33]["n_removed"] == 0
    assert found[25]["text"].strip() == "" and found[26]["n_removed"] == len(corpus[26])


def test_offsets_point_into_the_original(docs, corpus):
    for r in lines.without_repeats(docs).where("doc_id IS NOT NULL").collect():
        text = corpus[r["doc_id"]] or ""
        kept, at = [], 0
        for s in r["spans"]:
            kept.append(text[at: s["start"]])
            at = s["stop"]
        assert "".join([*kept, text[at:]]) == r["text"]


def test_repeated_rows_and_empty(docs, empty):
    rows = lines.without_repeats(docs).where("doc_id = 3").collect()
    assert len(rows) == 2 and all(r["n_removed"] == 0 for r in rows)
    assert lines.without_repeats(empty).count() == 0
