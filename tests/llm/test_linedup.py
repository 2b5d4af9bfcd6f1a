import random

import pytest
from pyspark.sql import functions as F

from rowtide.llm import linedup
from .conftest import prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_rule(texts, edits, min_chars):
    seen, gone = [], set()
    for i in sorted(texts):
        for k, raw in enumerate((texts[i] or "").split("\n")):
            line = raw.strip(" ").lower()
            if len(line) < min_chars:
                continue
            if any(abs(len(o) - len(line)) <= edits and (o == line or distance(o, line) <= edits) for o in seen):
                gone.add((i, k))
            seen.append(line)
    return gone


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_bounded_distance(spark, edits):
    r, rows = random.Random(edits), []
    for _ in range(600):
        a = [r.choice("abc") for _ in range(r.randrange(edits + 1, 22))]
        b = list(a)
        for _ in range(r.randrange(edits + 3)):
            at = r.randrange(len(b))
            b[at: at + r.randrange(2)] = r.choice(["", "a", "b", "c"])
            if len(b) <= edits:
                b += "cab" * 2
        rows.append(("".join(a), "".join(b)))
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", linedup.within("a", "b", edits).alias("near"))
    assert all(r["near"] == (distance(r["a"], r["b"]) <= edits) for r in found.collect())


@pytest.fixture(scope="module")
def lines():
    r, texts = random.Random(8), {}
    pool = [prose(i, 9, 50)[:60] for i in range(25)]
    for i in range(40):
        picked = []
        for _ in range(r.randrange(6)):
            line = list(r.choice(pool))
            for _ in range(r.randrange(4)):
                at = r.randrange(len(line))
                line[at: at + r.randrange(2)] = r.choice(["", "q", "Ä", "zz"])
            picked.append("".join(line))
        texts[i] = "\n".join(picked)
    texts |= {50: None, 51: "", 52: "short\nshort", 53: "  " + pool[0] + "  \n" + pool[0].upper(), 54: "w" * 5000, 55: "w" * 4999 + "v\n\n"}
    texts |= {60 + i: f"template line with a running number in it, item {i:05d} of many" for i in range(30)}
    return texts


@pytest.mark.parametrize("edits", [1, 2])
def test_equals_brute_force(make, lines, edits):
    found = linedup.marked(make(lines, repeat=(3, 50)), edits=edits, min_chars=20).where("doc_id IS NOT NULL").collect()
    assert {(r["doc_id"], k) for r in found for k in r["removed"]} == by_rule(lines, edits, 20)
    assert {r["doc_id"]: r["n_lines"] for r in found} == {
        i: 0 if t is None else t.count("\n") + 1 for i, t in lines.items()}
    assert len(found) == len(lines) + 2


def test_lines_are_taken_out(docs, corpus):
    kept = {r["doc_id"]: r for r in linedup.keep_lines(docs).where("doc_id IS NOT NULL").collect()}
    gone = by_rule({i: t for i, t in corpus.items() if i not in (37, 38)}, 1, 40)
    for i, text in corpus.items():
        if i in (37, 38):
            continue
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if any(d == i for d, _ in gone) and not left.strip(" "):
            assert i not in kept
        else:
            assert kept[i]["text"] == left and kept[i]["kept"] == "x" and kept[i]["a.b"] == 1
    assert 25 not in kept and kept[20]["text"] is None and kept[21]["text"] == ""


def test_empty(empty):
    assert linedup.marked(empty).count() == 0 and linedup.keep_lines(empty).columns == empty.columns


def test_changed_words_by_length(make):
    """Lines of all classes with up to a dozen edits, spread or in one word, against every earlier line."""
    r, texts = random.Random(4), {}
    pool = [prose(200 + i, 200, 200)[: r.randrange(38, 340)] for i in range(40)] + ["ab" * 60, "ab" * 125]
    for i in range(90):
        line = list(r.choice(pool))
        most, at = r.randrange(13), r.randrange(len(line))
        for _ in range(most):
            at = r.randrange(len(line)) if i % 2 else min(at + 1, len(line) - 1)
            line[at: at + r.randrange(2)] = r.choice(["", "q", "Ä", "z"])
        texts[i] = "".join(line)
    texts |= {200: prose(300, 200, 200)[:340], 201: prose(300, 200, 200)[:340].replace(" ", " another ", 1)}
    kept, gone = [], set()
    for i in sorted(texts):
        line = texts[i].strip(" ").lower()
        if len(line) >= 40:
            if any(abs(len(o) - len(line)) <= 10 and distance(o, line) <= min(10, min(len(o), len(line)) // 20) for o in kept):
                gone.add((i, 0))
            kept.append(line)
    found = linedup.marked(make(texts, repeat=()), linedup.BY_LENGTH).where("doc_id IS NOT NULL").collect()
    assert {(r["doc_id"], k) for r in found for k in r["removed"]} == gone
    assert (201, 0) in gone and len(gone) > len(by_rule(texts, 1, 40)) + 10


def test_pairs_of_a_template_are_not_written(make, monkeypatch):
    """Lines of one template, each with words of its own order, which has the same letters; a few near each other but
    not near the first."""
    r, words, texts = random.Random(11), prose(400, 200, 200)[:230].split(" "), {}
    for i in range(40):
        line, some = list(words), r.sample(range(len(words) // 2, len(words) - 4), 6)
        for at, word in zip(some, r.sample([words[k] for k in some], 6)):
            line[at] = word
        texts[i] = " ".join(line)
    texts |= {100 + i: texts[i * 7].replace("e", "q", 3) for i in range(1, 6)}
    pairs, confirmed = [], linedup._confirmed

    def counted(found, distinct, edits, label):
        pairs.append((label, found.count()))
        return confirmed(found, distinct, edits, label)

    monkeypatch.setattr(linedup, "_confirmed", counted)
    monkeypatch.setattr(linedup, "CROWD", 8, raising=False)
    monkeypatch.setattr(linedup, "CROWD_PIECE", 16, raising=False)
    found = linedup.marked(make(texts, repeat=()), linedup.BY_LENGTH).where("doc_id IS NOT NULL").collect()
    near = lambda a, b: abs(len(a) - len(b)) <= 10 and distance(a, b) <= min(10, min(len(a), len(b)) // 20)
    line = {i: t.strip(" ").lower() for i, t in texts.items()}
    gone = {(i, 0) for i in line if any(near(line[j], line[i]) for j in line if j < i)}
    assert {(r["doc_id"], k) for r in found for k in r["removed"]} == gone
    assert {(100 + i, 0) for i in range(1, 6)} <= gone and len(gone) < 30
    assert dict(pairs)["more"] <= 4 * len(texts)


def test_production_finds_a_changed_word(spark, tmp_path):
    import corpus_pipeline
    from rowtide.llm.queries import QUERIES

    line = prose(300, 200, 200)[:340]
    docs = spark.createDataFrame([(1, line), (2, line.replace(" ", " another ", 1) + "\nother")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["removed"] for r in found} == {1: [], 2: [0]}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1: line, 2: "other"}


def test_classes_have_the_edits_of_their_lines():
    """Under the most edits, all lines of a class may have its number; a class is wider than the edits of the one below."""
    for least in range(linedup.CHARS_AN_EDIT, 230):
        every = linedup.classes(linedup.BY_LENGTH, least)
        for (low, e, w), (high, _, _) in zip(every, every[1:]):
            assert e == min((high - 1) // 20, 10) and w * (e + 1) <= low and high - low > e
            assert high > 200 or low == least or e == low // 20


@pytest.mark.parametrize("least", [27, 59])
def test_lines_on_both_sides_of_a_class(make, least):
    """Lines a few characters longer and shorter than where a class begins, with as many edits as they may have, and one more."""
    r, texts = random.Random(least), {}
    for i, size in enumerate([40, 60, 80, 120, 160, 200, 226, 254] * 2):
        line = prose(500 + i, 200, 200)[: size - 2 + r.randrange(4)].strip(" ").ljust(size - 2, "z")
        texts[10 * i] = line
        for k in range(1, 9):
            other = list(line)
            for _ in range(min(len(line) // 20, 10) + r.randrange(-1, 2)):
                at = r.randrange(len(other))
                other[at: at + r.randrange(2)] = r.choice(["", "q", "zz"])
            texts[10 * i + k] = "".join(other).strip(" ")
    kept, gone = [], set()
    for i in sorted(texts):
        if len(line := texts[i].lower()) >= least:
            if any(abs(len(o) - len(line)) <= 10 and distance(o, line) <= min(10, min(len(o), len(line)) // 20) for o in kept):
                gone.add((i, 0))
            kept.append(line)
    found = linedup.marked(make(texts, repeat=()), linedup.BY_LENGTH, least).where("doc_id IS NOT NULL").collect()
    assert {(r["doc_id"], k) for r in found for k in r["removed"]} == gone and len(gone) > 25
