import hashlib
import random
import re

from rowtide.llm import merkle
from .conftest import edited, prose


def test_compared_with_next(docs, corpus):
    rows = merkle.compare_with_next(docs).collect()
    assert len(rows) == docs.count()
    order = sorted(((r["doc_id"], r["doc_id"]) for r in docs.select("doc_id").collect() if r["doc_id"] is not None), reverse=True)
    order = [i for i, _ in order]
    texts = [corpus[i] or "" for i in order] + [prose(70, 90)]
    expected = []
    for k, (i, text) in enumerate(zip([*order, None], texts)):
        after, half = texts[(k + 1) % len(texts)], len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = map(merkle.fingerprint, (text, new, after))
        expected.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c),
                         [tuple(p) for p in merkle.differing(a, b)]))
    found = [tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
             + ([tuple(p) for p in r["edited_branches"]],) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_roots_tell_texts_apart():
    texts = ["", "a", "a\n", "\n", "\n\n", "a\n\nb", "a\nb", "a b", "a. b", "a.b", " a", "a ", "a\r\n", "a\n\n", prose(1, 300)]
    texts += [edited(prose(1, 300), i, 1) for i in range(20)]
    roots = {}
    for t in texts:
        assert "".join(merkle._LEAVES.findall(t)) == t
        roots.setdefault(merkle.fingerprint(t).partition(":")[0], set()).add(t)
    assert all(len(v) == 1 for v in roots.values()) and merkle.fingerprint(None) == merkle.fingerprint("")


def test_differing_branches_locate_edits():
    text = "\n\n".join(prose(i, 60, 12) for i in range(5))
    lines = text.split("\n")
    at = 3 * 6 + 2  # the third paragraph of the fourth section: five lines and a blank one each
    lines[at] = lines[at] + " changed"
    assert merkle.differing(merkle.fingerprint(text), merkle.fingerprint("\n".join(lines))) == [(3, 2)]
    assert merkle.differing(merkle.fingerprint(text), merkle.fingerprint(text)) == []


def test_likeness_follows_the_edit():
    text = prose(3, 2000)
    near = [merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(edited(text, 1, n))) for n in (0, 1, 20, 2000)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[1] > 0.95


def sentences(r, n):
    """A text as sections of paragraphs of sentences, none of which occurs twice."""
    number, text = iter(r.sample(range(10 ** 6), n)), []
    for k in number:
        text.append(f"sentence {k} ends here." + r.choice([" ", " ", "\n", "\n\n"]))
    return text


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_likeness_is_of_leaves_in_order():
    """Against the longest common subsequence of the sentences, written down without the module: equal where sentences
    are replaced, left out or added, never more where they are moved, and next to nothing in reverse order."""
    r = random.Random(6)
    for _ in range(60):
        one = sentences(r, r.randrange(1, 60))
        two = [s for s in one if r.random() > 0.15]
        for _ in range(r.randrange(6)):
            two.insert(r.randrange(len(two) + 1), f"new {r.randrange(10 ** 9)} one. ")
        a, b = merkle.fingerprint("".join(one)), merkle.fingerprint("".join(two))
        # A blank line is a leaf of its own.
        parts = lambda text: [p for s in text for p in re.findall(r"[^\n]+\n?|\n", s)]
        x, y = parts(one), parts(two)
        if len(set(x)) == len(x):
            assert merkle.likeness(a, b) == 2 * longest(x, y) / (len(x) + len(y))
        r.shuffle(two)
        x, y = parts(one), parts(two)
        moved = merkle.likeness(a, merkle.fingerprint("".join(two)))
        assert 0 <= moved <= 2 * longest(x, y) / (len(x) + len(y))
    lines = [f"line {k} of many.\n" for k in range(200)]
    back = merkle.fingerprint("".join(lines[::-1]))
    assert merkle.likeness(merkle.fingerprint("".join(lines)), back) == 1 / 200
    assert merkle.differing(merkle.fingerprint("".join(lines)), back) != []


def test_one_row_empty_and_plain(make, empty, docs, corpus):
    one = merkle.compare_with_next(make({5: "abcd"}, repeat=(), nameless=False)).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1.0
    assert merkle.compare_with_next(empty).count() == 0
    found = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(docs).collect()}
    assert found[25] == found[26] == found[3] and all(found[i] == merkle.fingerprint(t) for i, t in corpus.items())
