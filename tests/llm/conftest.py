import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ner", "pu", "sta", "vo", "zy") for b in ("an", "bel", "cor", "dim", "es", "fu")]
DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, `a.b` int, node int, `_row` int"


def prose(seed: int, words: int, per_line: int = 20) -> str:
    r = random.Random(seed)
    made = [r.choice(WORDS) + (r.choice(".!?") if r.random() < 0.1 else "") for _ in range(words)]
    return "\n".join(" ".join(made[i: i + per_line]) for i in range(0, words, per_line))


def edited(text: str, seed: int, changes: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(WORDS) + "x"
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """Texts with every awkward case: null, empty, blank, very long, copies, near copies, ties, repeated rows."""
    base = [prose(i, 40 + 13 * i) for i in range(12)]
    passage = prose(99, 70, 70)
    texts = dict(enumerate(base))
    texts |= {
        20: None, 21: "", 22: " \n\t \n", 23: "one two", 24: "One two", 25: base[3], 26: base[3],
        27: edited(base[9], 1, 1), 28: edited(base[9], 2, 1), 29: edited(base[9], 3, 20),
        30: base[4] + "\n" + passage, 31: passage + "\n" + base[5], 32: "###  ***\n" * 30, 33: "same line of words again\n" * 40,
        34: "a" * 400, 35: "ÄÖ ß İ ǅ é   nbsp x <|endoftext|>it's 12 <|startoftext|>", 36: prose(7, 200, 200) + "\r\n" + prose(8, 30),
        37: prose(50, 60_000), 38: "x" * 70_000 + " " + prose(51, 300), 39: base[11].upper(), 40: base[11] + ".",
    }
    return texts


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, repeat=(3, 20), nameless=True):
        rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "x", 1, 2, 3) for i, t in texts.items()]
        rows += [r for r in rows if r[0] in repeat]
        if nameless:
            rows += [(None, prose(70, 90), "en", "s1", 5, "x", 1, 2, 3)]
        return spark.createDataFrame(rows, DDL)

    return build


@pytest.fixture(scope="session")
def docs(make, corpus, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("documents") / "documents")
    make(corpus).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
