import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from rowtide.llm import manifest, sha256


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        if c == "text" and lower and v is not None:
            v = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def climb(nodes):
    """The last node, and for each of the given ones its runs on the way there: (place, run)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            paths[i].append((p % 16, nodes[p // 16 * 16: p // 16 * 16 + 16]))
        places = [p // 16 for p in places]
        nodes = [h("".join(nodes[k: k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def by_rule(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    made = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[name] = ordered, *climb([leaf(r) for r in ordered])
    root, tops = climb([made[s][1] for s in names])
    out = []
    for name, top in zip(names, tops):
        ordered, subroot, paths = made[name]
        for r, path in zip(ordered, paths):
            path = path + top
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            end = leaf(r, lower=hit)
            for place, run in path:
                end = h("".join(run[:place] + [end] + run[place + 1:]))
            proof = h("".join(d for place, run in path for i, d in enumerate(run) if i != place))
            out.append((r["doc_id"], leaf(r), subroot, root, proof, end, end == root))
    return sorted(out, key=str)


def check(docs):
    found = sorted((tuple(r) for r in manifest.verified(docs).collect()), key=str)
    assert found == by_rule(docs.collect())
    return found


def test_states_resume():
    assert sha256.START.tolist() == [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(16)]
    rows = np.stack([np.frombuffer(d, np.uint8) for d in digests])
    for n in (1, 2, 15, 16):
        kids = np.zeros((1, 16, 32), np.uint8)
        kids[0, :n] = rows[:n]
        digest, states = manifest.seal(kids, np.array([n]))
        assert digest[0].tobytes().hex() == h("".join(d.hex() for d in digests[:n]))
        for slot in range(n):
            new = hashlib.sha256(b"new%d" % slot).digest()
            end = manifest.fold(states[:, slot], np.frombuffer(new, np.uint8)[None], np.array([slot]), kids, np.array([n]))
            assert end[0].tobytes().hex() == h("".join(d.hex() for d in [*digests[:slot], new, *digests[slot + 1: n]]))


def test_equals_brute_force(docs):
    check(docs)


def test_sizes_of_groups(spark):
    """Groups around the powers of the width, many groups, null and empty names, equal and missing ids."""
    sizes = [1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 300] + [1] * 30
    rows = [(None if i % 41 == 0 else 1000 * g + i, None if g == 0 else "" if g == 1 else f"é{g}", None if i % 3 else "en", i if i % 2 else None,
             None if i % 7 == 0 else f"Text {i}é") for g, size in enumerate(sizes) for i in range(size)]
    frame = spark.createDataFrame(rows + rows[40:45], "doc_id long, source string, lang string, n_chars long, text string")
    check(frame.withColumn("key", F.lit(1)).withColumn("index", F.lit("x")).withColumn("path", F.lit(2)).repartition(5))


def test_hot_group_one_row_and_empty(spark, empty):
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                   F.lit(3).alias("n_chars"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("text"))
    found = check(hot)
    assert any(r[-1] for r in found) and not all(r[-1] for r in found)
    check(hot.where("doc_id = 10"))
    assert manifest.verified(empty).count() == 0
