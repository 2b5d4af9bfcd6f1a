"""Near-duplicates by MinHash with tensored banding.

Each set of shingles gets two small collections, A and B, of ``tuples`` hash tuples of ``width`` minhashes.
A table key is a pair (A_i, B_j): ``tuples ** 2`` tables of keys of ``2 * width`` minhashes each, from
``2 * tuples * width`` minhashes instead of ``tuples ** 2 * 2 * width``. A pair of similarity s meets in
some table with probability ``(1 - (1 - s ** width) ** tuples) ** 2``: 0.9997 at s = 0.85 by default, more
above, and links of a group support one another.

1. Equal sets become one node (its smallest doc_id). Of the A and B tuples only those that some other node
   shares can make a key that is shared, so only their pairs are formed.
2. In each key every node is compared with a pivot. Alike ones are linked; for others near the pivot it is kept
   what they have that the pivot lacks. Nodes far from it meet a second pivot among themselves.
3. No link that a key shows is lost: nodes of one key that are still in different components are compared
   where what they have beyond the pivot says they may be alike (see ``_sharing``; d(x, z) <= d(x, y) + d(y, z)
   for the Jaccard distance says that near and far nodes cannot be), and pair by pair where two pivots were far
   from both. Pairs inside a component are never formed.

Candidates are confirmed on the full shingle sets. Defined results: null or empty texts, and texts
without words, have an empty set and are linked with nothing; rows of one doc_id count as one document of
the graph; rows without doc_id are not linked (``component_id`` null, kept); of a group the smallest doc_id stays,
so there are no ties; all shingles of a text count, at any length; extra columns are left out; an empty table
gives an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtide.llm.components import components
from rowtide.llm.stage import bounded_batches, staged
from rowtide.llm.words import U64, mix, shingle_sets, signed, slices

WORDS = 5
PERCENT = 85
TUPLES = 10
WIDTH = 3
ROUNDS = 2

_SIGNED = "doc_id long, n long, d1 long, d2 long, a array<long>, b array<long>"
# Orders of the nodes that give the pivots of the rounds: smallest, largest, then two scattered ones.
_ORDERS = (0, (1 << 63) - 1, 0x2AAAAAAAAAAAAAAA, 0x1C71C71C71C71C71)


def sketch(shingles: np.ndarray, tuples: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The A and B tuples of a set, each a 64-bit hash of its minhashes."""
    count = 2 * tuples * width
    odd = mix(np.arange(1, count + 1, dtype=U64)) | U64(1)
    least = np.empty(count, U64)
    for low in range(0, count, 20):  # bounds the product table of a very long text
        block = np.full(len(odd[low: low + 20]), U64((1 << 64) - 1))
        for at in range(0, len(shingles), 65_536):
            part = shingles[at: at + 65_536]
            np.minimum(block, (part[None, :] * odd[low: low + 20, None]).min(axis=1), out=block)
        least[low: low + 20] = block
    grouped = mix(least).reshape(2 * tuples, width)
    keys = np.zeros(2 * tuples, U64)
    for i in range(width):
        keys = mix(keys * U64(31) + grouped[:, i])
    return signed(keys[:tuples]), signed(keys[tuples:])


def sketches(docs: DataFrame, words: int = WORDS, tuples: int = TUPLES, width: int = WIDTH) -> DataFrame:
    """Per row ``doc_id``, set size ``n``, a 128-bit digest of the set, and the tuples of both collections."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part in slices(batch.column(1)):
                n, digests, a, b = [], [], [], []
                for shingles in shingle_sets(part, words):
                    n.append(len(shingles))
                    digests.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64))
                    left, right = sketch(shingles, tuples, width) if len(shingles) else (None, None)
                    a.append(left)
                    b.append(right)
                ids = batch.column(0).slice(part.first, part.last - part.first)
                d = np.stack(digests)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(a, longs), pa.array(b, longs)],
                    ["doc_id", "n", "d1", "d2", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, _SIGNED)


def table_keys(nodes: DataFrame) -> DataFrame:
    """``key, node, n`` for every table key that two nodes may share."""

    def shared(side: str) -> DataFrame:
        carried = ["node", "n"] if side == "a" else ["node"]
        each = nodes.select(*carried, F.posexplode(side).alias(f"i{side}", f"v{side}"))
        often = each.groupBy(f"i{side}", f"v{side}").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        return each.join(often, [f"i{side}", f"v{side}"])

    key = F.xxhash64("ia", "va", "ib", "vb")
    return shared("a").join(shared("b"), "node").select(key.alias("key"), "node", "n")


def measured(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs ``u, v`` with ``alike``, whether their full shingle sets are ``percent`` alike, the numbers of
    shingles only in ``v`` (``lost``) and only in ``u`` (``gained``), and these last as ``extra`` where at least
    half of all are common. Both sets are made from the texts."""
    bounded_batches(pairs.sparkSession)
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("ut"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("vt"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                rows = batch.slice(low, 512)
                us = (s for part in slices(rows.column(2)) for s in shingle_sets(part, words))
                vs = (s for part in slices(rows.column(3)) for s in shingle_sets(part, words))
                alike, lost, gained, extra = [], [], [], []
                for x, y in zip(us, vs):
                    only = np.setdiff1d(x, y, assume_unique=True)
                    both = len(x) - len(only)
                    either = len(y) + len(only)
                    alike.append(100 * both >= percent * either)
                    lost.append(len(y) - both)
                    gained.append(len(only))
                    extra.append(signed(only) if 2 * both >= either else None)
                columns = [pa.array(alike, pa.bool_()), pa.array(lost, pa.int64()), pa.array(gained, pa.int64()),
                           pa.array(extra, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), *columns], ["u", "v", "alike", "lost", "gained", "extra"])

    met = pairs.join(left, "u").join(right, "v").select("u", "v", "ut", "vt")
    return met.mapInArrow(work, "u long, v long, alike boolean, lost long, gained long, extra array<long>")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The keys that hold nodes of more than one component."""
    return rows.groupBy(key).agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select(key)


def _sharing(near: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of different components that were both near one pivot and can be alike.

    With c any set, let G be what a node has and c lacks, L what c has and the node lacks. Two nodes without a
    common element in G differ in ``|G| + |G'| + abs(|L| - |L'|)`` shingles at least (where c is made of two
    sets, in both of these differences of L), and alike ones differ in
    ``(100 - percent) / (100 + percent)`` of the sum of their sizes at most. So a pair is met through a common
    element of G, or where these counts allow it to do without. For c the pivot is taken together with what
    a third of its group have beyond it: then only what a few nodes share, which chance edits seldom give, is
    left in G, also where the pivot itself stands at the edge of its group."""
    known = _labelled(near, labels)
    known = staged(known.join(_several(known, "pivot"), "pivot"), "near")
    each = known.select("pivot", "node", "label", "n", F.explode("extra").alias("e"))
    often = each.groupBy("pivot", "e").agg(
        F.count(F.lit(1)).alias("f"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    group = known.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"))
    often = staged(often.join(group, "pivot").withColumn("central", F.col("f") * 3 > F.col("m")), "elements")
    center = often.where("central").groupBy("pivot").agg(F.count(F.lit(1)).alias("c"))
    has = each.join(often.where("central").select("pivot", "e"), ["pivot", "e"]).groupBy("pivot", "node").agg(
        F.count(F.lit(1)).alias("o"))
    side = known.drop("extra").join(center, "pivot", "left").join(has, ["pivot", "node"], "left").fillna(0, ["c", "o"])
    side = staged(side.select(
        "pivot", "node", "label", "n", "lost", (F.col("c") - F.col("o")).alias("less"),
        (F.col("gained") - F.col("o")).alias("gained")), "counts")
    other = side.select("pivot", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "lost", "less", "gained")])
    apart = F.col("gained") + F.col("gained2") + F.abs(F.col("lost") - F.col("lost2")) + F.abs(F.col("less") - F.col("less2"))
    apart = apart * (100 + percent)
    counted = side.join(other, (side["pivot"] == other["pivot"]) & (F.col("node") < F.col("node2"))
                        & (F.col("label") != F.col("label2")) & (apart <= (F.col("n") + F.col("n2")) * (100 - percent)))
    rare = often.where("l0 <> l1 AND NOT central").select("pivot", "e")
    each = staged(each.join(rare, ["pivot", "e"]), "extra")
    twin = each.select("pivot", "e", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "n")])
    common = each.join(twin, ["pivot", "e"]).where(
        (F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2"))
        & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent))
    pairs = [c.select(F.col("node").alias("u"), F.col("node2").alias("v")) for c in (counted, common)]
    return pairs[0].union(pairs[1])


def links(keys: DataFrame, texts: DataFrame, words: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """Labels ``node, label`` of the components of all nodes that share a key and are alike."""
    open_, labels, found, near = keys, None, None, None
    for turn in range(rounds):
        known = _labelled(open_, labels)
        order = F.lit(_ORDERS[turn % len(_ORDERS)])
        several = known.groupBy("key").agg(
            F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.col("node").bitwiseXOR(order)).alias("p"))
        several = several.where("l0 <> l1").select("key", F.col("p").bitwiseXOR(order).alias("pivot"))
        met = staged(known.join(several, "key").where("node <> pivot").select("key", "node", "n", "pivot"), "met")
        star = staged(measured(
            met.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), texts, words, percent), "star")
        new = star.where("alike").select("u", "v")
        if not new.isEmpty():
            found = new if found is None else found.union(new)
            labels = components(found)
        met = met.join(star.select(F.col("u").alias("node"), F.col("v").alias("pivot"), "lost", "gained", "extra"),
                       ["node", "pivot"])
        close = met.where("extra IS NOT NULL").select("pivot", "node", "n", "lost", "gained", "extra").dropDuplicates(["pivot", "node"])
        near = close if near is None else near.union(close)
        # Two alike nodes are both at least half like the pivot, or both less than (150 - percent) % like it.
        union = F.col("n") + F.col("lost")
        open_ = staged(met.where((F.col("n") - F.col("gained")) * 100 < union * (150 - percent)).select("key", "node", "n"), "open")
    rest = _labelled(open_, labels)
    rest = staged(rest.join(_several(rest, "key"), "key"), "open")
    twin = rest.select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("label").alias("other"))
    left = rest.join(twin, "key").where(
        (F.col("node") < F.col("v")) & (F.col("label") != F.col("other"))
        & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)).select(F.col("node").alias("u"), "v")
    pairs = left.union(_sharing(near, labels, percent)).distinct()
    new = staged(measured(pairs, texts, words, percent).where("alike").select("u", "v"), "confirmed")
    if not new.isEmpty():
        labels = components(new if found is None else found.union(new))
    return labels if labels is not None else keys.select("node", F.col("node").alias("label")).limit(0)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, tuples: int = TUPLES, width: int = WIDTH,
) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``: documents are linked where their sets of
    ``words``-word shingles are ``percent`` alike; a component keeps its smallest doc_id."""
    rows = staged(sketches(docs, words, tuples, width), "sketches")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = staged(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = full.join(classes, ["d1", "d2"]).where("doc_id = node").dropDuplicates(["d1", "d2"])
    keys = staged(table_keys(nodes), "keys")
    named = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = staged(
        named.join(keys.select("node").distinct(), "node", "left_semi").dropDuplicates(["node", "text"]), "candidates")
    labels = links(keys, texts, words, percent)
    joined = classes.join(labels, "node", "left").select(
        "d1", "d2", F.coalesce("label", "node").alias("component_id"))
    some = full.join(joined, ["d1", "d2"]).select("doc_id", "n", "component_id")
    none = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.union(none).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay: of each component its smallest doc_id, of equal rows one."""
    kept = near_duplicates(docs, **settings).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
        F.col("text").alias("_text"))
    met = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi")
    return met.dropDuplicates(["_id", "_text"]).select("_row.*")
