"""Manifest of a dataset: a Merkle tree of SHA-256 digests whose parents keep the states before each child.

A row is a leaf. The leaves of a group, in order, are hashed in runs of ``WIDTH`` to parents, these again, until one
node is left; the groups' nodes, in the order of the groups, likewise give the root. A parent's message is the
hexadecimal text of its children's digests. While it is hashed, the state before every child is copied and kept in the
parent's row (``states``). A changed leaf is folded to the root from there: at each parent the state before its
place is resumed with the new digest and the siblings to the right, and nothing to the left is hashed again.

Every level is one grouping by (group, place div ``WIDTH``), at most ``WIDTH`` rows each, so a large group is spread as
evenly as small ones. The way up is handed down from the root: a node takes its parent's path and puts itself in
front, so no join has more than ``WIDTH`` rows to a key, and rows of one run share a path.

Defined results: null values are told from empty ones in the leaf; a row without id or without text is never tampered
with; null groups come first; rows of equal id are ordered by their leaves, equal rows are interchangeable and each a
leaf; very long texts are hashed whole by Spark; extra columns are left out; an empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowtide.llm import sha256
from rowtide.llm.sha256 import SIZE
from rowtide.llm.stage import staged

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5  # one row in so many, by the crc32 of its id
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RUNS = 256  # runs that are folded at once
_PATH = "array<struct<slot: int, state: binary, kids: binary>>"


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: every value as its UTF-8 length, a colon and its text, ``-`` where it is null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """Table ``doc_id, key, leaf, changed``: the group as a text that sorts null first, the leaf, and the leaf after
    tampering (the same where the row is left alone)."""
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    other = columns | {"text": F.translate(columns["text"], UPPER, LOWER)}
    hit = F.crc32(columns["doc_id"].cast("string").cast("binary")) % tampered == 0
    found = docs.select(
        columns["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), columns["source"].cast("string")), F.lit("")).alias("key"),
        leaf(list(columns.values())).alias("leaf"),
        F.when(hit, leaf(list(other.values()))).alias("changed"))
    return found.withColumn("changed", F.coalesce("changed", "leaf"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``index``, the place from 0 in its group by ``order``, and ``n``, the group's size.

    Rows are sorted by ranges; what a window sees is one row per group and partition."""
    by = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    placed = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    pieces = placed.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = W.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    return placed.withColumn("_part", part).join(pieces, [group, "_part"]).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("index"), "n")


def _digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated digests of every row, as an array padded to ``WIDTH``, and their numbers."""
    values = column.to_pylist()
    counts = np.array([len(v) // SIZE for v in values], np.int64)
    found = np.zeros((len(values), WIDTH, SIZE), np.uint8)
    flat = np.frombuffer(b"".join(values), np.uint8).reshape(-1, SIZE)
    found[np.arange(WIDTH) < counts[:, None]] = flat
    return found, counts


def seal(kids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest of every parent, and the state before each child slot."""
    state = sha256.begin(len(kids))
    kept = np.zeros((len(kids), WIDTH, SIZE), np.uint8)
    for slot in range(WIDTH):
        on = np.flatnonzero(counts > slot)
        kept[on, slot] = sha256.as_bytes(state[on])
        state[on] = sha256.absorb(state[on], kids[on, slot])
    return sha256.finish(state, counts), kept


def fold(states: np.ndarray, new: np.ndarray, slots: np.ndarray, kids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Digests of parents one of whose children (number ``slots``) is replaced by ``new``, from the states before it."""
    state = sha256.absorb(sha256.as_state(states), new)
    for slot in range(1, WIDTH):
        on = np.flatnonzero((slots < slot) & (slot < counts))
        if len(on):
            state[on] = sha256.absorb(state[on], kids[on, slot])
    return sha256.finish(state, counts)


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 16 * _RUNS):
            part = batch.slice(low, 16 * _RUNS)
            kids, counts = _digests(part.column("kids"))
            digest, states = seal(kids, counts)
            rows = [pa.array([d.tobytes() for d in digest], pa.binary()),
                    pa.array([s[:c].tobytes() for s, c in zip(states, counts)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns, *rows], [*part.schema.names, "digest", "states"])


def sealed(runs: DataFrame) -> DataFrame:
    """Parents with their ``digest`` and ``states``, from rows that have their children's digests in ``kids``."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return runs.mapInArrow(_sealed, f"{shape}, digest binary, states binary")


def _joined(digests: Column) -> Column:
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above ``key, index, n, digest``, of groups that have more than one node."""
    runs = nodes.where("n > 1").groupBy("key", F.floor(F.col("index") / WIDTH).cast("long").alias("index")).agg(
        F.ceil(F.first("n") / WIDTH).cast("long").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("index").alias("at"), "digest"))).alias("kids"))
    return sealed(runs.withColumn("kids", _joined(F.col("kids.digest"))))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels above ``nodes``, each written to the shared folder. Only whether a level is the last one comes to the driver."""
    found, now = [], nodes
    while not now.where("n > 1").isEmpty():
        now = staged(parents(now), "level")
        found.append(now)
    return found


def with_paths(nodes: DataFrame, above: list[DataFrame], ends: DataFrame) -> DataFrame:
    """``nodes`` (with ``key, index, n``) and the ``path`` of each: per parent on the way up the place in it, the state
    before that place, and the children. A group's last node takes the path that ``ends`` has for its ``key``."""
    alone = nodes.where("n = 1").join(ends, "key")
    if not above:
        return alone
    further = with_paths(above[0].select("key", "index", "n", "kids", "states"), above[1:], ends).select(
        "key", F.col("index").alias("_up"), F.col("kids").alias("_kids"), F.col("states").alias("_states"), *(
            F.col(c).alias(f"_{c}") for c in ends.columns if c != "key"))
    slot = (F.col("index") % WIDTH).cast("int")
    step = F.struct(slot.alias("slot"), F.substring("_states", slot * SIZE + 1, F.lit(SIZE)).alias("state"), F.col("_kids").alias("kids"))
    rest = nodes.where("n > 1").withColumn("_up", F.floor(F.col("index") / WIDTH).cast("long")).join(further, ["key", "_up"])
    return alone.unionByName(rest.select(
        *nodes.columns, F.concat(F.array(step), "_path").alias("path"), *(F.col(f"_{c}").alias(c) for c in ends.columns if c not in ("key", "path"))))


def _proofs(root: bytes):
    """Task that folds every row of runs with their paths; ``root`` is the digest they should give."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def siblings(kids: str, slot: int) -> str:
        return kids[: 2 * SIZE * slot] + kids[2 * SIZE * (slot + 1):]

    def folded(runs: list[dict]) -> list[bytes]:
        """The root that each row of the runs leads to, its changed leaf in place of the original one."""
        of = np.repeat(np.arange(len(runs)), [len(r["ids"]) for r in runs])
        value = np.frombuffer(b"".join(r["changed"] for r in runs), np.uint8).reshape(-1, SIZE).copy()
        slots = np.concatenate([np.arange(len(r["ids"])) for r in runs])
        on = np.flatnonzero(np.array([r["states"] is not None for r in runs])[of])
        if len(on):
            kids, counts = _digests(pa.array([r["leaves"] for r in runs]))
            states, _ = _digests(pa.array([r["states"] or b"" for r in runs]))
            value[on] = fold(states[of[on], slots[on]], value[on], slots[on], kids[of[on]], counts[of[on]])
        for step in range(max(len(r["path"]) for r in runs)):
            steps = [r["path"][step] if step < len(r["path"]) else None for r in runs]
            on = np.flatnonzero(np.array([s is not None for s in steps])[of])
            kids, counts = _digests(pa.array([s["kids"] if s else b"" for s in steps]))
            states = np.frombuffer(b"".join(s["state"] if s else bytes(SIZE) for s in steps), np.uint8).reshape(-1, SIZE)
            slot = np.array([s["slot"] if s else 0 for s in steps])
            value[on] = fold(states[of[on]], value[on], slot[of[on]], kids[of[on]], counts[of[on]])
        return [v.tobytes() for v in value]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _RUNS):
                runs = batch.slice(low, _RUNS).to_pylist()
                ends, rows = iter(folded(runs)), []
                for r in runs:
                    kids = r["leaves"].hex()
                    above = "".join(siblings(s["kids"].hex(), s["slot"]) for s in r["path"])
                    for slot, id_ in enumerate(r["ids"]):
                        end = next(ends)
                        proof = hashlib.sha256((siblings(kids, slot) + above).encode()).hexdigest()
                        rows.append((id_, kids[2 * SIZE * slot: 2 * SIZE * (slot + 1)], r["subroot"].hex(), root.hex(), proof, end.hex(), end == root))
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return work


def runs_of(rows: DataFrame) -> DataFrame:
    """Runs of consecutive leaves with their parent: ``key, index, n, ids, leaves, changed, digest, states``. The only
    leaf of a group is a node itself and has no states."""
    slot = F.struct((F.col("index") % WIDTH).alias("slot"), "doc_id", "leaf", "changed")
    runs = rows.groupBy("key", F.floor(F.col("index") / WIDTH).cast("long").alias("index")).agg(
        F.first("n").alias("size"), F.sort_array(F.collect_list(slot)).alias("rows"))
    runs = sealed(runs.select(
        "key", "index", F.ceil(F.col("size") / WIDTH).cast("long").alias("n"), "size", F.col("rows.doc_id").alias("ids"),
        _joined(F.col("rows.leaf")).alias("kids"), _joined(F.col("rows.changed")).alias("changed")))
    alone = F.col("size") == 1
    return runs.select("key", "index", "n", "ids", F.col("kids").alias("leaves"), "changed",
                       F.when(alone, F.col("kids")).otherwise(F.col("digest")).alias("digest"), F.when(~alone, F.col("states")).alias("states"))


def verified(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """Per row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the tree over all rows, and what each
    row, some of them tampered with, folds to."""
    rows = staged(leaves(docs, tampered), "leaves")
    runs = staged(runs_of(numbered(rows, "key", ["doc_id", "leaf"])), "runs")
    node = ["key", "index", "n", "digest"]
    above = levels(runs.select(*node))
    subroots = runs.select(*node).where("n = 1")
    for level in above:
        subroots = subroots.union(level.select(*node).where("n = 1"))
    # The groups' own tree: one group whose nodes are the subroots in order.
    tops = subroots.select(F.lit("").alias("all"), F.col("key").alias("name"), F.col("digest").alias("subroot"))
    tops = staged(numbered(tops, "all", ["name"]).select(F.col("all").alias("key"), "index", "n", "name", "subroot"), "subroots")
    over = levels(tops.withColumnRenamed("subroot", "digest"))
    last = (over[-1] if over else tops.withColumnRenamed("subroot", "digest")).select("digest").first()
    none = docs.sparkSession.range(1).select(F.lit("").alias("key"), F.array().cast(_PATH).alias("path"))
    ends = staged(with_paths(tops, over, none).select(F.col("name").alias("key"), "subroot", "path"), "ends")
    shape = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = with_paths(runs.drop("digest"), above, ends)
    return found.mapInArrow(_proofs(bytes(last["digest"]) if last else b""), shape)
