"""Mixing sources to target weights, with a splitting tree that deals blocks to output shards.

The documents of a source stand in the order of a hash of their id, cut into blocks by the first digits of
that hash. A source's target says how far along that order the mix reaches, once or, beyond the source's
size, a second time; the blocks it reaches are the source's quota. A tree over the shards then halves
the quotas: at each node the left half's share of every source is a draw from the multivariate
hypergeometric distribution, so every shard gets the same number of blocks (within one per level) and each
block lands in one shard only. A shard takes its part of a source's blocks in hash order, and its
documents are put in another hash order.

Everything is DataFrame operations. Positions are sums over a tree of hash digits, so that no window spans a
source; only the sum of all sizes and the number of drawn blocks come to the driver.

Defined results: a null text has size 0, a null source is a source of its own (the last), equal ids of a source
stand next to each other in the order of their sizes; sources without words have target 0. Extra columns are
passed through by ``mixed`` and left out by ``drawn``. A text of any length is drawn as a whole or not. An empty table
gives an empty table.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowtide.llm.stage import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all sizes, what the mix takes
MOST = 2.0  # times its size, what a source gives at most
BLOCK_WORDS = 262_144
SHARD_WORDS = 4_194_304
SEED = "mix"

_WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``src, source_size, target`` per source, from rows of ``src, source, size``.

    Sources are ordered by code point, null last, and weighted in turn. Those whose share by weight is
    more than ``most`` times their size stop there; they are the first in the order of ``most * size /
    weight``, so that one pass over the (few) sources finds them all."""
    totals = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    known = totals.withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = W.orderBy((F.col("cap") / F.col("w")), "src")
    rest = order.rowsBetween(0, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    known = known.withColumns({
        "all": F.lit(share) * F.sum("source_size").over(whole),
        "given": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left_w": F.sum("w").over(rest),
    })
    full = (F.col("all") - F.col("given")) * F.col("w") >= F.col("cap") * F.col("left_w")
    known = known.withColumn("full", full)
    known = known.withColumns({
        "taken_up": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole),
        "free_w": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole),
    })
    target = F.when(F.col("full"), F.col("cap")).otherwise(
        F.col("w") * (F.col("all") - F.col("taken_up")) / F.col("free_w"))
    return known.select("src", "source_size", target.alias("target"))


def before_in_order(blocks: DataFrame, digits: int, value: str, out: str) -> DataFrame:
    """``blocks`` (unique ``src, block``) with the sum of ``value`` over the earlier blocks of the source.

    A block's name is ``digits`` digits of its hash. Sums are formed per leading digits, one digit at a
    time, so that a window never spans more than the 16 children of a node."""
    starts = None
    for length in range(1, digits + 1):
        prefix = F.substring("block", 1, length)
        sums = blocks.groupBy("src", prefix.alias("prefix")).agg(F.sum(value).alias("n"))
        sums = sums.withColumn("parent", F.substring("prefix", 1, length - 1))
        siblings = W.partitionBy("src", "parent").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
        level = sums.select("src", "prefix", "parent", F.coalesce(F.sum("n").over(siblings), F.lit(0)).alias("own"))
        if starts is not None:
            level = level.join(starts.withColumnRenamed("prefix", "parent"), ["src", "parent"]).withColumn(
                "own", F.col("own") + F.col("above"))
        starts = level.select("src", "prefix", F.col("own").alias("above"))
    if starts is None:
        return blocks.withColumn(out, F.lit(0).cast("long"))
    return blocks.join(starts.withColumnsRenamed({"prefix": "block", "above": out}), ["src", "block"])


#: A draw from the hypergeometric distribution by inversion: of ``t`` blocks, ``k`` are of the source and ``n``
#: go left; how many of the source's do. Probabilities follow one another by their ratio, beginning far enough
#: (12 standard deviations) below the mean that what is left out is less than a double can tell from 0.
_PARTS = "named_struct('t', {t}, 'k', {k}, 'n', {n}, 'u', {u}, 'mean', {n} * {k} / greatest({t}, 1D), " \
         "'sd', sqrt({n} * {k} / greatest({t}, 1D) * (1 - {k} / greatest({t}, 1D)) * ({t} - {n}) / greatest({t} - 1, 1D)))"
_ENDS = "named_struct('t', p.t, 'k', p.k, 'n', p.n, 'u', p.u, " \
        "'lo', cast(greatest(0D, p.n + p.k - p.t, floor(p.mean - 12 * p.sd) - 1) as long), " \
        "'hi', cast(least(p.n, p.k, ceil(p.mean + 12 * p.sd) + 1) as long))"
_RATIO = "(r.k - x) * (r.n - x) / ((x + 1) * (r.t - r.k - r.n + x + 1))"
_STEPS = "sequence(r.lo, r.hi)"
_SUM = f"aggregate({_STEPS}, named_struct('w', 1D, 's', 0D), (a, x) -> " \
       f"named_struct('w', if(x = r.hi, 0D, cast(a.w * {_RATIO} as double)), 's', a.s + a.w), a -> a.s)"
_FIND = f"aggregate({_STEPS}, named_struct('w', 1D, 's', 0D, 'x', r.hi), (a, x) -> " \
        f"named_struct('w', if(x = r.hi, 0D, cast(a.w * {_RATIO} as double)), 's', a.s + a.w, " \
        "'x', if(a.s <= f.goal AND a.s + a.w > f.goal, x, a.x)), a -> a.x)"


def hypergeometric(t: str, k: str, n: str, u: str) -> str:
    """SQL for a draw; ``t, k, n`` are doubles and ``u`` is uniform in [0, 1)."""
    parts = _PARTS.format(t=t, k=k, n=n, u=u)
    ends = f"transform(array({parts}), p -> {_ENDS})[0]"
    goal = f"transform(array({ends}), r -> named_struct('r', r, 'goal', r.u * {_SUM}))[0]"
    return f"transform(array({goal}), f -> transform(array(f.r), r -> {_FIND})[0])[0]"


def split_quotas(quotas: DataFrame, depth: int, seed: str = SEED) -> DataFrame:
    """Deal ``n`` blocks of each ``src`` to ``2 ** depth`` shards: ``src, shard, first, n``, the blocks of a
    source from number ``first`` on. Each level of the tree is a step over its nodes; a node carries the
    quotas of all sources."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("src", F.col("n").cast("double").alias("n")))).alias("q"))
    nodes = nodes.select(F.lit(0).cast("long").alias("shard"), "q")
    u = f"shiftrightunsigned(xxhash64('{seed}', {{level}}, shard, q0.src), 11) / 9007199254740992D"
    for level in range(depth):
        draw = hypergeometric("s.t", "q0.n", "s.n", u.format(level=level))
        left = F.expr(
            "aggregate(q, named_struct('t', total, 'n', ceil(total / 2) + 0D, 'out', cast(array() as array<double>)), "
            "(s, q0) -> transform(array(named_struct('t', s.t, 'n', s.n, 'out', s.out, 'k', q0.n, "
            f"'x', cast({draw} as double))), z -> named_struct('t', z.t - z.k, 'n', z.n - z.x, "
            "'out', concat(z.out, array(z.x))))[0], s -> s.out)")
        nodes = nodes.withColumn("total", F.expr("aggregate(q, 0D, (s, q0) -> s + q0.n)")).withColumn("l", left)
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("shard") * 2).alias("shard"),
                     F.expr("zip_with(q, l, (a, b) -> named_struct('src', a.src, 'n', b))").alias("q")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"),
                     F.expr("zip_with(q, l, (a, b) -> named_struct('src', a.src, 'n', a.n - b))").alias("q")),
        )).alias("node")).select("node.*")
        if level % 6 == 5:
            nodes = staged(nodes, "nodes")  # keeps the plan small
    dealt = nodes.select("shard", F.inline("q")).select("src", "shard", F.col("n").cast("long").alias("n"))
    earlier = W.partitionBy("src").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return dealt.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _digits(amount: int, per: int) -> int:
    """Hexadecimal digits that cut ``amount`` into parts of ``per`` or less."""
    return max(0, math.ceil(math.log(max(1, amount / per), 16)))


def drawn(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS, seed: str = SEED,
) -> DataFrame:
    """Per document ``doc_id, source, size, key, source_size, target`` and ``shards``: the output shard of
    each time it is drawn (none, one or two)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sizes = staged(docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("src"), words().alias("size"),
        key.alias("key")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    digits = _digits(total, block_words)
    sizes = sizes.withColumn("block", F.substring("key", 1, digits))
    targets = staged(source_targets(sizes, weights, share, most), "targets")

    # Where each document begins along its source, and how many words the source reaches.
    blocks = before_in_order(sizes.groupBy("src", "block").agg(F.sum("size").alias("n")), digits, "n", "start")
    blocks = blocks.join(targets, "src")
    inside = W.partitionBy("src", "block").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks.drop("n"), ["src", "block"])
    middle = F.col("start") + F.col("_in") + F.col("size") / 2
    passes = F.array(*[F.col("target") - F.lit(p) * F.col("source_size") >= middle for p in range(math.ceil(most))])
    placed = staged(placed.select(
        "doc_id", "source", "src", "block", "size", "key", "source_size", "target", passes.alias("passes")), "placed")

    # The blocks reached, numbered along the source: the first time round, then the second.
    reached = placed.groupBy("src", "block").agg(*[
        F.max(F.element_at("passes", p + 1).cast("int")).cast("long").alias(f"p{p}") for p in range(math.ceil(most))])
    reached = staged(reached, "reached")
    quotas = reached.groupBy("src").agg(*[F.sum(f"p{p}").alias(f"q{p}") for p in range(math.ceil(most))])
    tries = []
    for p in range(math.ceil(most)):
        numbered = before_in_order(reached.select("src", "block", f"p{p}"), digits, f"p{p}", "number").where(f"p{p} = 1")
        offset = sum((F.col(f"q{i}") for i in range(p)), F.lit(0))
        tries.append(numbered.join(quotas, "src").select(
            "src", "block", F.lit(p).alias("turn"), (F.col("number") + offset).alias("number")))
    blocks_drawn = tries[0]
    for more in tries[1:]:
        blocks_drawn = blocks_drawn.union(more)

    depth = max(0, math.ceil(math.log2(max(1, share * total / shard_words))))
    n = sum((F.col(f"q{p}") for p in range(math.ceil(most))), F.lit(0))
    dealt = split_quotas(quotas.select("src", n.alias("n")), depth, seed).where("n > 0")
    dealt = dealt.select("src", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("number"))
    homes = blocks_drawn.join(dealt, ["src", "number"]).groupBy("src", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("turn", "shard"))).alias("homes"))  # one entry per turn
    shards = F.expr("filter(transform(passes, (hit, i) -> if(hit, homes[i], NULL)), s -> s IS NOT NULL)")
    joined = placed.join(homes, ["src", "block"], "left")
    return joined.select(
        "doc_id", "source", "size", "key", "source_size", "target",
        F.coalesce(shards, F.array().cast("array<bigint>")).alias("shards"))


def mixed(docs: DataFrame, seed: str = SEED, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are drawn, put together by shard and shuffled
    within. Rows are told apart by doc_id, source and size: those alike in all three take
    the shards of all of them in turns, so that none is multiplied."""
    plan = drawn(docs, seed=seed, **settings).where(F.size("shards") > 0).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "shards")
    # Equal rows of the plan are one, with all their shards, so that repeated rows are not multiplied.
    plan = plan.groupBy("_id", "_source", "_size").agg(
        F.count(F.lit(1)).alias("_n"), F.flatten(F.collect_list("shards")).alias("_shards"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), words().alias("_z"), row)
    same = F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_z") == F.col("_size"))
    met = rows.join(plan, same)
    share = F.row_number().over(W.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64("_row"))) - 1
    mine = F.expr("filter(_shards, (s, i) -> i % _n = _turn)")
    out = met.withColumn("_turn", share).withColumn("_mine", mine).select("_row", "_d", F.posexplode("_mine").alias("_k", "_shard"))
    order = F.xxhash64(F.lit(seed), "_shard", "_d", "_k")
    return out.repartition("_shard").sortWithinPartitions("_shard", order).select("_row.*")
