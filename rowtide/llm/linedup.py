"""Line deduplication with a segment-partition edit join.

A line goes when an earlier one (smaller doc_id, or the same and earlier in the text) is equal or at most so
many character edits away as ``edits`` says, after normalisation (lower case, no spaces at the ends): a number
for all lines, or ``BY_LENGTH``, one for every ``CHARS_AN_EDIT`` characters of the shorter line and ``MOST_EDITS``
at most, which finds a line with a changed word. Lines of fewer than ``min_chars`` code points are left alone.
Judged on the input, so a line that goes still counts as earlier.

Lines are in classes by length, each with its number of edits ``e`` and a width. A line has ``e + 1`` blocks of
that width, counted from its begin and from its end. Of two lines within ``e`` edits either the begin has fewer
edits than blocks, or the end has; there the first block ``i`` with at most ``i`` edits up to its end is
whole, and moved by ``i`` at most. So each line enters its blocks, and looks up, per block, the substrings of
itself that are moved that little. A block with a space in its first third is known by what follows the first
space, for two thirds of the width: equal blocks have the same one, and substrings at neighbouring moves mostly share it, so
that a line has a key for every word start near a block and not for every move. Blocks without such a space are known
by all their characters. A line looks up in the class below as well if a line there can be near.

In a bucket all lines first meet the earliest one; only those that found no near line there meet all
others. In a crowd, a bucket of more than ``CROWD`` rows, they meet as texts, each until it finds a near one, so
that what is written grows with the lines and not with their pairs: lines of one template that are all further apart than
their edits share most blocks and letters, and nothing but their texts tells them apart. Before texts are compared, pairs are ruled out by what the bucket stands for. The blocks from the begin and
those from the end do not overlap, so the differences in letters of the two parts add up to at most twice the
edits; the part of the bucket's block has fewer edits than blocks; and a pair with an equal outermost block meets
in the bucket of that one only. The others are confirmed by their edit distance, which is not followed beyond
what is allowed.

Equal lines are one before any of this, and everything is DataFrame operations. Defined results: a null text
has no lines; a null doc_id ranks last; rows of one doc_id and text are one document, and texts of one doc_id rank
by a hash of the text, so that of two lines one is always the earlier; a text of any length is its lines, and lines of
2 ** 20 code points or more are one class; extra columns are passed through by ``keep_lines``, whatever their
names; an empty table gives an empty table.
"""

import functools

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm.stage import bucketed, discard, staged

EDITS = 1
MIN_CHARS = 40
BY_LENGTH = "by length"
CHARS_AN_EDIT = 20
MOST_EDITS = 10
CROWD = 128  # rows of a bucket from which its pairs are not written before they are confirmed
CROWD_PIECE = 1024  # lines of a crowd that one task holds against all others

_LONGEST = 1 << 20  # lines from here on are one class
_COUNTED = "abcdefghijklmnopqrstuvwxyz ,.012"  # characters counted to tell lines apart before their texts are compared


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, h, line_no, line, size, l1, l2`` per line that is long enough: ``doc`` is the rank of its document,
    ``h`` a hash of the whole text, ``line`` normalised, ``size`` its code points, and ``l1, l2`` its 128-bit
    identity. Lines are normalised inside the array, so that what is exploded is a column of its own and no
    expression over it is worked out again for each use."""
    lines = F.transform(F.split("text", "\n", -1), normal)
    rows = docs.select(rank().alias("doc"), F.xxhash64("text").alias("h"), F.posexplode(lines).alias("line_no", "line"))
    sized = rows.withColumn("size", F.char_length("line")).where(F.col("size") >= min_chars)
    return sized.withColumns({"l1": F.xxhash64("line"), "l2": F.xxhash64(F.lit(1), "line")})


def rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def normal(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def allowed(size: Column, edits: int | str) -> Column:
    """The edits that a pair may have whose shorter line has ``size`` characters."""
    if edits == BY_LENGTH:
        return F.least(F.floor(size / CHARS_AN_EDIT), F.lit(MOST_EDITS)).cast("int")
    return F.lit(edits)


def classes(edits: int | str, min_chars: int) -> list[tuple[int, int, int]]:
    """Least size, most edits and block width of each class of lines. A class is wider than its edits, so
    that only neighbours can have near lines. All lines of a class may have its number of edits, where that goes by
    length, and blocks are nearly as wide as the longest line allows: what short blocks share by chance grows with the
    square of the lines."""
    at = lambda size: min(size // CHARS_AN_EDIT, MOST_EDITS) if edits == BY_LENGTH else edits
    found, low = [], min_chars
    while low < _LONGEST:
        high = low + max(low // (8 if low < 1024 else 4), at(low * 2) + 1)
        if edits == BY_LENGTH and at(low) < MOST_EDITS:
            high = -(-(low + at(low * 2) + 1) // CHARS_AN_EDIT) * CHARS_AN_EDIT
        found.append((low, at(high - 1), low // (at(high - 1) + 1)))
        low = high
    return [*found, (low, at(low), low // (at(low) + 1))]


def _item(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def class_of(size: Column, every: list[tuple[int, int, int]]) -> Column:
    return sum(((size >= low).cast("int") for low, _, _ in every[1:]), F.lit(0))


def segment_keys(lines: DataFrame, edits: int | str = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key, code`` per block of each line, and per substring that it looks up; ``code`` holds the line's ``id``, the
    block (7 bits), whether it is one of the class below, and whether it is a block of its own (see ``parts_of``).

    A block is taken with the characters it may be moved by. Every move in it is a window; windows that share the
    first space share a key, which is made by the first of them."""
    every = classes(edits, min_chars)
    of = lambda values: F.array(*[F.lit(v) for v in values])
    size = F.col("size")
    below = F.col("c") - 1
    near = (below >= 0) & (size < _item([low for low, _, _ in every], F.col("c")) + _item([e for _, e, _ in every], below))
    downs = F.explode(F.when(near, of([0, 1])).otherwise(of([0]))).alias("down")
    seen = lines.select(F.coalesce("id", F.lit(0)).alias("id"), "line", "size", class_of(size, every).alias("c")).select("id", "line", "size", "c", downs)
    seen = seen.withColumn("c", F.col("c") - F.col("down"))
    e, w = _item([e for _, e, _ in every], F.col("c")), _item([w for _, _, w in every], F.col("c"))
    most = max(e for _, e, _ in every)
    codes = F.get(F.array(*[of([side * 64 + i for side in (0, 1) for i in range((e + 2 - side) // 2)]) for e in range(most + 1)]), e)
    blocks = seen.select("id", "line", "size", "c", "down", w.alias("w"), F.explode(codes).alias("block"))
    blocks = blocks.withColumn("i", F.col("block").bitwiseAND(63))
    begin = F.when(F.col("block") < 64, F.col("i") * F.col("w")).otherwise(size - (F.col("i") + 1) * F.col("w"))
    region = F.col("line").substr(begin - F.col("i") + 1, F.col("w") + 2 * F.col("i"))
    windows = F.get(F.array(*[of(range(2 * i + 1)) for i in range(most // 2 + 1)]), F.col("i"))
    moves = blocks.select("id", "c", "down", "w", "block", "i", region.alias("region"))
    moves = moves.select("*", F.explode(windows).alias("j"), F.floor(F.col("w") / 3).cast("int").alias("reach"))
    moves = moves.withColumn("x", F.expr("locate(' ', region, j + 1)"))
    moves = moves.withColumn("anchored", F.expr("x > 0 AND x - j <= reach"))
    made = moves.where("NOT anchored OR j = 0 OR x - j = reach OR substr(region, j, 1) = ' '")
    part = F.expr("CASE WHEN anchored THEN substr(region, x + 1, w - reach) ELSE substr(region, j + 1, w) END")
    own = F.expr("CASE WHEN down = 0 AND CASE WHEN anchored THEN j <= i AND x > i ELSE j = i END THEN 1 ELSE 0 END")
    code = ((F.col("id") * 128 + F.col("block")) * 2 + F.col("down")) * 2 + own
    return made.select(F.xxhash64("c", "block", "anchored", part).alias("key"), code.alias("code"))


def parts_of(code: str = "code") -> dict[str, Column]:
    """What a ``code`` holds."""
    bits = lambda shift, mask: F.shiftright(code, shift).bitwiseAND(mask).cast("int")
    return {"id": F.shiftright(code, 9), "block": bits(2, 127), "down": bits(1, 1), "own": bits(0, 1) == 1}


def within(left: str, right: str, edits: int | str = EDITS) -> Column:
    """Whether two strings are at most ``edits`` edits apart; the distance is followed in a band of that width."""
    sizes = F.char_length(left), F.char_length(right)
    most = allowed(F.least(*sizes), edits)
    near = F.abs(sizes[0] - sizes[1]) <= most
    return F.when(near, F.call_function("levenshtein", F.col(left), F.col(right), most) >= 0).otherwise(False)


def letters(line: Column) -> list[Column]:
    """How often a text has each of 32 characters, four bits each, in two numbers. Counts one apart differ in one
    bit and counts four apart in four, and from there on they come round again: two texts differ in no more bits
    than counts."""
    n = lambda c: (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))).bitwiseAND(7)
    bits = lambda c: F.call_function("shiftright", F.lit(0x0F0F), n(c)).bitwiseAND(15).cast("long")
    return [sum((F.shiftleft(bits(c), 4 * k) for k, c in enumerate(_COUNTED[at: at + 16])), F.lit(0).cast("long")) for at in (0, 16)]


def _sketches(lines: DataFrame, edits: int | str, min_chars: int) -> DataFrame:
    """Per line (``id, down, first, size, line``), as one of the class that ``down`` says: ``letters`` of the part with the
    blocks from its begin (``b0, b1``) and of the one from its end (``e0, e1``), hashes of its first block and its last
    one, and ``most``, the edits of the class."""
    every = classes(edits, min_chars)
    c, size, line = F.col("c"), F.col("size"), F.col("line")
    w, e = F.col("w"), F.col("most")
    rows = lines.withColumn("c", class_of(size, every) - F.col("down"))
    rows = rows.withColumns({"w": _item([w for _, _, w in every], c), "most": _item([e for _, e, _ in every], c)})
    ends = F.floor((e + 1) / 2).cast("int") * w
    rows = rows.withColumns({
        "begin": line.substr(F.lit(1), F.floor((e + 2) / 2).cast("int") * w), "end": line.substr(size - ends + 1, ends),
        "first_block": F.xxhash64(line.substr(F.lit(1), w)), "last_block": F.xxhash64(line.substr(size - w + 1, w))})
    (b0, b1), (e0, e1) = letters(F.col("begin")), letters(F.col("end"))
    return rows.select("id", "down", "first", "size", "most", "first_block", "last_block",
                       b0.alias("b0"), b1.alias("b1"), e0.alias("e0"), e1.alias("e1"))


def possible(left: str, right: str, edits: int | str) -> Column:
    """Whether two lines of a bucket (structs with ``size``, ``outer``, letters ``n0, n1`` of the part of the bucket's block
    and ``f0, f1`` of the other part) can be near: an edit changes two counts at most, the part has ``tight`` edits
    at most, and lines with an equal outermost block meet there."""
    size = lambda side: F.col(f"{side}.size")
    moved = lambda *names: sum(F.bit_count(F.col(f"{left}.{n}").bitwiseXOR(F.col(f"{right}.{n}"))) for n in names)
    most = allowed(F.least(size(left), size(right)), edits)
    return (
        (F.abs(size(left) - size(right)) <= most) & (F.col(f"{left}.outer") != F.col(f"{right}.outer"))
        & (moved("n0", "n1") <= 2 * F.col(f"{left}.tight")) & (moved("n0", "n1", "f0", "f1") <= 2 * most))


def _confirmed(pairs: DataFrame, distinct: DataFrame, edits: int | str, label: str) -> DataFrame:
    """Of pairs of lines ``x`` and ``y`` (ids), the ``later`` one of those within ``edits``."""
    asked = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    texts = staged(distinct.select("id", "line").join(asked, "id", "left_semi"), "texts")
    named = lambda side: texts.select(F.col("id").alias(side), F.col("line").alias(f"{side}_line"))
    met = pairs.join(named("x"), "x").join(named("y"), "y")
    found = staged(met.where(within("x_line", "y_line", edits)).select(F.col("later").alias("id")).distinct(), label)
    discard(texts)
    return found


def repeated_lines(docs: DataFrame, edits: int | str = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, h, line_no`` of every line that an earlier one makes redundant."""
    if edits != BY_LENGTH and min_chars <= 2 * edits or edits == BY_LENGTH and min_chars < CHARS_AN_EDIT:
        raise ValueError("lines must be longer than twice the edits, or long enough for one")
    place = F.struct("doc", "h", "line_no")
    lines = document_lines(docs, min_chars)
    seen = lines.groupBy("l1", "l2").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    distinct = staged(seen.withColumns({"id": F.monotonically_increasing_id(), "size": F.char_length("line")}), "distinct-lines")
    often = staged(distinct.where("n > 1").select("l1", "l2", "first"), "often")
    equal = lines.select(place.alias("gone"), "l1", "l2").join(often, ["l1", "l2"]).where("gone > first").select("gone")

    # Buckets that hold two different lines, one of them under its own segment. Both sides of the join read the
    # same exchange, and what is kept of a bucket is one number, so the keys are not sorted.
    keys = segment_keys(distinct, edits, min_chars).repartition("key")
    line_id = parts_of()["id"]
    live = keys.groupBy("key").agg(F.min(line_id).alias("a"), F.max(line_id).alias("b"), F.max(F.col("code").bitwiseAND(1)).alias("own"))
    live = live.where("a <> b AND own = 1").select(F.col("key").alias("_key")).hint("shuffle_hash")
    met = keys.join(live, F.col("key") == F.col("_key")).select("key", "code").distinct()
    met = staged(met.select("key", *[c.alias(n) for n, c in parts_of().items()]), "met")
    asked = met.select("id", "down").distinct()
    known = staged(_sketches(distinct.select("id", "first", "size", "line").join(asked, "id"), edits, min_chars), "sketches")
    at_end, i = F.col("block") >= 64, F.col("block").bitwiseAND(63)
    side = lambda begin, end: F.when(at_end, F.col(end)).otherwise(F.col(begin))
    at = F.struct(
        "first", "size", F.floor((F.col("most") - at_end.cast("int")) / 2).cast("int").alias("tight"),
        F.when(i == 0, F.col("id")).otherwise(side("first_block", "last_block")).alias("outer"),
        side("b0", "e0").alias("n0"), side("b1", "e1").alias("n1"), side("e0", "b0").alias("f0"), side("e1", "b1").alias("f1"), "id")
    with bucketed(met.join(known, ["id", "down"]).select("key", "own", at.alias("at")), "buckets", "key") as buckets:
        discard(met)
        discard(known)
        found = _near(buckets, distinct, edits)
    near = functools.reduce(DataFrame.union, found).distinct()
    gone = staged(distinct.select("id", F.col("first").alias("gone")).join(near, "id").select("gone"), "gone")
    for done in (*found, distinct):
        discard(done)
    return equal.union(gone).select("gone.*")


def _near(met: DataFrame, distinct: DataFrame, edits: int | str) -> list[DataFrame]:
    """``id`` of every line with an earlier one near it in a bucket (``key, own, at``): those near the earliest line
    of a bucket, those near another one of a crowd, and those near another one elsewhere."""
    own, other = F.when(F.col("own"), F.col("at")), F.when(~F.col("own"), F.col("at"))
    pivots = met.groupBy("key").agg(F.min(own).alias("own_pivot"), F.min(other).alias("other_pivot"))
    against = F.explode(F.array("own_pivot", F.when(F.col("own"), F.col("other_pivot")))).alias("y")
    star = met.join(pivots, "key").select(F.col("at").alias("x"), against)
    star = star.where((F.col("x.id") != F.col("y.id")) & possible("x", "y", edits))
    later = F.when(F.col("x.first") > F.col("y.first"), F.col("x.id")).otherwise(F.col("y.id")).alias("later")
    star = staged(star.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), later).distinct(), "star")
    near = _confirmed(star, distinct, edits, "near")

    # The rest: lines that still stand, against all earlier ones of their buckets.
    crowds = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowds = staged(crowds.select("key", F.ceil(F.col("n") / CROWD_PIECE).cast("int").alias("pieces")), "crowds")
    crowd = _in_crowds(met.join(crowds, "key"), near, distinct, edits)
    met = met.join(crowds, "key", "left_anti")
    settled = near.union(crowd)
    one = met.join(settled, met["at.id"] == settled["id"], "left_anti").select("key", F.col("own").alias("x_own"), F.col("at").alias("x"))
    two = met.select("key", F.col("own").alias("y_own"), F.col("at").alias("y"))
    rest = one.join(two, "key").where("(x_own OR y_own) AND y.first < x.first").where(possible("x", "y", edits))
    rest = rest.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.col("x.id").alias("later")).distinct()
    rest = staged(rest.join(star.select("x", "y"), ["x", "y"], "left_anti"), "rest")
    more = _confirmed(rest, distinct, edits, "more")
    for done in (star, crowds, rest):
        discard(done)
    return [near, crowd, more]


def _in_crowds(met: DataFrame, near: DataFrame, distinct: DataFrame, edits: int | str) -> DataFrame:
    """``id`` of every line but those of ``near`` with an earlier one near it in a crowd (``key, own, at, pieces``).

    A line is held against the others until one is near, and no pair is written. Each piece of a crowd meets all of it."""
    texts = distinct.select("id", "line").join(met.select(F.col("at.id").alias("id")).distinct(), "id", "left_semi")
    rows = staged(met.withColumn("id", F.col("at.id")).join(texts, "id"), "crowd-lines")
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    one = rows.join(near, "id", "left_anti").select(
        F.col("key").alias("x_key"), piece.alias("x_piece"), F.col("own").alias("x_own"), F.col("at").alias("x"), F.col("line").alias("x_line"))
    two = rows.select(
        F.col("key").alias("y_key"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("y_piece"),
        F.col("own").alias("y_own"), F.col("at").alias("y"), F.col("line").alias("y_line"))
    met_there = (F.col("x_key") == F.col("y_key")) & (F.col("x_piece") == F.col("y_piece"))
    earlier = F.expr("(x_own OR y_own) AND y.first < x.first")
    found = one.join(two, met_there & earlier & possible("x", "y", edits) & within("x_line", "y_line", edits), "left_semi")
    found = staged(found.select(F.col("x.id").alias("id")).distinct(), "crowd")
    discard(rows)
    return found


def marked(docs: DataFrame, edits: int | str = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row ``doc_id``, ``n_lines`` and ``removed``, the numbers (from 0) of its lines that go."""
    gone = repeated_lines(docs, edits, min_chars).groupBy("doc", "h").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    gone = gone.withColumnsRenamed({"doc": "_doc", "h": "_h"})
    rows = docs.select(
        F.col("doc_id"), rank().alias("doc"), F.xxhash64("text").alias("h"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"))
    joined = rows.join(gone, (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def keep_lines(docs: DataFrame, edits: int | str = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` and ``n_chars``, if there, counted again. A text of
    which no word is left, but had some, goes as a whole: all it says stands elsewhere."""
    gone = repeated_lines(docs, edits, min_chars).groupBy("doc", "h").agg(F.collect_set("line_no").alias("_removed"))
    gone = gone.withColumnsRenamed({"doc": "_doc", "h": "_h"})
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), rank().alias("_rank"),
                      F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    joined = row.join(gone, (F.col("_rank") == F.col("_doc")) & (F.col("_hash") == F.col("_h")), "left")
    left = F.expr("array_join(filter(split(_text, '\\n', -1), (l, i) -> NOT array_contains(_removed, i)), '\\n')")
    text = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(left)
    kept = joined.withColumn("_left", text).where(F.col("_removed").isNull() | (F.trim("_left") != ""))
    columns = {"text": F.col("_left"), "n_chars": F.char_length("_left").cast("long")}
    return kept.select(*[
        (F.when(F.col("_removed").isNull(), F.col(f"_row.`{c}`")).otherwise(columns[c]) if c in columns else F.col(f"_row.`{c}`"))
        .alias(c) for c in docs.columns])
