"""Line de-duplication by a segment-partition edit join (operator 3).

Two lines within ``threshold`` edits share, if one is cut into threshold + 1
segments, at least one segment unchanged.  So every line is indexed under its
segments (with length and segment number), and probes, for each shorter or equal
length the threshold allows, only those of its substrings that can face a segment:
the starts that leave at most the allowed edits on the left and on the right.
Signature keys held by one line only are dropped before any pair is formed.  The join
of index and probes also compares two 64-bit parity masks (characters, pairs of
characters), of which an edit can flip only a few bits, so lines that merely share a
segment make no pair.  Pairs are verified by a banded bit-parallel edit distance.

A line occurrence goes if an equal line, or a line within the threshold, stands
earlier in (doc_id, line) order.  The first of each kind stays.  Lines shorter than
``min_chars`` characters are left alone.

Two edits make one short line of many unrelated ones, so the threshold may follow the
length: with ``chars_per_edit`` two lines may differ by one edit for each so many
characters of the shorter one, ``threshold`` at most.  Lines are then joined in a band of
lengths for each number of edits, with that many segments and one more.  Lines too short
for any edit are compared for equality only, if they are not blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.scratch import stored

SMALL = 1_000_000  # rows of one or two longs that may be broadcast
WIDE = 200_000     # rows with the first place of a line


def signature_kinds(threshold: int) -> list[tuple[int, int, int, bool]]:
    """(segment, shorter, shift, probe) of every signature a line has: its own
    segments, and the substrings that can face segment ``segment`` of a line that is
    ``shorter`` characters shorter, ``shift`` places from where it stands there.

    ``segment`` segments stand to the left: at most as many edits there, and at most
    threshold - segment on the right, where the lengths differ by ``shorter``.
    """
    own = [(i, 0, 0, False) for i in range(threshold + 1)]
    probes = [(i, d, shift, True) for d in range(threshold + 1) for i in range(threshold + 1)
              for shift in range(max(-i, d - (threshold - i)), min(i, d + (threshold - i)) + 1)]
    # A line's own segments are also its probes for lines of its length, unshifted.
    return own + [k for k in probes if k[1:3] != (0, 0)]


def signatures(lines: DataFrame, threshold: int) -> DataFrame:
    """(_h, key, probe) for lines (_h, _line, _n characters).

    Segments have even sizes, the longer ones last.  The kinds are exploded first and
    one small expression makes the key of each, which compiles to a short loop.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(d).alias("d"), F.lit(x).alias("shift"), F.lit(p).alias("probe"))
                      for i, d, x, p in signature_kinds(threshold)])
    pieces = threshold + 1
    seg, length = F.col("s.seg"), F.col("_n") - F.col("s.d")
    short = F.call_function("div", length, F.lit(pieces)).cast("int")
    even = F.lit(pieces) - (length - short * pieces)  # segments without an extra character
    start = short * seg + F.greatest(F.lit(0), seg - even) + F.col("s.shift")
    size = short + F.when(seg >= even, 1).otherwise(0)
    rows = lines.select("_h", "_line", "_n", F.explode(kinds).alias("s"))
    rows = rows.where((start >= 0) & (size > 0) & (start + size <= F.col("_n")))
    return rows.select("_h", F.xxhash64(length, seg, F.substring("_line", start + 1, size)).alias("key"),
                       F.col("s.probe").alias("probe"))


def masks(line: Column) -> Column:
    """Parity masks of a line: bit c mod 64 for each character with code c, and the
    same for each pair of neighbours.  One edit flips at most 2 and 4 bits."""
    codes = F.transform(F.split(line, ""), lambda c: F.ascii(c))

    def parity(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))))

    def both(c: Column) -> Column:
        pairs = F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.size(c)), lambda x, y: x * 31 + y)
        return F.struct(parity(c).alias("one"), parity(pairs).alias("two"))

    return let(codes, both)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two character arrays is at most ``threshold``."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: _within(v["a"], v["b"], threshold))


def _within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two character arrays is at most ``threshold``.

    Bit d + threshold of word e says: the first i characters of ``a`` and the first
    i + d of ``b`` are at most e edits apart.  One character of ``a`` moves all
    diagonals of the band at once: equal characters keep a bit, a substitution takes
    it from word e - 1, a deletion also shifts it right, an insertion left.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1

    def bits(e: int) -> int:  # before any character of a: d insertions
        return sum(1 << (d + threshold) for d in range(e + 1))

    names = [f"r{e}" for e in range(threshold + 1)]
    start = F.struct(*[F.lit(bits(e)).alias(names[e]) for e in range(threshold + 1)])

    def match(own: Column, i: Column) -> Column:
        """The diagonals on which character i of ``a`` equals the one of ``b``."""
        mask = None
        for d in range(-threshold, threshold + 1):
            at = i + d
            bit = F.when((at >= 0) & (F.get(b, F.greatest(at, F.lit(0))) == own), 1 << (d + threshold)).otherwise(0)
            mask = bit if mask is None else mask + bit
        return mask

    end = F.aggregate(F.transform(a, match), start, lambda state, mask: _rows(state, mask, names, full), lambda state: state[names[-1]])
    last = F.size(b) - F.size(a)
    reached = F.call_function("shiftright", end, last + threshold).bitwiseAND(F.lit(1)) == 1
    return (F.when(F.abs(last) > threshold, F.lit(False)).when(F.size(a) == 0, F.lit(True))
            .when((F.size(a) <= threshold) & (F.size(b) <= threshold), F.lit(True)).otherwise(reached))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings, by halving steps: at each step the
    next ``s`` characters are skipped if they are equal in both."""
    most = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double"))).cast("int")),
                        lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.aggregate(F.reverse(steps), F.lit(0), lambda at, s: F.when(
        (at + s <= most) & (F.substring(a, at + 1, s) == F.substring(b, at + 1, s)), at + s).otherwise(at))


def lines_within(x: Column, y: Column, threshold: int) -> Column:
    """Whether two lines are within ``threshold`` edits.

    What both begin and end with cannot matter and is cut off first; the distance is
    computed on what lies between.
    """
    def both(a: Column, b: Column) -> Column:
        return F.struct(a.alias("x"), b.alias("y"))

    def characters(c: Column) -> Column:
        return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))

    def without_prefix(body: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda v: let(common_prefix(v["x"], v["y"]), lambda p: let(
            both(F.substring(v["x"], p + 1, F.length(v["x"])), F.substring(v["y"], p + 1, F.length(v["y"]))), body))

    middle = without_prefix(lambda v: within(characters(v["x"]), characters(v["y"]), threshold))
    return let(both(x, y), without_prefix(lambda v: let(both(F.reverse(v["x"]), F.reverse(v["y"])), middle)))


def _rows(state: Column, match: Column, names: list[str], full: int) -> Column:
    """The words after one character, word 0 first; each needs the one before."""
    out = []
    for e, name in enumerate(names):
        row = state[name].bitwiseAND(match)
        if e:
            old = state[names[e - 1]]
            inserted = F.shiftleft(out[-1], 1).bitwiseAND(F.lit(full))
            row = row.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(inserted)
        out.append(row)
    return F.struct(*[c.alias(n) for c, n in zip(out, names)])


def _bounded(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A broadcast hint if the stored table is small enough; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def length_bands(threshold: int, near_from: int, chars_per_edit: int | None) -> list[tuple[int, int, int | None]]:
    """(edits, least, most length) of the joins: two lines that may differ by ``edits``
    meet in that band.  The shorter of them has at least ``least`` characters and, unless
    it is the last band, too few for one edit more."""
    if chars_per_edit is None:
        return [(threshold, near_from, None)]
    out = [(threshold, max(near_from, threshold * chars_per_edit, threshold + 1), None)]
    for e in range(threshold - 1, 0, -1):
        least = max(near_from, e * chars_per_edit, e + 1)
        if least < (e + 1) * chars_per_edit:
            out.append((e, least, (e + 1) * chars_per_edit - 1 + e))
    return out


def near_lines(lines: DataFrame, edits: int, least: int, most: int | None, below: int | None) -> DataFrame:
    """(a, b): distinct lines of ``least`` to ``most`` characters within ``edits`` edits; with
    ``below`` only pairs whose shorter line has fewer characters than that."""
    long = lines.where(F.col("_n") >= least)
    if most is not None:
        long = long.where(F.col("_n") <= most)
    signed = signatures(long, edits)
    # Signature keys that at least two different lines hold.
    shared = stored(signed.groupBy("key").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"), F.min("probe").alias("probes_only"))
                    .where("lo < hi AND NOT probes_only").select("key"), "line-keys")
    held = stored(signed.join(_bounded(shared), "key", "left_semi").groupBy("key", "probe", "_h").agg(F.lit(1).alias("x"))
                  .drop("x"), "line-signatures")
    wanted = stored(held.select("_h").distinct(), "line-wanted")
    texts = stored(long.join(_bounded(wanted), "_h", "left_semi").groupBy("_h").agg(F.first("_line").alias("line"))
                   .withColumn("m", masks(F.col("line"))), "line-texts")
    held = stored(held.join(texts.select("_h", "m"), "_h"), "line-masks")
    index = held.where("NOT probe").select("key", F.col("_h").alias("i"), F.col("m").alias("mi"))
    probes = held.select(F.col("key").alias("k"), F.col("_h").alias("j"), F.col("m").alias("mj"))
    flips = lambda f: F.bit_count(F.col(f"mi.{f}").bitwiseXOR(F.col(f"mj.{f}")))
    meet = ((F.col("key") == F.col("k")) & (F.col("i") != F.col("j"))
            & (flips("one") <= 2 * edits) & (flips("two") <= 4 * edits))
    pairs = stored(index.join(probes, meet)
                   .groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.lit(1).alias("x")).drop("x"),
                   "line-pairs")
    candidates = (pairs.join(texts.select(F.col("_h").alias("a"), F.col("line").alias("x")), "a")
                  .join(texts.select(F.col("_h").alias("b"), F.col("line").alias("y")), "b"))
    if below is not None:
        candidates = candidates.where(F.least(F.length("x"), F.length("y")) < below)
    return stored(candidates.where(lines_within(F.col("x"), F.col("y"), edits)).select("a", "b"), "line-near")


def removed_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 20, key: str = "doc_id",
                  text: str = "text", near_chars: int | None = None, chars_per_edit: int | None = None) -> DataFrame:
    """(_row, removed): for each row identity the numbers (from 0) of its lines that go.

    ``_row`` is the hash of id and text: rows equal in both lose the same lines.
    """
    body = F.col(f"`{text}`").cast("string")
    base = docs.select(F.col(f"`{key}`").alias("_id"), F.xxhash64(F.col(f"`{key}`"), body).alias("_row"),
                       F.posexplode(F.split(body, "\n")).alias("_no", "_line"))
    # The length is counted once, as a column: the signatures refer to it many times.
    near_from = max(min_chars if near_chars is None else near_chars, 2 if chars_per_edit else threshold + 1)
    bands = length_bands(threshold, near_from, chars_per_edit)
    equal_only = min(least for _, least, _ in bands)
    counted = (F.col("_n") >= equal_only) | ((F.col("_n") >= min_chars) & F.col("_line").rlike(r"[^\x20\x09-\x0D]"))
    lines = base.withColumn("_n", F.length("_line")).where(counted).select(
        "_id", "_row", "_no", "_line", "_n", F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(7), F.col("_line")).alias("_g"))

    # Every distinct line with its first place and its number of places.
    known = stored(lines.groupBy("_h", "_g").agg(F.min(F.struct("_id", "_row", "_no")).alias("first"),
                                                 F.count(F.lit(1)).alias("n")), "lines")
    near = None
    for edits, least, most in bands:
        found = near_lines(lines, edits, least, most, None if most is None else (edits + 1) * chars_per_edit)
        near = found if near is None else near.unionByName(found)
    # Of two near lines the one whose first place is later goes everywhere.
    first = known.select("_h", "first")
    places = (_bounded(near).join(first.select(F.col("_h").alias("a"), F.col("first").alias("fa")), "a")
              .join(first.select(F.col("_h").alias("b"), F.col("first").alias("fb")), "b"))
    late = stored(places.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("_h")).distinct()
                  .withColumn("late", F.lit(True)), "line-late")
    doomed = stored(known.join(_bounded(late), "_h", "left").where("n > 1 OR late")
                    .select("_h", "_g", "first", F.coalesce("late", F.lit(False)).alias("late")), "line-doomed")
    place = F.struct("_id", "_row", "_no")
    return (lines.select("_id", "_row", "_no", "_h", "_g").join(_bounded(doomed, WIDE), ["_h", "_g"])
            .where(F.col("late") | ~place.eqNullSafe(F.col("first")))
            .groupBy("_row").agg(F.sort_array(F.collect_set("_no")).alias("removed")))


def dedup_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 20, key: str = "doc_id",
                text: str = "text", near_chars: int | None = None, chars_per_edit: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, plus n_lines and
    removed_lines (their numbers from 0).

    ``near_chars`` (``min_chars`` if None) is the length from which lines are also
    compared by edit distance; ``chars_per_edit`` lets the threshold follow the length of
    the shorter line (None: ``threshold`` edits at any length).  Whole texts are read; a text without removed lines is returned as it was, and a
    text whose lines all go becomes empty.  Null text: null, 0 lines.  Rows are kept
    one to one; rows equal in id and text lose the same lines; null ids sort first.
    Columns named n_lines or removed_lines are replaced.  An empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    gone = removed_lines(docs, threshold, min_chars, key, text, near_chars, chars_per_edit)
    body = F.col(f"`{text}`").cast("string")
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(F.col(f"`{key}`"), body).alias("_row")) \
              .join(gone, "_row", "left")
    out = out.withColumn("_parts", F.split(body, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("removed"))
    cleaned = F.when(F.col("removed").isNull(), body).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_parts", i)), "\n"))
    return out.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in kept],
                      F.when(body.isNull(), 0).otherwise(F.size("_parts")).alias("n_lines"),
                      F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))
