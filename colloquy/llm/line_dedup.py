"""Near-duplicate removal of lines by a segment-partition edit join, in DataFrame functions only.

A line, with its white space collapsed, is dropped if an earlier one (by document id, the text's
hash and position) is equal or within two edits.

Segments: lines are binned by length, eight lengths a bin, and each bin has t + 1 disjoint
segments for t edits: the first half of them counted from a line's start, the others from its
end. Of two lines within t edits one segment is whole in both, at a place that differs by no more
than the number of segments between it and the nearer end; so each line has a key for each
segment and each such place, of its own bin and, if a line t characters shorter may be in the
next lower bin, of that one too. Near lines share a key.

The lines are read once and stored with their keys. Keys that several different lines have are
counted first; only lines on these go on. Where many lines share a key, it is refined by the
keys of a second partition, with other lengths, of which near lines share one as well. The rest
meet in a semi join, which ends at the first earlier line that is near and never gives pairs.
The parities of their counts of characters and neighbours, and short pieces of both lines, rule
most pairs out; what the others have between their common ends is
verified by a banded bit-parallel edit distance in 64-bit arithmetic.

Lines of fewer than `least` characters take no part in the edit join, as two edits are too large
a part of them; with `short` they are dropped if an earlier line is equal, else they stay. Blank
lines always stay.

Tables are broadcast only after a count has shown them to be small; beyond that they are joined
by exchanges, which adaptive execution can split at a common line: no join is followed by a step
that needs its partitioning.

Defined results: a null text stays null and has no lines; a text that loses all lines becomes
empty; rows that repeat id and text count as one document and get the same lines; rows with a
null id come last in order; an empty table gives an empty result; other columns are kept as they
are, whatever their names (names that begin with `__line_` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sized, stored, table

EDITS = 2
LEAST = 20
BIN = 8  # lengths that share segments
CROWD = 2048  # lines on a key from which it is refined
#: Shares of a line that the outer segments have together, in twentieths, for the two partitions of three segments.
_OUTER = (14, 18)


def collapsed(raw: Column) -> Column:
    """White space collapsed; most lines have none to collapse and cost no pattern."""
    odd = F.lit(False)
    for mark in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd |= F.contains(raw, F.lit(mark))
    return F.trim(F.when(odd, F.regexp_replace(raw, r"\s+", " ")).otherwise(raw))


def _segments(base: Column, edits: int, outer: int) -> list[tuple[Column, Column]]:
    """Start and length of each segment of a bin whose least length is `base`."""
    if not edits:
        return [(F.lit(0), base)]
    if edits == 2:
        side = F.floor(base * outer / 40)
        return [(F.lit(0), side), (side, base - 2 * side), (base - side, side)]
    cut = lambda k: F.floor(base * k / (edits + 1))
    return [(cut(k), cut(k + 1) - cut(k)) for k in range(edits + 1)]


def keys(line: Column, n: Column, edits: int, outer: int = _OUTER[0]) -> Column:
    """array<bigint> of a line's keys."""

    def of_bin(number: Column) -> list[Column]:
        out = []
        base = number * BIN
        for k, (start, length) in enumerate(_segments(base, edits, outer)):
            reach = min(k, edits - k)
            begin = start if 2 * k <= edits else n - base + start  # the later ones keep their place from the end
            for shift in range(-reach, reach + 1):
                out.append(F.xxhash64(F.lit(outer * 10 + k), number, F.substring(line, (begin + shift + 1).cast("int"), length.cast("int"))))
        return out

    number = F.floor(n / BIN)
    own, lower = F.array(*of_bin(number)), F.array(*of_bin(number - 1))
    return F.when((F.pmod(n, F.lit(BIN)) < edits) & (number > 1), F.concat(own, lower)).otherwise(own)


def lines_of(docs: DataFrame, id_col: str, text_col: str, least: int, short: bool, edits: int) -> DataFrame:
    """One row per line: its place (id, text's hash, position), two hashes, its length and, from `least` characters, its text and keys."""
    at = F.posexplode(F.split(F.col("__line_text"), "\n", -1)).alias("pos", "raw")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__line_text")).withColumn("doc", F.xxhash64("__line_text"))
    found = rows.select("id", "doc", at).withColumn("line", collapsed(F.col("raw"))).withColumn("n", F.length("line")).filter(F.col("n") >= (1 if short else least))
    long = F.col("n") >= least
    return found.select(
        F.struct(F.col("id").isNull().alias("late"), "id", "doc", "pos").alias("place"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2"), "n",
        F.when(long, F.col("line")).alias("line"), F.when(long, keys(F.col("line"), F.col("n"), edits)).alias("keys"),
    )


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two strings whose lengths differ by `edits` at most; beyond it, more than edits.

    Bit-parallel over a band of 2 * edits + 1 diagonals: bit i of a word is the diagonal
    i - edits. `vp` and `vn` mark where the distance rises and falls down a column; a step takes
    the next character of b, and the distance is followed along the lowest diagonal, then, when
    a's end is reached, up the last row.
    """
    return F.element_at(banded(a, b, edits), 1)


def banded(a: Column, b: Column, edits: int) -> Column:
    """The distance in an array of one element, which binds the characters, so that no step splits the strings again."""
    split = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    return F.transform(F.array(F.struct(split(a).alias("a"), split(b).alias("b"))), lambda s: _banded(s["a"], s["b"], edits))


def _banded(chars_a: Column, chars_b: Column, edits: int) -> Column:
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    la, lb = F.size(chars_a), F.size(chars_b)

    def step(state: Column, j: Column) -> Column:
        """j counts the characters of b from 1."""
        c = F.get(chars_b, j - 1)
        match = F.lit(0).cast("long")
        for bit in range(width):
            row = j - 1 - edits + bit
            same = F.when(row < 0, F.lit(False)).otherwise(F.coalesce(F.get(chars_a, row) == c, F.lit(False)))
            match = match.bitwiseOR(F.when(same, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return _advance(state, match, j)

    def _advance(state: Column, match: Column, j: Column) -> Column:
        one = F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), state["d"].alias("d"), match.alias("m"))
        keep = lambda x: x.bitwiseAND(full)
        flip = lambda x: x.bitwiseXOR(full)
        add = lambda s: keep(s["m"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(s["m"]).bitwiseOR(s["vn"])
        with_d0 = F.transform(F.array(one), lambda s: F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), add(s).alias("d0")))
        with_h = F.transform(with_d0, lambda s: F.struct(s["d"].alias("d"), s["d0"].alias("d0"), s["vn"].bitwiseOR(flip(s["d0"].bitwiseOR(s["vp"]))).alias("hp"), s["d0"].bitwiseAND(s["vp"]).alias("hn")))
        past = j + edits - la  # rows that the band's lowest diagonal is past a's end
        last = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.lit(width - 1) - past).cast("int"))

        def out(s: Column) -> Column:
            down = F.shiftrightunsigned(s["d0"], 1)
            diagonal = F.when(s["d0"].bitwiseAND(top) == 0, 1).otherwise(0)
            across = F.when(s["hp"].bitwiseAND(last) != 0, 1).when(s["hn"].bitwiseAND(last) != 0, -1).otherwise(0)
            return F.struct(
                s["hn"].bitwiseOR(flip(down.bitwiseOR(s["hp"]))).alias("vp"),
                down.bitwiseAND(s["hp"]).alias("vn"),
                (s["d"] + F.when(past <= 0, diagonal).otherwise(across)).cast("int").alias("d"),
            )

        return F.element_at(F.transform(with_h, out), 1)

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(edits), la).cast("int").alias("d"))
    return F.when((la == 0) | (lb == 0), la + lb).otherwise(F.aggregate(F.sequence(F.lit(1), lb), start, step, lambda s: s["d"]))


def parities(line: Column) -> tuple[Column, Column]:
    """Bits for 64 classes of characters, and of pairs of neighbours: whether their count is odd.

    An edit changes two characters' counts at most, and four pairs'.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63))
    xor = lambda bits: F.aggregate(bits, F.lit(0).cast("long"), lambda x, b: x.bitwiseXOR(b))
    codes = F.array(F.transform(F.split(line, ""), F.ascii))
    singles = F.transform(codes, lambda c: xor(F.transform(c, bit)))
    pairs = F.transform(codes, lambda c: xor(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: bit(a * 37 + b * 11))))
    return F.element_at(singles, 1), F.when(F.length(line) > 1, F.element_at(pairs, 1)).otherwise(F.lit(0).cast("long"))


def trimmed(a: Column, b: Column) -> Column:
    """array<struct<a, b>> of one element: both strings without their common beginning and end, by
    halving steps. Their distance is the same."""

    def common(x: Column, y: Column, most: Column) -> Column:
        same = lambda p, k: F.substring(x, p + 1, k) == F.substring(y, p + 1, k)
        power = lambda k: F.call_function("shiftleft", F.lit(1), k)
        steps = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))
        return F.aggregate(steps, F.lit(0), lambda p, k: F.when((p + power(k) <= most) & same(p, power(k)), p + power(k)).otherwise(p))

    both = F.least(F.length(a), F.length(b))
    begun = F.transform(F.array(common(a, b, both)), lambda p: F.struct(F.substring(a, p + 1, F.length(a)).alias("a"), F.substring(b, p + 1, F.length(b)).alias("b")))
    ends = lambda s: common(F.reverse(s["a"]), F.reverse(s["b"]), F.least(F.length(s["a"]), F.length(s["b"])))
    cut = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)
    with_ends = F.transform(begun, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), ends(s).alias("n")))
    return F.transform(with_ends, lambda s: F.struct(cut(s["a"], s["n"]).alias("a"), cut(s["b"], s["n"]).alias("b")))


def may_be_near(a: Column, b: Column, edits: int, window: int = 32) -> Column:
    """False only for strings that are more than `edits` apart: pieces of both from the same place
    are within twice the edits of each other if the strings are within them.

    The pieces are short, as the time of Spark's own distance grows with the square of the length.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(window))
    return F.forall(starts, lambda k: F.levenshtein(F.substring(a, k, F.lit(window)), F.substring(b, k, F.lit(window)), 2 * edits) >= 0)


def within(a: Column, b: Column, edits: int, window: int = 32) -> Column:
    """Whether two strings are within `edits`: the banded bit-parallel distance of what is left of
    them between their common ends, unless their outer pieces or a look at that rule it out."""
    near = lambda x, y: F.levenshtein(x, y, 2 * edits) >= 0
    outer = near(F.substring(a, 1, window), F.substring(b, 1, window)) & near(F.substring(a, -window, window), F.substring(b, -window, window))
    short = lambda s: F.length(s["a"]) <= 4 * window
    guess = lambda s: F.when(short(s), F.levenshtein(s["a"], s["b"], edits) >= 0).otherwise(may_be_near(s["a"], s["b"], edits, window))
    sure = F.transform(trimmed(a, b), lambda s: guess(s) & (F.element_at(banded(s["a"], s["b"], edits), 1) <= edits))
    return outer & F.element_at(sure, 1)


def near_lines(lines: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """h and h2 of different lines that have an earlier one within `edits`."""
    keyed = lines.filter(F.col("keys").isNotNull()).select("h", F.explode("keys").alias("key"))
    crowds = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")
    crowds = stored(crowds, "line-keys")
    kept = stored(keyed.join(sized(crowds, crowds.count()), "key", "left_semi").distinct(), "line-rows")
    ids = stored(kept.select("h").distinct(), "line-met")
    met = stored(firsts.join(sized(ids, n := ids.count()), "h", "left_semi").select("h", "h2", F.col("place").alias("first")), "line-firsts")
    # the text of each different line on a shared key: at its first place alone
    firsts_only = lines.join(sized(met, n), ["h", "h2"]).filter(F.col("place") == F.col("first")).select("h", "h2", "first", "line", "n")
    once = stored(firsts_only, "line-copies").groupBy("h", "h2").agg(F.min("first").alias("first"), F.min("line").alias("line"), F.min("n").alias("n"))
    odd, odd_pairs = parities(F.col("line"))
    texts = stored(once.select("*", odd.alias("odd"), odd_pairs.alias("odd_pairs")), "line-texts")
    sizes = kept.groupBy("key").agg(F.count("*").alias("size"))
    chars = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    rows = kept.join(sizes, "key").join(sized(texts, n + chars // 50), "h")
    finer = F.transform(F.array_distinct(keys(F.col("line"), F.col("n"), edits, _OUTER[1])), lambda k: F.xxhash64("key", k))
    rows = stored(rows.withColumn("key", F.explode(F.when(F.col("size") > CROWD, finer).otherwise(F.array("key")))).drop("size"), "line-cells")
    one, two = rows.alias("x"), rows.alias("y")
    differ = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    near = (
        (F.col("x.key") == F.col("y.key"))
        & (F.abs(F.col("x.n") - F.col("y.n")) <= edits)
        & (differ("odd") <= 2 * edits)
        & (differ("odd_pairs") <= 4 * edits)
        & (F.col("y.first") < F.col("x.first"))
        & within(F.col("y.line"), F.col("x.line"), edits)
    )
    return one.join(two, near, "left_semi").select("h", "h2").distinct()


def decisions(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """One row per line that goes: id, doc (hash of its text), pos."""
    lines = stored(lines_of(docs, id_col, text_col, least, short, edits), "lines")
    firsts = stored(lines.groupBy("h", "h2").agg(F.min("place").alias("place"), F.count("*").alias("copies")), "line-classes")
    near = stored(near_lines(lines, firsts, edits), "line-near") if edits else firsts.select("h", "h2").limit(0)
    # of a class with near earlier lines all copies go, of another all but the first
    going = firsts.join(sized(near.withColumn("near", F.lit(True)), near.count()), ["h", "h2"], "left").filter("copies > 1 OR near")
    going = stored(going.select("h", "h2", F.when(F.col("near").isNull(), F.col("place")).alias("kept")), "line-going")
    gone = lines.select("h", "h2", "place").join(sized(going, going.count()), ["h", "h2"]).filter(F.col("kept").isNull() | (F.col("place") != F.col("kept")))
    return gone.select("place.id", "place.doc", "place.pos").distinct()


def without(text: Column, gone: Column) -> Column:
    """A text without the lines at sorted positions (from 0): the slices between them."""

    def left(lines: Column, cuts: Column) -> Column:
        between = lambda k: F.slice(lines, F.get(cuts, k) + 2, F.get(cuts, k + 1) - F.get(cuts, k) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), between))

    # arrays of one element bind the lines and the cuts, so that no step splits the text again
    bound = F.transform(F.array(F.split(text, "\n", -1)), lambda x: F.struct(x.alias("lines"), F.concat(F.array(F.lit(-1)), gone, F.array(F.size(x))).alias("cuts")))
    return F.array_join(F.element_at(F.transform(bound, lambda s: left(s["lines"], s["cuts"])), 1), "\n")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """docs with the lines that go taken out of the text; one more column, `__line_dropped`, counts them."""
    gone = decisions(docs, edits, least, id_col, text_col, short).groupBy("id", "doc").agg(F.array_sort(F.collect_list("pos")).alias("__line_gone"))
    gone = stored(gone.select(F.col("id").alias("__line_id"), F.col("doc").alias("__line_doc"), "__line_gone"), "line-gone")
    size = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("__line_gone")), F.lit(0)).alias("lines")).first()
    rows = docs.withColumn("__line_key", F.xxhash64(F.col(text_col)))
    joined = rows.join(sized(gone, size.rows + size.lines // 8), F.col(id_col).eqNullSafe(F.col("__line_id")) & (F.col("__line_key") == F.col("__line_doc")), "left")
    text = F.when(F.col("__line_gone").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col("__line_gone")))
    dropped = F.coalesce(F.array_size("__line_gone"), F.lit(0)).cast("long")
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), dropped.alias("__line_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_dropped, the text that is left and its length."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return found.select("doc_id", F.col("__line_dropped").alias("n_dropped"), F.length("text").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))
