"""SimHash near-duplicate detection with a pigeonring filter.

Fingerprints: words are runs of other than ASCII white space in the text with A-Z lower-cased;
each shingle of words, repeats included, is hashed; a bit of the fingerprint is set if it is set
in over half the hashes. Two fingerprints link if they differ in at most `k` bits.

Search: equal fingerprints become one record first. The bits are split into segments on a ring,
two more than k, so that linked fingerprints agree in two whole segments at least; each pair of
segments gives a blocking key. Records that share one are candidates, of which the pigeonring
keeps those with a chain of segments whose differences, added up along the ring, stay within
l * k / m after each l segments; a full Hamming check follows. Within a block only the edges of
a spanning forest are kept, so that a dense group doesn't give all its pairs; connections are
the same. Blocks beyond a size get finer keys: the bits outside the block's two segments are cut
into one piece more than k, of which linked fingerprints agree in one at least. What is beyond
the size even so is cut into parts, and each pair of parts is a task of its own.

Defined results: a null text counts as empty; a text without words has the fingerprint zero and
links like any other; rows that repeat a doc_id are each returned; rows with a null doc_id take
part, but never name a component unless all its rows have none; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import forget, let_go, sized, stored, stored_since, table, text_batches

#: Records of a block that one task compares with each other or with as many others.
PART = 2048


def hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """The unsigned hashes of all shingles in order."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    return np.fromiter((digest(view[a:b], seed) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(found) - words + 1)


def fingerprint(h: np.ndarray) -> int:
    """As a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # a bounded part at a time
        part = np.ascontiguousarray(h[k : k + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    @F.pandas_udf("bigint")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(hashes(t, shingle, seed)) for t in texts], dtype="int64")

    return found(text)


class Ring:
    """Segments of the bits of fingerprints on a ring, for a threshold of k differing bits.

    There are two more than k. `keys` are masks of the bits of all pairs of segments, of which one
    is always the same in both; `finer` has, for each, masks of pieces of the other bits.
    """

    def __init__(self, k: int) -> None:
        self.k, self.m = k, k + 2
        cuts = [round(64 * s / self.m) for s in range(self.m + 1)]
        masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.segments = [np.uint64(mask) for mask in masks]
        self.keys = [masks[a] | masks[b] for a, b in combinations(range(self.m), 2)]
        self.finer = []
        for key in self.keys:
            rest = [1 << b for b in range(64) if not key >> b & 1]
            ends = [round(len(rest) * s / (k + 1)) for s in range(k + 2)]
            self.finer.append([sum(rest[a:b]) for a, b in zip(ends, ends[1:], strict=False)])

    def near(self, x: np.ndarray) -> np.ndarray:
        """Of differing bits (xor of fingerprints): whether at most k are set."""
        at = np.flatnonzero(self.chained(x))
        out = np.zeros(len(x), bool)
        out[at] = np.bitwise_count(x[at]) <= self.k
        return out

    def chained(self, x: np.ndarray) -> np.ndarray:
        """Whether, from some segment on, the first l differ in at most l * k / m bits for every l."""
        counts = [np.bitwise_count(x & mask).astype(np.int16) for mask in self.segments]
        found = np.zeros(len(x), bool)
        for first in range(self.m):
            at = np.flatnonzero(~found & (counts[first] * self.m <= self.k))
            total = counts[first][at]
            for more in range(1, self.m):
                if not len(at):
                    break
                total = total + counts[(first + more) % self.m][at]
                good = total.astype(np.int32) * self.m <= (more + 1) * self.k
                at, total = at[good], total[good]
            found[at] = True
        return found


def forest(ids: np.ndarray, fps: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """The edges, by id, of a spanning forest of the linked fingerprints."""
    left, a, b = np.arange(len(ids)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = ring.near(fps[left] ^ fps[one])
            if near.any():
                b.append(ids[left[near]])
                a.append(np.full(len(b[-1]), ids[one]))
                front.extend(left[near].tolist())
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def _linked(cell: np.ndarray, ids: np.ndarray, fps: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the runs of equal cells."""
    bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    sizes = np.diff(bounds)
    a, b = [ids[:0]], [ids[:0]]
    small = np.repeat(sizes <= 32, sizes)
    for shift in range(1, 32):
        at = np.flatnonzero(small[shift:] & (cell[shift:] == cell[:-shift]))
        if not len(at):
            break
        for k in range(0, len(at), 1 << 17):
            part = at[k : k + (1 << 17)]
            part = part[ring.near(fps[part] ^ fps[part + shift])]
            a.append(ids[part])
            b.append(ids[part + shift])
    for k in np.flatnonzero(sizes > 32):
        x, y = forest(ids[bounds[k] : bounds[k + 1]], fps[bounds[k] : bounds[k + 1]], ring)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, ring: Ring) -> DataFrame:
    """Edges a, b between fingerprints that connect all that link. distinct: id (long), all different."""
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    key = lambda n, mask: F.struct(F.xxhash64(F.lit(n), F.col("id").bitwiseAND(signed(mask))).alias("key"), F.lit(n).alias("kind"))
    keyed = distinct.select("id", F.explode(F.array(*(key(n, mask) for n, mask in enumerate(ring.keys)))).alias("k")).select("id", "k.*")
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(keyed.join(crowds, "key"), "fingerprint-keys")
    pieces = F.get(F.array(*(F.array(*map(signed, masks)) for masks in ring.finer)), F.col("kind"))
    finer = F.transform(pieces, lambda m: F.xxhash64("key", m, F.col("id").bitwiseAND(m)))
    fine = shared.filter(F.col("n") > PART).select("id", F.explode(finer).alias("key"))
    sizes = fine.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    every = shared.filter(F.col("n") <= PART).select("id", "key", F.lit(1).alias("parts")).union(fine.join(sizes, "key").select("id", "key", "parts"))
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, part).alias("x"), F.greatest(o, part).alias("y")))
    cells = every.select("id", "key", F.explode(others).alias("c")).select(F.xxhash64("key", "c.x", "c.y").alias("cell"), "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def edges(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b = _linked(cols[0], cols[1], cols[1].view(np.uint64), ring)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on in the next batch
            held = [c[last:] for c in cols]
            if last:
                yield from edges([c[:last] for c in cols])
        if held is not None:
            yield from edges(held)

    return cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(search, "a long, b long")


def component_of(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """id, component_id: the smallest doc_id among all classes that are connected. classes: id, doc_id.

    No step after a join needs its partitioning, so that a large component can be split.
    """
    placed = stored(classes.join(roots, F.col("id") == F.col("node"), "left").select("id", "doc_id", F.coalesce("root", "id").alias("root")), "classes")
    least = stored(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return stored(placed.join(sized(least), "root").select("id", "component_id"), "components")


def near_duplicates(docs: DataFrame, k: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint as 16 hex digits, component_id."""
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle, seed).alias("id")), "fingerprints")
    classes = stored(rows.groupBy("id").agg(F.min("doc_id").alias("doc_id")), "fingerprint-classes")
    found = component_of(classes, components(links(classes.select("id"), Ring(k))))
    return rows.join(sized(found), "id").select("doc_id", F.lower(F.lpad(F.hex("id"), 16, "0")).alias("fingerprint"), "component_id")


#: Documents of the sample in which words and common shingles are counted, and the most of each that are held.
SAMPLED, COMMON, KNOWN = 20_000, 200_000, 50_000


#: Parts by hash of which a sketch counts a set's members.
CELLS = 128


def sketched(h: np.ndarray) -> dict:
    """A set of hashes and how many fall into each of the cells, a byte each; no sketch if one has more."""
    h = np.unique(h)
    counts = np.bincount((h >> np.uint64(57)).astype(np.int64), minlength=CELLS)
    return {"set": h.view(np.int64), "sketch": counts.astype(np.uint8).tobytes() if counts.max() < 256 else None}


def table_of(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of counts for each sketch, and which there are."""
    found = sketches.to_pylist()
    rows = np.frombuffer(b"".join(x if x is not None else bytes(CELLS) for x in found), np.uint8).reshape(-1, CELLS)
    return rows, np.array([x is not None for x in found], bool)


def may_be_similar(x: np.ndarray, there_x: np.ndarray, n: np.ndarray, y: np.ndarray, there_y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False only for pairs of sets of sizes n and m whose similarity is below 0.8: two sets share
    no more members than the lesser counts of their sketches add up to."""
    return ~(there_x & there_y) | (9 * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= 4 * (n + m))


def _ruled_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs a, b, n_a, n_b, sketch_a, sketch_b those that their sketches don't rule out."""
    for batch in batches:
        a, b, n, m = (batch.column(k).to_numpy() for k in range(4))
        keep = may_be_similar(*table_of(batch.column(4)), n.astype(np.int64), *table_of(batch.column(5)), m.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b)], names=["a", "b"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Order:
    """An order of all shingles, the same for each text: first those whose words are rare in a sample,
    common shingles of the sample last. It only says which shingles are tried first."""

    #: Halvings of a word's share that count at most; a word that the sample hasn't has one more.
    MOST = 24

    def __init__(self, words: dict[bytes, int], common: np.ndarray) -> None:
        total = sum(words.values())
        self.rare = {w: min(self.MOST, int(np.log2(total / n))) for w, n in words.items()}
        self.common = common

    def prefix(self, text: str | None, h: np.ndarray, shingle: int) -> np.ndarray:
        """Of the shingles' hashes those of which two sets of Jaccard similarity 0.8 share one: of
        n different ones in order the first n - ceil(0.8 n) + 1 can't all be missing from a set
        that has 0.8 n of them."""
        if not len(h):
            return h
        rare = np.array([self.rare.get(w, self.MOST + 1) for w in (text or "").encode().lower().split()], np.int64)
        total = np.concatenate([[0], np.cumsum(rare)])
        weight = total[shingle:] - total[:-shingle] if len(rare) > shingle else total[-1:]
        keys, first = np.unique(h, return_index=True)
        late = np.zeros(len(keys), bool)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)
            late = self.common[at] == keys
        return keys[np.lexsort((keys, -weight[first], late))[: len(keys) - -(-4 * len(keys) // 5) + 1]]


def order_of(docs: DataFrame, shingle: int, seed: int, text_col: str) -> Order:
    """The order by a bounded sample of the texts."""
    share = min(1.0, SAMPLED / max(1, docs.count()))
    text = docs.select(F.col(text_col).alias("text"))
    text = text.filter(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) < share * (1 << 30))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update((t or "").encode().lower().split())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(t, shingle, seed)).view(np.int64))], names=["key"])

    words = text.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = {bytes(r.word): r.n for r in words.orderBy(F.desc("n"), "word").limit(KNOWN).collect()}
    counts = text.mapInArrow(hashed, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    common = counts.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toPandas()
    return Order(words, np.sort(common.key.to_numpy(np.int64).view(np.uint64)))


def set_id(h: np.ndarray, seed: int) -> int:
    """A hash of a set of hashes in unsigned order."""
    return _signed(xxhash.xxh64_intdigest(h.tobytes(), seed))


def judged(text: Column, order: Order, shingle: int, seed: int) -> Column:
    """struct<id, n, sketch, print, prefix>: a hash of the set of shingles, its size and sketch, the
    fingerprint, and the shingles of which similar sets share one."""
    shipped = SparkSession.getActiveSession().sparkContext.broadcast(order)

    @F.pandas_udf("id bigint, n int, sketch binary, print bigint, prefix array<bigint>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def row(t: str | None) -> dict:
            h = hashes(t, shingle, seed)
            one = sketched(h)
            kept = {"id": set_id(one["set"], seed), "n": len(one["set"]), "sketch": one["sketch"]}
            return kept | {"print": fingerprint(h), "prefix": shipped.value.prefix(t, h, shingle).view(np.int64)}

        for texts in batches:
            yield pd.DataFrame([row(t) for t in texts], columns=["id", "n", "sketch", "print", "prefix"])
        let_go()

    return found(text)


def odd_cells(h: np.ndarray) -> bytes:
    """A bit for each of two to four times as many cells as hashes, eight at least: whether it has an odd number of them."""
    cells = 1 << max(7, 2 * len(h) - 1).bit_length()
    counts = np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits(counts & 1 == 1, bitorder="little").tobytes()


def differ_at_least(x: bytes, y: bytes) -> int:
    """A number of members that are in one of two sets only, of whose odd cells each changes one at most."""
    one, two = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(two) > len(one):
        two = two[: len(two) // 2] ^ two[len(two) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def sets_of(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """id, n, set, odd of each text: the different shingles' hashes, in unsigned order, and their odd cells."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 100):
                sets = [np.unique(hashes(t, shingle, seed)) for t in batch.column(0)[k : k + 100].to_pylist()]
                sizes = [len(x) for x in sets]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                ids = [set_id(x, seed) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), flat, pa.array([odd_cells(x) for x in sets], pa.binary())], names=["id", "n", "set", "odd"])
        let_go()

    return texts.mapInArrow(found, "id long, n int, set array<long>, odd binary")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs a, b, n_a, n_b, odd_a, odd_b those that may be similar: of sets that are, at most a ninth of both sizes differs."""
    for batch in batches:
        cols = batch.to_pydict()
        keep = [9 * differ_at_least(x, y) <= n + m for n, m, x, y in zip(cols["n_a"], cols["n_b"], cols["odd_a"], cols["odd_b"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(2)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Similar:
    """Which pairs have sets with a Jaccard similarity of 0.8 at least.

    Only sketches are stored of all. Sets are made anew from the texts of pairs that their sketches
    don't rule out, and travel only with pairs that their odd cells don't rule out either.
    """

    def __init__(self, docs: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, seed: int, text_col: str) -> None:
        self.texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
        self.rows, self.classes, self.shingle, self.seed = rows, classes, shingle, seed

    def sketches(self, ids: DataFrame) -> DataFrame:
        """id, n, sketch of each of these ids."""
        ids = stored(ids.distinct(), "sketched")
        return stored(self.rows.join(sized(ids), "id", "left_semi").select("id", "n", "sketch").dropDuplicates(["id"]), "sketches")

    def near(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Of stored pairs a, b those that sketches, which has all their ids, doesn't rule out."""
        met = _side(sketches, "a", "n", "sketch").join(sized(pairs), "a").join(_side(sketches, "b", "n", "sketch"), "b")
        return stored(met.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_ruled_in, "a long, b long"), "pairs-near")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of stored pairs a, b those that are similar."""
        mark = len(stored_since())
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = stored(ids.join(self.classes, "id").select("text_hash").distinct(), "texts-near")
        texts = self.texts.join(sized(wanted), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
        sets = stored(sets_of(texts.select("text"), self.shingle, self.seed), "sets-near")
        met = _side(sets, "a", "n", "odd").join(sized(pairs), "a").join(_side(sets, "b", "n", "odd"), "b")
        close = stored(met.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(_close, "a long, b long"), "pairs-close")
        both = F.size(F.array_intersect("set_a", "set_b"))
        met = _side(sets, "a", "n", "set").join(sized(close), "a").join(_side(sets, "b", "n", "set"), "b")
        found = met.filter(9 * both >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")
        past = stored_since(mark)
        found = stored(found, "links-near")
        forget(pairs.sparkSession, past)
        return found


def _side(table: DataFrame, c: str, *cols: str) -> DataFrame:
    """Columns of one side of pairs: its id as c, others with _c."""
    return table.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in cols))


def _fit(x: str | Column, y: str | Column) -> Column:
    """Whether sets of these sizes can be similar."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def printed_links(classes: DataFrame, similar: Similar, ring: Ring) -> DataFrame:
    """Edges a, b between similar ids that the search by fingerprints finds: those of one
    fingerprint with its least id, and the least ids of fingerprints that link."""
    least = stored(classes.groupBy("print").agg(F.min("id").alias("a")), "prints")
    edges = stored(links(least.select(F.col("print").alias("id")), ring), "print-links")
    same = classes.join(sized(least), "print").filter("id <> a").select("a", F.col("id").alias("b"))
    end = lambda c, of: least.select(F.col("print").alias(c), F.col("a").alias(of))
    near = end("a", "x").join(sized(edges), "a").join(end("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = stored(same.union(near).distinct(), "print-pairs")
    return similar.links(similar.near(pairs, similar.sketches(pairs.select(F.explode(F.array("a", "b")).alias("id")))))


def similar_links(rows: DataFrame, classes: DataFrame, similar: Similar, ring: Ring) -> DataFrame:
    """Edges a, b that connect all ids whose sets are similar. rows: id, n, prefix, sketch;
    classes: id, n, print, text_hash, one row of each id.

    Fingerprints find the closest first. Blocks of one shingle of the prefixes in which these
    links leave different components then give the rest: each member first meets the least
    component's least id, and pairs that are still in different components are met all, so that
    no link is lost and a dense group doesn't give all its pairs.
    """
    near = printed_links(classes, similar, ring)
    roots = stored(components(near), "print-roots")
    keyed = rows.join(sized(roots), F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("root", "id").alias("root"), F.explode("prefix").alias("key"))
    crowds = keyed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key", "a")
    crowds = stored(crowds, "shingle-crowds")
    shared = stored(keyed.join(sized(crowds, crowds.count() // 3), "key").select("key", "id", "n", "root", "a").distinct(), "shingle-keys")  # 24 bytes a row
    sketches = similar.sketches(shared.select("id").union(shared.select("a")))
    pairs = shared.filter("a <> root").select("a", "id", "n").distinct().join(sized(sketches.select(F.col("id").alias("a"), F.col("n").alias("an"))), "a")
    pairs = stored(pairs.filter(_fit("n", "an")).select("a", F.col("id").alias("b")), "star-pairs")
    near = near.union(similar.links(similar.near(pairs, sketches)))
    roots = components(near)
    placed = shared.drop("root").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", "a", F.coalesce("root", "id").alias("root"))
    split = placed.filter("id <> a").groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).filter("x <> y")
    split = split.select("key", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    left = placed.filter("id <> a").join(split, "key")
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, part).alias("x"), F.greatest(o, part).alias("y")))
    left = left.join(sized(sketches.select("id", "sketch")), "id")
    cells = left.select("id", "n", "root", "sketch", "key", F.explode(others).alias("c")).select(F.xxhash64("key", "c.x", "c.y").alias("cell"), "id", "n", "root", "sketch")
    rest = stored(cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_parted, "a long, b long").distinct(), "pairs-left")
    return near.union(similar.links(rest))


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within runs of equal cells that have different roots and sizes that fit, and that their
    sketches don't rule out."""
    held: list[np.ndarray] | None = None

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, ids, n, root, counts, there = cols
        ends = np.searchsorted(cell, cell, side="right")
        for i in np.flatnonzero(ends - np.arange(len(cell)) > 1):
            at = np.arange(i + 1, ends[i])
            at = at[(root[at] != root[i]) & (ids[at] != ids[i]) & (5 * np.minimum(n[at], n[i]) >= 4 * np.maximum(n[at], n[i]))]
            at = at[may_be_similar(counts[at], there[at], n[at], counts[i], there[i], n[i])]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[i])), pa.array(ids[at])], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(k).to_numpy().astype(np.int64) for k in range(4)] + list(table_of(batch.column(4)))
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on in the next batch
        held = [c[last:] for c in cols]
        if last:
            yield from pairs([c[:last] for c in cols])
    if held is not None:
        yield from pairs(held)


def without_near_duplicates(docs: DataFrame, shingle: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """docs with one document of each group of near copies, that with the smallest id.

    Rows of one id and text are one document. Documents link if the Jaccard similarity of their
    shingles is 0.8 at least. The search by fingerprints within k bits, with its pigeonring filter,
    connects the closest; what it can't find comes from prefixes of the shingles, which lose no
    link. Every link is verified.
    """
    text_batches(docs.sparkSession)
    order = order_of(docs, shingle, seed, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), judged(F.col(text_col), order, shingle, seed).alias("j"))
    rows = stored(found.select("doc_id", "text_hash", "j.*"), "shingles")
    classes = rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.min("n").alias("n"), F.min("print").alias("print"))
    classes = stored(classes, "shingle-classes")
    similar = Similar(docs, rows, classes, shingle, seed, text_col)
    found = component_of(classes.select("id", "doc_id"), components(similar_links(rows, classes, similar, Ring(k))))
    gone = rows.select("id", "doc_id", "text_hash").join(sized(found), "id")
    gone = gone.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__sim_id"), F.col("text_hash").alias("__sim_hash")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__sim_id")) & (F.xxhash64(F.col(text_col)) == F.col("__sim_hash"))
    return docs.join(gone, same, "left_anti")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
