from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from colloquy.llm import exact_dedup, line_dedup, shared, simhash
from colloquy.llm.components import components

DOCS = "doc_id long, text string"


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


# --- exact dedup --------------------------------------------------------------------------------


def test_exact_dedup_cases(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b"), (None, "a b"), (4, None), (5, ""), (6, "x" * 200_000), (7, "x" * 200_000), (8, "é"), (9, "É"), (9, "É"), (None, "only")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {
        (3, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (7, 6, 2, False),
        (8, 8, 1, True), (9, 9, 2, True), (None, None, 1, True),
    }


def test_exact_dedup_ignores_clashing_columns_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)], DOCS + ", digest string, keep_id long")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(df).collect()} == {(1, 1), (2, 1)}
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_grace_spills_and_compares_contents(tmp_path):
    texts = [f"text {k % 700}".encode() * 20 for k in range(3000)]
    records = [(hashlib.sha256(t).digest(), t, k, 1) for k, t in enumerate(texts)]
    got = {bytes(e[1]): (e[2], e[3]) for e in exact_dedup.grace(iter(records), 20_000, 4, 0, str(tmp_path))}
    want = {}
    for k, t in enumerate(texts):
        least, n = want.get(t, (k, 0))
        want[t] = (least, n + 1)
    assert got == want
    assert not list(tmp_path.iterdir())
    same = hashlib.sha256(b"").digest()  # one digest, two contents
    assert len(list(exact_dedup.grace(iter([(same, b"a", 1, 1), (same, b"b", 2, 1)]), 10))) == 2


# --- SimHash ------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))] for _ in range(25)]
    docs = [(None, "Ünïque text"), (900, None), (901, " \t"), (902, "One TWO"), (902, "One TWO")]
    for k in range(200):
        words = list(rng.choice(base))
        if words and rng.random() < 0.7:
            words[rng.randrange(len(words))] = "changed"
        docs.append((k, " ".join(words)))
    got = simhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((d or -1, f"{f:016x}") for (d, _), f in zip(docs, fps, strict=True))
    edges = [(i, j) for i in range(len(docs)) for j in range(i + 1) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    root = union_find(edges)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    want = sorted((d or -1, least.get(root[i], -1)) for i, (d, _) in enumerate(docs))
    assert sorted((r.doc_id or -1, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_pigeonring_loses_nothing_and_forests_connect():
    rng = np.random.default_rng(1)
    ring = simhash.Ring(4)
    bits = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(3000)], np.uint64)
    counts = np.bitwise_count(bits)
    assert (ring.near(bits) == (counts <= 4)).all()
    assert (~ring.chained(bits) & (counts > 4)).any()  # it does prune
    fps = np.unique(np.concatenate([bits[:150], rng.integers(0, 2**63, 50).astype(np.uint64)]))
    ids = np.arange(len(fps))
    a, b = simhash.forest(ids, fps, ring)
    want = union_find([(int(i), int(j)) for i in ids for j in ids[: i + 1] if bin(int(fps[i] ^ fps[j])).count("1") <= 4])
    got = union_find([(int(i), int(i)) for i in ids] + list(zip(a.tolist(), b.tolist(), strict=True)))
    assert got == want
    assert len(a) == len(ids) - len(set(want.values()))


def test_large_blocks_are_cut_and_still_connect(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    fps = [(k ^ (k >> 1)) & 0xFFF for k in range(60)]  # neighbours differ in a bit
    df = spark.createDataFrame([(f,) for f in fps], "id long")
    roots = components(simhash.links(df, simhash.Ring(4))).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 59


def test_finer_keys_of_large_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 4)
    rng = random.Random(7)
    fps = []
    for _ in range(40):  # all in one block: 22 bits are the same, the others random or near another's
        fps.append(rng.getrandbits(40) << 22)
        fps.append(fps[-1] ^ sum(1 << b for b in rng.sample(range(22, 62), rng.randint(1, 6))))
    df = spark.createDataFrame([(f,) for f in set(fps)], "id long")
    got = {r.node: r.root for r in components(simhash.links(df, simhash.Ring(4))).collect()}
    fps = sorted(set(fps))
    root = union_find([(i, j) for i in range(len(fps)) for j in range(i + 1) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    assert got == {fps[i]: fps[r] for i, r in root.items() if i != r}


def test_near_duplicates_of_an_empty_table_long_texts_and_clashing_columns(spark):
    schema = DOCS + ", id long, fingerprint string, component_id long, root long, set array<long>"
    docs = spark.createDataFrame([(1, "a b c d e " * 60_000, 5, "x", 1, 2, [1]), (2, "a b c d e " * 60_000, 6, "y", 2, 3, [2]), (3, "q r s t", 7, "z", 3, 4, None)], schema)
    for found in (simhash.near_duplicates(docs), simhash.near_duplicates(docs.limit(0))):
        assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.without_near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(docs).collect()) == [1, 3]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_leave_one_of_each_group(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    docs, group = [], {}
    for g in range(12):
        words = [word() for _ in range(150)]
        for c in range(4):
            own = list(words)
            if c:
                own[rng.randrange(150)] = word()
            docs.append((g * 10 + c, " ".join(own), "en"))
            group[g * 10 + c] = g
    docs += [(500, None, None), (None, "null id", "en")]
    kept = simhash.without_near_duplicates(spark.createDataFrame(docs, DOCS + ", lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([g * 10 for g in range(12)] + [500])
    assert kept.filter("doc_id IS NULL").count() == 1


def shingle_set(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_copies_equal_brute_force_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(40)]
    docs = []
    for g in range(60):  # pairs on both sides of 0.8, half of them with a passage that all share
        words = [word() for _ in range(rng.randint(80, 160))] + (passage if g % 2 else [])
        own = list(words)
        for k in rng.sample(range(0, 80, 5), rng.randint(1, 9)):
            own[k] = word()
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(own))]
    for k in range(40):  # documents that are mostly one template, some of them similar
        docs.append((200 + k, " ".join(passage + passage[::-1] + [word() for _ in range(rng.randint(2, 14))])))
    sets = [shingle_set(t) for _, t in docs]
    jaccard = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(docs)) for j in range(i)}
    close = [x for x in jaccard.values() if 0.7 < x < 0.9]
    assert sum(x >= 0.8 for x in close) > 20 and sum(x < 0.8 for x in close) > 20
    root = union_find([(i, i) for i in range(len(docs))] + [p for p, x in jaccard.items() if x >= 0.8])
    kept = simhash.without_near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(docs[i][0] for i in set(root.values()))


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
        a, b = rng.choice(pool, rng.integers(1, 300)), rng.choice(pool, rng.integers(1, 300))
        x, y = simhash.sketched(a), simhash.sketched(b)
        (i, j), there = simhash.table_of(pa.array([x["sketch"], y["sketch"]]))
        assert there.all() and i.sum() == len(set(a.tolist())) and np.minimum(i, j).sum() >= len(set(a.tolist()) & set(b.tolist()))
    crowded = np.arange(300, dtype=np.uint64)  # all in the first cell
    assert simhash.sketched(crowded)["sketch"] is None
    (i, j), (p, q) = simhash.table_of(pa.array([None, x["sketch"]]))
    assert simhash.may_be_similar(i[None], np.array([p]), np.array([300]), j[None], np.array([q]), np.array([4])).all()


def test_odd_cells_bound_what_sets_differ_by():
    rng = np.random.default_rng(4)
    for _ in range(50):
        pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 3000))) for _ in range(2))
        assert simhash.differ_at_least(simhash.odd_cells(a), simhash.odd_cells(b)) <= len(np.setxor1d(a, b))
    for n, m in ((4000, 4000), (3900, 4700), (0, 1), (1, 2), (2, 3), (3, 5), (8, 9)):  # none shared but two
        a, b = (np.sort(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (n, m))
        a[:2] = b[: len(a[:2])] if n > 2 else a[:2]
        far = len(np.setxor1d(a, b))
        assert far // 3 <= simhash.differ_at_least(simhash.odd_cells(a), simhash.odd_cells(b)) <= far
    assert simhash.differ_at_least(simhash.odd_cells(a), simhash.odd_cells(a)) == 0


def spied(monkeypatch):
    """Labels and row counts of the tables that near copies store."""
    seen, real = [], simhash.stored

    def counted(df, label):
        out = real(df, label)
        seen.append((label, out.count(), out.columns))
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    return seen


def test_sets_are_not_stored_and_travel_with_no_pair_of_unlike_long_texts(spark, monkeypatch):
    seen = spied(monkeypatch)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    monkeypatch.setattr(simhash, "KNOWN", 0)  # no word counts as rarer than another
    parts = [" ".join(word() for _ in range(60)) for _ in range(3)]
    docs = [(k, " ".join([word() for _ in range(6000)] + [parts[k // 2]])) for k in range(6)]  # too long for sketches to tell apart
    docs.append((6, docs[0][1] + " " + word()))
    kept = simhash.without_near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(6))
    rows = {}
    for label, n, columns in seen:
        rows[label] = rows.get(label, 0) + n
        assert "set" not in columns or label == "sets-near", label
    assert rows["pairs-near"] + rows["pairs-left"] > 2 and rows["pairs-close"] == 1


def test_workers_hand_over_a_fifth_of_the_shingles_in_one_order():
    rng = random.Random(14)
    often, seldom = [f"o{k}" for k in range(40)], [f"s{k}" for k in range(4000)]
    order = simhash.Order({w.encode(): 5000 for w in often}, np.zeros(0, np.uint64))
    words = [rng.choice(often) for _ in range(400)] + seldom[:100]
    text, other = " ".join(words), " ".join(words[200:] + words[:200])
    h, g = simhash.hashes(text, 5, 42), simhash.hashes(other, 5, 42)
    n = len(set(h.tolist()))
    first = order.prefix(text, h, 5)
    assert len(first) == n - -(-4 * n // 5) + 1
    rare = simhash.hashes(" ".join(seldom[:100]), 5, 42)
    assert len(set(first.tolist()) & set(rare.tolist())) == min(len(first), len(rare))
    late = simhash.Order({w.encode(): 5000 for w in often}, np.sort(rare))
    assert set(late.prefix(text, h, 5).tolist()).isdisjoint(rare.tolist())
    shared = [x for x in first.tolist() if x in set(g.tolist())]  # of those in both, the same come first
    found = [x for x in order.prefix(other, g, 5).tolist() if x in set(shared)]
    assert len(found) > 90 and found == shared[: len(found)]
    assert len(order.prefix(None, simhash.hashes(None, 5, 42), 5)) == 0 and len(order.prefix("a b", simhash.hashes("a b", 5, 42), 5)) == 1


def test_fingerprints_find_the_closest_copies_before_any_block_of_shingles(spark, monkeypatch):
    seen = spied(monkeypatch)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    docs = []
    for g in range(8):
        words = [word() for _ in range(1500)]
        docs += [(g * 10 + c, " ".join([*words, *[word()] * c])) for c in range(3)]
    fps = {d: simhash.fingerprint(simhash.hashes(t, 5, 42)) for d, t in docs}
    near = [(x, y) for x in fps for y in fps if x // 10 == y // 10 and x < y and bin(fps[x] ^ fps[y]).count("1") <= 4]
    assert len(near) == 24
    kept = simhash.without_near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == [g * 10 for g in range(8)]
    labels = [label for label, _, _ in seen]
    assert labels.index("print-links") < labels.index("links-near") < labels.index("shingle-crowds")
    assert dict((label, n) for label, n, _ in seen)["shingle-crowds"] == 0  # nothing is left for prefixes
    # fingerprints that link without similar sets are no copies
    short = [(1, "a b c d e f"), (2, "a b c d e g")]
    monkeypatch.setattr(simhash, "fingerprint", lambda h: 7)
    assert simhash.without_near_duplicates(spark.createDataFrame(short, DOCS)).count() == 2


# --- line dedup ---------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.34:
            out.insert(k, rng.choice("abé"))
        elif out and kind < 0.67:
            out.pop(min(k, len(out) - 1))
        elif out:
            out[min(k, len(out) - 1)] = rng.choice("abé")
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2])
def test_banded_distance(spark, edits):
    from pyspark.sql import functions as F

    rng = random.Random(edits)
    pairs = []
    for _ in range(700):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 30)))
        b = changed(rng, a, rng.randint(0, 4))
        if b and abs(len(a) - len(b)) <= edits:
            pairs.append((a, b, distance(a, b)))
    for r in spark.createDataFrame(pairs, "a string, b string, d int").withColumn("got", line_dedup.banded_distance(F.col("a"), F.col("b"), edits)).collect():
        assert (r.got == r.d) if r.d <= edits else (r.got > edits), r
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for window in (2, 8, 32):
        assert df.filter(line_dedup.within(F.col("a"), F.col("b"), edits, window) != (F.col("d") <= edits)).count() == 0
    differ = lambda k: F.bit_count(line_dedup.parities(F.col("a"))[k].bitwiseXOR(line_dedup.parities(F.col("b"))[k]))
    odd = (differ(0) <= 2 * edits) & (differ(1) <= 4 * edits)
    assert df.filter(~odd & (F.col("d") <= edits)).count() == 0
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst🙂") for _ in range(60))
    assert spark.createDataFrame([(word(), word()) for _ in range(50)], "a string, b string").filter(odd).count() < 10
    may = line_dedup.may_be_near(F.col("a"), F.col("b"), edits, 8)
    assert df.filter(~may & (F.col("d") <= edits)).count() == 0 and df.filter(~may).count() > 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_key_of_each_partition(spark, edits):
    from pyspark.sql import functions as F

    rng = random.Random(edits)
    pairs = []
    for n in [*range(20, 60), 100, 101] * 12:
        a = "".join(rng.choice("abé") for _ in range(n))
        b = changed(rng, a, edits)
        if len(b) >= 20 and distance(a, b) <= edits:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for outer in line_dedup._OUTER:
        of = lambda c: line_dedup.keys(F.col(c), F.length(c), edits, outer)  # noqa: E731, B023
        assert df.filter(~F.arrays_overlap(of("a"), of("b"))).count() == 0
    far = spark.createDataFrame([("".join(rng.choice("abcdefgh") for _ in range(40)), "".join(rng.choice("abcdefgh") for _ in range(40))) for _ in range(50)], "a string, b string")
    assert far.filter(F.arrays_overlap(of("a"), of("b"))).count() == 0


@pytest.mark.parametrize("crowd,broadcast", [(64, 500_000), (2, 0)])
def test_line_dedup_against_brute_force(spark, monkeypatch, crowd, broadcast):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(15, 60))) for _ in range(25)]
    docs = [(k, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(0, 5))) if k % 17 else None, k) for k in range(40)]
    seen, want = [], {}
    for k, text, _ in docs:
        left = []
        for line in (text or "").split("\n"):
            line_ = re.sub(r"\s+", " ", line).strip(" ")
            if len(line_) < 20 or not any(abs(len(line_) - len(s)) <= 2 and distance(line_, s) <= 2 for s in seen):
                left.append(line)
            if len(line_) >= 20:
                seen.append(line_)
        want[k] = None if text is None else "\n".join(left)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS + ", h long"))
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert got.columns == ["doc_id", "text", "h", "__line_dropped"]


def test_line_dedup_cases(spark):
    line = "a line that is long enough to count"
    docs = [(1, f"{line}\n\n{line}"), (2, line), (None, line), (3, ""), (4, "short\nshort"), (1, f"{line}\n\n{line}")]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(1, f"{line}\n")] * 2 + [(2, ""), (None, ""), (3, ""), (4, "short\nshort")], key=str)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_lines_and_very_many(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(50_000))
    many = [f"line {k} of very many in this one" for k in range(0, 100_000_000, 1001)]
    docs = [(1, long), (2, long[:20_000] + "x" + long[20_000:]), (3, "\n".join(many[:1000] * 100)), (4, None)]
    got = {r.doc_id: (r.text, r["__line_dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1] == (long, 0) and got[2] == ("", 1) and got[4] == (None, 0)
    left = got[3][0].split("\n")
    assert got[3][1] == 100_000 - len(left) and left == [x for x in many[:1000] if x in set(left)]
    assert all(distance(a, b) > 2 for a, b in zip(left, left[1:]))


def test_op10_drops_exact_repeats_of_short_lines(spark, tmp_path):
    line = "a line that is long enough to count"
    docs = [(1, "Les.\n\n日本語\nLes.\nab"), (2, f"{line}\n Les. \n日本語\n\nLet.\nac"), (3, f"{line}s\nac\nnew")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: "Les.\n\n日本語\nab", 2: f"{line}\n\nLet.\nac", 3: "new"}
    got = {r.doc_id: (r.n_dropped, r.text_sha256) for r in line_dedup.op10_line_dedup(spark, f"file://{tmp_path}").collect()}
    assert got == {k: (n, hashlib.sha256(want[k].encode()).hexdigest()) for k, n in [(1, 1), (2, 2), (3, 2)]}
