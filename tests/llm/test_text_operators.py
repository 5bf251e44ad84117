from __future__ import annotations

import base64
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import ann, bpe, langid, licenses, packing, shared, toxicity, url_filter

DOCS = "doc_id long, text string"
ODD = ["a", "b", " ", "'", "s", "é", "\n", "日", "本", " \x1c", "\x85", "　", "🙂", "ll", "'ve", "<|endoftext|>", "İ", "ǅ", "é", "5", "²", "$", "ſ", "  "]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return [None, "", "x" * 3000, "ab" * 20_000, *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n))]


# --- BPE ----------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.Vocabulary.read(path)
    assert all(vocabulary.keys[vocabulary.hash.index(k)] == k for k in vocabulary.keys)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(400, 1)
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS + ", n_tokens string")
    got = {r.doc_id: r for r in bpe.round_trip(rows, vocabulary).collect()}
    for k, t in enumerate(texts):
        ids = other.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = rows.select(bpe.encode(spark, F.col("text"), vocabulary).alias("ids"), "text").select(bpe.decode(spark, F.col("ids"), vocabulary).cast("string").alias("back"), "text")
    assert all(r.back == r.text for r in both.collect())
    assert bpe.round_trip(spark.createDataFrame([], DOCS), vocabulary).count() == 0
    twice = bpe.round_trip(spark.createDataFrame([(7, "same text"), (7, "same text"), (None, "same text")], DOCS), vocabulary)
    assert twice.count() == 3 and twice.select("ids_sha256").distinct().count() == 1


# --- packing ------------------------------------------------------------------------------------


def test_packing_ids_places_and_count(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = odd_texts(150, 2)
    found = packing.pack_documents(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], DOCS + ", length int"), length=64).collect()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    assert {(r.doc_id, r.piece) for r in found} == {(k, p) for k, x in ids.items() for p in range(-(-len(x) // 64))}
    sequences = {}
    for r in found:
        own = ids[r.doc_id][r.piece * 64 : (r.piece + 1) * 64]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * 64, len(own), zlib.crc32(np.array(own, "<u4").tobytes())), texts[r.doc_id]
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 64) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_of_repeated_rows_and_common_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 16)
    docs = spark.createDataFrame([(7, "a b c")] * 40 + [(k, "x y z") for k in range(60)] + [(None, None)], DOCS)
    found = packing.pack_documents(docs, length=16).collect()
    assert len(found) == 101
    places = sorted((r.sequence_id, r.offset, r.length) for r in found)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert (s2 > s and o2 == 0) or (s2 == s and o2 == o + n)
    assert len({s for s, *_ in places}) == -(-sum(n for *_, n in places) // 16)


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = np.bincount(rng.integers(1, 40, rng.integers(0, 200)), minlength=65)
        used = np.zeros(65, int)
        for times, lengths in packing.plan(counts):
            assert sum(x * n for x, n in lengths.items()) <= 64
            for x, n in lengths.items():
                used[x] += times * n
        assert (used == counts).all()


# --- URL filter ---------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = {
        "https://a.example.net/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://EXAMPLE.net/fr": ("example.net", "/fr", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "x://b.example.com/de/1#t": ("b.example.com", "/de/1", "example.com/de/", "block"),
        "http://w.org/fr/a": ("w.org", "/fr/a", "org/fr/", "allow"), "http://w.org/frx": ("w.org", "/frx", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://": ("", "", None, "allow"), "http://net/": ("net", "/", "net/", "block"), "http://é.net/#/": ("é.net", "/", "net/", "block"), "http://x.net#/": ("x.net", "", None, "allow"), "http://x.net?/": ("x.net", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    want = dict(enumerate(urls.values()))
    assert all((r.host, r.path, r.rule, r.verdict) == want[r.page_id] for r in got)
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    long = "http://" + "a." * 3000 + "net/" + "p/" * 50_000
    r = url_filter.filter_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), rules).first()
    assert (r.rule, r.verdict, len(r.path)) == ("net/", "block", 100_001)


def test_url_candidates_are_filtered_before_any_exchange(spark, capsys):
    keys = spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"))
    url_filter.may_be_listed(keys, url_filter.bloom_blocks(keys, 4), 4).distinct().explain()
    plan = capsys.readouterr().out
    assert plan.index("Exchange hashpartitioning(key") < plan.index("BroadcastHashJoin")  # printed from the top down


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark, monkeypatch):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = -(-2000 * url_filter.BITS_A_KEY // 512)
    filter_ = url_filter.bloom_blocks(keys, blocks)
    assert url_filter.may_be_listed(keys, filter_, blocks).count() == 2000
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert url_filter.may_be_listed(others, filter_, blocks).count() < 400
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert url_filter.may_be_listed(keys, filter_, blocks).count() == 2000


# --- licences -----------------------------------------------------------------------------------


def test_licence_scan(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    odd = "Copyright (c) 2020 Someone\n\n" + mit.replace(". ", " .\n").upper().replace("SUBLICENSE", "Sublicence")
    texts = [mit, odd, mit + " And more.", "Text\nReleased under the MIT License.\nLicenced under CC BY-NC 4.0", None, "", "license " * 5000]
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS + ", digest string")).collect()}
    assert got == {0: ("MIT", ""), 1: ("MIT", ""), 2: (None, ""), 3: (None, "CC-BY-NC-4.0,MIT"), 4: (None, ""), 5: (None, ""), 6: (None, "")}
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_licences_of_any_length_on_one_line_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    flat = {n: t.replace("\n", " ") for n, t in licenses.KNOWN if "\n" in t}
    texts = [*flat.values(), *(f"Some text\n{t}\nand more" for t in flat.values()), "*" * 400 + " Released under the MIT License. " + "-" * 400, f"{flat['MIT']}\n{flat['ISC'].upper()}", "no notice", None]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = sorted(tuple(r) for r in licenses.scan(docs).collect())
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == sorted(db.execute(licenses.OP4_SQL).fetchall())
    notices = [r[3] for r in got]
    assert notices[: len(flat)] == list(flat) and notices[len(flat) : 2 * len(flat)] == list(flat) and notices[2 * len(flat) :] == ["MIT", "ISC,MIT", "", ""]
    own = [("Own", "First part of it.\nSecond part."), ("Digits", "1 2 3")]
    rows = spark.createDataFrame([(1, "x\nfirst part of it second PART"), (2, "y\n1, 2, 3"), (3, "z")], DOCS)
    assert {r.doc_id: r.notices for r in licenses.scan(rows, own).collect()} == {1: "Own", 2: "Digits", 3: ""}


def test_long_texts_padded_lines_repeats_and_two_licences_of_one_text(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    there = {n: (folder / f).read_text(encoding="utf-8") for n, f in files.items() if (folder / f).exists()}
    texts = [*there.values(), *there.values(), "Licensed under the MIT License" + " ." * 300]
    texts += [" ".join(x for x in t.split("\n") if "opyright (" not in x) for t in there.values() if "GNU LESSER" not in t]
    got = licenses.scan(spark.createDataFrame([(7, t) for t in texts], DOCS)).collect()
    assert sorted(r.license_id for r in got if r.license_id and not r.notices) == sorted([*there] * 2)
    assert len(got) == len(texts) and [r.notices for r in got if r.license_id == "MIT"] == ["MIT"]
    if "MPL-2.0" in there:
        flat = spark.createDataFrame([(1, "Some text\n" + " ".join(x for x in there["MPL-2.0"].split("\n") if "(c)" not in x))], DOCS)
        assert licenses.scan(flat).first().notices == "MPL-2.0"
    own = [("B", "One text."), ("A", "one  TEXT")]
    assert licenses.scan(spark.createDataFrame([(1, "one text")], DOCS), own).first().license_id == "A"
    with pytest.raises(ValueError, match="at most"):
        licenses.known_digests([("X", f"text {k}") for k in range(licenses.MOST + 1)])


# --- toxicity and language ----------------------------------------------------------------------


def corpus(n, seed):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu", "ren"], "bb": ["sch", "ung", "ei", "pf", "ber"]}
    rows = []
    for k in range(n):
        lang = "aa" if k % 2 else "bb"
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        toxic = int(k % 4 < 2 and k % 3 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vilewort" + rng.choice(parts[lang]))
        rows.append((k, " ".join(words), lang, toxic))
    return rows


def test_toxicity_held_out(spark):
    rows = corpus(400, 5)
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in rows] + [(9001, None), (9002, ""), (9003, "1 2 3"), (None, "x")], DOCS)
    labels = spark.createDataFrame([(d, 1, x) for d, _, _, x in rows] + [(9001, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert {d for d, *_ in held} == {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(got[d].predicted == x for d, _, _, x in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9001].score == got[9002].score == got[9003].score
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert max(r.score for r in toxicity.score_documents(docs, none).collect()) < 0.01


def test_language_held_out_spans_and_cases(spark):
    rows = corpus(300, 6)
    docs = spark.createDataFrame([(d, t, x) for d, t, x, _ in rows] + [(9001, None, "aa"), (9002, "12 !", "bb"), (9003, "日本語", None), (None, "kalo", "aa")], DOCS + ", lang string")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert {d for d, *_ in held} == {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    assert all(got[d].lang_pred == x for d, _, x, _ in held)
    assert (got[9001].lang_pred, got[9002].lang_pred) == ("und", "und") and got[9003].lang_pred in ("aa", "bb")
    spans = langid.Labeller(model).spans("kalo mituren lokami tuka renlo schung beiei pfber ungsch berung")
    assert [s[0] for s in spans] == ["aa", "bb"] and spans[0][2] == 5
    assert langid.identify(docs, langid.train(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def plain_chances(counts, order=toxicity.ORDER, d=toxicity.DISCOUNT):
    """Kneser-Ney by the book, with dicts: counts[word] is how often each of two classes has it."""
    top, longer = {}, {}
    for w, n in counts.items():
        w = f"\x02{w}\x03"
        for k in range(1, len(w)):
            g = w[max(0, k - order + 1) : k + 1]
            top[g] = [a + b for a, b in zip(top.get(g, (0, 0)), n)]
            for m in range(2, min(order, k + 1) + 1):
                longer.setdefault(m, set()).add(w[k - m + 1 : k + 1])
    cont = {m: {} for m in range(1, order)}
    for m in cont:
        for g in longer.get(m + 1, ()):
            cont[m][g[1:]] = cont[m].get(g[1:], 0) + 1
    base = 1 / len({c for w in counts for c in f"\x02{w}\x03"})

    def shared(g):
        if not g:
            return base
        same = {x: n for x, n in cont[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * shared(g[1:])

    def of_class(g, c):
        same = {x: n[c] for x, n in top.items() if x[:-1] == g[:-1] and n[c]}
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * shared(g[1:]) if total else shared(g[1:])

    def ratio(word):
        w = f"\x02{word}\x03"
        return sum(np.log(of_class(w[max(0, k - order + 1) : k + 1], 0) / of_class(w[max(0, k - order + 1) : k + 1], 1)) for k in range(1, len(w)))

    return ratio, of_class, top


def test_class_chances_equal_plain_kneser_ney():
    rng = random.Random(4)
    counts = {"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 11))): (rng.randint(0, 3), rng.randint(0, 3)) for _ in range(60)}
    counts = {w: n for w, n in counts.items() if sum(n)}
    ratio, of_class, top = plain_chances(counts)
    found = list(counts)
    model = toxicity.evidence(found, *(np.array([counts[w][c] for w in found], float) for c in (0, 1)))
    want = np.array([ratio(w) for w in found])
    assert np.allclose(model.of(found), np.log1p(toxicity.MIXED * np.expm1(want)), atol=1e-4)
    contexts = {g[:-1] for g, n in top.items() if n[0]}
    for context in list(contexts)[:10]:  # the chances of all characters that are known after a context, and of the others, are at most 1
        assert 0 < sum(of_class(g, 0) for g in top if g[:-1] == context) < 1 + 1e-9


def test_language_of_whole_texts_equals_a_plain_search():
    rows = corpus(120, 16)
    model = langid.fit_texts([t for _, t, _, _ in rows], [x for *_, x, _ in rows])
    rng = random.Random(1)
    texts = [" ".join(rng.choice(rows)[1].split()[:9][k % 9 :] + rng.choice(rows)[1].split()[:5]) for k in range(150)]
    labeller = langid.Labeller(model)
    searched = 0
    for (found, at, labels), (lang, share) in zip(labeller.label(texts), labeller.predict(texts), strict=True):
        scores = labeller.table[at]
        searched += langid.switch_may_pay(scores, int(scores.sum(axis=0).argmax()), langid.PENALTY)
        best, back = scores[0].copy(), []
        for s in scores[1:]:
            moves = best[None, :] - langid.PENALTY * (1 - np.eye(len(best)))
            back.append(moves.argmax(axis=1))
            best = moves.max(axis=1) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        assert path == labels.tolist()
        letters = [sum(len(w) for w, x in zip(found, path) if x == k) for k in range(2)]
        assert lang == model.languages[int(np.argmax(letters))] and abs(share - max(letters) / sum(letters)) < 1e-12
    assert 10 < searched < 140


def test_letters_are_letters():
    model = langid.fit_texts(["kalo miturn", "schung beiei"], ["aa", "bb"])
    got = langid.Labeller(model).predict(["²½", "Ⅷ", "١٢٣", None, "", "_ 5", "नमस्ते", "e\u0301"])
    assert [g[0] for g in got[:6]] == ["und"] * 6 and got[6][0] != "und" and got[7][0] != "und"
    assert shared.words("नमस्ते e\u0301A x²y") == ["नमस्ते", "e\u0301a", "x", "y"]


def test_empty_repeated_long_and_clashing_rows(spark):
    rows = corpus(120, 26)
    docs = spark.createDataFrame([(d, t, x, 0.5, "p", 7) for d, t, x, _ in rows], DOCS + ", lang string, score double, lang_pred string, word int")
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(5000, rows[0][1] * 3000, None, 0.1, "q", 1)], docs.schema))
    labels = spark.createDataFrame([(d, x, 0.0) for d, _, _, x in rows] * 2, "doc_id long, toxic int, score double")
    empty = docs.limit(0)
    bad, lang = toxicity.train(docs, labels), langid.train(docs)
    for found in (toxicity.score_documents(docs, bad), langid.identify(docs, lang)):
        assert found.count() == 126 and found.filter("score IS NULL").count() == 0
        assert found.distinct().count() == 121
    assert toxicity.score_documents(empty, bad).count() == langid.identify(empty, lang).count() == 0
    assert toxicity.score_documents(docs, toxicity.train(empty, labels)).filter("score > 0").count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    scores = [rng.normal(size=(n, 3)).astype(np.float32) for n in (0, 1, 2, 5, 6)]
    for s, labels in zip(scores, langid.viterbi(scores, 0.7), strict=True):
        value = lambda path, s=s: sum(s[k, x] for k, x in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        paths = np.array(np.meshgrid(*[range(3)] * len(s))).reshape(len(s), -1).T if len(s) else [[]]
        assert abs(value(labels) - max(value(p) for p in paths)) < 1e-4


# --- nearest neighbours -------------------------------------------------------------------------


def test_neighbours_recall_copies_and_cases(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16)).round(3)
    x[100:130] = x[100]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    bad = [(800, None), (820, [0.0] * 16), (840, [float("nan")] + [1.0] * 15), (860, [None] + [1.0] * 15), (880, []), (900, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, shard=256, least=1).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(range(0, 700, 20))
    assert ann.recall(x, np.arange(700), {q: [r.vec_id for r in rs] for q, rs in found.items()}, 20) >= 0.9
    for q, rs in found.items():
        assert [r.rank for r in rs] == list(range(1, 21)) and q not in {r.vec_id for r in rs}
        assert all(abs(r.score - float(x[q] @ x[r.vec_id])) < 1e-12 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.nearest(few.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 100.0, 1e4, 1e200])
def test_recall_with_one_long_vector(spark, monkeypatch, scale):
    monkeypatch.setattr(ann, "SCANNED", 64)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16))
    x[7] *= scale
    x[8:40] *= rng.uniform(0.01, 30, 32)[:, None]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(5, [float(v) for v in x[5]])], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, shard=300, least=1).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert ann.recall(x, np.arange(600), found, 20) >= 0.9 and all(len(v) == 20 for v in found.values())


def test_exact_complements_beyond_many_that_are_used():
    counts = np.zeros(4097, np.int64)
    counts[1:72] = counts[3929:4000] = 1
    assert packing.Gaps(counts.copy()).exact(4000, {k: 1 for k in range(1, 71)}) == [3929, 71]
    counts[:] = 0
    counts[45:82] = counts[3929:4000] = 1
    assert packing.Gaps(counts.copy()).exact(4090, {k: 1 for k in range(3930, 4000)}) == [3929, 81, 80]
