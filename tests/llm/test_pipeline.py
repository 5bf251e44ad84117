from __future__ import annotations

import random
import re
from pathlib import Path

import corpus_pipeline
from colloquy.llm import queries, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(folder, spark):
    rng = random.Random(9)
    parts = {"aa": ["ka", "lo", "mi", "tu", "ren"], "bb": ["sch", "ung", "ei", "pf", "ber"]}
    docs, labels = [], []
    for k in range(160):
        lang = "aa" if k % 2 else "bb"
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(2, 4))) for _ in range(60)]
        toxic = int(k % 8 == 3)
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), "vileword" + rng.choice(parts[lang]))
        docs.append((k, "\n".join(" ".join(words[i : i + 15]) for i in range(0, len(words), 15)), lang, "s", 0))
        labels.append((k, 1, toxic))
    clean = next(t for d, t, *_ in docs if d == 0)
    one_word = clean.split(" ")
    one_word[30] = "tukami"
    docs += [(1000, clean, "bb", "s", 0), (1001, " ".join(one_word), "bb", "s", 0), (1002, None, "aa", "s", 0), (1003, "123 456", None, "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, {d for d, _, x in labels if x}


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, toxic = made(folder, spark)
    now, ids, columns = spark.read.parquet(f"{folder}/documents.parquet"), [], SCHEMA
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < 4:
            assert [c.split()[0] for c in columns.split(", ")] == out.columns
        out.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
    every = {d for d, *_ in docs}
    clean = {d for d in every - toxic if d < 1000}
    assert toxic.isdisjoint(ids[0]) and clean <= ids[0]
    assert ids[1] == ids[0] - {1002, 1003}
    # the exact copy loses all its lines to the first; the changed one keeps the changed line
    assert 1000 not in ids[2] and clean <= ids[2]
    assert clean <= ids[3]
    assert ids[4] == ids[3]
    sequences = {}
    for r in now.collect():
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert max(sequences.values()) <= 4096


def test_run_and_registered_queries(spark, tmp_path):
    folder = f"file://{tmp_path}"
    made(folder, spark)
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert sorted({int(q[2:].split("_")[0]) for q in queries.QUERIES}) == list(range(1, 11))


def test_language_stage_rejects_what_no_learned_language_has(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, _ = made(folder, spark)
    own = docs[0][1].split()
    rng = random.Random(3)
    random_words = ["".join(rng.choice("dfghjqvwxyz") for _ in range(7)) for _ in range(60)]
    mixed = own[:12] + random_words[:12] + ["это", "русский", "текст"] * 6 + ["日本語の文章"] * 10 + ["ελληνικά"] * 10
    odd = {2000: "日本語の文章 " * 20, 2001: "это русский текст " * 20, 2002: " ".join(random_words), 2003: " ".join(mixed), 2004: " ".join(own[:40] + random_words[:15])}
    more = spark.createDataFrame([(k, t, None, "s", 0) for k, t in odd.items()], SCHEMA)
    every = spark.read.parquet(f"{folder}/documents.parquet").union(more)
    kept = {r.doc_id for r in corpus_pipeline._language(spark, every, folder).select("doc_id").collect()}
    assert kept == {d for d, *_ in docs} - {1002, 1003} | {2004}


EXTRA = SCHEMA + ", id long, set string, page_id int, rank int, score double, line string, key long, h long"


def test_stages_take_empty_tables_repeats_and_clashing_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, toxic = made(folder, spark)
    rows = [(*d, k, "s", k, k, 0.1, "l", k, k) for k, d in enumerate(docs)]
    rows += [rows[0], rows[2], (None, rows[4][1], "bb", "s", 0, 9, None, 9, 9, None, None, 9, 9)]  # two repeated rows; a copy without an id
    full, empty = spark.createDataFrame(rows, EXTRA), spark.createDataFrame([], EXTRA)
    for start, count in ((full, None), (empty, 0)):
        now = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, folder)
            if k < 4:
                assert out.columns == start.columns, name
            out.write.parquet(f"{folder}/more-{count}-{k}")
            now = spark.read.parquet(f"{folder}/more-{count}-{k}")
            if k == 3 and count is None:
                kept = [r.doc_id for r in now.select("doc_id").collect()]
                assert kept.count(0) == kept.count(2) == 2 and None not in kept and toxic.isdisjoint(kept)
        assert count is None or now.count() == count


def test_a_stage_removes_what_the_one_before_had_stored(spark, tmp_path):
    folder = f"file://{tmp_path}"
    made(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline._toxicity(spark, docs, folder).write.parquet(f"{folder}/one")
    left = list(corpus_pipeline._LEFT)
    assert left and set(left) <= set(shared.stored_since())
    corpus_pipeline._language(spark, spark.read.parquet(f"{folder}/one"), folder).write.parquet(f"{folder}/two")
    assert set(left).isdisjoint(shared.stored_since())


def native_mb(spark):
    """MB of the driver's JVM that no file stands for."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def freed_in_pieces(spark):
    """About 60 MB outside the heap that the JVM frees, but for a piece here and there that stays in use."""
    held = [spark._jvm.java.util.zip.Deflater() for _ in range(400)]
    for k, x in enumerate(held):
        if k % 10:
            x.end()
    return held


def test_storing_and_stages_give_back_what_the_driver_has_freed(spark, tmp_path):
    folder = f"file://{tmp_path}"
    made(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    few = spark.range(10)
    shared.stored(few, "warm-up")
    for step in (lambda: shared.stored(few, "few"), lambda: corpus_pipeline.stage(lambda _, d, __: d)(spark, docs, folder)):
        held = freed_in_pieces(spark)
        before = native_mb(spark)
        step()
        assert before - native_mb(spark) > 20
        for x in held:
            x.end()
