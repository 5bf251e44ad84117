from __future__ import annotations

import json

import pytest

from colloquy.operators import turns
from colloquy.sources import readers, writers


def test_jsonl_keeps_turns_and_rejects_faults(spark, tmp_path):
    good = {"session_id": "s", "student": None, "role": "user", "turn": 0, "content": "hi"}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"turn": 1}) + "\n")
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text("{oops\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + "\n\n{oops\n")
    with pytest.raises(Exception, match="b.jsonl:3: not a JSON object"):
        readers.read(spark, "jsonl", str(tmp_path / "b.jsonl")).collect()
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), numbers=False).collect()
    (tmp_path / "c.jsonl").write_text('{"session_id": "s"}\n')
    with pytest.raises(Exception, match="c.jsonl:1: missing student"):
        readers.read_jsonl(spark, str(tmp_path / "c.jsonl")).collect()
    (tmp_path / "d.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        readers.read_jsonl(spark, str(tmp_path / "d.jsonl"))
    (tmp_path / "e.jsonl").write_text((json.dumps(good) + "\n") * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path / "e.jsonl"))
        assert lines.rdd.getNumPartitions() > 3
        assert sorted(r.number for r in lines.collect()) == list(range(1, 3001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_node_export_sorts_by_time_and_drops_empties(spark, tmp_path):
    node = lambda role, at, parts, slug=None: {"message": {"author": {"role": role}, "create_time": at, "content": {"parts": parts}, "metadata": {"model_slug": slug}}}
    conv = {"conversation_id": "", "id": "c1", "mapping": {"r": {"message": None}, "b": node("assistant", 2.0, ["yes"], "m1"), "a": node("user", 1.0, ["one", {"image": 1}, "two"]), "e": node("user", 1.5, [" "]), "t": node("tool", 3.0, ["out"])}}
    (tmp_path / "x.json").write_text(json.dumps([conv]))
    rows = readers.read(spark, "openai", str(tmp_path / "x.json"), model="pinned").orderBy("turn").collect()
    assert [(r.session_id, r.turn, r.role, r.content, r.model) for r in rows] == [("c1", 0, "user", "one\ntwo", "pinned"), ("c1", 1, "assistant", "yes", "m1"), ("c1", 2, "system", "out", "pinned")]


def test_flat_export_leaves_gaps(spark, tmp_path):
    conv = {"uuid": "u", "chat_messages": [{"text": "hi", "sender": "human"}, {"text": "", "content": [], "sender": "assistant"}, {"text": "", "content": [{"text": "a"}, {"text": "b"}], "sender": "assistant"}]}
    (tmp_path / "x.json").write_text(json.dumps(conv))
    rows = readers.read(spark, "anthropic", str(tmp_path / "x.json")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.content) for r in rows] == [(0, "user", "hi"), (2, "assistant", "a\nb")]


def test_transcripts_and_directory(spark, tmp_path):
    (tmp_path / "07_bo.txt").write_bytes("Title\n\nStudent: hi\nthere\n**Assistant:** yes\n[User]: \nClaude: ok \xff".encode("latin-1"))
    (tmp_path / "x.txt").write_text("no labels")
    rows = readers.read(spark, "dir", str(tmp_path)).orderBy("turn").collect()
    assert [(r.session_id, r.student, r.turn, r.role, r.content.strip("� ")) for r in rows] == [("07_bo", "7", 0, "user", "hi\nthere"), ("07_bo", "7", 1, "assistant", "** yes"), ("07_bo", "7", 3, "assistant", "ok")]
    with pytest.raises(FileNotFoundError):
        readers.read(spark, "dir", str(tmp_path / "none"))
    with pytest.raises(ValueError, match="unknown source"):
        readers.read(spark, "pdf", "x")


def test_csv_counts_turns_in_file_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sid,role,content\na,Human,x\nb,q,y\na,AI:,z\n")
    rows = readers.read_csv(spark, str(tmp_path / "t.csv"), session_id="sid").orderBy("session_id", "turn").collect()
    assert [(r.session_id, r.turn, r.role) for r in rows] == [("a", 0, "user"), ("a", 1, "assistant"), ("b", 0, "user")]


def test_unknown_roles_and_rosters_are_errors(spark):
    df = spark.createDataFrame([("s1", "narrator"), ("s2", "user")], "session_id string, role string")
    with pytest.raises(Exception, match="unknown role"):
        df.select(turns.role_of(df.role)).collect()
    with pytest.raises(ValueError, match="no student for sessions .'s2'"):
        turns.pseudonyms(df, spark.createDataFrame([("s1", "x")], "session_id string, student string"))
    assert {(r.session_id, r.pseudonym) for r in turns.pseudonyms(df)[1].collect()} == {("s1", 1), ("s2", 2)}


def test_codes_are_dense_in_order(spark):
    names = [f"S{k:03d}" for k in range(300)] + ["a", "é", "Z"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "student string")
    got = {r.student: r.code for r in turns.dense_codes(df, "student", 7).collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=str.encode), 1)}


def test_cutpoints_crosswalk_and_r_script(spark, tmp_path):
    from colloquy.operators import scoring, simulate

    writers.write_json(scoring.A_PRIORI, str(tmp_path / "cuts.json"))
    assert readers.read_cutpoints(str(tmp_path / "cuts.json")) == scoring.A_PRIORI
    writers.put(spark, "text é", f"file://{tmp_path}/deep/t.txt")
    assert (tmp_path / "deep" / "t.txt").read_text(encoding="utf-8") == "text é"
    cross = spark.createDataFrame([("s", "x", 1)], "session_id string, student string, pseudonym int")
    writers.write_crosswalk(cross, str(tmp_path / "cross"))
    assert spark.read.csv(str(tmp_path / "cross"), header=True).first().asDict() == {"session_id": "s", "student": "x", "pseudonym": "1"}
    script = open(writers.lavaan(spark.createDataFrame(simulate.one_factor(9, 1)), str(tmp_path / "r"))).read()
    assert "Prompt" in script and "G =~" in script and "lavTestLRT(single, fit)" in script
    assert len((tmp_path / "r" / "items.csv").read_text().splitlines()) == 10


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", None, [1.0, 2.0])], "a string, b string, c array<double>")
    writers.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"s","c":[1.0,2.0]}'
    writers.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().c == "[1.0,2.0]"
    assert r"a\_b" in writers.latex_table([{"a_b": "5%"}], "c", "l")
