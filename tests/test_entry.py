from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import catalog

#: Letters, digits and spaces outside of ASCII beside markers, where Unicode's classes and those of SQL part.
OTHER_LETTERS = [
    "de équeue, queueí o ñqueue; queue", "éthics ébias biasé éfirst then esecond", "a\u00a0source, ſource, \u212aeep, segfaultſ, mismatcheſ", "\u0130n order to, f\u0131x \u0131t, d\u0131sclos",
    "١٢٣ 12 words, ٤٥ lines, in about ٣", "1.\u00a0one\n1.\x0btwo\n\u00a03. x\n\u20034) y", "é(1) x ²(2) y —(3) z, seé (4) w éfor (5) v ſtep (6) u (7)\u00a0t :\u00a08) s (h) r",
    "éMRN: 1, patient\u00a0id 3, patient\x0bid 4, aſtudent id 5, patient \u0130d", "é@b.cc éa@b.cc ab.é@c.dd x@é.com x@b.ccé http://x\u00a0y ٣555-123-4567 555-123-4567٣",
    "x;\u00a0\n\u00a0}\n\u2003y;\u2028z;\n#define\u00e9 x\n#\x0bdefine y", "int x;\u2028int y;\n\u00a0\nint z;\n\x0b\nint w;", "that’s wrong, i’m trying to, i’ll rewrite; doesn’t run \u1e9e", "why\u0301 a\u0301gpl gpl\u0301 _gpl gpl_ 1gpl",
]
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_points_name_the_same_queries(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    show = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(got.select(*cols).collect()) == show(want.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", ["q_marker_families", "q_features_all", "q_features_session", "q_features_student", "q_recheck_window", "q_unprompted", "q_enumeration", "q_context_ratio", "q_tokens_specificity"])
def test_queries_equal_sql_on_other_letters(spark, tmp_path, name):
    rows = [(c, t, "user" if t % 3 == 0 else "assistant", OTHER_LETTERS[(c + t) % len(OTHER_LETTERS)]) for c in range(20) for t in range(len(OTHER_LETTERS))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
