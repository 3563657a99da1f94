"""Array files (reader and sink) and keyword tables against plain Python."""

import io
import json
import os
import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.operators import keywords as K
from postlens.sources import arrays as A

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(alphabet='a"\\[]{},: é\n', max_size=8),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet='k"\\}', max_size=3), x, max_size=3), max_leaves=6)


def cut(raw, step):
    """All elements, range by range, as the two passes find them."""
    f, inside, depth, out = io.BytesIO(raw), 0, 0, []
    for start in range(0, len(raw), step):
        end = min(start + step, len(raw))
        out += [b for _, b in A.elements(f, len(raw), start, end, inside, depth)]
        quotes, outside, within = A.summarise(f, start, end)
        depth += within if inside else outside
        inside = (inside + quotes) % 2
    return out


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(x=st.lists(VALUES, max_size=6), step=st.integers(1, 40), chunk=st.integers(1, 60), ascii_=st.booleans(),
       indent=st.sampled_from([None, 2]), around=st.sampled_from(["", " ", "\n\t", "﻿"]))
def test_ranges_cut_what_json_reads(monkeypatch, x, step, chunk, ascii_, indent, around):
    monkeypatch.setattr(A, "CHUNK", chunk)
    raw = (around + json.dumps(x, ensure_ascii=ascii_, indent=indent) + around.strip("﻿")).encode()
    assert [json.loads(e) for e in cut(raw, step)] == x


def records(n):
    r = random.Random(6)
    nasty = ['quote " and \\ slash', "], [", "}{", "\\\\\"", "line\nbreak", "é ü 한국어", "", "plain"]
    return [{"doc_id": k, "title": r.choice(nasty), "tags": [r.choice(nasty) for _ in range(k % 4)],
             "inner": {"a": r.choice(nasty), "b": None}} for k in range(n)]


SCHEMA = "doc_id long, title string, tags array<string>, inner struct<a:string,b:string>"


def plain(row):
    return {"doc_id": row.doc_id, "title": row.title, "tags": list(row.tags), "inner": {"a": row.inner.a, "b": row.inner.b}}


def test_a_long_array_is_read_by_many_tasks(spark, tmp_path):
    x = records(8000)
    raw = json.dumps(x, ensure_ascii=False, indent=2)
    (tmp_path / "naver_blog_8000_x_20240601_010203.json").write_text(raw, encoding="utf-8")
    df = A.read_arrays(spark, str(tmp_path), SCHEMA, range_bytes=50_000)
    assert df.rdd.getNumPartitions() == -(-len(raw.encode()) // 50_000) > 10
    got = df.collect()
    assert sorted((plain(r) for r in got), key=lambda r: r["doc_id"]) == x
    assert {(r.file_platform, r[A.CORRUPT]) for r in got} == {("naver", None)}


def test_odd_files(spark, tmp_path):
    files = {"a_1.json": "[]", "b_1.json": "", "c_1.json": '﻿ [{"doc_id": 1}]', "d_1.json": '{"doc_id": 2}', "e_1.json": '[{"doc_id": 3}, {"doc_id": 4',
             "f_1.json": '[1, "x", {"doc_id": "no number"}, null, {"doc_id": 5, "other": [1]}]', "_g.json": '[{"doc_id": 6}]', "h.txt": "[7]",
             "sub/i_1.json": '[{"doc_id": 8}]'}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    for step in (4, 1000):
        got = {}
        for r in A.read_arrays(spark, f"file://{tmp_path}", "doc_id long, title string", step).collect():
            got.setdefault(r.file_platform, []).append((r.doc_id, r[A.CORRUPT]))
        assert got.pop("c") == [(1, None)] and got.pop("i") == [(8, None)]
        assert got.pop("d") == [(None, '{"doc_id": 2}')]
        assert sorted(got.pop("e"), key=str) == [(3, None), (None, ' {"doc_id": 4')]
        assert sorted(got.pop("f"), key=str) == [(5, None), (None, ' "x"'), (None, " null"), (None, ' {"doc_id": "no number"}'), (None, "1")]
        assert got == {}


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        A.read_arrays(spark, str(tmp_path / "nowhere"), "a long").collect()


def test_sink_writes_arrays(spark, tmp_path):
    x = records(500)
    df = spark.createDataFrame([json.dumps(r) for r in x], "string").select(F.from_json("value", SCHEMA).alias("r")).select("r.*")
    named = df.withColumn("name", F.concat(F.lit("site"), (F.col("doc_id") % 3).cast("string"), F.lit("_all")))
    path = str(tmp_path / "out")
    A.write_arrays(named, path, "name", gather=True)
    names = os.listdir(path)
    assert {n.split("_")[0] for n in names} == {"site0", "site1", "site2"} and all(n.endswith(".json") for n in names)
    assert sum(len(json.load(open(f"{path}/{n}", encoding="utf-8"))) for n in names) == 500
    back = A.read_arrays(spark, path, SCHEMA, 7000)
    assert sorted((plain(r) for r in back.collect()), key=lambda r: r["doc_id"]) == x
    A.write_arrays(named.where("doc_id < 10"), path, "name", "overwrite")
    assert A.read_arrays(spark, path, SCHEMA).count() == 10
    A.write_arrays(named.where("doc_id < 0"), path, "name")
    assert A.read_arrays(spark, path, SCHEMA).count() == 10


# ---- keyword tables -----------------------------------------------------------------------------

TEXTS = ["abab ababab", None, "", "Ünder the Bridge, under THE bridge", "aaaa aa a", "no match", "x" * 5000 + "needle" + "y" * 100, "aba"]
WORDS = ["ab", "aba", "a", "aa", "bridge", "ÜNDER", "needle", "the", "zzz", None, "", "AB"]


def plain_matches(text, words):
    text = (text or "").lower()
    return sorted((text.find(w) + 1, w, text.count(w)) for w in {w.lower() for w in words if w} if w in text)


@pytest.mark.parametrize("part_bytes", [1 << 20, 6])
def test_matches_equal_search(spark, part_bytes):
    """Also with a table cut to several automata."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string").withColumns({"n": F.lit(1), "first": F.lit("x")})
    words = spark.createDataFrame([(w,) for w in WORDS], "keyword string")
    got = K.with_matches(df, "content", words, part_bytes=part_bytes)
    assert got.columns == ["doc_id", "content", "n", "first", "matches"]
    for r in got.collect():
        assert [(m["first"], m["keyword"], m["n"]) for m in r.matches] == plain_matches(TEXTS[r.doc_id], WORDS)


def test_one_automaton_at_a_time(spark):
    """However many parts a table has, a task has one Python worker and that one automaton."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string")
    words = spark.createDataFrame([(w,) for w in WORDS], "keyword string")
    assert len(list(K.keyword_parts(words, part_bytes=6))) > 2
    plan = K.with_matches(df, "content", words, part_bytes=6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    texts = [(t or "").lower() for t in TEXTS]
    parts = [(f"t{k}", pa.array(w)) for k, w in enumerate((["ab", "a"], ["aba"], ["bridge", "the"]))]
    batches = [pa.RecordBatch.from_pydict({"_text": texts[k:k + 2]}) for k in range(0, len(texts), 2)]
    for hold in (1, 40, 1 << 20):
        found = [f for b in K.match_batches(parts, iter(batches), hold) for f in b.column("_found").to_pylist()]
        assert [sorted((m["first"], m["keyword"], m["n"]) for m in f) for f in found] == \
            [plain_matches(t, ["ab", "a", "aba", "bridge", "the"]) for t in texts]
        assert len(K._automaton) == 1


def test_matches_as_written_and_empty_table(spark):
    df = spark.createDataFrame([(1, "The the")], "doc_id long, content string")
    words = spark.createDataFrame([("The",), ("THE",)], "keyword string")
    assert [tuple(m) for m in K.with_matches(df, "content", words, ignore_case=False).first().matches] == [("The", 1, 1)]
    assert K.with_matches(df, "content", words.where("false")).first().matches == []


def test_many_keywords(spark):
    words = spark.range(50_000).select(F.concat(F.lit("kw"), F.col("id").cast("string"), F.lit(";")).alias("keyword"))
    df = spark.createDataFrame([(1, "kw7; kw49999; kw7; kw50000;")], "doc_id long, content string")
    assert [tuple(m) for m in K.with_matches(df, "content", words, part_bytes=200_000).first().matches] == [("kw7;", 2, 1), ("kw49999;", 1, 6)]


def test_rules(spark):
    rules = spark.createDataFrame([
        (1, 0, "Bridge", "AND"), (1, 1, "under", "AND"), (2, 0, "ab", "AND"), (2, 1, "zzz", "OR"), (2, 2, "aba", "OR"),
        (3, 0, "ab", "AND"), (3, 1, "zzz", "AND"), (4, 1, "ab", "AND"), (5, 0, "aa", "AND"), (5, 1, None, "AND"), (6, 0, "a", "OR"), (6, 1, "a", "OR")],
        "rule_id long, place int, text string, condition string")
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string")
    got = {(r.rule_id, r.doc_id) for r in K.rule_hits(df, "doc_id", "content", rules).collect()}
    low = [(t or "").lower() for t in TEXTS]
    want = {(1, k) for k, t in enumerate(low) if "bridge" in t and "under" in t} | {(2, k) for k, t in enumerate(low) if "aba" in t}
    want |= {(5, k) for k, t in enumerate(low) if "aa" in t} | {(6, k) for k, t in enumerate(low) if "a" in t}
    assert got == want


def test_snippet(spark):
    x = spark.createDataFrame([("0123456789needle0123456789", 11, "needle")], "t string, p int, k string")
    cuts = x.select(K.snippet(F.col("t"), F.col("p"), F.col("k"), 3).alias("a"), K.snippet(F.col("t"), F.col("p"), F.col("k"), 50).alias("b")).first()
    assert tuple(cuts) == ("...789needle012...", "0123456789needle0123456789")
