"""Key store, catalogue, run history, quality sketches and raw records."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.functions import predicates as P
from postlens.operators import history as H
from postlens.operators import records as R
from postlens.session import scratch_path, scratch_scope
from postlens.sources import catalog as CT
from postlens.sources import keystore as KS


# ---- key store ----------------------------------------------------------------------------------

@pytest.fixture
def store(spark, tmp_path):
    s = KS.KeyStore(spark, f"keys_{uuid.uuid4().hex[:8]}", str(tmp_path / "keys"), buckets=4)
    yield s
    s.drop()


def keys(spark, names):
    return spark.createDataFrame([(n, "2024-01-01") for n in names], "key string, seen string")


def test_store_is_not_shuffled(spark, store, capsys):
    store.add(keys(spark, [f"k{i}" for i in range(1000)]))
    day = spark.createDataFrame([(i, f"k{i}") for i in range(900, 1100)] + [(5000, None)], "doc_id long, url string")
    assert sorted(r.doc_id for r in store.unseen(day, "url").collect()) == [*range(1000, 1100), 5000]
    got = store.seen(day, "url")
    assert got.count() == 100
    got.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    # the day's distinct keys lie left of the join and are dealt into the store's buckets; the store, at the
    # right, is read bucket by bucket
    right = plan[plan.index("Sort [key"):]
    assert "Exchange" not in right and "Bucketed: true" in right and "hashpartitioning(_key" in plan[:plan.index("Sort [key")]


def test_store_over_sessions_and_repeats(spark, store):
    for part in (["a", "b"], ["c"], ["a"], []):
        store.add(keys(spark, part))
    again = KS.KeyStore(spark, store.name + "_again", store.path, store.buckets)
    try:
        assert sorted(r.key for r in again.read().collect()) == ["a", "a", "b", "c"]
        rows = spark.createDataFrame([("a",), ("d",), ("d",)], "url string")
        assert [r.url for r in again.unseen(rows, "url").collect()] == ["d", "d"]
        assert {r.key for r in again.lookup(["a", "zz"]).collect()} == {"a"}
    finally:
        again.drop()


# ---- catalogue ----------------------------------------------------------------------------------

def test_listing_reads_no_content(spark, tmp_path, capsys):
    spark.range(100).withColumn("dataset", F.concat(F.lit("d"), (F.col("id") % 2).cast("string"))).write.partitionBy("dataset").json(str(tmp_path / "x"))
    files = CT.list_files(spark, str(tmp_path / "x"), "*.json")
    sets = CT.folders(files, "dataset")
    assert {r.dataset for r in sets.collect()} == {"d0", "d1"}
    sets.explain("formatted")
    plan = capsys.readouterr().out
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_runs_entered_again_change_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert CT.read_runs(spark, path).count() == 0

    def run(day, item, n):
        return spark.createDataFrame([(item, f"result={item}", ["m"], n, 1, 1, n - 2, day)], CT.RUN)

    for r in (run("1", "a", 5), run("2", "a", 6), run("1", "b", 7).union(run("1", "a", 5)), run("2", "a", 8), run("3", "c", 0)):
        CT.record_runs(r, path)
    got = {(r.run_id, r.input_file, r.item_count) for r in CT.read_runs(spark, path).collect()}
    assert got == {("1", "a", 5), ("1", "b", 7), ("2", "a", 8), ("3", "c", 0)}
    results = spark.createDataFrame([("/r/result=a/part-0", 10), ("/r/result=b/part-0", 0)], "file_path string, size long")
    sets = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset string")
    out = {r.dataset: (r.last_run, r.n_runs, r.item_count, r.models, r.is_analyzed) for r in CT.with_analyses(sets, CT.read_runs(spark, path), results).collect()}
    assert out == {"a": ("2", 2, 8, "m", True), "b": (None, 0, None, None, False), "c": (None, 0, None, None, False)}


def test_scratch_is_deleted_with_its_scope(spark):
    outer = scratch_path(spark, "stays")
    spark.range(3).write.parquet(outer)
    with scratch_scope(spark):
        inner = scratch_path(spark, "goes")
        spark.range(3).write.parquet(inner)
        assert spark.read.parquet(inner).count() == 3
    assert spark.read.parquet(outer).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner)


# ---- sketches -----------------------------------------------------------------------------------

def test_sketches_merge_within_their_bounds(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice("ab"), f"https://x/{r.randrange(20000)}", "c" * r.randrange(400), r.random(), f"2024-{r.randrange(1, 7):02d}-{r.randrange(1, 28):02d}")
            for _ in range(40000)]
    p = spark.createDataFrame(rows, "platform string, url string, content string, confidence double, day string").withColumn("base_date", F.col("day").cast("date"))
    path = str(tmp_path / "q")
    H.write_months(H.daily_sketches(p), path)
    H.write_months(H.daily_sketches(p.where("day like '2024-03%'")), path)          # a month again
    schema = spark.read.parquet(path).schema
    got = {x.platform: x for x in H.merge_span(spark, path, schema, "2024-02-10", "2024-05-20", ["platform"]).collect()}
    for name in "ab":
        own = [x for x in rows if x[0] == name and "2024-02-10" <= x[4] <= "2024-05-20"]
        g = got[name]
        assert g.n == len(own) and g.n_blank == sum(not x[2] for x in own)
        exact = len({x[1] for x in own})
        assert abs(g.n_urls - exact) < 0.06 * exact
        sizes = np.sort([len(x[2]) for x in own])
        for q, value in ((0.5, g.size_median), (0.9, g.size_p90)):
            rank = np.searchsorted(sizes, value, "right") / len(sizes)
            assert abs(rank - q) < 0.04


# ---- records ------------------------------------------------------------------------------------

def test_paths_of_any_depth(spark):
    raw = ['{"a": {"b": [{"c": 7}, {"c": "x"}]}, "d.e": 1, "f": null, "g": {"h": true}}', '{"a": 5}', "[1, {\"a\": 2}]", "broken {", None, '"text"']
    df = R.parsed(spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "k long, raw string"))
    got = df.select("k", *[R.text("record", p).alias(n) for n, p in {"x": "a.b.1.c", "n": "a.b.0.c", "o": "g", "f": "f", "a": "a", "l": "1.a"}.items()]).orderBy("k").collect()
    assert tuple(got[0])[1:] == ("x", "7", '{"h":true}', "", '{"b":[{"c":7},{"c":"x"}]}', "")
    assert [tuple(r)[1:] for r in got[1:]] == [("", "", "", "", "5", ""), ("", "", "", "", "", "2")] + [("",) * 6] * 3


def test_shapes_are_found(spark):
    rows = [("k", '{"a": 1}'), ("k", '{"a": 2, "b": ["x"]}'), ("k", "no json"), ("l", '{"c": {"d": 1.5}}')]
    got = {r.kind: (r.shape, r.n_records, r.n_malformed) for r in R.shapes(R.parsed(spark.createDataFrame(rows, "kind string, raw string")), "kind").collect()}
    assert got["k"] == ("OBJECT<a: BIGINT, b: ARRAY<STRING>>", 3, 1) and got["l"][0].startswith("OBJECT<c: OBJECT<d: DECIMAL")


def test_text_is_lowered_once(spark, capsys):
    spark.createDataFrame([("x",)], "s string").select(P.keyword_match_strict("s").alias("a"), P.postprocess_keep("s", "s").alias("b")).explain()
    assert capsys.readouterr().out.count("lower(") == 2
