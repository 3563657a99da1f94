"""The pipeline's stages against brute force on a small folder, and every query on the small tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from postlens.llm import mixing, pii_feistel, queries, toxicity_crf

from .conftest import prose
from .test_copies import brute_components, brute_leaks, words

SMALL = "/root/testdata/sf0.001"


def test_stage_order_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLE) <= set(names)


def test_pipeline_equals_brute_force(spark, frame, tmp_path):
    items = [(k, prose(700 + k, 30)) for k in range(3)]
    base = prose(800, 120)
    t = [prose(810 + k, 90) for k in range(20)] + [base, base + " tail", base.replace(" w", " W", 3), prose(801, 60) + " " + items[1][1],
         prose(802, 60) + " " + " ".join(["scum idiot"] * 4), "see 10.0.0.1 and x@y.example.com " + prose(803, 60), None, "", "", base]
    ids = list(range(len(t)))
    df = frame(t, ids, ["a", "b", None] * 10, clash=False)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, 1, 0) for k in range(20)] + [(24, 1, 1)]
    toxic = [(1000 + k, 1, int(k % 2)) for k in range(240)]
    more = frame([prose(900 + k, 40) + " scum idiot" * (k % 2) for k in range(240)], [x[0] for x in toxic], clash=False)
    more.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks + toxic, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.read.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    bad = {r["doc_id"] for r in toxicity_crf.toxicity(docs, lab).where("predicted = 1").collect()}
    assert bad >= {24} and not bad & set(range(20))
    rows = [r for r in rows if r[0] not in bad]
    comp = {i: c for i, n, c in brute_components([r[:2] for r in rows]) if n}
    rows = [r for r in rows if not words(r[1]) or comp[r[0]] == r[0]]
    leaked = {d for d, _ in brute_leaks([r[:2] for r in rows], items)}
    assert leaked == {23}
    rows = [r for r in rows if r[0] not in leaked]
    left = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = pii_feistel.pseudonymise(left)
    want = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(left).collect()}

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "mix_copy"]
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(got.get(i, 0) * size == taken for i, (taken, size) in want.items())
    assert not out.where(F.col("text").contains("10.0.0.1")).count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_whole_tables(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    n = out.count()
    whole = {"op1": None, "op6": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    each = 16 if name.startswith("op11_") else 1            # a row for each component
    if whole:
        assert n == each * spark.read.parquet(f"{SMALL}/{whole}.parquet").count()
    else:
        assert n > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]

    def key(row):
        return tuple(round(row[c], 4) if isinstance(row[c], float) else row[c] for c in sorted(cols))
    want = sorted(key(dict(zip(cols, r, strict=True))) for r in cur.fetchall())
    out = queries.QUERIES[name](spark, SMALL)
    assert sorted(out.columns) == sorted(cols)
    assert sorted(key(r.asDict()) for r in out.collect()) == want
