
from pyspark.sql import functions as F

from postlens.functions import text as T
from tests.conftest import one


def test_clean_example(spark):
    # C17
    assert one(spark, T.basic_clean(F.col("s")), "<b>x</b> a@b.co https://t.co/z ok!") == "x ok!"


def test_clean_unicode_blanks_and_specials(spark):
    s = "  Héllo wörld #tag ✓ 123_x \t\n end. "
    assert one(spark, T.basic_clean(F.col("s")), s) == "Héllo wörld tag 123_x end."


def test_clean_idempotent(spark):
    for s in ["a  b", "x <i>y</i> z!!", "Ünïcödé, text? yes.", "mail me: a.b@c.de now"]:
        once = one(spark, T.basic_clean(F.col("s")), s)
        assert one(spark, T.basic_clean(F.col("s")), once) == once


def test_chunk_short_text_unchanged(spark):
    s = "Short text. Another one!"
    assert one(spark, T.preprocess(F.col("s")), s) == s


def test_chunk_first_qualifying_chunk(spark):
    # 30 sentences of 200 characters (50 tokens each): 10 fit into 512 tokens
    sent = "a" * 199
    text = ". ".join([sent] * 30) + "."
    out = one(spark, T.preprocess(F.col("s")), text)
    assert out == " ".join([sent] * 10)


def test_chunk_falls_back_to_prefix(spark):
    # one giant sentence of 5000 chars = 1250 tokens: a single chunk > 512 tokens is still kept
    # (it qualifies with >= 30 tokens) -> the whole sentence
    text = "b" * 5000
    assert one(spark, T.preprocess(F.col("s")), text) == text
    # many tiny sentences of 3 chars (0 tokens each) never reach 30 tokens -> first 4096 chars
    tiny = ". ".join(["abc"] * 1200)
    assert one(spark, T.preprocess(F.col("s")), tiny) == tiny[:4096]


def test_fixed_pieces_cover_text(spark):
    s = "x" * 12345
    pieces = one(spark, T.fixed_pieces(F.col("s")), s)
    assert [len(p) for p in pieces] == [5000, 5000, 2345]
    assert "".join(pieces) == s
    assert one(spark, T.fixed_pieces(F.col("s")), "") == []


def test_safe_keyword(spark):
    assert one(spark, T.safe_keyword(F.col("s")), "buan trip!! 2024") == "buan_trip_2024"


def test_query_variations(spark):
    # C8
    df = spark.createDataFrame([("r", ["a"], ["b", "c"]), ("r", [], ["b"])],
                               "region string, ands array<string>, ors array<string>")
    rows = df.select(T.query_variations("region", "ands", "ors").alias("v")).collect()
    assert set(rows[0]["v"]) == {"r a b", "r a c", "r a b c"}
    assert set(rows[1]["v"]) == {"r", "r b"}


