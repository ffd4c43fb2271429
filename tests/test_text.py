from pyspark.sql import functions as F

from kinmatch.functions import text as T


def one(spark, raw, f, *more):
    return spark.createDataFrame([(raw, *more)], "raw string" + "".join(f", c{i} string" for i in range(len(more)))).select(f).first()[0]


FORMS = [
    ("name", "\t Ｎorthwind   ŠTEEL\u00a0 ", "northwind šteel"), ("name", "O\u2019Hara & Mills (Dublin), PLC.", "ohara and mills dublin plc"), ("name", "X.Y. Optics", "x y optics"),
    ("core", "Blue Heron Kayaks Pvt. Ltd.", "blue heron kayaks"), ("core", "Kestrel L.P.", "kestrel"), ("core", "Corporation Street Bakers GmbH", "corporation street bakers"),
    ("search", "Żółw Ærø", "zołw ærø"), ("standard", "77 Elm Ct, Suite 4, Quarry Ln", "77 elm court suite 4 quarry lane"), ("text", " ＫＥＮＹＡ\u3000", "kenya"), ("text", "\n\t", ""),
]


def test_forms(spark):
    forms = {"name": T.normalize_name, "core": T.core_name, "search": T.name_search_text, "standard": T.standardize_address, "text": T.normalize_text}
    for kind, raw, expected in FORMS:
        assert one(spark, raw, forms[kind]("raw")) == expected, raw


def test_other_scripts_keep_marks(spark):
    assert one(spark, "नदी किनारा – पुस्तकालय", T.normalize_name("raw")) == "नदी किनारा पुस्तकालय"
    assert one(spark, "ก้าวหน้า_2", T.normalize_name("raw")) == "ก้าวหน้า 2"


def test_blanks_are_empty(spark):
    for raw in (None, "", "   "):
        assert one(spark, raw, T.normalize_name("raw")) == ""
        assert one(spark, raw, T.tokens(T.normalize_name("raw"))) == []


def test_core_name_may_become_empty_and_keeps_inner_words(spark):
    assert one(spark, "Company Inc", T.core_name("raw")) == ""
    assert one(spark, "Inc Limited Editions", T.core_name("raw")) == "inc limited editions"


def test_numbers_and_postals(spark):
    assert one(spark, "Block 7/007, Pier 0450 - unit 7C", T.numeric_tokens("raw")) == ["7", "007", "0450", "7"]
    for raw, country, expected in (("lot 4, 60614-0099", "US", "60614-0099"), ("040010 then 411045", "India", "411045"), ("13008 Marseille", "France", "13008"), ("13008", "Narnia", None)):
        assert one(spark, raw, T.postal_candidate("raw", "c0"), country) == expected


def test_safe_numbers(spark):
    rows = spark.createDataFrame([("1.5",), ("",), ("nan",), ("inf",), (None,)], "raw string").select(T.safe_double("raw").alias("d"), T.safe_int("raw").alias("i")).collect()
    assert [r.d for r in rows] == [1.5, 0, 0, 0, 0] and rows[0].i == 1 and rows[1].i == 0


def test_tokens_keep_order_and_repetition(spark):
    assert one(spark, "b a b", T.tokens(F.col("raw"))) == ["b", "a", "b"]
