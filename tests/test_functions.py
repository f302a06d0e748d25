import pytest
from pyspark.sql import functions as F

from linkwright.functions import sets as S
from linkwright.functions import text as X


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "text,segments",
    [("QZ-MKLO-14TX-C3", ["qz", "mklo14tx", "c3"]), ("zx9q4d 7k", ["zx9q4d7k"]), ("garden chairs", ["garden", "chairs"]), ("ab12 34cd", ["ab1234cd"]), ("lamp 60 watt", ["lamp60watt"]), ("+ +", []), ("9 8 7", ["987"])],
)
def test_segments(spark, text, segments):
    assert one(spark, [(text,)], "s string", X.segments(F.col("s"))) == [segments]


def test_tokens_and_ngrams(spark):
    s = F.col("s")
    assert one(spark, [("QZ-MKLO-14TX-C3 qz",), (None,)], "s string", X.word_tokens(s)) == [["qz", "mklo", "14tx", "c3", "qz"], None]
    assert one(spark, [("usb",), ("abcde",), ("abcdefabcde",)], "s string", X.char_ngrams(s)) == [[], ["abcde"], ["abcde", "bcdef", "cdefa", "defab", "efabc", "fabcd"]]
    shared = one(spark, [("qzmklo14txc3", "qz-mklo-14tx-c3")], "a string, b string", F.array_intersect(X.char_ngrams(F.col("a")), X.char_ngrams(F.col("b"))))
    assert "mklo1" in shared[0]
    assert one(spark, [("A-B c1!",)], "s string", X.collapsed(s)) == ["abc1"]


def test_identifier_shapes(spark):
    rows = [(t,) for t in ("gt7250v", "mnopq34", "2098765", "green", "2160", "hub", "b2")]
    assert one(spark, rows, "s string", X.is_identifier_like(F.col("s"))) == [True, True, False, False, False, False, False]
    assert one(spark, rows, "s string", X.is_identifier_shaped(F.col("s"))) == [True, True, True, False, False, False, False]


def test_prices(spark):
    rows = [("19.99",), ("0",), ("-5",), ("not a price",), (None,), ("5d",), ("nan",), ("inf",), (" 7 ",), ("1e400",)]
    assert one(spark, rows, "s string", X.parse_price(F.col("s"))) == [19.99, None, None, None, None, None, None, None, 7.0, None]


def test_record_texts(spark):
    row, schema = [("Widget XL", None, "Acme", None, "9.99")], "title string, category string, brand string, modelno string, price string"
    assert one(spark, row, schema, X.record_text(schema.replace(" string", "").split(", "))) == ["widget xl acme 9.99"]
    assert one(spark, row, schema, X.labelled_text(["title", "category", "price"])) == ["title: Widget XL | price: 9.99"]


@pytest.mark.parametrize(
    "a,b,conflict",
    [("1tb", "1024gb", False), ("512mb", "32gb", True), ("8gb or 64 gb", "64gb", False), ("20 inch", "nothing", False), ("32gb 20 inch", "32gb 24 inch", True), ("20 inch", "20w", False), ("kq-256mb-z", "256mb", False), ("5 inland harbours", '27"', False)],
)
def test_quantity_conflicts(spark, a, b, conflict):
    q = X.quantities
    assert one(spark, [(a, b)], "a string, b string", S.quantities_conflict(q(F.col("a")), q(F.col("b")))) == [conflict]


def test_similarities(spark):
    rows = [(["a", "b", "c"], ["b", "c", "d"]), ([], []), (["a"], []), (["a"], ["a"]), (None, ["a"])]
    schema = "a array<string>, b array<string>"
    assert one(spark, rows, schema, S.word_jaccard(F.col("a"), F.col("b"))) == [0.5, None, 0.0, 1.0, None]
    assert one(spark, rows, schema, S.set_jaccard(F.col("a"), F.col("b"))) == [0.5, 0.0, 0.0, 1.0, 0.0]
    prices = [(49.99, 49.99), (10.0, 15.0), (None, 1.0)]
    assert one(spark, prices, "a double, b double", S.price_gap(F.col("a"), F.col("b"))) == [0.0, pytest.approx(1 / 3), None]
    assert one(spark, [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>", S.cosine(F.col("a"), F.col("b"))) == [pytest.approx(1), None]


def test_bits(spark):
    got = one(spark, [(0.5,), (2 / 3,), (1.0,), (0.0,)], "p double", S.match_bits(F.col("p")))
    assert got[:2] == [0.0, pytest.approx(1.0)] and got[2] == pytest.approx(-got[3], rel=0.01)
    assert one(spark, [(6.0,)], "b double", S.probability(F.col("b"))) == [pytest.approx(64 / 65)]
    assert one(spark, [(61.47, 58.95, 64.09)], "a double, b double, c double", X.interval(F.col("a"), F.col("b"), F.col("c"))) == ["61.47 [58.95, 64.09]"]
    assert X.human_size(2048) == "2.0 KB"
