import pytest
from pyspark.sql import functions as F

from bytelane.functions import bytes as B


def one(spark, expr, schema="x STRING", value=None):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


@pytest.mark.parametrize(
    "text,expected",
    [("hello", [104, 101, 108, 108, 111]), ("über", [195, 188, 98, 101, 114]), ("🥰", [240, 159, 165, 176]), ("", [])],
)
def test_text_to_bytes(spark, text, expected):
    assert one(spark, B.text_to_array("x"), value=text) == expected


def test_round_trip_multibyte(spark):
    for text in ("日本", "über", "🥰 bytes"):
        assert one(spark, B.array_to_text_strict(B.text_to_array("x")), value=text) == text


def test_all_byte_values(spark):
    data = bytes(range(256))
    assert one(spark, B.bytes_to_array("x"), "x BINARY", data) == list(range(256))
    assert bytes(one(spark, B.array_to_bytes(B.bytes_to_array("x")), "x BINARY", data)) == data


def test_safe_decode(spark):
    assert one(spark, B.array_to_text_safe("x", "?"), "x ARRAY<INT>", [104, 105]) == "hi"
    assert one(spark, B.array_to_text_safe("x", "?"), "x ARRAY<INT>", [195]) == "?"
    assert one(spark, B.array_to_text_safe("x", "?"), "x ARRAY<INT>", [104, 300]) == "?"


@pytest.mark.parametrize(
    "raw,expected",
    [(b"h\xc3\xc9llo world", "h��llo world"), (b"\xe2\xe2\xe2\xe2\x86\x91", "���↑")],
)
def test_replacement_decode(spark, raw, expected):
    assert one(spark, B.bytes_to_text_replace("x"), "x BINARY", raw) == expected
    assert raw.decode("utf-8", errors="replace") == expected


def test_int_string_and_overflow(spark):
    assert one(spark, B.array_to_int_string("x"), "x ARRAY<INT>", [1, 22, 255]) == "1 22 255"
    assert one(spark, B.drop_overflow("x"), "x ARRAY<INT>", [1, 256, 3]) == [1, 3]
    with pytest.raises(Exception):
        one(spark, B.check_no_overflow("x"), "x ARRAY<INT>", [1, 256])
    assert bytes(one(spark, B.int_to_byte("x"), "x INT", 65)) == b"A"
