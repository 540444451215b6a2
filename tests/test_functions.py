"""Expressions, with boundary and null cases."""

from pyspark.sql import functions as F

from fernweave.functions import numbers, text, web


def values(spark, expression, inputs, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, v {kind}")
    return [r[0] for r in frame.orderBy("k").select(expression(F.col("v"))).collect()]


def test_text(spark):
    assert values(spark, text.clean_text, [" a \n b\t", "", "  ", None]) == ["a b", None, None, None]
    assert values(spark, lambda c: text.snippet(c, 3), ["  abcdef", None]) == ["abc", None]
    assert values(spark, text.without_accents, ["Hồ Minh ệ", "Đà", "straße", None]) == ["Ho Minh e", "Đa", "straße", None]
    assert values(spark, text.normal_title, ["Đường  Số 5×5!", None]) == ["duong so 5x5", None]
    assert values(spark, text.slug, ["--A & B--", "x" * 100, ""]) == ["a-b", "x" * 80, ""]
    assert values(spark, text.looks_vietnamese, ["Nhà hàng ở", "House"]) == ["vi", "en"]
    assert values(spark, text.html_to_text, ["<p>a&amp;b</p><script>x()</script><br>c <!-- no -->", None]) == ["a&b\n\nc".replace("\n\n", "\n"), None]
    assert values(spark, text.redacted, ["x?token=abc&a=1"]) == ["x?token=***&a=1"]
    assert values(spark, lambda c: text.filled("hi {who}", who=c), ["Bo"]) == ["hi Bo"]


def test_web(spark):
    assert values(spark, web.host_of, ["HTTPS://www.A.example:80/x", "a.b.example", "none", None, "u:p@c.example"]) == ["a.example", "a.b.example", None, None, "c.example"]
    assert values(spark, web.registrable_domain, ["http://x.y.example", "http://a.b.co.example"]) == ["y.example", "b.co.example"]
    assert values(spark, web.normal_url, ["http://a.example/x/?q#f", "ftp://a.example", None]) == ["http://a.example/x", None, None]
    assert values(spark, web.canonical_url, ["http://www.A.example/Menu/?utm_source=x&b=1#top", "https://a.example/?ref=map"]) == ["https://a.example/Menu?b=1", "https://a.example"]
    assert values(spark, web.emails_in, ["Info@a.example, info@a.example x@b.example logo@2x.png", None]) == [["info@a.example", "x@b.example"], None]
    assert values(spark, web.email_kind, ["desk@a.example", "jobs@a.example", "bo@a.example"]) == ["general", "hiring", "personal"]
    assert values(spark, web.phone_digits, ["+84 (0)12-345 67", "12-34", None]) == ["+8401234567", None, None]
    assert values(spark, web.public_host, ["http://a.example", "http://10.0.0.1", "http://x.local", "http://u:p@a.example", None]) == [True, False, False, False, False]


def test_numbers(spark):
    assert values(spark, lambda c: numbers.clamped(c, 0, 1), [2.0, -1.0, None, float("nan"), 0.5], "double") == [1.0, 0.0, 0.0, 0.0, 0.5]
    assert values(spark, numbers.fixed, [1.005, 2.675, 0.125, -1.555, None], "double") == [1.0, 2.67, 0.13, -1.55, None]

    def poly(s):
        h = 0
        for c in s:
            code = ord(c) if ord(c) < 0x10000 else 0xD800 + ((ord(c) - 0x10000) >> 10)
            h = (h * 31 + (1 << 31)) % (1 << 32) - (1 << 31) + code
        return abs(h)

    texts = ["", "abc", "đường", "x" * 50, "7|105", "a😀b"]
    assert values(spark, numbers.polynomial_hash, texts) == [poly(s) for s in texts]
    assert values(spark, numbers.polynomial_hash, ["abc", "zzzzzzz"]) == [96354, 215481018]
    assert values(spark, numbers.isbn10_valid, ["0-306-40615-2", "080442957X", "0306406153", "X306406152", None]) == [True, True, False, False, False]
    assert values(spark, numbers.isbn10_of, ["030640615", "080442957"]) == ["0306406152", "080442957X"]
    assert values(spark, numbers.isbn13_valid, ["978-0-306-40615-7", "9780306406158", "123", None]) == [True, False, False, False]
    assert values(spark, numbers.isbn13_of, ["030640615"]) == ["9780306406157"]
    assert values(spark, lambda c: numbers.stable_id("x", c, F.lit(None)), ["a"])[0].startswith("x:")
