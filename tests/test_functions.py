import pytest
from pyspark.sql import functions as F

from leadflow.functions import dates as D
from leadflow.functions import text as T


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_money(spark):
    vectors = {
        "$1.500.000": 1500000, "1.500.000": 1500000, "1,500,000": 1500000, "2 millones": 2000000, "1 palo": 1000000, "6 palos": 6000000, "2000 mil": 2000000, "2000mil": 2000000,
        "3000mil": 3000000, "4900 mil": 4900000, "1.5 millones": 1500000, "1 millon": 1000, "hola 5": None, "presupuesto": None, "3 meses cuota": 3000, "": None,
    }
    assert column(spark, [*vectors, None], T.parse_amount) == [*vectors.values(), None]


def test_phones(spark):
    got = column(spark, ["3001234567", "+57 300 123 4567", "0057-3001234567", "12345", None], T.phone_normalized)
    assert got == ["+573001234567"] * 3 + [None, None]
    assert column(spark, ["3001234567", "12345", None], T.phone_status) == ["VALID", "INVALID", "MISSING"]
    assert column(spark, ["573001234567", "12-345"], T.profile_phone) == ["+573001234567", "12345"]


def test_dates(spark):
    values = ["2026-01-05", "2026-01-05 10:00", "2026-02-30", "31-04-2026", "30-04-2026", "05/06/2026", "13/01/2026", "01/13/2026 10:00", "13/13/2026", " ", None, "x"]
    assert column(spark, values, D.date_status) == ["VALID", "VALID", "INVALID", "INVALID", "VALID", "AMBIGUOUS", "VALID", "VALID", "INVALID", "MISSING", "MISSING", "INVALID"]
    shown = [str(v) if v else None for v in column(spark, values, D.date_value)]
    assert shown == ["2026-01-05", "2026-01-05", None, None, "2026-04-30", None, "2026-01-13", "2026-01-13", None, None, None, None]
    edges = ["13/01/2026T10:00", "0/5/2026", "13/01/2026\t10:00", "13/0/2026", "5/13/2026 x"]
    assert column(spark, edges, D.date_status) == ["VALID", "AMBIGUOUS", "INVALID", "INVALID", "VALID"]
    assert column(spark, ["2026-01-05", "05-01-2026", "5/1/2026", "x"], D.date_format_label) == ["ISO", "DD-MM-YYYY", "SLASH", "OTHER"]


def test_text(spark):
    assert column(spark, ["  Hónda   CB ", None], T.normalize_text) == ["honda cb", None]
    assert column(spark, ["hónda-cb/190r"], T.normalize_lexical) == ["honda cb 190r"]
    assert column(spark, [" Honda  CB 190R ", "Façade-Ö", None], T.normalize_model) == ["honda cb 190r", "facade o", ""]
    assert column(spark, ["WhatsApp", " Meta  Ads", "radio", None], T.channel) == ["whatsapp", "meta_ads", None, None]
    assert column(spark, ["abc\x00def", "\\u0000"], T.strip_nul) == ["abcdef", "\\u0000"]
    assert column(spark, ["Sí", "NO", "x", None], T.yes_no) == [True, False, None, None]
    assert column(spark, ["1.5", "1,5", "", None], lambda c: T.number_status(c, True)) == ["VALID", "INVALID", "MISSING", "MISSING"]


def test_error_classes(spark):
    texts = ["Length limit was reached", "HTTP 429", "request timed out", "model gpt is not available", "ConnectError", "bad json"]
    assert column(spark, texts, T.classify_error) == ["output_length_limit", "rate_limit", "request_timeout", "model_unavailable", "request_error", "structured_output_invalid"]


@pytest.mark.parametrize("value,expected", [("Bogotá D.C.", "bogota"), ("  RIO   negro ", "rionegro"), ("Lima", None)])
def test_city(spark, value, expected):
    assert column(spark, [value], T.city) == [expected]


def test_nul_goes_however_deep(spark):
    schema = "a string, s struct<t:string,n:int>, l array<struct<m:map<string,array<string>>>>, i int, b binary"
    row = ("x\x00y", ("\x00", 1), [({"k": ["p\x00", None]},), (None,), None], 5, b"\x00")
    out = T.without_nul(spark.createDataFrame([row, (None,) * 5], schema))
    assert out.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    first = next(r for r in out.collect() if r["a"]).asDict(recursive=True)
    assert first == {"a": "xy", "s": {"t": "", "n": 1}, "l": [{"m": {"k": ["p", None]}}, {"m": None}, None], "i": 5, "b": bytearray(b"\x00")}
