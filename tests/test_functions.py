"""Scalar functions: parity with the pandas/Python semantics they replace."""

import math

import pandas as pd
from pyspark.sql import functions as F

from driftwatch.functions import (
    clean_text, clean_zip, first_token, is_blank, na_to_null, normalize_header,
    normalize_header_col, to_double, ustrip,
)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_ustrip_matches_python_strip(spark):
    for s in ["  a b  ", "\ta\n", " x　", "  y  ", "", "   "]:
        assert one(spark, ustrip, s) == s.strip()


def test_to_double_matches_pandas_to_numeric(spark):
    cases = ["5", " 5.5 ", "-2", "1e3", ".5", "5.", "$5", "1,299.00", "5d", "abc", "", "NaN", None]
    for s in cases:
        got = one(spark, to_double, s)
        exp = pd.to_numeric(pd.Series([s]), errors="coerce").iloc[0] if s is not None else float("nan")
        if s is not None and s.strip() == "NaN":
            exp = float("nan")      # NaN is treated as missing
        if exp is None or (isinstance(exp, float) and math.isnan(exp)):
            assert got is None, s
        else:
            assert got == float(exp), s


def test_clean_zip_pads_never_truncates(spark):
    assert one(spark, clean_zip, "123.0") == "00123"
    assert one(spark, clean_zip, " 2108 ") == "02108"
    assert one(spark, clean_zip, "12345-6789") == "12345-6789"
    assert one(spark, clean_zip, "   ") is None     # S4: blank is not padded to 00000
    assert one(spark, clean_zip, None) is None
    assert one(spark, lambda c: clean_zip(c, pad5=False), "123") == "123"


def test_blank_and_clean_text(spark):
    assert one(spark, is_blank, " \t") is True
    assert one(spark, is_blank, None) is True
    assert one(spark, is_blank, "x") is False
    assert one(spark, clean_text, "  S1 ") == "S1"
    assert one(spark, clean_text, "  ") is None


def test_na_tokens(spark):
    for tok in ["NA", "n/a", "#N/A", "null", "NaN", "", "<NA>"]:
        assert one(spark, na_to_null, tok) is None
    assert one(spark, na_to_null, "NaNa") == "NaNa"


def test_first_token(spark):
    assert one(spark, first_token, "2024-01-02 10:11:12") == "2024-01-02"
    assert one(spark, first_token, "  2024-01-02\t10:11") == "2024-01-02"


def test_normalize_header(spark):
    for h in ["Store ID", "store_id", "SubType / Size", "Zip-Code", "DateExtracted"]:
        assert one(spark, normalize_header_col, h) == normalize_header(h)
    assert normalize_header("SubType / Size") == "subtypesize"
