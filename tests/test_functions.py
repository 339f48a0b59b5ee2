from fractions import Fraction
from math import comb

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intervale.functions import scalars as S
from intervale.functions.fisher import fisher


def exact(a, b, c, d):
    r, k, n = a + b, a + c, a + b + c + d
    p = {i: Fraction(comb(r, i) * comb(n - r, k - i), comb(n, k)) for i in range(max(0, r + k - n), min(r, k) + 1)}
    left, right = sum(v for i, v in p.items() if i <= a), sum(v for i, v in p.items() if i >= a)
    return float(left), float(right), float(min(1, sum(v for v in p.values() if v <= p[a])))


@settings(max_examples=300, deadline=None)
@given(*[st.integers(0, 40)] * 4)
def test_fisher_against_rationals(a, b, c, d):
    if max(0, a - d) == min(a + b, a + c):
        assert fisher(a, b, c, d) == (1, 1, 1)
    else:
        assert fisher(a, b, c, d) == pytest.approx(exact(a, b, c, d), abs=1e-9)


def test_fisher_golden():
    assert fisher(3, 1, 1, 3)[2] == pytest.approx(0.485714, abs=1e-6)
    assert fisher(7, 2, 9, 400)[1] == pytest.approx(9.41972e-10, rel=1e-5)
    left, right, two = fisher(300, 0, 0, 10000)  # below the floor
    assert left == 1 and two == pytest.approx(1.54e-202, rel=1e-2) and right == two


@pytest.mark.parametrize(
    "basic, java",
    [("a+b", r"a\+b"), (r"a\+b", "a+b"), ("*a", r"\*a"), (r"\(a\|b\)*", "(a|b)*"), (r"a\{2\}", "a{2}"), ("[]a]", r"[\]a]"), ("a|b(c)", r"a\|b\(c\)"), ("[[:digit:]]", r"[\p{Digit}]")],
)
def test_basic_patterns(basic, java):
    assert S.java_pattern(basic) == java


def test_regions():
    assert S.parse_regions("chr1:5-9,X:1-2") == [S.Region("1", 5, 9), S.Region("X", 1, 2)]
    for bad in ("1-5", "1:5", "1:a-b", "1:5-"):
        with pytest.raises(ValueError):
            S.parse_region(bad)


def test_numbers_from_text(spark):
    d = spark.createDataFrame([("12x",), (" 7",), ("x",), ("",), ("99999999999999999999",), (None,)], "t string")
    got = [tuple(r) for r in d.select(S.integer(F.col("t")), S.lenient_integer(F.col("t"), "int"), S.lenient_float(F.col("t"))).collect()]
    assert got == [(12, 12, 12.0), (7, 7, 7.0), (None, 0, 0.0), (None, 0, 0.0), (None, None, 1e20), (None, None, None)]


def test_small_functions(spark):
    row = spark.range(1).select(
        S.safe_subtract(F.lit(2), F.lit(5)), S.log2fc(F.lit(0.00001)), S.log2fc(F.lit(0.25)), S.neg_log10(F.lit(0.0)), S.plot_log2fc(F.lit(0.0)),
        S.plot_neg_log10(F.lit(0.0)), S.first_token(F.lit("  abcdef g"), 4), S.normalize_chrom(F.lit("chrchr1")), S.binary_to_integer(F.lit("101")), S.base_name(F.lit("a/b/c.bed")),
    ).first()
    assert tuple(row) == (0, 0.0, -2.0, float("inf"), 0.0, 6.0, "abcd", "chr1", 5, "c.bed")


def test_registered_scores_follow_their_sql(spark, monkeypatch):
    """Odds below 1e-4 have a logarithm, the first are told by the exact score, and ties of significance go by name."""
    from intervale import queries

    t = spark.createDataFrame([("b", 100201, 34576, 34576, 115424, 65625, 42000), ("a", 100201, 34576, 34576, 115424, 65625, 42000)], "fname string, num_intervals bigint, overlaps bigint, n11 bigint, n12 bigint, n21 bigint, n22 bigint")
    small = t.withColumns({"n11": F.lit(1), "n12": F.lit(500_000), "n21": F.lit(500_000), "n22": F.lit(1_000_000)})
    monkeypatch.setattr(queries, "_table", lambda spark, d: small)
    got = queries.enrichment(spark, "").collect()
    assert all(r.odds_ratio < 1e-4 and r.combo_score < -1000 for r in got)
    assert {r.fname: r.place for r in queries.order_by_significance(spark, "").collect()} == {"a": 0, "b": 1}
    near = spark.createDataFrame([(f"f{i}", 503, 3, 3, 500, 500, 1_000_000 + i) for i in range(8)], t.schema)  # scores some 4e-6 apart
    monkeypatch.setattr(queries, "_table", lambda spark, d: near)
    assert "exact_score" not in queries.topk_combo(spark, "").columns
    assert [r.fname for r in queries.topk_combo(spark, "").collect()] == ["f7", "f6", "f5"]
