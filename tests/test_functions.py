import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.functions import arguments, cases, dates, text, wages


def apply(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_unescape_is_anchored_at_both_ends(spark):
    got = apply(spark, text.unescape, ['="Analyst ("FP&A")"', 'Analyst "Senior"', '="a\nb"', '="open', None])
    assert got == ['Analyst ("FP&A")', 'Analyst "Senior"', "a\nb", '="open', None]


def test_title_case_equals_python_title(spark):
    cities = [
        "o'fallon", "winston-salem", "ST. LOUIS", "1st city", "new\tyork", "évry-sur-seine", "nation_7",
        "", "a  b", "mcDONALD's", "ǆabc", "saint-jean (east)", "x2y", "東京tower", "straße",
    ]
    assert apply(spark, text.title_case, cities) == [c.title() for c in cities]


def random_texts(n=3000, seed=11):
    """Texts over letters with and without case, digits, marks and every kind of space.

    Left out is the capital sigma: before an apostrophe its two lower forms may differ.
    """
    rng = random.Random(seed)
    alphabet = "aAbZéÉßñøΩλжЯאب東あ09_'-. \t\n\x0b\x1c\x1f\x85\xa0\u2003\u3000\u0301\u00aa\u2160²½()&,ﬁǆǅ𝒜"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("ours, python", [(text.title_case, str.title), (text.strip, str.strip)])
def test_text_rules_equal_python_on_random_texts(spark, ours, python):
    raw = random_texts()
    wrong = [(r, g, python(r)) for r, g in zip(raw, apply(spark, ours, raw)) if g != python(r)]
    assert not wrong, wrong[:5]


def test_strip_takes_every_kind_of_whitespace(spark):
    raw = [" a ", "\t a\n", "\xa0a b ", "\x1ca\x1f", "", " 　 "]
    assert apply(spark, text.strip, raw) == [r.strip() for r in raw]


def test_employer_variants_collapse(spark):
    names = ["MICROSOFT CORPORATION", "Microsoft Corp.", "microsoft, inc", " Microsoft  LLC "]
    assert set(apply(spark, text.normalize_employer, names)) == {"MICROSOFT"}


def test_employer_rule_stays_conservative(spark):
    names = ["Cognizant Technology Solutions", "SparkCognizant Inc", "TMG HEALTH - A COGNIZANT COMPANY"]
    assert apply(spark, text.normalize_employer, names) == [
        "COGNIZANT TECHNOLOGY SOLUTIONS", "SPARKCOGNIZANT", "TMG HEALTH A COGNIZANT COMPANY",
    ]


def test_employer_keeps_letters_of_every_script_and_only_drops_one_suffix(spark):
    names = ["Café Inc", "Acme Co LLC", "INC", "Über_1 LP", "Zinc", None, "ÁB"]
    assert apply(spark, text.normalize_employer, names) == ["CAFÉ", "ACME CO", "INC", "ÜBER_1", "ZINC", None, "AB"]


def test_soc_and_tech(spark):
    codes = ['="15-1252.00"', "11-3021.00", "11-3031.00", "29-1216", " 15-2051 ", None]
    assert apply(spark, text.normalize_soc, codes) == ["15-1252", "11-3021", "11-3031", "29-1216", "15-2051", None]
    tech = apply(spark, lambda c: text.is_tech(text.normalize_soc(c)), codes)
    assert tech == [True, True, False, False, True, False]


@pytest.mark.parametrize("value, expected", [
    ("100000", 100000.0), (" 12.5 ", 12.5), ("1e5", 100000.0), (".5", 0.5), ("+3.", 3.0), ("-4", -4.0),
    ("$120,000", None), ("1d", None), ("nan", None), ("inf", None), ("", None), (None, None),
])
def test_wage_text(spark, value, expected):
    dtype = T.StringType()
    assert apply(spark, lambda c: wages.to_wage(c, dtype), [value]) == [expected]
    lost = expected is None and value is not None
    assert apply(spark, lambda c: wages.unreadable(c, dtype), [value]) == [lost]


def test_units(spark):
    units = ["Year", "Hour", "Month", "Week", "Bi-Weekly", "Fortnight", None]
    assert apply(spark, wages.unit_multiplier, units) == [1.0, 2080.0, 12.0, 52.0, 26.0, None, None]


def test_half_even_dollars(spark):
    assert apply(spark, wages.whole_dollars, [120000.5, 120001.5, 2.5, None], "double") == [120000, 120002, 2, None]


def test_outlier_flag_is_never_null(spark):
    values = [9999.99, 10000.0, 2000000.0, 2000000.01, 0.0, None]
    assert apply(spark, wages.outside_band, values, "double") == [True, False, False, True, True, True]


def test_fiscal_year_of(spark):
    days = [dt.date(2024, 9, 30), dt.date(2024, 10, 1), None]
    assert apply(spark, dates.fiscal_year_of, days, "date") == [2024, 2025, None]


def test_lenient_date(spark):
    values = ["2025-01-15", "1/5/2025", "2025-01-15 10:00:00", "soon", "", None]
    got = apply(spark, lambda c: dates.lenient_date(c, T.StringType()), values)
    assert got == [dt.date(2025, 1, 15), dt.date(2025, 1, 5), dt.date(2025, 1, 15), None, None, None]


def test_case_number_splits_and_comes_together(spark):
    numbers = ["I-200-25001-000001", "I-203-26085-730937", "I-001-00001-000000"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    n = F.col("n")
    rows = df.select(
        "n", cases.case_prefix(n).alias("p"), cases.case_serial(n).alias("s"), cases.case_order(n).alias("o")
    )
    back = rows.select("n", "p", "s", cases.case_number(F.col("p"), F.col("s")).alias("back")).collect()
    assert all(r.n == r.back for r in back)
    assert (back[1].p, back[1].s) == (203, 26085730937)
    by_order = [r.n for r in rows.orderBy("o").collect()]
    assert by_order == sorted(numbers)


def test_malformed_case_numbers(spark):
    bad = ["I-20-25001-000001", "X-200-25001-000001", "I-200-25001-0000011", "", None]
    assert apply(spark, cases.case_serial, bad) == [None] * 5
    assert apply(spark, cases.well_formed, bad) == [False] * 5


@pytest.mark.parametrize("value", [True, "5", 1.0, None, np.bool_(True)])
def test_whole_number_refuses_other_types(value):
    with pytest.raises(TypeError):
        arguments.whole_number("limit", value)


@pytest.mark.parametrize("value", [-1, 2**63])
def test_whole_number_refuses_out_of_range(value):
    with pytest.raises(ValueError):
        arguments.whole_number("limit", value)


def test_arguments_accept_numpy_scalars():
    assert arguments.whole_number("year", np.int64(2025)) == 2025
    assert arguments.switch("flag", np.bool_(False)) is False
    assert arguments.optional_text("city", None) is None


@pytest.mark.parametrize("value", ["no", 1, 0, None])
def test_switch_refuses_merely_truthy_values(value):
    with pytest.raises(TypeError):
        arguments.switch("include_outliers", value)


def test_text_argument_refuses_numbers():
    with pytest.raises(TypeError):
        arguments.optional_text("job_title", 5)
