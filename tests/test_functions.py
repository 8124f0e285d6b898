from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vacancia.functions import dates, money, text, urls

RATES = money.rate_map({"USD": "40", "EUR": "44", "CZK": "2"})


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("title", "want"),
    [("Python Developer (Remote, EU)", "python developer"), ("Python Developer (Django)", "python developer (django)"), ("Dev - Kyiv", "dev"), ("A/B — tester.", "a b tester"), (None, ""), ("  Straße Dev ", "strasse dev"), ("X [Remote | Senior]", "x [remote | senior]")],
)
def test_title_identity(spark, title, want):
    assert value(spark, text.title_identity(F.lit(title).cast("string"))) == want


@pytest.mark.parametrize(("company", "want"), [("ТОВ Ромашка LLC", "ромашка"), ("Acme, Inc.", "acme"), ("Foo s.r.o.", "foo"), ("LLC", "llc"), ("Дев_Тест", "дев тест")])
def test_company_identity(spark, company, want):
    assert value(spark, text.company_identity(F.lit(company))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.com:443/a/b/?utm_source=x&b=2&a=1&ref=q#top", "https://example.com/a/b?a=1&b=2"), ("http://h.example:8080", "http://h.example:8080/"), ("/relative", None), ("https://h.example/?a", "https://h.example/?a="),
        ("https://user:pw@h.example/x//", "https://h.example/x"),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, urls.canonical_url(F.lit(url))) == want


@pytest.mark.parametrize(("url", "want"), [("https://a.example/x", True), ("https://a.example:443/x", True), ("http://a.example/x", False), ("https://u@a.example/", False), ("https://a.example:8443/", False), ("https://b.example/", False), ("https://a.example/ x", False), (None, False)])
def test_trusted(spark, url, want):
    assert value(spark, urls.trusted(F.lit(url).cast("string"), ("a.example",))) is want


@pytest.mark.parametrize(
    ("details", "want"),
    [("Київ, $1000–1500", (1000, 1500, "USD")), ("до 40 000 грн", (None, 40000, "UAH")), ("від €2000", (2000, None, "EUR")), ("remote", None), ("5 years, up to 900 usd", (None, 900, "USD"))],
)
def test_salary_of_details(spark, details, want):
    got = value(spark, money.salary_of_details(F.lit(details)))
    assert (got and tuple(x if x is None or isinstance(x, str) else int(x) for x in got)) == want


def test_converted_lines(spark):
    lines = value(spark, money.converted_lines(F.lit(Decimal("1000")), F.lit(Decimal("1250.5")), F.lit("usd"), F.lit("month"), RATES))
    assert lines == ["USD: 1,000-1,251 / месяц", "UAH: 40,000-50,020 / месяц", "CZK: 20,000-25,010 / месяц"]


def test_rates_are_checked():
    for bad in ({"USD": "NaN", "CZK": "1"}, {"USD": "1"}, {"USD": "-1", "CZK": "2"}):
        with pytest.raises(ValueError):
            money.rate_map(bad)


def test_retry_delays(spark):
    got = [r["d"] for r in spark.range(1, 9).select(text.retry_delay(F.col("id").cast("int")).alias("d")).collect()]
    assert got == [60, 120, 240, 480, 960, 1920, 3600, 3600]


def test_redaction(spark):
    got = value(spark, text.redact(F.lit("https://u:secret@h/?api_key=abc&x=1 Authorization: Bearer a.b.c 1234567890:ABCDEFGHIJKLMNOPQRSTUVWX")))
    assert "secret" not in got and "abc" not in got and "a.b.c" not in got and "ABCDEF" not in got


def test_dates(spark):
    assert str(value(spark, dates.rfc822(F.lit("Mon, 05 Jan 2026 10:00:00 +0200")))) == "2026-01-05 08:00:00"
    assert str(value(spark, dates.month_name(F.lit("Опубліковано 5 квітня 2026")))) == "2026-04-05 00:00:00"
    assert value(spark, dates.month_name(F.lit("nothing"))) is None and value(spark, dates.rfc822(F.lit("soon"))) is None


def test_pack_lines(spark):
    got = value(spark, text.pack_lines(F.array(*map(F.lit, ["aaaa", "bbb", "cccccccccccc", "d"])), 8))
    assert got == ["aaaa\nbbb", "cccccccccccc", "d"]


def test_quality_score(spark):
    got = value(spark, text.quality_score(F.lit(" a  b "), F.lit(None).cast("int"), F.lit(1), F.lit("x"), F.lit(None).cast("string")))
    assert got == 3 + 2000 + 100


def test_one_decimal_rounds_the_binary_value(spark):
    from vacancia.functions import text

    values = [m * 100.0 / n for n in (*range(1, 60), 400, 800, 2000) for m in range(0, n + 1)] + [0.25, 0.75, 0.05, 0.95, 99.95, 85.15, 1e6 + 0.25]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.one_decimal(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in found} == {v: f"{v:.1f}" for v in values}


def test_half_prices_are_cast_as_sql_does(spark, tmp_path):
    import duckdb

    from vacancia.plans import ORACLES, QUERIES

    prices = [0.29, 0.57, 1.13, 0.03, 0.09, 1000.99, 998.99, 2469.99, 335544.35, 499993.19]
    c = duckdb.connect()
    c.sql(f"create table orders as select 10 * i + 1 as o_orderkey, 1 as o_custkey, p as o_totalprice, '1-URGENT' as o_orderpriority, DATE '2024-01-01' as o_orderdate from (select unnest(range({len(prices)})) as i, unnest({prices}::double[]) as p)")
    c.sql("create table customer as select 1 as c_custkey, 'x' as c_name, 'y' as c_mktsegment")
    for t in ("supplier", "lineitem", "labels", "events"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for t in ("orders", "customer"):
        c.sql(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    prices_of = lambda rows: sorted(tuple(r) for r in rows)
    for name in ("f27_range_text", "f6_content_hash"):
        assert prices_of(QUERIES[name](spark, str(tmp_path)).collect()) == prices_of(c.sql(ORACLES[name]).fetchall())
