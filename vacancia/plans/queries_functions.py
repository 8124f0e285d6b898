"""Queries of scalar functions (F1-F28, R-functions) over the test tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from vacancia.functions import dates, money, text, urls
from vacancia.plans.registry import query

RATES = money.rate_map({"USD": Decimal("41.5"), "EUR": Decimal("45.25"), "CZK": Decimal("1.8")})

SQL_TEXT = "replace(lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"


def sql_text(c: str) -> str:
    return SQL_TEXT.format(c)


@query("f1_normalize_text", f"SELECT doc_id, md5({sql_text('text')}) AS normalized FROM documents")
def f1(t):
    return t.raw("documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normalized"))


SQL_LEGAL = "(\\s+(llc|incorporated|inc|ltd|limited|gmbh|plc|corp|corporation|s\\s*r\\s*o|a\\s*s|тов|тзов|пп|фоп))+$"
SQL_LEGAL_PREFIX = "^((llc|ltd|gmbh|corp|corporation|s\\s*r\\s*o|тов|тзов|пп|фоп)\\s+)+"
COMPANY = "CASE {k} % 4 WHEN 0 THEN concat({n}, ', LLC') WHEN 1 THEN concat('ТОВ  ', {n}, ' Corp.') WHEN 2 THEN concat({n}, ' s.r.o.') ELSE upper({n}) END"


@query(
    "f2_company_identity",
    f"SELECT c_custkey, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace({sql_text(COMPANY.format(k='c_custkey', n='c_name'))}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '{SQL_LEGAL_PREFIX}', '')), '{SQL_LEGAL}', '')) AS identity FROM customer",
)
def f2(t):
    return t.raw("customer").select("c_custkey", text.company_identity(F.expr(COMPANY.format(k="c_custkey", n="c_name"))).alias("identity"))


TITLE = "CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' (Remote, EU)') WHEN 1 THEN concat(p_name, ' [Senior]') WHEN 2 THEN concat(p_name, ' - Kyiv') WHEN 3 THEN concat(p_name, '/', p_type, ' (remote work)') WHEN 4 THEN concat(p_name, ' – full-time') ELSE concat('  ', p_name, ' . ', p_type) END"
SQL_TITLE = sql_text(TITLE)


@query(
    "f3_title_identity",
    f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(
  regexp_replace({SQL_TITLE}, '[\\[(]\\s*((remote|remote work|віддалено|віддалена робота|europe|eu|worldwide|anywhere|kyiv|kiev|prague|praha|full time|full-time)\\s*([,/|·]+\\s*)?)+[\\])]', ' ', 'g'), '\\s+', ' ', 'g')),
  '\\s+[-–—|·]\\s*(remote|remote work|віддалено|віддалена робота|europe|eu|worldwide|anywhere|kyiv|kiev|prague|praha|full[- ]time)\\s*$', ''), '[-–—_/.,:;]+', ' ', 'g'), '\\s+', ' ', 'g')) AS identity FROM part""",
)
def f3(t):
    return t.raw("part").select("p_partkey", text.title_identity(F.expr(TITLE)).alias("identity"))


@query(
    "f4_canonical_url",
    """SELECT page_id, concat(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)), '://', lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)),
  CASE WHEN rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') END,
  CASE WHEN len(q) = 0 THEN '' ELSE concat('?', array_to_string(q, '&')) END) AS canonical
FROM (SELECT *, list_sort(list_filter(str_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) IN ('fbclid', 'gclid', 'ref', 'source') OR starts_with(lower(split_part(x, '=', 1)), 'utm_')))) AS q FROM pages) AS p""",
)
def f4(t):
    return t.raw("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(
    "f5_canonical_key",
    f"""SELECT id, sha256(concat_ws('|', trim(regexp_replace({sql_text('company')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), trim(regexp_replace({sql_text('title')}, '[-–—_/.,:;]+', ' ', 'g')), {sql_text('location_text')}, work_mode)) AS canonical_key FROM opportunities""",
)
def f5(t):
    key = text.canonical_key(F.col("company"), F.col("title"), F.col("location_text"), F.col("work_mode"))
    return t.opportunities.select("id", key.alias("canonical_key"))


@query("f6_content_hash", "SELECT count(*) AS rows_, count(DISTINCT (title, company, salary_min, source_updated_at)) AS hashes FROM opportunities")
def f6(t):
    h = text.content_hash(F.col("title"), F.col("company"), F.col("salary_min"), F.col("source_updated_at"))
    return t.opportunities.select(h.alias("h")).agg(F.count("*").alias("rows_"), F.countDistinct("h").alias("hashes"))


@query(
    "f7_quality_score",
    f"""SELECT id, CAST(least(length({sql_text('description')}), 20000) + CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN 2000 ELSE 0 END + 100 * ((company IS NOT NULL)::INT + (location_text IS NOT NULL)::INT
  + (employment_type IS NOT NULL)::INT + (coalesce(published_at, source_updated_at) IS NOT NULL)::INT) AS INT) AS score FROM opportunities""",
)
def f7(t):
    score = text.quality_score(F.col("description"), F.col("salary_min"), F.col("salary_max"), F.col("company"), F.col("location_text"), F.col("employment_type"), F.coalesce("published_at", "source_updated_at"))
    return t.opportunities.select("id", score.alias("score"))


@query("f8_discovery_fingerprint", "SELECT p_partkey, sha256(concat_ws('|', p_brand, p_name, p_type)) AS fingerprint FROM part")
def f8(t):
    return t.raw("part").select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_name", "p_type"), 256).alias("fingerprint"))


HEADLINE = "CASE WHEN c_custkey % 3 = 0 THEN concat('Engineer в відділ в ', c_name, ', $', CAST(c_custkey AS STRING)) WHEN c_custkey % 3 = 1 THEN concat('Tester в ', c_name) ELSE c_name END"


@query(
    "f12_headline",
    f"""SELECT c_custkey, CASE WHEN m THEN trim(regexp_extract(h, '^(.+)\\s+в\\s+([^,]+)(?:,\\s*(.+))?$', 1)) ELSE h END AS title, CASE WHEN m THEN trim(regexp_extract(h, '^(.+)\\s+в\\s+([^,]+)(?:,\\s*(.+))?$', 2)) END AS company,
  nullif(trim(regexp_extract(h, '^(.+)\\s+в\\s+([^,]+)(?:,\\s*(.+))?$', 3)), '') AS details FROM (SELECT c_custkey, {HEADLINE} AS h, regexp_matches({HEADLINE}, '^(.+)\\s+в\\s+([^,]+)(?:,\\s*(.+))?$') AS m FROM customer) AS x""",
)
def f12(t):
    return t.raw("customer").select("c_custkey", text.headline(F.expr(HEADLINE)).alias("h")).select("c_custkey", "h.*")


DETAILS = "CASE c_custkey % 5 WHEN 0 THEN concat('Київ, від $', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('до ', CAST(c_custkey AS STRING), ' грн') WHEN 2 THEN concat('$', CAST(c_custkey AS STRING), '–', CAST(c_custkey + 500 AS STRING)) WHEN 3 THEN 'remote, 5 years' ELSE concat('remote, ', CAST(c_custkey AS STRING), ' EUR') END"


@query(
    "f13_salary_of_details",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 2 THEN c_custkey WHEN 4 THEN c_custkey END::DECIMAL(14,2) AS minimum, CASE c_custkey % 5 WHEN 1 THEN c_custkey WHEN 2 THEN c_custkey + 500 END::DECIMAL(14,2) AS maximum,
  CASE c_custkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'UAH' WHEN 2 THEN 'USD' WHEN 4 THEN 'EUR' END AS currency FROM customer""",
)
def f13(t):
    return t.raw("customer").select("c_custkey", money.salary_of_details(F.expr(DETAILS)).alias("s")).select("c_custkey", "s.minimum", "s.maximum", "s.currency")


SALARY = "CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size AS STRING), ' 500 – ', CAST(p_size + 10 AS STRING), ' 000 грн') WHEN 1 THEN concat('$', CAST(p_size AS STRING)) WHEN 2 THEN concat(CAST(p_size AS STRING), ',50 Kč') ELSE 'negotiable' END"


@query(
    "f14_salary_of_text",
    """SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 END)::DECIMAL(14,2) AS minimum, (CASE p_partkey % 4 WHEN 0 THEN (p_size + 10) * 1000 WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 END)::DECIMAL(14,2) AS maximum,
  CASE p_partkey % 4 WHEN 0 THEN 'UAH' WHEN 1 THEN 'USD' WHEN 2 THEN 'CZK' END AS currency FROM part""",
)
def f14(t):
    return t.raw("part").select("p_partkey", money.salary_of_text(F.expr(SALARY)).alias("s")).select("p_partkey", "s.minimum", "s.maximum", "s.currency")


@query(
    "f15_salary_text",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '100 USD' WHEN p_size > 25 THEN concat(p_size, ' - ', p_size + 5, ' грн') WHEN p_size % 2 = 0 THEN concat(p_size, ' грн') ELSE concat(floor(p_retailprice)::BIGINT, ' грн') END AS salary FROM part""",
)
def f15(t):
    low = F.when(F.col("p_size") > 25, F.col("p_size")).when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0)
    high = F.when(F.col("p_size") > 25, F.col("p_size") + 5).otherwise(0)
    comment = F.when(F.col("p_partkey") % 5 == 0, F.lit(" 100 USD ")).otherwise(F.lit("good pay"))
    return t.raw("part").select("p_partkey", money.salary_text(low, high, F.col("p_retailprice"), comment).alias("salary"))


@query("f20_path_id", "SELECT page_id, CASE WHEN regexp_extract(url, '/(\\d+)(?:[/?#]|$)', 1) <> '' THEN regexp_extract(url, '/(\\d+)(?:[/?#]|$)', 1) ELSE sha256(url) END AS external_id FROM pages")
def f20(t):
    return t.raw("pages").select("page_id", urls.path_id(F.col("url")).alias("external_id"))


@query("f21_feed_date", "SELECT o_orderkey, o_orderdate - INTERVAL '3' HOUR AS published FROM orders")
def f21(t):
    written = F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss")
    return t.raw("orders").select("o_orderkey", dates.rfc822(F.concat(written, F.lit(" +0300"))).cast("timestamp_ntz").alias("published"))


@query("f22_page_date", "SELECT o_orderkey, date_trunc('day', o_orderdate) AS by_name, date_trunc('day', o_orderdate) AS in_english FROM orders")
def f22(t):
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month("o_orderdate"))
    named = F.concat_ws(" ", F.lit("Опубліковано"), F.dayofmonth("o_orderdate").cast("string"), month, F.year("o_orderdate").cast("string"))
    english = dates.english_day(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return t.raw("orders").select("o_orderkey", dates.month_name(named).cast("timestamp_ntz").alias("by_name"), english.cast("timestamp_ntz").alias("in_english"))


@query("f24_markdown_text", "SELECT c_custkey, concat(c_name, ' is ', c_mktsegment) AS plain FROM customer")
def f24(t):
    marked = F.concat(F.lit("## **["), F.col("c_name"), F.lit("](https://x.example/)**\n is  *"), F.col("c_mktsegment"), F.lit("*"))
    return t.raw("customer").select("c_custkey", text.markdown_text(marked).alias("plain"))


@query("f25_convert", "SELECT id, round(CAST(CASE upper(salary_currency) WHEN 'USD' THEN 41.5 WHEN 'UAH' THEN 1 WHEN 'EUR' THEN 45.25 END AS DECIMAL(10,4)) * salary_max, 2)::DOUBLE AS uah FROM opportunities")
def f25(t):
    return t.opportunities.select("id", money.convert(F.col("salary_max"), F.col("salary_currency"), "UAH", RATES).cast("double").alias("uah"))


@query(
    "f26_conversion_fingerprint",
    "SELECT id, CASE upper(salary_currency) WHEN 'UAH' THEN sha256(concat('USD=41.5', chr(10), 'UAH=1')) WHEN 'EUR' THEN sha256(concat('USD=41.5', chr(10), 'EUR=45.25')) END AS fingerprint FROM opportunities",
)
def f26(t):
    return t.opportunities.select("id", money.conversion_fingerprint(F.col("salary_currency"), RATES).alias("fingerprint"))


def _sql_amount(c: str) -> str:
    return f"format('{{:,}}', round({c})::BIGINT)"


@query(
    "f27_range_text",
    f"""SELECT id, CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN NULL ELSE concat(coalesce(upper(salary_currency), 'Original currency'), ': ', CASE WHEN {_sql_amount('coalesce(salary_min, salary_max)')} = {_sql_amount('coalesce(salary_max, salary_min)')}
  THEN {_sql_amount('coalesce(salary_min, salary_max)')} ELSE concat({_sql_amount('coalesce(salary_min, salary_max)')}, '-', {_sql_amount('coalesce(salary_max, salary_min)')}) END,
  CASE WHEN salary_period IS NULL THEN '' ELSE concat(' / ', CASE lower(salary_period) WHEN 'hour' THEN 'час' WHEN 'month' THEN 'месяц' WHEN 'year' THEN 'год' END) END) END AS line FROM opportunities""",
)
def f27(t):
    return t.opportunities.select("id", money.original_line(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period")).alias("line"))


@query(
    "f28_monthly_salary",
    """SELECT id, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN salary_max * f * r > 2000.0 * 41.5 * d END AS high FROM (SELECT *, CASE lower(salary_period) WHEN 'month' THEN 1 WHEN 'year' THEN 1 WHEN 'hour' THEN 160 END AS f, CASE lower(salary_period) WHEN 'year' THEN 12 ELSE 1 END AS d,
  CASE upper(salary_currency) WHEN 'USD' THEN 41.5 WHEN 'UAH' THEN 1 WHEN 'EUR' THEN 45.25 END AS r FROM opportunities) AS x""",
)
def f28(t):
    x, y = money.monthly_usd_scaled(F.col("salary_max"), F.col("salary_currency"), F.col("salary_period"), RATES)
    return t.opportunities.select("id", (x > y * 2000).alias("high"))


@query("f35_redact", "SELECT c_custkey, concat('https://u:[REDACTED]@h.example/?token=[REDACTED]&x=', c_custkey, ' Bearer [REDACTED] ') AS redacted FROM customer")
def f35(t):
    secret = F.concat(F.lit("https://u:pw"), F.col("c_custkey"), F.lit("@h.example/?token=abc"), F.col("c_custkey"), F.lit("&x="), F.col("c_custkey"), F.lit(" Bearer a.b-c"), F.lit(" "))
    return t.raw("customer").select("c_custkey", text.redact(secret).alias("redacted"))


@query("f37_event_key", "SELECT p_partkey, concat('match:v2:', substr(sha256(p_name), 1, 16)) AS event_key FROM part")
def f37(t):
    return t.raw("part").select("p_partkey", text.event_key(F.lit("v2"), F.sha2("p_name", 256)).alias("event_key"))


@query("f38_retry_delay", "SELECT id, CAST(least(3600, 60 * pow(2, least(6, greatest(0, attempts - 1)))) AS INT) AS seconds FROM deliveries")
def f38(t):
    return t.deliveries.select("id", text.retry_delay(F.col("attempts")).alias("seconds"))


@query("r2_replace_parameter", "SELECT page_id, concat(regexp_extract(url, '^[^?#]*'), '?', array_to_string(list_append(list_filter(str_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) <> 'utm_source'), 'utm_source=x'), '&')) AS url FROM pages")
def r2(t):
    return t.raw("pages").select("page_id", urls.with_parameter(F.col("url"), "utm_source", "x").alias("url"))


@query("p2_trusted_link", "SELECT id, regexp_matches(source_url, '^(?i:https)://site[02]\\.example(:443)?/') AS trusted FROM listings")
def p2(t):
    return t.listings.select("id", urls.trusted(F.col("source_url"), ("site0.example", "site2.example")).alias("trusted"))


@query("r17_pack_lines")
def r17(t):
    lines = F.split("text", "\n")
    return t.raw("documents").select("doc_id", F.size(text.pack_lines(lines)).alias("chunks"))
