"""Queries of normalised listings, their fields, URLs and reports over the test tables.

Where a rule reads prose that the test tables do not hold, stated cases are dealt over all rows of a table by key,
and the SQL deals what each case must give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions import money, urls, work
from vacancia.operators import runs, upkeep
from vacancia.operators.lineage import spread
from vacancia.plans.registry import query
from vacancia.sources import postings


def dealt(key: str, cases: Sequence[str | None]) -> Column:
    return F.get(F.array(*(F.lit(c).cast("string") for c in cases)), (F.col(key) % len(cases)).cast("int"))


def sql_dealt(key: str, cases: Sequence[str | None]) -> str:
    shown = ", ".join("NULL" if c is None else "'" + c.replace("'", "''") + "'" for c in cases)
    return f"[{shown}][CAST({key} % {len(cases)} AS INT) + 1]"


# (headline, description, what both say)
MODES = (
    ("Dev в Acme, віддалено", "We build services.", "remote"),
    ("Dev в Acme, remote", "Remote work is not available.", None),
    ("Dev в Acme, Kyiv, remote", "You must work in the office.", "onsite"),
    ("Dev в Acme, remote", "You do not have to attend the office. No required office visits.", "remote"),
    ("Dev в Acme, remote", "Office work is not required.", "remote"),
    ("Dev в Acme, remote", "Hybrid format.", None),
    ("Dev в Acme, remote", "Remote or hybrid format.", "remote"),
    ("Dev в Acme, Kyiv", "Two days per week in the office.", "hybrid"),
    ("Dev в Acme, Kyiv", "We build services.", "onsite"),
    ("Dev в Acme, Lviv", "We build services.", None),
    ("Dev в Acme, віддалено", "Без required office.", "remote"),
)


@query("p16_work_mode_of_text", f"SELECT p_partkey, {sql_dealt('p_partkey', [m for _, _, m in MODES])} AS work_mode FROM part")
def p16(t):
    head, text = dealt("p_partkey", [h for h, _, _ in MODES]), dealt("p_partkey", [d for _, d, _ in MODES])
    return t.raw("part").select("p_partkey", work.work_mode_of_text(head, text, ("Kyiv", "Київ")).alias("work_mode"))


EMPLOYMENT = (("Повна зайнятість та відпустка", "full_time", None), ("Full-time or part-time", "full_time", "full_time,part_time"), ("Part time only", "part_time", None), ("Wonderful times", None, None), (None, None, None))


@query("f17_employment_type", f"SELECT p_partkey, {sql_dealt('p_partkey', [a for _, a, _ in EMPLOYMENT])} AS by_words, {sql_dealt('p_partkey', [b for _, _, b in EMPLOYMENT])} AS by_marks FROM part")
def f17(t):
    text = dealt("p_partkey", [c for c, _, _ in EMPLOYMENT])
    return t.raw("part").select("p_partkey", work.employment_of_text(text).alias("by_words"), work.employment_of_marks(text).alias("by_marks"))


LABELS = ("Remote", "Віддалена робота", "Remote office", "дистанційн", None)


@query("r10_remote_label", "SELECT p_partkey, p_partkey % 5 < 2 AS labelled, p_partkey % 5 < 4 AS marked FROM part")
def r10(t):
    c = dealt("p_partkey", LABELS)
    return t.raw("part").select("p_partkey", work.remote_label(c).alias("labelled"), work.remote_marked(c).alias("marked"))


def _json_postings(t):
    """Each order as a structured posting, of forms that vary by key."""
    form = (F.col("id") % 4).cast("int")
    salary = F.when(form == 0, '{"currency":"usd","value":{"minValue":10.5,"maxValue":"20","unitText":"MONTH"}}').when(form == 1, '{"currency":"EUR","value":30,"unitText":"Year"}').when(form == 2, '{"currency":" ","value":{"value":"x"}}').otherwise('"none"')
    place = F.when(form == 0, '[{"address":{"addressCountry":["UA","CZ"],"addressLocality":{"name":"Kyiv"}}},{"@type":"Country","name":"UA"}]').when(form == 1, '{"address":{"addressCountry":" ","addressRegion":"Praha"}}').otherwise("null")
    mode = F.when(form == 2, '"TELECOMMUTE"').when(form == 3, '["telecommute"]').otherwise("null")
    kind = F.when(form == 0, '["FULL_TIME","CONTRACTOR"]').when(form == 1, '"PART_TIME"').otherwise("null")
    name = F.when(form == 0, F.concat(F.lit('{"value":"v'), F.col("id").cast("string"), F.lit('"}'))).when(form == 1, F.concat(F.lit('{"name":"n'), F.col("id").cast("string"), F.lit('"}'))).otherwise(F.col("id").cast("string"))
    wanted = F.when(form == 3, '{"@type":"Country","name":["DE","AT","DE"]}').otherwise("null")
    text = F.concat(F.lit('{"title":" '), "title", F.lit('","hiringOrganization":{"name":"'), F.coalesce("company", F.lit("")), F.lit('"},"description":"d","identifier":'), name, F.lit(',"employmentType":'), kind,
        F.lit(',"jobLocationType":'), mode, F.lit(',"jobLocation":'), place, F.lit(',"applicantLocationRequirements":'), wanted, F.lit(',"estimatedSalary":'), salary, F.lit("}"))
    return t.opportunities.select("id", "title", "company", F.parse_json(text).alias("posting"))


@query("r5_normalize_postings", """SELECT id, CASE id % 4 WHEN 0 THEN concat('v', id) WHEN 1 THEN concat('n', id) ELSE CAST(id AS VARCHAR) END AS external_id, title, company, ['UA, CZ, Kyiv', 'Praha', 'Remote', 'DE, AT'][CAST(id % 4 AS INT) + 1] AS location_text,
['onsite', 'onsite', 'remote', 'remote'][CAST(id % 4 AS INT) + 1] AS work_mode, ['full_time,contractor', 'part_time', NULL, NULL][CAST(id % 4 AS INT) + 1] AS employment_type, CAST(CASE id % 4 WHEN 0 THEN 10.5 WHEN 1 THEN 30 END AS DECIMAL(14,2)) AS salary_min,
CAST(CASE id % 4 WHEN 0 THEN 20 WHEN 1 THEN 30 END AS DECIMAL(14,2)) AS salary_max, ['USD', 'EUR', NULL, NULL][CAST(id % 4 AS INT) + 1] AS salary_currency, ['month', 'year', NULL, NULL][CAST(id % 4 AS INT) + 1] AS salary_period FROM opportunities""")
def r5_postings(t):
    rows = _json_postings(t).withColumn("external_id", work.identifier_of_posting(F.col("posting")))
    return postings.normalize_postings(rows, "id", "external_id").select("id", "external_id", "title", "company", "location_text", "work_mode", "employment_type", "salary_min", "salary_max", "salary_currency", "salary_period")


@query("r5_normalize_feed", """SELECT p_partkey, concat(p_name, ' & co') AS title, p_brand AS company, CASE WHEN p_partkey % 2 = 0 THEN 'Kyiv, Lviv' ELSE 'Remote' END AS location_text, 'remote' AS work_mode, 'full_time' AS employment_type,
CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size END AS DECIMAL(14,2)) AS salary_min, CASE WHEN p_partkey % 2 = 0 THEN 'USD' END AS salary_currency, CASE WHEN p_partkey % 2 = 0 THEN 'month' END AS salary_period FROM part""")
def r5_feed(t):
    title = F.concat("p_name", F.lit(" &amp; co в "), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(", Kyiv, від $"), F.col("p_size").cast("string"), F.lit(", Lviv"))).otherwise(""))
    rows = t.raw("part").select("p_partkey", title.alias("title"), F.lit("<p>Full-time</p>").alias("description"), F.lit(None).cast("string").alias("work_mode"), F.lit("Sat, 03 Jan 2026 10:00:00 GMT").alias("pub_date"))
    return postings.normalize_feed(rows, "p_partkey").select("p_partkey", "title", "company", "location_text", "work_mode", "employment_type", "salary_min", "salary_currency", "salary_period")


@query("r5_normalize_search", "SELECT p_partkey, p_name AS title, 'Remote' AS location_text, 'full_time' AS employment_type, CAST(p_size AS DECIMAL(14,2)) AS salary_max, 'UAH' AS salary_currency FROM part")
def r5_search(t):
    none = F.lit(None).cast("string")
    rows = t.raw("part").select("p_partkey", F.col("p_name").alias("title"), none.alias("company"), F.lit(" ").alias("description"), F.lit("Full-time").alias("summary"), none.alias("location_text"), F.concat(F.col("p_size").cast("string"), F.lit(" грн")).alias("salary_text"), none.alias("published_at"))
    return postings.normalize_search(rows, "p_partkey").select("p_partkey", "title", "location_text", "employment_type", "salary_max", "salary_currency")


def _markdown(t):
    """Each part as a page with one vacancy; odd ones have contacts and a name, even ones a prompt for a resume."""
    key, odd = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 1
    head = F.concat(F.lit("Title: x\nMarkdown Content:\n# [logo](x)\n# **"), "p_name", F.lit("**\n5 квітня 2026\n[Acme "), "p_brand", F.lit("](https://robota.ua/company7)\n"), F.col("p_size").cast("string"), F.lit(" 000 грн\nКиїв\nПовна зайнятість\nВіддалена робота\n"))
    tail = F.when(odd, "\n- Build [things](u)\n\nTest\nIvan Franko\n\nПоказати контакти\nmore").otherwise("Створіть резюме, щоб оцінити свої шанси на вакансію\n\nСтворити резюме\nBuild `things`\n## [Next](x)\nmore")
    return t.raw("part").select("p_partkey", F.concat(head, tail).alias("markdown"), key.alias("key"))


@query("s13_markdown_details", """SELECT p_partkey, p_name AS title, concat('Acme ', p_brand) AS company, CASE WHEN p_partkey % 2 = 1 THEN concat('Build things', chr(10), 'Test') ELSE 'Build things' END AS description, 'Київ' AS location_text, 'remote' AS work_mode,
'full_time' AS employment_type, CAST(p_size * 1000 AS DECIMAL(14,2)) AS salary_min, 'UAH' AS salary_currency, DATE '2026-04-05' AS published FROM part""")
def s13_details(t):
    rows = postings.normalize_details(postings.markdown_details(_markdown(t)), "p_partkey")
    return rows.select("p_partkey", "title", "company", "description", "location_text", "work_mode", "employment_type", "salary_min", "salary_currency", F.to_date("published_at").alias("published"))


@query("s13_markdown_links", """SELECT p_partkey, unnest([concat('1', p_partkey), concat('2', p_partkey), concat('3', p_partkey)]) AS external_id, unnest([concat('https://robota.ua/company5/vacancy1', p_partkey), concat('https://robota.ua/company6/vacancy2', p_partkey), concat('https://robota.ua/company7/vacancy3', p_partkey)]) AS url, unnest([false, true, false]) AS is_remote FROM part""")
def s13_links(t):
    link = lambda company, k: F.concat(F.lit(f"https://www.robota.ua/company{company}/vacancy{k}"), F.col("p_partkey").cast("string"))
    text = F.concat(F.lit("ВІДДАЛЕНА РОБОТА\nsee "), link(5, 1), F.lit("\n## [Dev\nАdd віддалена робота\nText]("), link(6, 2), F.lit("?a=b)\n[Next]("), link(7, 3), F.lit(")\nВіддалена робота\n[Again]("), link(9, 1), F.lit(") (віддалено)"))
    return postings.markdown_links(t.raw("part").select("p_partkey", text.alias("markdown")), "p_partkey")


@query("r6_snapshot_json", "SELECT id, title, company, salary_max, CAST(published_at AS TIMESTAMP) AS published_at FROM opportunities")
def r6(t):
    rows = t.opportunities.select("id", postings.to_snapshot("title", "company", "salary_max", "published_at").alias("j"))
    found = rows.select("id", postings.from_snapshot(F.col("j")).alias("s"))
    return found.select("id", "s.title", "s.company", "s.salary_max", F.col("s.published_at").cast("timestamp_ntz").alias("published_at"))


@query("s22_listing_cache", "SELECT external_id, source_url AS raw_data FROM listings WHERE source_id = 1")
def s22(t):
    rows = t.listings.select("source_id", "external_id", F.col("source_url").alias("raw_data"), F.col("last_seen_at").alias("detail_fetched_at"))
    return postings.listing_cache(rows, 1).select("external_id", "raw_data")


HOSTS = ("feeds.example",)
FEEDS = (
    ("https://feeds.example/jobs/?page=2&primary_keyword=Python", "https://feeds.example/jobs/rss/?primary_keyword=Python&employment=remote"),
    ("https://feeds.example/jobs/l-nonhr/?employment=office", "https://feeds.example/jobs/rss/?editorial=nonhr&employment=remote"),
    ("https://feeds.example/jobs/other/", None),
    ("http://feeds.example/jobs/", None),
    ("https://feeds.example/jobs/rss/?a=b+c&editorial=x", "https://feeds.example/jobs/rss/?a=b+c&editorial=x&employment=remote"),
)


@query("r3_feed_url", f"SELECT p_partkey, {sql_dealt('p_partkey', [b for _, b in FEEDS])} AS url FROM part")
def r3(t):
    return t.raw("part").select("p_partkey", urls.feed_url(dealt("p_partkey", [a for a, _ in FEEDS]), HOSTS, True).alias("url"))


@query("f23_page_url", """SELECT p_partkey, CASE WHEN p_size <= 1 THEN concat('https://x.example/jobs/?q=', p_partkey) ELSE concat('https://x.example/jobs/?q=', p_partkey, '&page=', p_size) END AS by_parameter,
CASE WHEN p_size <= 1 THEN concat('https://x.example/jobs/?q=', p_partkey) ELSE concat('https://x.example/jobs/params;page=', p_size, '?q=', p_partkey) END AS by_path, concat('https://reader.example/jobs/?q=', p_partkey) AS reader, 'https://main.example/jobs' AS vacancy FROM part""")
def f23(t):
    url = F.concat(F.lit("https://x.example/jobs/?q="), F.col("p_partkey").cast("string"))
    made = {"by_parameter": urls.page_url(url, F.col("p_size")), "by_path": urls.page_url(url, F.col("p_size"), in_path=True), "reader": urls.reader_url("https://reader.example", url, ("x.example",)), "vacancy": urls.vacancy_url(url, "main.example")}
    return t.raw("part").select("p_partkey", *(c.alias(n) for n, c in made.items()))


@query("f42_feed_identity", """SELECT p_partkey, substr(sha256(u), 1, 16) AS feed_id, 'redacted|3y' AS levels, concat('sha256:', substr(sha256(p_brand), 1, 16)) AS category, 'UKR' AS country
FROM (SELECT p_partkey, p_brand, concat('https://x.example/jobs/rss/?exp_level=99y&exp_level=3y&secret=1&country=UKR&primary_keyword=', replace(p_brand, '#', '%23')) AS u FROM part) AS x""")
def f42(t):
    url = F.concat(F.lit("https://x.example/jobs/rss/?exp_level=99y&exp_level=3y&secret=1&country=UKR&primary_keyword="), F.replace("p_brand", F.lit("#"), F.lit("%23")))
    found = spread(t.raw("part").select("p_partkey", "p_brand")).select("p_partkey", F.explode(F.array(urls.feed_identity(url, ("basic",)))).alias("f"))
    return found.select("p_partkey", "f.feed_id", F.array_join(F.col("f.filters")["exp_level"], "|").alias("levels"), F.col("f.filters")["primary_keyword"][0].alias("category"), F.col("f.filters")["country"][0].alias("country"))


@query("f43_coercions", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS whole, CASE WHEN p_partkey % 3 = 0 THEN 'неизвестная сумма' WHEN p_partkey % 2 = 0 THEN concat('USD ', p_size, '.00') ELSE concat('USD ', p_size, '.00-', p_size, '.50') END AS shown FROM part")
def f43(t):
    low = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string")).otherwise("many")
    high = F.when((F.col("p_partkey") % 3 != 0) & (F.col("p_partkey") % 2 != 0), F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return t.raw("part").select("p_partkey", money.integer_or_null(low).alias("whole"), money.usd_range(money.decimal_or_null(low), money.decimal_or_null(high)).alias("shown"))


@query("r15_health_worklist", "SELECT s.id AS source_id, r.id AS run_id FROM sources s JOIN (SELECT * FROM runs WHERE finished_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1) AS r ON r.source_id = s.id WHERE enabled")
def r15(t):
    return runs.health_worklist(t.sources, t.runs)


@query("r12_consistency_report", """WITH m AS (SELECT event_type AS parent, event_id AS id, event_id % 2 = 0 AS remaining FROM events), c AS (SELECT DISTINCT event_type AS parent, user_id AS child FROM events),
i AS (SELECT parent, count(*) AS missing_count, array_to_string(list_sort(list(id))[1:10], ',') AS missing_ids, array_to_string(list_sort(list(id) FILTER (remaining))[1:10], ',') AS remaining_ids, count(*) FILTER (remaining) AS remaining_missing_count FROM m GROUP BY parent),
k AS (SELECT parent, count(*) AS children_count, count(*) FILTER (child % 3 = 0) AS rechecks_attempted, list_transform(list_sort(list({'a': child % 3 <> 0, 'b': child % 2 = 0, 'c': child}))[1:16], lambda x: x.c) AS kids FROM c GROUP BY parent)
SELECT parent, missing_count, missing_ids, greatest(0, missing_count - 10) AS missing_ids_omitted, remaining_missing_count, remaining_ids, children_count, rechecks_attempted, greatest(0, children_count - 16) AS children_omitted, array_to_string(kids, ',') AS children FROM i JOIN k USING (parent)""")
def r12(t):
    events = t.raw("events")
    reads = events.select(F.col("event_type").alias("parent"), F.col("user_id").alias("child")).distinct()
    reads = reads.select("*", F.when(F.col("child") % 2 == 0, "processed").otherwise("failed").alias("outcome"), F.when(F.col("child") % 3 == 0, "processed").alias("recheck"), (F.col("child") % 3 == 0).alias("scheduled"))
    missing = events.select(F.col("event_type").alias("parent"), F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("remaining"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return runs.consistency_report(reads, missing).select(
        "parent", "missing_count", text(F.col("missing_ids")).alias("missing_ids"), "missing_ids_omitted", "remaining_missing_count", text(F.col("remaining_missing_ids")).alias("remaining_ids"),
        "children_count", "rechecks_attempted", "children_omitted", text(F.col("children.child")).alias("children"),
    )


@query("l12_scan_cursors", "SELECT CAST(user_id AS VARCHAR) AS profile_id, max(event_id) AS last FROM events GROUP BY user_id")
def l12(t):
    """Cursors begun by each user's first event and moved to the last one."""
    at = lambda f: t.raw("events").groupBy("user_id").agg(f("event_id").alias("e")).select(F.col("user_id").cast("string").alias("profile_id"), F.lit("mail").alias("channel"), F.timestamp_seconds("e").alias("minimum_first_seen_at"))
    begun = upkeep.begin_cycles(at(F.min).where("profile_id < '5'"), at(F.min))
    return upkeep.complete_cycles(begun, at(F.max)).select("profile_id", F.unix_seconds("minimum_first_seen_at").alias("last"))
