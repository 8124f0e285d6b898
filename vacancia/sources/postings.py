"""Listings in one normalised form: Markdown cards and details, structured postings, feeds, stored snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions import dates, markup, money, work
from vacancia.functions.text import collapse, fold, headline
from vacancia.operators.lineage import spread

# What links, headings, dates and labels of the Markdown pages look like.
VACANCY_URL = r"(?i)https?://(?:www\.)?robota\.ua/company\d+/vacancy(\d+)(?:\?[^)\s]*)?"
COMPANY_LINK = r"(?i)\[([^\]]+)\]\(https?://(?:www\.)?robota\.ua/company\d+/?(?:\?[^)]*)?\)"
HEADING = r"^#{1,2}\s+(?!\[)\S"
CARD_START = r"(?:#{1,3}\s+)?\[(?!Image\b)"
REMOTE_LABEL, REMOTE_SUFFIX = "Віддалена робота", "(віддалено)"
FULL_TIME, PART_TIME = "Повна зайнятість", ("Неповна зайнятість", "Часткова зайнятість")
RESUME_PROMPT, RESUME_NOTES, RESUME_BUTTON = "Створіть резюме, щоб оцінити свої шанси на вакансію", "Система порівняє", "Створити резюме"
CONTACTS, ENDS, END_PREFIXES = "Показати контакти", ("Відгукнутись", "Гарячі вакансії"), ("[Поділитися на Facebook]", "## [")
TITLE_LINES, DATE_LINES, METADATA_LINES = 40, 20, 35
CURRENCIES = r"uah|грн|₴|usd|\$|eur|€"

# The normalised form of a listing, and the type of each of its fields.
NORMALIZED = {
    "kind": "string", "title": "string", "company": "string", "description": "string", "location_text": "string", "work_mode": "string", "employment_type": "string", "contract_type": "string",
    "salary_min": "decimal(14,2)", "salary_max": "decimal(14,2)", "salary_currency": "string", "salary_period": "string", "published_at": "timestamp", "source_updated_at": "timestamp",
}
SNAPSHOT = ", ".join(f"{name} {kind}" for name, kind in NORMALIZED.items())


def plain_markdown(c: Column) -> Column:
    """A line of Markdown without images, links' targets, marks of headings and items, emphasis and code."""
    for pattern, kept in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"^#{1,6}\s+", ""), (r"^[-*+]\s+", ""), (r"\*\*|__|`", "")):
        c = F.regexp_replace(c, pattern, kept)
    return collapse(c)


def markdown_links(pages: DataFrame, key: str, column: str = "markdown") -> DataFrame:
    """A row per vacancy that a search page links, the first link of each: key, external_id, url, is_remote.

    A card starts at a line that opens a link; it is remote if a label stands between its start and the end of the
    link's line. Pages without links and null pages give no rows.
    """
    card = F.posexplode(F.split(F.col(column), rf"(?m)^(?=[^\S\n]*{CARD_START})")).alias("card", "_card")
    lines = F.split("_card", "\n")
    labelled = lambda x: F.contains(fold(x), F.lit(fold_text(REMOTE_LABEL))) | F.contains(fold(x), F.lit(REMOTE_SUFFIX))
    # only texts before the first card start with something else; there a line stands for itself
    opened = F.rlike("_card", F.lit(rf"^\s*{CARD_START}"))
    rows = spread(pages.select(key, column)).select(key, card).select(key, "card", opened.alias("opened"), F.array_position(F.transform(lines, labelled), True).alias("label"), F.posexplode(lines).alias("line", "_line"))
    rows = rows.withColumn("is_remote", F.when(F.col("opened"), (F.col("label") > 0) & (F.col("label") <= F.col("line") + 1)).otherwise(labelled(F.col("_line"))))
    rows = rows.select("*", F.posexplode(F.regexp_extract_all("_line", F.lit(VACANCY_URL), F.lit(0))).alias("place", "_url"))
    rows = rows.withColumn("external_id", F.regexp_extract("_url", VACANCY_URL, 1)).withColumn("url", F.concat(F.lit("https://robota.ua"), F.regexp_extract("_url", r"^[^:]+://[^/]+([^?]*)", 1)))
    first = rows.groupBy(key, "external_id").agg(F.min(F.struct("card", "line", "place", "url", "is_remote")).alias("f"))
    return first.select(key, "external_id", "f.url", "f.is_remote")


def fold_text(text: str) -> str:
    return text.casefold()


def _first(of: Column, holds: Callable[[Column], Column], start: Column, end: Column) -> Column:
    """The first place from start to before end whose value meets a condition; null without one."""
    places = F.sequence(F.lit(0), F.size(of) - 1)
    return F.array_min(F.filter(places, lambda i: (i >= start) & (i < end) & F.coalesce(holds(F.get(of, i)), F.lit(False))))


def _last(of: Column, holds: Callable[[Column], Column], start: Column, end: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(of) - 1)
    return F.array_max(F.filter(places, lambda i: (i >= start) & (i < end) & F.coalesce(holds(F.get(of, i)), F.lit(False))))


def markdown_details(pages: DataFrame, column: str = "markdown") -> DataFrame:
    """Pages with the fields of the vacancy they show; pages without a title or a description are left out.

    Fields stand in the lines below the first heading; the description runs from the lines after them to what follows
    a vacancy (contacts, sharing, other vacancies). A null or empty page has no title.
    """
    body = F.coalesce(F.nullif(F.regexp_extract(column, r"(?s)Markdown Content:(.*)", 1), F.lit("")), F.col(column))
    lines, clean, n = F.col("_lines"), F.col("_clean"), F.size("_lines")
    title, end, start, stop = (F.col(c) for c in ("_title", "_end", "_start", "_stop"))
    known = (REMOTE_LABEL, FULL_TIME, *PART_TIME)
    df = spread(pages.where(F.col(column).isNotNull())).withColumn("_lines", F.transform(F.split(body, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))).withColumn("_clean", F.transform("_lines", collapse))
    df = df.withColumn("_title", _first(lines, lambda x: F.rlike(x, F.lit(HEADING)), F.lit(0), F.lit(TITLE_LINES))).withColumn("_end", F.least(n, title + METADATA_LINES))
    # the head of the page, read once for each field
    date = _first(clean, lambda x: F.rlike(x, F.lit(rf"(?iu)^\d{{1,2}}\s+(?:{'|'.join(dates.MONTHS)})\s+\d{{4}}$")), title + 1, F.least(n, title + DATE_LINES))
    company = _first(lines, lambda x: F.rlike(x, F.lit(COMPANY_LINK)), title, end)
    paid = _first(clean, lambda x: F.rlike(F.lower(x), F.lit(CURRENCIES)) & F.rlike(x, F.lit(r"\d")), title, end)
    df = df.withColumn("_date", date).withColumn("_pay", F.get(clean, paid))
    placed = lambda x: (x != "") & ~x.isin(*known, RESUME_BUTTON) & ~F.coalesce(x == F.col("_pay"), F.lit(False)) & ~F.rlike(x, F.lit(rf"^(?:\[|Створіть резюме|{RESUME_NOTES})"))
    place = _first(clean, placed, F.col("_date") + 1, end)
    head = F.slice(clean, title + 1, end - title)
    full, part = F.array_contains(head, FULL_TIME), F.arrays_overlap(head, F.array(*map(F.lit, PART_TIME)))
    # the description starts after the prompt for a resume, or after the last label
    prompt = _first(clean, lambda x: x == RESUME_PROMPT, title + 1, end)
    told = _first(clean, lambda x: (x != "") & (x != RESUME_BUTTON) & ~F.startswith(x, F.lit(RESUME_NOTES)), prompt + 1, n)
    labels = F.coalesce(_last(clean, lambda x: x.isin(*known), title + 1, end), title)
    df = df.withColumn("_start", F.coalesce(told, _first(clean, lambda x: x != "", labels + 1, n), n))
    over = _first(clean, lambda x: x.isin(CONTACTS, *ENDS) | F.startswith(x, F.lit(END_PREFIXES[0])) | F.startswith(x, F.lit(END_PREFIXES[1])), start, n)
    df = df.withColumn("_over", F.coalesce(over, n)).withColumn("_signed", F.when(F.get(clean, F.col("_over")) == CONTACTS, _last(clean, lambda x: x != "", start, F.col("_over"))))
    # a name before the contacts is no part of the description
    name = F.get(clean, F.col("_signed"))
    person = (F.length(name) <= 80) & (F.size(F.split(name, " ")) <= 5) & ~F.rlike(name, F.lit(r"^[#*\-\[]|[.!?:;]$"))
    df = df.withColumn("_stop", F.when(person, F.col("_signed")).otherwise(F.col("_over")))
    said = F.filter(F.transform(F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0))), plain_markdown), lambda x: x != "")
    some = lambda c: F.nullif(c, F.lit(""))
    fields = {
        "salary_text": F.col("_pay"), "title": plain_markdown(F.get(lines, title)), "company": some(plain_markdown(F.regexp_extract(F.get(lines, company), COMPANY_LINK, 1))), "description": F.array_join(said, "\n"),
        "location_text": some(plain_markdown(F.get(clean, place))), "employment_type": some(F.concat_ws(",", F.when(full, "full_time"), F.when(part, "part_time"))),
        "published_at": dates.month_name(F.get(clean, F.col("_date"))), "is_remote": _first(clean, lambda x: fold(x) == fold_text(REMOTE_LABEL), title, start).isNotNull(),
    }
    # a condition on generated columns stays above them; pushed down, it would repeat every step within each other
    kept = [c for c in pages.columns if c not in fields]
    found = F.inline_outer(F.array(F.struct(*(c.alias(name) for name, c in fields.items()))))
    return df.select(*kept, found).where("title <> '' and description <> ''")


def _normalized(rows: DataFrame, keys: tuple[str, ...], **fields: Column) -> DataFrame:
    """Keys and all normalised fields; those not given are null."""
    given = {"kind": F.lit("employment")} | fields
    return rows.select(*keys, *(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in NORMALIZED.items()))


def _salary(found: Column) -> dict[str, Column]:
    """Fields of a salary of a text: monthly where it has a currency."""
    return {"salary_min": found["minimum"], "salary_max": found["maximum"], "salary_currency": found["currency"], "salary_period": F.when(found["currency"].isNotNull(), "month")}


def normalize_postings(rows: DataFrame, *keys: str, posting: str = "posting") -> DataFrame:
    """Structured postings (variants). Their dates speak of updates, so nothing says when they were published."""
    p = F.col(posting)
    get = lambda path: F.nullif(F.trim(F.try_variant_get(p, path, "string")), F.lit(""))
    pay = work.salary_of_posting(p)
    return _normalized(
        rows, keys, title=get("$.title"), company=get("$.hiringOrganization.name"), description=get("$.description"), location_text=work.location_of_posting(p), work_mode=work.work_mode_of_posting(p),
        employment_type=work.employment_of_posting(p), salary_min=pay["minimum"], salary_max=pay["maximum"], salary_currency=pay["currency"], salary_period=pay["period"],
        source_updated_at=get("$.sourceUpdatedAt").try_cast("timestamp"),
    )


def normalize_feed(rows: DataFrame, *keys: str) -> DataFrame:
    """Feed items (title, description, work_mode, pub_date) whose titles read "title в company, details"; details hold places and a salary."""
    head = headline(markup.decode_html(F.col("title")))
    parts = F.filter(F.transform(F.split(head["details"], ","), lambda x: F.trim(x)), lambda x: (x != "") & money.salary_of_details(x).isNull())
    place = F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit("Remote"))
    text = markup.description_text(F.col("description"))
    return _normalized(
        rows, keys, title=head["title"], company=head["company"], description=text, location_text=place, work_mode=F.coalesce("work_mode", F.lit("remote")), employment_type=work.employment_of_text(text),
        published_at=dates.rfc822(F.col("pub_date")), **_salary(money.salary_of_details(head["details"])),
    )


def normalize_search(rows: DataFrame, *keys: str) -> DataFrame:
    """Remote listings of a search (title, company, description, summary, location_text, salary_text, published_at)."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    marks = work.employment_of_marks(F.concat_ws(" ", some("description"), some("summary")))
    return _normalized(
        rows, keys, title=F.trim("title"), company=some("company"), description=some("description"), location_text=F.coalesce(some("location_text"), F.lit("Remote")), work_mode=F.lit("remote"),
        employment_type=marks, published_at=dates.iso(F.col("published_at")), **_salary(money.salary_of_text(F.col("salary_text"))),
    )


def normalize_details(rows: DataFrame, *keys: str) -> DataFrame:
    """Vacancies that `markdown_details` read, or rows with its fields."""
    remote = F.coalesce("is_remote", F.lit(False))
    return _normalized(
        rows, keys, title=F.col("title"), company=F.col("company"), description=F.col("description"), location_text=F.coalesce(F.nullif(F.trim("location_text"), F.lit("")), F.when(remote, "Remote")),
        work_mode=F.when(remote, "remote").otherwise("unknown"), employment_type=F.col("employment_type"), published_at=F.col("published_at"), **_salary(money.salary_of_text(F.col("salary_text"))),
    )


def to_snapshot(*fields: str) -> Column:
    """Normalised fields as one JSON text; nulls are written."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def from_snapshot(c: Column) -> Column:
    return F.from_json(c, SNAPSHOT)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of a JSON Lines snapshot for comparing rules offline: normalised fields, and `raw_data` as a map, empty where there is none."""
    rows = spark.read.schema(f"{SNAPSHOT}, raw_data map<string,string>").json(path)
    return rows.withColumn("raw_data", F.coalesce("raw_data", F.create_map().cast("map<string,string>")))


def listing_cache(listings: DataFrame, source_id: int) -> DataFrame:
    """What a source's details are compared with: three columns of all its listings, inactive ones too; nothing is collected."""
    return listings.where(F.col("source_id") == source_id).select("external_id", "raw_data", "detail_fetched_at")
