"""Pages and documents of sources: JSON-LD, cards in HTML and Markdown, API and export JSON, exchange rates."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.sources import exports

SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
CHALLENGE_TEXT = r"(?i)(verify you are human|checking your browser|security check|підтвердьте, що ви не робот)"
CHALLENGE_MARKS = r"(?i)(cf-chl|challenge-platform|g-recaptcha|hcaptcha)"
EXPORT = "Id string, Url string, Name string, CompanyName string, DescriptionShort string, Description string, WorkType string, SalaryFrom long, SalaryTo long, Salary long, SalaryTxt string, LastUpdate string, CityId int, RubricId array<int>, BranchId int"


def json_ld(pages: DataFrame, column: str = "html", kind: str = "JobPosting") -> DataFrame:
    """A row per JSON-LD object of a type in each page, as a variant; @graph lists are opened, malformed scripts skipped."""
    scripts = pages.select("*", F.explode(F.regexp_extract_all(F.col(column), F.lit(SCRIPT), F.lit(1))).alias("_script"))
    parsed = scripts.select("*", F.try_parse_json("_script").alias("_v")).where("_v is not null")
    graph = F.coalesce(F.try_variant_get("_v", "$['@graph']", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"), F.array(F.col("_v")))
    objects = parsed.select("*", F.explode(graph).alias("posting"))
    one, many = F.try_variant_get("posting", "$['@type']", "string"), F.try_variant_get("posting", "$['@type']", "array<string>")
    return objects.where(F.coalesce(one == kind, F.lit(False)) | F.coalesce(F.array_contains(many, kind), F.lit(False))).drop("_script", "_v")


def posting_fields(objects: DataFrame) -> DataFrame:
    """The usual fields of job postings."""
    get = lambda path, kind="string": F.try_variant_get("posting", path, kind)
    return objects.select(
        "*", F.coalesce(get("$.identifier.value"), get("$.identifier")).alias("external_id"), get("$.title").alias("title"), get("$.hiringOrganization.name").alias("company"), get("$.description").alias("description"),
        get("$.datePosted").try_cast("timestamp").alias("published_at"), F.when(get("$.jobLocationType") == "TELECOMMUTE", "remote").when(get("$.jobLocation").isNotNull() | get("$.jobLocation", "variant").isNotNull(), "onsite").otherwise("unknown").alias("work_mode"),
        F.coalesce(get("$.baseSalary.value.minValue", "decimal(14,2)"), get("$.baseSalary.value.value", "decimal(14,2)")).alias("salary_min"), F.coalesce(get("$.baseSalary.value.maxValue", "decimal(14,2)"), get("$.baseSalary.value.value", "decimal(14,2)")).alias("salary_max"),
        F.upper(get("$.baseSalary.currency")).alias("salary_currency"), F.lower(get("$.baseSalary.value.unitText")).alias("salary_period"),
    )


def challenge(content: Column, has_listings: Column) -> Column:
    """Whether a page is a security challenge: by what it says, or by a vendor's marks where it holds no listing."""
    return F.rlike(content, F.lit(CHALLENGE_TEXT)) | ~has_listings & F.rlike(content, F.lit(CHALLENGE_MARKS))


class _Cards(HTMLParser):
    """Cards of a search page: an element whose class names a card, its first link, and texts by class."""

    def __init__(self, card: str, fields: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.card, self.fields, self.cards, self.depth, self.open = card, fields, [], 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        classes = (found.get("class") or "").split()
        if not self.depth and self.card in classes:
            self.cards.append({"url": None} | dict.fromkeys(self.fields, ""))
            self.depth = 1
        elif self.depth and tag not in ("br", "img", "input", "hr", "meta", "link"):
            self.depth += 1
        if self.depth:
            if tag == "a" and self.cards[-1]["url"] is None:
                self.cards[-1]["url"] = found.get("href")
            name = next((f for f, c in self.fields.items() if c in classes), None)
            if name:
                self.open.append((self.depth, name))

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag not in ("br", "img", "input", "hr", "meta", "link"):
            self.open = [o for o in self.open if o[0] != self.depth]
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth and self.open:
            self.cards[-1][self.open[-1][1]] += data


def html_cards(pages: DataFrame, key: str, card: str, fields: dict[str, str], column: str = "html") -> DataFrame:
    """A row per card of each page: key, position, url and the text of each named class."""
    names = list(fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, text in zip(f[key], f[column]):
                parser = _Cards(card, fields)
                parser.feed(text or "")
                out += [(k, i, c["url"], *(" ".join(c[n].split()) or None for n in names)) for i, c in enumerate(parser.cards)]
            yield pd.DataFrame(out, columns=[key, "position", "url", *names])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInPandas(run, f"{key} {kind}, position int, url string, " + ", ".join(f"{n} string" for n in names))


def markdown_cards(pages: DataFrame, column: str = "markdown") -> DataFrame:
    """A row per linked second-level heading of a Markdown page: position, title, url and the lines below it."""
    blocks = F.filter(F.split(F.col(column), r"(?m)^##\s+(?=\[)"), lambda b: F.startswith(b, F.lit("[")))
    rows = pages.select("*", F.posexplode(blocks).alias("position", "_block"))
    head = r"^\[([^\]]+)\]\(([^)\s]+)[^)]*\)"
    lines = F.filter(F.transform(F.split(F.regexp_replace("_block", head, ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("*", F.regexp_extract("_block", head, 1).alias("title"), F.regexp_extract("_block", head, 2).alias("url"), lines.alias("lines")).drop("_block")


def between(text: Column, start: str, end: str) -> Column:
    """The text between two markers; null where the first is missing."""
    found = F.regexp_extract(text, rf"(?s){start}(.*?)(?:{end}|\z)", 1)
    return F.when(F.rlike(text, F.lit(start)), F.trim(found))


def api_details(rows: DataFrame, column: str, remote_group: int) -> DataFrame:
    """Details of API answers: null where the answer is of another id or no longer active; remote where a cluster holds the group."""
    schema = "id string, name string, companyName string, description string, cityName string, date string, salary int, salaryFrom int, salaryTo int, salaryComment string, isActive boolean, clusters array<struct<groups:array<struct<id:int>>>>"
    parsed = rows.withColumn("d", F.from_json(column, schema))
    groups = F.flatten(F.transform("d.clusters", lambda c: c["groups"]))
    ok = (F.col("d.id") == F.col("external_id")) & F.coalesce("d.isActive", F.lit(True))
    fields = {n: F.when(ok, F.col(f"d.{n}")) for n in ("name", "companyName", "description", "cityName", "salaryFrom", "salaryTo")}
    return parsed.withColumns(fields | {"remote": F.when(ok, F.coalesce(F.exists(groups, lambda g: g["id"] == remote_group), F.lit(False)))}).drop("d")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of objects, gzipped or not, of a file or a folder; one that isn't whole fails the read rather than losing rows."""
    return exports.read(spark, path, EXPORT)


def export_candidates(rows: DataFrame, rubrics: tuple[int, ...], keywords: tuple[str, ...], remote_city: int) -> DataFrame:
    """Export rows of wanted rubrics or with a wanted word in their title, that are remote by city or by text."""
    wanted = F.arrays_overlap(F.coalesce("RubricId", F.array().cast("array<int>")), F.array(*map(F.lit, rubrics)))
    for word in keywords:
        wanted = wanted | F.contains(F.lower(F.coalesce("Name", F.lit(""))), F.lit(word))
    text = F.lower(F.concat_ws(" ", "Name", "DescriptionShort", "WorkType"))
    return rows.where(wanted & ((F.col("CityId") == remote_city) | F.rlike(text, F.lit("remote|віддален|удал[её]н"))))


def exchange_rates(payload: DataFrame, column: str = "json") -> DataFrame:
    """code, rate, effective_date of a rates list; rows without a code or a finite positive rate are left out."""
    items = payload.select(F.explode(F.from_json(column, "array<struct<cc:string,rate:string,exchangedate:string>>")).alias("r"))
    rate = F.col("r.rate").try_cast("decimal(20,8)")
    return items.where((rate > 0) & (F.trim(F.coalesce("r.cc", F.lit(""))) != "")).select(F.upper(F.trim("r.cc")).alias("code"), rate.alias("rate"), F.to_date("r.exchangedate", "dd.MM.yyyy").alias("effective_date"))


def text_of_html(column: Column) -> Column:
    """All text of a fragment with its character references decoded and white space collapsed."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(html.unescape(re.sub(r"<[^>]*>", " ", v)).split()))

    return plain(column)
