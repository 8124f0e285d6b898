"""Text normalisation, identity keys and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and context words that identities leave out, and the separators between parts.
LEGAL_SUFFIXES = r"(\s+(llc|incorporated|inc|ltd|limited|gmbh|plc|corp|corporation|s\s*r\s*o|a\s*s|тов|тзов|пп|фоп))+$"
LEGAL_PREFIXES = r"^((llc|ltd|gmbh|corp|corporation|s\s*r\s*o|тов|тзов|пп|фоп)\s+)+"
CONTEXT_MARKERS = ("remote", "remote work", "віддалено", "віддалена робота", "europe", "eu", "worldwide", "anywhere", "kyiv", "kiev", "prague", "praha", "full time", "full-time")
TRAILING_CONTEXT = r"(?U)\s+[-–—|·]\s*(remote|remote work|віддалено|віддалена робота|europe|eu|worldwide|anywhere|kyiv|kiev|prague|praha|full[- ]time)\s*$"
BRACKETS = r"[\[(]([^\])]+)[\])]"
HEADLINE = r"(?iu)^(.+)\s+в\s+([^,]+)(?:,\s*(.+))?$"

REDACTED = "[REDACTED]"
# Fixed values, in the order in which they apply: where secrets stand in a text.
SECRETS = (
    (r"(://[^:/\s]+:)([^@\s]+)(@)", rf"$1{REDACTED}$3"),
    (r"(?i)([?&](?:api[_-]?key|access[_-]?token|oauth[_-]?token|token|password|secret)=)([^&\s]+)", rf"$1{REDACTED}"),
    (r"(?i)(Bearer\s+)([A-Za-z0-9._~+/=-]+)", rf"$1{REDACTED}"),
    (r"(?i)((?:authorization|api[_-]?key|access[_-]?token|oauth[_-]?token|bot[_-]?token|password|passwd|secret)\s*[=:]\s*)([^\s,;]+)", rf"$1{REDACTED}"),
    (r"(?<!\d)(\d{6,12}):([A-Za-z0-9_-]{20,})(?!\w)", REDACTED),
)


def fold(c: Column) -> Column:
    """Lower case in which a sharp s is two letters."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    return fold(collapse(F.coalesce(c, F.lit(""))))


def company_identity(c: Column) -> Column:
    plain = collapse(F.regexp_replace(normalize_text(c), r"[^\p{L}\p{N}]+", " "))
    bare = F.trim(F.regexp_replace(plain, LEGAL_PREFIXES, ""))
    return F.trim(F.regexp_replace(bare, LEGAL_SUFFIXES, ""))


def title_identity(c: Column) -> Column:
    """A title without bracketed groups that hold context markers alone, without a trailing marker, and without dashes and stops."""
    text = normalize_text(c)
    groups = F.regexp_extract_all(text, F.lit(BRACKETS), F.lit(0))

    def context_only(group: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.substring(group, 2, 1_000_000), r"[\])]|[,/|·]+"), lambda p: F.trim(p)), lambda p: p != "")
        return (F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(*CONTEXT_MARKERS))

    bare = F.aggregate(F.filter(groups, context_only), text, lambda whole, group: F.replace(whole, group, F.lit(" ")))
    return collapse(F.regexp_replace(F.regexp_replace(collapse(bare), TRAILING_CONTEXT, ""), r"[-–—_/.,:;]+", " "))


def canonical_key(company: Column, title: Column, location: Column, work_mode: Column) -> Column:
    return F.sha2(F.concat_ws("|", company_identity(company), title_identity(title), normalize_text(location), work_mode), 256)


def content_hash(*fields: Column) -> Column:
    """A hash of named fields that tells nulls from empty texts."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def terms(normalized: Column) -> Column:
    """The distinct words of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def quality_score(description: Column, salary_min: Column, salary_max: Column, *optional: Column) -> Column:
    """Length of the description up to 20,000, 2,000 for a salary, 100 for each optional field there is."""
    score = F.least(F.length(normalize_text(description)), F.lit(20_000)) + F.when(salary_min.isNotNull() | salary_max.isNotNull(), 2000).otherwise(0)
    for field in optional:
        score = score + F.when(field.isNotNull(), 100).otherwise(0)
    return score


def headline(c: Column) -> Column:
    """struct(title, company, details) of "title в company, details"; the whole as title where it has no such form."""
    part = lambda k: F.trim(F.regexp_extract(c, HEADLINE, k))
    whole = F.rlike(c, F.lit(HEADLINE)) & (part(1) != "") & (part(2) != "")
    return F.struct(F.when(whole, part(1)).otherwise(c).alias("title"), F.when(whole, part(2)).alias("company"), F.nullif(part(3), F.lit("")).alias("details"))


def redact(c: Column) -> Column:
    for pattern, replacement in SECRETS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def markdown_text(c: Column) -> Column:
    """Text of Markdown: images and links by their words, without emphasis and heading marks."""
    plain = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    plain = F.regexp_replace(plain, r"(?m)^\s{0,3}#{1,6}\s*", "")
    return collapse(F.regexp_replace(plain, r"[*`]+", ""))


def one_decimal(c: Column) -> Column:
    """A double of 0 to 1e12 with one decimal, the exact binary value rounded half to even, as printf does; format_string rounds its shortest decimal half up."""
    tenths = ((c - F.floor(c)) * float(2**56)).cast("long") * 10
    half, unit = F.lit(2**55), 2**56
    down, rest = F.shiftright(tenths, 56), tenths.bitwiseAND(unit - 1)
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    whole = F.floor(c) * 10 + down + up.cast("long")
    return F.format_string("%d.%d", F.floor(whole / 10), whole % 10)


def event_key(rules: Column, content: Column) -> Column:
    return F.concat(F.lit("match:"), rules, F.lit(":"), F.substring(content, 1, 16))


def retry_delay(attempts: Column) -> Column:
    """Seconds until the next attempt: doubling from a minute to an hour."""
    return F.least(F.lit(3600), (60 * F.pow(F.lit(2), F.least(F.lit(6), F.greatest(F.lit(0), attempts - 1)))).cast("int"))


def term_hit(text: Column, term: str) -> Column:
    """Whether a term stands in a text with no word character beside it."""
    import re

    return F.contains(text, F.lit(term)) & F.rlike(text, F.lit(r"(^|[^\p{L}\p{N}_])" + re.escape(term) + r"($|[^\p{L}\p{N}_])"))


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def pack_lines(lines: Column, limit: int = 3500) -> Column:
    """Lines joined into chunks of at most ``limit`` characters, greedily; a longer line is a chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, line: Column) -> Column:
        fits = F.length(state["open"]) + 1 + F.length(line) <= limit
        done = F.when(state["open"].isNull() | fits, state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        return F.struct(done.alias("done"), F.when(fits, F.concat(state["open"], F.lit("\n"), line)).otherwise(line).alias("open"))

    return F.aggregate(lines, start, add, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))
