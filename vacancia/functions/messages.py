"""What users see: explanations of rule codes, notification texts, masked errors, tables of diagnostics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English words of the scoring rules' codes.
EXPLANATIONS = {
    "unpaid": "Rejected: unpaid or volunteer work.", "military": "Rejected: military recruitment or service.", "equity_only": "Rejected: a share or an idea instead of a base salary.", "senior_title": "Rejected: middle, senior or above.",
    "senior_level": "Rejected: the stated level is senior or above.", "other_role": "Rejected: not a developer's role.", "zero_salary": "Rejected: the stated pay is zero.", "experience": "Rejected: three years of experience or more.",
    "residence": "Rejected: the required residence excludes yours.", "office": "Rejected: office work without a confirmed local workplace.", "not_remote": "Rejected: neither remote nor local.",
}


def explain(code: Column, words: Mapping[str, str] = EXPLANATIONS) -> Column:
    """A code's words; a code of a family ("region_usa") by its family and value; others as they are."""
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    family = F.regexp_extract(code, r"^(region|language|scam)_(.+)$", 1)
    said = F.replace(F.regexp_extract(code, r"^(region|language|scam)_(.+)$", 2), F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_element_at(known, code), F.when(family != "", F.concat(F.lit("Rejected: "), family, F.lit(" ("), said, F.lit(")."))), code)


def explain_all(codes: Column, words: Mapping[str, str] = EXPLANATIONS) -> Column:
    return F.transform(codes, lambda c: explain(c, words))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def match_message(title: Column, company: Column, score: Column, reasons: Column, concerns: Column, url: Column, explore: tuple[int, int] = (35, 54)) -> Column:
    """A notification: title, company, score, up to three reasons and two concerns, the link."""
    bullets = lambda items, n, mark: F.transform(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, n), lambda r: F.concat(F.lit(mark), escape_html(r)))
    head = F.concat(F.lit("<b>"), escape_html(title), F.lit("</b>"), F.when(score.between(*explore), " (Explore)").otherwise(""))
    firm = F.when(company.isNotNull(), F.array(escape_html(company))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(head), firm, F.array(F.concat(F.lit("Score: "), score.cast("string"))), bullets(reasons, 3, "+ "), bullets(concerns, 2, "- "), F.array(escape_html(url)))
    return F.array_join(lines, "\n")


def masked(error: Column, text: str = "Source reported an issue. Details are available internally.") -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", F.lit(text))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def text_table(rows: DataFrame, most: int = 200) -> str:
    """A plain table of a small report, for a terminal."""
    found = [rows.columns, *([("" if v is None else str(v)) for v in r] for r in rows.limit(most).collect())]
    widths = [max(len(r[i]) for r in found) for i in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in found)
