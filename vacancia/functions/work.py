"""Work modes, employment types, places and salaries of texts and structured postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.text import fold, headline, normalize_text, term_hit

# How texts speak of remote, hybrid and office work.
REMOTE_HEADLINE = r"(?iuU)(?<!\w)(?:віддалено|remote)(?!\w)"
OFFICE_DAYS = r"(?:one|two|three|four|five|\d+)\s+days?\s+(?:per\s+week\s+)?(?:in|at)\s+(?:the\s+)?office|(?:один|два|три|чотири|п'ять|кілька|\d+)\s+дн\w*\s+(?:на\s+тиждень\s+)?(?:в|у)\s+(?:офіс\w*|офис\w*)"
HYBRID_WORK = rf"(?U)(?<!\w)(?:гібридн\w*\s+(?:формат\w*|графік\w*|режим\w*|модел\w*|робот\w*)|гибридн\w*\s+(?:формат\w*|график\w*|режим\w*|модел\w*|работ\w*)|hybrid[-\s]+(?:work\w*|format|mode|model|schedule)|(?:work\w*|format|mode|model|schedule)[-\s]+hybrid|частков\w*\s+віддален\w*|частичн\w*\s+удален\w*|part(?:ial|ially)[-\s]+remote|{OFFICE_DAYS})(?!\w)"
REMOTE_WORD = r"(?:remote(?:ly)?|віддален\w*|дистанційн\w*|удален\w*|удалён\w*)"
HYBRID_WORD = r"(?:hybrid|гібридн\w*|гибридн\w*)"
CHOICE_WORD = r"(?:or|або|чи|или)"
REMOTE_CHOICE = rf"(?U)(?<!\w)(?:{REMOTE_WORD}[^.!?;\n]{{0,90}}?\b{CHOICE_WORD}\b[^.!?;\n]{{0,45}}?{HYBRID_WORD}|{HYBRID_WORD}[^.!?;\n]{{0,90}}?\b{CHOICE_WORD}\b[^.!?;\n]{{0,45}}?{REMOTE_WORD})(?!\w)"
REMOTE_DENIED = rf"(?U)(?<!\w)(?:no|not|without|немає|нема|без|не)\s+(?:fully\s+)?{REMOTE_WORD}|{REMOTE_WORD}(?:\s+or\s+{HYBRID_WORD})?\s+(?:work\s+)?(?:is\s+)?not\s+(?:available|allowed|possible)"
ATTENDANCE_WORD = r"(?:office|on[- ]?site|in[- ]person|офіс\w*|офис\w*)"
REQUIRED_WORD = r"(?:must|required|mandatory|have\s+to|обов['’ʼ]?язков\w*|обязательн\w*)"
ATTENDANCE_LINK = r"(?:to|work|working|attend|attendance|visits?|presence|at|in|the|our|be|present|from|an?|is|are|присутність|відвідування|робота|працювати|в|у|на|є|присутствие|посещение|работа|работать)"
HYBRID_LINK = r"(?:work|working|format|model|schedule|is|are|режим\w*|формат\w*|робот\w*|работ\w*|графік\w*|график\w*|є|буде|является)"
ATTENDANCE = rf"(?<!\w)(?:{REQUIRED_WORD}(?:\s+{ATTENDANCE_LINK}){{0,6}}\s+{ATTENDANCE_WORD}|{ATTENDANCE_WORD}(?:\s+{ATTENDANCE_LINK}){{0,4}}\s+{REQUIRED_WORD}|{REQUIRED_WORD}(?:\s+{HYBRID_LINK}){{0,3}}\s+{HYBRID_WORD}|{HYBRID_WORD}(?:\s+{HYBRID_LINK}){{0,4}}\s+{REQUIRED_WORD}|{OFFICE_DAYS})(?!\w)"
NEGATION = r"(?<!\w)(?:no|not|without|без|не)"
FULL_TIME = r"(?U)(?<!\w)(?:full[- ]?time|повн\w*\s+зайнят\w*)(?!\w)"
PART_TIME = r"(?U)(?<!\w)(?:part[- ]?time|частков\w*\s+зайнят\w*)(?!\w)"
REMOTE_LABELS = ("remote", "remote work", "remote jobs", "дистанційна робота", "віддалена робота")
REMOTE_MARKERS = ("віддален", "удален", "дистанційн", "дистанцион", "remote", "work from home")


def strict_remote(head: Column, description: Column) -> Column:
    """Remote by the headline, not denied, no attendance demanded unless negated, and hybrid work at most a choice."""
    text = normalize_text(F.concat_ws(" ", head, description))
    # the negation before a demand is part of its match, so a demand without one has an empty first group
    demands = F.regexp_extract_all(text, F.lit(rf"(?U)({NEGATION}\s*)?{ATTENDANCE}"), F.lit(1))
    hybrid_only = F.rlike(text, F.lit(HYBRID_WORK)) & ~F.rlike(text, F.lit(REMOTE_CHOICE))
    return F.coalesce(F.rlike(head, F.lit(REMOTE_HEADLINE)), F.lit(False)) & ~F.rlike(text, F.lit(REMOTE_DENIED)) & ~F.exists(demands, lambda d: F.coalesce(d, F.lit("")) == "") & ~hybrid_only


def work_mode_of_text(head: Column, description: Column, cities: tuple[str, ...]) -> Column:
    """remote, or hybrid or onsite where the headline's details name one of the cities; null elsewhere: no listing to keep."""
    place = normalize_text(headline(head)["details"])
    near = F.lit(False)
    for city in cities:
        near = near | term_hit(place, city.casefold())
    text = normalize_text(F.concat_ws(" ", head, description))
    hybrid = F.rlike(text, F.lit(HYBRID_WORK)) | term_hit(place, "hybrid")
    return F.when(strict_remote(head, description), "remote").when(near & hybrid, "hybrid").when(near, "onsite")


def remote_label(c: Column) -> Column:
    """Whether a text is one of the labels of remote work."""
    return F.coalesce(fold(c).isin(*REMOTE_LABELS), F.lit(False))


def remote_marked(*texts: Column) -> Column:
    """Whether any of the texts holds a marker of remote work."""
    return F.rlike(fold(F.concat_ws(" ", *texts)), F.lit("|".join(REMOTE_MARKERS)))


def employment_of_text(description: Column) -> Column:
    """full_time or part_time by the words of a description, full_time first."""
    text = normalize_text(description)
    return F.when(F.rlike(text, F.lit(FULL_TIME)), "full_time").when(F.rlike(text, F.lit(PART_TIME)), "part_time")


def employment_of_marks(description: Column) -> Column:
    """Both types where a description names both."""
    text = fold(description)
    found = F.concat_ws(",", F.when(F.contains(text, F.lit("full-time")), "full_time"), F.when(F.contains(text, F.lit("part-time")), "part_time"))
    return F.nullif(found, F.lit(""))


def _of(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, *kinds: str) -> Column:
    """Whether a variant is of one of the kinds of JSON values; false where there is none."""
    name = F.schema_of_variant(v)
    out = F.lit(False)
    for kind in kinds:
        out = out | F.startswith(name, F.lit(kind))
    return F.coalesce(out, F.lit(False))


def _items(v: Column) -> Column:
    """A list's values, or the one value; empty where there is none."""
    many = _of(v, "$", "array<variant>")
    return F.when(v.isNull(), F.array().cast("array<variant>")).when(many.isNotNull(), many).otherwise(F.array(v))


def employment_of_posting(posting: Column) -> Column:
    """The employment types of a posting in lower case, joined by commas where there are several."""
    kinds = F.transform(_items(_of(posting, "$.employmentType", "variant")), lambda v: F.lower(_of(v, "$")))
    return F.nullif(F.array_join(F.filter(kinds, lambda k: k.isNotNull()), ","), F.lit(""))


def work_mode_of_posting(posting: Column) -> Column:
    kinds = F.transform(_items(_of(posting, "$.jobLocationType", "variant")), lambda v: F.lower(_of(v, "$")))
    place = F.to_json(_of(posting, "$.jobLocation", "variant"))
    placed = place.isNotNull() & ~place.isin("null", "{}", "[]", '""', "0", "false")
    return F.when(F.exists(kinds, lambda k: F.coalesce(k == "telecommute", F.lit(False))), "remote").when(placed, "onsite").otherwise("unknown")


def salary_of_posting(posting: Column) -> Column:
    """struct(minimum, maximum, currency, period) of `estimatedSalary`, whose amounts stand in its `value` or in itself; a zero bound counts as none."""
    whole = _of(posting, "$.estimatedSalary", "variant")
    inner = _of(posting, "$.estimatedSalary.value", "variant")
    amounts = F.when(_is(inner, "OBJECT"), inner).otherwise(whole)
    money = lambda key: F.nullif(_of(amounts, f"$.{key}").try_cast("decimal(14,2)"), F.lit(0).cast("decimal(14,2)"))
    word = lambda v, key: F.nullif(F.trim(_of(v, f"$.{key}")), F.lit(""))
    found = F.struct(
        F.coalesce(money("minValue"), money("value")).alias("minimum"), F.coalesce(money("maxValue"), money("value")).alias("maximum"),
        F.upper(word(whole, "currency")).alias("currency"), F.lower(word(amounts, "unitText")).alias("period"),
    )
    return F.when(_is(whole, "OBJECT"), found)


def _names(v: Column) -> Column:
    """Texts of a name: a text, an object's name, or a list of either."""
    unnamed = F.flatten(F.transform(_items(v), lambda x: F.when(_is(x, "OBJECT"), _items(_of(x, "$.name", "variant"))).otherwise(F.array(x))))
    texts = F.transform(unnamed, lambda x: F.when(_is(x, "STRING"), F.trim(_of(x, "$"))))
    return F.filter(texts, lambda x: F.coalesce(x != "", F.lit(False)))


def _places(v: Column) -> Column:
    def one(x: Column) -> Column:
        at = _of(x, "$.address", "variant")
        parts = F.concat(*(_names(_of(x, f"$.address.{k}", "variant")) for k in ("addressCountry", "addressRegion", "addressLocality")))
        country = F.when(_of(x, "$['@type']") == "Country", _names(_of(x, "$.name", "variant"))).otherwise(F.array().cast("array<string>"))
        return F.when(_is(at, "OBJECT"), parts).otherwise(country)

    return F.flatten(F.transform(_items(v), one))


def location_of_posting(posting: Column) -> Column:
    """Places that applicants must live in, else those of the job, each once; `Remote` where a remote posting names none."""
    wanted, given = _places(_of(posting, "$.applicantLocationRequirements", "variant")), _places(_of(posting, "$.jobLocation", "variant"))
    chosen = F.when(F.size(wanted) > 0, wanted).otherwise(given)
    return F.when(F.size(chosen) > 0, F.array_join(F.array_distinct(chosen), ", ")).when(work_mode_of_posting(posting) == "remote", "Remote")


def identifier_of_posting(posting: Column) -> Column:
    """A posting's identifier: a text, or an object's value or name."""
    v = _of(posting, "$.identifier", "variant")
    text = F.when(_is(v, "OBJECT"), F.coalesce(F.nullif(_of(v, "$.value"), F.lit("")), _of(v, "$.name"))).otherwise(_of(v, "$"))
    return F.nullif(F.trim(text), F.lit(""))
