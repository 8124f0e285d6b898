"""Salary texts, periods and currencies, as column expressions. Thresholds are multiplied through, never divided, so decimals stay exact."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.text import normalize_text

# months' worth of each period, as numerator and denominator; currencies that amounts are shown in.
PERIODS = {
    "hour": (160, 1), "hourly": (160, 1), "day": (22, 1), "daily": (22, 1), "week": (52, 12), "weekly": (52, 12), "fortnight": (26, 12), "fortnightly": (26, 12),
    "month": (1, 1), "monthly": (1, 1), "year": (1, 12), "yearly": (1, 12), "annual": (1, 12), "annually": (1, 12),
}
TARGETS = ("USD", "UAH", "CZK")
PERIOD_WORDS = {"hour": "час", "day": "день", "week": "неделя", "month": "месяц", "year": "год", "project": "проект"}
AMOUNT = r"(?iU)(?<![\p{L}\p{N}_])(від|до|from|up\s+to)?\s*([$€])?\s*(\d[\d\s .,]*)(?:\s*(?:[-–—]|до|to)\s*([$€])?\s*(\d[\d\s .,]*))?\s*(usd|eur|uah|грн(?:\.|ивень|ивні)?|долар[\p{L}]*|доллар[\p{L}]*)?(?![\p{L}\p{N}_])"
NUMBER = r"(?U)\d[\d\s ]*(?:[.,]\d+)?"


def amount(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"(?U)[\s ]", ""), F.lit(","), F.lit(".")).try_cast("decimal(14,2)")


def currency_of(symbol: Column, code: Column) -> Column:
    low = normalize_text(code)
    return (
        F.when(symbol == "$", "USD").when(symbol == "€", "EUR").when((low == "usd") | low.startswith("долар") | low.startswith("доллар"), "USD").when(low == "eur", "EUR").when((low == "uah") | low.startswith("грн"), "UAH")
    )


def salary_of_details(details: Column) -> Column:
    """struct(minimum, maximum, currency) of the first comma-separated part that holds an amount with a currency."""

    def read(segment: Column) -> Column:
        part = lambda k: F.regexp_extract(segment, AMOUNT, k)
        prefix, first, second = normalize_text(part(1)), amount(F.trim(part(3))), amount(F.nullif(F.trim(part(5)), F.lit("")))
        currency = currency_of(part(2), part(6))
        low = F.when(~prefix.isin("до", "up to"), first)
        high = F.when(prefix.isin("до", "up to"), first).otherwise(second)
        return F.when(currency.isNotNull() & first.isNotNull(), F.struct(low.alias("minimum"), high.alias("maximum"), currency.alias("currency")))

    return F.get(F.filter(F.transform(F.split(details, ","), read), lambda s: s.isNotNull()), F.lit(0))


def salary_of_text(text: Column) -> Column:
    """struct(minimum, maximum, currency) of the first two numbers of a text; a single one is both bounds."""
    low = F.lower(text)
    currency = F.when(low.rlike("грн|uah|₴"), "UAH").when(low.rlike(r"usd|\$"), "USD").when(low.rlike("czk|kč"), "CZK").when(low.rlike("eur|€"), "EUR")
    numbers = F.filter(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), amount), lambda n: n.isNotNull())
    first = F.get(numbers, F.lit(0))
    return F.when(currency.isNotNull() & first.isNotNull(), F.struct(first.alias("minimum"), F.coalesce(F.get(numbers, F.lit(1)), first).alias("maximum"), currency.alias("currency")))


def salary_text(low: Column, high: Column, single: Column, comment: Column, currency: str = "грн") -> Column:
    """The text of numeric salary fields: a comment that names a currency first, a range, a bound, a single amount."""
    some = lambda c: F.when(c > 0, c)
    whole = lambda c: some(c).cast("bigint").cast("string")
    named = F.when(F.lower(comment).rlike("грн|uah|usd|eur|\\$|€|₴"), F.trim(comment))
    pair = F.when(some(low).isNotNull() & some(high).isNotNull() & (low != high), F.concat(whole(low), F.lit(" - "), whole(high)))
    one = F.coalesce(pair, whole(low), whole(high), whole(single))
    return F.coalesce(named, F.concat(one, F.lit(f" {currency}")))


def rate_map(rates: Mapping[str, Decimal | str]) -> dict[str, Decimal]:
    """A checked snapshot of rates in UAH a unit, UAH itself 1."""
    found = {code.upper(): Decimal(str(rate)) for code, rate in rates.items()}
    found["UAH"] = Decimal(1)
    bad = [c for c, r in found.items() if not r.is_finite() or r <= 0] + [c for c in TARGETS if c not in found]
    if bad:
        raise ValueError(f"exchange rates are missing or invalid: {', '.join(sorted(bad))}")
    return found


def rate(currency: Column, rates: Mapping[str, Decimal]) -> Column:
    """UAH a unit, null for an unknown currency."""
    low = F.upper(currency)
    out = F.lit(None).cast("decimal(20,8)")
    for code, value in rates.items():
        out = F.when(low == code, F.lit(value).cast("decimal(20,8)")).otherwise(out)
    return out


def convert(value: Column, source: Column, target: str, rates: Mapping[str, Decimal]) -> Column:
    """An amount in another currency, to a cent, null for an unknown one."""
    return F.round(value.cast("decimal(14,2)") * rate(source, rates) / F.lit(rates[target]).cast("decimal(20,8)"), 2)


def rates_fingerprint(rates: Mapping[str, Decimal]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(f"{c}={r:f}" for c, r in sorted(rates.items())).encode()).hexdigest()


def conversion_fingerprint(currency: Column, rates: Mapping[str, Decimal]) -> Column:
    """A hash of the two rates a conversion to USD depends on; null where it depends on none."""
    low, out = F.upper(F.coalesce(currency, F.lit(""))), F.lit(None).cast("string")
    for code, value in rates.items():
        if code != "USD":
            out = F.when(low == code, F.sha2(F.lit(f"USD={rates['USD']:f}\n{code}={value:f}"), 256)).otherwise(out)
    return out


def whole_amount(value: Column) -> Column:
    return F.format_number(F.round(value), 0)


def range_text(low: Column, high: Column) -> Column:
    a, b = whole_amount(F.coalesce(low, high)), whole_amount(F.coalesce(high, low))
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b))


def period_suffix(period: Column) -> Column:
    low = F.replace(F.lower(period), F.lit("_"), F.lit(" "))
    words = F.create_map(*[F.lit(x) for pair in PERIOD_WORDS.items() for x in pair])
    return F.when(F.coalesce(period, F.lit("")) == "", "").otherwise(F.concat(F.lit(" / "), F.coalesce(F.try_element_at(words, low), low)))


def converted_lines(low: Column, high: Column, currency: Column, period: Column, rates: Mapping[str, Decimal]) -> Column:
    """One line of each target currency; none without an amount."""
    line = lambda code: F.concat(F.lit(f"{code}: "), range_text(*(x.cast("decimal(14,2)") * rate(currency, rates) / F.lit(rates[code]).cast("decimal(20,8)") for x in (low, high))), period_suffix(period))
    return F.when(low.isNull() & high.isNull(), F.array().cast("array<string>")).otherwise(F.array(*map(line, TARGETS)))


def original_line(low: Column, high: Column, currency: Column, period: Column) -> Column:
    named = F.when(F.coalesce(currency, F.lit("")) != "", F.upper(currency)).otherwise("Original currency")
    return F.when(low.isNotNull() | high.isNotNull(), F.concat(named, F.lit(": "), range_text(low, high), period_suffix(period)))


def period_factor(period: Column) -> tuple[Column, Column]:
    """Numerator and denominator of the months in a period; null for an unknown one."""
    low = F.replace(normalize_text(period), F.lit("_"), F.lit(" "))
    num, den = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (n, d) in PERIODS.items():
        num, den = F.when(low == name, n).otherwise(num), F.when(low == name, d).otherwise(den)
    return num, den


def monthly_usd_scaled(value: Column, currency: Column, period: Column, rates: Mapping[str, Decimal]) -> tuple[Column, Column]:
    """(x, y) with value in USD a month = x / y, so that a threshold t is compared as x with t * y."""
    num, den = period_factor(period)
    usd = F.when(F.upper(currency) == "USD", F.lit(rates["USD"]).cast("decimal(20,8)")).otherwise(rate(currency, rates))
    return value.cast("decimal(14,2)") * num * usd.cast("decimal(16,6)"), den * F.lit(rates["USD"]).cast("decimal(16,6)")


def decimal_or_null(c: Column) -> Column:
    """A number out of a text, null where it is none."""
    return F.trim(c).try_cast("decimal(20,6)")


def integer_or_null(c: Column) -> Column:
    """A whole number out of a text; null for all else, fractions too."""
    return F.when(F.rlike(F.trim(c), F.lit(r"^[+-]?\d+$")), F.trim(c).try_cast("long"))


def usd_range(low: Column, high: Column, unknown: str = "неизвестная сумма") -> Column:
    """The text of a range, of its one bound that is there and not zero, or of an unknown sum."""
    shown = lambda c: F.bround(c, 2).cast("decimal(18,2)").cast("string")
    some = F.coalesce(F.nullif(low, F.lit(0)), high)
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("USD "), shown(low), F.lit("-"), shown(high))).otherwise(F.coalesce(F.concat(F.lit("USD "), shown(some)), F.lit(unknown)))
