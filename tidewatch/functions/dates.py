"""Dates as sources write them. Bad values give null, never an error, in ANSI mode too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in the genitive.
MONTHS = {"января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12}

# How texts write dates and entry into force.
LONG_DATE = r"(\d{1,2})[\s\p{Z}]+([а-яё]+)[\s\p{Z}]+(\d{4})"
EXPLICIT = r"вступ(?:ает|ил|ила)[\s\p{Z}]+в[\s\p{Z}]+силу[\s\p{Z}]+(?:с[\s\p{Z}]+)?(\d{1,2})[\s\p{Z}]+([а-яё]+)[\s\p{Z}]+(\d{4})[\s\p{Z}]*г"
FROM_PUBLICATION = r"вступ(?:ает|ил|ила)[\s\p{Z}]+в[\s\p{Z}]+силу[\s\p{Z}]+со?[\s\p{Z}]+дня[\s\p{Z}]+(?:его[\s\p{Z}]+)?официальн[\p{L}\p{N}_]*[\s\p{Z}]+опубликовани[\p{L}\p{N}_]*"
MOSCOW = "+03:00"


def _date(lower: Column, pattern: str) -> Column:
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(months, F.regexp_extract(lower, pattern, 2))
    whole = F.concat_ws("-", F.regexp_extract(lower, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(lower, pattern, 1), 2, "0"))
    return F.when(month.isNotNull(), whole.try_cast("date"))


def russian_date(text: Column) -> Column:
    """The first 'day month year' of a text; unknown months and impossible days are null."""
    return _date(F.lower(text), LONG_DATE)


def effective_date(text: Column, published_at: Column, zone: str = MOSCOW) -> Column:
    """The date given after 'in force from', else the publication's date, in its source's zone, where the text says so."""
    lower = F.lower(text)
    return F.coalesce(F.when(lower.rlike(EXPLICIT), _date(lower, EXPLICIT)), F.when(lower.rlike(FROM_PUBLICATION), F.to_date(F.from_utc_timestamp(published_at, zone))))


_DAY = r"^(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(?:-?\d)?)"
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?(\d))?$"
_TIME = r"^[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?$"


def _iso_day(day: Column) -> Column:
    """A day as yyyy-MM-dd, written so, without hyphens, or as a day (else Monday) of an ISO week; null for a week or weekday that there isn't."""
    number = lambda k: F.regexp_extract(day, _WEEK, k).try_cast("int")
    fourth = F.try_to_date(F.concat(F.regexp_extract(day, _WEEK, 1), F.lit("-01-04")))  # always in week 1
    weekday = F.coalesce(number(3), F.lit(1))
    found = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (number(2) - 1) * 7 + weekday - 1)
    week = F.when((number(2) > 0) & weekday.between(1, 7) & (F.weekofyear(found) == number(2)), found.cast("string"))
    compact = F.concat_ws("-", F.left(day, F.lit(4)), F.substring(day, 5, 2), F.right(day, F.lit(2)))
    return F.when(day.contains("W"), week).when(F.length(day) == 8, compact).otherwise(day)


def iso(text: Column, zone: str) -> Column:
    """An ISO date, or date and time with ``T`` or a blank between: day or week dates, with or without hyphens and colons; hours, minutes or seconds may end it,
    fractions have any number of digits, of which six count. Without an offset it is the zone's."""
    day = F.regexp_extract(text, _DAY, 0)
    time = F.substr(text, F.length(day) + 1)
    part = lambda k: F.regexp_extract(time, _TIME, k)
    given = lambda k: F.when(part(k) == "", "00").otherwise(part(k))
    offset = F.when(part(5) == "", zone).when(part(5) == "Z", "+00:00").when(F.length(part(5)) == 3, F.concat(part(5), F.lit(":00"))).otherwise(F.concat(F.substring(part(5), 1, 3), F.lit(":"), F.right(part(5), F.lit(2))))
    whole = F.concat(_iso_day(day), F.lit("T"), given(1), F.lit(":"), given(2), F.lit(":"), given(3), F.lit("."), F.rpad(F.left(part(4), F.lit(6)), 6, "0"), offset)
    return F.when((day != "") & ((time == "") | time.rlike(_TIME)), whole.try_cast("timestamp"))


def iso_moscow(text: Column) -> Column:
    """An ISO date or moment; without an offset it is Moscow's."""
    return iso(text, MOSCOW)


def moscow_stamp(text: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in Moscow."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit(MOSCOW)).try_cast("timestamp"))


def dotted_moscow(text: Column) -> Column:
    """dd.MM.yyyy at midnight in Moscow."""
    parts = F.split(F.trim(text), r"\.")
    whole = F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    return F.when(F.trim(text).rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.concat(whole, F.lit("T00:00:00" + MOSCOW)).try_cast("timestamp"))


# Names of zones and months in feeds.
ZONES = {"": "+00:00", "z": "+00:00", "ut": "+00:00", "utc": "+00:00", "gmt": "+00:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00", "msk": "+03:00"}
SHORT_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_FEED = r"^(?:[a-z]{3,9},?\s+)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([+-]\d{4}|[a-z]{1,3}))?)?$"


def feed_date(text: Column) -> Column:
    """A date of a feed: RFC 822 with years of two or four digits (two: 1990 to 2089), offsets or the usual zone names, without seconds, or without a time (then midnight); or ISO.

    Without a zone it is UTC.
    """
    lower = F.lower(F.trim(text))
    part = lambda k: F.regexp_extract(lower, _FEED, k)
    month = F.array_position(F.array(*[F.lit(m) for m in SHORT_MONTHS]), part(2))
    year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3) < "90", "20").otherwise("19"), part(3))).otherwise(part(3))
    two = lambda c: F.lpad(F.when(c == "", "0").otherwise(c), 2, "0")
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), part(7))
    offset = F.when(part(7).rlike("^[+-]"), F.concat(F.left(part(7), F.lit(3)), F.lit(":"), F.right(part(7), F.lit(2)))).otherwise(named)
    whole = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), two(part(1)), F.lit("T"), two(part(4)), F.lit(":"), two(part(5)), F.lit(":"), two(part(6)), offset)
    return F.when(lower.rlike(_FEED), F.when(month > 0, whole.try_cast("timestamp"))).otherwise(iso(F.trim(text), "+00:00"))


def seconds_until(now: Column, hour: int) -> Column:
    """Seconds to the next full hour of the day; a whole day where it is that hour now."""
    target = F.date_trunc("day", now) + F.make_interval(hours=F.lit(hour))
    ahead = F.when(target <= now, target + F.expr("INTERVAL 1 DAY")).otherwise(target)
    return (F.unix_micros(ahead.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000
