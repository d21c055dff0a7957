"""Date and time functions; intervals are structs of (months, days, micros)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quern.semantics import _c, bound, let

DAY = 86_400_000_000


def extract(field: str, t) -> Column:
    """A field of a timestamp, Sunday being dow 0."""
    t, y = _c(t), F.year(_c(t))
    micros = F.unix_micros(t.cast("timestamp"))
    return {
        "dow": lambda: F.dayofweek(t) - 1,
        "isodow": lambda: F.weekday(t) + 1,
        "doy": lambda: F.dayofyear(t),
        "week": lambda: F.weekofyear(t),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), t),
        "year": lambda: y,
        "quarter": lambda: F.quarter(t),
        "month": lambda: F.month(t),
        "day": lambda: F.dayofmonth(t),
        "hour": lambda: F.hour(t),
        "minute": lambda: F.minute(t),
        "second": lambda: (F.pmod(micros, F.lit(60_000_000)) / 1e6),
        "milliseconds": lambda: F.pmod(micros, F.lit(60_000_000)) / 1e3,
        "microseconds": lambda: F.pmod(micros, F.lit(60_000_000)),
        "epoch": lambda: micros / 1e6,
        "decade": lambda: F.floor(y / 10),
        "century": lambda: F.when(y > 0, F.floor((y + 99) / 100)).otherwise(-F.floor((99 - (y - 1)) / 100)),
        "millennium": lambda: F.when(y > 0, F.floor((y + 999) / 1000)).otherwise(-F.floor((999 - (y - 1)) / 1000)),
    }[field]()


def date_trunc(field: str, t) -> Column:
    """Spark's fields plus decade, century and millennium."""
    t, y = _c(t), F.year(_c(t))
    first = {"decade": lambda: F.floor(y / 10) * 10, "century": lambda: F.floor((y - 1) / 100) * 100 + 1, "millennium": lambda: F.floor((y - 1) / 1000) * 1000 + 1}
    if field in first:
        return F.make_date(first[field]().cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(field, t)


def interval(months=0, days=0, micros=0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(months).cast("long").alias("months"), lit(days).cast("long").alias("days"), lit(micros).cast("long").alias("micros"))


def _toward_zero(a: Column, n: int) -> Column:
    return F.when(a < 0, F.ceil(a / n)).otherwise(F.floor(a / n)).cast("long")


@bound
def justify_hours(i: Column) -> Column:
    d = _toward_zero(i["micros"], DAY)
    days, micros = i["days"] + d, i["micros"] - d * DAY
    up, down = (days > 0) & (micros < 0), (days < 0) & (micros > 0)
    return interval(i["months"], F.when(up, days - 1).when(down, days + 1).otherwise(days), F.when(up, micros + DAY).when(down, micros - DAY).otherwise(micros))


@bound
def justify_days(i: Column) -> Column:
    m = _toward_zero(i["days"], 30)
    months, days = i["months"] + m, i["days"] - m * 30
    up, down = (months > 0) & (days < 0), (months < 0) & (days > 0)
    return interval(F.when(up, months - 1).when(down, months + 1).otherwise(months), F.when(up, days + 30).when(down, days - 30).otherwise(days), i["micros"])


@bound
def justify_interval(i: Column) -> Column:
    """Days of 24 hours, months of 30 days, all parts of one sign."""
    d = _toward_zero(i["micros"], DAY)
    whole = interval(i["months"], i["days"] + d, i["micros"] - d * DAY)

    def months(i: Column) -> Column:
        m = _toward_zero(i["days"], 30)
        return interval(i["months"] + m, i["days"] - m * 30, i["micros"])

    def days(i: Column) -> Column:
        below, above = (i["days"] < 0) | ((i["days"] == 0) & (i["micros"] < 0)), (i["days"] > 0) | ((i["days"] == 0) & (i["micros"] > 0))
        step = F.when((i["months"] > 0) & below, 1).when((i["months"] < 0) & above, -1).otherwise(0)
        return interval(i["months"] - step, i["days"] + step * 30, i["micros"])

    def time(i: Column) -> Column:
        step = F.when((i["days"] > 0) & (i["micros"] < 0), 1).when((i["days"] < 0) & (i["micros"] > 0), -1).otherwise(0)
        return interval(i["months"], i["days"] - step, i["micros"] + step * DAY)

    return let(let(let(whole, months), days), time)


@bound
def add_interval(t, i: Column) -> Column:
    """Months first, clamped to the end of the month, then days, then the time."""
    t = _c(t).cast("timestamp_ntz")
    d = F.date_add(F.add_months(t.cast("date"), i["months"].cast("int")), i["days"].cast("int"))
    rest = F.unix_micros(t.cast("timestamp")) - F.unix_micros(t.cast("date").cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(d.cast("timestamp")) + rest + i["micros"]).cast("timestamp_ntz")


@bound
def age(a, b) -> Column:
    """a - b as whole months, days and time of day, all of one sign."""
    a, b = _c(a).cast("timestamp_ntz"), _c(b).cast("timestamp_ntz")
    hi, lo, sign = F.greatest(a, b), F.least(a, b), F.when(a < b, -1).otherwise(1)
    months = F.floor(F.months_between(hi, lo)).cast("int")
    months = F.when(add_interval(lo, interval(months)) > hi, months - 1).otherwise(months)
    mid = add_interval(lo, interval(months))
    left = F.unix_micros(hi.cast("timestamp")) - F.unix_micros(mid.cast("timestamp"))
    days = F.floor(left / DAY)
    return interval(months * sign, days * sign, (left - days * DAY) * sign)


@bound
def overlaps(s1, e1, s2, e2) -> Column:
    """Half-open periods share a point; a period's ends may come in either order, and a single instant overlaps where it lies."""
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return F.when(a == c, F.lit(True)).when(a > c, a < d).otherwise(c < b)


#: Template patterns and their equivalents, longest first.
TEMPLATE = (
    ("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("month", "MMMM"), ("DDD", "DDD"), ("Day", "EEEE"), ("Mon", "MMM"), ("Dy", "EEE"), ("MM", "MM"), ("DD", "dd"),
    ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("YY", "yy"), ("AM", "a"), ("PM", "a"), ("TZ", "z"), ("Q", "q"),
)


def template(pattern: str) -> str:
    """A to_char/to_date template as a Spark datetime pattern; quoted text stays."""
    out, i = [], 0
    pattern = pattern.replace("FM", "")
    while i < len(pattern):
        if pattern[i] == '"':
            j = pattern.find('"', i + 1)
            out.append("'" + pattern[i + 1 : j] + "'")
            i = j + 1
            continue
        for k, v in TEMPLATE:
            if pattern.startswith(k, i):
                out.append(v)
                i += len(k)
                break
        else:
            ch = pattern[i]
            out.append(f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)


def to_char(t, pattern: str) -> Column:
    return F.date_format(_c(t), template(pattern))


def to_date(s, pattern: str) -> Column:
    return F.to_date(_c(s), template(pattern))


def to_timestamp(s, pattern: str) -> Column:
    """Blanks in text and template are skipped."""
    return F.to_timestamp_ntz(F.regexp_replace(F.trim(_c(s)), "\\s+", " "), F.lit(re.sub(r"\s+", " ", template(pattern).strip())))


# interval and datetime input
#: Unit names of intervals (by prefix-free lists) and what one is, in months, days and microseconds.
UNITS = {
    "millennium millenniums millennia mil mils": (12_000, 0, 0), "century centuries c cent": (1200, 0, 0), "decade decades dec decs": (120, 0, 0), "year years y yr yrs": (12, 0, 0), "mon mons month months": (1, 0, 0),
    "week weeks w": (0, 7, 0), "day days d": (0, 1, 0), "hour hours h hr hrs": (0, 0, 3_600_000_000), "minute minutes m min mins": (0, 0, 60_000_000), "second seconds s sec secs": (0, 0, 1_000_000),
    "millisecond milliseconds ms msec msecs": (0, 0, 1000), "microsecond microseconds us usec usecs": (0, 0, 1),
}
_UNIT = {name: size for names, size in UNITS.items() for name in names.split()}
_NAMES = {name: names.split()[0] for names in UNITS for name in names.split()}


def _clock(text: str) -> int:
    """Microseconds of [sign]h:m[:s[.f]]."""
    sign = -1 if text.startswith("-") else 1
    h, m, *s = text.lstrip("+-").split(":")
    return sign * ((int(h) * 60 + int(m)) * 60_000_000 + round(float(s[0]) * 1_000_000 if s else 0))


def _scaled(number: float, unit: str) -> tuple[int, int, int]:
    """A number of units; fractions of months go on to days (30) and of days to the time, a fraction of a year to months only."""
    months, days, micros = _UNIT[unit]
    if months:
        whole = int(number * months) if months == 1 else round(number * months)
        rest = (number - whole) * 30 if months == 1 else 0.0
        return whole, int(rest), round((rest - int(rest)) * DAY)
    if days:
        whole = number * days
        return 0, int(whole), round((whole - int(whole)) * DAY)
    return 0, 0, round(number * micros)


def parse_interval(text: str, fields: str = "") -> tuple[int, int, int]:
    """(months, days, microseconds) of an interval as people write it: units, SQL year-month and day-time, clock, @ and ago, P forms.

    fields restricts it as in `day to minute`: a bare last number counts in the last field, finer fields are cut off, and a clock of
    two parts is minutes and seconds for `minute to second`.
    """
    last = fields.lower().split()[-1] if fields else ""
    if last:
        t = text.strip()
        if fields.lower() == "minute to second":
            t = re.sub(r"(^|\s)([+-]?)(\d+:\d+(?:\.\d+)?)$", r"\1\g<2>0:\3", t)
        if re.fullmatch(r"[+-]?[\d.]+", t) or (last == "hour" and re.fullmatch(r"\d+ \d+", t)):
            t += " " + last
            t = re.sub(r"^(\d+) (\d+ hour)$", r"\1 day \2", t)
        months, days, micros = parse_interval(t)
        unit = {"year": 0, "month": 0, "day": 0, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1}[last]
        months = int(months / 12) * 12 if last == "year" else months
        return months, 0 if last in ("year", "month") else days, int(micros / unit) * unit if unit else 0
    t = text.strip().lower()
    if t.startswith("p"):
        return _iso_interval(t)
    ago = bool(re.search(r"\bago$", t))
    t = re.sub(r"\bago$", "", t).replace("@", " ").strip()
    total, seen, parts = [0, 0, 0], set(), re.findall(r"[+-]?\d+:\d+(?::\d+(?:\.\d+)?)?|[+-]?\d+-\d+|[+-]?(?:\d+\.?\d*|\.\d+)|[a-z]+|\S", t)
    i = 0

    def add(kind: str, amount) -> None:
        if kind in seen or (kind == "clock" and seen & {"hour", "minute", "second"}) or (kind in ("millisecond", "microsecond") and seen & {"clock"}):
            raise ValueError(f"invalid interval: {text!r}")
        seen.add(kind)
        for k in range(3):
            total[k] += amount[k]

    while i < len(parts):
        p = parts[i]
        nxt = parts[i + 1] if i + 1 < len(parts) else ""
        if ":" in p:
            add("clock", (0, 0, _clock(p)))
        elif re.fullmatch(r"[+-]?\d+-\d+", p):
            sign, (y, m) = (-1 if p[0] == "-" else 1), p.lstrip("+-").split("-")
            add("month", (sign * (int(y) * 12 + int(m)), 0, 0))
        elif re.fullmatch(r"[+-]?[\d.]+", p):
            if nxt in _UNIT:
                if "." in p and _NAMES[nxt] == "second" and seen & {"millisecond", "microsecond"} or _NAMES[nxt] in ("millisecond", "microsecond") and "fraction" in seen:
                    raise ValueError(f"invalid interval: {text!r}")
                add(_NAMES[nxt], _scaled(float(p), nxt))
                if "." in p and _NAMES[nxt] == "second":
                    seen.add("fraction")
                i += 1
            elif ":" in nxt:  # days before a clock
                add("day", (0, int(p), 0))
            elif not nxt and len(parts) == 1:
                add("second", (0, 0, round(float(p) * 1_000_000)))
            else:
                raise ValueError(f"invalid interval: {text!r}")
        else:
            raise ValueError(f"invalid interval: {text!r}")
        i += 1
    if not seen:
        raise ValueError(f"invalid interval: {text!r}")
    return tuple(-x for x in total) if ago else tuple(total)


def _iso_interval(t: str) -> tuple[int, int, int]:
    date, _, time = t[1:].partition("t")
    total = [0, 0, 0]
    for body, units in ((date, {"y": "year", "m": "month", "w": "week", "d": "day"}), (time, {"h": "hour", "m": "minute", "s": "second"})):
        found = re.findall(r"([+-]?[\d.]+)([a-z])", body)
        if "".join(a + b for a, b in found) != body or any(u not in units for _, u in found):
            raise ValueError(f"invalid interval: {t!r}")
        for n, u in found:
            for k, v in enumerate(_scaled(float(n), units[u])):
                total[k] += v
    return tuple(total)


def interval_literal(text: str) -> Column:
    return interval(*parse_interval(text))


def interval_input(s) -> Column:
    """Texts as intervals, parsed in Arrow batches; a text that is none is an error."""
    import pandas as pd

    def parse(texts: pd.Series) -> pd.DataFrame:
        known = {t: parse_interval(t) for t in texts.dropna().unique()}  # once for each different text
        return pd.DataFrame([known.get(t, (None, None, None)) for t in texts], columns=["months", "days", "micros"]).astype("Int64")

    parse.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(parse, "months long, days long, micros long")(_c(s))


@bound
def interval_text(i: Column) -> Column:
    """years, mons, days and a clock; a clock that follows a negative part has its plus sign."""
    y, m = _toward_zero(i["months"], 12), i["months"] - _toward_zero(i["months"], 12) * 12
    part = lambda n, name: F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s")))
    a = F.abs(i["micros"])
    h, rest = F.floor(a / 3_600_000_000), a % 3_600_000_000
    sec = F.concat(F.lpad(F.floor(rest / 1_000_000 % 60).cast("string"), 2, "0"), F.regexp_replace(F.concat(F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0")), "\\.?0+$", ""))
    clock = F.concat(F.lpad(h.cast("string"), F.greatest(F.length(h.cast("string")), F.lit(2)), F.lit("0")), F.lit(":"), F.lpad(F.floor(rest / 60_000_000).cast("string"), 2, "0"), F.lit(":"), sec)
    before = F.when(i["days"] != 0, i["days"] < 0).when(m != 0, m < 0).otherwise(y < 0)
    sign = F.when(i["micros"] < 0, "-").when(before, "+").otherwise("")
    shown = (i["micros"] != 0) | ((i["months"] == 0) & (i["days"] == 0))
    return F.concat_ws(" ", part(y, "year"), part(m, "mon"), part(i["days"], "day"), F.when(shown, F.concat(sign, clock)))


@bound
def interval_plus(a: Column, b: Column) -> Column:
    return interval(*(a[f] + b[f] for f in ("months", "days", "micros")))


@bound
def interval_minus(a: Column, b: Column) -> Column:
    return interval(*(a[f] - b[f] for f in ("months", "days", "micros")))


@bound
def interval_times(i: Column, factor) -> Column:
    """Fractions of a month go on to days (30 each), fractions of a day to the time."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    m, d = i["months"] * f, i["days"] * f
    days = F.round((m - cut(m)) * 30, 6)
    rest = F.round(days - cut(days) + d - cut(d), 6)
    return interval(cut(m), cut(d) + cut(days) + cut(rest), F.round(i["micros"] * f + (rest - cut(rest)) * DAY))


def interval_over(i: Column, divisor: float) -> Column:
    return interval_times(i, 1.0 / divisor)


@bound
def interval_order(i: Column) -> Column:
    """Intervals compare by this: months of 30 days, days of 24 hours."""
    return (i["months"] * 30 + i["days"]).cast("decimal(20,0)") * DAY + i["micros"]


#: Time zone abbreviations, in hours from UTC.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "ZULU": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "MET": 1}
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def parse_timestamp(text: str, order: str = "mdy", zone: str = "UTC", now=None):
    """A datetime without zone, in UTC where the text names a zone (of `zone` otherwise), from the usual ways to write one.

    order says how 02/10/97 reads (mdy, dmy or ymd). now, today, tomorrow, yesterday and epoch count from `now`.
    """
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    words = {"now": now, "today": midnight, "tomorrow": midnight + timedelta(1), "yesterday": midnight - timedelta(1), "epoch": datetime(1970, 1, 1)}
    t = text.strip()
    if t.lower() in words:
        return words[t.lower()]
    bad = ValueError(f"invalid timestamp: {text!r}")
    t = re.sub(r"(?<=\d)T(?=\d)", " ", t)
    offset = None
    if m := re.search(r"\s([A-Za-z_]+/[A-Za-z_/]+)$", t):
        offset, t = ZoneInfo(m[1]), t[: m.start()]
    elif m := re.search(r"\s([A-Za-z]{3,4})([+-]\d{1,2})(?::(\d\d))?$", t):  # the sign counts west of Greenwich, the letters are decoration
        offset, t = -int(m[2]) * 3600 - (1 if int(m[2]) >= 0 else -1) * int(m[3] or 0) * 60, t[: m.start()]
    elif (m := re.search(r"\s?\b([A-Za-z]+)$", t)) and m[1].upper() in ABBREVIATIONS:
        offset, t = ABBREVIATIONS[m[1].upper()] * 3600, t[: m.start()]
    clock = re.search(r"(\d{1,2}):(\d\d)(?::(\d\d)(\.\d+)?)?\s*([AaPp][Mm])?\s*([+-]\d\d(?::?\d\d)?)?", t) or re.search(r"(?<=[ \d])\s(\d\d)(\d\d)(\d\d)(\.\d+)?()\s*([+-]\d{4})?$", t)
    h = mi = s = us = 0
    if clock:
        h, mi, s, us = int(clock[1]), int(clock[2]), int(clock[3] or 0), round(float(clock[4] or 0) * 1_000_000)
        if clock[5]:
            if not 1 <= h <= 12:
                raise bad
            h = h % 12 + 12 * (clock[5].lower() == "pm")
        if clock[6]:
            z = clock[6].replace(":", "")
            offset = (-1 if z[0] == "-" else 1) * (int(z[1:3]) * 3600 + int(z[3:5] or 0) * 60)
        t = t[: clock.start()] + " " + t[clock.end() :]
    if m := re.search(r"\s([+-]\d\d(?::?\d\d)?)\s*$", t):
        z = m[1].replace(":", "")
        offset, t = (-1 if z[0] == "-" else 1) * (int(z[1:3]) * 3600 + int(z[3:5] or 0) * 60), t[: m.start()]
    t = re.sub(r"(?i)\b(mon|tue|wed|thu|fri|sat|sun)[a-z]*\b,?", " ", t).strip()
    year = lambda y: int(y) + (0 if len(y) > 2 else 2000 if int(y) < 70 else 1900)
    if m := re.fullmatch(r"(\d{4})\.(\d{3})", t):
        day = datetime(int(m[1]), 1, 1) + timedelta(int(m[2]) - 1)
    elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)", t):
        day = (int(m[1]), int(m[2]), int(m[3]))
    elif m := re.fullmatch(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", t):
        day = (int(m[1]), int(m[2]), int(m[3]))
    elif m := re.fullmatch(r"(\d{1,4})[-/](\d{1,2})[-/](\d{1,4})", t):
        at = {k: m[i + 1] for i, k in enumerate(order)}
        day = (year(at["y"]), int(at["m"]), int(at["d"]))
    elif m := re.fullmatch(r"(?i)([a-z]{3,9})[- ]+(\d{1,2})(?:,?[- ]+(\d{1,4}))", t):
        day = (year(m[3]), _MONTHS.get(m[1][:3].lower(), 0), int(m[2]))
    elif m := re.fullmatch(r"(?i)(\d{1,4})[- ]*([a-z]{3,9})[- ]*(\d{1,4})", t):
        a, b = (m[1], m[3]) if order == "ymd" or len(m[1]) > 2 else (m[3], m[1])
        day = (year(a), _MONTHS.get(m[2][:3].lower(), 0), int(b))
    else:
        raise bad
    try:
        day = day if isinstance(day, datetime) else datetime(*day)
        out = day + timedelta(hours=h, minutes=mi, seconds=s, microseconds=us)
    except ValueError:
        raise bad from None
    offset = ZoneInfo(zone) if offset is None else offset
    if isinstance(offset, ZoneInfo):
        return out.replace(tzinfo=offset).astimezone(timezone.utc).replace(tzinfo=None)
    return out - timedelta(seconds=offset)


def timestamp_input(s, order: str = "mdy", zone: str = "UTC") -> Column:
    """Texts as timestamps in UTC, parsed in Arrow batches; a text that is none is an error."""
    import pandas as pd

    def parse(texts: pd.Series) -> pd.Series:
        known = {t: parse_timestamp(t, order, zone) for t in texts.dropna().unique()}
        return pd.Series([known.get(t) for t in texts], dtype="datetime64[us]")

    parse.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(parse, "timestamp_ntz")(_c(s))


# time zones, clocks, epochs
def at_time_zone(t, zone) -> Column:
    """A timestamp without zone is taken as local there and gives the instant."""
    return F.to_utc_timestamp(_c(t), zone if isinstance(zone, str) else zone).cast("timestamp_ntz")


def local_in(t, zone) -> Column:
    """An instant (in UTC) gives the wall clock there."""
    return F.from_utc_timestamp(_c(t), zone).cast("timestamp_ntz")


def from_epoch(x) -> Column:
    """to_timestamp(double): seconds since 1970, fractions too."""
    return F.timestamp_micros(F.round(_c(x).cast("double") * 1_000_000).cast("bigint"))


def statement_timestamp() -> Column:
    """The query's start; now() and transaction_timestamp() are the same here."""
    return F.current_timestamp()


def timenow() -> Column:
    """The query's start in whole seconds."""
    return F.date_trunc("second", F.current_timestamp())


def clock_timestamp() -> Column:
    """The time at which each batch of rows is evaluated."""
    import pandas as pd

    def tick(i: pd.Series) -> pd.Series:
        return pd.Series(pd.Timestamp.now(tz="UTC"), index=i.index)

    tick.__annotations__ = {"i": pd.Series, "return": pd.Series}
    return F.pandas_udf(tick, "timestamp").asNondeterministic()(F.monotonically_increasing_id())


def timeofday() -> Column:
    return F.date_format(clock_timestamp(), "EEE MMM dd HH:mm:ss.SSSSSS yyyy z")


# times of day, as microseconds
def time_input(text: str) -> int:
    """Microseconds since midnight of 04:05, 04:05:06.7, 040506 or 4:05 PM; 24:00:00 is allowed."""
    m = re.fullmatch(r"\s*(\d{1,2}):?(\d\d)(?::?(\d\d(?:\.\d+)?))?\s*([AaPp][Mm])?\s*", text)
    if not m or int(m[1]) > 24 or int(m[2]) > 59 or (m[4] and not 1 <= int(m[1]) <= 12):
        raise ValueError(f"invalid time: {text!r}")
    h = int(m[1]) % 12 + 12 * (m[4].lower() == "pm") if m[4] else int(m[1])
    out = (h * 60 + int(m[2])) * 60_000_000 + round(float(m[3] or 0) * 1_000_000)
    if out > DAY:
        raise ValueError(f"invalid time: {text!r}")
    return out


def time_of(t) -> Column:
    """Time of day of a timestamp."""
    return F.pmod(F.unix_micros(_c(t).cast("timestamp")), F.lit(DAY))


def time_plus(t, i: Column) -> Column:
    """Turns over at midnight; only the interval's time counts."""
    return F.pmod(_c(t) + i["micros"], F.lit(DAY))


def time_minus(a, b) -> Column:
    return interval(0, 0, _c(a) - _c(b))


def time_text(t) -> Column:
    return interval_text(interval(0, 0, _c(t)))


# spans of time
def tinterval(start, end) -> Column:
    s, e = _c(start), _c(end)
    return F.struct(s.alias("start"), e.alias("end"))


def tinterval_contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (a["end"] >= b["end"])


def tinterval_overlaps(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def tinterval_length(a: Column) -> Column:
    """reltime: whole seconds."""
    return F.unix_seconds(a["end"].cast("timestamp")) - F.unix_seconds(a["start"].cast("timestamp"))


@bound
def timestamp_series(start, end, step: Column) -> Column:
    """Array of start, start + step, ... up to end (down to it for a negative step), months by the calendar. Explode it for rows.

    A month step counts from the start, so that the 31st comes back after a short month where the engine's day survives;
    steps are added one after another, as the engine does, through Spark's sequence for calendar steps.
    """
    s, e = _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz")
    empty = F.array().cast("array<timestamp_ntz>")
    size = interval_order(step)
    whole = F.make_interval(F.lit(0), step["months"].cast("int"), F.lit(0), step["days"].cast("int"), F.lit(0), F.lit(0), (step["micros"] / 1e6).cast("decimal(18,6)"))
    fits = F.when(size > 0, s <= e).otherwise(s >= e)
    return F.when(size == 0, F.raise_error(F.lit("step size cannot be zero")).cast("array<timestamp_ntz>")).when(fits, F.sequence(s, e, whole)).otherwise(empty)
