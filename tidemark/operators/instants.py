"""Texts of mixed form, precision and zone to one UTC instant.

An ordered cascade of anchored patterns: the first pattern that matches the whole trimmed
value decides, its parts are checked strictly (a 30 February is no date) and a value no
pattern takes is null.  Local times get their zone from the writer's entry in a lookup
table.  Policy: a local time that occurs twice means the first, one that is skipped is read
with the offset in force before the skip; both are what the JVM's zone rules do with a
local time, so the step is one built-in call.  Everything is a Catalyst expression.

Defined cases: null, empty and other texts give null; blanks around a value are ignored;
digits beyond microseconds are cut; a year-last digit date needs a day-first or
month-first writer when written with slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations that mean one offset, in minutes east of UTC.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "JST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# English month names, which texts give in full or by their first letters.
MONTHS = "January February March April May June July August September October November December".split()

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_ZONE = r"\s*(Z|[A-Z]{2,4}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?)?"
_MON = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + r"|Sept)\.?"
_DAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"

#: name -> (pattern, order of the groups); the order of the entries is the cascade.
PATTERNS: dict[str, tuple[str, str]] = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:[T ]|\s+){_CLOCK}{_ZONE})?$", "y m d H M S f z"),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,12}}))?{_ZONE}$", "y m d H M S f z"),
    "year_slash": (rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:(?:[T ]|\s+){_CLOCK}{_ZONE})?$", "y m d H M S f z"),
    "mail": (rf"^{_DAY}(\d{{1,2}})[ -]{_MON}[ -](\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", "d n y H M S f z"),
    "month_first": (rf"^{_DAY}{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}{_HALF}{_ZONE})?$", "n d y H M S f h z"),
    "digits": (rf"^(\d{{1,2}})([/.-])(\d{{1,2}})[/.-](\d{{4}})(?:,?\s+{_CLOCK}{_HALF}{_ZONE})?$", "a x b y H M S f h z"),
    "han": (rf"^(\d{{4}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日\s*(?:{_CLOCK}{_ZONE})?$", "y m d H M S f z"),
}
#: Unix times by number of digits of the whole part: microseconds per unit as (times, by).
EPOCHS = {10: (1_000_000, 1), 13: (1_000, 1), 16: (1, 1), 19: (1, 1_000)}


#: Field names of the picked parts, which differ without regard to case.
_FIELD = dict(zip("ymdHMSfhz", "year month day hour minute second fraction half zone".split()))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _month_number(name: Column) -> Column:
    letters = F.lit("".join(m[:3].lower() for m in MONTHS))
    at = F.call_function("locate", F.lower(F.substring(name, 1, 3)), letters)
    return F.floor((at - 1) / 3).cast("int") + 1


def _offset_us(zone: Column) -> Column:
    """Microseconds east of UTC; null for no zone or one that is not known."""
    sign = F.when(F.regexp_extract(zone, r"([+-])", 1) == "-", -1).otherwise(1)
    hours = _int(F.regexp_extract(zone, r"[+-](\d{2})", 1))
    minutes = F.coalesce(_int(F.regexp_extract(zone, r"[+-]\d{2}:?(\d{2})", 1)), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes <= 59), sign * (hours * 60 + minutes))
    table = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
    return F.when(zone.rlike(r"[+-]"), numeric).otherwise(F.try_element_at(table, zone)).cast("long") * 60_000_000


def _parts(text: Column, kind: str, order: Column) -> Column:
    """The texts of year, month, day, clock, half of the day and zone by one pattern."""
    pattern, groups = PATTERNS[kind]
    part = {g: F.regexp_extract(text, pattern, i + 1) for i, g in enumerate(groups.split())}
    day, month = part.get("d"), part.get("m")
    if kind == "digits":
        day_first = (order == "dmy") | ((order == "ymd") & (part["x"] == "."))
        day = F.when(day_first, part["a"]).when(order == "mdy", part["b"])
        month = F.when(day_first, part["b"]).when(order == "mdy", part["a"])
    elif "n" in part:
        month = _month_number(part["n"]).cast("string")
    none = F.lit("")
    named = {"y": part["y"], "m": month, "d": day} | {g: part.get(g, none) for g in "HMSfhz"}
    return F.struct(*[c.alias(_FIELD[g]) for g, c in named.items()])


def with_instant(rows: DataFrame, value: str, tz: Column, order: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: microseconds since 1970 UTC of the text ``value``, null where it
    denotes no instant.  ``tz`` is an IANA zone for local times, ``order`` one of ymd, dmy,
    mdy for digit dates.

    The cascade only picks the parts; checking and arithmetic follow once, in a second
    projection, which keeps the generated code small."""
    bare = F.regexp_replace(F.col(value), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    step = rows.withColumns({"_bare": bare, "_zone": tz, "_ord": order})
    text = F.col("_bare")
    cascade = None
    for kind, (pattern, _) in PATTERNS.items():
        branch = (text.rlike(pattern), _parts(text, kind, F.col("_ord")))
        cascade = F.when(*branch) if cascade is None else cascade.when(*branch)
    # a generator of one row keeps the optimizer from copying the cascade into every field
    step = step.withColumn("_p", F.explode(F.array(cascade)))
    p = {g: F.col(f"_p.{name}") for g, name in _FIELD.items()}
    half = F.lower(p["h"])
    checked = F.struct(*[c.alias(name) for name, c in {
        "_y": _int(p["y"]), "_m": _int(p["m"]), "_d": _int(p["d"]), "_h0": F.coalesce(_int(p["H"]), F.lit(0)),
        "_mi": F.coalesce(_int(p["M"]), F.lit(0)), "_s": F.coalesce(_int(p["S"]), F.lit(0)), "_half": half,
        "_us": F.rpad(F.substring(p["f"], 1, 6), 6, "0").try_cast("long"), "_off": _offset_us(p["z"]), "_z": p["z"],
    }.items()])
    step = step.withColumn("_c", F.explode(F.array(checked))).select("*", "_c.*")
    y, m, d, h0, mi, s = (F.col(c) for c in ("_y", "_m", "_d", "_h0", "_mi", "_s"))
    good_hour = F.when(F.col("_half") == "", h0 <= 23).otherwise((h0 >= 1) & (h0 <= 12))
    hour = F.when(F.col("_half") == "p", h0 % 12 + 12).when(F.col("_half") == "a", h0 % 12).otherwise(h0)
    good = good_hour & (mi <= 59) & (s <= 59) & (y >= 1) & (m <= 12) & (d <= 31)
    date = F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")
    days = F.when(good, F.unix_date(date)).cast("long")
    local = days * 86_400_000_000 + (hour * 3600 + mi * 60 + s).cast("long") * 1_000_000 + F.col("_us")
    step = step.withColumn("_local", local)
    by_rules = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_zone")))
    placed = F.when(F.col("_z") == "", by_rules).otherwise(F.col("_local") - F.col("_off"))
    whole, rest = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"^\d{10}\.(\d{1,9})$", 1)
    epoch = F.when(
        text.rlike(r"^\d{10}\.\d{1,9}$"),
        whole.try_cast("long") * 1_000_000 + F.rpad(F.substring(rest, 1, 6), 6, "0").try_cast("long"),
    )
    for digits, (times, by) in EPOCHS.items():
        number = whole.try_cast("long")
        epoch = epoch.when(text.rlike(rf"^\d{{{digits}}}$"), F.floor(number / by).cast("long") if by > 1 else number * times)
    return step.withColumn(out, F.coalesce(epoch, placed)).select(*rows.columns, out)


def client_of(session: Column) -> Column:
    """The part of a session id before its first ``-``."""
    return F.substring_index(session, "-", 1)


def normalise_times(
    rows: DataFrame, clocks: DataFrame, fields: list[str], key: str = "id", session: str = "source_session_id"
) -> DataFrame:
    """(knowledge_id, field_name, utc_us) of every value of ``fields`` that is an instant.

    ``clocks`` is a writer table with one row per client, so it is broadcast behind a limit
    on its rows; a larger one is joined by key."""
    zones = clocks.select(
        F.col("client").alias("_client"), F.col("tz_name").alias("_tz"), F.col("date_order").alias("_order")
    ).dropDuplicates(["_client"])
    small = clocks.limit(10_001).count() <= 10_000
    slim = rows.select(F.col(key).alias("knowledge_id"), client_of(F.col(session)).alias("_client"), *fields)
    joined = slim.join(F.broadcast(zones) if small else zones, "_client", "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
    long = joined.withColumn("p", pairs).select("knowledge_id", "p.field_name", "p.value", "_tz", "_order")
    tz, order = F.coalesce("_tz", F.lit("UTC")), F.coalesce("_order", F.lit("ymd"))
    found = with_instant(long.filter(F.col("value").isNotNull()), "value", tz, order, "utc_us")
    return found.filter(F.col("utc_us").isNotNull()).select("knowledge_id", "field_name", "utc_us").distinct()
