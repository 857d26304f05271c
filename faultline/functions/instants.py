"""Written dates in many notations -> one instant (microseconds since 1970 UTC), JVM-side.

All notations are one regular expression. Its named groups are pulled out by a single
``regexp_replace`` whose replacement lists the groups, so a value is matched once; calendar ranges
are checked on integers and the instant is put together with integer day arithmetic. Only values
with a region zone (or none, where the default is a region) consult the zone rules, and a wall time
that a clock change skips or repeats stays undecided.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations with one meaning, and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "NST": -210, "NDT": -150,
}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MON = r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_CLOCK = r"(?<h{0}>\d{{1,2}})(?::(?<i{0}>\d{{2}})(?::(?<s{0}>\d{{2}})(?:[.,](?<f{0}>\d{{1,9}}))?)?)?"

PATTERN = (
    r"(?i)^\s*(?:(?:"
    # year-month-day, month/day/year, day.month.year, day month year, month day year; then the clock
    r"(?:(?<y1>\d{4})-(?<m1>\d{1,2})-(?<d1>\d{1,2})|(?<m2>\d{1,2})/(?<d2>\d{1,2})/(?<y2>\d{4})|(?<d3>\d{1,2})\.(?<m3>\d{1,2})\.(?<y3>\d{4})"
    rf"|{_DAY}(?<d4>\d{{1,2}})[\s-]+(?<b4>{_MON})\.?,?[\s-]+(?<y4>\d{{4}})|{_DAY}(?<b5>{_MON})\.?\s+(?<d5>\d{{1,2}}),?\s+(?<y5>\d{{4}}))"
    rf"(?:T|,?\s+(?:at\s+)?){_CLOCK.format(1)}(?:\s*(?<ap>[ap])\.?m\.?(?![a-z]))?"
    # weekday month day clock year
    rf"|{_DAY}(?<b6>{_MON})\.?\s+(?<d6>\d{{1,2}})\s+{_CLOCK.format(6)}\s+(?<y6>\d{{4}})"
    # compact yearmonthdayThourminutesecond
    r"|(?<y7>\d{4})(?<m7>\d{2})(?<d7>\d{2})T(?<h7>\d{2})(?:(?<i7>\d{2})(?:(?<s7>\d{2})(?:[.,](?<f7>\d{1,9}))?)?)?"
    r")\s*(?:(?:utc|gmt|z)?(?<zs>[+-])(?<zh>\d{2}):?(?<zm>\d{2})?|(?<zr>[a-z]+(?:[_-][a-z]+)*(?:/[a-z0-9+]+(?:[_-][a-z0-9]+)*)+)|(?<za>[a-z]{1,5}))?"
    # numbers: alone by size, or seconds before any second number
    r"|(?<es>-?)(?<en>\d{1,14})(?:\.(?<ef>\d{1,9}))?(?<e2>\s+[+-]?\d{1,6})?"
    r")\s*$"
)
_FIELDS = {
    "y": "${y1}${y2}${y3}${y4}${y5}${y6}${y7}", "m": "${m1}${m2}${m3}${m7}", "b": "${b4}${b5}${b6}", "d": "${d1}${d2}${d3}${d4}${d5}${d6}${d7}",
    "h": "${h1}${h6}${h7}", "i": "${i1}${i6}${i7}", "s": "${s1}${s6}${s7}", "f": "${f1}${f6}${f7}", "ap": "${ap}",
    "zs": "${zs}", "zh": "${zh}", "zm": "${zm}", "zr": "${zr}", "za": "${za}", "es": "${es}", "en": "${en}", "ef": "${ef}", "e2": "${e2}",
}
_SEP = "\x01"


def _zone_names() -> dict[str, str]:
    return {z.upper(): z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "Etc/"))}


def parts(text: Column) -> Column:
    """The named parts of a written date as an array of strings in the order of ``_FIELDS``; null if no notation fits."""
    flat = F.regexp_replace(text, PATTERN, _SEP + _SEP.join(_FIELDS.values()) + _SEP)
    return F.when(F.substring(flat, 1, 1) == _SEP, F.split(flat, _SEP))


def _offset(wall: Column, zone: Column) -> Column:
    """Microseconds east of UTC that ``zone`` keeps at the instant ``wall``."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(wall), zone)) - wall


def instant(text: Column, default_zone: Column) -> Column:
    """The one instant a written date names, as microseconds since 1970 UTC (bigint), or null.

    Null, empty and unreadable text, impossible dates and clock readings, dates without a clock,
    unknown or many-valued zone abbreviations, wall times skipped or repeated by a clock change, and
    numbers of more than 14 digits give null. ``default_zone`` holds where the text has no zone.

    The steps are chained as array transforms of one element: their lambda variables keep the plan
    small, where chained projections would be multiplied out by the optimizer.
    """
    step = lambda steps, f: F.transform(steps, f)
    at = {n: k + 1 for k, n in enumerate(_FIELDS)}
    # one literal each, folded to a constant map by the optimizer
    texts = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",")
    known = dict(sorted(_zone_names().items()))
    abbr = F.map_from_arrays(texts(ABBREVIATIONS), texts(ABBREVIATIONS.values()).cast("array<bigint>"))
    names = F.map_from_arrays(texts(known), texts(known.values()))
    fields = lambda r, *ns: [r.getField(n) for n in ns]

    def read(p: Column) -> Column:
        # groups hold digits or nothing, so a leading zero makes every cast safe
        num = lambda n: F.concat(F.lit("0"), p.getItem(at[n])).cast("int")
        micros = lambda n: F.rpad(F.substring(p.getItem(at[n]), 1, 6), 6, "0").cast("bigint")
        mon = p.getItem(at["b"])
        month = F.when(mon != "", ((F.instr(F.lit(_MONTHS), F.lower(F.substring(mon, 1, 3))) + 2) / 3).cast("int")).otherwise(num("m"))
        return F.struct(
            num("y").alias("y"), month.alias("m"), num("d").alias("d"), num("h").alias("h"), num("i").alias("i"), num("s").alias("s"), micros("f").alias("f"),
            F.lower(p.getItem(at["ap"])).alias("ap"), p.getItem(at["zs"]).alias("zs"), num("zh").alias("zh"), num("zm").alias("zm"),
            F.upper(p.getItem(at["zr"])).alias("zr"), F.upper(p.getItem(at["za"])).alias("za"),
            p.getItem(at["es"]).alias("es"), p.getItem(at["en"]).alias("en"), F.concat(F.lit("0"), p.getItem(at["en"])).cast("bigint").alias("count"), micros("ef").alias("ef"), p.getItem(at["e2"]).alias("e2"),
        )

    def place(r: Column) -> Column:
        y, m, d, h, ap = fields(r, "y", "m", "d", "h", "ap")
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        clock = F.when(ap == "", h <= 23).otherwise(h.between(1, 12))
        valid = (y >= 1) & m.between(1, 12) & d.between(1, longest) & (r.i < 60) & (r.s < 60) & (r.zh <= 18) & (r.zm < 60) & clock
        hour = F.when(ap == "", h).otherwise(h % 12 + F.when(ap == "p", 12).otherwise(0))
        shifted = y - F.when(m <= 2, 1).otherwise(0)
        whole = lambda a, b: F.floor(a / b)
        days = shifted * 365 + whole(shifted, 4) - whole(shifted, 100) + whole(shifted, 400) + whole(153 * (m + F.when(m > 2, -3).otherwise(9)) + 2, 5) + d - 719469
        wall = (days * 86400 + hour * 3600 + r.i * 60 + r.s) * 1000000 + r.f
        sign = F.when(r.es == "-", -1).otherwise(1)
        seconds = r["count"] < 100000000000
        number = F.when(seconds, sign * (r["count"] * 1000000 + r.ef)).when(r.e2 == "", sign * (r["count"] * 1000 + whole(r.ef, 1000)))
        offset = F.when(r.zs != "", F.when(r.zs == "-", -1).otherwise(1) * (r.zh * 60 + r.zm)).when(r.za != "", F.try_element_at(abbr, r.za))
        zone = F.when(r.zs != "", None).when(r.zr != "", F.try_element_at(names, r.zr)).when(r.za == "", default_zone)
        return F.struct(
            F.when((r.en == "") & valid, wall).alias("wall"), F.when(r.en != "", number).alias("number"),
            offset.cast("bigint").alias("offset"), zone.alias("zone"),
        )

    def guess(r: Column) -> Column:
        day = 93_600_000_000  # 26 hours: beyond any clock change near the wall time
        region = r.wall.isNotNull() & r.offset.isNull() & r.zone.isNotNull() & (r.zone != "UTC")
        before = F.when(region, r.wall - _offset(r.wall - day, r.zone))
        after = F.when(region, r.wall - _offset(r.wall + day, r.zone))
        return F.struct(r.wall.alias("wall"), r.number.alias("number"), r.offset.alias("offset"), r.zone.alias("zone"), before.alias("u1"), after.alias("u2"))

    def settle(r: Column) -> Column:
        hit = lambda u: u + _offset(u, r.zone) == r.wall
        region = F.when(r.u1 == r.u2, F.when(hit(r.u1), r.u1)).when(r.u1.isNotNull() & (hit(r.u1) != hit(r.u2)), F.when(hit(r.u1), r.u1).otherwise(r.u2))
        return F.when(r.number.isNotNull(), r.number).when(r.offset.isNotNull(), r.wall - r.offset * 60000000).when(r.zone == "UTC", r.wall).otherwise(region)

    return step(step(step(step(F.array(parts(text)), read), place), guess), settle).getItem(0)


def with_instants(df: DataFrame, text: str, out: str = "utc_us", default_zone: str = "UTC", default_zone_col: str | None = None) -> DataFrame:
    """Add ``out``: ``instant`` of the string column ``text``; every row and all other columns are kept.

    ``default_zone_col`` names a column with the zone used where the text has none, else
    ``default_zone`` is. An existing column ``out`` is replaced.
    """
    return df.withColumn(out, instant(F.col(text).cast("string"), F.col(default_zone_col) if default_zone_col else F.lit(default_zone)))
