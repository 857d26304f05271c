"""The SQL twin of p1_found for DuckDB: one notation after the other, zones by its own zone functions."""

# Hours east of UTC and the abbreviations that mean them, kept apart from the library's own list.
_HOURS = [
    (-10, "HST"),
    (-9, "AKST"),
    (-8, "AKDT PST"),
    (-7, "MST PDT"),
    (-6, "CST MDT"),
    (-5, "CDT EST"),
    (-4, "EDT"),
    (-3.5, "NST"),
    (-2.5, "NDT"),
    (0, "GMT UT UTC WET Z"),
    (1, "CET WEST"),
    (2, "CEST EET"),
    (3, "EEST MSK"),
    (8, "AWST"),
    (9, "JST KST"),
    (9.5, "ACST"),
    (10, "AEST"),
    (10.5, "ACDT"),
    (11, "AEDT"),
    (12, "NZST"),
    (13, "NZDT"),
]
_ABBR = "MAP {" + ", ".join(f"'{k}': {int(h * 60)}" for h, ks in _HOURS for k in ks.split()) + "}"
P1_FOUND = rf"""
WITH v AS (
  SELECT 'logs' AS tab_name, locid AS rec_id, 'date' AS field_name, date AS s, 'UTC' AS dz FROM logs
  UNION ALL SELECT 'validbugs', bug, 'reportDateText', reportDateText, 'America/Los_Angeles' FROM validbugs
  UNION ALL SELECT 'validbugs', bug, 'modDateText', modDateText, 'America/Los_Angeles' FROM validbugs),
t AS (SELECT DISTINCT tab_name, rec_id, field_name, upper(trim(s)) AS s, dz FROM v WHERE trim(s) <> ''),
n AS (SELECT *, regexp_extract(s, '^(\d+)(\.\d+)?( [+-]?\d+)?$', ['n', 'f', 'two']) AS num,
  regexp_extract(s, '^(\d{{4}}-\d\d-\d\d)[T ](\d\d:\d\d)(:\d\d)?(\.\d+)? *(.*)$', ['d', 'hm', 'sec', 'f', 'z']) AS iso,
  regexp_extract(s, '^(\d{{4}})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)Z$', ['y', 'm', 'd', 'h', 'i', 's']) AS c,
  regexp_extract(s, '^(\d+/\d+/\d+ \d+:\d+ [AP]M) *(.*)$', ['t', 'z']) AS us, regexp_extract(s, '^(\d+\.\d+\.\d+ \d+:\d+) *(.*)$', ['t', 'z']) AS de,
  regexp_extract(s, '^[A-Z]{{3}}, (\d+ [A-Z]{{3}} \d+ \d+:\d+:\d+) *(.*)$', ['t', 'z']) AS rfc, regexp_extract(s, '^[A-Z]{{3}} ([A-Z]{{3}} \d+ \d+:\d+:\d+ \d{{4}}) *(.*)$', ['t', 'z']) AS ct,
  regexp_extract(s, '^([A-Z]{{3}} \d+, \d{{4}} \d+:\d+ [AP]M) *(.*)$', ['t', 'z']) AS na FROM t),
w AS (SELECT *, CASE WHEN iso.d <> '' THEN try_cast(iso.d || ' ' || iso.hm || coalesce(nullif(iso.sec, ''), ':00') || iso.f AS TIMESTAMP) WHEN c.y <> '' THEN try_cast(c.y || '-' || c.m || '-' || c.d || ' ' || c.h || ':' || c.i || ':' || c.s AS TIMESTAMP)
  WHEN us.t <> '' THEN try_strptime(us.t, '%m/%d/%Y %I:%M %p') WHEN de.t <> '' THEN try_strptime(de.t, '%d.%m.%Y %H:%M') WHEN rfc.t <> '' THEN try_strptime(rfc.t, '%d %b %Y %H:%M:%S') WHEN ct.t <> '' THEN try_strptime(ct.t, '%b %d %H:%M:%S %Y')
  WHEN na.t <> '' THEN try_strptime(na.t, '%b %d, %Y %I:%M %p') END AS wall,
  CASE WHEN c.y <> '' THEN 'Z' ELSE iso.z || us.z || de.z || rfc.z || ct.z || na.z END AS z FROM n),
o AS (SELECT *, regexp_extract(z, '^(?:UTC|GMT)?([+-])(\d\d):?(\d\d)$', ['sg', 'h', 'm']) AS off, {_ABBR}[z] AS ab FROM w),
r AS (SELECT o.*, CASE WHEN z = '' THEN dz ELSE q.name END AS region FROM o LEFT JOIN (SELECT upper(name) AS up, min(name) AS name FROM pg_timezone_names() WHERE contains(name, '/') GROUP BY 1) q ON q.up = o.z),
u AS (SELECT *, CASE WHEN num.n <> '' THEN CASE WHEN num.two <> '' OR length(num.n) <= 11 THEN try_cast(num.n AS BIGINT) * 1000000 + coalesce(try_cast(rpad(nullif(substr(num.f, 2, 6), ''), 6, '0') AS BIGINT), 0) WHEN length(num.n) <= 14 THEN try_cast(num.n AS BIGINT) * 1000 END
  WHEN off.sg <> '' THEN epoch_us(wall) - (CASE off.sg WHEN '-' THEN -1 ELSE 1 END) * (try_cast(off.h AS BIGINT) * 60 + try_cast(off.m AS BIGINT)) * 60000000 WHEN ab IS NOT NULL THEN epoch_us(wall) - ab::BIGINT * 60000000
  WHEN region = 'UTC' THEN epoch_us(wall) WHEN region IS NOT NULL AND timezone(region, timezone(region, wall)) = wall AND timezone(region, timezone(region, wall) + INTERVAL 1 HOUR) <> wall AND timezone(region, timezone(region, wall) - INTERVAL 1 HOUR) <> wall
  THEN epoch_us(timezone(region, wall)) END AS utc_us FROM r)
SELECT DISTINCT tab_name, rec_id, field_name, utc_us FROM u WHERE utc_us IS NOT NULL"""
