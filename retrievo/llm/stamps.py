"""Operator 11: time stamps of mixed formats as UTC instants, by a wall-time interval table.

Stamps are parsed with built-in expressions to wall time, offset or epoch.  Slashed dates that can be
read in one order only vote for it in their source; where both orders give different dates, the order
with over ten times the other's votes is taken, else the day comes first.

The timeline of each zone that the table names is cut into intervals of wall time: ``normal`` ones,
``gap`` (skipped by clocks) and ``overlap`` (shown twice), each with the offsets before and after the
change.  They are joined by zone, year and range.  The table is broadcast: it holds zones of the time
zone database only, each with a few rows a year from 2000 to 2099, some 300,000 rows for all zones.

Votes are sums by source, combined before the shuffle.  Sources with over a thousandth of all
contested stamps are a thousand at most, so their orders are broadcast; the others, of which none is
large, are joined by shuffle.

Defined cases: null, empty or unreadable stamps are bad, as are those without an offset whose zone is
null or not in the time zone database; rows without a source are a source of their own; repeated rows
and rows that share a stamp_id, null included, each give a row and vote once each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize

# The forms of a stamp.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
WHITE = " \t\n\x0b\x0c\r"
DATE = rf"20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|20[0-9]{{6}}|[0-9]{{2}}\.[0-9]{{2}}\.20[0-9]{{2}}|[0-9]{{2}} (?:{'|'.join(MONTHS)}) 20[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/20[0-9]{{2}}"
TIME = r"(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AP]M)?(?: ?(?:Z|[+-][0-9]{2}:?[0-9]{2}))?)?"
#: Votes for an order count if they are more than so many times the other's.
LEAD = 10

YEARS = range(2000, 2100)
DAY = 86_400
#: Sources with more than one in so many contested stamps have their order broadcast.
LARGE = 1000


def timeline(zone: str) -> Iterator[tuple[int, int, str, int, int]]:
    """(from, to, kind, offset before, offset after) in seconds of wall time, over YEARS and a day around."""
    rules = zoneinfo.ZoneInfo(zone)

    def offset(t: int) -> int:
        return int(datetime.fromtimestamp(t, rules).utcoffset().total_seconds())

    at = int(datetime(YEARS[0], 1, 1, tzinfo=UTC).timestamp()) - 3 * DAY
    end = int(datetime(YEARS[-1] + 1, 1, 1, tzinfo=UTC).timestamp()) + 3 * DAY
    before = offset(at)
    since = at + before
    for t in range(at, end, DAY // 2):
        if offset(t + DAY // 2) == before:
            continue
        low, high = t, t + DAY // 2  # the change lies after low, at high the latest
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if offset(middle) == before else (low, middle)
        after = offset(high)
        first, last = high + min(before, after), high + max(before, after)
        yield since, first, "normal", before, before
        yield first, last, "gap" if after > before else "overlap", before, after
        since, before = last, after
    yield since, end + before, "normal", before, before


def wall_intervals(zones: DataFrame) -> DataFrame:
    """The timelines of ``zones(zone)``, cut at the turns of years: zone, year, low, high, wall, before, after."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = [int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in [*YEARS, YEARS[-1] + 1]]
        known = zoneinfo.available_timezones()
        if not known:
            raise RuntimeError("this machine has no time zone database")
        for pdf in batches:
            for zone in set(pdf["zone"]) & known:
                rows = [
                    (zone, year, max(low, start), min(high, end), wall, before, after)
                    for low, high, wall, before, after in timeline(zone)
                    for year, start, end in zip(YEARS, starts, starts[1:], strict=False)
                    if low < end and high > start
                ]
                yield pd.DataFrame(rows, columns=["zone", "year", "low", "high", "wall", "before", "after"])

    return zones.select("zone").mapInPandas(run, "zone string, year int, low long, high long, wall string, before int, after int")


def _number(text: Column, at: int | Column, length: int = 2) -> Column:
    return F.substring(text, at, length).try_cast("int")


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a date of this century; null if there is none."""
    longest = F.when(month == 2, F.when(year % 4 == 0, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    exists = month.between(1, 12) & day.between(1, longest)
    return F.when(exists, F.unix_date(F.make_date(year, month, day)))


def parsed(stamps: DataFrame, zones: DataFrame) -> DataFrame:
    """stamp_id, source, zone, raw and what they say: ``epoch`` (microseconds), or the date with the day first or only (``first``)
    and with the month first (``second``, slashed dates), seconds of the day and offset; ``form`` is bad, epoch, slashed or plain."""
    text, c = F.btrim("raw", F.lit(WHITE)), F.col
    rows = stamps.select("stamp_id", "source", "zone", "raw", text.alias("text"))
    rows = rows.withColumns({"whole": F.coalesce(c("text").rlike(rf"\A(?:{DATE}){TIME}\z"), F.lit(False)), "digits": F.coalesce(c("text").rlike(r"\A(?:[0-9]{10}|[0-9]{13})\z"), F.lit(False))})
    mark = F.substring("text", 3, 1)
    kind = F.when(mark == "/", "slashed").when(mark == ".", "dotted").when(mark == " ", "named").when(F.substring("text", 5, 1) == "-", "dashed").otherwise("compact")
    rows = rows.withColumn("kind", kind)
    length = F.when(c("kind") == "compact", 8).when(c("kind") == "named", 11).otherwise(10)
    rows = rows.withColumn("rest", c("text").substr(length + 1, F.length("text")))
    a, b, late = _number(c("text"), 1), _number(c("text"), 4), _number(c("text"), 7, 4)
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring("text", 4, 3)).cast("int")
    by_kind = lambda dashed, compact, name, other: F.when(c("kind") == "dashed", dashed).when(c("kind") == "compact", compact).when(c("kind") == "named", name).otherwise(other)
    rows = rows.withColumns({
        "year": by_kind(_number(c("text"), 1, 4), _number(c("text"), 1, 4), _number(c("text"), 8, 4), late),
        "month": by_kind(_number(c("text"), 6), _number(c("text"), 5), named, b),
        "day": by_kind(_number(c("text"), 9), _number(c("text"), 7), a, a),
        "seconded": F.substring("rest", 7, 1) == ":",
    })
    tail = F.ltrim(c("rest").substr(F.when(c("seconded"), 10).otherwise(7), F.length("rest")))
    rows = rows.withColumn("tail", tail).withColumn("half", F.when(F.substring("tail", 2, 1) == "M", F.substring("tail", 1, 1)))
    rows = rows.withColumn("shift", F.when(c("half").isNull(), c("tail")).otherwise(F.ltrim(c("tail").substr(F.lit(3), F.length("tail")))))
    hour, minute, second = _number(c("rest"), 2), _number(c("rest"), 5), F.when(c("seconded"), _number(c("rest"), 8)).otherwise(0)
    away, minutes = _number(c("shift"), 2), F.right("shift", F.lit(2)).try_cast("int")
    timely = F.when(c("half").isNull(), hour <= 23).otherwise(hour.between(1, 12)) & (minute <= 59) & (second <= 59)
    shifted = (c("shift") == "Z") | (c("shift") == "") | ((away <= 14) & (minutes <= 59))
    hour = F.when(c("half").isNull(), hour).otherwise(hour % 12 + F.when(c("half") == "P", 12).otherwise(0))
    seconds = F.when(c("rest") == "", 0).when(timely & shifted, hour * 3600 + minute * 60 + second)
    offset = F.when(c("shift") == "Z", 0).when(c("shift") != "", F.when(F.substring("shift", 1, 1) == "-", -1).otherwise(1) * (away * 3600 + minutes * 60))
    slashed = c("kind") == "slashed"
    rows = rows.withColumns({
        "seconds": F.when(c("whole"), seconds), "offset": F.when(c("whole"), offset),
        "first": F.when(c("whole"), _days(c("year"), c("month"), c("day"))),
        "second": F.when(c("whole") & slashed, _days(c("year"), c("day"), c("month"))),
        "epoch": F.when(c("digits"), F.when(F.length("text") == 10, c("text").try_cast("long") * 1_000_000).otherwise(c("text").try_cast("long") * 1000)),
    })
    rows = rows.join(F.broadcast(zones.select(c("zone").alias("known"))), c("zone") == c("known"), "left")
    read = c("seconds").isNotNull() & (c("first").isNotNull() | c("second").isNotNull()) & (c("offset").isNotNull() | c("known").isNotNull())
    form = F.when(c("epoch").isNotNull(), "epoch").when(~read, "bad").when(slashed, "slashed").otherwise("plain")
    # a null source is a source of its own
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    return rows.select("stamp_id", "source", "zone", "raw", key.alias("key"), "epoch", "first", "second", "seconds", "offset", form.alias("form"))


def normalise(stamps: DataFrame) -> DataFrame:
    """stamp_id, source, zone, raw, utc (timestamp), utc_us, rule, wall (normal, gap, overlap; null where no zone was asked) and ambiguous of every row."""
    c = F.col
    zones = stamps.filter("zone is not null").select("zone").distinct()
    intervals = materialize(wall_intervals(zones), "stamps-intervals")
    rows = materialize(parsed(stamps, intervals.select("zone").distinct()), "stamps-parsed")

    contested = (c("form") == "slashed") & (c("first") != c("second"))
    count = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("long"))
    votes = rows.filter("form = 'slashed'").groupBy("key").agg(
        count(c("second").isNull()).alias("days"), count(c("first").isNull()).alias("months"), count(contested).alias("contested"),
    )
    order = F.when(c("days") > LEAD * c("months"), "day").when(c("months") > LEAD * c("days"), "month")
    votes = materialize(votes.filter("contested > 0").select("key", order.alias("order"), "contested"), "stamps-votes")
    every = votes.agg(F.sum("contested")).first()[0] or 0
    large, small = (votes.filter(x).select("key", "order") for x in (c("contested") * LARGE > every, c("contested") * LARGE <= every))
    doubtful = rows.filter(contested)
    decided = doubtful.join(F.broadcast(large), "key").unionByName(doubtful.join(F.broadcast(large.select("key")), "key", "left_anti").join(small, "key"))
    settled = rows.filter(~F.coalesce(contested, F.lit(False))).withColumn("order", F.lit(None).cast("string"))
    rule = F.when(c("form").isin("bad", "epoch"), c("form")).when(~F.coalesce(contested, F.lit(False)), "plain").when(c("order").isNull(), "default").otherwise("votes")
    days = F.when(c("order") == "month", c("second")).otherwise(F.coalesce("first", "second"))
    rows = settled.unionByName(decided).withColumns({"rule": rule, "local": F.when(c("form").isin("slashed", "plain"), days.cast("long") * DAY + c("seconds"))})

    asks = c("local").isNotNull() & c("offset").isNull()
    rows = rows.withColumn("asked", F.when(asks, c("zone"))).withColumn("in", F.year(F.date_from_unix_date(F.floor(c("local") / DAY).cast("int"))))
    table = intervals.withColumnsRenamed({"zone": "table_zone"})
    rows = rows.join(F.broadcast(table), (c("asked") == c("table_zone")) & (c("in") == c("year")) & (c("local") >= c("low")) & (c("local") < c("high")), "left")
    utc_us = F.coalesce("epoch", (c("local") - F.coalesce("offset", "after")) * 1_000_000)
    odd = c("rule").isin("votes", "default") | F.coalesce(c("wall") != "normal", F.lit(False))
    return rows.select("stamp_id", "source", "zone", "raw", F.timestamp_micros(utc_us).alias("utc"), utc_us.alias("utc_us"), "rule", "wall", odd.alias("ambiguous"))


#: ``normalise`` by the offsets that the zone has a day before and after a wall time.
SQL = r"""
WITH t AS (
  SELECT stamp_id, source, zone, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM stamps),
m AS (
  SELECT stamp_id, source, CASE WHEN zone IN (SELECT name FROM pg_timezone_names()) THEN zone END AS zone, x,
         regexp_full_match(x, '[0-9]{10}|[0-9]{13}') AS epoch,
         regexp_extract(x, '^(?:(20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})\.([0-9]{2})\.(20[0-9]{2})|([0-9]{2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9]{2})|([0-9]{2})/([0-9]{2})/(20[0-9]{2}))(?:[T ].*)?$',
           ['y1', 'm1', 'd1', 'y2', 'm2', 'd2', 'd3', 'm3', 'y3', 'd4', 'm4', 'y4', 'a', 'b', 'y5']) AS d,
         regexp_extract(x, '^(?:20[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{2}[./][0-9]{2}[./]20[0-9]{2}|[0-9]{2} [A-Z][a-z]{2} 20[0-9]{2})(?:([T ])([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP])M)?(?: ?(?:(Z)|([+-])([0-9]{2}):?([0-9]{2})))?)?$',
           ['t', 'h', 'mi', 's', 'half', 'z', 'sign', 'oh', 'om']) AS c,
         regexp_full_match(x, '(?:20[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{2}[./][0-9]{2}[./]20[0-9]{2}|[0-9]{2} [A-Z][a-z]{2} 20[0-9]{2})(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AP]M)?(?: ?(?:Z|[+-][0-9]{2}:?[0-9]{2}))?)?') AS timed
  FROM t),
n AS (
  SELECT *, TRY_CAST(c.h AS INT) AS h, coalesce(TRY_CAST(c.s AS INT), 0) AS s, TRY_CAST(c.mi AS INT) AS mi, TRY_CAST(c.oh AS INT) AS oh, TRY_CAST(c.om AS INT) AS om, d.a <> '' AS slashed,
         coalesce(TRY_CAST(concat_ws('-', nullif(d.y1, ''), nullif(d.m1, ''), nullif(d.d1, '')) AS DATE), TRY_CAST(concat_ws('-', nullif(d.y2, ''), nullif(d.m2, ''), nullif(d.d2, '')) AS DATE),
                  TRY_CAST(concat_ws('-', nullif(d.y3, ''), nullif(d.m3, ''), nullif(d.d3, '')) AS DATE), CAST(try_strptime(concat_ws(' ', nullif(d.d4, ''), nullif(d.m4, ''), nullif(d.y4, '')), '%d %b %Y') AS DATE),
                  TRY_CAST(concat_ws('-', nullif(d.y5, ''), nullif(d.b, ''), nullif(d.a, '')) AS DATE)) AS first,
         TRY_CAST(concat_ws('-', nullif(d.y5, ''), nullif(d.a, ''), nullif(d.b, '')) AS DATE) AS second
  FROM m),
p AS (
  SELECT *, CASE WHEN c.z = 'Z' THEN 0 WHEN c.sign <> '' THEN (CASE WHEN c.sign = '-' THEN -1 ELSE 1 END) * (oh * 3600 + om * 60) END AS shift,
         CASE WHEN c.t = '' THEN 0 WHEN c.half = '' THEN h * 3600 + mi * 60 + s ELSE (h % 12 + CASE WHEN c.half = 'P' THEN 12 ELSE 0 END) * 3600 + mi * 60 + s END AS seconds,
         coalesce(timed AND (first IS NOT NULL OR second IS NOT NULL) AND (c.t = '' OR (mi <= 59 AND s <= 59 AND (CASE WHEN c.half = '' THEN h <= 23 ELSE h BETWEEN 1 AND 12 END) AND (c.sign = '' OR (oh <= 14 AND om <= 59))))
           AND (c.z = 'Z' OR c.sign <> '' OR zone IS NOT NULL), false) AS good
  FROM n),
v AS (
  SELECT source, count(*) FILTER (second IS NULL) AS days, count(*) FILTER (first IS NULL) AS months FROM p WHERE good AND slashed GROUP BY source),
r AS (
  SELECT p.*, CASE WHEN coalesce(epoch, false) THEN 'epoch' WHEN NOT good THEN 'bad' WHEN NOT slashed OR first IS NULL OR second IS NULL OR first = second THEN 'plain'
                   WHEN days > 10 * months OR months > 10 * days THEN 'votes' ELSE 'default' END AS rule,
         CASE WHEN slashed AND first IS NOT NULL AND second IS NOT NULL AND months > 10 * days THEN second ELSE coalesce(first, second) END AS date
  FROM p LEFT JOIN v ON p.source IS NOT DISTINCT FROM v.source),
l AS (
  SELECT *, CASE WHEN rule NOT IN ('bad', 'epoch') THEN CAST(date - DATE '1970-01-01' AS BIGINT) * 86400 + seconds END AS local FROM r),
o AS (
  SELECT *, CAST(epoch(timezone(zone, to_timestamp(local - 86400))) AS BIGINT) - (local - 86400) AS before, CAST(epoch(timezone(zone, to_timestamp(local + 86400))) AS BIGINT) - (local + 86400) AS after FROM l),
w AS (
  SELECT *, CASE WHEN shift IS NOT NULL OR local IS NULL OR before = after THEN NULL ELSE CAST(epoch(timezone(zone, to_timestamp(local - before))) AS BIGINT) - (local - before) = before END AS early,
         CASE WHEN shift IS NOT NULL OR local IS NULL OR before = after THEN NULL ELSE CAST(epoch(timezone(zone, to_timestamp(local - after))) AS BIGINT) - (local - after) = after END AS late
  FROM o)
SELECT stamp_id,
       CASE WHEN rule = 'epoch' THEN CASE WHEN length(x) = 10 THEN CAST(x AS BIGINT) * 1000000 ELSE CAST(x AS BIGINT) * 1000 END
            WHEN rule <> 'bad' THEN (local - coalesce(shift, CASE WHEN early AND NOT late THEN before ELSE after END)) * 1000000 END AS utc_us,
       rule, rule IN ('votes', 'default') OR coalesce(early = late, false) AS ambiguous
FROM w
"""
