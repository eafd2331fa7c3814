"""Operator 11 against plain Python and SQL."""

import calendar
import random
import re
import zoneinfo
from collections import Counter
from datetime import UTC, datetime, timedelta

import duckdb
import pytest

from retrievo.llm import stamps
from tests.conftest import SF

SCHEMA = "stamp_id long, source string, zone string, raw string, year int, wall string, `first` int, key string"
ZONES = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca", "America/St_Johns", "Pacific/Apia"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 2, "k") for r in rows], SCHEMA)


def dates(raw):
    """(epoch microseconds | None, [dates day first, month first], seconds, offset | None) or None for what can't be read."""
    if raw is None:
        return None
    x = raw.strip(" \t\n\x0b\x0c\r")
    if re.fullmatch(r"[0-9]{10}", x):
        return int(x) * 10**6
    if re.fullmatch(r"[0-9]{13}", x):
        return int(x) * 1000
    m = re.fullmatch(
        r"(?:(20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})\.([0-9]{2})\.(20[0-9]{2})|([0-9]{2}) ([JFMASOND][a-z]{2}) (20[0-9]{2})|([0-9]{2})/([0-9]{2})/(20[0-9]{2}))"
        r"(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP])M)?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?", x)
    if not m:
        return None
    g = m.groups()
    tries = []
    for y, mo, d in ((g[0], g[1], g[2]), (g[3], g[4], g[5]), (g[8], g[7], g[6]), (g[11], g[10], g[9]), (g[14], g[13], g[12]), (g[14], g[12], g[13])):
        if y is None:
            continue
        if not mo.isdigit():
            if mo not in list(calendar.month_abbr):
                return None
            mo = list(calendar.month_abbr).index(mo)
        try:
            tries.append(datetime(int(y), int(mo), int(d)))
        except ValueError:
            tries.append(None)
    hour, minute, second, half, zone = int(g[15] or 0), int(g[16] or 0), int(g[17] or 0), g[18], g[19]
    if minute > 59 or second > 59 or (half and not 1 <= hour <= 12) or hour > 23 or not any(tries):
        return None
    if half:
        hour = hour % 12 + (12 if half == "P" else 0)
    offset = None
    if zone == "Z":
        offset = 0
    elif zone:
        oh, om = int(zone[1:3]), int(zone[-2:])
        if oh > 14 or om > 59:
            return None
        offset = (oh * 3600 + om * 60) * (-1 if zone[0] == "-" else 1)
    return tries, hour * 3600 + minute * 60 + second, offset


def brute(rows):
    votes, out = Counter(), []
    known = zoneinfo.available_timezones()
    read = []
    for _, source, zone, raw in rows:
        x = dates(raw)
        if isinstance(x, tuple) and x[2] is None and zone not in known:
            x = None
        read.append(x)
        if isinstance(x, tuple) and len(x[0]) == 2 and None in x[0]:
            votes[source, 0 if x[0][0] else 1] += 1
    for (key, source, zone, _), x in zip(rows, read, strict=True):
        if not isinstance(x, tuple):
            out.append((key, x, "bad" if x is None else "epoch", False))
            continue
        tries, seconds, offset = x
        rule, date = "plain", next(t for t in tries if t)
        if len(tries) == 2 and all(tries) and tries[0] != tries[1]:
            a, b = votes[source, 0], votes[source, 1]
            rule = "votes" if a > 10 * b or b > 10 * a else "default"
            date = tries[1] if b > 10 * a else tries[0]
        local, odd = date + timedelta(seconds=seconds), rule != "plain"
        if offset is None:
            z = zoneinfo.ZoneInfo(zone)
            # instants whose clock shows this wall time, by every offset near it
            near = sorted({(local.replace(tzinfo=UTC) + timedelta(hours=h)).astimezone(z).utcoffset() for h in range(-40, 41, 1)})
            shown = [o for o in near if (local.replace(tzinfo=UTC) - o).astimezone(z).replace(tzinfo=None) == local]
            if len(shown) == 1:
                offset = shown[0].total_seconds()
            else:
                odd = True
                offset = (local.replace(tzinfo=UTC) + timedelta(hours=30)).astimezone(z).utcoffset().total_seconds()
        out.append((key, round((local.replace(tzinfo=UTC).timestamp() - offset) * 10**6), rule, odd))
    return out


def random_rows(n, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = datetime(r.choice([2000, 2007, 2011, 2024, 2024, 2040, 2099]), 1, 1) + timedelta(seconds=r.randrange(366 * 86400))
        if r.random() < 0.4:  # around changes of the clocks
            t = datetime(2024, *r.choice([(3, 10, 2), (11, 3, 1), (3, 31, 2), (10, 27, 2), (4, 7, 1), (10, 6, 2)])) + timedelta(seconds=r.randrange(-3600, 7200))
        form = r.choice(["%Y-%m-%d", "%Y%m%d", "%d.%m.%Y", "%d %b %Y", "%d/%m/%Y", "%m/%d/%Y", "%m/%d/%Y"])
        time = r.choice(["", "T%H:%M:%S", " %H:%M", " %I:%M %p", " %I:%M:%S%p", "T%H:%M:%SZ", " %H:%M +0530", "T%H:%M-08:00", " %H:%M:%S Z", "T24:00", " 12:60", " 13:00 PM", "T10:00+15:00", " 00:30 AM", "T1:00", "Z", " %H:%M +14:59"])
        raw = t.strftime(form + time)
        raw = r.choice([raw] * 12 + [f" \t{raw}\n", raw.lower(), "", None, "1715224703266", "1711983087", "171198308", f"{raw}x", "31/02/2024", "29.02.2023", "20240230", "1999-01-01", "٢٠٢٤-01-01", "2024-01-01 ", "2024-1-1"])
        rows.append((i % (n - 3), r.choice(["a", "b", "c", None]) if "/" in form else "d", r.choice([*ZONES, *ZONES, None, "Nowhere/Here", ""]), raw))
    # sources that lead by exactly ten times, and by more
    rows += [(n + i, "ten", "UTC", "13/01/2024") for i in range(10)] + [(n + 20, "ten", "UTC", "01/13/2024"), (n + 21, "ten", "UTC", "01/02/2024")]
    rows += [(n + 30 + i, "more", "UTC", "01/13/2024") for i in range(11)] + [(n + 50, "more", "UTC", "13/01/2024"), (n + 51, "more", "UTC", "01/02/2024"), (n + 52, "more", "UTC", "02/02/2024"), (None, "more", "UTC", "03/02/2024")]
    return rows


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_against_plain_python(spark):
    rows = random_rows(3000)
    got = stamps.normalise(frame(spark, rows)).select("stamp_id", "utc_us", "rule", "ambiguous").collect()
    assert ordered(tuple(r) for r in got) == ordered(brute(rows))
    assert {r.rule for r in got} == {"bad", "epoch", "votes", "default", "plain"}


def test_small_sources_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(stamps, "LARGE", 2)
    rows = random_rows(400, seed=6)
    got = stamps.normalise(frame(spark, rows)).select("stamp_id", "utc_us", "rule", "ambiguous").collect()
    assert ordered(tuple(r) for r in got) == ordered(brute(rows))


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_against_sql(spark, folder):
    got = stamps.normalise(spark.read.parquet(f"{folder}/stamps.parquet")).select("stamp_id", "utc_us", "rule", "ambiguous").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW stamps AS SELECT * FROM '{folder}/stamps.parquet'")
    assert ordered(tuple(r) for r in got) == ordered(con.execute(stamps.SQL).fetchall())


def test_sql_of_fuzzed_rows(spark):
    # the SQL engine's own time zone tables end early and have other rules for Morocco
    rows = [r for r in random_rows(1500, seed=9) if r[2] != "Africa/Casablanca" and not re.search("20[4-9][0-9]", r[3] or "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE stamps (stamp_id BIGINT, source VARCHAR, zone VARCHAR, raw VARCHAR)")
    con.executemany("INSERT INTO stamps VALUES (?, ?, ?, ?)", rows)
    assert ordered(con.execute(stamps.SQL).fetchall()) == ordered(brute(rows))


def test_intervals_tile_the_timeline():
    for zone in ZONES:
        found = list(stamps.timeline(zone))
        assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
        assert all(a[0] < a[1] and (a[2] == "normal") == (a[3] == a[4]) for a in found)


def test_empty_and_very_long(spark):
    assert stamps.normalise(frame(spark, [])).collect() == []
    rows = [(1, None, None, "1" * 1_000_000), (2, "s", "UTC", " " * 100_000 + "2024-02-29"), (2, "s", "UTC", " " * 100_000 + "2024-02-29"), (None, None, None, None)]
    got = stamps.normalise(frame(spark, rows)).select("stamp_id", "utc_us", "rule", "ambiguous").collect()
    assert ordered(tuple(r) for r in got) == ordered(brute(rows))
