"""Column expressions of the scoring domain. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from creaseline.schemas import INSTANT

TTL_DAYS = 90
INT_MASK = 4294967296


def event_sequence(inning="inning", over="over_no", ball="ball") -> Column:
    """``inning#over#ball``; the over has at least two digits, the ball is not padded."""
    return F.format_string("%d#%02d#%d", F.col(inning), F.col(over), F.col(ball))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def ttl(ts: Column) -> Column:
    return epoch_seconds(ts) + F.lit(TTL_DAYS * 86400)


def header(name: str, headers="headers") -> Column:
    """Last header of that name as text; null when absent, '' when its bytes are empty."""
    named = F.filter(F.col(headers), lambda h: h["key"] == F.lit(name))
    return F.try_element_at(named, F.lit(-1))["value"].cast("string")


def score_line(team: Column, runs: Column, wickets: Column, over: Column, ball: Column) -> Column:
    return F.format_string("%s %d/%d (%d.%d)", team, runs, wickets, over, ball)


def ratio_percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 where the denominator is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(F.lit(0.0))


def java_hash(text: Column) -> Column:
    """``String.hashCode``: h = 31*h + c over UTF-16 units in 32-bit arithmetic, as a long."""

    def unit(h: Column, c: Column) -> Column:
        return F.pmod(h * 31 + c, F.lit(INT_MASK))

    def step(h: Column, char: Column) -> Column:
        cp = F.ascii(char).cast("long")
        high = F.lit(0xD800) + F.floor((cp - 0x10000) / 1024)
        low = F.lit(0xDC00) + cp % 1024
        return F.when(cp < 0x10000, unit(h, cp)).otherwise(unit(unit(h, high), low))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    folded = F.aggregate(chars, F.lit(0).cast("long"), step)
    return F.when(folded >= INT_MASK // 2, folded - INT_MASK).otherwise(folded)


def java_abs(h: Column) -> Column:
    """32-bit absolute value: the smallest integer stays negative."""
    return F.when(h == -(INT_MASK // 2), h).otherwise(F.abs(h))


def string_shard(text: Column, n: int) -> Column:
    return (java_abs(java_hash(text)) % F.lit(n)).cast("int")


def md5_position(text: Column) -> Column:
    """First eight MD5 bytes as a signed 64-bit number."""
    high = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(F.md5(text), 9, 8), 16, 10).cast("long")
    signed_high = F.when(high >= INT_MASK // 2, high - INT_MASK).otherwise(high)
    return signed_high * F.lit(INT_MASK) + low


def salted_key(key: Column, spread: Column, salts: int = 10) -> Column:
    return F.concat(key, F.lit("#"), F.pmod(spread, F.lit(salts)).cast("string"))


EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def instant_text(ts: Column) -> Column:
    """ISO-8601 UTC text of an instant with the fewest of 0, 3 or 6 digits that are exact."""
    fraction = F.date_format(ts, "SSSSSS")
    digits = (
        F.when(fraction == "000000", "")
        .when(F.substring(fraction, 4, 3) == "000", F.concat(F.lit("."), F.substring(fraction, 1, 3)))
        .otherwise(F.concat(F.lit("."), fraction))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), digits, F.lit("Z"))


def instant(text: Column) -> Column:
    """The instant of such a text, to the microsecond; null for any other text."""
    return F.when(text.rlike(INSTANT), F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz"))
