"""Column functions on numbers, dates, maps and small JSON values."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, as the variable of a lambda function.

    A Python variable that holds a column is an expression, which Spark copies
    to each place where it stands.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("long")


def progress(current: Column, total: Column) -> Column:
    """Percent read, 100 at most; null without a total or with a negative place."""
    share = half_up(current.cast("double") / F.nullif(total, F.lit(0)) * 100)
    return F.when((total > 0) & (current >= 0), F.least(F.lit(100).cast("long"), share))


def position(index: Column, fraction: Column, n: Column) -> Column:
    """Percent of a flat place among ``n``, held between 0 and 100; 0 for none."""
    share = half_up((index + fraction) / F.nullif(n, F.lit(0)) * 100)
    # least() passes over nulls, so a missing n is caught first
    return F.when(n > 0, F.greatest(F.lit(0).cast("long"), F.least(F.lit(100).cast("long"), share))).otherwise(F.lit(0).cast("long"))


def cached_percent(cached: Column, total: Column) -> Column:
    """Percent of chapters in the cache; without a total, all or nothing."""
    share = F.least(F.lit(100).cast("long"), half_up(cached.cast("double") / F.nullif(total, F.lit(0)) * 100))
    return F.when(total > 0, share).when(cached > 0, F.lit(100).cast("long")).otherwise(F.lit(0).cast("long"))


def upload_progress(size: Column, percent: Column) -> Column:
    """An aggregate: percent of an import weighted by size, 99 at most; 0 for none."""
    share = half_up(F.sum(size * percent) / F.nullif(F.sum(size), F.lit(0)))
    return F.when(F.sum(size) > 0, F.least(F.lit(99).cast("long"), share)).otherwise(F.lit(0).cast("long"))


def bar_height(value: Column, most: Column) -> Column:
    """Height in percent of the largest bar: 0 without data, else 8 at least."""
    return F.when(value > 0, F.greatest(F.lit(8).cast("long"), half_up(value / most * 100))).otherwise(F.lit(0).cast("long"))


def duration(seconds: Column) -> Column:
    """``2h 5m``, ``5m`` or ``40s``."""
    s = seconds.cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    long = F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))
    return F.when(s >= 3600, long).when(s >= 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def file_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one digit behind the point."""
    unit = lambda n, name: F.concat(F.format_string("%.1f", size / F.lit(float(n))), F.lit(" " + name))
    return (
        F.when(size < 1 << 10, F.concat(size.cast("long").cast("string"), F.lit(" B")))
        .when(size < 1 << 20, unit(1 << 10, "KB"))
        .when(size < 1 << 30, unit(1 << 20, "MB"))
        .otherwise(unit(1 << 30, "GB"))
    )


def fresh(updated: Column, now: Column | int, ttl: int = 300_000) -> Column:
    """Whether an entry of a cache still holds; the last millisecond counts."""
    return F.lit(now) - updated <= F.lit(ttl)


def valid_username(c: Column) -> Column:
    """Five bytes at least, letters and digits, and not the name of the common namespace."""
    return (F.octet_length(c) >= 5) & c.rlike("^[A-Za-z0-9]+$") & (c != "default")


def stepped(c: Column, low: float, high: float, step: float, default: float) -> Column:
    """A setting between bounds, rounded to its step; anything else is the default."""
    x = c.try_cast("double")
    return F.when(x.between(low, high), F.floor(x / step + F.lit(0.5)) * F.lit(float(step))).otherwise(F.lit(float(default)))


def config(c: Column) -> Column:
    """A JSON object as a map, empty where it is missing or broken."""
    return F.coalesce(F.from_json(c, _MAP), F.create_map().cast(_MAP))


def merged(local: Column, server: Column) -> Column:
    """Both maps; the server's value wins."""
    return F.map_concat(F.map_filter(local, lambda k, _: ~F.map_contains_key(server, k)), server)


def valid_days(days: Column) -> Column:
    """The entries of a day map whose key is a date and whose value is finite and positive."""
    finite = lambda v: ~F.isnan(v) & (v < float("inf"))
    return F.map_filter(days, lambda k, v: k.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(finite(v) & (v > 0), F.lit(False)))


def recent_days(days: Column, today: Column, keep: int = 31) -> Column:
    """The entries of a day map that are at most ``keep`` days old."""
    oldest = F.date_format(F.date_sub(today, keep), "yyyy-MM-dd")
    return F.map_filter(days, lambda k, _: k >= oldest)


def tokens(c: Column) -> Column:
    """A token map in any of its spellings, an array, an object's keys or a comma list, as an array."""
    text = F.trim(F.coalesce(c, F.lit("")))
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.when(text.startswith("["), listed).when(text.startswith("{"), F.map_keys(config(text))).otherwise(parts)


def with_token(known: Column, token: Column, most: int = 5) -> Column:
    """The last ``most`` distinct tokens, the newest one last."""
    rest = F.filter(F.array_distinct(known), lambda x: (x != token) & (x != ""))
    return F.reverse(F.slice(F.reverse(F.concat(rest, F.array(token))), 1, most))


def token_valid(given: Column, primary: Column, others: Column, last_login: Column, now: int, days: int) -> Column:
    """Whether a token is the primary or one of the others, and the login isn't older than ``days``."""
    return ((given == primary) | F.array_contains(others, given)) & (F.lit(now) - last_login <= F.lit(days * 86_400_000))


def luminance(colour: Column) -> Column:
    """Relative luminance of ``#rrggbb``, from 0 to 1; null for anything else."""

    def channel(start: int) -> Column:
        v = F.conv(F.substring(colour, start, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return F.when(colour.rlike("^#[0-9a-fA-F]{6}$"), 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6))


def rgb(colour: Column) -> Column:
    """``array(red, green, blue)`` of ``#rgb`` or ``#rrggbb``; null for anything else."""
    c = F.lower(F.trim(colour))
    long = F.when(F.length(c) == 4, F.regexp_replace(c, "([0-9a-f])", "$1$1")).otherwise(c)
    return F.when(c.rlike("^#([0-9a-f]{3}|[0-9a-f]{6})$"), F.array(*(F.conv(F.substring(long, k, 2), 16, 10).cast("int") for k in (2, 4, 6))))


def mixed(a: Column, b: Column, ratio: float) -> Column:
    """Two colours mixed, the first for 0 and the second for 1; the first as it is where one is no colour."""
    channel = lambda x, y: F.least(F.lit(255).cast("long"), F.greatest(F.lit(0).cast("long"), half_up(x + (y - x) * F.lit(ratio))))
    digits = lambda both: F.array_join(F.transform(both, lambda v: F.lower(F.lpad(F.hex(v), 2, "0"))), "")
    return F.coalesce(F.concat(F.lit("#"), digits(F.zip_with(rgb(a), rgb(b), channel))), a)


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def start_of_week(ts: Column) -> Column:
    """Midnight of the week's Monday."""
    return F.date_trunc("week", ts)


def string_config(c: Column) -> Column:
    """The entries of a JSON object whose value is a string; empty for anything else."""
    entries = F.from_json(c, "map<string,variant>")
    strings = F.map_filter(entries, lambda _, v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return F.coalesce(F.transform_values(strings, lambda _, v: F.try_variant_get(v, "$", "string")), F.create_map().cast(_MAP))


def new_id() -> Column:
    """A random UUID (version 4); differs at every evaluation."""
    return F.uuid()


def new_token() -> Column:
    """32 random hex digits, for tokens and salts."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


#: Networks that aren't public.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/32")
PRIVATE_6 = ("::1/128", "::/128", "fc00::/7", "fe80::/10", "ff00::/8")

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = rf"{_OCTET}(\.{_OCTET}){{3}}"


def _expanded(c: Column) -> Column:
    """The 32 digits of an IPv6 address without dotted parts, null for anything else."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    padded = lambda x: F.array_join(F.transform(x, lambda g: F.lpad(g, 4, "0")), "")
    plain = c.rlike("^[0-9a-f:]*$") & c.contains(":") & ~c.rlike(":::|::.*::|^:[^:]|[^:]:$|[^:]{5}")

    def joined(head: Column, rest: Column, short: Column) -> Column:
        n = F.size(head) + F.size(rest)
        hole = F.repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - n))
        return F.when(F.when(short, n < 8).otherwise(n == 8), F.concat(padded(head), hole, padded(rest)))

    def halves(h: Column) -> Column:
        rest = groups(F.coalesce(F.get(h, 1), F.lit("")))
        return bound(groups(F.get(h, 0)), lambda a: bound(rest, lambda b: joined(a, b, F.size(h) > 1)))

    return F.when(plain, bound(F.split(c, "::", -1), halves))


def address_key(c: Column) -> Column:
    """An address of either kind as 32 hex digits, null for anything else.

    An IPv4 address has the key of its form in IPv6, ``::ffff:a.b.c.d``; a dotted
    end of an IPv6 address stands for its last two groups. Keys sort as addresses do.
    """
    octets = lambda q: F.transform(F.split(q, r"\."), lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0")))
    tail = lambda o: F.concat(F.get(o, 0), F.get(o, 1), F.lit(":"), F.get(o, 2), F.get(o, 3))
    dotted = lambda x: F.regexp_extract(x, rf":({_QUAD})$", 1)
    undotted = lambda x, q: F.when(q == "", x).otherwise(F.concat(F.left(x, F.length(x) - F.length(q)), bound(octets(q), tail)))
    six = lambda x: bound(bound(dotted(x), lambda q: undotted(x, q)), _expanded)
    four = F.concat(F.lit("0" * 20 + "ffff"), F.array_join(octets(c), ""))
    return F.when(c.rlike(rf"^{_QUAD}$"), four).otherwise(bound(F.lower(c), six))


def ipv6(c: Column) -> Column:
    """An IPv6 address as 32 hex digits, null for anything else."""
    return F.when(c.contains(":"), address_key(c))


def network_bounds(networks: Iterable[str]) -> list[str]:
    """The keys at which addresses begin and cease to be in one of the networks, ``address/n`` or one address each, in turn."""
    spans = []
    for text in networks:
        net = ipaddress.ip_network(text, strict=False)
        shift = 0xFFFF << 32 if net.version == 4 else 0
        spans.append((int(net.network_address) + shift, int(net.broadcast_address) + shift + 1))
    out: list[int] = []
    for low, high in sorted(spans):
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high)
        else:
            out += [low, high]
    return [f"{x:032x}" for x in out if x < 1 << 128]


def in_networks(c: Column, networks: Iterable[str]) -> Column:
    """Whether an address lies in one of some networks: parsed once, then a binary search in their sorted bounds."""
    bounds = network_bounds(networks)

    def search(key: Column, low: int, high: int) -> Column:
        """Behind an odd number of bounds a key is inside."""
        if low == high:
            return F.lit(low % 2 == 1)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], search(key, low, middle)).otherwise(search(key, middle + 1, high))

    return bound(address_key(c), lambda key: F.when(key.isNotNull(), search(key, 0, len(bounds))).otherwise(False))


def in_network(c: Column, network: str) -> Column:
    """Whether an address lies in a network of its kind, written as ``address/n``."""
    return in_networks(c, [network])


in_network6 = in_network


def is_private(c: Column) -> Column:
    """Whether an address of either kind is of a loopback, private, link-local, multicast or unspecified network.

    An IPv4 address written as IPv6 counts as IPv4.
    """
    return in_networks(c, (*PRIVATE, *PRIVATE_6))
