"""Addresses and the ranges they lie in."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import with_value

#: Ranges that nothing outside may be asked for.
PRIVATE_V4 = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 192.0.0.0/24 100.64.0.0/10 198.18.0.0/15 224.0.0.0/3".split()
PRIVATE_V6 = "fe80::/10 fc00::/7 ff00::/8".split()
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _hex(number: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(number.cast("long")), digits, "0"))


def v4_digits(ip: Column) -> Column:
    """A dotted address as eight hexadecimal digits; null if it isn't one."""
    octets = lambda x: F.array_join(F.transform(F.split(x, r"\."), lambda o: _hex(o, 2)), "")
    return with_value(ip, lambda x: F.when(x.rlike(_V4), octets(x)))


def _groups(x: Column) -> Column:
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))


def _expanded(halves: Column) -> Column:
    """The digits of the groups before and after ::, or of all of them."""

    def joined(both: Column) -> Column:
        given = F.flatten(both)
        zeros = 8 - F.size(given)
        fits = F.when(F.size(halves) == 2, zeros >= 1).otherwise((F.size(halves) == 1) & (zeros == 0))
        every = F.concat(F.get(both, F.lit(0)), F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), F.coalesce(F.get(both, F.lit(1)), F.array().cast("array<string>")))
        good = fits & F.forall(given, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return with_value(F.transform(halves, _groups), joined)


def v6_digits(ip: Column) -> Column:
    """An address of up to eight groups, :: for zeros, perhaps with a dotted end, as 32 hexadecimal digits; null if it isn't one."""

    def plain(low: Column) -> Column:
        digits = v4_digits(F.regexp_extract(low, r"([^:]*)$", 1))
        dotted = with_value(digits, lambda e: F.concat(F.regexp_extract(low, r"^(.*:)[^:]*$", 1), F.substring(e, 1, 4), F.lit(":"), F.substring(e, 5, 4)))
        return F.when(low.contains(":"), F.when(low.contains("."), dotted).otherwise(low))

    return with_value(F.lower(ip), lambda low: with_value(F.split(plain(low), "::", -1), _expanded))


def in_ranges(digits: Column, ranges: list[str]) -> Column:
    """Whether an address of fixed digits lies in one of the ranges (sorted and merged where they touch)."""
    nets = sorted((ip_network(r) for r in ranges), key=lambda n: int(n.network_address))
    width = nets[0].max_prefixlen // 4
    merged: list[list[int]] = []
    for n in nets:
        a, b = int(n.network_address), int(n.broadcast_address)
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts, ends = ([f"{x[i]:0{width}x}" for x in merged] for i in (0, 1))
    # the last range that starts no later than the address
    at = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= digits))
    return with_value(at, lambda i: (i > 0) & (digits <= F.get(F.array(*map(F.lit, ends)), i - 1)))


def is_private(ip: Column) -> Column:
    """Whether an address is of one's own host or network, reserved or multicast; one of version 6 that holds one of version 4 (mapped or
    compatible) is judged by that. What is no address isn't private."""

    def six(digits: Column) -> Column:
        held = F.substring(digits, 1, 24).isin("0" * 24, "0" * 20 + "ffff")
        inner = with_value(F.substring(digits, 25, 8), lambda v: in_ranges(v, PRIVATE_V4))
        return F.when(held, inner).otherwise(in_ranges(digits, PRIVATE_V6))

    four = lambda v: F.when(v.isNotNull(), in_ranges(v, PRIVATE_V4))
    return with_value(ip, lambda x: F.coalesce(with_value(v4_digits(x), four), with_value(v6_digits(x), six), F.lit(False)))
