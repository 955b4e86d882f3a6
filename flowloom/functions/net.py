"""Addresses, ports and protocol numbers as Column expressions (no UDF)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.parsing import number
from flowloom.schemas import IANA_PROTOCOL_NAMES, NAMED_PROTOCOL_NUMBERS

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4_BODY = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
V4_PATTERN = f"^{_V4_BODY}$"
PLAIN_PORT = "^(?:[0-9]{1,4}|[1-5][0-9]{4})$"


def _v6_pattern() -> str:
    """Regex for IPv6 text: 8 groups, or fewer around one ``::``.

    A dotted-quad tail counts as two groups; a ``%zone`` suffix is allowed.
    """
    group = "[0-9a-fA-F]{1,4}"
    forms = []
    for tail, width in ((group, 1), (_V4_BODY, 2)):
        forms.append(f"(?:{group}:){{{8 - width}}}{tail}")
        for before in range(8 - width):
            left = f"{group}(?::{group}){{{before - 1}}}" if before else ""
            forms.append(f"{left}::(?:{group}:){{0,{7 - width - before}}}{tail}")
    forms.append(f"(?:{group}(?::{group}){{0,6}})?::")
    return f"^(?:{'|'.join(forms)})(?:%[^%/]+)?$"


V6_PATTERN = _v6_pattern()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ipv4(ip: Column | str) -> Column:
    return F.coalesce(F.trim(_col(ip)).rlike(V4_PATTERN), F.lit(False))


def is_ipv6(ip: Column | str) -> Column:
    t = F.trim(_col(ip))
    return F.coalesce(t.contains(":") & t.rlike(V6_PATTERN), F.lit(False))


def is_valid_ip(ip: Column | str) -> Column:
    """True for a v4 or v6 address; NULL and leading-zero octets are invalid."""
    return is_ipv4(ip) | is_ipv6(ip)


def is_valid_port(port: Column | str) -> Column:
    """True for an integral number in 0..65535; plain digits below 60,000 need no number."""
    n = number(port)
    plain = _col(port).cast("string").rlike(PLAIN_PORT)
    return F.coalesce(plain | (n.between(0, 65535) & (n == F.floor(n))), F.lit(False))


def _v4_hex(text: Column) -> Column:
    octets = F.split(text, r"\.")
    return F.concat_ws("", F.transform(octets, lambda o: F.lpad(F.hex(o.try_cast("int")), 2, "0")))


def address_hex(ip: Column | str) -> Column:
    """Fixed-width upper-case hex of an address: 8 digits for v4, 32 for v6.

    Text of one width compares in address order, so CIDR tests are ``between``.
    """
    text = F.regexp_replace(F.trim(_col(ip)), "%.*$", "")
    quad = F.regexp_extract(text, rf"({_V4_BODY})$", 1)
    tail = _v4_hex(quad)
    unified = F.when(
        quad != "",
        F.concat(F.regexp_replace(text, rf"{_V4_BODY}$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)),
    ).otherwise(text)
    halves = F.split(unified, "::")

    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":"), lambda g: g != "")

    def padded(gs: Column) -> Column:
        return F.concat_ws("", F.transform(gs, lambda g: F.lpad(F.upper(g), 4, "0")))

    left = groups(halves[0])
    right = groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    gap = F.expr("'0000'")
    zeros = F.repeat(gap, F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
    v6 = F.concat(padded(left), zeros, padded(right))
    return F.when(is_ipv4(ip), _v4_hex(F.trim(_col(ip)))).when(is_ipv6(ip), v6)


def _bounds(cidr: str) -> tuple[str, str]:
    net = ipaddress.ip_network(cidr, strict=False)
    width = 8 if net.version == 4 else 32
    return f"{int(net[0]):0{width}X}", f"{int(net[-1]):0{width}X}"


def in_cidr(hex_address: Column, cidr: str) -> Column:
    low, high = _bounds(cidr)
    return (F.length(hex_address) == len(low)) & hex_address.between(low, high)


def in_any(hex_address: Column, cidrs: tuple[str, ...]) -> Column:
    """The ranges of a width are tested together, so an address skips those of the other."""
    test = F.lit(False)
    for width in (8, 32):
        held = [_bounds(c) for c in cidrs if len(_bounds(c)[0]) == width]
        inside = F.lit(False)
        for low, high in held:
            inside = inside | hex_address.between(low, high)
        test = test | ((F.length(hex_address) == width) & inside)
    return test


# --- fixed values: special address ranges (RFC 5735, RFC 4291) ---------------
MULTICAST = ("224.0.0.0/4", "ff00::/8")
UNSPECIFIED = ("0.0.0.0/32", "::/128")
LOOPBACK = ("127.0.0.0/8", "::1/128")
RESERVED = (
    "240.0.0.0/4",
    "::/8",
    "100::/8",
    "200::/7",
    "400::/6",
    "800::/5",
    "1000::/4",
    "4000::/3",
    "6000::/3",
    "8000::/3",
    "a000::/3",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fe00::/9",
)
BROADCAST = "255.255.255.255"
# --- end of fixed values -----------------------------------------------------


# Why a target is refused, in this engine's own words.
REASON_MALFORMED = "'%s' cannot be read as an IP address"
REASON_MULTICAST = "%s addresses a multicast group, no single host"
REASON_UNSPECIFIED = "%s stands for no host"
REASON_BROADCAST = "%s reaches every host of the network"
REASON_RESERVED = "%s lies in a range reserved by IANA"
REASON_LOOPBACK = "%s belongs to this host; pass allow_loopback to target it"
REASON_OUTSIDE = "%s is in none of the lab networks (%s)"
SCOPE_LOOPBACK = "loopback (allow_loopback)"


def parse_cidrs(text: str) -> list[str]:
    """Networks of a comma-separated list; malformed entries are skipped."""
    found = []
    for raw in text.split(","):
        try:
            found.append(str(ipaddress.ip_network(raw.strip(), strict=False)))
        except ValueError:
            continue
    return found


def target_scope(ip: Column | str, cidrs: str, allow_loopback: bool = False) -> Column:
    """``struct(scope, reason)`` of a response target: exactly one is non-NULL."""
    text = F.trim(F.coalesce(_col(ip), F.lit("")))
    # The one-element array binds text and address once for all range tests.
    bound = F.array(F.struct(text.alias("text"), address_hex(text).alias("address")))
    return F.transform(bound, lambda t: _classified(t["text"], t["address"], cidrs, allow_loopback))[0]


def _classified(text: Column, address: Column, cidrs: str, allow_loopback: bool) -> Column:
    """One chain of tests, so that none is made twice for an address."""

    def verdict(scope: Column, reason: Column) -> Column:
        return F.struct(scope.alias("scope"), reason.alias("reason"))

    def refused(template: str, *more: str) -> Column:
        return verdict(none, F.format_string(template, text, *[F.lit(m) for m in more]))

    none = F.lit(None).cast("string")
    tests = (
        F.when(address.isNull(), refused(REASON_MALFORMED))
        .when(in_any(address, MULTICAST), refused(REASON_MULTICAST))
        .when(in_any(address, UNSPECIFIED), refused(REASON_UNSPECIFIED))
        .when(text == BROADCAST, refused(REASON_BROADCAST))
        .when(in_any(address, RESERVED), refused(REASON_RESERVED))
        .when(in_any(address, LOOPBACK), verdict(F.lit(SCOPE_LOOPBACK), none) if allow_loopback else refused(REASON_LOOPBACK))
    )
    for cidr in parse_cidrs(cidrs):
        tests = tests.when(in_cidr(address, cidr), verdict(F.lit(cidr), none))
    return tests.otherwise(refused(REASON_OUTSIDE, cidrs))


def protocol_number(name: Column | str) -> Column:
    """IANA number of a protocol name; ``IP-PROTO-<n>`` gives n, others NULL."""
    c = _col(name)
    table = F.create_map(*[F.lit(x) for pair in NAMED_PROTOCOL_NUMBERS.items() for x in pair])
    encoded = F.regexp_extract(c, r"^IP-PROTO-(\d+)$", 1).try_cast("int")
    return F.coalesce(F.try_element_at(table, c), encoded)


def protocol_name(number_col: Column | str) -> Column:
    """Name of an IANA number; unknown numbers give ``IP-PROTO-<n>``."""
    c = _col(number_col)
    table = F.create_map(*[F.lit(x) for pair in IANA_PROTOCOL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c.cast("int")), F.concat(F.lit("IP-PROTO-"), c.cast("string")))
