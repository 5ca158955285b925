"""Addresses, flows and places as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the Internet registries and of TCP.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PRIVATE_BLOCKS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
TCP_FLAGS = (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16))
EARTH_KM = 6371.0088


def is_ip(ip: Column) -> Column:
    return ip.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")


def ip_to_int(ip: Column) -> Column:
    """Dotted IPv4 as a number, null for anything else."""
    parts = F.split(ip, r"\.")
    total = F.lit(0).cast("long")
    for k in range(4):
        total = total * 256 + F.get(parts, F.lit(k)).cast("long")
    return F.when(is_ip(ip), total)


def int_to_ip(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)))


def in_block(ip: Column, block: str) -> Column:
    """Does the address lie in a CIDR block?"""
    base, bits = block.split("/")
    a, b, c, d = map(int, base.split("."))
    size = 1 << (32 - int(bits))
    low = (a << 24 | b << 16 | c << 8 | d) // size * size
    return ip_to_int(ip).between(low, low + size - 1)


def is_private(ip: Column) -> Column:
    found = F.lit(False)
    for block in PRIVATE_BLOCKS:
        found = found | in_block(ip, block)
    return found


def is_global(ip: Column) -> Column:
    return ~is_private(ip) & ~in_block(ip, "100.64.0.0/10")


def is_loopback(ip: Column) -> Column:
    return in_block(ip, "127.0.0.0/8")


def is_link_local(ip: Column) -> Column:
    return in_block(ip, "169.254.0.0/16")


def is_multicast(ip: Column) -> Column:
    return in_block(ip, "224.0.0.0/4")


def is_reserved(ip: Column) -> Column:
    return in_block(ip, "240.0.0.0/4")


def is_unspecified(ip: Column) -> Column:
    return ip == "0.0.0.0"


def netmask(bits: int = 16) -> Column:
    return F.lit(4294967295 ^ (4294967295 >> bits))


def hostmask(bits: int = 16) -> Column:
    return F.lit(4294967295 >> bits)


def network_of(ip: Column, bits: int) -> Column:
    """The network's address as dotted text."""
    return F.when(is_ip(ip), int_to_ip(ip_to_int(ip).bitwiseAND(netmask(bits))))


def tcp_flags(flags: Column) -> dict[str, Column]:
    return {name: flags.bitwiseAND(F.lit(bit)) != 0 for name, bit in TCP_FLAGS}


def great_circle_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance."""
    dy, dx = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.sin(dy) * F.sin(dy) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(dx) * F.sin(dx)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ip_to_hex(ip: Column) -> Column:
    """The bytes of an IPv4 or IPv6 address as 8 or 32 hexadecimal digits; null for anything else, zones among it."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")

    def plain(text: Column) -> Column:
        """A dotted end as two groups."""
        digits = F.lpad(F.lower(F.hex(ip_to_int(F.substring_index(text, ":", -1)))), 8, "0")
        whole = _let(digits, lambda d: F.concat(F.regexp_replace(text, "[^:]*$", ""), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
        return F.when(text.contains("."), whole).otherwise(text)

    def filled(parts: Column) -> Column:
        """Eight groups of four digits, from those before and after the gap."""
        gap, n = parts["gap"], F.size(parts["head"]) + F.size(parts["tail"])
        every = F.concat(parts["head"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), parts["tail"])
        fine = F.when(gap, n <= 7).otherwise(n == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fine, F.upper(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))

    def cut(text: Column) -> Column:
        gap = text.contains("::")
        head = groups(F.when(gap, F.substring_index(text, "::", 1)).otherwise(text))
        tail = groups(F.when(gap, F.substring_index(text, "::", -1)).otherwise(""))
        return F.when(~text.rlike("^:[^:]|[^:]:$|:::|::.*::"), _let(F.struct(gap.alias("gap"), head.alias("head"), tail.alias("tail")), filled))

    return F.when(ip.contains(":"), _let(plain(F.lower(ip)), cut)).otherwise(F.lpad(F.hex(ip_to_int(ip)), 8, "0"))


#: Protocols by name, those that have ports, and the kinds of messages that answer each other: fixed values of the public flow hash.
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17, "icmp6": 58, "icmpv6": 58, "ipv6-icmp": 58, "sctp": 132}
WITH_PORTS = (1, 6, 17, 58, 132)
ANSWERS = {1: ((8, 0), (13, 14), (10, 9), (15, 16), (17, 18)), 58: ((128, 129), (133, 134), (135, 136), (130, 131), (139, 140), (144, 145))}


def community_id(src: Column, dst: Column, protocol: Column, sport: Column | None = None, dport: Column | None = None, seed: int = 0) -> Column:
    """Flow hash, version 1: both directions of a flow get one id. Protocols are numbers or names; the ports of ICMP are type and code.

    Null if an address or the protocol isn't known, if one port is there without the other, or if a protocol that has ports lacks them.
    """
    none = F.lit(None).cast("int")
    named = F.lower(protocol.cast("string"))
    number = F.coalesce(named.try_cast("int"), F.try_element_at(F.create_map(*(F.lit(x) for pair in PROTOCOLS.items() for x in pair)), named))
    mapped = F.create_map(*(F.lit(x) for proto, pairs in ANSWERS.items() for pair in pairs for x, y in (pair, pair[::-1]) for x in (proto << 16 | x, y)))
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")

    def packed(f: Column) -> Column:
        """Seed, the lesser endpoint, the other, protocol, padding and the ports in the endpoints' order."""
        first, ports = F.concat(f["a"], f["b"]), F.concat(hexed(f["p"], 4), hexed(f["q"], 4))
        back, other = F.concat(f["b"], f["a"]), F.concat(hexed(f["q"], 4), hexed(f["p"], 4))
        swap = ~f["one_way"] & ((f["a"] > f["b"]) | ((f["a"] == f["b"]) & F.coalesce(f["p"] > f["q"], F.lit(False))))
        known = (f["p"].isNull() == f["q"].isNull()) & (f["p"].isNotNull() | ~f["number"].isin(*WITH_PORTS))
        middle = F.concat(hexed(f["number"], 2), F.lit("00"))
        both = F.when(swap, F.concat(back, middle, F.coalesce(other, F.lit("")))).otherwise(F.concat(first, middle, F.coalesce(ports, F.lit(""))))
        return F.when(known, F.concat(F.lit(f"{seed:04x}"), both))

    def flow(f: Column) -> Column:
        """With messages that answer each other as the ports of one exchange."""
        asks = f["number"].isin(*ANSWERS) & f["p"].isNotNull() & f["q"].isNotNull()
        answer = F.when(asks, F.try_element_at(mapped, F.shiftleft(f["number"], 16) + f["p"]))
        return F.struct(f["a"].alias("a"), f["b"].alias("b"), f["number"].alias("number"), f["p"].alias("p"), F.coalesce(answer, f["q"]).alias("q"), F.coalesce(f["number"].isin(*ANSWERS) & answer.isNull(), F.lit(False)).alias("one_way"))

    ports = [(c.cast("int") if c is not None else none).alias(n) for c, n in ((sport, "p"), (dport, "q"))]
    parts = F.struct(ip_to_hex(src).alias("a"), ip_to_hex(dst).alias("b"), number.alias("number"), *ports)
    return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(_let(_let(parts, flow), packed))))))
