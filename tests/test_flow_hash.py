"""Addresses as bytes, and flow hashes over both families."""

import base64
import hashlib
import ipaddress
import itertools

import pytest
from pyspark.sql import functions as F

from lodestream.functions import network

ADDRESSES = ["1.2.3.4", "10.0.0.1", "::", "::1", "fe80::1", "2001:DB8:0:0:1::2", "1:2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7::"]
BROKEN = ["", "1.2.3", "1:2:3", ":1::", "1:::2", "1::2::3", "12345::", "g::", "fe80::1%eth0", "1:2:3:4:5:6:7:8:9", "::1.2.3", "1:2:3:4:5:6:7:8::", None, "1:"]


def test_addresses(spark):
    df = spark.createDataFrame([(x,) for x in ADDRESSES + BROKEN], "ip string")
    got = {r.ip: r.h for r in df.select("ip", network.ip_to_hex(F.col("ip")).alias("h")).collect()}
    assert got == {x: ipaddress.ip_address(x).packed.hex().upper() for x in ADDRESSES} | dict.fromkeys(BROKEN)


def written_out(a, b, proto, p, q, seed):
    """The hash from bytes, by the public description."""
    one_way = False
    if proto in network.ANSWERS and p is not None:
        pairs = dict(network.ANSWERS[proto]) | {y: x for x, y in network.ANSWERS[proto]}
        one_way, q = p not in pairs, pairs.get(p, q)
    x, y = (ipaddress.ip_address(i).packed for i in (a, b))
    if not (one_way or x < y or (x == y and (p is None or p < q))):
        x, y, p, q = y, x, q, p
    data = seed.to_bytes(2, "big") + x + y + bytes([proto, 0]) + (b"" if p is None else p.to_bytes(2, "big") + q.to_bytes(2, "big"))
    return "1:" + base64.b64encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


@pytest.mark.parametrize("seed", [0, 7])
def test_hash_against_bytes(spark, seed):
    flows = [(a, b, proto, p, q) for a, b in (("10.0.0.1", "10.0.0.2"), ("10.0.0.2", "10.0.0.1"), ("fe80::1", "fe80::2"), ("fe80::2", "fe80::1"), ("fe80::1", "fe80::1"), ("10.0.0.1", "fe80::1")) for proto, (p, q) in itertools.product((1, 6, 17, 58, 132), ((8, 0), (0, 0), (128, 0), (129, 0), (3, 1), (443, 9999))) if True]
    flows += [("10.0.0.2", "10.0.0.1", 50, None, None), ("fe80::2", "fe80::1", 47, 3, 4)]
    df = spark.createDataFrame(flows, "a string, b string, proto int, p int, q int")
    got = df.select("*", network.community_id(F.col("a"), F.col("b"), F.col("proto"), F.col("p"), F.col("q"), seed).alias("h")).collect()
    assert [r.h for r in got] == [written_out(r.a, r.b, r.proto, r.p, r.q, seed) for r in got]


def test_hash_of_what_is_not_known(spark):
    rows = [("x", "1.1.1.1", "tcp", 1, 2), (None, "1.1.1.1", "tcp", 1, 2), ("1.1.1.1", "1.1.1.2", None, 1, 2), ("1.1.1.1", "1.1.1.2", "nothing", 1, 2), ("1.1.1.1", "1.1.1.2", "tcp", None, None), ("1.1.1.1", "1.1.1.2", "50", 1, None)]
    df = spark.createDataFrame(rows, "a string, b string, proto string, p int, q int")
    assert [r[0] for r in df.select(network.community_id(F.col("a"), F.col("b"), F.col("proto"), F.col("p"), F.col("q"))).collect()] == [None] * len(rows)
    one = spark.range(1).select(network.community_id(F.lit("1.1.1.1"), F.lit("1.1.1.2"), F.lit("TCP"), F.lit(1), F.lit(2)) == network.community_id(F.lit("1.1.1.2"), F.lit("1.1.1.1"), F.lit(6), F.lit(2), F.lit(1)))
    assert one.first()[0]
