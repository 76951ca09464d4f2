"""Literal addresses against Python's own reading of the registries."""

import ipaddress
import random
import socket

from pagewright.operators import destinations as D


#: Registered for documentation after this version of the standard library.
LATER = ipaddress.ip_network("3fff::/20")


def public(ip):
    if ip.version == 6 and ip in LATER:
        return False
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


def test_addresses_by_the_standard_library(spark):
    rng = random.Random(1)
    edges = [int(n.network_address) + d for n in map(ipaddress.ip_network, (b for b, _ in D.BLOCKS)) if n.version == 4 for d in (-1, 0, n.num_addresses - 1, n.num_addresses)]
    v4 = [str(ipaddress.IPv4Address(x)) for x in [*edges, *(rng.getrandbits(32) for _ in range(200))] if 0 <= x < 1 << 32]
    edges = [int(n.network_address) + d for n in map(ipaddress.ip_network, (b for b, _ in D.BLOCKS)) if n.version == 6 for d in (-1, 0, 5, n.num_addresses - 1, n.num_addresses)]
    v6 = [ipaddress.IPv6Address(x) for x in [*edges, *(rng.getrandbits(128) for _ in range(200)), 0xFFFF_0A000001, 0xFFFF_08080808] if 0 <= x < 1 << 128]
    rows = [(f"http://{a}:80/x", a, public(ipaddress.ip_address(a))) for a in v4]
    rows += [(f"https://u@[{s}]/", f"[{s}]".lower(), public(a)) for a in v6 for s in (a.compressed, a.exploded.upper())]
    got = {r["url"]: (r["host"], r["allowed"]) for r in D.destinations(spark.createDataFrame(rows, "url string, want_host string, want boolean")).collect()}
    assert got == {u: (h, w) for u, h, w in rows}


def test_spellings_and_names(spark):
    spelt = ["127.1", "0x7f.1", "017700000001", "2130706433", "0x7F000001", "10.0x10.1", "1.2.3", "8.8.8.8", "8.8.8.8."]
    cases = {f"http://{s}/": public(ipaddress.IPv4Address(socket.inet_aton(s.rstrip(".")))) for s in spelt}
    cases |= {"http://[::ffff:127.0.0.1]/": False, "http://[64:ff9b::8.8.8.8%eth0]/": None, "http://[::1": False, "http://[1::2::3]/": False, "http://256.1.1.1/": True, "http://1.2.3.4.5/": True, "http://a.example/": True, "http://LOCALHOST/": False, "http://x.localhost:8/": False, "nothing": False, "": False}
    cases["http://[64:ff9b::8.8.8.8%eth0]/"] = public(ipaddress.IPv6Address("64:ff9b::808:808"))
    rows = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    assert {r["url"]: r["allowed"] for r in D.destinations(rows).collect()} == cases | {None: False}
    assert D.destinations(rows.limit(0)).count() == 0
