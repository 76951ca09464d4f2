"""Which destinations may be fetched from: literal addresses against the blocks that are not public, by longest prefix."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.markup import Expr, each, found, let, like, only, replaced
from pagewright.functions.text import url_part

# Blocks that are no public destinations, with what they are for, and public blocks within them.
BLOCKS = (
    ("0.0.0.0/8", "unspecified"), ("10.0.0.0/8", "private"), ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link-local"), ("172.16.0.0/12", "private"),
    ("192.0.0.0/24", "private"), ("192.0.0.9/32", "public"), ("192.0.0.10/32", "public"), ("192.0.2.0/24", "private"), ("192.168.0.0/16", "private"),
    ("198.18.0.0/15", "private"), ("198.51.100.0/24", "private"), ("203.0.113.0/24", "private"), ("224.0.0.0/4", "multicast"), ("240.0.0.0/4", "reserved"),
    ("::/8", "reserved"), ("::ffff:0:0/96", "public"), ("::/128", "unspecified"), ("::1/128", "loopback"), ("64:ff9b:1::/48", "private"), ("100::/8", "reserved"), ("200::/7", "reserved"), ("400::/6", "reserved"),
    ("800::/5", "reserved"), ("1000::/4", "reserved"), ("2001::/23", "private"), ("2001:1::1/128", "public"), ("2001:1::2/128", "public"), ("2001:3::/32", "public"),
    ("2001:4:112::/48", "public"), ("2001:20::/28", "public"), ("2001:30::/28", "public"), ("2001:db8::/32", "private"), ("2002::/16", "private"), ("3fff::/20", "private"),
    ("4000::/3", "reserved"), ("6000::/3", "reserved"), ("8000::/3", "reserved"), ("a000::/3", "reserved"), ("c000::/3", "reserved"), ("e000::/4", "reserved"), ("f000::/5", "reserved"),
    ("f800::/6", "reserved"), ("fe00::/9", "reserved"), ("fc00::/7", "private"), ("fe80::/10", "link-local"), ("ff00::/8", "multicast"),
)
#: What stands before a v4 address where both kinds are compared.
MAPPED = "0" * 20 + "ffff"


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user, port, brackets' zone and closing dots."""
    netloc = F.lower(F.regexp_replace(url_part(url, "netloc"), "^.*@", ""))
    bracketed = F.regexp_extract(netloc, r"^(\[[^\]]*\])", 1)
    return F.when(bracketed != "", bracketed).otherwise(F.regexp_replace(F.regexp_replace(netloc, ":[0-9]*$", ""), r"\.+$", ""))


def _v4(host: Expr) -> Expr:
    """Eight hexadecimal digits of a v4 address in any of its spellings: one to four parts, decimal, octal or hexadecimal, of which the
    last fills what the others leave; null if it is none."""
    number = lambda p: f"case when {like(p, '^0x')} then conv(substring({p}, 3), 16, 10) when {like(p, '^0[0-7]+$')} then conv({p}, 8, 10) when {like(p, '^0[0-9]+$')} then null else {p} end"
    parts = each(f"split({host}, '[.]')", lambda p: f"try_cast({number(p)} as bigint)")
    room = lambda p: f"element_at(array(4294967296L, 16777216L, 65536L, 256L), size({p}))"
    fits = lambda p: f"not exists({p}, x -> x is null) and not exists(slice({p}, 1, size({p}) - 1), x -> x > 255) and element_at({p}, -1) < {room(p)}"
    whole = lambda p: f"lpad(hex(aggregate(slice({p}, 1, size({p}) - 1), 0L, (n, x) -> n * 256 + x) * {room(p)} + element_at({p}, -1)), 8, '0')"
    shape = like(host, r"^(?:0x[0-9a-f]{1,12}|[0-9]{1,15})(?:[.](?:0x[0-9a-f]{1,12}|[0-9]{1,15})){0,3}$")
    return f"case when {shape} then {let(parts, lambda p: f'case when {fits(p)} then lower({whole(p)}) end')} end"


def _v6(host: Expr) -> Expr:
    """Thirty-two hexadecimal digits of a v6 address in brackets; null if it is none."""
    inner = replaced(replaced(host, r"^\[|\]$"), "%.*$")
    tail = lambda x: found(x, r"([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)$")
    as_groups = lambda x: let(_v4(tail(x)), lambda d: f"case when {tail(x)} = '' then {x} when {d} is null then 'none' else concat(substring({x}, 1, length({x}) - length({tail(x)})), substring({d}, 1, 4), ':', substring({d}, 5)) end")
    groups = lambda x: only(f"split({x}, ':')", lambda g: f"{g} <> ''")
    digits = lambda x: f"array_join({each(groups(x), lambda g: f'lpad({g}, 4, {chr(39)}0{chr(39)})')}, '')"

    def whole(x: Expr) -> Expr:
        left, right = f"substring_index({x}, '::', 1)", found(x, "^.*?::(.*)$")
        legal = like(x, "^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$")
        short = f"{like(x, '^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$')} and size({groups(x)}) <= 7"
        return f"case when {legal} then {digits(x)} when {short} then concat({digits(left)}, repeat('0', 32 - length({digits(left)}) - length({digits(right)})), {digits(right)}) end"

    return f"case when {like(host, r'^\[.*\]$')} then {let(let(inner, as_groups), whole)} end"


def address(host: str) -> Column:
    """The literal address that a host column holds, as 32 hexadecimal digits, v4 as mapped into v6; null for names."""
    return F.expr(f"coalesce({_v6(host)}, concat('{MAPPED}', {_v4(host)}))")


def block_rows() -> list[tuple[str, str, int, str]]:
    """(first, last, prefix length, kind) of every block, both ends as 32 hexadecimal digits."""
    out = []
    for text, kind in BLOCKS:
        net = ipaddress.ip_network(text)
        lift = (0xFFFF << 32, 96) if net.version == 4 else (0, 0)
        out.append((f"{int(net.network_address) + lift[0]:032x}", f"{int(net.broadcast_address) + lift[0]:032x}", net.prefixlen + lift[1], kind))
    return sorted(out)


def kind_of(digits: Column) -> Column:
    """What the longest block that holds an address is for; 'public' outside all, null without an address."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("first", "last", "bits", "kind"), row, strict=True)]) for row in block_rows()])
    held = F.filter(rows, lambda b: (b["first"] <= digits) & (digits <= b["last"]))
    best = F.array_max(F.transform(held, lambda b: F.struct(b["bits"], b["kind"])))
    return F.when(digits.isNotNull(), F.coalesce(best["kind"], F.lit("public")))


def destinations(urls: DataFrame) -> DataFrame:
    """The columns of urls and host, kind, allowed: names are allowed as far as they go (kind 'name': what they resolve to has to be
    looked at as well), literal addresses if they are public, urls without a host (kind null) never."""
    rows = urls.withColumn("host", host_of(F.col("url"))).withColumn("__address", address("host"))
    kind = F.when(F.col("__address").isNotNull(), kind_of(F.col("__address"))).when(F.col("host").isin("localhost", "localhost.localdomain") | F.col("host").endswith(".localhost"), "loopback")
    kind = kind.when((F.col("host") != "") & ~F.col("host").startswith("["), "name")
    return rows.withColumn("kind", kind).withColumn("allowed", F.coalesce(F.col("kind").isin("name", "public"), F.lit(False))).drop("__address")
