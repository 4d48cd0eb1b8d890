"""Addresses, ports, flags and identifiers of flows, as expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.schema import AF_INET, L4PROTO_TCP

TUPLE = ("src", "dst", "sport", "dport", "l4proto")


def ipv4(address: Column) -> Column:
    """Dotted text of an IPv4 address held as a number, most significant byte first."""
    a = address.cast("long")
    return F.concat_ws(".", *[F.shiftright(a, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def ipv4_bytes(raw: Column) -> Column:
    """Dotted text of four bytes."""
    return F.concat_ws(".", *[F.conv(F.hex(F.substring(raw, i, 1)), 16, 10) for i in range(1, 5)])


def _swapped(a: Column) -> Column:
    """A 32-bit number with its bytes in reverse."""
    part = lambda right, left: F.shiftleft(F.shiftright(a, right).bitwiseAND(F.lit(255)), left)
    return part(0, 24) + part(8, 16) + part(16, 8) + part(24, 0)


def ipv4_pair(packed: Column) -> tuple[Column, Column]:
    """Source and destination of a 64-bit pair: high half, low half, each with its bytes in reverse."""
    p = packed.cast("long")
    return ipv4(_swapped(F.shiftrightunsigned(p, 32))), ipv4(_swapped(p.bitwiseAND(F.lit(0xFFFFFFFF))))


# The longest run of two or more zero groups, of equally long ones the first, with what stands before and after it.
_ZERO_RUN = "^(?:" + "|".join(rf"(?:|(.*?):)0(?::0){{{n - 1}}}(?::(.*))?" for n in range(8, 1, -1)) + ")$"
_WITHOUT_RUN = "".join(f"${i}" for i in range(1, 15, 2)) + "::" + "".join(f"${i}" for i in range(2, 15, 2))


def ipv6(raw: Column) -> Column:
    """Canonical text of 16 bytes; null for other lengths."""
    # Few expressions: they stand in one generated method with those of IPv4 rows, and the JVM doesn't compile a long one.
    groups = F.regexp_replace(F.lower(F.hex(raw)), "(.{4})(?!$)", "$1:")
    text = F.regexp_replace(F.regexp_replace(groups, "(^|:)0{1,3}(?=[0-9a-f])", "$1"), _ZERO_RUN, _WITHOUT_RUN)
    part = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10)
    four = F.concat_ws(".", F.transform(F.sequence(F.lit(13), F.lit(16)), part))
    mapped = groups.startswith("0000:0000:0000:0000:0000:ffff:")
    return F.when(F.length(raw) == 16, F.when(mapped, F.concat(F.lit("::ffff:"), four)).otherwise(text))


def is_ipv4(family: Column) -> Column:
    return family == AF_INET


def sockaddr_bytes(raw: Column, family: Column) -> Column:
    """Address bytes inside a 28-byte socket address."""
    return F.when(is_ipv4(family), F.substring(raw, 5, 4)).otherwise(F.substring(raw, 9, 16))


def ports(packed: Column, order: str = "host") -> tuple[Column, Column]:
    """Source and destination port of a packed 32-bit pair. ``host``: both halves as they are; ``sock``: the second
    half's bytes in reverse; ``cwnd``: both halves' bytes in reverse, as each source writes them."""
    p = packed.cast("long")
    high, low = F.shiftright(p, 16).bitwiseAND(F.lit(0xFFFF)), p.bitwiseAND(F.lit(0xFFFF))
    turned = lambda x: F.shiftleft(x.bitwiseAND(F.lit(255)), 8) + F.shiftright(x, 8)
    return (turned(high) if order == "cwnd" else high).cast("int"), (turned(low) if order in ("sock", "cwnd") else low).cast("int")


def tcp_flags(bits: Column) -> Column:
    """Booleans of the flag byte."""
    return F.struct(*[(bits.bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(("fin", "syn", "rst", "psh", "ack", "urg"))])


def hashed_id(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, joined by bars."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hashed_id_of(*parts: object) -> int:
    """``hashed_id`` of constants, on the driver."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def flow_id(prefix: str = "") -> Column:
    return hashed_id(*[F.col(prefix + c) for c in TUPLE])


def series_id(flow: Column, name: Column) -> Column:
    return hashed_id(flow, name)


def with_flow(records: DataFrame, kind: str, port_order: str | None = None) -> DataFrame:
    """Adds the flow tuple of a record kind; no row goes through Python."""
    src, dst, sport, dport = F.col, F.col, F.col("sport") if "sport" in records.columns else None, F.col("dport") if "dport" in records.columns else None
    if kind == "packet":
        v4 = (F.col("saddr") != 0) & (F.col("daddr") != 0)
        src, dst = F.when(v4, ipv4(F.col("saddr"))), F.when(v4, ipv4(F.col("daddr")))
        raw = F.col("saddr_v6"), F.col("daddr_v6")
    elif kind == "probe":
        v4 = is_ipv4(F.col("family"))
        src, dst = (F.when(v4, ipv4_bytes(F.substring(F.col(c), 5, 4))) for c in ("saddr", "daddr"))
        raw = tuple(F.substring(F.col(c), 9, 16) for c in ("saddr", "daddr"))
    elif kind in ("sock", "cwnd"):
        v4 = is_ipv4(F.col("family"))
        src, dst = (F.when(v4, x) for x in ipv4_pair(F.col("addr_v4")))
        raw = F.col("src_v6"), F.col("dst_v6")
        sport, dport = ports(F.col("ports"), port_order or kind)
    elif kind == "retransmit_synack":
        v4 = is_ipv4(F.col("family"))
        src, dst = F.when(v4, ipv4_bytes(F.col("saddr"))), F.when(v4, ipv4_bytes(F.col("daddr")))
        raw = F.col("saddr_v6"), F.col("daddr_v6")
    else:
        raise ValueError(f"{kind} records have no flow")
    named = records.withColumns({c: F.coalesce(four, F.when(~v4, ipv6(six))) for c, four, six in (("src", src, raw[0]), ("dst", dst, raw[1]))})
    return named.withColumns({"sport": sport.cast("int"), "dport": dport.cast("int"), "l4proto": F.lit(L4PROTO_TCP)})


def swap_direction(df: DataFrame, received: Column | None = None, addresses: bool = True) -> DataFrame:
    """Source and destination of received rows exchanged (with ``addresses`` off, of ports only)."""
    back = F.col("direction") == "recv" if received is None else received
    pairs = [("sport", "dport"), *([("src", "dst")] if addresses else [])]
    return df.withColumns({x: F.when(back, F.col(y)).otherwise(F.col(x)) for a, b in pairs for x, y in ((a, b), (b, a))})


def filter_port(df: DataFrame, port: int = 0) -> DataFrame:
    """Rows with the port on either side; 0 keeps all."""
    return df if port == 0 else df.filter((F.col("sport") == port) | (F.col("dport") == port))
