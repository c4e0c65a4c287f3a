"""Scalar functions over columns: ring hashes, keys, checksums, limits and sizes. No Python runs on rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_hash(key: Column) -> Column:
    """The first 64 bits of SHA-256 as 16 hex digits, whose text order is the order of the unsigned numbers."""
    return F.substring(F.sha2(key, 256), 1, 16)


def composite_key(tenant: Column, key: Column) -> Column:
    return F.concat(tenant, F.lit(":"), key)


def split_key(composite: Column) -> Column:
    """tenant_id and key, cut at the first colon."""
    at = F.locate(":", composite)
    return F.struct(F.substring(composite, F.lit(1), at - 1).alias("tenant_id"), F.substring(composite, at + 1, F.length(composite)).alias("key"))


def vnode_node(vnode: Column) -> Column:
    """The node of a virtual node, cut at the last mark; text without one is the node."""
    return F.when(F.contains(vnode, F.lit("-vnode-")), F.regexp_extract(vnode, "^(.*)-vnode-", 1)).otherwise(vnode)


def in_range(hash_: Column, lo: Column, hi: Column) -> Column:
    """lo <= hash < hi around the ring; equal ends hold nothing."""
    return F.when(lo < hi, (hash_ >= lo) & (hash_ < hi)).when(lo > hi, (hash_ >= lo) | (hash_ < hi)).otherwise(False)


def crc_frame(data: Column) -> Column:
    """The bytes with their CRC-32 behind them, little-endian."""
    h = F.lpad(F.hex(F.crc32(data)), 8, "0")
    little = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.concat(data, F.unhex(little))


def crc_valid(frame: Column) -> Column:
    """Whether a frame has four bytes or more and its checksum holds."""
    body = F.substring(frame, F.lit(1), F.length(frame) - 4)
    return (F.length(frame) >= 4) & (crc_frame(body) == frame)


def write_size(tenant: Column, key: Column, value: Column) -> Column:
    size = F.octet_length(tenant) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
    return F.floor((size * 3 + 350) * 6 / 5).cast("long")


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter of n keys with a false-positive rate p."""
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, math.ceil(bits / n * math.log(2)))


def tenant_error(t: Column) -> Column:
    return F.when(F.coalesce(t, F.lit("")) == "", "tenant_empty").when(F.octet_length(t) > 256, "tenant_too_long").when(F.contains(t, F.lit(":")), "tenant_colon").when(F.regexp_like(t, F.lit("[\\x00-\\x1f\\x7f]")), "tenant_control")


def key_error(k: Column) -> Column:
    return F.when(F.coalesce(k, F.lit("")) == "", "key_empty").when(F.octet_length(k) > 1024, "key_too_long").when(F.regexp_like(k, F.lit("[\\x00-\\x08\\x0b-\\x1f\\x7f]")), "key_control")


def value_error(v: Column, most: int = 1 << 20) -> Column:
    return F.when(F.octet_length(v) > most, "value_too_long")


def write_error(t: Column, k: Column, v: Column) -> Column:
    """The first error of tenant, key and value; null if valid."""
    return F.coalesce(tenant_error(t), key_error(k), value_error(v))


def generated_key(tenant: Column, key: Column, nanos: Column, salt: Column) -> Column:
    """An idempotency key of 64 hex digits for a request that brings none, of its time and a salt."""
    return F.sha2(F.concat_ws(":", tenant, key, nanos.cast("string"), salt), 256)


def day(seconds: Column) -> Column:
    """The UTC date of a time in seconds, as text."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd")
