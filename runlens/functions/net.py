"""Address and version functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import IPV4


def ips_in(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({IPV4})"), 1), F.array().cast("array<string>"))


def ip_to_int(ip: Column) -> Column:
    octets = F.transform(F.split(ip, r"\."), lambda o: o.cast("bigint").bitwiseAND(F.lit(255)))
    return F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)


def ip_in_range(ip: Column, cidr: str) -> Column:
    """Membership in a literal range, as one integer comparison."""
    base, bits = cidr.split("/")
    size = 1 << (32 - int(bits))
    start = 0
    for octet in base.split("."):
        start = start * 256 + (int(octet) & 255)
    return F.floor(ip_to_int(ip) / size) == start // size


def any_ip_in(ips: Column, ranges: list[str]) -> Column:
    if not ranges:
        return F.lit(False)
    return F.exists(ips, lambda ip: _any(ip_in_range(ip, r) for r in ranges))


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def parse_version(text: Column) -> Column:
    """Struct of three numbers, or null. Structs compare field by field, so ranges are plain comparisons."""
    pattern = r"(\d+)\.(\d+)(?:\.(\d+))?"

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))

    return F.when(
        text.rlike(pattern),
        F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")),
    )


def version_literal(version: tuple[int, int, int]) -> Column:
    names = ("major", "minor", "patch")
    return F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(version, names)])


def version_in(version: Column, low: tuple, high: tuple) -> Column:
    return (version >= version_literal(low)) & (version < version_literal(high))


def normalize_binary(path: Column) -> Column:
    """File name of a path; an interpreter loses its version except a leading 3."""
    name = F.regexp_replace(F.regexp_replace(F.trim(path), "/+\\z", ""), r"^.*/", "")
    name = F.regexp_replace(name, r"\.basic\z", "")
    pattern = r"^(python|perl|ruby|php|node)(\d)?(?:\.\d+)?\z"
    family, major = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    return F.when(name.rlike(pattern), F.when(major == "3", F.concat(family, F.lit("3"))).otherwise(family)).otherwise(name)
