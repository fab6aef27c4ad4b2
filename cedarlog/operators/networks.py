"""Places of IPv4 and IPv6 addresses: networks and ranges joined by prefixes.

Every address is 16 bytes; IPv4 ones stand in ``::ffff:0:0/96``. Networks and ranges are
cut into prefixes. A prefix belongs to the level (a multiple of 16 bits) at or below its
length: its first bits up to there are the bucket, and the following 16 bits are a stretch
of units in it. So an address and its prefix share a bucket, and the join is an equality
on the bucket and a test of one small number. In a bucket stretches are made disjoint, the
smallest network winning, so a bucket has at most 65,536 of them. Of the levels' matches
the smallest network's is taken.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions.once import with_once
from cedarlog.functions.text import address_bytes
from cedarlog.session import fits_broadcast, materialize

#: Bits of a bucket's units.
STEP = 16
UNITS = 1 << STEP
#: Stretches up to which a prepared table is broadcast; at about 150 bytes each that is 150 MB.
BROADCAST_ROWS = 1_000_000
#: Rows with one text that are joined with its place together.
HOT_ROWS = 100_000
_CUT = "level int, bucket binary, low int, high int, size binary, place string"
_MAPPED = 0xFFFF << 32


def _bounds(network: str | None, first: str | None, last: str | None) -> tuple[int, int] | None:
    """First and last address as numbers of 128 bits; None for what is no network or range."""

    def number(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> int:
        return int(address) | _MAPPED if address.version == 4 else int(address)

    try:
        if network:
            net = ipaddress.ip_network(network.strip(), strict=False)
            return number(net.network_address), number(net.broadcast_address)
        low, high = (number(ipaddress.ip_address(x.strip())) for x in (first or "", last or ""))
    except ValueError:
        return None
    return (low, high) if low <= high else None


def _prefixes(low: int, high: int) -> Iterator[tuple[int, int]]:
    """(first address, length) of the prefixes that make up a range, at most 254."""
    while low <= high:
        free = (low & -low).bit_length() - 1 if low else 128
        free = min(free, (high - low + 1).bit_length() - 1)
        yield low, 128 - free
        low += 1 << free


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for network, first, last, place in batch.itertuples(index=False):
            bounds = _bounds(network, first, last)
            if bounds is None or place is None:
                continue
            size = (bounds[1] - bounds[0]).to_bytes(16)
            for at, length in _prefixes(*bounds):
                level = length // STEP * STEP
                units = STEP - (length - level) if level < 128 else 0
                low = (at >> (128 - STEP - level)) & (UNITS - 1) if level < 128 else 0
                out.append((level, at.to_bytes(16)[: level // 8], low, low + (1 << units) - 1, size, place))
        yield pd.DataFrame(out, columns=["level", "bucket", "low", "high", "size", "place"])


def _painted(lows: list[int], highs: list[int], ranks: list[tuple[bytes, str]]) -> list[tuple[int, int, int]]:
    """(row, low, high) of one bucket's disjoint stretches: of the rows that cover a unit the least by rank owns it.

    Rows are sorted by ``low``, wider ones first. They are prefixes, so of two one holds the other or they are apart.
    """
    out: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []  # (high, owner) of the rows that hold the current unit, the innermost last
    at = 0

    def give(high: int) -> None:
        nonlocal at
        owner = open_[-1][1]
        if at <= high:
            if out and out[-1][0] == owner and out[-1][2] + 1 == at:
                out[-1] = owner, out[-1][1], high
            else:
                out.append((owner, at, high))
            at = high + 1

    for row, (low, high) in enumerate(zip(lows, highs, strict=True)):
        while open_ and open_[-1][0] < low:
            give(open_[-1][0])
            open_.pop()
        if open_:
            give(low - 1)
        at = low
        inner = not open_ or ranks[row] < ranks[open_[-1][1]]
        open_.append((high, row if inner else open_[-1][1]))
    while open_:
        give(open_[-1][0])
        open_.pop()
    return out


def _disjoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's stretches made disjoint; rows come sorted by bucket, then as :func:`_painted` takes them.

    Most buckets of a large table hold one stretch, and those rows pass as they are.
    """

    def done(rows: pa.Table, starts: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        owner = starts[counts == 1]
        low, high = (rows[c].to_numpy()[owner] for c in ("low", "high"))
        extra = []
        for start, count in zip(starts[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
            lows, highs, sizes, places = (rows[c].slice(start, count).to_pylist() for c in ("low", "high", "size", "place"))
            extra += [(start + row, a, b) for row, a, b in _painted(lows, highs, list(zip(sizes, places, strict=True)))]
        if extra:
            owner, low, high = (np.concatenate([x, y]) for x, y in zip((owner, low, high), np.array(extra, "int64").T, strict=True))
        if len(owner):
            taken = rows.take(pa.array(owner))
            for name, values in (("low", low), ("high", high)):
                taken = taken.set_column(taken.schema.get_field_index(name), name, pa.array(values, pa.int32()))
            yield from taken.combine_chunks().to_batches()

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([*(held.to_batches() if held else ()), batch]).combine_chunks()
        if not rows.num_rows:
            continue
        new = np.ones(rows.num_rows, bool)
        later, earlier = rows.slice(1), rows.slice(0, rows.num_rows - 1)
        new[1:] = False
        for name in ("level", "bucket"):
            new[1:] |= pc.not_equal(later[name], earlier[name]).to_numpy()
        starts = np.flatnonzero(new)
        yield from done(rows, starts[:-1], np.diff(starts))  # the last bucket may go on
        held = rows.slice(starts[-1])
    if held:
        yield from done(held, np.array([0]), np.array([held.num_rows]))


def prepare_networks(networks: DataFrame) -> DataFrame:
    """``(level, bucket, low, high, size, place)`` from ``network`` or ``first`` and ``last``, and ``place``.

    ``network`` is like ``2001:db8::/32`` or ``10.0.0.0/8``, bits past the prefix do not
    matter; ``first`` and ``last`` are addresses of a range, both included. ``place`` is a
    JSON object, what a database knows of the network. Rows that are neither, or without a
    place, are left out. Where networks of one size overlap, the smaller text wins.
    Do this once per table and keep the result.
    """
    have = set(networks.columns)
    texts = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("network", "first", "last", "place")]
    cut = networks.select(*texts).mapInPandas(_cut, _CUT)
    least = F.min(F.struct("size", "place")).alias("least")
    one = cut.groupBy("level", "bucket", "low", "high").agg(least).select("level", "bucket", "low", "high", "least.size", "least.place")
    ordered = one.repartition("level", "bucket").sortWithinPartitions("level", "bucket", "low", F.desc("high"))
    return ordered.mapInArrow(_disjoint, _CUT)


def is_prepared(table: DataFrame) -> bool:
    return {"level", "bucket", "place"} <= set(table.columns)


def _unit(address: Column, level: int | Column) -> Column:
    at = F.lit(level) if isinstance(level, int) else level
    two = F.substring(address, (at / 8).cast("int") + 1, F.lit(2))
    return F.coalesce(F.conv(F.hex(two), 16, 10).cast("int"), F.lit(0))


def _bucket(address: Column, level: int | Column) -> Column:
    at = F.lit(level) if isinstance(level, int) else level
    return F.substring(address, F.lit(1), (at / 8).cast("int"))


def places_of(df: DataFrame, ip_column: str, table: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Add ``place``, that of the smallest network the address lies in; NULL if there is none or it is no address.

    Every input row comes out exactly once. A small table (checked by counting) is
    broadcast, and each level is one lookup. Otherwise the distinct addresses are written
    out, looked up by shuffle, once for each level, and joined back; there the rows of a
    text that many rows have, address or not, are dealt out to several tasks.
    """
    levels = sorted(r["level"] for r in table.select("level").distinct().collect())  # nine at most
    columns = [F.col(f"`{c}`") for c in df.columns]
    if broadcast is None:
        broadcast = fits_broadcast(table, BROADCAST_ROWS)
    if broadcast:
        rows = df.withColumn("__address", address_bytes(F.col(ip_column)))
        for level in levels:
            own = table.where(F.col("level") == level).select(
                F.col("bucket").alias("__bucket"), F.col("low").alias("__low"), F.col("high").alias("__high"), F.struct("size", "place").alias(f"__at{level}")
            )
            address = F.col("__address")
            on = (_bucket(address, level) == F.col("__bucket")) & _unit(address, level).between(F.col("__low"), F.col("__high"))
            rows = rows.join(F.broadcast(own), on, "left").drop("__bucket", "__low", "__high")
        matches = F.filter(F.array(*(F.col(f"__at{level}") for level in levels)), lambda m: m.isNotNull()) if levels else None
        place = F.array_min(matches)["place"] if levels else F.lit(None).cast("string")
        return rows.select(*columns, place.alias("place"))
    counted = df.groupBy(F.col(ip_column).alias("__text")).agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("__parts"))
    texts = materialize(with_once(counted, "__address", address_bytes(F.col("__text"))), "addresses")
    wanted = texts.where("__address IS NOT NULL")
    each = wanted.withColumn("level", F.explode(F.array(*(F.lit(level) for level in levels)).cast("array<int>")))
    asked = each.select("__text", "__parts", "level", _bucket(F.col("__address"), F.col("level")).alias("bucket"), _unit(F.col("__address"), F.col("level")).alias("__unit"))
    hits = asked.join(table.hint("shuffle_hash"), ["level", "bucket"]).where(F.col("__unit").between(F.col("low"), F.col("high")))
    found = hits.groupBy("__text", "__parts").agg(F.min(F.struct("size", "place"))["place"].alias("place"))
    found = found.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    hot = texts.where("__parts > 1").select(F.col("__text").alias("__hot"), "__parts")
    rows = df.join(F.broadcast(hot), F.col(ip_column).eqNullSafe(F.col("__hot")), "left")
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    part = F.pmod(F.xxhash64(*plain), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = rows.select(*columns, part.alias("__own"))
    return dealt.join(found, (F.col(ip_column) == F.col("__text")) & (F.col("__own") == F.col("__part")), "left").select(*columns, "place")
