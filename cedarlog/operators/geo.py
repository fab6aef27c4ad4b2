"""Countries of IPv4 addresses: a range join kept as a hash join.

Tables with IPv6 networks or with more than a country are those of
:mod:`cedarlog.operators.networks`; :func:`geoip_join` takes them as well.

``ranges`` is a table ``(start_ip bigint, end_ip bigint, country string)``. It is
cut at the borders of /16 blocks, so that an address and its range share a block
number and the join is an equality on that number plus a range test.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions import records
from cedarlog.functions.once import with_once
from cedarlog.functions.text import ipv4_number
from cedarlog.operators import networks
from cedarlog.session import fits_broadcast

_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS

# Above this many prepared ranges the table is joined by shuffle, not broadcast;
# at well under 100 bytes a row this keeps a broadcast below about 200 MB.
BROADCAST_ROWS = 2_000_000

# Parts one address block is spread over in a shuffled join, so that a block
# holding a large share of all rows does not end up in one task.
SALTS = 32

_PREPARED = "block bigint, start_ip bigint, end_ip bigint, country string"


def prepare_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges cut at block borders and made disjoint: ``(block, start_ip, end_ip, country)``.

    Do this once per range table and keep the result. One block never holds more
    than 65,536 disjoint ranges, whatever the table's size.
    """
    block = F.col("block")
    cut = (
        ranges.select(
            F.col("start_ip").cast("bigint").alias("low"),
            F.col("end_ip").cast("bigint").alias("high"),
            "country",
        )
        .filter(F.col("low") <= F.col("high"))
        .withColumn(
            "block",
            F.explode(
                F.sequence(F.shiftright("low", _BLOCK_BITS), F.shiftright("high", _BLOCK_BITS), F.lit(1).cast("bigint"))
            ),
        )
        .select(
            "block",
            F.greatest(F.col("low"), block * _BLOCK).alias("start_ip"),
            F.least(F.col("high"), block * _BLOCK + (_BLOCK - 1)).alias("end_ip"),
            (F.col("high") - F.col("low")).alias("size"),
            "country",
        )
        .groupBy("block", "start_ip", "end_ip", "size")
        .agg(F.min("country").alias("country"))
    )
    def innermost(rows: pd.DataFrame) -> pd.DataFrame:
        """Cut one block's ranges into disjoint ones; where several cover, the smallest wins."""
        starts = rows.sort_values("start_ip")
        points = sorted(set(rows["start_ip"]) | set(rows["end_ip"] + 1))
        pending = list(zip(starts["start_ip"], starts["size"], starts["country"], starts["end_ip"]))[::-1]
        active: list[tuple[int, str, int]] = []
        out = []
        for low, following in zip(points, points[1:]):
            while pending and pending[-1][0] <= low:
                _, size, country, end = pending.pop()
                heapq.heappush(active, (size, country, end))
            while active and active[0][2] < low:
                heapq.heappop(active)
            if active:
                out.append((low, following - 1, active[0][1]))
        result = pd.DataFrame(out, columns=["start_ip", "end_ip", "country"])
        result.insert(0, "block", rows["block"].iloc[0])
        return result

    return cut.groupBy("block").applyInPandas(innermost, _PREPARED)


def countries_of(
    df: DataFrame, ip_column: str, ranges: DataFrame, prepared: bool = False, broadcast: bool | None = None
) -> DataFrame:
    """Add ``country``; an address in no range gets NULL, and with a range table also one that is not IPv4.

    Every input row comes out exactly once. The range table is broadcast while it
    is small enough (checked by counting it), otherwise shuffled with the rows,
    which are then spread over :data:`SALTS` parts per block.
    """
    if networks.is_prepared(ranges):
        found = networks.places_of(df, ip_column, ranges, broadcast)
        return found.select(*(F.col(f"`{c}`") for c in df.columns), records.json_text(F.col("place"), "country", "iso_code").alias("country"))
    table = ranges if prepared else prepare_ranges(ranges)
    if broadcast is None:
        broadcast = fits_broadcast(table, BROADCAST_ROWS)
    rows = df.withColumn("__ip", ipv4_number(F.col(ip_column))).withColumn(
        "__block", F.shiftright("__ip", _BLOCK_BITS)
    )
    right = table.select(
        F.col("block").alias("__r_block"),
        F.col("start_ip").alias("__low"),
        F.col("end_ip").alias("__high"),
        "country",
    )
    on: Column = (F.col("__block") == F.col("__r_block")) & F.col("__ip").between(F.col("__low"), F.col("__high"))
    if broadcast:
        joined = rows.join(F.broadcast(right), on, "left")
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(SALTS)))
        right = right.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(right.hint("shuffle_hash"), on & (F.col("__salt") == F.col("__r_salt")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), "country")


def places(df: DataFrame, ip_column: str, ranges: DataFrame, prepared: bool = False, broadcast: bool | None = None) -> DataFrame:
    """Add ``place`` (JSON, NULL for none) by a prepared network table, or by a range table, which knows the country."""
    if networks.is_prepared(ranges):
        return networks.places_of(df, ip_column, ranges, broadcast)
    country = F.col("country")
    known = F.to_json(F.struct(F.struct(country.alias("iso_code")).alias("country")))
    return countries_of(df, ip_column, ranges, prepared, broadcast).withColumn("place", F.when(country.isNotNull(), known)).drop("country")


def geoip_join(
    df: DataFrame,
    field: str,
    ranges: DataFrame,
    ip_column: str | None = None,
    prepared: bool = False,
    broadcast: bool | None = None,
) -> DataFrame:
    """Merge what is known of an enriched address field's place into the stored record.

    A hit is stored at ``enriched.geoip.<field>``: ``country.iso_code`` of a range table, or
    the whole place of a table made by ``prepare_networks``; a miss adds nothing. The
    address is taken from ``ip_column`` when given, else from the record.
    """
    address = F.col(ip_column) if ip_column else records.enriched_text(F.col("raw"), field)
    rows = df.withColumn("__ip_text", address)
    found = places(rows, "__ip_text", ranges, prepared, broadcast).withColumnRenamed("place", "__place")
    place = F.col("__place")
    entry = records.with_member(F.lit("{}"), field, place)
    old_block = records.enriched_block(F.col("raw"))
    old_geo = F.to_json(F.try_variant_get(records.record(F.col("raw")), "$.enriched.geoip", "variant"))
    geo = F.when(old_geo.isNull(), entry).otherwise(
        records.with_member(old_geo, field, place)
    )
    block = F.col("__block")
    merged = records.with_member(F.col("raw"), "enriched", records.with_member(block, "geoip", geo))
    hits = with_once(found, "__block", F.when(place.isNotNull(), old_block))
    return with_once(hits, "raw", F.when(block.isNotNull(), merged).otherwise(F.col("raw"))).select(
        *(F.col(f"`{c}`") for c in df.columns)
    )

