"""Packet captures: files are split into frames, frames are decoded column-wise.

Records of a classic capture chain by their lengths, so one file is one task (a capture is at
most 2 GB as a binary value; larger ones should be rotated). Everything after the split is
plain column arithmetic in the JVM.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the capture format: magic -> (byte order, fractions per second).
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
FRAME_SCHEMA = "path string, frame_no bigint, ts_us bigint, link_type int, frame binary"
BATCH = 4096
# Link types, ether types and header sizes.
RAW_LINKS, COOKED_LINK = (101, 228), 113
ETHER_IPV4, ETHER_VLAN = 0x0800, 0x8100
TCP, UDP = 6, 17
FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}


def split_frames(files: DataFrame) -> DataFrame:
    """One row per captured frame from ``path``, ``content`` rows.

    The splitter is a local function, so Spark ships its code and workers need no package.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "frame_no", "ts_us", "link_type", "frame"]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                order, unit = MAGICS.get(bytes(content[:4]), ("<", 1_000_000))
                if len(content) < 24:
                    continue
                link = struct.unpack_from(order + "I", content, 20)[0]
                header, at, number, rows = struct.Struct(order + "IIII"), 24, 0, []
                while at + 16 <= len(content):
                    sec, frac, kept, _ = header.unpack_from(content, at)
                    rows.append((path, number, sec * 1_000_000 + frac * 1_000_000 // unit, link, bytes(content[at + 16:at + 16 + kept])))
                    at, number = at + 16 + kept, number + 1
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(split, FRAME_SCHEMA)


def uint(frame: Column | str, offset: Column | int, size: int) -> Column:
    """Big-endian unsigned number at a byte offset, null past the end."""
    frame = F.col(frame) if isinstance(frame, str) else frame
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    piece = F.substring(frame, offset + 1, F.lit(size))
    return F.when(F.length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("bigint"))


def dotted(frame: str, offset: Column) -> Column:
    return F.concat_ws(".", *[uint(frame, offset + i, 1).cast("string") for i in range(4)])


def _ip_offset() -> Column:
    """Where the IPv4 header starts, or null."""
    n = F.length("frame")
    first4 = F.shiftright(uint("frame", 0, 1), 4) == 4
    kind = uint("frame", 12, 2)
    plain = F.when(kind == ETHER_IPV4, F.lit(14))
    tagged = F.when((n >= 38) & (uint("frame", 16, 2) == ETHER_IPV4), F.lit(18))
    by_link = (F.when(F.col("link_type").isin(*RAW_LINKS) | first4, F.lit(0))
               .when((F.col("link_type") == COOKED_LINK) & (n >= 36), F.when(uint("frame", 14, 2) == ETHER_IPV4, F.lit(16)))
               .when(n >= 34, F.when((kind == ETHER_VLAN) & (n >= 38), tagged).otherwise(plain)))
    guess = F.when((n >= 34) & (F.shiftright(uint("frame", 14, 1), 4) == 4), F.lit(14))
    return F.coalesce(by_link, guess)


def decode(frames: DataFrame) -> DataFrame:
    """Packet table from frames; non-IPv4 and truncated frames are dropped.

    Offsets are added as columns first so that each later field is a short expression.
    """
    at = frames.filter(F.length("frame") >= 20).withColumn("_ip", _ip_offset())
    at = at.filter(F.col("_ip").isNotNull() & (F.length("frame") >= F.col("_ip") + 20))
    head = F.col("_ip")
    at = at.withColumns({
        "_ihl": uint("frame", head, 1).bitwiseAND(0x0F) * 4, "_total": uint("frame", head + 2, 2),
        "_frag": uint("frame", head + 6, 2), "ttl": uint("frame", head + 8, 1).cast("int"),
        "protocol": uint("frame", head + 9, 1).cast("int"),
    }).withColumn("_l4", (head + F.col("_ihl")).cast("int"))
    l4, n = F.col("_l4"), F.length("frame")
    tcp = (F.col("protocol") == TCP) & (n >= l4 + 20)
    ported = tcp | ((F.col("protocol") == UDP) & (n >= l4 + 4))
    bits = uint("frame", l4 + 13, 1)
    return at.select(
        "path", "frame_no", "ts_us", dotted("frame", head + 12).alias("src_ip"), dotted("frame", head + 16).alias("dst_ip"),
        F.when(ported, uint("frame", l4, 2)).cast("int").alias("src_port"), F.when(ported, uint("frame", l4 + 2, 2)).cast("int").alias("dst_port"),
        "protocol", "ttl", F.when(tcp, uint("frame", l4 + 14, 2)).cast("int").alias("tcp_window"),
        ((F.col("_frag").bitwiseAND(0x2000) != 0) | (F.col("_frag").bitwiseAND(0x1FFF) != 0)).alias("ip_frag_flag"),
        F.least(F.greatest(F.lit(0), F.col("_total") - F.col("_ihl")), F.greatest(F.lit(0), n - l4)).cast("bigint").alias("payload_size"),
        *[F.when(tcp, bits.bitwiseAND(b) != 0).otherwise(F.lit(False)).alias(f"flag_{f}") for f, b in FLAG_BITS.items()],
        F.when(tcp, uint("frame", l4 + 4, 4)).alias("tcp_seq"), F.when(tcp, uint("frame", l4 + 8, 4)).alias("tcp_ack"),
        F.when(tcp, F.shiftright(uint("frame", l4 + 12, 1), 4) * 4).cast("int").alias("tcp_header_len"))


def read_packets(files: DataFrame) -> DataFrame:
    """Packets of all captures; ``pkt_id`` is unique within a file."""
    return decode(split_frames(files)).withColumn("pkt_id", F.col("frame_no"))
