"""Text of sizes, durations, addresses and connections; parsing of times and stack lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allocation size ranges and protocol numbers.
SIZE_RANGES = [
    (16, "0-16B"), (64, "16-64B"), (256, "64-256B"), (1024, "256B-1KB"), (4096, "1-4KB"), (16384, "4-16KB"),
    (65536, "16-64KB"), (262144, "64-256KB"), (1048576, "256KB-1MB"), (4194304, "1-4MB"), (16777216, "4-16MB"),
    (67108864, "16-64MB"), (None, ">64MB"),
]
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}
LAUNCH_SYMBOL = "cudaLaunchKernel"


def time_ms(text: Column) -> Column:
    """Milliseconds of a time given as text or as seconds; null when it is neither (F1)."""
    seconds = F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$"), F.expr("1000D") * text.try_cast("double"))
    stamp = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return F.coalesce(seconds, F.unix_micros(stamp) / 1000.0)


def _fixed(value: Column, places: int, unit: str) -> Column:
    return F.format_string(f"%.{places}f{unit}", F.bround(value, places))


def bytes_text(value: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB (F2)."""
    x = value.cast("double")
    return (F.when(value.isNull(), "N/A").when(x < 1024, _fixed(x, 0, "B")).when(x < 1024 ** 2, _fixed(x / 1024, 2, "KB"))
            .when(x < 1024 ** 3, _fixed(x / 1024 ** 2, 2, "MB")).when(x < 1024 ** 4, _fixed(x / 1024 ** 3, 2, "GB"))
            .otherwise(_fixed(x / 1024 ** 4, 2, "TB")))


def duration_text(us: Column) -> Column:
    """Microseconds as us, ms or s (F2)."""
    x = us.cast("double")
    return (F.when(us.isNull(), "N/A").when(x < 1000, _fixed(x, 2, "us")).when(x < 1_000_000, _fixed(x / 1000, 2, "ms"))
            .otherwise(_fixed(x / 1_000_000, 3, "s")))


def clock_text(ms: Column) -> Column:
    """Time of day of milliseconds since 1970 (F2)."""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "HH:mm:ss.SSS")


def size_range(size: Column) -> Column:
    """Range label of an allocation size."""
    out = F.when(size < 0, "unknown")
    for upper, label in SIZE_RANGES:
        out = out.when(size < upper, label) if upper is not None else out.otherwise(label)
    return out


def ipv4_text(address: Column) -> Column:
    """Dotted text of an address in network byte order read as a little-endian number."""
    parts = [F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (0, 8, 16, 24)]
    return F.concat_ws(".", *parts)


def protocol_name(number: Column) -> Column:
    """Name of an IP protocol."""
    out = F.concat(F.lit("Proto("), number.cast("string"), F.lit(")"))
    for code, name in PROTOCOLS.items():
        out = F.when(number == code, name).otherwise(out)
    return out


def connection_key(src: Column, src_port: Column, dst: Column, dst_port: Column, protocol: Column) -> Column:
    """src:port->dst:port (proto)."""
    colon = F.lit(":")
    return F.concat(src, colon, src_port.cast("string"), F.lit("->"), dst, colon, dst_port.cast("string"),
                    F.lit(" ("), protocol, F.lit(")"))


def hex_address(address: Column) -> Column:
    """0x and the address in lower-case hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def without_launch_frames(frames: Column, symbol: str = LAUNCH_SYMBOL) -> Column:
    """Frames that are not blank and do not start with the launch symbol."""
    return F.filter(frames, lambda f: (F.trim(f) != "") & ~F.trim(f).startswith(symbol))


def nested_value(json: Column, path: str) -> Column:
    """A value inside nested call arguments, by JSON path (F16)."""
    return F.get_json_object(json, path)
