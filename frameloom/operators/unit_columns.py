"""Classification of elementary-stream units as columns, for all five codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.sources.frames import byte_at


def prefix_length(data: str = "data") -> Column:
    """4 or 3 for a start code at the front, else 0."""
    front = F.hex(F.substring(F.col(data), 1, 4))
    return F.when(front == "00000001", 4).when(front.startswith("000001"), 3).otherwise(0)


def classified(units: DataFrame, codec: str, data: str = "data", keys: tuple[str, ...] = ("stream_id",), order: str = "seq") -> DataFrame:
    """``units`` with prefix, code, role (predicted, key, header, picture, slice, extension, other) and picture type.

    For MPEG-1 and 2 a slice is predicted by the latest picture header of its stream before it.
    """
    n = F.col("prefix")
    rows = units.withColumn("prefix", prefix_length(data)).withColumn("code", F.when((n > 0) & (F.length(data) > n), byte_at(data, n)))
    code = F.col("code")
    if codec == "h264":
        kind = code.bitwiseAND(F.lit(31))
        role = F.when(kind == 1, "predicted").when(kind == 5, "key").when(kind.isin(7, 8), "header")
        return rows.withColumns({"role": F.coalesce(role, F.lit("other")), "picture": F.lit(None).cast("string")})
    if codec == "hevc":
        kind = F.shiftright(code, 1).bitwiseAND(F.lit(63))
        role = F.when(kind < 16, "predicted").when(kind < 24, "key").when(kind.between(32, 34), "header")
        return rows.withColumns({"role": F.coalesce(role, F.lit("other")), "picture": F.lit(None).cast("string")})
    if codec == "mpeg4":
        bits = F.when((code == 0xB6) & (F.length(data) > n + 1), F.shiftright(byte_at(data, n + 1), 6))
        picture = F.when(bits == 0, "I").when(bits == 1, "P").when(bits == 2, "B").when(bits == 3, "S")
        role = F.when(picture == "I", "key").when(picture.isNotNull(), "predicted").when(code.isin(0xB0, 0xB2, 0xB3, 0xB5) | code.between(0x20, 0x2F), "header")
        return rows.withColumns({"role": F.coalesce(role, F.lit("other")), "picture": picture})
    if codec not in ("mpeg1", "mpeg2"):
        raise ValueError("a codec is one of h264, hevc, mpeg4, mpeg1, mpeg2")
    bits = F.when((code == 0) & (F.length(data) > n + 2), F.shiftright(byte_at(data, n + 2), 3).bitwiseAND(F.lit(7)))
    picture = F.when(bits == 1, "I").when(bits == 2, "P").when(bits == 3, "B").when(bits == 4, "D")
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    current = F.last(F.when(code == 0, F.coalesce(picture, F.lit(""))), ignorenulls=True).over(by)
    rows = rows.withColumns({"picture": picture, "_current": current})
    role = (
        F.when(code == 0, "picture").when(code.between(1, 0xAF), F.when(F.col("_current").isin("P", "B", "D"), "predicted").otherwise("slice"))
        .when(code == 0xB5, "extension").when(code.isin(0xB2, 0xB3, 0xB7, 0xB8), "header")
    )
    return rows.withColumn("role", F.coalesce(role, F.lit("other"))).drop("_current")
