"""Control streams: text messages, signals mapped onto the macro controls, and a reset trigger with hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.scalars import clamp


def messages(rows: DataFrame, text: str = "message", keys: tuple[str, ...] = ("frame_no",)) -> DataFrame:
    """Lines of control messages as events (keys, line_no, verb, name, value).

    Lines are ``preset name``, ``set id value`` or ``id=value``, ``controls i m r t b``, ``reset-controls``,
    ``reset`` and longer words that begin so, ``ping``. Empty lines and those after ``#`` give nothing, other lines
    the verb ``error`` with the line as name.
    """
    lines = rows.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    line = F.trim("line")
    lines = lines.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    words = F.split("line", r"\s+")
    pair = F.split("line", "=")
    verb = F.lower(words[0])
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    parsed = lines.withColumns({"w": words, "p": pair, "v": verb, "is_pair": F.instr("line", "=") > 0})
    is_set = ~F.col("is_pair") & (F.col("v") == "set") & (F.size("w") == 3)
    kind = (
        F.when(F.col("is_pair"), F.when(number("trim(p[1])").isNotNull() & (F.size("p") == 2), "set").otherwise("error"))
        .when(is_set, F.when(number("w[2]").isNotNull(), "set").otherwise("error"))
        .when((F.col("v") == "preset") & (F.size("w") == 2), "preset")
        .when((F.col("v") == "controls") & (F.size("w") >= 2) & (F.size("w") <= 6), "controls")
        .when(F.col("v") == "reset-controls", "reset-controls")
        .when(F.col("v").startswith("reset") & (F.size("w") == 1), "reset")
        .when((F.col("v") == "ping") & (F.size("w") == 1), "ping")
        .otherwise("error")
    )
    parsed = parsed.withColumn("verb", kind)
    name = F.when(F.col("verb") == "error", F.col("line")).when((F.col("verb") == "set") & F.col("is_pair"), F.trim(F.col("p")[0])).when(F.col("verb").isin("set", "preset"), F.col("w")[1]).when(F.col("verb") == "controls", F.array_join(F.slice("w", 2, 5), " "))
    value = F.when((F.col("verb") == "set") & F.col("is_pair"), number("trim(p[1])")).when(F.col("verb") == "set", number("w[2]"))
    return parsed.select(*keys, "line_no", "verb", name.alias("name"), value.alias("value"))


def mapped(base: float, sample: Column, amount: float, gain: float = 1.0, bias: float = 0.0) -> Column:
    """A macro control moved toward a signal, held to 0…8 and then to the engine's 0…2."""
    moved = F.lit(base * (1 - amount)) + (sample * F.lit(gain) + F.lit(bias)) * F.lit(amount)
    return clamp(clamp(moved, 0.0, 8.0), 0.0, 2.0)


def latest(frames: DataFrame, signal: DataFrame, keys: tuple[str, ...], value: str = "sample") -> DataFrame:
    """Each frame (keys, at) with the last sample (keys, at, value) at or before it: one union and one window over
    both, so no pair of rows is made. Of samples at one time the greatest counts."""
    marked = frames.select(*keys, "at", F.lit(1).alias("_frame"), F.lit(None).cast("double").alias("_v"))
    marked = marked.unionByName(signal.select(*keys, "at", F.lit(0).alias("_frame"), F.col(value).cast("double").alias("_v")))
    by = Window.partitionBy(*keys).orderBy("at", "_frame", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(value, F.last("_v", ignorenulls=True).over(by)).filter("_frame = 1").select(*keys, "at", value)


def resets(rows: DataFrame, keys: tuple[str, ...], value: str, threshold: float, rearm: float) -> DataFrame:
    """Rows (keys, at) with ``fires``: the value is at the threshold or over for the first time since it was at the
    re-arm level or under, or since the start."""
    by = Window.partitionBy(*keys).orderBy("at")
    state = F.when(F.col(value) >= threshold, 1).when(F.col(value) <= rearm, 0)
    before = F.last("_state", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_state", state)
    return marked.withColumn("fires", F.coalesce((F.col("_state") == 1) & (F.coalesce(before, F.lit(0)) == 0), F.lit(False))).drop("_state")
