"""Rules over ordered units (stream_id, seq, kind, …): drops, repeats, references to the previous unit, payload edits.

``kind`` is header, key or predicted. Order is per stream; the windows need the rows of one stream together, as the
rules do, and streams are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.scalars import every
from frameloom.operators.unit_columns import classified


def _over(order: str = "seq") -> Window:
    return Window.partitionBy("stream_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def ordinals(units: DataFrame) -> DataFrame:
    """``units`` with key_no and predicted_no: how many of that kind the stream has had."""
    return units.withColumns({f"{k}_no": F.count_if(F.col("kind") == k).over(_over()) for k in ("key", "predicted")})


#: Start codes and first bytes of the units that events become: parameter sets, a keyframe slice, a predicted one.
HEADER_BYTES = (0x67, 0x68, 0x47)
KEY_UNIT, PREDICTED_UNIT = "00000165", "0000000141"


def from_events(events: DataFrame) -> DataFrame:
    """Events as H.264 units (stream_id, seq, event_id, data, payload): sign-ups are parameter sets, purchases keyframe
    slices, the others predicted slices; the payload is ``props``."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    header = F.array(*(F.lit(f"00000001{b:02x}") for b in HEADER_BYTES))
    front = F.when(F.col("event_type") == "signup", F.get(header, (F.col("event_id") % 3).cast("int"))).when(F.col("event_type") == "purchase", F.lit(KEY_UNIT)).otherwise(F.lit(PREDICTED_UNIT))
    payload = F.col("props").cast("binary")
    return events.select(F.col("user_id").alias("stream_id"), seq.cast("long").alias("seq"), "event_id", F.concat(F.unhex(front), payload).alias("data"), payload.alias("payload"))


def kinds(units: DataFrame, codec: str = "h264") -> DataFrame:
    """Units (…, data) with the ``kind`` that their bytes say: header, key or predicted."""
    rows = classified(units, codec)
    return rows.withColumn("kind", F.when(F.col("role").isin("header", "key"), F.col("role")).otherwise("predicted")).drop("prefix", "role", "picture")


def drop_keyframes(units: DataFrame, passed: int, recover: int) -> DataFrame:
    """The first ``passed`` keyframes stay, later ones at each ``recover``-th."""
    k = F.col("key_no")
    return ordinals(units).filter((F.col("kind") != "key") | (k <= passed) | every(recover, k - passed))


def drop_every(units: DataFrame, n: int) -> DataFrame:
    """Each n-th predicted unit goes; it has been counted."""
    return ordinals(units).filter((F.col("kind") != "predicted") | ~every(n, "predicted_no"))


def first_headers(units: DataFrame, header: Column) -> DataFrame:
    """The first header of each kind stays."""
    first = F.row_number().over(Window.partitionBy("stream_id", "header").orderBy("seq"))
    marked = units.withColumn("header", F.when(F.col("kind") == "header", header.cast("int")))
    return marked.withColumn("no", first).filter(F.col("header").isNull() | (F.col("no") == 1)).drop("no")


def carried(units: DataFrame, what: Column, name: str) -> DataFrame:
    """The latest non-null value so far, by stream."""
    return units.withColumn(name, F.last(what, ignorenulls=True).over(_over()))


def skip_pictures(units: DataFrame, picture: Column, passed: int, recover: int) -> DataFrame:
    """Pictures of type I beyond ``passed`` go, each with its units up to the next picture header."""
    rows = units.withColumn("picture", picture)
    rows = rows.withColumn("i_no", F.count_if(F.col("picture") == "I").over(_over()))
    keep = (F.col("i_no") <= passed) | every(recover, F.col("i_no") - passed)
    rows = carried(rows, F.when(F.col("picture").isNotNull(), F.when(F.col("picture") == "I", ~keep).otherwise(F.lit(False))), "skipped")
    return rows.filter(~F.coalesce("skipped", F.lit(False)))


def with_previous(units: DataFrame, drop_n: int = 0) -> DataFrame:
    """Predicted units that are not dropped, each with the payload of the one before it, unedited."""
    rows = ordinals(units).filter(F.col("kind") == "predicted").filter(~every(drop_n, "predicted_no"))
    return rows.withColumn("previous", F.lag("payload").over(Window.partitionBy("stream_id").orderBy("seq")))


def echo_and_repeat(units: DataFrame, echo_n: int, echoes: int, repeat_n: int, repeats: int) -> DataFrame:
    """Copies of predicted units (stream_id, seq, copy, source_seq): echoes of the previous unit first, then the unit
    and its repeats."""
    rows = ordinals(units).withColumn("before", F.last(F.when(F.col("kind") == "predicted", F.col("seq")), ignorenulls=True).over(Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    predicted = F.col("kind") == "predicted"
    echo = F.when(predicted & every(echo_n, "predicted_no") & F.col("before").isNotNull(), F.array_repeat("before", echoes)).otherwise(F.array().cast("array<bigint>"))
    own = F.array_repeat("seq", F.when(predicted & every(repeat_n, "predicted_no"), 1 + repeats).otherwise(1))
    return rows.select("stream_id", "seq", F.posexplode(F.concat(echo, own)).alias("copy", "source_seq"))


def replaced(units: DataFrame, n: int) -> DataFrame:
    """Each n-th predicted unit becomes the one before it."""
    rows = with_previous(units)
    hit = every(n, "predicted_no") & F.col("previous").isNotNull()
    return rows.select("stream_id", "seq", F.when(hit, F.col("previous")).otherwise(F.col("payload")).alias("payload"), hit.alias("replaced"))


def donors(units: DataFrame, stream: int, size: int) -> DataFrame:
    """The bank (slot, donor) of the last ``size`` predicted units of a stream: a table of at most ``size`` rows."""
    last = units.filter((F.col("stream_id") == stream) & (F.col("kind") == "predicted")).orderBy(F.col("seq").desc()).limit(size)
    slot = F.row_number().over(Window.orderBy("seq")) - 1
    return last.select(slot.cast("long").alias("slot"), F.col("payload").alias("donor"), F.count("*").over(Window.partitionBy()).alias("bank"))


def with_donor(units: DataFrame, bank: DataFrame) -> DataFrame:
    """Each predicted unit with the donor that its ordinal picks."""
    rows = ordinals(units).filter(F.col("kind") == "predicted")
    size = bank.agg(F.max("bank").alias("bank"))
    slot = (F.col("predicted_no") * 1103515245 + F.col("bank")) % F.col("bank")
    return rows.crossJoin(F.broadcast(size)).withColumn("slot", slot).join(F.broadcast(bank.drop("bank")), "slot")


def shifted_address(address: Column, by: int) -> Column:
    """A slice address in 1 to 175, moved around."""
    return F.pmod(address - 1 + by, F.lit(175)) + 1


def address_dropped(address: Column, n: int, phase: int) -> Column:
    return F.lit(False) if n == 0 else (address - 1) % n == phase % n


def truncated(payload: Column, amount: int) -> Column:
    """Without its last ``amount`` bytes, but for one."""
    n = F.length(payload)
    return F.when((amount == 0) | (n <= 1), payload).otherwise(F.substring(payload, F.lit(1), n - F.least(F.lit(amount), n - 1)))


def _overlap(payload: Column, other: Column, amount: int) -> Column:
    return F.least(F.lit(amount), F.length(payload), F.length(other))


def spliced(payload: Column, other: Column, seed: Column, amount: int) -> Column:
    """``amount`` bytes of another payload in place of as many."""
    k = _overlap(payload, other, amount)
    to = (seed * 3) % (F.length(payload) - k + 1)
    at = (seed * 5 + 1) % (F.length(other) - k + 1)
    out = F.concat(F.substring(payload, F.lit(1), to), F.substring(other, at + 1, k), F.substring(payload, to + k + 1, F.length(payload)))
    return F.when(other.isNull() | (k <= 0), payload).otherwise(out)


def grown(payload: Column, other: Column, seed: Column, amount: int) -> Column:
    """``amount`` bytes of another payload put in between."""
    k = F.least(F.lit(amount), F.length(other))
    at = (seed * 7 + 3) % (F.length(other) - k + 1)
    to = (seed * 11) % (F.length(payload) + 1)
    out = F.concat(F.substring(payload, F.lit(1), to), F.substring(other, at + 1, k), F.substring(payload, to + 1, F.length(payload)))
    return F.when(other.isNull() | (k <= 0), payload).otherwise(out)


def rotated_window(payload: Column, seed: Column, amount: int) -> Column:
    """A seeded window of ``amount`` bytes rotated right by a seeded number."""
    n = F.length(payload)
    k = F.least(F.lit(amount), n)
    at = seed % (n - k + 1)
    by = F.floor(seed / 3) % (k - 1) + 1
    out = F.concat(F.substring(payload, F.lit(1), at), F.substring(payload, at + k - by + 1, by), F.substring(payload, at + 1, k - by), F.substring(payload, at + k + 1, n))
    return F.when(k < 2, payload).otherwise(out)


def mutation_counts(units: DataFrame, drop_n: int, echo_n: int, repeat_n: int, repeats: int) -> DataFrame:
    """Counters by stream."""
    p = F.col("kind") == "predicted"
    rows = ordinals(units)
    kept = p & ~every(drop_n, "predicted_no")
    return rows.groupBy("stream_id").agg(
        F.count("*").alias("units_in"), F.count_if(F.col("kind") == "key").alias("keys_seen"), F.count_if(p).alias("predicted_seen"),
        F.count_if(p & every(drop_n, "predicted_no")).alias("predicted_dropped"), F.count_if(kept & every(echo_n, "predicted_no")).alias("echo_points"),
        (F.count_if(kept & every(repeat_n, "predicted_no")) * repeats).alias("predicted_repeated"), F.sum(F.length("payload")).cast("long").alias("bytes_in"),
    )
