"""Column expressions of the frame format, message ids and routing; nothing here leaves the JVM.

A frame is big-endian: u8 type, u16 part number (from 1), u16 part count, u16 id
length, id, 4 hex characters of checksum, u16 payload length, payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
MESSAGE, ERROR, STATUS, KEY_EXCHANGE, DEBUG, MULTIPART, CLEARTEXT = range(7)
GZIP, ZSTD = 32, 64
OVERHEAD = 13
MAX_U16 = 65535


def checksum(payload: Column) -> Column:
    """Last four hex digits of the payload's MD5."""
    return F.right(F.md5(payload), F.lit(4))


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def uint(value: Column, size: int) -> Column:
    """Big-endian bytes of a non-negative number."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def number(data: Column, start: Column, size: int) -> Column:
    """Big-endian number of size bytes from a zero-based place."""
    return F.conv(F.hex(F.substring(data, start + 1, F.lit(size))), 16, 10).cast("int")


def capacity(mtu: int, id: Column) -> Column:
    return F.lit(mtu - OVERHEAD) - F.octet_length(id)


def part_count(size: Column, cap: Column, compat: bool = False) -> Column:
    """Frames of a payload. compat declares one more when the size is a multiple of the capacity, as old senders do."""
    full = F.floor(size / cap).cast("int")
    return full + 1 if compat else F.greatest(F.lit(1), full + F.when(full * cap < size, 1).otherwise(0)).cast("int")


def frame(type: Column, part: Column, parts: Column, id: Column, payload: Column) -> Column:
    name = id.cast("binary")
    return F.concat(uint(type, 1), uint(part, 2), uint(parts, 2), uint(F.octet_length(id), 2), name, checksum(payload).cast("binary"), uint(F.octet_length(payload), 2), payload)


def fragment(df: DataFrame, mtu: int, compat: bool = False) -> DataFrame:
    """(id, part_no, n_parts, frame) of rows (id, type, value), with any other columns; an empty value is one empty frame.

    A frame whose id leaves no room for payload, or exceeds a u16 field, is an error.
    """
    size, cap = F.octet_length("value"), capacity(mtu, F.col("id"))
    sent = F.greatest(F.lit(1), F.ceil(size / cap)).cast("int")
    sound = F.when((cap > 0) & (F.octet_length("id") <= MAX_U16) & (F.lit(mtu) <= MAX_U16) & (sent <= MAX_U16), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("frame does not fit: "), F.col("id"))).cast("boolean"))
    rows = df.filter(sound).withColumns({"_cap": cap, "_sent": sent, "n_parts": part_count(size, cap, compat), "_value": F.col("value")})
    rows = rows.withColumn("part_no", F.explode(F.sequence(F.lit(1), F.col("_sent"))))
    payload = F.substring(F.col("_value"), (F.col("part_no") - 1) * F.col("_cap") + 1, F.col("_cap"))
    rows = rows.withColumn("frame", frame(F.col("type"), F.col("part_no"), F.col("n_parts"), F.col("id"), payload))
    return rows.drop("_cap", "_sent", "_value", "value")


def parse(df: DataFrame, max_parts: int = 4096) -> DataFrame:
    """df (with a binary column frame) and type, part_no, n_parts, id, checksum, payload, error; a bad frame has error alone."""
    f = F.col("frame")
    size = F.octet_length(f)
    id_size = number(f, F.lit(5), 2)
    n_parts, part = number(f, F.lit(3), 2), number(f, F.lit(1), 2)
    given = F.substring(f, id_size + 8, F.lit(4)).cast("string")
    payload_size = number(f, id_size + 11, 2)
    payload = F.substring(f, id_size + OVERHEAD + 1, payload_size)
    error = (
        F.when(f.isNull() | (size < OVERHEAD), "too short")
        .when(n_parts > max_parts, "too many parts")
        .when(id_size + OVERHEAD > size, "bad id length")
        .when(id_size + OVERHEAD + payload_size != size, "bad length")
        .when(given != checksum(payload), "bad checksum")
    )
    fields = {"type": number(f, F.lit(0), 1).cast("smallint"), "part_no": part, "n_parts": n_parts, "id": F.substring(f, F.lit(8), id_size).cast("string"), "checksum": given, "payload": payload}
    # Fields depend on the error, so that a bad frame has none; its own column keeps the CASE from being repeated.
    rows = df.withColumn("error", error)
    return rows.withColumns({n: F.when(F.col("error").isNull(), c) for n, c in fields.items()})


def is_type(type: Column, code: int) -> Column:
    """Types from 32 on are bit flags; smaller ones are compared with the flags masked out for code 0 to 31."""
    return type.bitwiseAND(code) == code if code >= 32 else F.when(type < 32, type == code).otherwise(type.bitwiseAND(F.lit(code)) == code)


def merge_flag(type: Column, flag: int) -> Column:
    return type.bitwiseOR(flag)


def reassemble(parsed: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, type, value, complete) of parsed frames with arrival: the last payload of each part, the first part count; parts grouped once.

    Exact when a message's frames come in one go; repeated deliveries in time order are the streaming operator's.
    """
    one = parsed.filter("error IS NULL").groupBy(*keys, "part_no").agg(F.max_by("payload", "arrival").alias("payload"), F.min_by("n_parts", "arrival").alias("n_parts"), F.min("arrival").alias("first"), F.min_by("type", "arrival").alias("type"))
    got = one.groupBy(*keys).agg(
        F.min_by("n_parts", "first").alias("n_parts"),
        F.max_by("type", "first").alias("type"),
        F.array_sort(F.collect_list(F.struct("part_no", "payload"))).alias("parts"),
    )
    # Parts beyond the count are kept apart, parts 1 to n must all be there.
    own = F.filter("parts", lambda p: p["part_no"].between(1, F.col("n_parts")))
    complete = (F.size(own) == F.col("n_parts")) & (F.col("n_parts") > 0)
    # Joined in one go: a fold would copy the message for each part.
    value = F.unhex(F.array_join(F.transform(own, lambda p: F.hex(p["payload"])), ""))
    return got.select(*keys, "type", F.when(complete, value).alias("value"), complete.alias("complete"))


def split_id(id: Column) -> Column:
    """(topic, partition, offset) of an id of exactly three parts, else null."""
    p = F.split(id, "_", -1)
    return F.when(F.size(p) == 3, F.struct(p[0].alias("topic"), p[1].alias("partition"), p[2].alias("offset")))


_ID = r"^([^_]*)_([+-]?[0-9]+)_([+-]?[0-9]+)_*$"


def dedup_id(id: Column, rightmost: bool = False) -> Column:
    """Struct (topic STRING, part INT, off BIGINT) of a standard id, else null: trailing separators are dropped, numbers must be in range.

    rightmost also takes ids whose topic has separators.
    """
    pattern = r"^(.*)_([+-]?[0-9]+)_([+-]?[0-9]+)$" if rightmost else _ID
    part, off = F.regexp_extract(id, pattern, 2).try_cast("int"), F.regexp_extract(id, pattern, 3).try_cast("long")
    return F.when(part.isNotNull() & off.isNotNull(), F.struct(F.regexp_extract(id, pattern, 1).alias("topic"), part.alias("part"), off.alias("off")))


def make_id(topic: Column, part: Column, off: Column) -> Column:
    return F.concat_ws("_", topic, part, off)


def translate(topic: Column, names: dict[str, str]) -> Column:
    """Topic by a small map, else itself."""
    if not names:
        return topic
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, topic), topic)


def shift_partition(part: Column, start: int) -> Column:
    """part + start; out of int range is an error."""
    moved = part.cast("long") + start
    return F.when(moved.between(-(2**31), 2**31 - 1), moved.cast("int")).otherwise(F.raise_error("partition out of range").cast("int"))


def unshift_partition(part: Column, start: int) -> Column:
    """The partition at the source; -1 stays, and what would be negative is null."""
    return F.when(part == -1, part).when(part - start >= 0, part - start)


def fallback(id: Column, topic: str) -> tuple[Column, Column]:
    """Topic and partition to write to: those of the id, or the configured topic and partition 0."""
    got = split_id(id)
    part = got["partition"].try_cast("int")
    return F.when(part.isNotNull(), got["topic"]).otherwise(F.lit(topic)), F.coalesce(part, F.lit(0))


def format_range(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo, hi))


def route(type: Column) -> Column:
    """Where a message goes, in the order in which receivers test."""
    return (
        F.when(is_type(type, CLEARTEXT), "clear")
        .when(type == KEY_EXCHANGE, "keys")
        .when(type == ERROR, "errors")
        .when(type == MULTIPART, "drop")
        .when(is_type(type, MESSAGE), "decrypt")
        .otherwise("internal")
    )


def encrypt(value: Column, key: Column, id: Column | None = None) -> Column:
    """AES-GCM with a 12-byte nonce in front: random, or with an id drawn from key, id and value.

    The latter gives the same bytes again when a task runs anew, so that frames of two attempts fit together;
    different messages have different nonces but for chances of a 96-bit hash.
    """
    if id is None:
        return F.aes_encrypt(value, key, F.lit("GCM"))
    nonce = F.substring(F.unhex(F.sha2(F.concat(key, F.unhex(F.sha2(id.cast("binary"), 256)), value), 256)), 1, 12)
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), nonce)


def decrypt(value: Column, key: Column) -> Column:
    """Null where the key or the data is wrong."""
    return F.try_aes_decrypt(value, key, F.lit("GCM"))


def parse_time(text: Column) -> Column:
    """Timestamp of RFC 3339 text or of yyyy-MM-ddTHH:mm:ss with an offset; null for anything else."""
    sound = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(sound, text.try_cast("timestamp"))
