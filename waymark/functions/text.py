"""Column builders for parameter strings, ids, paths and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def params_map(s: Column) -> Column:
    """Map of a 'k:v;k:v;' string; the first ':' of an entry separates, empty entries are ignored, of a repeated key the last
    entry stays."""
    entries = F.filter(F.transform(F.split(s, ";"), lambda e: F.struct(F.substring_index(e, ":", 1).alias("k"), F.when(F.locate(":", e) > 0, F.substr(e, F.locate(":", e) + 1)).alias("v"))), lambda e: e["k"] != "")
    later = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["k"] == e["k"])
    return F.map_from_entries(F.filter(entries, later))


def param(m: Column, key: str, default: float) -> Column:
    return F.coalesce(m.getItem(key).try_cast("double"), F.lit(default))


def map_time(map_id: Column) -> Column:
    """Time in a map_YYYYMMDD_HHMMSS id, null for any other id."""
    return F.try_to_timestamp(F.regexp_extract(map_id, r"^map_(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def upload_path(path: Column, prefix: str, base: str) -> Column:
    """Paths under ``prefix`` moved to ``base`` by their last part; others stay."""
    return F.when(path.startswith(prefix), F.concat(F.lit(base), F.element_at(F.split(path, "/"), -1))).otherwise(path)


def pose_string(s: Column) -> Column:
    """Array of the three numbers in 'x,y,z', null unless there are exactly three."""
    parts = F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == 3) & ~F.exists(parts, lambda x: x.isNull()), parts)


def sanitized(c: Column, kind: T.DataType, most: int) -> Column:
    """A value as logs may show it: long strings and binaries in it, at any depth of structs, arrays and maps, become their
    lengths."""
    if isinstance(kind, T.StringType):
        return shortened(c, most)
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>")))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sanitized(x, kind.elementType, most))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: sanitized(v, kind.valueType, most))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[sanitized(c[f.name], f.dataType, most).alias(f.name) for f in kind.fields]))
    return c


def shortened(s: Column, most: int) -> Column:
    """Long values in logs are replaced by their length."""
    return F.when(F.length(s) > most, F.concat(F.lit("<"), F.length(s).cast("string"), F.lit(" chars>"))).otherwise(s)


#: Frames that a chunk may hold: an index is chunk * CHUNK_FRAMES + place.
CHUNK_FRAMES = 1000


def padded(n: Column, width: int) -> Column:
    """A number with zeros before it up to ``width`` digits; longer ones stay whole."""
    digits = n.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(digits), F.lit(0))), digits)


def frame_name(index: Column) -> Column:
    """The file name, without suffix, of a frame of a session."""
    return padded(index, 6)


def chunk_name(chunk: Column) -> Column:
    return F.concat(F.lit("chunk_"), padded(chunk, 4), F.lit(".json"))


def params_string(m: Column) -> Column:
    """The 'k:v;k:v;' string of a map, in key order; the inverse of ``params_map``."""
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"], F.lit(";")))
    return F.array_join(entries, "")


def params_yaml(m: Column) -> Column:
    """A line 'key: "value"' for each entry of a map, in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(': "'), e["value"], F.lit('"'))), "\n")


def in_namespaces(key: Column, namespaces: list[str]) -> Column:
    """Whether a parameter's key begins with one of the namespaces 'Name/'; a name given without the slash gets one."""
    return F.coalesce(F.greatest(*[key.startswith(n if n.endswith("/") else f"{n}/") for n in namespaces], F.lit(False)), F.lit(False))


def ns_to_ms(ns: Column) -> Column:
    """Whole milliseconds, towards zero."""
    return F.call_function("div", ns, F.lit(1_000_000))


def stamp_seconds(ms: Column) -> Column:
    """Seconds of a millisecond stamp; 0 without a positive one."""
    return F.when(ms > 0, ms / 1000.0).otherwise(F.lit(0.0))


def pending(frames: Column, uploaded: Column) -> Column:
    return F.greatest(frames - uploaded, F.lit(0))


def decimal_text(x: Column) -> Column:
    """A double's shortest digits as Python prints them: no exponent from 0.0001 to 10^16, a ".0" behind whole numbers, and an
    exponent of two digits at least outside.  Null for null; nan and inf by name.  From 10^16 on a digit more than needed is
    possible."""
    # 15 to 17 digits are the shortest form if they read back as the same number; Java's own text may have more
    forms = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
    digits = F.coalesce(*[F.when(f.try_cast("double") == x, f) for f in forms], forms[-1])
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(digits, "e", 1), "0+$", ""), r"\.$", "")
    power = F.substring_index(digits, "e", -1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(digits.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    far = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), padded(F.abs(power), 2))
    size = F.abs(x)
    named = F.lower(F.regexp_replace(x.cast("string"), "Infinity", "inf"))
    return F.when(F.isnan(x) | (size == float("inf")), named).when(x == 0, x.cast("string")).when((size >= 1e-4) & (size < 1e16), plain).otherwise(far)


def tum_line(stamp: Column, place: list[Column], turn: list[Column]) -> Column:
    """'ts tx ty tz qx qy qz qw' of a pose."""
    return F.concat_ws(" ", *[decimal_text(c.cast("double")) for c in (stamp, *place, *turn)])


def session_id(at: Column, seed: Column) -> Column:
    """session_<yyyyMMdd_HHmmss>_<8 hex digits> of a time and whatever tells sessions of one second apart."""
    return F.concat(F.lit("session_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(seed.cast("string")), 1, 8))


def valid_request(name: Column, images: Column, most: int) -> Column:
    """Whether a request has a name that isn't blank and 1 to ``most`` images."""
    return F.coalesce((F.trim(name) != "") & F.size(images).between(1, most), F.lit(False))
