"""Names of applications, blocks and files of an exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_app_id(app_id: Column) -> Column:
    """The digits of an application id as a number; null without digits or with over eighteen."""
    return F.nullif(F.regexp_replace(app_id, r"\D", ""), F.lit("")).try_cast("long")


def object_key(app_id: Column, shuffle_id: Column) -> Column:
    return F.concat(app_id, shuffle_id.cast("string"))


def parse_block(name: Column) -> Column:
    """shuffle_<shuffle>_<map>_<reduce> to a struct; null if the name has another form."""
    ok = name.rlike(r"^shuffle_\d+_\d+_\d+$")
    part = lambda k, kind: F.get(F.split(name, "_"), F.lit(k)).try_cast(kind)
    return F.when(ok, F.struct(part(1, "int").alias("shuffle_id"), part(2, "long").alias("map_id"), part(3, "int").alias("reduce_id")))


def file_path(root: Column, app_id: Column, shuffle_id: Column, map_id: Column, kind: str) -> Column:
    """Path of a map output's data or index file."""
    return F.format_string(f"%s/%s/%d_%d.{kind}", root, app_id, shuffle_id, map_id)


def spill_key(map_id: Column, sequence: Column) -> Column:
    return F.concat_ws("_", map_id.cast("string"), sequence.cast("string"))


def host(uri: Column) -> Column:
    return F.try_parse_url(uri, F.lit("HOST"))


def byte_size(text: Column) -> Column:
    """A size such as 30m in bytes; a bare number is bytes; null if it cannot be read."""
    form = r"^\s*(\d+)\s*([kmgtp]?)i?b?\s*$"
    number = F.nullif(F.regexp_extract(F.lower(text), form, 1), F.lit("")).try_cast("long")
    scales = F.create_map(*[F.lit(x) for k, unit in enumerate(["", "k", "m", "g", "t", "p"]) for x in (unit, 1024**k)])
    return number * scales[F.regexp_extract(F.lower(text), form, 2)]
