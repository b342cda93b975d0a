"""String cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# Java's parseFloat also takes a type suffix; Spark's cast follows it.
_QUOTED = r'^"(.+)"$'


def _unquote(c: Column) -> Column:
    return F.when(
        c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
        F.substring(c, F.lit(2), F.length(c) - 2),
    ).otherwise(c)


def parse_number(c: Column | str) -> Column:
    """Trim and unquote; empty or ``na`` is missing; unreadable is NULL too
    (see :func:`number_error` for telling the two apart)."""
    body = F.trim(_unquote(F.trim(col(c))))
    value = F.expr("NULL").cast("double")
    return F.when((body == "") | (F.lower(body) == "na"), value).otherwise(
        F.nanvl(body.try_cast("double"), value)
    )


def number_error(c: Column | str) -> Column:
    body = F.trim(_unquote(F.trim(col(c))))
    return (
        (body != "") & (F.lower(body) != "na") & body.try_cast("double").isNull()
    )


def clean_feature_name(c: Column | str, strict: bool = True) -> Column:
    """Strip one pair of surrounding double quotes; an empty name is an error
    (or NULL with ``strict=False``)."""
    name = F.trim(_unquote(F.trim(col(c))))
    empty = F.raise_error(F.lit("empty feature name")) if strict else F.lit(None)
    return F.when(name != "", name).otherwise(empty.cast("string"))


def split_fields(line: Column | str, width: Column | int | None = None) -> Column:
    """Tab split that keeps inner empty fields, pads short rows to ``width``
    and drops empty fields beyond it."""
    parts = F.transform(F.split(col(line), "\t", -1), lambda x: F.trim(x))
    if width is None:
        return parts
    width = F.lit(width) if isinstance(width, int) else width
    pad = F.array_repeat(F.lit(""), F.greatest(width - F.size(parts), F.lit(0)))
    head = F.slice(parts, F.lit(1), width)
    tail = F.filter(
        F.slice(parts, width + 1, F.greatest(F.size(parts) - width, F.lit(0))),
        lambda x: x != "",
    )
    return F.concat(head, pad, tail)


def is_null_token(c: Column | str) -> Column:
    body = F.trim(col(c))
    return body.isNull() | (body == "") | (F.upper(body) == "NULL")


def is_na_token(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))) == "na", F.lit(False))


def base_name(c: Column | str) -> Column:
    """``file#set`` -> set; a plain path -> its file name."""
    c = col(c)
    parts = F.filter(F.split(c, "#"), lambda x: x != "")
    aux = F.element_at(parts, -1)
    return F.when(c.contains("#"), aux).otherwise(F.element_at(F.split(c, "/"), -1))


def collection_version(
    path: Column | str, extension: str, known_hosts: Sequence[str] = ()
) -> Column:
    """``struct(version, species)`` read off the file name.

    The version is the text from the last ``v`` up to ``extension``; it is
    trusted only where the path names one of ``known_hosts``, else both fields
    are NULL (an unknown version equals no other)."""
    path = col(path)
    stop = F.length(path) - F.length(
        F.element_at(F.split(path, extension.replace(".", r"\.")), -1)
    ) - len(extension)
    stem = F.substring(path, F.lit(1), stop)
    version = F.concat(F.lit("v"), F.element_at(F.split(stem, "v"), -1))
    trusted = F.lit(False)
    for host in known_hosts:
        trusted = trusted | F.lower(path).contains(host.lower())
    trusted = trusted & path.contains(extension) & stem.contains("v")
    version = F.when(trusted, version)
    species = F.when(version.contains("Mm"), "mouse").when(version.isNotNull(), "human")
    return F.struct(version.alias("version"), species.alias("species"))
