"""Text functions: names, ids, labels and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing_number(name: Column) -> Column:
    """The number that ends a file's stem; null if there is none."""
    digits = F.regexp_extract(name, r"(\d+)(?:\.[^./]*)?$", 1)
    return F.when(digits != "", digits.cast("long"))


def numbered(prefix: str, number: Column, width: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def first_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def same_object(first: Column, second: Column) -> Column:
    """The object of two paths; an error when it is read if they have none or two."""
    a, b = first_segment(first), first_segment(second)
    return F.when((a != "") & (a == b), a).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not one object:"), first, second)).cast("string"))


def number_label(x: Column) -> Column:
    """A threshold as text: whole numbers without a fraction, others as short as they are."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def setting_label(stage: str, **settings) -> str:
    """A label of a stage and its settings in their order."""
    return ":".join([stage, *(f"{k}={v:g}" if isinstance(v, float) else f"{k}={v}" for k, v in settings.items())])


def stable_hash(seed: int | str, *tokens: Column) -> Column:
    """The first 8 bytes of SHA-256 of ``seed:token:...`` as an unsigned number, decimal(20,0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *(t.cast("string") for t in tokens)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def plain_number(x: Column) -> Column:
    """A double without negative zero; null if not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x + F.lit(0.0))


def alias_label(key: Column, names: dict[str, str]) -> Column:
    """Publication name of a key, or the key itself."""
    if not names:
        return key
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key], key)
