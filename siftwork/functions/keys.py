"""Fingerprints and family keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Family keys: which suffixes of a file's stem are cut off, and whether case counts.
FAMILY_MODES = ("marker_and_augment", "marker_and_augment_lower", "last_marker", "name_lower")
#: What copies of a picture carry in their names.
MARKER, AUGMENT, LAST_MARKER = ".rf.", r"(?i)[_-]aug(?:mented)?[_-]?\d+$", r"(?i)\.rf\.[^.]+$"


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def sha1_prefix(content: Column, n: int) -> Column:
    """The first ``n`` hex digits of the SHA-1."""
    return F.substring(F.sha1(content.cast("binary")), 1, n)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """A file's name without its last extension; a leading point is no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def family(path: Column, source: Column | None = None, mode: str = "marker_and_augment", separator: str = ":") -> Column:
    """The key that related files share.

    ``marker_and_augment``: the stem before the first ``.rf.``, less an augmentation suffix.
    ``marker_and_augment_lower``: the same in lower case. ``last_marker``: the stem less a last
    ``.rf.`` part. ``name_lower``: the whole name in lower case before the first ``.rf.``.
    """
    if mode not in FAMILY_MODES:
        raise ValueError(f"mode must be one of {FAMILY_MODES}")
    if mode == "name_lower":
        key = F.substring_index(F.lower(base_name(path)), MARKER, 1)
    elif mode == "last_marker":
        key = F.regexp_replace(stem(path), LAST_MARKER, "")
    else:
        key = F.regexp_replace(F.substring_index(stem(path), MARKER, 1), AUGMENT, "")
        key = F.lower(key) if mode.endswith("lower") else key
    return key if source is None else F.concat(source, F.lit(separator), key)


def grid_bits(grid: Column, width: int, height: int, rising: bool = False) -> Column:
    """Bits of a difference hash: for each pair of neighbours in a row, whether the left one is
    larger (or, if ``rising``, the right one), row by row. ``grid`` is one array; null without one."""
    pairs = F.array(*[F.lit(r * width + c) for r in range(height) for c in range(width - 1)])
    bit = lambda i: F.get(grid, i) < F.get(grid, i + 1) if rising else F.get(grid, i) > F.get(grid, i + 1)
    bits = F.array_join(F.transform(pairs, lambda i: F.when(bit(i), "1").otherwise("0")), "")
    return F.when(grid.isNotNull(), bits)


def dhash(grid: Column, width: int = 9, height: int = 8, rising: bool = False) -> Column:
    """A difference hash as hex text, a digit for each four bits. Not a bigint: it uses all 64."""
    digits = (width - 1) * height // 4
    return F.lpad(F.lower(F.conv(grid_bits(grid, width, height, rising), 2, 16)), digits, "0")


def output_name(source: Column, key: Column, path: Column, digits: int = 64) -> Column:
    """``source__key.ext`` with the first digits of a hash as key."""
    return F.concat(source, F.lit("__"), F.substring(key, 1, digits), extension(path))


def numbered_name(source: Column, number: Column, content: Column, path: Column) -> Column:
    """``source_0001_key.ext`` with a running number of four digits at least and ten digits of the SHA-1."""
    digits = F.when(F.length(number.cast("string")) < 4, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    return F.concat(source, F.lit("_"), digits, F.lit("_"), sha1_prefix(content, 10), extension(path))


def fingerprint(content: Column, grid: Column, width: Column, height: Column, columns: int = 9, rows: int = 8) -> Column:
    """What tells pictures apart: content hash, difference hash of a grid of pixels, and size."""
    return F.struct(sha256(content).alias("sha256"), dhash(grid, columns, rows).alias("dhash"), width.alias("width"), height.alias("height"))


def seeded_order(seed: int | str, key: Column) -> Column:
    """The text that orders rows at random but alike in every run and engine."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)
