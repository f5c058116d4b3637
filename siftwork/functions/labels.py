"""Label lines: parsing, validation, class ids and box arithmetic, as column expressions.

A line is a class and a box (``class x y width height``, centre and size as shares of the image)
or a class and a polygon (``class x1 y1 x2 y2 ...``). Numbers are read the way Python's
``float`` reads plain decimals: anything else, and text that only the JVM takes for a number
such as ``1d``, is no number. All checks are two-sided, so a NaN passes none.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Where a token of a line begins that is no plain decimal.
NO_DECIMAL = r"(?:^| )(?![+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?: |$))"
WHOLE = r"^[+-]?\d+$"
#: How a class token is read: as an integral number, as digits only, or cut off after the point.
CLASS_MODES = ("integral", "digits", "truncate")
PARSED = "struct<kind:string,class_id:int,x:double,y:double,w:double,h:double,n_points:int,error:string>"


def tokens(line: Column) -> Column:
    """The words of a line; an empty array for a null or blank one."""
    words = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    return F.coalesce(words, F.array().cast("array<string>"))


def number(token: Column) -> Column:
    """A finite double, else null."""
    value = F.when(token.rlike(DECIMAL), token.try_cast("double"))
    return _once(value, lambda v: F.when((v > float("-inf")) & (v < float("inf")), v))


def class_id(token: Column, nc: int | None = None, mode: str = "integral") -> Column:
    """A class id, or null where the token isn't one (by ``mode``) or lies outside ``0..nc-1``."""
    if mode not in CLASS_MODES:
        raise ValueError(f"mode must be one of {CLASS_MODES}")
    if mode == "digits":
        found = F.when(token.rlike(WHOLE), token.try_cast("int"))
    elif mode == "truncate":
        found = _once(number(token), lambda v: F.when(F.abs(v) < 2**31, v.cast("int")))
    else:
        found = _once(number(token), lambda v: F.when((v == F.floor(v)) & (F.abs(v) < 2**31), v.cast("int")))
    return found if nc is None else _once(found, lambda v: F.when(v.between(0, nc - 1), v))


def read_line(df: DataFrame, line: str, mode: str = "integral") -> DataFrame:
    """``df`` with what a line of five tokens says: ``_n`` tokens, ``_class``, ``_v1`` to ``_v4``.

    Each step is a column of its own, so that a token is cut and read once a row, in generated
    code; the numbers are null where there are not five tokens.
    """
    clean = df.withColumn("_clean", F.regexp_replace(line, r"^\s+|\s+$", ""))
    split = clean.withColumn("_w", F.split("_clean", r"\s+"))
    n = F.when(F.col("_clean").isNull() | (F.col("_clean") == ""), 0).otherwise(F.size("_w"))
    token = lambda k: F.when(F.col("_n") == 5, F.get("_w", k))
    cut = split.withColumn("_n", n).withColumns({f"_t{k}": token(k) for k in range(1, 5)} | {"_t0": F.get("_w", 0)})
    read = lambda k: F.when(F.col(f"_t{k}").rlike(DECIMAL), F.col(f"_t{k}").try_cast("double"))
    raw = cut.withColumns({f"_r{k}": read(k) for k in range(5)})
    finite = lambda k: F.when(F.abs(f"_r{k}") < float("inf"), F.col(f"_r{k}"))
    first = F.col("_r0")
    if mode == "digits":
        cls = F.when(F.col("_t0").rlike(WHOLE), F.col("_t0").try_cast("int"))
    elif mode == "truncate":
        cls = F.when(F.abs(first) < 2**31, first.cast("int"))
    else:
        cls = F.when((first == F.floor(first)) & (F.abs(first) < 2**31), first.cast("int"))
    said = raw.withColumns({f"_v{k}": finite(k) for k in range(1, 5)} | {"_class": cls})
    return said.select(*df.columns, "_n", "_class", *[f"_v{k}" for k in range(1, 5)])


def parsed(
    df: DataFrame, line: str, name: str, nc: int | None = None, mode: str = "integral", polygons: bool = True, least_points: int = 3
) -> DataFrame:
    """``df`` with the struct of ``parse_line`` as the column ``name``; arrays are built for polygons only."""
    if mode not in CLASS_MODES:
        raise ValueError(f"mode must be one of {CLASS_MODES}")
    v = [F.col(f"_v{k}") for k in range(1, 5)]
    cls = F.col("_class") if nc is None else F.when(F.col("_class").between(0, nc - 1), F.col("_class"))
    error = (
        F.when(F.col("_id").isNull(), "class")
        .when(~(in_unit(v[0]) & in_unit(v[1])), "coordinate")
        .when(~(share(v[2]) & share(v[3])), "size")
    )
    n = F.col("_n")
    could = (n != 5) & (n >= 1 + 2 * least_points) & (n % 2 == 1) & F.lit(polygons)
    judged = read_line(df, line, mode).withColumn("_id", cls)
    # a polygon's numbers are split by place and read as whole arrays: no function of a single element
    judged = judged.withColumn("_rest", F.when(could, F.regexp_replace(F.regexp_replace(line, r"^\s*\S+\s+|\s+$", ""), r"\s+", " ")))
    column = lambda k: F.split(F.regexp_replace("_rest", r"(\S+) (\S+)( |$)", f"${k}$3"), " ").try_cast("array<double>")
    judged = judged.withColumns({"_xs": column(1), "_ys": column(2), "_plain": ~F.col("_rest").rlike(NO_DECIMAL)})
    judged = judged.withColumns({"_x0": F.array_min("_xs"), "_x1": F.array_max("_xs"), "_y0": F.array_min("_ys"), "_y1": F.array_max("_ys")})
    a, b, c, d = (F.col(k) for k in ("_x0", "_x1", "_y0", "_y1"))
    inside = F.col("_plain") & in_unit(a) & in_unit(b) & in_unit(c) & in_unit(d)
    outline = F.when(F.col("_id").isNull(), "class").when(~inside, "coordinate").when(~((b > a) & (d > c)), "extent")
    judged = judged.withColumn("_error", F.when(n == 5, error).when(could, outline).otherwise("tokens"))
    sound, box = F.col("_error").isNull(), n == 5
    field = lambda of_box, of_polygon, name: F.when(sound, F.when(box, of_box).otherwise(of_polygon)).alias(name)
    whole = F.struct(
        field(F.lit("bbox"), F.lit("polygon"), "kind"), F.when(sound, F.col("_id")).alias("class_id"),
        field(v[0], (a + b) / 2, "x"), field(v[1], (c + d) / 2, "y"), field(v[2], b - a, "w"), field(v[3], d - c, "h"),
        field(F.lit(0), ((n - 1) / 2).cast("int"), "n_points"), F.col("_error").alias("error"),
    )
    # made into rows, so that what is asked of the result isn't pushed below and computed again there
    return judged.select(*df.columns, F.explode(F.array(whole)).alias(name))


def in_unit(value: Column) -> Column:
    """True for numbers of the closed unit interval, false for all else, nulls included."""
    return F.coalesce((value >= 0) & (value <= 1), F.lit(False))


def share(value: Column) -> Column:
    """True for numbers above 0 and up to 1."""
    return F.coalesce((value > 0) & (value <= 1), F.lit(False))


def parse_line(
    line: Column, nc: int | None = None, mode: str = "integral", polygons: bool = True, least_points: int = 3
) -> Column:
    """A struct with what a line says, or why it says nothing in ``error``.

    ``error`` is one of tokens, class, coordinate, size, extent. A polygon's box is its bounds.
    """
    def read(words: Column) -> Column:
        numbers = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda t: number(t))
        return F.struct(F.size(words).alias("n"), class_id(F.get(words, 0), nc, mode).alias("cls"), numbers.alias("values"))

    def bounded(r: Column) -> Column:
        xs, ys = F.filter(r["values"], lambda v, i: i % 2 == 0), F.filter(r["values"], lambda v, i: i % 2 == 1)
        sides = [f(v).alias(k) for k, f, v in (("x0", F.array_min, xs), ("x1", F.array_max, xs), ("y0", F.array_min, ys), ("y1", F.array_max, ys))]
        return F.struct(r["n"].alias("n"), r["cls"].alias("cls"), r["values"].alias("values"), *sides)

    def checked(r: Column) -> Column:
        box, v = r["n"] == 5, [F.get(r["values"], k) for k in range(4)]
        many = (r["n"] >= 1 + 2 * least_points) & (r["n"] % 2 == 1)
        error = (
            F.when(~(box | (many & polygons)), "tokens")
            .when(r["cls"].isNull(), "class")
            .when(box & ~(in_unit(v[0]) & in_unit(v[1])), "coordinate")
            .when(box & ~(share(v[2]) & share(v[3])), "size")
            .when(~box & ~F.forall(r["values"], in_unit), "coordinate")
            .when(~box & ~((r["x1"] > r["x0"]) & (r["y1"] > r["y0"])), "extent")
        )
        return F.struct(r.alias("r"), error.alias("error"))

    def said(c: Column) -> Column:
        r, sound = c["r"], c["error"].isNull()
        box, v = r["n"] == 5, [F.get(r["values"], k) for k in range(4)]
        pick = lambda of_box, of_polygon: F.when(sound, F.when(box, of_box).otherwise(of_polygon))
        return F.struct(
            pick(F.lit("bbox"), F.lit("polygon")).alias("kind"),
            F.when(sound, r["cls"]).alias("class_id"),
            pick(v[0], (r["x0"] + r["x1"]) / 2).alias("x"),
            pick(v[1], (r["y0"] + r["y1"]) / 2).alias("y"),
            pick(v[2], r["x1"] - r["x0"]).alias("w"),
            pick(v[3], r["y1"] - r["y0"]).alias("h"),
            pick(F.lit(0), ((r["n"] - 1) / 2).cast("int")).alias("n_points"),
            c["error"].alias("error"),
        )

    return _once(_once(_once(_once(tokens(line), read), bounded), checked), said)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once a row, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def polygon_box(points: Column) -> Column:
    """Centre and size of the enclosing box of an array of structs x, y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    a, b, c, d = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(((a + b) / 2).alias("x"), ((c + d) / 2).alias("y"), (b - a).alias("w"), (d - c).alias("h"))


def pixel_box(left: Column, top: Column, width: Column, height: Column, image_w: Column, image_h: Column) -> Column:
    """A pixel box as shares of the image; null where the image has no size.

    Centre and size are clipped to the unit interval. A box that is left without extent is null.
    """
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    sized = (image_w > 0) & (image_h > 0)
    x, y = (left + width / 2) / F.when(sized, image_w), (top + height / 2) / F.when(sized, image_h)
    w, h = width / F.when(sized, image_w), height / F.when(sized, image_h)
    box = F.struct(clip(x).alias("x"), clip(y).alias("y"), clip(w).alias("w"), clip(h).alias("h"))
    whole = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    return F.when(whole & (clip(w) > 0) & (clip(h) > 0), box)


def pixel_corners(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Corners in pixels, cut off after the point."""
    whole = lambda v: v.cast("int")
    return F.struct(
        whole((x - w / 2) * image_w).alias("left"), whole((y - h / 2) * image_h).alias("top"),
        whole((x + w / 2) * image_w).alias("right"), whole((y + h / 2) * image_h).alias("bottom"),
    )


def distinct_lines(lines: Column) -> Column:
    """Lines without repeats, in the order of their first occurrence."""
    return F.array_distinct(lines)


def remap_first(line: Column, mapping: Column) -> Column:
    """A line with its class replaced by ``mapping`` (a map of int to int); null if unmapped."""
    words = tokens(line)
    target = F.try_element_at(mapping, class_id(F.get(words, 0), mode="digits"))
    return F.when(target.isNotNull(), F.array_join(F.concat(F.array(target.cast("string")), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))), " "))


def denied(name: Column, keywords: list[str]) -> Column:
    """True if a name contains one of the keywords, whatever its case."""
    hit = F.lit(False)
    for k in keywords:
        hit |= F.lower(name).contains(k.lower())
    return F.coalesce(hit, F.lit(False))


def first_present(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias that is a column. Presence decides, not whether its values are null."""
    return next((a for a in aliases if a in columns), None)


def fixed8(value: Column) -> Column:
    """A double with eight decimals, rounded half to even on its exact binary value.

    The JVM formats the shortest decimal text instead and may differ in the last digit, so this
    is a vectorised Python function; use it in sinks only.
    """
    def written(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:.8f}" for v in values], dtype=object)

    return F.pandas_udf(written, "string")(value)
