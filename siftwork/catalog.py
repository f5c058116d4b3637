"""Every query of the library by name, with DuckDB SQL for the same result.

Keys start with the id of the operator. The tables hold orders, parts, events and documents, so
they stand in for images and labels: an order is a record, its lines are its annotations, line
numbers are classes, documents are pictures.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, labels, resample
from .operators import checks, classify, dedup, detections, match, records, report, select
from .operators.ordering import placed
from .plans import builds
from .sinks import outputs
from .sources import coco, config, files, runs, scan, storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SEED = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- stand-ins -----------------------------------------------------------------------------

CLASS_ROWS = [(c, c - 1, "target") for c in (1, 2, 3, 4)] + [(5, None, "negative"), (6, None, "unsupported"), (7, None, "unsupported")]
LINES_SQL = """
lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS x, l_tax AS y, l_quantity / 100 AS w,
                 (l_extendedprice / 50000.0) AS h FROM lineitem)"""
ROLES_SQL = """
roles AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CASE WHEN l_linenumber <= 4 THEN 'target' WHEN l_linenumber = 5 THEN 'negative' ELSE 'unsupported' END AS role,
                 CASE WHEN l_linenumber <= 4 THEN l_linenumber - 1 END AS target_class FROM lineitem)"""


def class_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASS_ROWS, "l_linenumber int, target_class int, role string")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", "l_suppkey")
    return classify.remap(lines, class_map(spark), ["l_linenumber"])


def numeric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines as text from numeric columns; line number 7 has a sixth token, 6 is a polygon."""
    li = table(spark, sf_dir, "lineitem")
    text = lambda c: c.cast("string")
    cls, x, y, w = (text(F.col("l_linenumber")), text(F.col("l_discount")), text(F.col("l_tax")), text(F.col("l_quantity") / 100))
    five = F.concat_ws(" ", cls, x, y, w, F.lit("0.5"))
    line = F.when(F.col("l_linenumber") == 7, F.concat(five, F.lit(" 9"))).when(F.col("l_linenumber") == 6, F.concat_ws(" ", cls, x, y, w, y, w, F.lit("0.9")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", line.otherwise(five).alias("line"))


def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines whose numbers leave their ranges in part; line number 7 has a sixth token."""
    text = lambda c: c.cast("string")
    five = F.concat_ws(" ", text(F.col("l_linenumber")), text(F.col("l_discount") * 12), text(F.col("l_tax")), text(F.col("l_quantity") / 40), text(F.col("l_tax") * 20))
    line = F.when(F.col("l_linenumber") == 7, F.concat(five, F.lit(" 9"))).otherwise(five)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", line.alias("line"))


#: The lines of ``numeric_lines`` that are valid with seven classes.
VALID_SQL = "(l_linenumber < 6 OR (l_linenumber = 6 AND l_discount <> l_quantity / 100))"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: content hash, and the whole text without case and punctuation as perceptual key."""
    d = table(spark, sf_dir, "documents")
    folded = F.regexp_replace(F.lower("text"), r"[ \t\r\n.,;:!?]+", " ")
    return d.select(
        F.col("doc_id").alias("id"), "source", F.col("doc_id").cast("string").alias("image_path"),
        keys.sha256(F.col("text")).alias("sha256"), keys.sha256(folded).alias("dhash"),
        F.length(folded).cast("long").alias("width"), F.lit(1).alias("height"),
    )


PICTURES_SQL = r"""
pictures AS (SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS image_path, sha256(text) AS sha256, sha256(folded) AS dhash, CAST(length(folded) AS BIGINT) AS width, 1 AS height
             FROM (SELECT *, regexp_replace(lower(text), '[ \t\r\n.,;:!?]+', ' ', 'g') AS folded FROM documents))"""


#: Customers as images: id, split, and for each of up to three lines its number, class and position.
IMAGES_SQL = """
cust AS (SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, c_custkey % 4 AS n FROM customer),
ln AS (SELECT id, split, k, (id // 4 + k) % 8 AS cls, k / 8::DOUBLE AS y, id % 11 = 0 AND k = 1 AS odd FROM (SELECT id, split, unnest(range(1, n + 1)) AS k FROM cust))"""


def image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, split, line_no, line`` of the customers; those without a line have one row with nulls."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("s"))
    split = F.when(F.col("s") == 0, "train").when(F.col("s") == 1, "valid").otherwise("test")
    numbers = F.transform(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda k: k <= F.col("id") % 4), lambda k: k)
    each = c.select("id", split.alias("split"), F.explode_outer(numbers).alias("line_no"))
    cls = ((F.floor(F.col("id") / 4) + F.col("line_no")) % 8).cast("string")
    five = F.concat_ws(" ", cls, F.lit("0.5"), (F.col("line_no") / 8).cast("string"), F.lit("0.25 0.125"))
    line = F.when((F.col("id") % 11 == 0) & (F.col("line_no") == 1), F.concat(five, F.lit(" 9"))).when(F.col("line_no").isNotNull(), five)
    return each.select("id", "split", "line_no", line.alias("line"))


def scratch(spark: SparkSession) -> str:
    return storage.shared_folder(spark, "tree")


def tree(spark: SparkSession, sf_dir: str, missing: int | None = None) -> str:
    """Writes the customers as images and label files below a new folder; ids that ``missing`` divides get no label file."""
    root, lines = scratch(spark), image_lines(spark, sf_dir)
    base = F.concat(F.lit("c"), F.col("id").cast("string"))
    texts = lines.groupBy("id", "split").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\r\n").alias("content"))
    image = F.struct(F.concat("split", F.lit("/images/"), base, F.when(F.col("id") % 2 == 0, ".PNG").otherwise(".jpg")).alias("name"), base.alias("content"))
    label = F.struct(F.concat("split", F.lit("/labels/"), base, F.lit(".txt")).alias("name"), F.col("content"))
    both = F.array(image, label) if missing is None else F.when(F.col("id") % missing == 0, F.array(image)).otherwise(F.array(image, label))
    outputs.write_files(texts.select(F.explode(both).alias("file")).select("file.*"), root, "name", "content")
    return root


POLICY = {c: 3 - c for c in range(4)}


def policy(root: str, **options) -> config.SourcePolicy:
    return config.SourcePolicy("customers", root, POLICY, **options)


def stem_of(path: str):
    return keys.stem(F.col(path)).alias("stem")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; low quality stands for negatives."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select("doc_id", "source", (F.col("quality") == 0).alias("is_negative"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("o_orderpriority").alias("source"))


# --- parsing -------------------------------------------------------------------------------


@query("p1_class_id", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber < 5 THEN CAST(l_linenumber AS INT) END AS class_id, CASE WHEN l_discount = floor(l_discount) AND l_discount BETWEEN 0 AND 4 THEN CAST(l_discount AS INT) END AS of_discount FROM lineitem")
def p1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        labels.class_id(F.col("l_linenumber").cast("string"), 5).alias("class_id"), labels.class_id(F.col("l_discount").cast("string"), 5).alias("of_discount"),
    )


@query("p2_unit_coordinate", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount * 12 BETWEEN 0 AND 1 AS inside, l_quantity / 40 > 0 AND l_quantity / 40 <= 1 AS sized FROM lineitem")
def p2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        labels.in_unit(F.col("l_discount") * 12).alias("inside"), labels.share(F.col("l_quantity") / 40).alias("sized"),
    )


@query("p3_validate_lines", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'tokens' WHEN l_linenumber >= 6 THEN 'class'
WHEN NOT (l_discount * 12 BETWEEN 0 AND 1 AND l_tax BETWEEN 0 AND 1) THEN 'coordinate' WHEN NOT (l_quantity / 40 > 0 AND l_quantity / 40 <= 1 AND l_tax * 20 > 0 AND l_tax * 20 <= 1) THEN 'size' END AS error FROM lineitem""")
def p3(spark, sf_dir):
    lines = labels.parsed(boundary_lines(spark, sf_dir), "line", "p", 6, polygons=False)
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p.error")


POLYGON_SQL = """
WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount AS x1, l_tax AS y1, l_quantity / 100 AS x2, l_tax AS y2, l_quantity / 100 AS x3, 0.9::DOUBLE AS y3 FROM lineitem),
b AS (SELECT *, least(x1, x2) AS ax, greatest(x1, x2) AS bx, least(y1, y3) AS ay, greatest(y1, y3) AS by_ FROM p)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN bx > ax AND by_ > ay THEN 'polygon' END AS kind,
       CASE WHEN bx > ax AND by_ > ay THEN (ax + bx) / 2 END AS x, CASE WHEN bx > ax AND by_ > ay THEN (ay + by_) / 2 END AS y,
       CASE WHEN bx > ax AND by_ > ay THEN bx - ax END AS w, CASE WHEN bx > ax AND by_ > ay THEN by_ - ay END AS h,
       CASE WHEN NOT (bx > ax AND by_ > ay) THEN 'extent' END AS error FROM b"""


@query("p4_parse_polygons", POLYGON_SQL)
def p4(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x2 = (F.col("l_quantity") / 100).cast("string")
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_discount").cast("string"), F.col("l_tax").cast("string"), x2, F.col("l_tax").cast("string"), x2, F.lit("0.9"))
    parsed = labels.parsed(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", line.alias("line")), "line", "p", 8)
    return parsed.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p.kind", "p.x", "p.y", "p.w", "p.h", "p.error")


@query("p5_parse_truncating", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN 'bbox' WHEN l_discount <> l_quantity / 100 THEN 'polygon' END AS kind,
CASE WHEN l_linenumber < 7 OR l_discount <> l_quantity / 100 THEN CAST(trunc(l_quantity / 10) AS INT) END AS class_id, CASE WHEN l_linenumber = 7 AND l_discount = l_quantity / 100 THEN 'extent' END AS error FROM lineitem""")
def p5(spark, sf_dir):
    text = lambda c: c.cast("string")
    cls, x, y, w = (text(F.col("l_quantity") / 10), text(F.col("l_discount")), text(F.col("l_tax")), text(F.col("l_quantity") / 100))
    line = F.when(F.col("l_linenumber") == 7, F.concat_ws(" ", cls, x, y, w, y, w, F.lit("0.9"))).otherwise(F.concat_ws(" ", cls, x, y, w, F.lit("0.5")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", line.alias("line"))
    return labels.parsed(lines, "line", "p", mode="truncate").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p.kind", "p.class_id", "p.error")


@query("p6_remap", f"WITH {ROLES_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(target_class AS INT) AS target_class, role FROM roles")
def p6(spark, sf_dir):
    return mapped(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "target_class", "role")


@query("p7_drop_reasons", f"""WITH {ROLES_SQL} SELECT l_orderkey, CASE WHEN bool_or(l_linenumber = 3 AND l_suppkey % 5 = 0) THEN 'non_detection_label' WHEN bool_or(role = 'unsupported') THEN 'unsupported_class' WHEN bool_or(target_class IS NULL AND role <> 'negative') THEN 'unknown_class' END AS drop_reason
FROM roles GROUP BY l_orderkey""")
def p7(spark, sf_dir):
    lines = mapped(spark, sf_dir).withColumn("n_tokens", F.when((F.col("l_linenumber") == 3) & (F.col("l_suppkey") % 5 == 0), 7).otherwise(5))
    return classify.drop_reasons(lines, ["l_orderkey"], "l_linenumber", "n_tokens")


@query("p7_remapped_lines", f"""WITH {IMAGES_SQL}, r AS (SELECT cust.id, n, bool_or(odd) AS odd, max(cls) AS top, string_agg(printf('%d 0.50000000 %.8f 0.25000000 0.12500000', 3 - cls, y), '|' ORDER BY k) AS labels FROM cust LEFT JOIN ln USING (id) GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN n = 0 THEN 'empty_label' WHEN odd THEN 'non_detection_label' WHEN top >= 4 THEN 'unsupported_class' END AS drop_reason FROM r)
SELECT id, CASE WHEN drop_reason IS NULL THEN labels ELSE '' END AS labels, false AS is_negative, drop_reason FROM d""")
def p7_lines(spark, sf_dir):
    classes = spark.createDataFrame([(c, POLICY.get(c), "target" if c < 4 else "unsupported") for c in range(8)], "source_class int, target_class int, role string")
    done = records.remapped(image_lines(spark, sf_dir), ["id"], classes)
    return done.select("id", F.array_join("labels", "|").alias("labels"), "is_negative", "drop_reason")


@query("p8_polygon_box", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (least(l_discount, l_tax) + greatest(l_discount, l_tax)) / 2 AS x, (least(l_tax, l_quantity / 100) + greatest(l_tax, l_quantity / 100)) / 2 AS y,
greatest(l_discount, l_tax) - least(l_discount, l_tax) AS w, greatest(l_tax, l_quantity / 100) - least(l_tax, l_quantity / 100) AS h FROM lineitem""")
def p8(spark, sf_dir):
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100
    box = labels.polygon_box(F.array(point(d, t), point(t, q), point(d, q)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "b.*")


@query("p9_pixel_box", """WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + l_discount * 100 / 2 AS cx, l_quantity + l_tax * 100 / 2 AS cy, l_discount * 100 AS bw, l_tax * 100 AS bh FROM lineitem),
c AS (SELECT *, greatest(0, least(1, cx / 50)) AS x, greatest(0, least(1, cy / 40)) AS y, greatest(0, least(1, bw / 50)) AS w, greatest(0, least(1, bh / 40)) AS h FROM b)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN w > 0 AND h > 0 THEN x END AS x, CASE WHEN w > 0 AND h > 0 THEN y END AS y, CASE WHEN w > 0 AND h > 0 THEN w END AS w, CASE WHEN w > 0 AND h > 0 THEN h END AS h FROM c""")
def p9(spark, sf_dir):
    q = F.col("l_quantity")
    box = labels.pixel_box(q, q, F.col("l_discount") * 100, F.col("l_tax") * 100, F.lit(50), F.lit(40))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "b.*")


@query("p10_convert", f"WITH {LINES_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_linenumber - 1 AS INT) AS target_class, x, y, w FROM lines WHERE l_linenumber <= 4")
def p10(spark, sf_dir):
    parsed = labels.parsed(numeric_lines(spark, sf_dir), "line", "p", 7).filter("p.error is null")
    cut = parsed.select("l_orderkey", "l_partkey", "l_suppkey", F.col("p.class_id").alias("l_linenumber"), "p.x", "p.y", "p.w")
    done = classify.remap(cut, class_map(spark), ["l_linenumber"]).filter("target_class is not null")
    return done.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "target_class", "x", "y", "w")


@query("p11_convert_distinct", """SELECT l_orderkey, CAST(l_linenumber % 4 AS INT) AS target_class, l_linenumber % 4 || ' ' || l_returnflag || ' b c d' AS text, count(*) - 1 AS repeats FROM lineitem
GROUP BY l_orderkey, l_linenumber % 4, l_returnflag""")
def p11(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), "l_returnflag", F.lit("b c d"))
    classes = spark.createDataFrame([(c, c % 4, "target") for c in range(1, 8)], "source_class int, target_class int, role string")
    lines = li.select("l_orderkey", (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("line_no"), line.alias("line"))
    return records.converted(lines, ["l_orderkey"], classes).select("l_orderkey", "target_class", "text", "repeats")


@query("p12_map_first_token", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber <= 4 THEN CAST(l_linenumber - 1 AS VARCHAR) || ' a b' END AS line FROM lineitem")
def p12(spark, sf_dir):
    table_ = F.create_map(*[F.lit(x) for c, t, r in CLASS_ROWS if t is not None for x in (c, t)])
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(" a b"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", labels.remap_first(line, table_).alias("line"))


@query("p13_distinct_lines", """WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, line, min(i) AS i FROM w GROUP BY doc_id, line) SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS digest, count(*) AS n_lines FROM f GROUP BY doc_id""")
def p13(spark, sf_dir):
    lines = labels.distinct_lines(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", keys.sha256(F.array_join(lines, "\n")).alias("digest"), F.size(lines).cast("long").alias("n_lines"))


@query("p14_denied_names", "SELECT p_partkey, contains(lower(p_name), 'green') OR contains(lower(p_name), 'red') AS denied FROM part")
def p14(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", labels.denied(F.col("p_name"), ["Green", "red"]).alias("denied"))


@query("p15_numbers", "SELECT event_id, CASE WHEN regexp_matches(CAST(user_id AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN 'd' ELSE '' END, '^[+-]?[0-9]+$') THEN CAST(user_id AS DOUBLE) END AS v FROM events")
def p15(spark, sf_dir):
    token = F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "d").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", labels.number(token).alias("v"))


@query("p16_pixel_corners", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc((l_discount - l_quantity / 100 / 2) * 640) AS INT) AS left_, CAST(trunc((l_tax - 0.25::DOUBLE / 2) * 480) AS INT) AS top_,
CAST(trunc((l_discount + l_quantity / 100 / 2) * 640) AS INT) AS right_, CAST(trunc((l_tax + 0.25::DOUBLE / 2) * 480) AS INT) AS bottom_ FROM lineitem""")
def p16(spark, sf_dir):
    c = labels.pixel_corners(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.lit(0.25), F.lit(640), F.lit(480))
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", c.alias("c"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.col(f"c.{k}").alias(f"{k}_") for k in ("left", "top", "right", "bottom")])


# --- records -------------------------------------------------------------------------------


@query("c1_classify", f"""WITH {ROLES_SQL}, f AS (SELECT l_orderkey, bool_or(role = 'target') t, bool_or(role = 'negative') n, bool_or(role = 'unsupported') o FROM roles GROUP BY 1)
SELECT l_orderkey, CASE WHEN t AND NOT n AND NOT o THEN 'target' WHEN n AND NOT t AND NOT o THEN 'negative_candidate' ELSE 'ambiguous' END AS decision FROM f""")
def c1(spark, sf_dir):
    return classify.classify(mapped(spark, sf_dir), ["l_orderkey"])


@query("c2_target_annotations", f"""WITH {ROLES_SQL}, ok AS (SELECT l_orderkey FROM roles GROUP BY 1 HAVING bool_and(role = 'target'))
SELECT l_orderkey, string_agg(CAST(target_class AS VARCHAR), ',' ORDER BY l_partkey, l_suppkey, target_class) AS classes FROM roles JOIN ok USING (l_orderkey) GROUP BY 1""")
def c2(spark, sf_dir):
    done = classify.target_annotations(mapped(spark, sf_dir), ["l_orderkey"], ["l_partkey", "l_suppkey", "target_class"])
    return done.select("l_orderkey", F.array_join(F.transform("annotations", lambda a: a["target_class"].cast("string")), ",").alias("classes"))


OUTCOME_SQL = f"""WITH {IMAGES_SQL}, r AS (SELECT cust.id, split, n, bool_or(odd) AS odd, max(cls) AS top, min(cls) AS low, string_agg(printf('%d 0.50000000 %.8f 0.25000000 0.12500000', 3 - cls, y), '|' ORDER BY k) AS labels FROM cust LEFT JOIN ln USING (id, split) GROUP BY 1, 2, 3),
d AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'missing_label' WHEN n = 0 THEN 'empty_label_skipped' WHEN odd OR top >= 6 THEN 'invalid_or_unknown' WHEN top >= 4 AND low < 4 THEN 'ambiguous_mixed' WHEN low >= 4 THEN 'negative' ELSE 'kept' END AS outcome FROM r)"""
LENIENT_ROWS = [(c, POLICY.get(c), "target" if c < 4 else "negative") for c in range(6)]


@query("c3_drop_taxonomy", OUTCOME_SQL + " SELECT outcome, count(*) AS n FROM d GROUP BY 1")
def c3(spark, sf_dir):
    lines = image_lines(spark, sf_dir).withColumn("found", F.col("id") % 13 != 0)
    classes = spark.createDataFrame(LENIENT_ROWS, "source_class int, target_class int, role string")
    return records.lenient(lines, ["id"], classes, "found").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("c4_core_reject", f"""WITH {ROLES_SQL}, f AS (SELECT l_orderkey, string_agg(DISTINCT CAST(target_class AS VARCHAR), ',' ORDER BY CAST(target_class AS VARCHAR)) AS classes, bool_or(target_class IS NULL) AS unknown FROM roles GROUP BY 1)
SELECT l_orderkey, coalesce(classes, '') AS classes, CASE WHEN classes IS NULL THEN 'reject' WHEN unknown THEN 'mixed' ELSE 'core' END AS part FROM f""")
def c4(spark, sf_dir):
    done = classify.core_and_reject(mapped(spark, sf_dir), ["l_orderkey"])
    return done.withColumn("classes", F.array_join(F.transform("classes", lambda c: c.cast("string")), ","))


# --- keys ----------------------------------------------------------------------------------


@query("f1_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.sha256(F.col("text")).alias("sha256"))


@query("f2_sha1_prefix", "SELECT doc_id, substr(sha1(text), 1, 10) AS short, substr(sha1(source || '/' || CAST(doc_id AS VARCHAR)), 1, 12) AS path_key FROM documents")
def f2(spark, sf_dir):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", keys.sha1_prefix(F.col("text"), 10).alias("short"), keys.sha1_prefix(path, 12).alias("path_key"))


DHASH_SQL = """WITH g AS (SELECT vec_id, embedding AS e, unnest(range(56)) AS i FROM embeddings),
b AS (SELECT vec_id, string_agg(CASE WHEN e[(i // 7) * 8 + i % 7 + 1] {op} e[(i // 7) * 8 + i % 7 + 2] THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM g GROUP BY vec_id)
SELECT vec_id, bits FROM b"""


@query("f3_dhash", DHASH_SQL.replace("{op}", ">"))
def f3(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", keys.grid_bits(F.col("embedding"), 8, 8).alias("bits"))


@query("f4_dhash_rising", DHASH_SQL.replace("{op}", "<"))
def f4(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", keys.grid_bits(F.col("embedding"), 8, 8, rising=True).alias("bits"))


@query("f5_fingerprint", DHASH_SQL.replace("{op}", ">").replace("SELECT vec_id, bits FROM b", "") + """, h AS (SELECT vec_id, string_agg(format('{:x}', CAST(('0b' || substr(bits, CAST(k * 4 + 1 AS INT), 4)) AS INT)), '' ORDER BY k) AS dhash FROM b, range(14) AS r(k) GROUP BY vec_id)
SELECT vec_id, sha256(CAST(vec_id AS VARCHAR)) AS sha256, dhash, 8 AS width, 8 AS height FROM h""")
def f5(spark, sf_dir):
    made = keys.fingerprint(F.col("vec_id").cast("string"), F.col("embedding"), F.lit(8), F.lit(8), 8, 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", made.alias("f")).select("vec_id", "f.*")


#: Documents as grey pictures: a byte is a pixel, and the last row is filled up but for each eleventh document.
GREYS_SQL = """
sized AS (SELECT doc_id, source, 3 + doc_id % 40 AS w, hex(encode(coalesce(text, ''))) AS h FROM documents),
tall AS (SELECT *, CAST(ceil((length(h) // 2) / CAST(w AS DOUBLE)) AS BIGINT) AS t FROM sized),
greys AS (SELECT doc_id, source, w, t, CASE WHEN doc_id % 11 <> 0 THEN rpad(h, CAST(2 * w * t AS INTEGER), '0') ELSE h END AS h FROM tall),
readable AS (SELECT * FROM greys WHERE t > 0 AND length(h) = 2 * w * t),
px AS (SELECT doc_id, w, t, i % w AS x, i // w AS y, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS v
       FROM (SELECT doc_id, w, t, h, unnest(range(0, w * t)) AS i FROM readable)),
sides AS (SELECT DISTINCT w AS size, 9 AS cells FROM readable UNION SELECT DISTINCT t, 8 FROM readable)"""
WINDOWED_SQL = f"""WITH {GREYS_SQL},
cells AS (SELECT size, cells, c, greatest(size / CAST(cells AS DOUBLE), 1) AS stretch, (c + 0.5) * (size / CAST(cells AS DOUBLE)) AS centre
          FROM (SELECT size, cells, unnest(range(0, cells)) AS c FROM sides)),
taps AS (SELECT *, unnest(range(CAST(greatest(0, trunc(centre - 3 * stretch + 0.5)) AS BIGINT), CAST(least(size, trunc(centre + 3 * stretch + 0.5)) AS BIGINT))) AS x FROM cells),
raw AS (SELECT *, CASE WHEN p = 0 THEN 1 WHEN p >= -3 AND p < 3 THEN sin(pi() * p) / (pi() * p) * (sin(pi() * p / 3) / (pi() * p / 3)) ELSE 0 END AS f
        FROM (SELECT *, (x - centre + 0.5) / stretch AS p FROM taps)),
weights AS (SELECT size, cells, c, x, trunc(u + CASE WHEN u >= 0 THEN 0.5 ELSE -0.5 END) AS k FROM (SELECT *, f / sum(f) OVER (PARTITION BY size, cells, c) * 4194304 AS u FROM raw)),
across AS (SELECT doc_id, t, y, c, greatest(0, least(255, floor((sum(v * k) + 2097152) / 4194304))) AS v FROM px JOIN weights g ON g.size = w AND g.cells = 9 AND g.x = px.x GROUP BY doc_id, t, y, c),
grid AS (SELECT doc_id, g.c AS r, a.c, CAST(greatest(0, least(255, floor((sum(v * k) + 2097152) / 4194304))) AS INTEGER) AS v FROM across a JOIN weights g ON g.size = t AND g.cells = 8 AND g.x = y GROUP BY doc_id, g.c, a.c)"""
AREA_SQL = f"""WITH {GREYS_SQL},
weights AS (SELECT size, cells, c, x, least((c + 1) * size, (x + 1) * cells) - greatest(c * size, x * cells) AS k
            FROM (SELECT size, cells, c, unnest(range(c * size // cells, ((c + 1) * size + cells - 1) // cells)) AS x FROM (SELECT size, cells, unnest(range(0, cells)) AS c FROM sides))),
across AS (SELECT doc_id, w, t, y, c, sum(v * k) AS v FROM px JOIN weights g ON g.size = w AND g.cells = 9 AND g.x = px.x GROUP BY doc_id, w, t, y, c),
summed AS (SELECT doc_id, any_value(w * t) AS n, g.c AS r, a.c, CAST(sum(v * k) AS BIGINT) AS s FROM across a JOIN weights g ON g.size = t AND g.cells = 8 AND g.x = y GROUP BY doc_id, g.c, a.c),
grid AS (SELECT doc_id, r, c, CAST(s // n + CASE WHEN 2 * (s % n) > n OR (2 * (s % n) = n AND (s // n) % 2 = 1) THEN 1 ELSE 0 END AS INTEGER) AS v FROM summed)"""
HASHED_SQL = """,
bits AS (SELECT doc_id, r, c, CASE WHEN v {op} lead(v) OVER (PARTITION BY doc_id, r ORDER BY c) THEN 1 ELSE 0 END AS bit FROM grid),
hashes AS (SELECT doc_id, string_agg(printf('%02x', CAST(b AS INTEGER)), '' ORDER BY r) AS dhash FROM (SELECT doc_id, r, sum(bit << CAST(7 - c AS INTEGER)) AS b FROM bits WHERE c < 8 GROUP BY doc_id, r) GROUP BY doc_id)"""
RESAMPLED_SQL = """
SELECT g.doc_id, CAST(g.w AS INTEGER) AS width, CAST(g.t AS INTEGER) AS height, greys_text AS grid, dhash, dhash IS NULL AS unreadable
FROM greys g LEFT JOIN hashes USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY r, c) AS greys_text FROM grid GROUP BY doc_id) USING (doc_id)"""


def greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("width", (3 + F.col("doc_id") % 40).cast("int"))
    data = F.coalesce("text", F.lit("")).cast("binary")
    d = d.withColumn("content", data).withColumn("height", F.ceil(F.octet_length("content") / F.col("width")).cast("int"))
    filled = F.rpad("content", F.col("width") * F.col("height"), F.lit(b"\0"))
    return d.withColumn("pixels", F.when(F.col("doc_id") % 11 != 0, filled).otherwise(F.col("content"))).select("doc_id", "source", "width", "height", "content", "pixels")


def _resampled(spark, sf_dir, kind):
    made = resample.grid(F.col("pixels"), F.col("width"), F.col("height"), kind)
    hashed = keys.dhash(F.col("g"), rising=kind == "area")
    return greys(spark, sf_dir).withColumn("g", made).select(
        "doc_id", "width", "height", F.array_join(F.col("g").cast("array<string>"), " ").alias("grid"), hashed.alias("dhash"), F.col("g").isNull().alias("unreadable")
    )


@query("f3_resampled", WINDOWED_SQL + HASHED_SQL.replace("{op}", ">") + RESAMPLED_SQL)
def f3_resampled(spark, sf_dir):
    return _resampled(spark, sf_dir, "windowed")


@query("f4_resampled", AREA_SQL + HASHED_SQL.replace("{op}", "<") + RESAMPLED_SQL)
def f4_resampled(spark, sf_dir):
    return _resampled(spark, sf_dir, "area")


def grey_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with keys made from pixels; unreadable ones have none."""
    keyed = resample.with_key(greys(spark, sf_dir), "k", "content", "pixels", "width", "height", "area")
    return keyed.select(F.col("doc_id").alias("id"), "source", "k.sha256", "k.dhash", "k.width", "k.height")


GREY_RECORDS_SQL = AREA_SQL + HASHED_SQL.replace("{op}", "<") + """,
records AS (SELECT g.doc_id AS id, g.source, CASE WHEN dhash IS NOT NULL THEN sha256(unhex(s.h)) END AS sha256, dhash,
                   CASE WHEN dhash IS NOT NULL THEN g.w END AS width, CASE WHEN dhash IS NOT NULL THEN g.t END AS height
            FROM greys g JOIN sized s USING (doc_id) LEFT JOIN hashes USING (doc_id))"""


@query("j4_unreadable", GREY_RECORDS_SQL + """
SELECT count(*) AS records, count(*) FILTER (dhash IS NULL) AS unreadable, count(DISTINCT CASE WHEN dhash IS NOT NULL THEN (dhash, width, height) END) AS keys FROM records""")
def j4_unreadable(spark, sf_dir):
    return match.protected_keys(grey_records(spark, sf_dir))[1]


@query("d2_unreadable", GREY_RECORDS_SQL + """,
held AS (SELECT * FROM records WHERE source IN ('src0', 'src1') AND dhash IS NOT NULL),
m AS (SELECT *, CASE WHEN dhash IS NULL THEN 'unreadable' WHEN sha256 IN (SELECT sha256 FROM held) THEN 'benchmark_exact'
                     WHEN (dhash, width, height) IN (SELECT (dhash, width, height) FROM held) THEN 'benchmark_perceptual' END AS early
      FROM records WHERE source IS NULL OR source NOT IN ('src0', 'src1')),
k AS (SELECT *, first_value(sha256) OVER w AS kept, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY dhash, width, height, early IS NULL ORDER BY source, id))
SELECT id, CASE WHEN early IS NOT NULL THEN early WHEN r = 1 THEN NULL WHEN sha256 = kept THEN 'duplicate_exact' ELSE 'duplicate_perceptual' END AS drop_reason FROM k""")
def d2_unreadable(spark, sf_dir):
    every = grey_records(spark, sf_dir)
    benchmark = F.coalesce(F.col("source").isin("src0", "src1"), F.lit(False))
    return dedup.exclude_and_deduplicate(every.filter(~benchmark), every.filter(benchmark), ["source", "id"]).select("id", "drop_reason")


NAMES_SQL = "SELECT p_partkey, 'src' || CAST(p_partkey % 3 AS VARCHAR) AS source, {key} AS family FROM (SELECT p_partkey, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '_aug_' || CAST(p_partkey AS VARCHAR) ELSE '' END AS s, '.rf.' || CAST(p_partkey AS VARCHAR) AS m FROM part)"


def names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    aug = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_aug_"), F.col("p_partkey").cast("string"))).otherwise("")
    path = F.concat(F.lit("images/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), aug, F.lit(".rf."), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    return p.select("p_partkey", F.concat(F.lit("src"), (F.col("p_partkey") % 3).cast("string")).alias("source"), path.alias("path"))


def _family(mode, separator=":"):
    return lambda spark, sf_dir: names(spark, sf_dir).select("p_partkey", "source", keys.family(F.col("path"), F.col("source"), mode, separator).alias("family"))


_CUT = "regexp_replace(s, '(?i)[_-]aug(?:mented)?[_-]?[0-9]+$', '')"
_SRC = "'src' || CAST(p_partkey % 3 AS VARCHAR) || "
query("f6_family", NAMES_SQL.replace("{key}", _SRC + "':' || " + _CUT))(_family("marker_and_augment"))
query("f7_family_lower", NAMES_SQL.replace("{key}", _SRC + "'::' || lower(" + _CUT + ")"))(_family("marker_and_augment_lower", "::"))
query("f8_family_last_marker", NAMES_SQL.replace("{key}", _SRC + "':' || s"))(_family("last_marker"))


@query("f9_source_key", NAMES_SQL.replace("{key}", "lower(s)"))
def f9(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", "source", keys.family(F.col("path"), mode="name_lower").alias("family"))


@query("f10_output_name", "SELECT p_partkey, 'src' || CAST(p_partkey % 3 AS VARCHAR) || '__' || substr(sha256(p_name), 1, 12) || '.jpg' AS output_name FROM part")
def f10(spark, sf_dir):
    n = names(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return n.select("p_partkey", keys.output_name(F.col("source"), keys.sha256(F.col("p_name")), F.col("path"), 12).alias("output_name"))


@query("f10_numbered_name", "SELECT p_partkey, 'src_' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END || '_' || substr(sha1(p_name), 1, 10) || '.jpg' AS output_name FROM part")
def f10_numbered(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", keys.numbered_name(F.lit("src"), F.col("p_partkey"), F.col("p_name"), F.lit("d/a.JPG")).alias("output_name"))


# --- joins ---------------------------------------------------------------------------------


@query("j1_pairing", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'image_only' WHEN d.doc_id IS NULL THEN 'label_only' ELSE 'paired' END AS pairing
FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def j1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return match.pair(d, table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


PROTECT_SQL = f"""WITH {PICTURES_SQL}, held AS (SELECT * FROM pictures WHERE source IN ('src0', 'src1')), free AS (SELECT * FROM pictures WHERE source NOT IN ('src0', 'src1')),
m AS (SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM held h WHERE h.sha256 = f.sha256) THEN 'exact'
  WHEN EXISTS (SELECT 1 FROM held h WHERE h.dhash = f.dhash AND h.width = f.width AND h.height = f.height) THEN 'perceptual' END AS match FROM free f)"""


def _sides(spark, sf_dir):
    p = pictures(spark, sf_dir)
    held = F.col("source").isin("src0", "src1")
    return p.filter(~held), p.filter(held)


@query("j2_match_kind", PROTECT_SQL + " SELECT id, match FROM m")
def j2(spark, sf_dir):
    return match.match_kind(*_sides(spark, sf_dir)).select("id", "match")


@query("j3_protect", PROTECT_SQL + " SELECT id, source FROM m WHERE match IS NULL")
def j3(spark, sf_dir):
    return match.protect(*_sides(spark, sf_dir)).select("id", "source")


@query("j4_protected_keys", f"WITH {PICTURES_SQL} SELECT DISTINCT dhash, width, height FROM pictures WHERE source IN ('src0', 'src1')")
def j4(spark, sf_dir):
    return match.fingerprints(_sides(spark, sf_dir)[1])[1]


def _dated(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < F.lit("2001-02-24").cast("timestamp")
    return li.filter(early), li.filter(~early)


@query("j5_leakage_exclusion", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem l WHERE l_shipdate < TIMESTAMP '2001-02-24' AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_shipdate >= TIMESTAMP '2001-02-24' AND r.l_partkey = l.l_partkey)")
def j5(spark, sf_dir):
    train, valid = _dated(spark, sf_dir)
    return match.exclude_keys(train, valid, "l_partkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("j6_overlap", """SELECT l_partkey, a AS left_rows, b AS right_rows FROM (SELECT l_partkey, count(*) a FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-02-24' GROUP BY 1)
JOIN (SELECT l_partkey, count(*) b FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-02-24' GROUP BY 1) USING (l_partkey)""")
def j6(spark, sf_dir):
    return match.overlap(*_dated(spark, sf_dir), "l_partkey")


@query("j8_three_relations", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey""")
def j8(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    categories = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"), "l_suppkey", "l_linenumber")
    done = match.coco_labels(images, notes, categories)
    return done.select(F.col("image_id").alias("l_orderkey"), "l_linenumber", F.col("category_id").alias("l_partkey"), "l_suppkey", F.col("file_name").alias("o_orderpriority"), F.col("category").alias("p_name"))


@query("j9_compare", """WITH a AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS before, b.v AS after, b.v - a.v AS change FROM a FULL JOIN b ON a.user_id = b.user_id""")
def j9(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    best = lambda df: df.groupBy("user_id").agg(F.max("value").alias("v"))
    return match.compare(best(e.filter("event_type = 'click'")), best(e.filter("event_type = 'purchase'")), "user_id", "v")


# --- duplicates ----------------------------------------------------------------------------

ORDER = ["source", "id"]


@query("d1_dedup", f"WITH {PICTURES_SQL} SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY dhash, width, height ORDER BY source, id) AS k FROM pictures) WHERE k = 1")
def d1(spark, sf_dir):
    return dedup.deduplicate(pictures(spark, sf_dir), ORDER).select("id", "source")


@query("d1_counts", f"WITH {PICTURES_SQL} SELECT count(*) - count(DISTINCT sha256) AS exact, count(DISTINCT sha256) - count(DISTINCT (dhash, width, height)) AS perceptual, count(DISTINCT (dhash, width, height)) AS kept FROM pictures")
def d1_counts(spark, sf_dir):
    return dedup.two_passes(pictures(spark, sf_dir), "sha256", match.PERCEPTUAL)


@query("d2_counts", f"""WITH {PICTURES_SQL}, k AS (SELECT *, first_value(sha256) OVER w AS held, row_number() OVER w AS r FROM pictures WINDOW w AS (PARTITION BY dhash, width, height ORDER BY source, id))
SELECT CAST(sum(CASE WHEN r > 1 AND sha256 = held THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN r > 1 AND sha256 <> held THEN 1 ELSE 0 END) AS BIGINT) AS perceptual, CAST(sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM k""")
def d2_counts(spark, sf_dir):
    return dedup.one_pass(pictures(spark, sf_dir), "sha256", match.PERCEPTUAL, ORDER)


@query("d2_exclude_and_dedup", PROTECT_SQL + """, k AS (SELECT *, first_value(sha256) OVER w AS held, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY dhash, width, height, match IS NULL ORDER BY source, id))
SELECT id, CASE WHEN match = 'exact' THEN 'benchmark_exact' WHEN match = 'perceptual' THEN 'benchmark_perceptual' WHEN r = 1 THEN NULL WHEN sha256 = held THEN 'duplicate_exact' ELSE 'duplicate_perceptual' END AS drop_reason FROM k""")
def d2(spark, sf_dir):
    return dedup.exclude_and_deduplicate(*_sides(spark, sf_dir), ORDER).select("id", "drop_reason")


@query("d3_dedup_candidates", PROTECT_SQL + """ SELECT min(id) AS id, dhash FROM free WHERE dhash NOT IN (SELECT dhash FROM held) GROUP BY dhash""")
def d3(spark, sf_dir):
    free, held = _sides(spark, sf_dir)
    return dedup.first_of_each(match.exclude_keys(free, held, "dhash"), ["dhash"], ["id"]).select("id", "dhash")


@query("d4_first_per_key", "SELECT source, min(doc_id) AS doc_id, count(*) - 1 AS others FROM documents GROUP BY source")
def d4(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    first = dedup.first_of_each(d, ["source"], ["doc_id"])
    return first.join(d.groupBy("source").agg((F.count(F.lit(1)) - 1).alias("others")), "source")


@query("d5_distinct_annotations", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def d5(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return dedup.distinct_annotations(lines, ["l_orderkey"], "l_linenumber", "l_partkey")


# --- aggregates ----------------------------------------------------------------------------


def _parsed(spark, sf_dir):
    return labels.parsed(numeric_lines(spark, sf_dir), "line", "p", 7)


@query("a1_line_counts", f"SELECT count(*) FILTER ({VALID_SQL}) AS valid_lines, count(*) FILTER (l_linenumber < 6) AS box_lines, count(*) FILTER (l_linenumber = 6 AND {VALID_SQL}) AS polygon_lines, count(*) FILTER (NOT {VALID_SQL}) AS invalid_lines FROM lineitem")
def a1(spark, sf_dir):
    return report.line_counts(_parsed(spark, sf_dir), "p")


@query("a1_class_counts", f"SELECT CAST(l_linenumber AS INT) AS class_id, count(*) AS lines FROM lineitem WHERE {VALID_SQL} GROUP BY 1")
def a1_classes(spark, sf_dir):
    return report.class_counts(_parsed(spark, sf_dir), "p")


@query("a2_audit_by_split", f"SELECT l_returnflag AS split, count(DISTINCT l_orderkey) AS records, count(*) AS lines, count(*) FILTER (NOT {VALID_SQL}) AS invalid_lines FROM lineitem GROUP BY 1")
def a2(spark, sf_dir):
    return report.audited(_parsed(spark, sf_dir), "l_returnflag", "l_orderkey", "p")


COCO_SQL = """
im AS (SELECT c_custkey AS id, c_mktsegment <> 'MACHINERY' AS found, c_custkey % 17 > 0 AS sized FROM customer),
an AS (SELECT o_orderkey AS id, o_custkey AS image_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS cat, o_orderkey % 50 > 0 AS wide, substr(o_orderpriority, 3) AS name FROM orders)"""


def coco_file(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Writes customers as images and orders as annotations into one COCO file; also the images' paths.

    Images of some customers have no width, and those of one segment no file.
    """
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    name = F.concat(F.lit("batch/c"), F.col("c_custkey").cast("string"), F.lit(".jpg"))
    images = c.select(F.struct(F.col("c_custkey").alias("id"), name.alias("file_name"), F.when(F.col("c_custkey") % 17 > 0, 100).otherwise(0).alias("width"), F.lit(100).alias("height")).alias("x"))
    box = F.array(F.lit(10.0), F.lit(20.0), (F.col("o_orderkey") % 50).cast("double"), F.lit(20.0))
    cat = F.substring("o_orderpriority", 1, 1).cast("bigint")
    notes = o.select(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"), cat.alias("category_id"), box.alias("bbox")).alias("x"))
    cats = o.select(F.struct(cat.alias("id"), F.substring("o_orderpriority", 3, 20).alias("name")).alias("x")).distinct()
    root, rows = scratch(spark), None
    for k, (section, df) in enumerate((("images", images), ("annotations", notes), ("categories", cats))):
        keyed = df.select(F.col("x.id").alias("id"), F.to_json("x").alias("text"))
        first = keyed.agg(F.min("id")).first()[0]
        each = keyed.select(F.lit(k).alias("k"), "id", F.concat(F.when(F.col("id") == first, "\n").otherwise(",\n"), "text").alias("text"))
        begin = spark.createDataFrame([(k, None, ("{" if k == 0 else "],\n") + f'"{section}": [')], "k int, id long, text string")
        rows = begin.unionByName(each) if rows is None else rows.unionByName(begin).unionByName(each)
    outputs.write_joined(rows, f"{root}/notes.json", ["k", "id"], "text", tail="]}\n")
    found = c.filter("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("/data/"), name).alias("path"))
    return f"{root}/notes.json", found


@query("a3_coco_audit", f"WITH {COCO_SQL} SELECT (SELECT count(*) FROM im) AS declared_images, (SELECT count(*) FROM im WHERE found) AS found_images, (SELECT count(*) FROM im WHERE NOT found) AS missing_images, (SELECT count(*) FROM an) AS annotations, (SELECT count(DISTINCT cat) FROM an) AS categories")
def a3(spark, sf_dir):
    path, found = coco_file(spark, sf_dir)
    return coco.audit(coco.read(spark, path), found)


@query("a4_audit_union", f"""WITH {IMAGES_SQL}, {COCO_SQL}, t AS (SELECT (SELECT count(*) FROM cust) AS images, (SELECT count(*) FROM cust) AS label_files, (SELECT count(*) FROM ln) AS lines, (SELECT count(*) FROM ln WHERE odd OR cls >= 6) AS invalid_lines)
SELECT 'lines' AS source, unnest(['images', 'label_files', 'lines', 'invalid_lines']) AS measure, unnest([images, label_files, lines, invalid_lines]) AS n FROM t
UNION ALL SELECT 'coco', unnest(['declared_images', 'found_images', 'missing_images', 'annotations', 'categories']), unnest([(SELECT count(*) FROM im), 0, (SELECT count(*) FROM im), (SELECT count(*) FROM an), (SELECT count(DISTINCT cat) FROM an)])""")
def a4(spark, sf_dir):
    path, _ = coco_file(spark, sf_dir)
    specs = [{"name": "lines", "format": "lines", "root": tree(spark, sf_dir), "classes": 6}, {"name": "coco", "format": "coco", "root": f"{path}-none", "annotations": path}]
    return scan.audits(spark, specs)


@query("a5_zero_filled", "SELECT c.class_id, coalesce(n, 0) AS lines FROM (SELECT unnest(range(0, 10))::INT AS class_id) c LEFT JOIN (SELECT CAST(l_linenumber AS INT) AS class_id, count(*) AS n FROM lineitem WHERE " + VALID_SQL + " GROUP BY 1) USING (class_id)")
def a5(spark, sf_dir):
    return report.zero_filled(report.class_counts(_parsed(spark, sf_dir), "p"), "class_id", list(range(10)), "lines")


@query("a5_by_split", "SELECT l_linestatus AS source, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\", count(*) FILTER (l_returnflag IN ('A', 'N', 'R')) AS total FROM lineitem GROUP BY 1")
def a5_split(spark, sf_dir):
    return report.by_split(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"]).withColumnRenamed("l_linestatus", "source")


@query("a5_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a5_rollup(spark, sf_dir):
    return report.rolled_up(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("level", F.col("level").cast("long"))


REPEATS_SQL = "WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) - 1 AS again FROM lineitem GROUP BY 1, 2, 3)"


@query("a6_duplicate_lines", REPEATS_SQL + " SELECT count(*) FILTER (again > 0) AS records, CAST(coalesce(sum(again), 0) AS BIGINT) AS lines FROM (SELECT l_orderkey, sum(again) AS again FROM a GROUP BY 1)")
def a6(spark, sf_dir):
    return report.duplicate_lines(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag")[0]


@query("a6_duplicates_by_class", REPEATS_SQL + " SELECT l_returnflag, CAST(sum(again) AS BIGINT) AS lines FROM a GROUP BY 1 HAVING sum(again) > 0")
def a6_classes(spark, sf_dir):
    return report.duplicate_lines(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag")[1]


@query("a7_leakage", """WITH b AS (SELECT l_partkey, count(*) FILTER (l_shipdate < TIMESTAMP '2001-02-24') AS a, count(*) FILTER (l_shipdate >= TIMESTAMP '2001-02-24') AS b FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (a > 0) AS left_keys, count(*) FILTER (b > 0) AS right_keys, count(*) FILTER (a > 1) AS left_groups, count(*) FILTER (b > 1) AS right_groups,
CAST(sum(greatest(a - 1, 0)) AS BIGINT) AS left_extra, CAST(sum(greatest(b - 1, 0)) AS BIGINT) AS right_extra, count(*) FILTER (a > 0 AND b > 0) AS shared_keys FROM b""")
def a7(spark, sf_dir):
    return report.leakage(*_dated(spark, sf_dir), "l_partkey")


@query("a7_overlap_estimates", """WITH k AS (SELECT DISTINCT l_returnflag AS s, l_orderkey AS k FROM lineitem)
SELECT a.s AS "left", b.s AS "right", count(*) AS shared_keys, true AS within FROM k a JOIN k b ON a.k = b.k AND a.s < b.s GROUP BY a.s, b.s""")
def a7_estimates(spark, sf_dir):
    # the estimates beside the exact overlaps of the same splits, from one pass each
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey")
    said = report.overlap_estimates(report.key_sketches(li, "l_returnflag", "l_orderkey")).withColumnRenamed("shared_keys", "estimate")
    sides = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("s"))
    both = sides.select("s", F.explode("s").alias("left")).select("left", F.explode("s").alias("right")).filter("left < right")
    exact = both.groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared_keys"))
    return exact.join(said, ["left", "right"]).select("left", "right", "shared_keys", (F.abs(F.col("estimate") - F.col("shared_keys")) <= F.col("bound")).alias("within"))


@query("a8_argmax", """SELECT user_id, count(*) AS rows_, arg_max(event_id, (value, -epoch_us(ts), -event_id)) AS best_event, max(value) AS best_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1""")
def a8(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    done = report.best_and_last(e, ["user_id"], "value", ["at", "event_id"])
    return done.select("user_id", F.col("rows").alias("rows_"), F.col("best.event_id").alias("best_event"), F.col("best.value").alias("best_value"), "last_value")


@query("a9_preflight", "WITH r AS (SELECT l_returnflag, l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber >= 6) AS bad FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS records, count(*) FILTER (n = 0) AS empty_records, CAST(sum(n) AS BIGINT) AS annotations, CAST(sum(bad) AS BIGINT) AS invalid_lines FROM r GROUP BY 1")
def a9(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.lit("0.5 0.5 0.5 0.5"))
    return report.preflight(li.withColumn("p", labels.parse_line(line, 6)), ["l_returnflag"], "l_orderkey", "p")


@query("a10_class_frequency", "SELECT l_linenumber AS class_id, count(DISTINCT l_orderkey) AS records, count(*) AS annotations FROM lineitem GROUP BY 1")
def a10(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("classes"))
    return report.records_with_class(r, "l_orderkey", "classes")


@query("a11_families", "SELECT conv_id, count(*) AS members, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def a11(spark, sf_dir):
    g = report.grouped(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])
    return g.select("conv_id", F.size("members").cast("long").alias("members"), F.array_join(F.transform("members", lambda m: m["turn"].cast("string")), ",").alias("turns"))


@query("a12_distinct_contents", "SELECT count(DISTINCT sha256(text)) AS contents FROM documents")
def a12(spark, sf_dir):
    return detections.distinct_contents(table(spark, sf_dir, "documents"), "text")


@query("a13_result_record", "SELECT user_id, avg(value) AS mean_value, max(value) AS best_value, count(*) AS n, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def a13(spark, sf_dir):
    return report.result_record(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "error"])


# --- caps, splits, selections --------------------------------------------------------------

HASH = "sha256('26:' || CAST({} AS VARCHAR))"


@query("x1_cap_negatives", f"""WITH r AS (SELECT d.doc_id, d.source, quality = 0 AS is_negative FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT CAST(floor(0.05::DOUBLE * count(*) / (1 - 0.05::DOUBLE)) AS BIGINT) AS most FROM r WHERE NOT is_negative)
SELECT doc_id, source, is_negative FROM (SELECT *, row_number() OVER (PARTITION BY is_negative ORDER BY {HASH.format('doc_id')}, doc_id) AS k FROM r), n WHERE NOT is_negative OR k <= most""")
def x1(spark, sf_dir):
    return select.cap_negatives(labelled(spark, sf_dir), "is_negative", "doc_id", 0.05, SEED)


@query("x2_cap_after_dedup", f"""WITH {PICTURES_SQL}, u AS (SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY dhash, width, height ORDER BY source, id) AS k FROM pictures) WHERE k = 1),
r AS (SELECT id, u.source, quality = 0 AS is_negative FROM u JOIN labels ON doc_id = id), n AS (SELECT CAST(floor(0.05::DOUBLE * count(*) / (1 - 0.05::DOUBLE)) AS BIGINT) AS most FROM r WHERE NOT is_negative)
SELECT id, source, is_negative FROM (SELECT *, row_number() OVER (PARTITION BY is_negative ORDER BY {HASH.format('id')}, id) AS k FROM r), n WHERE NOT is_negative OR k <= most""")
def x2(spark, sf_dir):
    unique = dedup.deduplicate(pictures(spark, sf_dir), ORDER).select("id", "source")
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("is_negative"))
    return select.cap_negatives(unique.join(l, "id").select("id", "source", "is_negative"), "is_negative", "id", 0.05, SEED)


FAMILIES_SQL = f"""WITH f AS (SELECT l_orderkey AS family, min(o_orderpriority) AS source, count(*) AS size, {HASH.format('l_orderkey')} AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
"""


X3_SQL = """p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, family) = 1 AS first_ FROM f),
c AS (SELECT count(*) AS nf, count(DISTINCT source) AS ns, greatest(1, round_even(sum(size) * 0.12::DOUBLE, 0)) AS target FROM f),
q AS (SELECT p.*, nf, target, first_ AND target >= ns AND nf > ns AS pre FROM p, c),
b AS (SELECT coalesce(sum(size) FILTER (pre), 0) AS base, count(*) FILTER (pre) AS np FROM q),
w AS (SELECT q.*, base, np, coalesce(sum(size) OVER (PARTITION BY pre ORDER BY o, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY pre ORDER BY o, family) AS rk FROM q, b)"""
X3_SELECT = "SELECT family, source, size, CASE WHEN pre OR (base + before < target AND rk <= nf - 1 - np) THEN 'valid' ELSE 'train' END AS split FROM w"
X4_SQL = """c AS (SELECT count(*) AS nf, least(greatest(1, round_even(count(*) * 0.12::DOUBLE, 0)), count(*) - 1) AS target FROM f),
s AS (SELECT source, count(*) AS n FROM f GROUP BY 1), e AS (SELECT count(*) FILTER (n >= 2) AS el FROM s),
p AS (SELECT f.*, s.n, c.target, e.el, target >= el AS room, row_number() OVER (PARTITION BY f.source ORDER BY o, family) = 1 AND n >= 2 AND target >= el AS pre FROM f JOIN s USING (source), c, e),
r AS (SELECT *, row_number() OVER (PARTITION BY source, pre ORDER BY o, family) AS rk FROM p),
k AS (SELECT *, CASE WHEN pre THEN 0 ELSE row_number() OVER (PARTITION BY pre ORDER BY rk > n - 1 - CASE WHEN room AND n >= 2 THEN 1 ELSE 0 END, o, family) END AS pos FROM r)"""
X4_SELECT = "SELECT family, source, size, CASE WHEN pre OR pos <= target - CASE WHEN room THEN el ELSE 0 END THEN 'valid' ELSE 'train' END AS split FROM k"


@query("x3_split_by_records", FAMILIES_SQL + X3_SQL + " " + X3_SELECT)
def x3(spark, sf_dir):
    return select.split_by_records(families(spark, sf_dir), "l_orderkey", "source", 0.12, SEED)


@query("x4_split_by_families", FAMILIES_SQL + X4_SQL + " " + X4_SELECT)
def x4(spark, sf_dir):
    return select.split_by_families(families(spark, sf_dir), "l_orderkey", "source", 0.12, SEED)


PINNED_SQL = """
f AS (SELECT doc_id, source, doc_id // 2 AS family, sha256(coalesce(text, '')) AS key, CASE doc_id % 10 WHEN 0 THEN 'valid' WHEN 1 THEN 'train' END AS pin FROM documents),
e AS (SELECT DISTINCT a.family AS a, b.family AS b FROM f a JOIN f b USING (key) WHERE a.family <> b.family),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT family, coalesce(least(family, min(r.b)), family) AS cluster FROM (SELECT DISTINCT family FROM f) LEFT JOIN reach r ON r.a = family GROUP BY family),
g AS (SELECT cluster, count(*) AS size, bool_or(pin = 'valid') IS TRUE AS v, bool_or(pin = 'train') IS TRUE AS t FROM f JOIN c USING (family) GROUP BY cluster),
o AS (SELECT *, sha256('26:' || CAST(cluster AS VARCHAR)) AS o FROM g),
n AS (SELECT greatest(1, round_even(sum(size) * 0.3::DOUBLE, 0)) AS target, coalesce(sum(size) FILTER (v), 0) AS base, count(*) FILTER (NOT v AND NOT t) AS free, bool_or(t AND NOT v) IS TRUE AS kept FROM g),
p AS (SELECT *, row_number() OVER w AS k, coalesce(sum(size) OVER (ORDER BY o, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE NOT v AND NOT t WINDOW w AS (ORDER BY o, cluster)),
s AS (SELECT cluster, 'valid' AS split FROM o WHERE v UNION ALL SELECT cluster, 'train' FROM o WHERE t AND NOT v
      UNION ALL SELECT cluster, CASE WHEN before + base < target AND k <= free - CASE WHEN kept THEN 0 ELSE 1 END THEN 'valid' ELSE 'train' END FROM p, n)"""


@query("x3_pinned", f"WITH RECURSIVE {PINNED_SQL} SELECT family, cluster, split FROM c JOIN s USING (cluster)")
def x3_pinned(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("family", F.floor(F.col("doc_id") / 2)).withColumn("key", keys.sha256(F.coalesce("text", F.lit(""))))
    pin = F.when(F.col("doc_id") % 10 == 0, "valid").when(F.col("doc_id") % 10 == 1, "train")
    return select.split_pinned(d.withColumn("pin", pin), "family", ["key"], "pin", 0.3, SEED)


@query("x5_validation_plan", """SELECT 'train' AS side, l_orderkey FROM lineitem l WHERE l_shipdate < TIMESTAMP '2001-02-24' AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_shipdate >= TIMESTAMP '2001-02-24' AND r.l_partkey = l.l_partkey)
UNION ALL SELECT 'valid', min(l_orderkey) FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-02-24' GROUP BY l_partkey""")
def x5(spark, sf_dir):
    train, valid = (d.select("l_partkey", "l_orderkey") for d in _dated(spark, sf_dir))
    rest, owned = select.validation_plan(train, valid, "l_partkey", "l_orderkey")
    return rest.select(F.lit("train").alias("side"), "l_orderkey").unionByName(owned.select(F.lit("valid").alias("side"), "l_orderkey"))


RECORDS_SQL = """r AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_linenumber AS INT)))) AS classes, l_orderkey % 3 = 0 AS a FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
u AS (SELECT l_orderkey, unnest(classes) AS c FROM r), fq AS (SELECT c, count(*) AS n FROM u GROUP BY 1),
pr AS (SELECT l_orderkey, arg_min(c, (n, c)) AS prim FROM u JOIN fq USING (c) GROUP BY 1)"""


def _classed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4")
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("classes"))


@query("x6_balanced", f"""WITH {RECORDS_SQL}, m AS (SELECT r.l_orderkey, r.a, prim, {HASH.format('r.l_orderkey')} AS o, CASE WHEN prim <= 402 % 4 THEN 101 ELSE 100 END AS q FROM r JOIN pr USING (l_orderkey)),
w AS (SELECT *, CAST(round_even(q * 0.7::DOUBLE, 0) AS INT) AS wish, count(*) FILTER (a) OVER (PARTITION BY prim) AS na, count(*) FILTER (NOT a) OVER (PARTITION BY prim) AS nb, row_number() OVER (PARTITION BY prim, a ORDER BY o, l_orderkey) AS rk FROM m),
l AS (SELECT *, least(na, wish) AS ta, least(nb, q - least(na, wish)) AS tb FROM w),
k AS (SELECT *, CASE WHEN a THEN rk <= ta + least(na - ta, q - ta - tb) ELSE rk <= tb END AS picked FROM l)
SELECT l_orderkey, prim AS "primary", picked FROM (SELECT *, row_number() OVER (ORDER BY NOT picked, o, l_orderkey) AS pos FROM k) WHERE pos <= 402""")
def x6(spark, sf_dir):
    done = select.balanced(_classed(spark, sf_dir), "l_orderkey", "classes", F.col("l_orderkey") % 3 == 0, 402, SEED, 0.7, [1, 2, 3, 4])
    return done.select("l_orderkey", "primary", "picked")


@query("x7_primary_class", f"WITH {RECORDS_SQL} SELECT l_orderkey, prim AS primary_class FROM pr")
def x7(spark, sf_dir):
    r = _classed(spark, sf_dir)
    counts = {x["class"]: x["records"] for x in select.class_frequency(r, "classes").collect()}
    freq = F.create_map(*[F.lit(v) for c, n in sorted(counts.items()) for v in (c, n)])
    return r.select("l_orderkey", select.primary_class(F.col("classes"), freq).alias("primary_class"))


@query("x8_reject_sample", "SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber > 5) ORDER BY sha256('1026:' || CAST(l_orderkey AS VARCHAR)), l_orderkey LIMIT 50")
def x8(spark, sf_dir):
    return select.seeded_sample(table(spark, sf_dir, "lineitem").filter("l_linenumber > 5").select("l_orderkey").distinct(), "l_orderkey", 50, 1026)


@query("x9_inspection_sample", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASH.format('doc_id')}, doc_id) AS k FROM documents) WHERE k <= 8")
def x9(spark, sf_dir):
    return select.seeded_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 8, SEED, ["source"])


@query("w1_running_position", f"""SELECT l_orderkey, position, before FROM (SELECT l_orderkey, row_number() OVER w AS position, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
FROM (SELECT l_orderkey, count(*) AS size, {HASH.format('l_orderkey')} AS o FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY o, l_orderkey))""")
def w1(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size")).withColumn("o", keys.seeded_order(SEED, F.col("l_orderkey")))
    return placed(f, "o", size="size", tie=["l_orderkey"]).select("l_orderkey", "position", "before")


# --- rankings and sets ---------------------------------------------------------------------


@query("t1_ranked_detections", "SELECT event_id, value FROM events WHERE value >= 0.25 ORDER BY value DESC, event_id LIMIT 100")
def t1(spark, sf_dir):
    return report.ranked_detections(table(spark, sf_dir, "events"), "value", "event_id").select("event_id", "value").limit(100)


@query("t2_best_detection", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1")
def t2(spark, sf_dir):
    return report.best_detection(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", ["event_id", "value"])


@query("t3_newest_first", "SELECT user_id, max(ts) AS modified FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def t3(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("modified"))
    return runs.orderBy(F.desc("modified"), "user_id").limit(25)


@query("t4_first_overlaps", "SELECT l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-02-24' INTERSECT SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-02-24') ORDER BY 1 LIMIT 20")
def t4(spark, sf_dir):
    return match.overlap(*_dated(spark, sf_dir), "l_partkey").select("l_partkey").orderBy("l_partkey").limit(20)


@query("t5_confident", "SELECT event_id FROM events WHERE value >= 0.5")
def t5(spark, sf_dir):
    return report.confident(table(spark, sf_dir, "events"), "value", 0.5).select("event_id")


@query("t6_first_matching", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*e') ORDER BY p_name, p_partkey LIMIT 1")
def t6(spark, sf_dir):
    return report.first_matching(table(spark, sf_dir, "part"), "p_name", "^[a-m].*e", [F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "p_name")


@query("u1_union", "SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u1(spark, sf_dir):
    n = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("nationkey"))
    return n("customer", "c_nationkey").unionByName(n("supplier", "s_nationkey"))


@query("u2_intersection", "SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-02-24' INTERSECT SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-02-24'")
def u2(spark, sf_dir):
    a, b = _dated(spark, sf_dir)
    return a.select("l_partkey").intersect(b.select("l_partkey"))


@query("u3_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("u4_disjoint", "SELECT NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AS halves, NOT EXISTS (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) AS labelled")
def u4(spark, sf_dir):
    o, d = table(spark, sf_dir, "orders"), table(spark, sf_dir, "documents")
    halves = match.disjoint(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_orderkey")
    return spark.createDataFrame([(halves, match.disjoint(d, table(spark, sf_dir, "labels"), "doc_id"))], "halves boolean, labelled boolean")


@query("u5_concatenation", FAMILIES_SQL.rstrip(", \n") + " SELECT count(*) AS families, CAST(sum(size) AS BIGINT) AS records FROM f")
def u5(spark, sf_dir):
    s = x3(spark, sf_dir)
    both = s.filter("split = 'train'").union(s.filter("split = 'valid'"))
    return both.agg(F.count(F.lit(1)).alias("families"), F.sum("size").alias("records"))


# --- invariants, detections, builds --------------------------------------------------------


@query("i1_label_violations", """WITH v AS (SELECT l_linenumber, l_discount * 12 AS x, l_tax AS y, l_quantity / 40 AS w, l_tax * 20 AS h FROM lineitem)
SELECT code, count(*) AS n FROM (SELECT unnest([CASE WHEN l_linenumber = 7 THEN 'non_five_token_label' END, CASE WHEN l_linenumber BETWEEN 5 AND 6 THEN 'invalid_class_id' END,
CASE WHEN l_linenumber <> 7 AND NOT (x BETWEEN 0 AND 1) THEN 'invalid_x_center' END, CASE WHEN l_linenumber <> 7 AND NOT (y BETWEEN 0 AND 1) THEN 'invalid_y_center' END,
CASE WHEN l_linenumber <> 7 AND NOT (w > 0 AND w <= 1) THEN 'invalid_width' END, CASE WHEN l_linenumber <> 7 AND NOT (h > 0 AND h <= 1) THEN 'invalid_height' END]) AS code FROM v) WHERE code IS NOT NULL GROUP BY 1""")
def i1(spark, sf_dir):
    return checks.label_violations(boundary_lines(spark, sf_dir), "line", [1, 2, 3, 4])


@query("i1_dataset_violations", PROTECT_SQL + """, dk AS (SELECT doc_id, source FROM documents)
SELECT * FROM (SELECT 'benchmark_exact_overlap' AS code, count(*) AS n FROM m WHERE match = 'exact' UNION ALL SELECT 'benchmark_perceptual_overlap', count(*) FROM m WHERE match = 'perceptual'
UNION ALL SELECT 'missing_label_file', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'missing_image_file', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'exact_overlap', count(*) FROM (SELECT sha256 FROM free GROUP BY 1 HAVING count(DISTINCT source) > 1)
UNION ALL SELECT 'non_five_token_label', count(*) FROM ln WHERE odd UNION ALL SELECT 'invalid_class_id', count(*) FROM ln WHERE NOT odd AND cls > 3) WHERE n > 0""".replace(", dk AS (SELECT doc_id, source FROM documents)", f", {IMAGES_SQL}"))
def i1_dataset(spark, sf_dir):
    free, held = _sides(spark, sf_dir)
    docs, marks = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    lines = image_lines(spark, sf_dir).filter("line is not null")
    return checks.dataset_violations(free, "source", {"exact_overlap": ["sha256"]}, held, lines, "line", [0, 1, 2, 3], docs, marks, ["doc_id"])


@query("i1_split_violations", """SELECT * FROM (SELECT 'family_overlap' AS code, count(*) AS n FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)
UNION ALL SELECT 'exact_overlap', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1)) WHERE n > 0""")
def i1_split(spark, sf_dir):
    return checks.split_violations(table(spark, sf_dir, "lineitem"), "l_returnflag", {"family_overlap": ["l_partkey"], "exact_overlap": ["l_orderkey", "l_linenumber"]})


@query("i2_counts_check", """SELECT * FROM (SELECT 'unequal_counts' AS code, count(*) AS n FROM (SELECT l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) <> count(DISTINCT CASE WHEN l_linenumber < 6 THEN l_orderkey END))
UNION ALL SELECT 'class_out_of_range', count(*) FROM lineitem WHERE l_linenumber > 5 UNION ALL SELECT 'family_leakage', count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)) WHERE n > 0""")
def i2(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    return checks.built_violations(li, li.filter("l_linenumber < 6"), li, li, "l_returnflag", "l_orderkey", "l_orderkey", "l_linenumber", 6, "l_partkey")


@query("i3_absent_classes", "SELECT CAST(c AS INT) AS class_id FROM (SELECT unnest(range(0, 10)) AS c) WHERE c NOT IN (SELECT l_linenumber FROM lineitem WHERE " + VALID_SQL + ")")
def i3(spark, sf_dir):
    return checks.absent_classes(a5(spark, sf_dir), "class_id", "lines")


PREFLIGHT_SQL = """
v AS (SELECT split, id, n, (n > 0) AS lined FROM cust WHERE split <> 'test'),
l AS (SELECT v.split, v.id, k, cls, odd, y FROM v JOIN ln USING (id) WHERE id % 13 <> 0),
z AS (SELECT split, count(*) AS images, count(*) FILTER (id % 13 <> 0) AS labels, count(*) FILTER (id % 13 = 0) AS lone, count(*) FILTER (id % 13 <> 0 AND n = 0) AS empty FROM v GROUP BY split),
m AS (SELECT split, count(*) FILTER (NOT odd AND cls < 6) AS annotations, count(*) FILTER (odd) AS tokens, count(*) FILTER (NOT odd AND cls >= 6) AS classes FROM l GROUP BY split),
c AS (SELECT split, k AS class_id, count(cls) AS n FROM (SELECT unnest(range(0, 7)) AS k), (SELECT DISTINCT split FROM v) LEFT JOIN (SELECT split AS s, cls FROM l WHERE NOT odd AND cls < 6) ON s = split AND cls = k GROUP BY 1, 2)"""


@query("i3_preflight", f"""WITH {IMAGES_SQL}, {PREFLIGHT_SQL} SELECT split, unnest(['images', 'label_files', 'empty_labels', 'annotations', 'missing_label_file', 'non_five_token_label', 'invalid_class_id']) AS measure, unnest([images, labels, empty, annotations, lone, tokens, classes]) AS n FROM z JOIN m USING (split)
UNION ALL SELECT split, 'class_' || class_id, n FROM c UNION ALL SELECT split, 'absent_class_' || class_id, 1 FROM c WHERE n = 0 UNION ALL SELECT '', 'missing_description', 1""")
def i3_preflight(spark, sf_dir):
    # no description is written, one label file in thirteen is missing, and class 6 is asked for but no line has it
    found = scan.preflight(spark, tree(spark, sf_dir, missing=13), [f"class {k}" for k in range(7)], ("train", "valid"), known=range(6))
    return found.filter("n > 0 or measure rlike '^(class_|images|label_files|annotations|empty)'")


@query("i4_class_list", "SELECT count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation")
def i4(spark, sf_dir):
    n = checks.require_classes(checks.require_rows(table(spark, sf_dir, "nation"), 25), "n_nationkey", "n_name", [f"NATION_{i}" for i in range(25)])
    listed = n.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    return listed.select("n", F.array_join(F.transform("l", lambda x: x["n_name"]), ",").alias("names"))


@query("e1_extract_detections", "SELECT event_id, 'c' || CAST(user_id % 3 AS VARCHAR) AS class, value AS confidence, CAST(printf('%.1f', value) AS DOUBLE) AS left_, CAST(printf('%.1f', value / 3) AS DOUBLE) AS top_ FROM events")
def e1(spark, sf_dir):
    box = F.struct((F.col("user_id") % 3).cast("int").alias("cls"), F.col("value").alias("conf"), F.array(F.col("value"), F.col("value") / 3).alias("xyxy"))
    found = detections.extracted(table(spark, sf_dir, "events").select("event_id", F.array(box).alias("b")), ["event_id"], "b", {0: "c0", 1: "c1", 2: "c2"})
    return found.select("event_id", "class", "confidence", F.get("box", 0).alias("left_"), F.get("box", 1).alias("top_"))


@query("e2_detection_rows", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, event_type AS class, round_even(value / 7, 3) AS confidence FROM events")
def e2(spark, sf_dir):
    item = F.struct(F.col("event_id"), F.col("event_type").alias("class"), (F.col("value") / 7).alias("confidence"))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return detections.numbered(per, ["user_id"], "items").withColumn("number", F.col("number").cast("long"))


# --- whole scans and files -----------------------------------------------------------------


@query("s1_paired_records", OUTCOME_SQL + """, e AS (SELECT *, CASE WHEN n = 0 THEN 'empty_label' WHEN odd THEN 'non_detection_label' WHEN top >= 4 THEN 'unsupported_class' END AS drop_reason FROM r)
SELECT 'customers' AS source, split AS source_split, 'c' || id AS stem, CASE WHEN drop_reason IS NULL THEN labels ELSE '' END AS labels, false AS is_negative, drop_reason FROM e""")
def s1(spark, sf_dir):
    done = scan.paired_records(spark, policy(tree(spark, sf_dir), unsupported=frozenset(range(4, 8))))
    return done.select("source", "source_split", stem_of("image_path"), F.array_join("labels", "|").alias("labels"), "is_negative", "drop_reason")


@query("s2_nested_records", OUTCOME_SQL + " SELECT 'customers' AS source, split AS source_split, 'c' || id AS stem, CASE WHEN outcome = 'kept' THEN labels ELSE '' END AS labels, outcome FROM d")
def s2(spark, sf_dir):
    done = scan.nested_records(spark, policy(tree(spark, sf_dir, missing=13), negative=frozenset((4, 5))))
    return done.select("source", "source_split", stem_of("image_path"), F.array_join("labels", "|").alias("labels"), "outcome")


@query("s4_label_lines", f"WITH {IMAGES_SQL} SELECT 'c' || cust.id AS stem, CAST(k - 1 AS INT) AS line_no, cls || ' 0.5 ' || y || ' 0.25 0.125' || CASE WHEN odd THEN ' 9' ELSE '' END AS line FROM cust LEFT JOIN ln USING (id)")
def s4(spark, sf_dir):
    return files.label_lines(spark, tree(spark, sf_dir)).select(stem_of("path"), "line_no", "line")


@query("s9_labelled_candidates", f"""WITH {IMAGES_SQL}, g AS (SELECT id, split, string_agg(cls - 1 || ' 0.5 ' || y || ' 0.25 0.125', '|' ORDER BY k) FILTER (cls BETWEEN 1 AND 4) AS labels, string_agg(CASE WHEN cls = 0 THEN 'BIODEGRADABLE' ELSE 'class_' || cls END, '|' ORDER BY k) FILTER (cls = 0 OR cls > 4) AS other FROM ln GROUP BY 1, 2)
SELECT 'c' || id AS stem, split AS source_split, CASE WHEN other IS NULL THEN labels ELSE '' END AS labels, coalesce(other, '') AS unknown_labels, CASE WHEN labels IS NULL THEN 'reject' WHEN other IS NULL THEN 'core' ELSE 'mixed' END AS part FROM g""")
def s9(spark, sf_dir):
    classes = spark.createDataFrame([(c, c - 1, "target") for c in range(1, 5)], "source_class int, target_class int, role string")
    done = scan.labelled_candidates(spark, tree(spark, sf_dir), classes)
    return done.select(stem_of("image_path"), "source_split", F.array_join("labels", "|").alias("labels"), F.array_join("unknown_labels", "|").alias("unknown_labels"), "part")


@query("s10_coco_candidates", f"""WITH {COCO_SQL}, g AS (SELECT im.id, count(*) FILTER (cat <= 4 AND sized AND wide) AS n_boxes, coalesce(string_agg(DISTINCT CAST(cat - 1 AS VARCHAR), ',' ORDER BY CAST(cat - 1 AS VARCHAR)) FILTER (cat <= 4 AND sized AND wide), '') AS classes,
coalesce(string_agg(name, ',' ORDER BY name) FILTER (cat = 5), '') AS unknown_labels FROM im JOIN an ON im.id = image_id WHERE found GROUP BY 1)
SELECT id, n_boxes, classes, unknown_labels, CASE WHEN classes <> '' AND unknown_labels <> '' THEN 'mixed' WHEN classes <> '' THEN 'core' WHEN unknown_labels <> '' THEN 'reject' ELSE 'empty' END AS part FROM g""")
def s10(spark, sf_dir):
    path, found = coco_file(spark, sf_dir)
    classes = spark.createDataFrame([(c, c - 1, "target") for c in range(1, 5)], "source_class int, target_class int, role string")
    done = coco.candidates(coco.read(spark, path), found, classes)
    joined = F.array_join(F.transform("classes", lambda c: c.cast("string")), ",")
    return done.select("id", F.size("boxes").cast("long").alias("n_boxes"), joined.alias("classes"), F.array_join("unknown_labels", ",").alias("unknown_labels"), "part")


@query("k1_written_dataset", OUTCOME_SQL + """ SELECT split, 'c' || id AS stem, true AS image, labels AS label FROM r WHERE n > 0 AND NOT odd AND top < 4""")
def k1(spark, sf_dir):
    done = scan.paired_records(spark, policy(tree(spark, sf_dir), unsupported=frozenset(range(4, 8)))).filter("drop_reason is null")
    named = done.withColumn("output_name", keys.base_name(F.col("image_path"))).withColumnRenamed("source_split", "final_split")
    root = scratch(spark) + "/out"
    outputs.write_dataset(named, root)
    images = files.images(spark, root).select(files.split_of(F.col("path")).alias("split"), stem_of("path"), (F.col("length") > 0).alias("image"))
    lines = files.label_lines(spark, root).groupBy(files.split_of(F.col("path")).alias("split"), stem_of("path")).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return images.join(lines, ["split", "stem"], "full_outer").select("split", "stem", "image", F.array_join(F.transform("l", lambda x: x["line"]), "|").alias("label"))


# --- builds ---------------------------------------------------------------------------------

RECORDS_HEAD = f"""WITH {PICTURES_SQL}, held AS (SELECT DISTINCT sha256 FROM pictures WHERE source = 'src0'), heldp AS (SELECT DISTINCT dhash, width, height FROM pictures WHERE source = 'src0'),
rec AS (SELECT p.*, quality = 0 AS neg, p.source || ':' || coalesce(lang, 'none') AS family_id FROM pictures p JOIN labels l ON l.doc_id = id JOIN documents d ON d.doc_id = id WHERE p.source <> 'src0'),
"""
CAP_SQL = f"""n AS (SELECT CAST(floor(0.05::DOUBLE * count(*) / (1 - 0.05::DOUBLE)) AS BIGINT) AS most FROM {{rel}} WHERE NOT neg),
{{out}} AS (SELECT * EXCLUDE (k, most) FROM (SELECT *, row_number() OVER (PARTITION BY neg ORDER BY {HASH.format('id')}, id) AS k FROM {{rel}}), n WHERE NOT neg OR k <= most)"""
TAG_SQL = """mt AS (SELECT c.*, CASE WHEN sha256 IN (SELECT sha256 FROM held) THEN 'benchmark_exact' WHEN (dhash, width, height) IN (SELECT (dhash, width, height) FROM heldp) THEN 'benchmark_perceptual' END AS hit FROM {rel} c),
tagged AS (SELECT *, CASE WHEN hit IS NOT NULL THEN hit WHEN row_number() OVER q = 1 THEN NULL WHEN sha256 = first_value(sha256) OVER q THEN 'duplicate_exact' ELSE 'duplicate_perceptual' END AS drop_reason
  FROM mt WINDOW q AS (PARTITION BY dhash, width, height, hit IS NULL ORDER BY source, image_path)),
uni AS (SELECT * EXCLUDE (hit, drop_reason) FROM tagged WHERE drop_reason IS NULL)"""
SPLIT_SQL = f""", f AS (SELECT family_id AS family, min(source) AS source, count(*) AS size, {HASH.format('family_id')} AS o FROM {{rel}} GROUP BY 1),
"""
SUMMARY_SQL = """ SELECT r.source, split AS outcome, count(*) AS n FROM {rel} r JOIN sp ON family = family_id GROUP BY 1, 2
UNION ALL SELECT source, 'dropped:' || drop_reason, count(*) FROM tagged WHERE drop_reason IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT source, 'dropped:negative_cap', count(*) FROM {over} WHERE id NOT IN (SELECT id FROM {capped}) GROUP BY 1, 2"""
FIRST_SQL = RECORDS_HEAD + CAP_SQL.format(rel="rec", out="cap") + ", " + TAG_SQL.format(rel="cap")
LAST_SQL = RECORDS_HEAD + TAG_SQL.format(rel="rec") + ", " + CAP_SQL.format(rel="uni", out="cap")


@query("b1_build_counts", FIRST_SQL + " SELECT (SELECT count(*) FROM rec) - (SELECT count(*) FROM uni) AS dropped, (SELECT count(*) FROM uni) AS kept, (SELECT count(*) FROM uni WHERE neg) AS negatives")
def b1(spark, sf_dir):
    done = curated(spark, sf_dir)
    kept = done.kept.agg(F.count(F.lit(1)).alias("kept"), F.count_if("is_negative").alias("negatives"))
    return done.dropped.agg(F.count(F.lit(1)).alias("dropped")).join(kept, F.lit(True)).select("dropped", "kept", "negatives")


def curated(spark: SparkSession, sf_dir: str, mode: str = "cap_first") -> builds.Build:
    """Labelled documents as records, those of the first source as the protected benchmark."""
    p = pictures(spark, sf_dir)
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("is_negative"))
    language = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("lang"))
    labelled_ = p.filter("source <> 'src0'").join(l, "id").join(language, "id")
    records = labelled_.withColumn("family_id", F.concat_ws(":", "source", "lang")).drop("lang")
    priority = [f"src{i}" for i in sorted(range(1, 20), key=str)]
    return builds.build(records, p.filter("source = 'src0'"), priority, 0.05, 0.12, SEED, mode)


@query("b2_build_last_mode", LAST_SQL + SPLIT_SQL.format(rel="cap") + X4_SQL + ", sp AS (" + X4_SELECT + ")" + SUMMARY_SQL.format(rel="cap", over="uni", capped="cap"))
def b2(spark, sf_dir):
    return builds.summary(curated(spark, sf_dir, "cap_last"))


def curate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a whole build, as counts by source and outcome."""
    return builds.summary(curated(spark, sf_dir))


query("b3_build_summary", FIRST_SQL + SPLIT_SQL.format(rel="uni") + X3_SQL + ", sp AS (" + X3_SELECT + ")" + SUMMARY_SQL.format(rel="uni", over="rec", capped="cap"))(curate_documents)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- files written and read back -----------------------------------------------------------


def archives(spark: SparkSession, sf_dir: str) -> str:
    """Writes the customers' label files into a ZIP archive for each nation; odd nations' are only stored."""
    lines = image_lines(spark, sf_dir)
    texts = lines.groupBy("id", "split").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        held, n = io.BytesIO(), int(pdf["nation"].iloc[0])
        with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED if n % 2 else zipfile.ZIP_DEFLATED) as z:
            z.writestr("labels/", "")
            for r in pdf.sort_values("id").itertuples(index=False):
                z.writestr(f"{r.split}/labels/c{r.id}.txt", r.content)
        return pd.DataFrame({"name": [f"nation{n}.ZIP" if n % 3 else f"deep/nation{n}.zip"], "content": [held.getvalue()]})

    made = texts.join(nation, "id").groupBy("nation").applyInPandas(packed, "name string, content binary")
    root = scratch(spark)
    outputs.write_files(made, root, "name", "content")
    return root


@query("s8_archive_members", f"""WITH {IMAGES_SQL}, texts AS (SELECT id, coalesce(string_agg(cls || ' 0.5 ' || y || ' 0.25 0.125' || CASE WHEN odd THEN ' 9' ELSE '' END, chr(10) ORDER BY k), '') AS t FROM cust LEFT JOIN ln USING (id) GROUP BY id)
SELECT 'nation' || c_nationkey AS archive, cust.split || '/labels/c' || id || '.txt' AS member, t AS content FROM cust JOIN customer ON c_custkey = id JOIN texts USING (id)""")
def s8(spark, sf_dir):
    members = files.archive_members(spark, archives(spark, sf_dir))
    return members.select(stem_of("archive").alias("archive"), "member", files.decoded(F.col("content")).alias("content"))


MANIFEST_SQL = """
m AS (SELECT 'o' || o_orderkey || '.jpg' AS output_name, o_orderpriority AS source, o_orderstatus AS source_split, 'f' || o_custkey AS family_id, o_orderkey % 2 = 0 AS is_negative,
             '/in/' || o_custkey || '/' || o_orderkey || ',a.jpg' AS source_image, CASE WHEN o_orderkey % 5 = 0 THEN 'valid' ELSE 'train' END AS final_split, o_orderkey, o_custkey FROM orders),
v(variant, brk, bom, yes, no, whole) AS (VALUES ('plain', chr(10), '', 'true', 'false', false), ('windows', chr(13) || chr(10), '', 'True', 'False', true), ('marked', chr(13) || chr(10), chr(65279), 'True', 'False', true)),
t AS (SELECT variant, any_value(bom) || 'source,source_split,family_id,is_negative,source_image,output_name,final_split,sha256,dhash,width,height' || any_value(brk)
             || string_agg(source || ',' || source_split || ',' || family_id || ',' || CASE WHEN is_negative THEN yes ELSE no END || ',"' || CASE WHEN whole THEN source_image ELSE o_orderkey || ',a.jpg' END || '",' || output_name || ',' || final_split
                 || ',' || sha256(CAST(o_orderkey AS VARCHAR)) || ',,' || o_custkey || ',1' || brk, '' ORDER BY output_name) AS t FROM m, v GROUP BY variant)"""


@query("k2_manifests", f"WITH {MANIFEST_SQL} SELECT variant, CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM t")
def k2(spark, sf_dir):
    o, text = table(spark, sf_dir, "orders"), lambda c: F.col(c).cast("string")
    records = o.select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("source_split"), F.concat(F.lit("f"), text("o_custkey")).alias("family_id"), (F.col("o_orderkey") % 2 == 0).alias("is_negative"),
        F.concat(F.lit("/in/"), text("o_custkey"), F.lit("/"), text("o_orderkey"), F.lit(",a.jpg")).alias("source_image"), F.concat(F.lit("o"), text("o_orderkey"), F.lit(".jpg")).alias("output_name"),
        F.when(F.col("o_orderkey") % 5 == 0, "valid").otherwise("train").alias("final_split"), keys.sha256(text("o_orderkey")).alias("sha256"), F.lit(None).cast("string").alias("dhash"),
        F.col("o_custkey").alias("width"), F.lit(1).alias("height"),
    )
    root = scratch(spark)
    for variant in outputs.VARIANTS:
        outputs.write_manifest(records, f"{root}/{variant}.csv", variant)
    found = files.digests(files.listing(spark, root).filter("path like '%.csv'"))
    return found.select(stem_of("path").alias("variant"), F.col("length").alias("bytes"), "sha256")


def run_tree(spark: SparkSession, sf_dir: str) -> str:
    """Writes a run folder for each user of the events: a result table of their events in order, with
    other headers for odd users and none for each fifth, and weights for some."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    odd, user = F.col("user_id") % 2 == 1, F.concat(F.lit("u"), F.col("user_id").cast("string"))
    line = F.when(odd, F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string"))).otherwise(F.concat_ws(" , ", F.lit("x"), F.col("value").cast("string"), F.col("event_id").cast("string")))
    held = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", line.alias("line")))).alias("l"))
    head = F.when(odd, F.lit("epoch,metrics/mAP50-95\n")).otherwise(F.lit("\ufeff other, metrics/mAP50-95(B) ,epoch\r\n"))
    body = F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    tables = held.filter("user_id % 5 <> 0").select(F.concat(F.lit("runs/"), user, F.lit("/results.csv")).alias("name"), body.alias("content"))
    weights = held.filter("user_id % 3 = 0").select(F.concat(F.lit("runs/"), user, F.when(odd, "/weights/best.pt").otherwise("/Weights/last.pt")).alias("name"), F.lit("w").alias("content"))
    args = held.select(F.concat(F.lit("runs/"), user, F.lit("/args.yaml")).alias("name"), F.lit("epochs: 3").alias("content"))
    root = scratch(spark)
    outputs.write_files(tables.unionByName(weights).unionByName(args), root, "name", "content")
    return root


RUNS_SQL = """
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
g AS (SELECT user_id, count(*) AS n, arg_max(event_id, (value, -k)) AS epoch, max(value) AS best, arg_max(value, k) AS last_value FROM e GROUP BY user_id)"""
METRIC = ["metrics/mAP50-95(B)", "metrics/mAP50-95"]


@query("s14_run_rows", f"WITH {RUNS_SQL} SELECT 'u' || user_id AS run, CAST(k AS INTEGER) AS row_no, CAST(event_id AS VARCHAR) AS epoch, value FROM e WHERE user_id % 5 <> 0")
def s14(spark, sf_dir):
    tables = runs.run_files(files.listing(spark, run_tree(spark, sf_dir))).filter("mark = 'results'")
    return runs.run_rows(tables).select(keys.base_name(F.col("run")).alias("run"), "row_no", F.col("values")["epoch"].alias("epoch"), runs.value_of(F.col("values"), METRIC).alias("value"))


@query("s15_inventory", f"""WITH {RUNS_SQL} SELECT 'u' || user_id AS run, user_id % 5 <> 0 AS has_results, user_id % 3 = 0 AND user_id % 2 = 1 AS has_best, false AS has_last, CASE WHEN user_id % 5 <> 0 THEN n ELSE 0 END AS n_epochs,
CASE WHEN user_id % 5 <> 0 THEN CAST(epoch AS VARCHAR) END AS epoch, CASE WHEN user_id % 5 <> 0 THEN best END AS best, CASE WHEN user_id % 5 <> 0 THEN last_value END AS last_value FROM g WHERE user_id % 5 <> 0 OR user_id % 3 = 0""")
def s15(spark, sf_dir):
    found = runs.inventory(spark, run_tree(spark, sf_dir), METRIC)
    return found.select(keys.base_name(F.col("run")).alias("run"), "has_results", "has_best", "has_last", "n_epochs", "epoch", "best", "last_value")


@query("k3_report_json", """WITH c AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT '{' || chr(10) || '  "lines": [' || chr(10) || string_agg('    {' || chr(10) || '      "flag": "' || f || '",' || chr(10) || '      "n": ' || n || ',' || chr(10) || '      "status": "' || s || '"' || chr(10) || '    }', ',' || chr(10) ORDER BY f, s) || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS text FROM c""")
def k3(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy("flag", "status")
    path = f"{scratch(spark)}/report.json"
    outputs.write_json(outputs.report(lines=c), path)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


@query("k5_comparison", """WITH a AS (SELECT l_returnflag AS k, avg(l_discount) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag AS k, avg(l_discount) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT '| flag | before | after | change |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || coalesce(a.k, b.k) || ' | ' || coalesce(printf('%.4f', a.v), 'N/A') || ' | ' || coalesce(printf('%.4f', b.v), 'N/A') || ' | ' || coalesce(printf('%+.4f', b.v - a.v), 'N/A') || ' |' || chr(10), '' ORDER BY coalesce(a.k, b.k)) AS text FROM a FULL JOIN b ON a.k = b.k""")
def k5(spark, sf_dir):
    mean = lambda s: table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_discount").alias("v"))
    rows, path = match.compare(mean("F"), mean("O"), "flag", "v"), f"{scratch(spark)}/comparison.md"
    outputs.write_text(outputs.comparison_markdown(rows, "flag"), path)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
