"""Line formats: registries, pair lists, trust grids, triangle meshes and scan metadata."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminae.session import settled


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_registry(df: DataFrame, path: str) -> None:
    """Replaces a registry as a whole."""
    df.write.mode("overwrite").json(path)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(surf, ct, rest, options): space-separated tokens with an optional tail of k=v; # starts a comment line."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    tokens = F.split(F.trim("value"), r"\s+")
    plain = F.filter(tokens, lambda t: ~t.contains("="))
    options = F.map_from_entries(F.transform(F.filter(tokens, lambda t: t.contains("=")), lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substring_index(t, "=", -1).alias("v"))))
    return lines.select(F.element_at(plain, 1).alias("surf"), F.try_element_at(plain, F.lit(2)).alias("ct"), F.slice(plain, 3, 4).alias("rest"), options.alias("options"))


def trust_grid(lines: DataFrame) -> DataFrame:
    """(tv, tu, verdict) from rows (row, value) of P, F and ?, the header left out."""
    letters = F.posexplode(F.split(F.regexp_replace("value", r"\s+", ""), "(?!$)"))
    return lines.select(F.col("row").alias("tv"), letters.alias("tu", "verdict")).filter("verdict in ('P', 'F', '?')")


def _numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of ``by``, numbered in ranges; what is gathered is one count a range."""
    part = settled(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in part.groupBy("_part").count().collect())
    before = accumulate((n for _, n in counts), initial=0)
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return part.join(F.broadcast(starts), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def triangles(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of OBJ lines (n, value); fans of faces; negative indices count back; bad ones are errors.

    ``n`` is the line's number. Vertices are numbered in line order from 1.
    """
    parts = lines.select("n", F.split(F.trim("value"), r"\s+").alias("t"))
    points = parts.filter("t[0] = 'v'").select("n", *(F.col("t")[k].cast("double").alias(a) for k, a in ((1, "x"), (2, "y"), (3, "z"))))
    vertices = _numbered(points, "n", "vertex")
    corner = F.transform(F.slice("t", 2, F.size("t")), lambda c: F.substring_index(c, "/", 1).cast("int"))
    faces = parts.filter("t[0] = 'f'").select("n", corner.alias("c"))
    total = vertices.agg(F.count("*").alias("total"))
    fixed = faces.crossJoin(F.broadcast(total)).select("n", F.transform("c", lambda i: F.when(i < 0, F.col("total") + i + 1).otherwise(i)).alias("c"), "total")
    good = F.forall("c", lambda i: (i >= 1) & (i <= F.col("total"))) & (F.size("c") >= 3)
    checked = fixed.withColumn("c", F.when(good, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("bad face in line "), F.col("n").cast("string")))))
    fans = F.transform(F.sequence(F.lit(2), F.size("c") - 1), lambda k: F.struct(F.col("c")[0].alias("a"), F.element_at("c", k).alias("b"), F.element_at("c", k + 1).alias("c")))
    return vertices.select("vertex", "z", "y", "x"), checked.select("n", F.explode(fans).alias("f")).select("f.*")


def json_number(text: Column | str, key: str) -> Column:
    """The first number under ``key`` anywhere in a JSON text."""
    return F.nullif(F.regexp_extract(text, f'"{key}"\\s*:\\s*(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)', 1), F.lit("")).cast("double")


def to_microns(value: Column, unit: Column) -> Column:
    return F.when(unit == "mm", value * 1000).otherwise(value)


def url_parts(url):
    """Columns (section, item) of URLs that end in /section/number; null where they do not."""
    section, item = (F.nullif(F.regexp_extract(url, "/([a-z]+)/([0-9]+)", k), F.lit("")) for k in (1, 2))
    return section, item.cast("bigint")


def numeric_fields(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, k, v): the numbers among the fields of a flat JSON object."""
    pairs = F.explode(F.from_json(column, "map<string,string>")).alias("k", "_s")
    return rows.select(key, pairs).select(key, "k", F.expr("try_cast(_s as double)").alias("v")).filter("v is not null")
