"""Projections of the given tables onto volumes, meshes and registries, in both engines' words."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = (16, 32, 32)
#: Order keys that share a slice of the grown volume: about as many rows as a slice has voxels, at any size.
KEYS_A_SLICE = 256


class Tables:
    """The given tables of one folder, and the views that the queries share."""

    shape = SHAPE
    #: Places of a residue of windings, which have nine: at six, a larger volume meets exact halves.
    residue_places = 6

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def slice_of(self, key):
        return key % SHAPE[0]

    def slab_of(self, z):
        return z % 4

    def volume(self, how) -> DataFrame:
        keys = [self.slice_of(F.col("l_orderkey")).alias("z"), (F.col("l_partkey") % SHAPE[1]).alias("y"), (F.col("l_suppkey") % SHAPE[2]).alias("x")]
        return self.lineitem.groupBy(*keys).agg(how(F.floor("l_quantity").cast("int")).alias("v"))

    def ct(self) -> DataFrame:
        return self.volume(F.max)

    def gt(self) -> DataFrame:
        return self.volume(F.min)

    def fg(self) -> DataFrame:
        return self.gt().filter("v >= 20").select("z", "y", "x")

    def points(self) -> DataFrame:
        at = [(F.col("embedding")[k].cast("double") * 100).alias(a) for k, a in enumerate(("z", "y", "x"))]
        normal = [F.col("embedding")[k + 3].cast("double").alias(f"n{a}") for k, a in enumerate(("z", "y", "x"))]
        return self.embeddings.select((F.col("vec_id") % 97).alias("mesh"), F.col("vec_id").alias("id"), *at, *normal)

    def scores(self) -> DataFrame:
        joined = self.documents.select("doc_id", "n_chars").join(self.labels, "doc_id")
        return joined.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000.0).alias("p"), F.col("quality").alias("y"))


class GrownTables(Tables):
    """The same tables under a volume that gains slices as orders come in: order keys are not folded.

    Rows a voxel stay the same, so the largest and smallest quantities of a voxel do not saturate.
    """

    residue_places = 9

    @cached_property
    def shape(self) -> tuple[int, int, int]:
        last = self.lineitem.agg(F.max("l_orderkey")).first()[0]
        return (last // KEYS_A_SLICE + 1 if last is not None else 1, *SHAPE[1:])

    def slice_of(self, key):
        return F.floor(key / KEYS_A_SLICE)

    def slab_of(self, z):
        return F.floor(z / 4)


_LAST = f"(SELECT coalesce(max(l_orderkey)//{KEYS_A_SLICE},0) FROM lineitem)"


def grown_sql(sql: str) -> str:
    """The SQL of a query over the folded volume, over the grown one: its slices, its last slice, its slabs."""
    for folded, grown in (
        ("l_orderkey%16 z", f"l_orderkey//{KEYS_A_SLICE} z"),
        ("range(16) a(i)", f"(SELECT unnest(range({_LAST}+1)) i) a"),
        ("z BETWEEN 0 AND 15", f"z BETWEEN 0 AND {_LAST}"),
        (">15 THEN 2*15+1-", f">{_LAST} THEN 2*{_LAST}+1-"),
        ("z+dz,0),15)", f"z+dz,0),{_LAST})"),
        ("least(greatest(zz+t,0),15)", f"least(greatest(zz+t,0),{_LAST})"),
        ("least(greatest(i.z+d,0),15)", f"least(greatest(i.z+d,0),{_LAST})"),
        ("+k,15)", f"+k,{_LAST})"),
        ("+i,15)", f"+i,{_LAST})"),
        ("least(z,15)", f"least(z,{_LAST})"),
        ("z IN (0,15)", f"z IN (0,{_LAST})"),
        ("z%4 b", "z//4 b"),
        ("//2+1],6) base", "//2+1],9) base"),
    ):
        sql = sql.replace(folded, grown)
    return sql


VIEWS = {
    "ct": "SELECT l_orderkey%16 z, l_partkey%32 y, l_suppkey%32 x, max(CAST(floor(l_quantity) AS INT)) v FROM lineitem GROUP BY 1,2,3",
    "gt": "SELECT l_orderkey%16 z, l_partkey%32 y, l_suppkey%32 x, min(CAST(floor(l_quantity) AS INT)) v FROM lineitem GROUP BY 1,2,3",
    "fg": "SELECT z,y,x FROM gt WHERE v>=20",
    "points": "SELECT vec_id%97 mesh, vec_id id, CAST(embedding[1] AS DOUBLE)*100 z, CAST(embedding[2] AS DOUBLE)*100 y, CAST(embedding[3] AS DOUBLE)*100 x, CAST(embedding[4] AS DOUBLE) nz, CAST(embedding[5] AS DOUBLE) ny, CAST(embedding[6] AS DOUBLE) nx FROM embeddings",
    "scores": "SELECT doc_id id, (n_chars%1000)/1000.0::DOUBLE p, quality y FROM documents JOIN labels USING (doc_id)",
    "faces": "SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dz,dy,dx)",
    "cube": "SELECT a.i dz, b.i dy, c.i dx FROM (SELECT unnest([-1,0,1]) i) a, (SELECT unnest([-1,0,1]) i) b, (SELECT unnest([-1,0,1]) i) c",
    "grid": "SELECT a.i z, b.i y, c.i x FROM range(16) a(i), range(32) b(i), range(32) c(i)",
    "cen": "SELECT z, avg(CASE WHEN v>=25 THEN y END) cy, avg(CASE WHEN v>=25 THEN x END) cx FROM ct GROUP BY z",
    "carried": "SELECT z, coalesce(last_value(cy IGNORE NULLS) OVER (ORDER BY z ROWS UNBOUNDED PRECEDING),16.0) cy, coalesce(last_value(cx IGNORE NULLS) OVER (ORDER BY z ROWS UNBOUNDED PRECEDING),16.0) cx FROM cen",
    "axis": "SELECT z, CASE WHEN lag(1) OVER o IS NULL OR lead(1) OVER o IS NULL THEN cy ELSE avg(cy) OVER (ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END cy, CASE WHEN lag(1) OVER o IS NULL OR lead(1) OVER o IS NULL THEN cx ELSE avg(cx) OVER (ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END cx FROM carried WINDOW o AS (ORDER BY z)",
    "wound": "SELECT z,y,x,v, round(sqrt((y-cy)*(y-cy)+(x-cx)*(x-cx))/8.0::DOUBLE + atan2(y-cy,x-cx)/(2*pi()),9) w FROM ct JOIN axis USING (z)",
    "rings0": "SELECT z//8 slab, least(CAST(trunc((atan2(y-15.5::DOUBLE,x-15.5::DOUBLE)+pi())*4/(2*pi())) AS BIGINT),3) sector, CAST(trunc(sqrt((y-15.5::DOUBLE)*(y-15.5::DOUBLE)+(x-15.5::DOUBLE)*(x-15.5::DOUBLE))+0.5) AS BIGINT) r, v FROM ct WHERE v>0",
    "profile": "SELECT slab,sector,r,count(*) n,avg(v) mean FROM rings0 GROUP BY 1,2,3",
    "ripples": "SELECT slab,sector,r,mean-m ripple FROM (SELECT *, avg(mean) OVER w m, count(*) OVER w k FROM profile WHERE n>=4 WINDOW w AS (PARTITION BY slab,sector ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE k>=3",
    "votes": "SELECT slab,r,quantile_cont(ripple,0.5) amplitude FROM ripples GROUP BY 1,2 HAVING count(*)>=3 AND least(count(*) FILTER (ripple>0), count(*) FILTER (ripple<0))<=1",
}
_NEEDS = {"fg": ("gt",), "cen": ("ct",), "carried": ("ct", "cen"), "axis": ("ct", "cen", "carried"), "wound": ("ct", "cen", "carried", "axis"), "rings0": ("ct",), "profile": ("ct", "rings0"), "ripples": ("ct", "rings0", "profile"), "votes": ("ct", "rings0", "profile", "ripples")}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` behind the named views, each before those that read it."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, ()), name) if n not in order]
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip()
    if body.startswith("WITH "):
        body = ", " + body[5:]
    return f"WITH {'RECURSIVE ' * recursive}{views} {body}"
