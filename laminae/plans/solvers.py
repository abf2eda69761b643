"""Registered queries of block solvers, relaxed fields and signed graphs; importing this module adds them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laminae.operators import bands, dense, fields, filters, review
from laminae.plans.catalog import FIXED, query, rounded
from laminae.session import shared_folder
from laminae.sources import archive, npy, tiff

KEY = ["z", "y", "x"]
#: Iterations until a volume settles: their grown forms would only repeat them at length.
FIXED |= {"dirichlet_winding", "eulerian_winding"}


def _grid(t):
    """All voxels of the volume."""
    depth, height, width = t.shape
    i = F.col("id")
    return t.spark.range(depth * height * width).select(F.floor(i / (height * width)).alias("z"), (F.floor(i / width) % height).alias("y"), (i % width).alias("x"))


def _ramp(t):
    """A radial ramp, eight voxels a turn, with the volume's values as noise; every voxel is trusted."""
    r = F.sqrt((F.col("y") - 15.5) * (F.col("y") - 15.5) + (F.col("x") - 15.5) * (F.col("x") - 15.5))
    noisy = _grid(t).join(t.ct(), KEY, "left").select(*KEY, (r / 8.0 + (F.coalesce("v", F.lit(25)) - 25) / 500.0).alias("turns"))
    return noisy.select(*KEY, (F.col("turns") - F.floor("turns")).alias("w"), F.lit(1.0).alias("trust"))


_RAMP = "f AS (SELECT g.z,g.y,g.x,sqrt((g.y-15.5::DOUBLE)*(g.y-15.5)+(g.x-15.5::DOUBLE)*(g.x-15.5))/8.0::DOUBLE+(coalesce(v,25)-25)/500.0::DOUBLE turns FROM grid g LEFT JOIN ct USING (z,y,x))"


@query(f"WITH {_RAMP} SELECT z,y,x,round(turns-(SELECT min(turns) FROM f),6) u FROM f", "ct", "grid")
def phase_unwrap(t):
    whole = fields.wrap_numbers(_ramp(t), 16, 3, t.shape)
    least = whole.agg(F.min("u").alias("least"))
    return rounded(whole.crossJoin(F.broadcast(least)).select(*KEY, (F.col("u") - F.col("least")).alias("u")), "u")


@query(f"WITH {_RAMP}, b AS (SELECT DISTINCT z//16 cz,y//16 cy,x//16 cx FROM f), s AS (SELECT f.z,f.y,f.x,(cz*2+cy)*2+cx k FROM f,b WHERE z>=cz*16-3 AND z<cz*16+19 AND y>=cy*16-3 AND y<cy*16+19 AND x>=cx*16-3 AND x<cx*16+19) SELECT p.k a,q.k b,0.0::DOUBLE residual FROM s p JOIN s q USING (z,y,x) WHERE p.k<q.k GROUP BY 1,2 HAVING count(*)>=50", "ct", "grid")
def stitch_loops(t):
    block = (F.col("cz") * 2 + F.col("cy")) * 2 + F.col("cx")
    solved = fields.unwrap_blocks(_ramp(t), 16, 3).withColumn("block", block)
    return rounded(fields.stitch_blocks(fields.settled(solved), least=50)[1], "residual", places=9)


def _anchored(t):
    held = F.col("v") >= 45
    return t.ct().select(*KEY, F.when(held, F.col("v") / 10.0).otherwise(2.5).alias("v"), held.cast("double").alias("fixed"), *(F.lit(0.0).alias(f"g{a}") for a in KEY))


_HALF = "n{k} AS (SELECT a.z,a.y,a.x,avg(b.u) m FROM s{k} a,faces JOIN s{k} b ON b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY 1,2,3), s{j} AS (SELECT z,y,x,odd,held,CASE WHEN odd={odd} AND NOT held THEN coalesce(m,u) ELSE u END u FROM s{k} LEFT JOIN n{k} USING (z,y,x))"
_SWEEPS = ", ".join(["s0 AS (SELECT z,y,x,(z+y+x)%2 odd,v>=45 held,CASE WHEN v>=45 THEN v/10.0::DOUBLE ELSE 2.5 END u FROM ct)", *(_HALF.format(k=k, j=k + 1, odd=k % 2) for k in range(4))])


@query(f"WITH {_SWEEPS} SELECT z,y,x,round(u,9) v FROM s4", "ct", "faces")
def field_sweeps(t):
    return rounded(fields.relaxed(_anchored(t), 2, 8).select(*KEY, "v"), "v", places=9)


@query()
def dirichlet_winding(t):
    anchors = t.ct().filter("v >= 45").select(*KEY, (F.col("v") / 10.0).alias("w"))
    return fields.dirichlet_field(anchors, t.ct(), 1e-7)


@query()
def eulerian_winding(t):
    lean = (F.col("v") - 25) / 100.0
    return fields.eulerian_field(t.ct().select(*KEY, lean.alias("nz"), F.lit(0.6).alias("ny"), F.lit(0.8).alias("nx")), 8.0, 1e-7)


_TRIPLES = "o AS (SELECT o_orderkey a FROM orders), e AS (SELECT i,a,b,CAST((a*37+b*11)%201-100 AS INT) w FROM (SELECT x.a//3 i,x.a,y.a b FROM o x JOIN o y ON x.a//3=y.a//3 AND x.a<y.a) WHERE (a*37+b*11)%201<>100), k AS (SELECT *,row_number() OVER (PARTITION BY i ORDER BY abs(w) DESC,a,b) r,count(*) OVER (PARTITION BY i) n FROM e), f AS (SELECT i,max(n) n,max(w) FILTER (r=1)>0 p1,max(w) FILTER (r=2)>0 p2,max(w) FILTER (r=3)>0 p3,list_sort([max(a) FILTER (r=1),max(b) FILTER (r=1)]) e1,list_sort([max(a) FILTER (r=2),max(b) FILTER (r=2)]) e2,list_sort([max(a) FILTER (r=3),max(b) FILTER (r=3)]) e3 FROM k GROUP BY i)"


@query(f"WITH {_TRIPLES}, j AS (SELECT i,unnest(CASE WHEN p1 THEN CASE WHEN p2 THEN [e1,e2] WHEN n=3 THEN [e1] ELSE [e1] END WHEN p2 THEN [e2] WHEN n=3 AND p3 THEN [e3] ELSE [] END) e FROM f), g AS (SELECT i,min(e[1]) least,list_distinct(flatten(list(e))) m FROM j GROUP BY i) SELECT a id,CASE WHEN list_contains(m,a) THEN least ELSE a END \"label\" FROM o LEFT JOIN g ON i=a//3")
def mutex_triples(t):
    keys = t.orders.select(F.col("o_orderkey").alias("a"))
    pairs = keys.join(keys.withColumnRenamed("a", "b"), F.floor(F.col("a") / 3) == F.floor(F.col("b") / 3)).filter("a < b")
    edges = pairs.withColumn("w", (F.col("a") * 37 + F.col("b") * 11) % 201 - 100)
    return fields.mutex_clusters(edges, keys.select(F.col("a").alias("id")))


# filters over chunks with halos


_LEVEL = "SELECT z,y,x,v/64.0::DOUBLE b,CAST(v>0 AND v<64 AS DOUBLE) s,CASE WHEN v>0 AND v<64 THEN v/64.0::DOUBLE ELSE 0 END p FROM (SELECT g.z,g.y,g.x,coalesce(v,0) v FROM grid g LEFT JOIN ct USING (z,y,x))"
_TAPS = "k5 AS (SELECT * FROM (VALUES (-2,1),(-1,4),(0,6),(1,4),(2,1)) t(d,c))"
_LINE = "{j} AS (SELECT {keep},sum(c*p)/16 p,sum(c*s)/16 s FROM (SELECT i.z,i.y,i.x,c,q.p,q.s FROM {i} i,k5 JOIN {i} q ON {on}) GROUP BY z,y,x)"


def _blurred_sql(source: str) -> str:
    ons = []
    for axis, last in (("z", "15"), ("y", "31"), ("x", "31")):
        same = " AND ".join(f"q.{a}=i.{a}" for a in KEY if a != axis)
        ons.append(f"q.{axis}=least(greatest(i.{axis}+d,0),{last}) AND {same}")
    names = [source, "bz", "by_", "bx"]
    return ", ".join(_LINE.format(i=i, j=j, keep="z,y,x", on=on) for i, j, on in zip(names, names[1:], ons, strict=False))


@query(f"WITH {_TAPS}, l0 AS ({_LEVEL}), {_blurred_sql('l0')}, m AS (SELECT l0.z,l0.y,l0.x,l0.b,l0.s>0 sure,CASE WHEN bx.s>1e-6 THEN bx.p/bx.s ELSE l0.b END mean FROM l0 JOIN bx USING (z,y,x)) SELECT z,y,x,round(CASE WHEN sure THEN least(greatest(mean+0.5*sign(b-mean)*pow(abs(b-mean)/0.5,0.7::DOUBLE),0),1) ELSE b END*64,5) v FROM m SEMI JOIN ct USING (z,y,x)", "ct", "grid")
def gain_level(t):
    return rounded(dense.gain_pyramid(t.ct(), 1, 8, t.shape, top=64.0), "v", places=5)


@query()
def gain_octaves(t):
    return dense.gain_pyramid(t.ct(), 3, 16, t.shape, core=0.01, top=64.0)


@query()
def wiener_deconvolution(t):
    return dense.wiener(t.ct(), 1.0, 16, 8, t.shape)


# files


@query("SELECT g.z,g.y,g.x,CAST(coalesce(v,0) AS DOUBLE) v FROM grid g LEFT JOIN ct USING (z,y,x)", "ct", "grid")
def npy_slabs(t):
    path = f"{shared_folder(t.spark)}/npy-{uuid.uuid4().hex}"
    npy.write(t.ct(), path, t.shape, "|u1", depth=8)
    return npy.read(t.spark, path)


@query("SELECT CAST(z AS VARCHAR) mesh,x u,y v,z/2.0::DOUBLE z,CAST(y AS DOUBLE) y,CAST(v AS DOUBLE) x FROM ct", "ct")
def surface_files(t):
    path = f"{shared_folder(t.spark)}/surfaces-{uuid.uuid4().hex}"
    cells = t.ct().select(F.col("z").alias("mesh"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("z") / 2.0).alias("z"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("x"))
    tiff.write_surfaces(cells, path)
    return tiff.read_surfaces(t.spark, path).filter("valid").drop("valid")


# bands


_NEAR = "p AS (SELECT z,y,x FROM gt WHERE v>=40 AND y<12)"


@query(f"WITH {_NEAR}, k AS (SELECT a.i*8 z,b.i*8 y,c.i*8 x FROM range(500) a(i),range(5) b(i),range(5) c(i)) SELECT DISTINCT greatest(k.z-1,0) z,greatest(k.y-1,0) y,greatest(k.x-1,0) x,k.z+9-greatest(k.z-1,0) dz,k.y+9-greatest(k.y-1,0) dy,k.x+9-greatest(k.x-1,0) dx FROM k JOIN p ON p.z>=k.z-3 AND p.z<k.z+11 AND p.y>=k.y-3 AND p.y<k.y+11 AND p.x>=k.x-3 AND p.x<k.x+11", "gt")
def band_blocks(t):
    return bands.band_blocks(t.gt().filter("v >= 40 and y < 12"), 8, 1, 2)


@query(f"WITH {_NEAR}, c AS (SELECT DISTINCT (p.z+a.i)//8 cz,(p.y+b.i)//8 cy,(p.x+c.i)//8 cx FROM p,range(-2,4) a(i),range(-2,4) b(i),range(-2,4) c(i) WHERE p.z+a.i>=0 AND p.y+b.i>=0 AND p.x+c.i>=0 AND a.i<=2 AND b.i<=2 AND c.i<=2) SELECT z,y,x,CAST(v AS DOUBLE) v FROM ct JOIN c ON cz=z//8 AND cy=y//8 AND cx=x//8", "ct", "gt")
def band_ingest(t):
    path = f"{shared_folder(t.spark)}/archive-{uuid.uuid4().hex}"
    archive.write(t.ct(), path, 8)
    return archive.read_band(t.spark, path, t.gt().filter("v >= 40 and y < 12"), 2)


# rays and verdicts


@query("SELECT y,x,round(sum(v*exp(-4*coalesce(d,0))),6) AS value FROM (SELECT y,x,v,sum(v*(1/500.0::DOUBLE)) OVER (PARTITION BY y,x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) d FROM ct) GROUP BY 1,2", "ct")
def composite_beer(t):
    return rounded(filters.composite_beer(t.ct(), 4.0, 1 / 500.0), "value")


_MEASURED = "c AS (SELECT o_orderkey k,CASE WHEN k%11<>0 THEN k*7%60+41.0 END pap,CASE WHEN k%5<>0 THEN pap-k%4 END lo,CASE WHEN k%5<>0 THEN pap+k%3 END hi,CASE WHEN k%4<>0 THEN k//3%15 END iqr,CASE WHEN k%3=0 THEN k//7%15 END aiqr,CASE WHEN k%6<3 THEN k//2%100 END coh,CASE WHEN k%9<>0 THEN k//5%11-5 END off_,k%10/10.0 good,k//2%90 ridge,CASE WHEN k%7=0 THEN 32 ELSE 16 END crops FROM orders)"
_TIER = "CASE WHEN {p}>=90 AND (coalesce(iqr<=7,false) OR coalesce(aiqr<=8,false) OR coalesce(coh>=70,false)) AND coalesce(abs(off_)<=3,true) THEN 'A' WHEN {p}>=84 AND (coalesce(iqr<=8,false) OR coalesce(aiqr<=9,false) OR coalesce(coh>=60,false)) AND coalesce(abs(off_)<=4,true) THEN 'B' WHEN {p}>=70 AND (coalesce(iqr<=12,false) OR coalesce(aiqr<=13,false) OR coalesce(coh>=45,false)) THEN 'C' WHEN good>=0.4 OR {p}>=50 THEN 'D' ELSE 'E' END"


@query(f"WITH {_MEASURED}, t AS (SELECT *,{_TIER.format(p='pap')} m,{_TIER.format(p='lo')} l,{_TIER.format(p='hi')} h FROM c) SELECT k,CASE WHEN pap IS NULL THEN CASE WHEN ridge>=72 AND coalesce(iqr<=5,false) THEN 'A' WHEN ridge>=62 AND coalesce(iqr<=6,false) THEN 'B' WHEN ridge>=50 AND coalesce(iqr<=10,false) THEN 'C' WHEN good>=0.4 THEN 'D' ELSE 'E' END WHEN lo IS NOT NULL AND (m<>l OR m<>h) AND crops<32 THEN m||'?' ELSE m END tier FROM t")
def align_verdict(t):
    k = F.col("o_orderkey")
    pap = F.when(k % 11 != 0, k * 7 % 60 + 41.0)
    measured = {
        "pap": pap,
        "pap_low": F.when(k % 5 != 0, pap - k % 4),
        "pap_high": F.when(k % 5 != 0, pap + k % 3),
        "iqr": F.when(k % 4 != 0, F.floor(k / 3) % 15),
        "alpha_iqr": F.when(k % 3 == 0, F.floor(k / 7) % 15),
        "coh": F.when(k % 6 < 3, F.floor(k / 2) % 100),
        "off": F.when(k % 9 != 0, F.floor(k / 5) % 11 - 5),
        "good": k % 10 / 10.0,
        "ridge": F.floor(k / 2) % 90,
        "crops": F.when(k % 7 == 0, 32).otherwise(16),
    }
    return review.alignment(t.orders.select(k.alias("k"), *(c.alias(n) for n, c in measured.items()))).select("k", "tier")
