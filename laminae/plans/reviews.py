"""Registered queries of filters, frames and reviews; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from laminae.operators import filters, frames, graph, mesh, metrics, patches, review, series, spatial, voxel
from laminae.plans.catalog import _CELLS, _cells, _wound, query, rounded

KEY = ["z", "y", "x"]
_CLAMPED = "least(greatest(z+dz,0),15) z,least(greatest(y+dy,0),31) y,least(greatest(x+dx,0),31) x"


# filters


@query(f"WITH b AS (SELECT {_CLAMPED},avg(v) m,avg(v*v) mm FROM ct,cube GROUP BY 1,2,3), k AS (SELECT ct.z,ct.y,ct.x,v,m,(mm-m*m)/(mm-m*m+100.0::DOUBLE) a FROM ct JOIN b USING (z,y,x)), c AS (SELECT {_CLAMPED},avg(a) ma,avg(m*(1-a)) mb FROM k,cube GROUP BY 1,2,3) SELECT ct.z,ct.y,ct.x,round(ma*v+mb,6) v FROM ct JOIN c USING (z,y,x)", "ct", "cube")
def guided_filter(t):
    return rounded(filters.guided(t.ct(), 100.0, t.shape), "v")


@query(f"WITH b AS (SELECT {_CLAMPED},avg(v) m FROM ct,cube GROUP BY 1,2,3) SELECT ct.z,ct.y,ct.x,round(v+1.5::DOUBLE*(v-m),6) v FROM ct JOIN b USING (z,y,x)", "ct", "cube")
def unsharp_mask(t):
    blurred = filters.reflected_means(t.ct(), t.shape, v=F.col("v"))
    return rounded(filters.unsharp(t.ct(), blurred, 1.5), "v")


@query("SELECT z,y,x,round(CASE WHEN abs(d)<0.1::DOUBLE THEN d*abs(d)/(0.1::DOUBLE+1e-8) ELSE 0.8::DOUBLE*sign(d)*pow(abs(d)/0.8::DOUBLE,0.7::DOUBLE) END,6) v FROM (SELECT z,y,x,(v-25)/25.0::DOUBLE d FROM ct)", "ct")
def musica_gain(t):
    return rounded(t.ct().select(*KEY, filters.detail_gain((F.col("v") - 25) / 25.0, 0.8, 0.7, 0.1).alias("v")), "v")


def _half(name: str, source: str, colour: int) -> str:
    return f"{name} AS (SELECT c.z,c.y,c.x,any_value(c.v0) v0,CASE WHEN (c.z+c.y+c.x)%2={colour} THEN (sum(coalesce(n.v,c.v))+2.0::DOUBLE*any_value(c.v0))/8 ELSE any_value(c.v) END v FROM {source} c CROSS JOIN faces f LEFT JOIN {source} n ON n.z=c.z+f.dz AND n.y=c.y+f.dy AND n.x=c.x+f.dx GROUP BY c.z,c.y,c.x)"


@query(f"WITH s AS (SELECT z,y,x,CAST(v AS DOUBLE) v,CAST(v AS DOUBLE) v0 FROM ct), {_half('a', 's', 0)}, {_half('b', 'a', 1)} SELECT z,y,x,round(v,6) v FROM b", "ct", "faces")
def relax_sweep(t):
    return rounded(filters.relax(t.ct(), 2.0, 1), "v")


@query("WITH s AS (SELECT z,y,x,v,d FROM ct,(SELECT unnest([-1.0::DOUBLE,1.0::DOUBLE]) d) WHERE v>=30), p AS (SELECT z,y,x,v,d,least(greatest(y+d*0.6::DOUBLE,0),31) py,least(greatest(x+d*0.8::DOUBLE,0),31) px FROM s), k AS (SELECT b.i j,c.i k FROM range(2) b(i),range(2) c(i)), q AS (SELECT p.z,p.y,p.x,any_value(p.v) v,d,sum((CASE j WHEN 1 THEN py-floor(py) ELSE 1-(py-floor(py)) END)*(CASE k WHEN 1 THEN px-floor(px) ELSE 1-(px-floor(px)) END)*coalesce(ct.v,0)) s FROM p CROSS JOIN k LEFT JOIN ct ON ct.z=p.z AND ct.y=least(CAST(floor(py) AS BIGINT)+j,31) AND ct.x=least(CAST(floor(px) AS BIGINT)+k,31) GROUP BY p.z,p.y,p.x,d), w AS (SELECT z,y,x,any_value(v) v,round(max(s) FILTER (d>0),9) f,round(max(s) FILTER (d<0),9) b FROM q GROUP BY 1,2,3) SELECT z,y,x FROM w WHERE v>=f AND v>=b AND (b-2*v+f>=-1e-3 OR round(abs(0.5::DOUBLE*(b-f)/(b-2*v+f)),9)<=0.5)", "ct")
def ridge_nms(t):
    field = t.ct().select(*KEY, F.col("v"), F.lit(0.0).alias("nz"), F.lit(0.6).alias("ny"), F.lit(0.8).alias("nx"))
    return filters.ridges(field, t.ct(), t.shape, 30)


@query("SELECT z,y,x,round((v-avg(v) OVER p)/greatest(stddev_pop(v) OVER p,1e-6),6) v FROM ct WINDOW p AS (PARTITION BY z//8,y//8,x//8)", "ct")
def patch_zscore(t):
    return rounded(filters.patch_scores(t.ct(), 8), "v")


_BOUNDS = """e AS (SELECT z//8 pz,y//8 py,x//8 px,CAST(min(v) AS DOUBLE) lo,CAST(max(v) AS DOUBLE) hi,count(*) n FROM ct GROUP BY 1,2,3),
h AS (SELECT pz,py,px,CAST(trunc((v-lo)*(63/(hi-lo))) AS BIGINT) bin,count(*) k,any_value(n) n FROM ct JOIN e ON pz=z//8 AND py=y//8 AND px=x//8 WHERE hi>lo GROUP BY 1,2,3,4),
r AS (SELECT *,sum(k) OVER (PARTITION BY pz,py,px ORDER BY bin) c FROM h),
c AS (SELECT pz,py,px,greatest(min(bin) FILTER (c>CAST(trunc(0.05::DOUBLE*n) AS BIGINT))-1,0) blo,min(bin) FILTER (c>=CAST(trunc(0.95::DOUBLE*n) AS BIGINT))-1 bhi FROM r GROUP BY 1,2,3),
b AS (SELECT pz,py,px,coalesce(lo+blo/(63/(hi-lo)),lo) l,lo+(bhi+1)/(63/(hi-lo)) u FROM e LEFT JOIN c USING (pz,py,px))"""


@query(f"WITH {_BOUNDS} SELECT z,y,x,round(least(greatest((v-l)/(CASE WHEN u>l THEN u-l ELSE 1 END),0),1),6) v FROM ct JOIN b ON pz=z//8 AND py=y//8 AND px=x//8", "ct")
def patch_percentile(t):
    return rounded(filters.patch_normalize(t.ct(), 8, 5.0, 95.0, 64), "v")


@query("WITH p AS (SELECT DISTINCT z,2*y+1+dy y,2*x+1+dx x FROM fg,cube WHERE dz=0) SELECT z,CAST(sum(CASE WHEN y%2+x%2=1 THEN -1 ELSE 1 END) AS BIGINT) chi FROM p GROUP BY 1", "fg", "cube")
def plane_euler(t):
    return filters.planes_chi(t.fg())


@query("WITH r AS (SELECT y,x,z,v,v/60.0::DOUBLE a FROM ct), k AS (SELECT *,coalesce(product(1-a) OVER (PARTITION BY y,x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1.0) l FROM r) SELECT y,x,round(sum(l*a*v) FILTER (l>=0.01),6) value,round(min(l*(1-a)) FILTER (l>=0.01),6) left FROM k GROUP BY 1,2".replace(" left FROM", ' "left" FROM'), "ct")
def composite_alpha(t):
    return rounded(filters.composite_alpha(t.ct(), F.col("v") / 60.0), "value", "left")


@query("WITH p AS (SELECT z//8 pz,y//8 py,x//8 px,count(*) n,min(v) least,max(v) most,round(avg(v),6) mean FROM ct GROUP BY 1,2,3) SELECT count(*) chunks,CAST(sum(n) AS BIGINT) voxels,min(least) least,max(most) most,min(pz) z0,max(pz) z1,min(py) y0,max(py) y1,min(px) x0,max(px) x1 FROM p", "ct")
def volume_summary(t):
    return voxel.summary(t.ct(), 8)


@query("WITH b AS (SELECT z//4 bz,y//4 byy,x//4 bx,avg(v)/10.0::DOUBLE u FROM ct GROUP BY 1,2,3), o AS (SELECT * FROM (VALUES (0,1,0,0),(1,0,1,0),(2,0,0,1)) t(axis,dz,dy,dx)) SELECT axis,a.bz,a.byy,a.bx,round(b.u-a.u,6) d,round(1-2*abs((b.u-a.u)-round_even(b.u-a.u,0)),6) q FROM b a,o JOIN b ON b.bz=a.bz+dz AND b.byy=a.byy+dy AND b.bx=a.bx+dx", "ct")
def block_faces(t):
    means = t.ct().groupBy(*(F.floor(F.col(a) / 4).alias(a) for a in KEY)).agg((F.avg("v") / 10.0).alias("v"))
    out = graph.block_faces(means).select("axis", F.col("z").alias("bz"), F.col("y").alias("byy"), F.col("x").alias("bx"), "d", "q")
    return rounded(out, "d", "q")


@query("WITH s AS (SELECT z,u,count(*) n,sum(v) total FROM (SELECT z,v,CAST(round((w-(SELECT min(w) FROM wound))*4) AS BIGINT) u FROM wound) GROUP BY 1,2), g AS (SELECT z,u FROM (SELECT unnest(range((SELECT min(z) FROM s),(SELECT max(z) FROM s)+1)) z),(SELECT unnest(range((SELECT min(u) FROM s),(SELECT max(u) FROM s)+1)) u)) SELECT g.z,g.u,round(coalesce(total/n,0.0),6) AS value FROM g LEFT JOIN s USING (z,u)", "wound")
def unroll_image(t):
    return rounded(frames.mean_image(_wound(t), 4), "value")


# frames: the slices of the volume, u along x and v along y

_FRAME = "f AS (SELECT z mesh,x u,y v,v d FROM ct)"


def _frame(t):
    return t.ct().select(F.col("z").alias("mesh"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("v").alias("d"))


_SQUARE5 = "q AS (SELECT a.i du,b.i dv FROM (SELECT unnest([-2,-1,0,1,2]) i) a,(SELECT unnest([-2,-1,0,1,2]) i) b)"
_KEPT = f"{_FRAME}, {_SQUARE5}, m AS (SELECT f.mesh,f.u+du u,f.v+dv v,count(*) n,list_sort(list(d))[count(*)//2+1] m FROM f,q GROUP BY 1,2,3), k AS (SELECT f.* FROM f JOIN m USING (mesh,u,v) WHERE n<5 OR abs(d-m)<=15)"


@query(f"WITH {_KEPT} SELECT mesh,u,v,d FROM k", "ct")
def median_reject(t):
    return frames.reject_outliers(_frame(t), "d", 15)


@query(f"WITH {_KEPT}, s AS (SELECT k.mesh,k.u+du u,k.v+dv v,avg(d) d FROM k,q WHERE abs(du)<=1 AND abs(dv)<=1 GROUP BY 1,2,3) SELECT mesh,u,v,round(s.d,6) d FROM s SEMI JOIN f USING (mesh,u,v)", "ct")
def median_smooth(t):
    return rounded(frames.smooth_kept(_frame(t), "d", 15), "d")


@query(f"WITH f AS (SELECT z mesh,x u,y v,v d FROM gt WHERE v>=12), {_SQUARE5}, a AS (SELECT mesh,u+du u,v+dv v,count(*) n,avg(d) d FROM f,q WHERE abs(du)<=1 AND abs(dv)<=1 GROUP BY 1,2,3) SELECT mesh,u,v,CAST(d AS DOUBLE) d FROM f UNION ALL SELECT mesh,u,v,round(d,6) FROM a ANTI JOIN f USING (mesh,u,v) WHERE n>=5", "gt")
def grid_fill(t):
    cells = t.gt().filter("v >= 12").select(F.col("z").alias("mesh"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("v").alias("d"))
    return rounded(frames.fill_gaps(cells, ["d"], 5), "d")


@query("WITH f AS (SELECT z mesh,x u,y v,v/50.0::DOUBLE*2*pi()/(2*pi()) t FROM ct), d AS (SELECT *,t-lag(t) OVER o s,first_value(t) OVER o f0 FROM f WINDOW o AS (PARTITION BY mesh,v ORDER BY u)) SELECT mesh,u,v,round(f0+sum(coalesce(s+0.5-floor(s+0.5)-0.5,0)) OVER (PARTITION BY mesh,v ORDER BY u),6) turn FROM d", "ct")
def turn_unwrap(t):
    cells = _frame(t).withColumn("a", F.col("d") / 50.0 * 2 * 3.141592653589793)
    return rounded(frames.turns(cells, F.col("a")).select("mesh", "u", "v", "turn"), "turn")


@query(f"WITH {_CELLS}, n AS (SELECT r.mesh,r.u-1 u,r.v v,r.z-l.z az,r.y-l.y ay,r.x-l.x ax,d.z-p.z bz,d.y-p.y b_y,d.x-p.x bx FROM cells r JOIN cells l ON l.mesh=r.mesh AND l.u=r.u-2 AND l.v=r.v JOIN cells c ON c.mesh=r.mesh AND c.u=r.u-1 AND c.v=r.v JOIN cells d ON d.mesh=r.mesh AND d.u=r.u-1 AND d.v=r.v+1 JOIN cells p ON p.mesh=r.mesh AND p.u=r.u-1 AND p.v=r.v-1), x AS (SELECT mesh,u,v,ay*bx-ax*b_y cz,ax*bz-az*bx cy,az*b_y-ay*bz cx FROM n) SELECT mesh,u,v,round(cz/sqrt(cz*cz+cy*cy+cx*cx),6) nz,round(cy/sqrt(cz*cz+cy*cy+cx*cx),6) ny,round(cx/sqrt(cz*cz+cy*cy+cx*cx),6) nx FROM x", "points")
def grid_normals(t):
    return rounded(mesh.grid_normals(_cells(t)), "nz", "ny", "nx")


_LAYERS = "c AS (SELECT z mesh,x u,y v,v/4.0::DOUBLE zz FROM gt WHERE v>=20), s AS (SELECT mesh,u,v,t,least(greatest(zz+t,0),15) pz,k FROM c,(SELECT unnest([-1.5::DOUBLE,0.0::DOUBLE,1.5::DOUBLE]) t),(SELECT unnest([0,1]) k)), w AS (SELECT *,CASE k WHEN 1 THEN pz-floor(pz) ELSE 1-(pz-floor(pz)) END w FROM s)"


@query(f"WITH {_LAYERS} SELECT mesh,u,w.v v,t,round(sum(w*coalesce(ct.v,0)),6) AS value FROM w LEFT JOIN ct ON ct.z=least(CAST(floor(pz) AS BIGINT)+k,15) AND ct.y=w.v AND ct.x=w.u GROUP BY 1,2,3,4", "ct", "gt")
def render_layers(t):
    at = t.gt().filter("v >= 20").select(F.col("z").alias("mesh"), F.col("x").alias("u"), F.col("y").alias("v"), (F.col("v") / 4.0).alias("z"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.lit(1.0).alias("nz"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nx"))
    return rounded(frames.layers(at, t.ct(), [-1.5, 0.0, 1.5], t.shape), "value")


@query("WITH p AS (SELECT y,x,list(v ORDER BY z) l FROM ct GROUP BY 1,2), i AS (SELECT y,x,l,unnest(range(1,len(l)-1)) i FROM p), c AS (SELECT *,l[i+1] v FROM i WHERE abs(i-8)<=5 AND l[i+1]>=l[i] AND l[i+1]>=l[i+2]), s AS (SELECT y,x,i,v,list_min(l[coalesce(list_max([j FOR j IN range(1,i+1) IF l[j]>v]),0)+1:i+1]) a,list_min(l[i+1:coalesce(list_min([j FOR j IN range(i+2,len(l)+1) IF l[j]>v]),len(l)+1)-1]) b FROM c), k AS (SELECT y,x,i FROM s WHERE v-greatest(a,b)>=10) SELECT y,x,CAST(t AS INT) t FROM (SELECT DISTINCT y,x FROM p) LEFT JOIN (SELECT y,x,i-8 t FROM k QUALIFY row_number() OVER (PARTITION BY y,x ORDER BY abs(i-8),i)=1) USING (y,x)", "ct")
def prominent_peak(t):
    profiles = t.ct().groupBy("y", "x").agg(F.transform(F.sort_array(F.collect_list(F.struct("z", "v"))), lambda s: s["v"]).alias("values"))
    return frames.prominent_peaks(profiles, ["y", "x"], 8, 5, 10)


_TRIANGLES = "t AS (SELECT o_orderkey id,(o_orderkey*7%40)/1.5::DOUBLE u0,(o_orderkey*11%40)/1.5::DOUBLE v0,(o_orderkey*13%40)/1.7::DOUBLE u1,(o_orderkey*17%40)/1.7::DOUBLE v1,(o_orderkey*19%40)/1.9::DOUBLE u2,(o_orderkey*23%40)/1.9::DOUBLE v2 FROM orders), a AS (SELECT *,(u1-u0)*(v2-v0)-(u2-u0)*(v1-v0) ar FROM t), b AS (SELECT *,unnest(range(CAST(ceil(least(u0,u1,u2)) AS BIGINT),CAST(floor(greatest(u0,u1,u2)) AS BIGINT)+1)) px FROM a WHERE abs(ar)>1e-12), c AS (SELECT *,unnest(range(CAST(ceil(least(v0,v1,v2)) AS BIGINT),CAST(floor(greatest(v0,v1,v2)) AS BIGINT)+1)) py FROM b), w AS (SELECT *,((px-u0)*(v2-v0)-(u2-u0)*(py-v0))/ar w1,((u1-u0)*(py-v0)-(px-u0)*(v1-v0))/ar w2 FROM c)"


@query(f"WITH {_TRIANGLES} SELECT id,px,py,round((1-w1-w2)*u0+w1*v1+w2*u2,6) AS value FROM w WHERE w1>=0 AND w2>=0 AND w1+w2<=1")
def uv_raster(t):
    k = F.col("o_orderkey")
    corner = {"u0": k * 7 % 40 / 1.5, "v0": k * 11 % 40 / 1.5, "u1": k * 13 % 40 / 1.7, "v1": k * 17 % 40 / 1.7, "u2": k * 19 % 40 / 1.9, "v2": k * 23 % 40 / 1.9}
    triangles = t.orders.select(k.alias("id"), *(c.alias(n) for n, c in corner.items()), corner["u0"].alias("f0"), corner["v1"].alias("f1"), corner["u2"].alias("f2"))
    return rounded(frames.raster(triangles), "value")


@query("WITH p AS (SELECT z+0.0::DOUBLE z,y+0.25::DOUBLE y,x+0.25::DOUBLE x,v/50.0::DOUBLE p FROM gt WHERE v>=30), s AS (SELECT CAST(round_even(z+d*0.5::DOUBLE,0) AS BIGINT) z,CAST(round_even(y+d*0.5::DOUBLE,0) AS BIGINT) y,CAST(round_even(x-d*0.7::DOUBLE,0) AS BIGINT) x,p FROM p,(SELECT unnest([-2.0::DOUBLE,-1.0::DOUBLE,0.0::DOUBLE,1.0::DOUBLE]) d)) SELECT z,y,x,max(p) p FROM s WHERE z BETWEEN 0 AND 15 AND y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31 GROUP BY 1,2,3", "gt")
def ink_splat(t):
    at = t.gt().filter("v >= 30").select((F.col("z") + 0.0).alias("z"), (F.col("y") + 0.25).alias("y"), (F.col("x") + 0.25).alias("x"), F.lit(0.5).alias("nz"), F.lit(0.5).alias("ny"), F.lit(-0.7).alias("nx"), (F.col("v") / 50.0).alias("p"))
    return frames.splat(at, [-2.0, -1.0, 0.0, 1.0], t.shape)


@query("WITH p AS (SELECT o_orderkey id,(o_orderkey%8)*2.1::DOUBLE z,(o_orderkey*7%16)*2.1::DOUBLE y,(o_orderkey*13%16)*2.1::DOUBLE x FROM orders), q AS (SELECT id,least(z,15) z,least(y,31) y,least(x,31) x FROM p), k AS (SELECT a.i i,b.i j,c.i k FROM range(2) a(i),range(2) b(i),range(2) c(i)), s AS (SELECT id,least(CAST(floor(z) AS BIGINT)+i,15) cz,least(CAST(floor(y) AS BIGINT)+j,31) cy,least(CAST(floor(x) AS BIGINT)+k,31) cx,(CASE i WHEN 1 THEN z-floor(z) ELSE 1-(z-floor(z)) END)*(CASE j WHEN 1 THEN y-floor(y) ELSE 1-(y-floor(y)) END)*(CASE k WHEN 1 THEN x-floor(x) ELSE 1-(x-floor(x)) END) w FROM q,k) SELECT id,round(sum(w*coalesce(v,0)),6) AS value FROM s LEFT JOIN ct ON ct.z=cz AND ct.y=cy AND ct.x=cx GROUP BY 1", "ct")
def resample_cube(t):
    k = F.col("o_orderkey")
    points = t.orders.select(k.alias("id"), (k % 8 * 2.1).alias("z"), (k * 7 % 16 * 2.1).alias("y"), (k * 13 % 16 * 2.1).alias("x"))
    return rounded(spatial.trilinear(points, t.ct(), t.shape), "value")


@query("SELECT id,round(0.5::DOUBLE*x-0.25::DOUBLE*y+3,6) x,round(0.25::DOUBLE*x+0.5::DOUBLE*y-1,6) y,round(2*z+0.1::DOUBLE*x,6) z FROM points", "points")
def affine_points(t):
    matrix = [[0.5, -0.25, 0, 3], [0.25, 0.5, 0, -1], [0.1, 0, 2, 0]]
    return rounded(review.affine(t.points().select("id", *KEY), matrix), *KEY)


@query("SELECT id,other,round(d2,6) d2 FROM (SELECT a.id,b.id other,(a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) d2 FROM points a JOIN points b ON a.mesh<40 AND b.mesh>=40) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2,other)=1", "points")
def nearest_any(t):
    return rounded(spatial.nearest_any(t.points().filter("mesh < 40"), t.points().filter("mesh >= 40"), 4.0), "d2")


@query("WITH n AS (SELECT a.id,min(sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) d FROM points a JOIN points b ON a.mesh<40 AND b.mesh>=40 GROUP BY 1), c AS (SELECT least(d,8.0::DOUBLE) d FROM n) SELECT count(*) n,round(avg(CAST(d<=2 AS DOUBLE)),6) at2,round(avg(CAST(d<=4 AS DOUBLE)),6) at4,round(avg(d),6) mean,round(list_sort(list(d))[count(*)//2+1],6) median FROM c", "points")
def trace_scores(t):
    return rounded(spatial.trace_scores(t.points().filter("mesh < 40"), t.points().filter("mesh >= 40"), 8.0), "at2", "at4", "mean", "median")


@query("WITH c AS (SELECT floor(z/10) bz,floor(y/10) b_y,mesh,count(*) n,avg(x) m FROM points GROUP BY 1,2,3) SELECT a.mesh a,b.mesh b,count(*) clusters,round(avg(b.m-a.m),6) offs FROM c a JOIN c b USING (bz,b_y) WHERE a.mesh<b.mesh GROUP BY 1,2", "points")
def cluster_offsets(t):
    cells = t.points().select(F.floor(F.col("z") / 10).alias("bz"), F.floor(F.col("y") / 10).alias("b_y"), "mesh", F.col("x").alias("value"))
    return rounded(spatial.cluster_offsets(cells, ["bz", "b_y"]), "offs")


# reviews


_MEASURES = "m AS (SELECT l_suppkey%400 mesh,avg(l_discount)*0.6::DOUBLE fold_detj,avg(l_tax) self_intersect,CASE WHEN l_suppkey%400%7=0 THEN NULL ELSE avg(l_discount)*1.1::DOUBLE END frac_long,count(*)/4.0::DOUBLE holes,stddev_pop(l_discount)*4 edge_cv FROM lineitem GROUP BY 1)"


def _measures(t):
    key = F.col("l_suppkey") % 400
    by = t.lineitem.groupBy(key.alias("mesh"))
    return by.agg((F.avg("l_discount") * 0.6).alias("fold_detj"), F.avg("l_tax").alias("self_intersect"), (F.avg("l_discount") * 1.1).alias("frac_long"), (F.count("*") / 4.0).alias("holes"), (F.stddev_pop("l_discount") * 4).alias("edge_cv")).withColumn("frac_long", F.when(F.col("mesh") % 7 != 0, F.col("frac_long")))


_HEALTH = f"{_MEASURES}, h AS (SELECT *,CASE WHEN fold_detj>0.05 OR self_intersect>0.10 OR frac_long>0.08 OR holes>100 OR edge_cv>0.5 THEN 'bad' WHEN fold_detj>0.02 OR self_intersect>0.05 OR frac_long>0.03 OR holes>20 OR edge_cv>0.2 THEN 'suspect' ELSE 'ok' END health FROM m)"


@query(f"WITH {_HEALTH} SELECT mesh,health FROM h".replace("l_suppkey%400%7", "(l_suppkey%400)%7"))
def health_verdict(t):
    return review.health(_measures(t)).select("mesh", "health")


_CARDS = "c AS (SELECT o_orderkey id,chr(CAST(65+o_orderkey%5 AS INT)) tier,CASE o_orderkey//5%3 WHEN 0 THEN 'ok' WHEN 1 THEN 'suspect' ELSE 'bad' END health,o_orderkey//15%2 disagree,o_orderkey//30%3 dup_bad,o_orderkey//90%3 dup_good,o_totalprice p FROM orders), g AS (SELECT *,CASE WHEN health='bad' OR tier='E' THEN 'E' WHEN health='suspect' AND tier IN ('A','B') THEN 'C' WHEN tier='A' AND disagree>0 THEN 'B' WHEN tier IN ('A','B') AND dup_bad>=1 AND dup_bad>dup_good THEN 'C' ELSE tier END grade FROM c)"


def _graded(t):
    k = F.col("o_orderkey")
    health = F.element_at(F.array(F.lit("ok"), F.lit("suspect"), F.lit("bad")), (F.floor(k / 5) % 3 + 1).cast("int"))
    cards = t.orders.select(k.alias("id"), F.char(65 + k % 5).alias("tier"), health.alias("health"), (F.floor(k / 15) % 2).alias("disagree"), (F.floor(k / 30) % 3).alias("dup_bad"), (F.floor(k / 90) % 3).alias("dup_good"), F.col("o_totalprice").alias("p"))
    return review.grade(cards)


@query(f"WITH {_CARDS} SELECT id,grade,CASE grade WHEN 'A' THEN 'use' WHEN 'B' THEN 'shift-repair' WHEN 'C' THEN 'warp-repair' WHEN 'D' THEN 'trust-mask' ELSE 'quarantine' END decision,CAST(ascii(grade)-65 AS INT) rnk FROM g")
def grade_decision(t):
    marked = F.concat("grade", F.when(F.col("id") % 2 == 0, "?").otherwise(""))
    return _graded(t).select("id", "grade", review.decision(marked).alias("decision"), review.rank(marked).alias("rnk"))


@query(f"WITH {_CARDS} SELECT id,CASE grade WHEN 'A' THEN 'gentle' WHEN 'B' THEN 'repair' WHEN 'C' THEN 'repair' WHEN 'D' THEN 'trust-mask' ELSE 'quarantine' END AS \"action\",CASE grade WHEN 'A' THEN 3 WHEN 'B' THEN 4 WHEN 'C' THEN 8 END max_shift,CAST(greatest(8,ceil(sqrt((id%900+1)*(id%700+1)/1200.0::DOUBLE))) AS INT) lattice FROM g")
def repair_triage(t):
    sized = _graded(t).withColumns({"nu": F.col("id") % 900 + 1, "nv": F.col("id") % 700 + 1})
    return review.repair_plan(sized).select("id", "action", "max_shift", "lattice")


@query("WITH b AS (SELECT l_suppkey id,avg(l_discount)*100 delta,max(l_tax)*10 ce,count(*) FILTER (l_returnflag='R') disagree FROM lineitem GROUP BY 1), s AS (SELECT id,round(greatest(5.0-delta,0.0)+3.0*ce+0.2*disagree,6) bad FROM b) SELECT id,bad,row_number() OVER (ORDER BY bad DESC,id) place FROM s QUALIFY place<=50")
def review_queue(t):
    cards = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg((F.avg("l_discount") * 100).alias("delta"), (F.max("l_tax") * 10).alias("ce"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("disagree"))
    scored = rounded(review.badness(cards).select("id", "bad"), "bad")
    return review.worst_first(scored, [F.desc("bad"), F.asc("id")], 50)


@query("SELECT user_id,event_type,event_id,value FROM events QUALIFY row_number() OVER (PARTITION BY user_id,event_type ORDER BY event_id DESC)=1")
def last_measurement(t):
    return review.last_measurements(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id,event_id,round(value-lag(value) OVER (PARTITION BY user_id ORDER BY ts,event_id),6) step FROM events")
def relative_steps(t):
    return rounded(series.steps(t.events, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "step"), "step")


@query("WITH p AS (SELECT l_suppkey a,l_partkey b,CASE l_returnflag WHEN 'A' THEN 'AGREE' WHEN 'R' THEN 'DISAGREE' ELSE 'OFFSET' END verdict FROM lineitem WHERE l_linenumber<4) SELECT name,verdict,count(*) n FROM (SELECT concat('s',a) AS name,verdict FROM p UNION ALL SELECT concat('p',b),verdict FROM p) GROUP BY 1,2")
def pair_counts(t):
    verdict = F.when(F.col("l_returnflag") == "A", "AGREE").when(F.col("l_returnflag") == "R", "DISAGREE").otherwise("OFFSET")
    line = F.format_string("pair s%d <-> p%d overlap %d%% %s", "l_suppkey", "l_partkey", F.col("l_quantity").cast("int"), verdict)
    return review.pair_counts(t.lineitem.select(F.when(F.col("l_linenumber") < 4, line).otherwise("no pair at all").alias("line")))


@query("WITH g AS (SELECT l_partkey patch,min(abs(l_discount-l_tax+0.001::DOUBLE)) g FROM lineitem GROUP BY 1) SELECT count(*) n,round(list_sort(list(g))[count(*)//2+1],6) spacing FROM g")
def patch_spacing(t):
    return rounded(review.spacing(t.lineitem.select(F.col("l_partkey").alias("patch"), (F.col("l_discount") - F.col("l_tax") + 0.001).alias("gap"))), "spacing")


@query("WITH r AS (SELECT l_suppkey component,l_discount*10+l_suppkey%3 residual,l_linenumber=1 held FROM lineitem WHERE l_quantity<45), g AS (SELECT component,list_sort(list(residual))[count(*)//2+1] gauge FROM r WHERE NOT held GROUP BY 1) SELECT component,round(gauge,6) gauge,count(*) n,round(avg(CAST(abs(residual-gauge)<=0.25 AS DOUBLE)),6) AS right FROM r JOIN g USING (component) WHERE held GROUP BY 1,2".replace("AS right", 'AS "right"'))
def score_holdout(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("component"), F.when(F.col("l_quantity") < 45, F.col("l_discount") * 10 + F.col("l_suppkey") % 3).alias("residual"), (F.col("l_linenumber") == 1).alias("held"))
    return rounded(review.holdout(rows, 0.25), "gauge", "right")


@query("WITH c AS (SELECT z,w u,w+3+((y+x)%7)/20.0::DOUBLE t FROM wound), m AS (SELECT z,quantile_cont(t-u,0.5) c FROM c GROUP BY 1) SELECT z,count(*) n,round(avg(CAST(round_even(u+c,0)=round_even(t,0) AS DOUBLE)),6) accuracy FROM c JOIN m USING (z) GROUP BY 1", "wound")
def wrap_accuracy(t):
    cells = _wound(t).select("z", F.col("w").alias("u"), (F.col("w") + 3 + (F.col("y") + F.col("x")) % 7 / 20.0).alias("w"))
    return rounded(review.wrap_accuracy(cells, "z"), "accuracy")


@query("SELECT z,y,x,round(sin(2*pi()*w),6) s,round(cos(2*pi()*w),6) c,round(CASE WHEN w-floor(w)>0.9999999 THEN 0 ELSE w-floor(w) END,9) AS turn FROM wound", "wound")
def turn_codes(t):
    sine, cosine = review.encode_turn(F.col("w"))
    turn = review.decode_turn(sine * 2, cosine * 2)
    out = _wound(t).select(*KEY, sine.alias("s"), cosine.alias("c"), F.when(turn > 0.9999999, 0.0).otherwise(turn).alias("turn"))
    return rounded(rounded(out, "s", "c"), "turn", places=9)


@query("WITH e AS (SELECT vec_id,label,[CAST(embedding[k] AS DOUBLE) for k in [1,2,3]] a,[CAST(embedding[k] AS DOUBLE) for k in [4,5,6]] b FROM embeddings), n AS (SELECT (vec_id*37%101)/100.0::DOUBLE p,label%2 y,(vec_id*13%100)/100.0::DOUBLE wp,(vec_id*29%100)/100.0::DOUBLE w,list_dot_product(a,b)/sqrt(list_dot_product(a,a)*list_dot_product(b,b)) d FROM e) SELECT round(2.0*count(*) FILTER (p>0.5 AND y=1)/(count(*) FILTER (p>0.5)+sum(y)+1e-6),6) dice,round(avg(least((wp-w)-floor(wp-w),(w-wp)-floor(w-wp))),6) w_mae,round(avg(degrees(acos(least(greatest(d,-1),1)))),5) AS degrees FROM n".replace("AS degrees", 'AS "degrees"'))
def head_metrics(t):
    part = [F.transform(F.slice("embedding", k, 3), lambda v: v.cast("double")) for k in (1, 4)]
    norm = [F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, v: s + v * v)) for p in part]
    unit = [F.transform(part[0], lambda v: v / norm[0]), F.transform(part[1], lambda v: v / norm[1])]
    k = F.col("vec_id")
    rows = t.embeddings.select((k * 37 % 101 / 100.0).alias("p"), (F.col("label") % 2).alias("y"), (k * 13 % 100 / 100.0).alias("w_pred"), (k * 29 % 100 / 100.0).alias("w"), unit[0].alias("n"), unit[1].alias("m"))
    return rounded(rounded(review.head_quality(rows), "dice", "w_mae"), "degrees", places=5)


_GRID = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


@query(f"WITH l AS (SELECT event_id id,(value-100)/20.0::DOUBLE d,CAST(user_id%3=0 AS INT) y FROM events), z AS (SELECT id,y,t,d/t z FROM l,(SELECT unnest({_GRID}::DOUBLE[]) t)), s AS (SELECT t,avg(greatest(z,0)-z*y+ln(1+exp(-abs(z)))) FILTER (id%2=0) fitted,avg(greatest(z,0)-z*y+ln(1+exp(-abs(z)))) FILTER (id%2<>0) held_out FROM z GROUP BY 1) SELECT t,round(fitted,6) fitted,round(held_out,6) held_out FROM s ORDER BY round(s.fitted,9),t LIMIT 1")
def temperature_scale(t):
    rows = t.events.select(F.col("event_id").alias("id"), ((F.col("value") - 100) / 20.0).alias("d"), (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    return rounded(review.temperature(rows, _GRID), "fitted", "held_out")


_BETTI_TERMS = ",".join(f"CASE WHEN p{k}+g{k}>0 THEN {w}*2*least(p{k},g{k})/(p{k}+g{k}) ELSE 0 END n{k},CASE WHEN p{k}+g{k}>0 THEN {w} ELSE 0 END w{k}" for k, w in enumerate(("0.34::DOUBLE", "0.33::DOUBLE", "0.33::DOUBLE")))


@query(f"WITH b AS (SELECT c_custkey id,c_custkey%3 p0,c_custkey%5 g0,c_custkey//3%2 p1,c_custkey//7%3 g1,c_custkey//11%2 p2,c_custkey//13%2 g2 FROM customer), n AS (SELECT id,{_BETTI_TERMS} FROM b) SELECT id,round(CASE WHEN w0+w1+w2>0 THEN (n0+n1+n2)/(w0+w1+w2) ELSE 1 END,6) topo FROM n")
def topo_score(t):
    k = F.col("c_custkey")
    cols = {"p0": k % 3, "g0": k % 5, "p1": F.floor(k / 3) % 2, "g1": F.floor(k / 7) % 3, "p2": F.floor(k / 11) % 2, "g2": F.floor(k / 13) % 2}
    return rounded(review.betti_score(t.customer.select(k.alias("id"), *(c.alias(n) for n, c in cols.items()))).select("id", "topo"), "topo")


@query("WITH RECURSIVE m AS (SELECT s_suppkey a,s_suppkey+s_nationkey+1 b FROM supplier WHERE s_nationkey%3<>0), e AS (SELECT a,b FROM m WHERE b IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT b,a FROM m WHERE b IN (SELECT s_suppkey FROM supplier)), r(id,lab) USING KEY (id) AS (SELECT s_suppkey,s_suppkey FROM supplier UNION (SELECT e.a,min(x.lab) FROM e JOIN recurring.r x ON e.b=x.id JOIN recurring.r y ON y.id=e.a GROUP BY e.a,y.lab HAVING min(x.lab)<y.lab)) SELECT c.a,c.b,p.lab AS \"label\" FROM (SELECT s_suppkey a,s_suppkey+7 b FROM supplier) c JOIN r p ON p.id=c.a JOIN r q ON q.id=c.b WHERE p.lab=q.lab")
def broken_links(t):
    key = F.col("s_suppkey")
    items = t.supplier.select(key.alias("id"))
    must = t.supplier.filter("s_nationkey % 3 <> 0").select(key.alias("a"), (key + F.col("s_nationkey") + 1).alias("b")).join(items.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    return review.linked(items, must, t.supplier.select(key.alias("a"), (key + 7).alias("b")))[1]


@query("SELECT c_custkey,c_nationkey,n_name FROM customer JOIN nation ON n_nationkey=c_nationkey")
def checked_lookup(t):
    source = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return review.matched(t.customer.select("c_custkey", "c_nationkey"), source, "c_nationkey", "n_name")


@query("WITH z AS (SELECT unnest(range(32)) pos,vec_id,embedding e FROM embeddings) SELECT CAST(pos AS INT) pos,count(*) n,round(avg(abs(CAST(e[pos+1] AS DOUBLE)-CAST(e[pos+33] AS DOUBLE))),6) mae FROM z GROUP BY 1")
def list_zip(t):
    halves = t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("p"), F.slice("embedding", 33, 32).alias("g"))
    both = review.zipped(halves, "p", "g", ["vec_id"])
    return rounded(both.groupBy("pos").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred").cast("double") - F.col("truth").cast("double"))).alias("mae")), "mae")


@query("WITH c AS (SELECT z,y*32+x a,v-avg(v) OVER (PARTITION BY z) d,var_pop(v) OVER (PARTITION BY z) s,count(*) OVER (PARTITION BY z) n FROM ct), r AS (SELECT p.z,k,avg(p.d*q.d)/any_value(p.s) r,any_value(p.n) n FROM c p,(SELECT unnest(range(1,13)) k) JOIN c q ON q.z=p.z AND q.a=p.a+k GROUP BY 1,2) SELECT z,any_value(n) n,CAST(coalesce(min(k) FILTER (r<exp(-1)),13) AS INT) length FROM r GROUP BY 1".replace(" length FROM", ' AS "length" FROM'), "ct")
def correlation_length(t):
    rows = t.ct().select("z", (F.col("y") * 32 + F.col("x")).alias("a"), F.col("v").cast("double").alias("v"))
    return review.lagged_length(rows, "z", "a", "v", 12)


@query("SELECT o_orderkey id,CAST((CASE WHEN v>=2 THEN 1 ELSE 0 END)+(CASE WHEN v>=4 THEN 1 ELSE 0 END)+(CASE WHEN v>=8 THEN 1 ELSE 0 END) AS INT) lod FROM (SELECT o_orderkey,1.0/greatest((o_orderkey%128+1)/64.0::DOUBLE,1e-6) v FROM orders)")
def lod_choice(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), review.lod_of((F.col("o_orderkey") % 128 + 1) / 64.0, 4).alias("lod"))


@query("WITH h AS (SELECT p_partkey id,((p_partkey*0.6180339887::DOUBLE)%1.0)*6 h FROM part), f AS (SELECT id,CAST(floor(h) AS INT) k,h-floor(h) t FROM h) SELECT id,round(CASE k WHEN 0 THEN 1 WHEN 1 THEN 1-t WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN t ELSE 1 END,6) r,round(CASE k WHEN 0 THEN t WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1-t ELSE 0 END,6) g,round(CASE k WHEN 2 THEN t WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1-t ELSE 0 END,6) b FROM f")
def label_palette(t):
    r, g, b = review.hue(F.col("p_partkey"))
    return rounded(t.part.select(F.col("p_partkey").alias("id"), r.alias("r"), g.alias("g"), b.alias("b")), "r", "g", "b")


@query("SELECT mesh,count(*) n,round(min(z),6) z0,round(max(z),6) z1,round(min(y),6) y0,round(max(y),6) y1,round(min(x),6) x0,round(max(x),6) x1,round(sum(nz*nz+ny*ny+nx*nx),6) peak FROM points GROUP BY 1", "points")
def surface_summary(t):
    out = mesh.summary(t.points())
    return rounded(out, *(f"{a}{k}" for a in KEY for k in (0, 1)), "peak")


@query("WITH m AS (SELECT l_orderkey//256 s,CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END y,l_discount*5 p FROM lineitem) SELECT s,count(*) n,round(sum(y*p),6) hit,round((2*sum(y*p)+1.0)/(sum(p*p)+sum(y*y)+1.0),6) soft FROM m GROUP BY 1")
def soft_dice(t):
    y, p = (F.col("l_returnflag") == "R").cast("int"), F.col("l_discount") * 5
    by = t.lineitem.groupBy(F.floor(F.col("l_orderkey") / 256).alias("s"))
    return rounded(by.agg(F.count("*").alias("n"), F.sum(y * p).alias("hit"), metrics.soft_overlap(p, y).alias("soft")), "hit", "soft")


@query("SELECT s_suppkey id,s_suppkey//3-min(s_suppkey//3) OVER (PARTITION BY s_suppkey//10) winding FROM supplier")
def integer_windings(t):
    key = F.col("s_suppkey")
    edges = t.supplier.select(key.alias("a"), (key + 1).alias("b")).filter("a % 10 <> 9").join(t.supplier.select(key.alias("b")), "b", "left_semi")
    steps = edges.select("a", "b", (F.floor(F.col("b") / 3) - F.floor(F.col("a") / 3)).alias("dwrap"), (0.5 + F.col("a") % 5 / 10.0).alias("certainty"))
    return patches.integer_windings(t.supplier.select(key.alias("id")), steps)
