"""Scores, verdicts and review queues over registries of meshes, heads and measurements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laminae.functions.numeric import ladder, upper_median, wrap_difference
from laminae.session import running_sums

#: Limits of the health verdict (bad, suspect), by measure.
HEALTH_LIMITS = {"fold_detj": (0.05, 0.02), "self_intersect": (0.10, 0.05), "frac_long": (0.08, 0.03), "holes": (100, 20), "edge_cv": (0.5, 0.2)}
#: What is done with a mesh of each grade.
DECISIONS = {"A": "use", "B": "shift-repair", "C": "warp-repair", "D": "trust-mask", "E": "quarantine"}
#: Order of grades; others come after.
RANKS = {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4}


def health(measures: DataFrame) -> DataFrame:
    """Adds ``health``: bad, suspect or ok by HEALTH_LIMITS; unknown if nothing was measured, a missing one counts as 0."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in HEALTH_LIMITS}

    def over(k: int) -> Column:
        return F.greatest(*((value[c] > limits[k]).cast("int") for c, limits in HEALTH_LIMITS.items())) == 1

    unknown = F.coalesce(*(F.col(c).cast("double") for c in HEALTH_LIMITS)).isNull()
    return measures.withColumn("health", ladder((unknown, "unknown"), (over(0), "bad"), (over(1), "suspect"), otherwise="ok"))


#: Least share on bright material, most spread, least coherence and largest offset (none: any) of a tier;
#: least ridge score and most spread where that share was not measured; crops that settle a doubt.
ALIGN_LIMITS = {"A": (90, 7, 70, 3), "B": (84, 8, 60, 4), "C": (70, 12, 45, None)}
RIDGE_LIMITS = {"A": (72, 5), "B": (62, 6), "C": (50, 10)}
MIXED, BRIGHT, CROPS, ENOUGH_CROPS = 0.4, 50, 8, 32


def alignment(cards: DataFrame) -> DataFrame:
    """Adds ``tier`` from columns pap, pap_low, pap_high, iqr, alpha_iqr, coh, off, ridge, good and crops, each maybe null.

    Spread counts by iqr, by alpha_iqr with one to spare, or by coherence. A tier that the ends of pap's interval do not
    share, on few crops, has a question mark. Without pap ridge scores decide; nothing measured is unknown.
    """
    number = {c: F.col(c).cast("double") for c in ("pap", "pap_low", "pap_high", "iqr", "alpha_iqr", "coh", "off", "ridge", "good")}
    mixed = F.coalesce(number["good"], F.lit(0.0)) >= MIXED

    def sure(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    def tier_at(p: Column) -> Column:
        steps = []
        for name, (least, spread, coherent, most) in ALIGN_LIMITS.items():
            tight = sure(number["iqr"] <= spread) | sure(number["alpha_iqr"] <= spread + 1) | sure(number["coh"] >= coherent)
            centred = F.lit(True) if most is None else F.coalesce(F.abs(number["off"]) <= most, F.lit(True))
            steps.append((sure(p >= least) & tight & centred, name))
        return ladder(*steps, (mixed | sure(p >= BRIGHT), "D"), otherwise="E")

    at = [tier_at(number[c]) for c in ("pap", "pap_low", "pap_high")]
    doubtful = number["pap_low"].isNotNull() & number["pap_high"].isNotNull() & ((at[0] != at[1]) | (at[0] != at[2])) & (F.coalesce("crops", F.lit(CROPS)) < ENOUGH_CROPS)
    ridges = [(sure(number["ridge"] >= least) & sure(number["iqr"] <= spread), name) for name, (least, spread) in RIDGE_LIMITS.items()]
    unknown = F.coalesce(*number.values()).isNull()
    tier = F.when(unknown, "unknown").when(number["pap"].isNull(), ladder(*ridges, (mixed, "D"), otherwise="E")).when(doubtful, F.concat(at[0], F.lit("?"))).otherwise(at[0])
    return cards.withColumn("tier", tier)


def grade(cards: DataFrame) -> DataFrame:
    """Adds ``grade`` from columns tier, health, disagree, dup_bad, dup_good: the tier, capped by health and by peers.

    A broken mesh is E; a suspect A or B becomes C; a peer that disagrees makes an A a B; redundant partners that
    disagree more often than they agree make an A or B a C.
    """
    tier, good = F.col("tier"), F.col("tier").isin("A", "B")
    peers = (F.col("dup_bad") >= 1) & (F.col("dup_bad") > F.col("dup_good"))
    steps = (((F.col("health") == "bad") | (tier == "E"), "E"), ((F.col("health") == "suspect") & good, "C"), ((tier == "A") & (F.col("disagree") > 0), "B"), (good & peers, "C"))
    capped = ladder(*steps, otherwise="")
    return cards.withColumn("grade", F.when(capped == "", tier).otherwise(capped))


def decision(grades: Column) -> Column:
    """What is done with a grade; a question mark behind it does not matter, other grades go to review."""
    known = F.create_map(*(F.lit(x) for pair in DECISIONS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.rtrim(grades, F.lit("?"))), F.lit("review"))


def rank(grades: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.rtrim(grades, F.lit("?"))), F.lit(5))


def repair_plan(cards: DataFrame) -> DataFrame:
    """Adds ``action`` and ``max_shift`` by grade, and ``lattice``: a spacing that leaves about 1,200 control points."""
    base = F.rtrim(F.col("grade"), F.lit("?"))
    action = ladder((base == "A", "gentle"), (base == "B", "repair"), (base == "C", "repair"), (base == "D", "trust-mask"), otherwise="quarantine")
    shift = F.when(base == "A", 3).when(base == "B", 4).when(base == "C", 8)
    spacing = F.greatest(F.lit(8), F.ceil(F.sqrt(F.col("nu") * F.col("nv") / 1200.0)).cast("int"))
    return cards.withColumns({"action": action, "max_shift": shift, "lattice": spacing})


def badness(cards: DataFrame) -> DataFrame:
    """Adds ``bad`` from delta, ce and disagree: small deltas, a large loss and conflicts all count; nulls count nothing."""
    low = F.coalesce(F.greatest(5.0 - F.col("delta"), F.lit(0.0)), F.lit(0.0))
    return cards.withColumn("bad", low + 3.0 * F.coalesce(F.col("ce"), F.lit(0.0)) + 0.2 * F.coalesce(F.col("disagree"), F.lit(0)))


def worst_first(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` with their ``place`` from 1; only these are ever ranked in one task."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def last_measurements(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key, by a maximum that runs before the shuffle; ``order`` tells a key's rows apart."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def pair_counts(lines: DataFrame) -> DataFrame:
    """(name, verdict, n) of text lines "pair A <-> B overlap N% VERDICT", counted for both ends; other lines are ignored."""
    pattern = r"^pair (\S+) <-> (\S+) overlap (\d+)% (AGREE|OFFSET|DISAGREE)$"
    parts = [F.regexp_extract("line", pattern, k) for k in (1, 2, 4)]
    read = lines.filter(F.col("line").rlike(pattern)).select(F.explode(F.array(*parts[:2])).alias("name"), parts[2].alias("verdict"))
    return read.groupBy("name", "verdict").agg(F.count("*").alias("n"))


def spacing(gaps: DataFrame) -> DataFrame:
    """One row (n, spacing): upper median over patches of the least absolute gap of (patch, gap)."""
    least = gaps.groupBy("patch").agg(F.min(F.abs("gap")).alias("g"))
    run, total = running_sums(least.groupBy("g").agg(F.count("*").alias("k")), ["g"], ["k"])
    n = total["k"]
    return run.filter(F.col("k_upto") > n // 2).agg(F.lit(n).cast("long").alias("n"), F.min("g").alias("spacing"))


def holdout(residuals: DataFrame, tolerance: float) -> DataFrame:
    """(component, gauge, n, right): share of held-out residuals within ``tolerance`` of the upper median of the others.

    Rows are (component, residual, held); null and NaN residuals are skipped; a component without training rows has
    no gauge.
    """
    real = residuals.filter(F.col("residual").isNotNull() & ~F.isnan("residual"))
    gauge = real.filter("not held").groupBy("component").agg(upper_median("residual").alias("gauge"))
    near = (F.abs(F.col("residual") - F.col("gauge")) <= tolerance).cast("double")
    return real.filter("held").join(gauge, "component").groupBy("component").agg(F.first("gauge").alias("gauge"), F.count("*").alias("n"), F.avg(near).alias("right"))


def wrap_accuracy(cells: DataFrame, by: str) -> DataFrame:
    """(by, n, accuracy): share of cells (u, w) whose rounded u + c is the rounded w, c being the group's median of w - u."""
    middle = cells.groupBy(by).agg(F.percentile(F.col("w") - F.col("u"), 0.5).alias("c"))
    right = (F.rint(F.col("u") + F.col("c")) == F.rint("w")).cast("double")
    return cells.join(middle, by).groupBy(by).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def encode_turn(w: Column) -> tuple[Column, Column]:
    """(sine, cosine) of a winding's turn."""
    return F.sin(2 * math.pi * w), F.cos(2 * math.pi * w)


def decode_turn(sine: Column, cosine: Column) -> Column:
    """A turn in [0, 1) from its sine and cosine, of any length."""
    return F.pmod(F.atan2(sine, cosine) / (2 * math.pi), F.lit(1.0))


def head_quality(rows: DataFrame) -> DataFrame:
    """One row (dice, w_mae, degrees) from p, y, w_pred, w and unit vectors n, m (arrays): Dice at one half, mean
    circular distance of turns, mean angle between normals."""
    hit = F.col("p") > 0.5
    top, bottom = F.sum((hit & (F.col("y") == 1)).cast("double")), F.sum(hit.cast("double")) + F.sum(F.col("y").cast("double"))
    dot = F.aggregate(F.zip_with("n", "m", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    angle = F.degrees(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))))
    return rows.agg((2 * top / (bottom + 1e-6)).alias("dice"), F.avg(F.abs(wrap_difference(F.col("w_pred") - F.col("w")))).alias("w_mae"), F.avg(angle).alias("degrees"))


def temperature(logits: DataFrame, grid: list[float]) -> DataFrame:
    """One row (t, fitted, held_out): the temperature of ``grid`` with the least mean cross-entropy on even ids, its
    value there and on odd ids. Rows are (id, d, y); one pass sums all temperatures."""
    dealt = logits.withColumn("t", F.explode(F.array(*(F.lit(float(t)) for t in grid))))
    z = F.col("d") / F.col("t")
    loss = F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z)))
    even = F.pmod("id", F.lit(2)) == 0
    sums = dealt.groupBy("t").agg(F.avg(F.when(even, loss)).alias("fitted"), F.avg(F.when(~even, loss)).alias("held_out"))
    return sums.agg(F.min_by(F.struct("t", "fitted", "held_out"), F.struct(F.round("fitted", 9), "t")).alias("r")).select("r.*")


def betti_score(rows: DataFrame) -> DataFrame:
    """Adds ``topo`` to columns p0, g0, p1, g1, p2, g2 (Betti numbers of two masks): weighted F1 of the dimensions in use."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for k, w in enumerate((0.34, 0.33, 0.33)):
        p, g = F.col(f"p{k}"), F.col(f"g{k}")
        used = (p + g) > 0
        total = total + F.when(used, w * 2 * F.least(p, g) / (p + g)).otherwise(0.0)
        weight = weight + F.when(used, w).otherwise(0.0)
    return rows.withColumn("topo", F.when(weight > 0, total / weight).otherwise(1.0))


def mask_score(pred: DataFrame, truth: DataFrame, shape, tolerance: int = 2) -> DataFrame:
    """One row (nsd, split, merge, topo, score) of two masks (z, y, x): surface Dice, variation of information of their
    26-connected parts, Betti F1, and their weighted sum. Two empty masks score 1."""
    from laminae.operators import graph, metrics

    labels = [graph.voxel_components(m, shape, full=True).withColumn("label", F.col("label") + 1) for m in (pred, truth)]
    voi = metrics.voi_of_masks(*labels).select(F.coalesce("split", F.lit(0.0)).alias("split"), F.coalesce("merge", F.lit(0.0)).alias("merge"))
    numbers = [graph.betti(m, shape).select(*(F.col(f"b{k}").alias(f"{side}{k}") for k in range(3))) for m, side in ((pred, "p"), (truth, "g"))]
    row = metrics.surface_dice(pred, truth, tolerance).crossJoin(voi).crossJoin(betti_score(numbers[0].crossJoin(numbers[1])).select("topo"))
    return metrics.composite_score(row)


def linked(items: DataFrame, must: DataFrame, cannot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, label) closed under must-links (a, b); cannot-links (a, b, label) that the closure breaks)."""
    from laminae.operators.graph import components

    labels = components(items, must)
    ends = [labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in ("a", "b")]
    return labels, cannot.join(ends[0], "a").join(ends[1], "b").filter("la = lb").select("a", "b", F.col("la").alias("label"))


def matched(rows: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``source``'s ``value`` of the same key; a row whose key the source lacks is an error, not a loss."""
    looked = rows.join(source.select(key, value), key, "left")
    message = F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string"))
    return looked.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(message)).otherwise(F.col(value)))


def zipped(rows: DataFrame, pred: str, truth: str, keys: list[str]) -> DataFrame:
    """(keys, pos, pred, truth): the elements of two arrays side by side; arrays of different length are an error."""
    checked = F.when(F.size(pred) == F.size(truth), F.arrays_zip(F.col(pred).alias("pred"), F.col(truth).alias("truth"))).otherwise(F.raise_error(F.lit("lists differ in length")))
    return rows.select(*keys, F.posexplode(checked).alias("pos", "both")).select(*keys, "pos", "both.pred", "both.truth")


def lagged_length(rows: DataFrame, by: str, at: str, value: str, lags: int) -> DataFrame:
    """(by, n, length): first lag up to ``lags`` at which the autocorrelation falls under 1/e, or lags + 1.

    Equal values never fall under it. Products are joined lag by lag, so pairs grow with rows x lags.
    """
    centred = rows.join(rows.groupBy(by).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count("*").alias("n")), by)
    centred = centred.select(by, F.col(at).alias("_at"), (F.col(value) - F.col("_m")).alias("_x"), "_v", "n")
    ahead = centred.select(by, "_at", F.col("_x").alias("_y"))
    moved = centred.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("_at", F.col("_at") + F.col("lag"))
    corr = moved.join(ahead, [by, "_at"]).groupBy(by, "lag").agg((F.avg(F.col("_x") * F.col("_y")) / F.max(F.when(F.col("_v") > 0, F.col("_v")))).alias("r"), F.first("n").alias("n"))
    under = F.min(F.when(F.col("r") < math.exp(-1), F.col("lag")))
    return corr.groupBy(by).agg(F.first("n").alias("n"), F.coalesce(under, F.lit(lags + 1)).alias("length"))


def lod_of(zoom: Column, levels: int) -> Column:
    """Coarsest level of which one voxel is no larger than a pixel at ``zoom`` pixels a voxel."""
    voxels = 1.0 / F.greatest(zoom, F.lit(1e-6))
    return sum(((voxels >= float(1 << k)).cast("int") for k in range(1, levels)), F.lit(0))


def hue(label: Column) -> tuple[Column, Column, Column]:
    """(red, green, blue) in [0, 1] of a label: hues a golden section apart, fully saturated."""
    h = F.pmod(label * 0.6180339887, F.lit(1.0)) * 6.0

    def channel(shift: float) -> Column:
        """1 for a third of the circle, and ramps of a sixth on either side."""
        return F.least(F.greatest(F.abs(F.pmod(h + shift, F.lit(6.0)) - 3.0) - 1.0, F.lit(0.0)), F.lit(1.0))

    return channel(0.0), channel(4.0), channel(2.0)


def affine(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Points (x, y, z order of the matrix, three rows of four numbers) moved; columns z, y, x are replaced."""
    at = [F.col("x"), F.col("y"), F.col("z")]
    moved = [sum((F.lit(float(m)) * c for m, c in zip(row, at)), F.lit(float(row[3]))) for row in matrix]
    return points.withColumns(dict(zip(("x", "y", "z"), moved, strict=True)))


def reconciled(rows: DataFrame, key: str, limit: float, strong: float, scale: float) -> DataFrame:
    """(key, v, conf) from (key, v, c): weighted mean, and mean confidence that fades with the weighted deviation.

    Where sources of at least ``strong`` confidence, two or more, differ by more than ``limit``, it is 0.
    """
    mean = F.sum(F.col("c") * F.col("v")) / F.sum("c")
    spread = F.sqrt(F.greatest(F.sum(F.col("c") * F.col("v") * F.col("v")) / F.sum("c") - mean * mean, F.lit(0.0)))
    by = rows.groupBy(key).agg(mean.alias("v"), spread.alias("_s"), F.avg("c").alias("_c"), F.sum((F.col("c") >= strong).cast("int")).alias("_n"))
    conf = F.when((F.col("_s") > limit) & (F.col("_n") >= 2), 0.0).otherwise(F.col("_c") * F.exp(-F.col("_s") / scale))
    return by.select(key, "v", conf.alias("conf"))


def geometric_consensus(rows: DataFrame, by: list[str], floor: float) -> DataFrame:
    """(by, v): geometric mean of v, each raised by ``floor``, which is taken off again."""
    return rows.groupBy(*by).agg((F.exp(F.avg(F.ln(F.col("v") + floor))) - floor).alias("v"))


def least_median(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, name, median): of each key's names, that with the least upper median; ties go to the first name."""
    medians = rows.groupBy(key, name).agg(upper_median(value).alias("median"))
    return medians.groupBy(key).agg(F.min(F.struct("median", name)).alias("_m")).select(key, f"_m.{name}", "_m.median")
