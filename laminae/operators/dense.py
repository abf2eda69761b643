"""Dense numerics on haloed chunks: voxels are dealt to every chunk whose halo they touch, and numpy works a chunk at a
time. A chunk's size bounds each group, whatever the volume's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminae.session import settled

KEY = ["z", "y", "x"]


def on_chunks(vox: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: list[str], side: int, halo: int, shape: tuple[int, int, int], mirrored: bool = True) -> DataFrame:
    """Applies ``work`` to dense blocks of ``side`` and a halo, reflected at the volume's ends; returns present voxels.

    ``work`` maps a block to named arrays of its shape. Missing voxels are 0 inside a block. Blocks that are not
    ``mirrored`` stop where the volume stops, for work that has a rule of its own there.
    """
    dealt = vox.select(*KEY, F.col("v").cast("double").alias("v"))
    for a in KEY:
        chunks = F.sequence(F.floor((F.col(a) - halo) / side), F.floor((F.col(a) + halo) / side))
        dealt = dealt.withColumn(f"c{a}", F.explode(chunks))
    for a, n in zip(KEY, shape, strict=True):
        dealt = dealt.filter((F.col(f"c{a}") >= 0) & (F.col(f"c{a}") * side < n))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        corner = [int(group[f"c{a}"].iloc[0]) * side for a in KEY]
        low = [max(0, c - halo) for c in corner]
        high = [min(n, c + side + halo) for c, n in zip(corner, shape)]
        block = np.zeros([h - b for h, b in zip(high, low)])
        at = [group[a].to_numpy() - b for a, b in zip(KEY, low)]
        block[tuple(at)] = group["v"].to_numpy()
        before = [halo - (c - b) for c, b in zip(corner, low)]
        after = [halo - (h - min(n, c + side)) for h, n, c in zip(high, shape, corner)]
        if mirrored:
            low = [b - n for b, n in zip(low, before)]
            block = np.pad(block, list(zip(before, after)), mode="symmetric")
        out = work(block)
        core = np.logical_and.reduce([(group[a] >= c) & (group[a] < c + side) for a, c in zip(KEY, corner)])
        inside = group[core]
        place = tuple(inside[a].to_numpy() - b for a, b in zip(KEY, low))
        return pd.DataFrame({**{a: inside[a] for a in KEY}, **{name: out[name][place] for name in outputs}})

    schema = ", ".join(f"{a} long" for a in KEY) + ", " + ", ".join(f"{name} double" for name in outputs)
    return dealt.groupBy("cz", "cy", "cx").applyInPandas(run, schema)


def gaussian_weights(sigma: float) -> np.ndarray:
    radius = max(1, int(np.ceil(3 * sigma)))
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return taps / taps.sum()


def blur(block: np.ndarray, sigma: float) -> np.ndarray:
    weights = gaussian_weights(sigma)
    half = len(weights) // 2
    for axis in range(3):
        wide = np.pad(block, [(half, half) if k == axis else (0, 0) for k in range(3)], mode="edge")
        windows = np.lib.stride_tricks.sliding_window_view(wide, len(weights), axis=axis)
        block = windows @ weights
    return block


def gaussian_blur(vox: DataFrame, sigma: float, side: int, shape) -> DataFrame:
    """(z, y, x, v): separable Gaussian, reflected at the ends."""
    halo = len(gaussian_weights(sigma)) // 2
    return on_chunks(vox, lambda b: {"v": blur(b, sigma)}, ["v"], side, halo, shape)


def _tensor(block: np.ndarray, sigma: float) -> np.ndarray:
    grads = np.gradient(block)
    rows = [[blur(grads[i] * grads[j], sigma) for j in range(3)] for i in range(3)]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def structure_tensor(vox: DataFrame, sigma: float, side: int, shape) -> DataFrame:
    """(z, y, x, sheetness, nz, ny, nx): planarity and normal from the smoothed gradient tensor's eigenvectors."""

    def work(block):
        values, vectors = np.linalg.eigh(_tensor(block, sigma))
        top, middle = values[..., 2], values[..., 1]
        normal = vectors[..., 2]
        sign = np.sign(normal[..., 0:1] + 1e-12 * normal[..., 1:2])
        normal = normal * np.where(sign == 0, 1, sign)
        return {"sheetness": (top - middle) / (top + 1e-9), **{f"n{a}": normal[..., k] for k, a in enumerate(KEY)}}

    halo = len(gaussian_weights(sigma)) // 2 + 2
    return on_chunks(vox, work, ["sheetness", "nz", "ny", "nx"], side, halo, shape)


def _second_differences(u: np.ndarray) -> np.ndarray:
    """Hessians from differences over one voxel either side; zero on the block's own faces."""
    out = np.zeros((*u.shape, 3, 3))
    inner = tuple(slice(1, n - 1) for n in u.shape)

    def at(**steps: int) -> np.ndarray:
        return u[tuple(slice(1 + steps.get(a, 0), n - 1 + steps.get(a, 0)) for a, n in zip(KEY, u.shape))]

    for i, a in enumerate(KEY):
        out[(*inner, i, i)] = at(**{a: 1}) - 2 * at() + at(**{a: -1})
        for j, b in enumerate(KEY[:i]):
            out[(*inner, i, j)] = out[(*inner, j, i)] = (at(**{a: 1, b: 1}) - at(**{a: 1, b: -1}) - at(**{a: -1, b: 1}) + at(**{a: -1, b: -1})) / 4
    return out


def plate_terms(block: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(ratio of the second to the largest curvature, strength of all) of a blurred block; strength is 0 off bright plates."""
    values = np.linalg.eigvalsh(_second_differences(blur(block, sigma)) * sigma * sigma)
    values = np.take_along_axis(values, np.argsort(np.abs(values), -1), -1)
    strength = np.sqrt((values**2).sum(-1))
    return np.abs(values[..., 1]) / (np.abs(values[..., 2]) + 1e-9), np.where(values[..., 2] < 0, strength, -strength)


def hessian_plateness(vox: DataFrame, sigmas: list[float], side: int, shape, alpha: float = 0.5) -> DataFrame:
    """(z, y, x, plate): over scales, the most of exp(-ratio^2 / 2 alpha^2) (1 - exp(-strength^2 / 2 c^2)) on bright sheets.

    c is half the largest strength of the whole volume at that scale, so a first aggregate settles it; voxels on the
    volume's faces have no second differences and get 0.
    """
    names = [f"{n}{k}" for k in range(len(sigmas)) for n in ("ratio", "strength")]

    def work(block):
        return dict(zip(names, (x for s in sigmas for x in plate_terms(block, s))))

    halo = max(len(gaussian_weights(s)) // 2 for s in sigmas) + 1
    terms = settled(on_chunks(vox, work, names, side, halo, shape))
    inside = F.lit(True)
    for a, n in zip(KEY, shape, strict=True):
        inside = inside & (F.col(a) > 0) & (F.col(a) < n - 1)
    top = terms.filter(inside).agg(*(F.greatest(F.max(F.abs(f"strength{k}")), F.lit(1e-9)).alias(f"top{k}") for k in range(len(sigmas))))
    plates = []
    for k in range(len(sigmas)):
        ratio, strength, c = F.col(f"ratio{k}"), F.col(f"strength{k}"), 0.5 * F.col(f"top{k}")
        value = F.exp(-ratio * ratio / (2 * alpha * alpha)) * (1 - F.exp(-strength * strength / (2 * c * c)))
        plates.append(F.when(inside & (strength > 0), value).otherwise(0.0))
    return terms.crossJoin(F.broadcast(top)).select(*KEY, F.greatest(*plates, F.lit(0.0)).alias("plate"))


def _clamped_gradient(u: np.ndarray) -> list[np.ndarray]:
    """Half central differences; beyond the block a neighbour is the voxel itself."""
    out = []
    for axis in range(3):
        wide = np.pad(u, [(1, 1) if k == axis else (0, 0) for k in range(3)], mode="edge")
        out.append((np.take(wide, range(2, wide.shape[axis]), axis) - np.take(wide, range(wide.shape[axis] - 2), axis)) / 2)
    return out


def along_sheets(block: np.ndarray, steps: int, rate: float, sigma_grad: float, sigma_tensor: float, floor: float) -> np.ndarray:
    """Diffusion of a block by a tensor that is ``floor`` across its sheets and grows with sheetness along them."""
    grads = _clamped_gradient(blur(block, sigma_grad))
    tensor = np.stack([np.stack([blur(a * b, sigma_tensor) for b in grads], -1) for a in grads], -2)
    values, vectors = np.linalg.eigh(tensor)
    sheet = np.clip((values[..., 2] - values[..., 1]) / (values[..., 2] + 1e-9), 0, 1)
    normal = [vectors[..., k, 2] for k in range(3)]
    along = floor + (1 - floor) * sheet
    for _ in range(steps):
        grads = _clamped_gradient(block)
        across = sum(n * g for n, g in zip(normal, grads))
        flux = [along * g - (along - floor) * across * n for g, n in zip(grads, normal)]
        block = block + rate * sum(_clamped_gradient(f)[axis] for axis, f in enumerate(flux))
    return block


def coherence_diffusion(vox: DataFrame, steps: int, rate: float, side: int, shape, sigma_grad: float = 0.5, sigma_tensor: float = 1.0, floor: float = 0.05) -> DataFrame:
    """(z, y, x, v): explicit diffusion along sheets, whose directions are those of the first volume.

    The rate is limited to 1/6, where explicit steps are stable. A step reaches two voxels, and the halo covers all. As it is
    deep, chunks are at least two halos wide: a voxel is then dealt to eight of them at most, and what they say of it is
    the same.
    """
    rate = min(rate, 1 / 6)
    halo = 2 * steps + 1 + len(gaussian_weights(sigma_grad)) // 2 + len(gaussian_weights(sigma_tensor)) // 2
    side = max(side, 2 * halo)

    def work(block):
        return {"v": along_sheets(block, steps, rate, sigma_grad, sigma_tensor, floor)}

    return on_chunks(vox, work, ["v"], side, halo, shape, mirrored=False)


def _envelope(at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Least (at - p)^2 + d[p] for every place of a sorted line: the lower envelope of parabolas, in one pass each way."""
    seeds = np.flatnonzero(np.isfinite(d))
    hull, since = [int(seeds[0])], [-np.inf]
    for p in seeds[1:].tolist():
        while True:
            q = hull[-1]
            meet = ((d[p] + at[p] ** 2) - (d[q] + at[q] ** 2)) / (2 * (at[p] - at[q]))
            if meet > since[-1]:
                break
            hull.pop()
            since.pop()
        hull.append(p)
        since.append(meet)
    own = np.array(hull)[np.searchsorted(np.array(since), at, "right") - 1]
    return (at - at[own]) ** 2 + d[own]


def _nearer(lines: np.ndarray, steps: int = 64) -> np.ndarray:
    """Least (i - j)^2 + d[j] along the rows of a table of full lines, inf where a line has no finite place.

    All lines take one step further at a time until no step can matter; those that need more than ``steps`` go through
    their envelope of parabolas.
    """
    out = lines.copy()
    n = lines.shape[1]
    open_ = np.flatnonzero(np.isfinite(lines).any(1))
    for k in range(1, min(steps, n - 1) + 1):
        open_ = open_[out[open_].max(1) > k * k]
        if not len(open_):
            return out
        part, far = out[open_], lines[open_]
        part[:, k:] = np.minimum(part[:, k:], far[:, :-k] + k * k)
        part[:, :-k] = np.minimum(part[:, :-k], far[:, k:] + k * k)
        out[open_] = part
    if steps < n - 1:
        at = np.arange(n)
        for r in open_[out[open_].max(1) > (steps + 1) ** 2]:
            out[r] = _envelope(at, lines[r])
    return out


def distance_squared(seeds: DataFrame, grid: DataFrame, bundle: int = 8) -> DataFrame:
    """(z, y, x, d2): squared distance of every grid voxel to the nearest seed, one axis after another.

    Each pass works on bundles of lines side by side, ``bundle`` a way along x and y, one a way along z, where lines are as
    long as the volume is deep. A line is as long as its places are apart; places that the grid lacks hold no seed.
    Without seeds d2 is null.
    """
    def along(axis: str):
        others = [a for a in KEY if a != axis]

        def lines(group: pd.DataFrame) -> pd.DataFrame:
            d = group["d2"].to_numpy(dtype=float, na_value=np.inf)
            d = np.where(np.isnan(d), np.inf, d)
            line = np.unique(group[others].to_numpy(), axis=0, return_inverse=True)[1].reshape(-1)
            at = group[axis].to_numpy()
            place = (line, at - at.min())
            table = np.full((line.max() + 1, place[1].max() + 1), np.inf)
            table[place] = d
            return group[KEY].assign(d2=_nearer(table)[place])

        return lines

    marked = grid.select(*KEY).join(seeds.select(*KEY, F.lit(0.0).alias("d2")), KEY, "left")
    for axis in ("x", "y", "z"):
        size = 1 if axis == "z" else bundle
        marked = marked.groupBy(*(F.floor(F.col(a) / size).alias(f"_{a}") for a in KEY if a != axis)).applyInPandas(along(axis), "z long, y long, x long, d2 double")
    return marked.withColumn("d2", F.when(F.col("d2") < float("inf"), F.col("d2")))


def drawn(number, salt: int, n: int):
    """Column: the place below ``n`` that sample ``number`` draws: one step of a linear generator, so that every worker,
    however many there are, draws the same for the same sample."""
    return F.floor((number * 1103515245 + salt) % (1 << 31) / 65536) % n


def block_shift(a: np.ndarray, b: np.ndarray) -> tuple[list[int], float]:
    """(signed shift that moves ``a`` onto ``b``, confidence) from the peak of their phase correlation."""
    cross = np.fft.fftn(b) * np.conj(np.fft.fftn(a))
    size = np.abs(cross)
    live = size > 1e-9 * max(size.max(), 1e-30)
    peak = np.fft.ifftn(np.where(live, cross / np.where(live, size, 1), 0)).real
    at = np.unravel_index(int(peak.argmax()), peak.shape)
    return [int(k) if k <= n // 2 else int(k) - n for k, n in zip(at, peak.shape)], float(peak.max() * peak.size / max(int(live.sum()), 1))


def phase_shifts(a: DataFrame, b: DataFrame, side: int) -> DataFrame:
    """(cz, cy, cx, sz, sy, sx, conf): how far each chunk of ``b`` (z, y, x, v) is moved against that of ``a``.

    A chunk's two blocks meet in one group of bounded size; absent voxels are 0.
    """
    both = a.select(*KEY, F.col("v").cast("double").alias("v"), F.lit(0).alias("of")).union(b.select(*KEY, F.col("v").cast("double"), F.lit(1)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = [int(group[f"c{x}"].iloc[0]) for x in KEY]
        blocks = np.zeros((2, side, side, side))
        blocks[(group["of"].to_numpy(), *(group[x].to_numpy() - k * side for x, k in zip(KEY, key)))] = group["v"].to_numpy()
        shift, conf = block_shift(*blocks)
        return pd.DataFrame([[*key, *shift, conf]], columns=[*(f"c{x}" for x in KEY), *(f"s{x}" for x in KEY), "conf"])

    keyed = both.select("*", *(F.floor(F.col(x) / side).alias(f"c{x}") for x in KEY))
    return keyed.groupBy(*(f"c{x}" for x in KEY)).applyInPandas(run, "cz long, cy long, cx long, sz long, sy long, sx long, conf double")


def gaussian_response(shape: tuple[int, ...], sigma: float) -> np.ndarray:
    """What a Gaussian blur leaves of each frequency of a real transform of ``shape``."""
    axes = [*(np.fft.fftfreq(n) for n in shape[:-1]), np.fft.rfftfreq(shape[-1])]
    square = sum(np.reshape(f * f, [-1 if k == axis else 1 for k in range(len(shape))]) for axis, f in enumerate(axes))
    return np.exp(-2 * np.pi**2 * sigma**2 * square)


def _filtered(vox: DataFrame, response: Callable[[tuple[int, ...]], np.ndarray], side: int, halo: int, shape) -> DataFrame:
    """Overlap-save: each chunk and its halo go through the transform, and what the halo's ends spoil is not kept."""

    def work(block):
        return {"v": np.fft.irfftn(np.fft.rfftn(block) * response(block.shape), block.shape, axes=(0, 1, 2))}

    return on_chunks(vox, work, ["v"], side, halo, shape)


def point_spread(vox: DataFrame, sigma: float, side: int, halo: int, shape) -> DataFrame:
    """(z, y, x, v): Gaussian blur by frequencies; the volume is mirrored at its ends."""
    return _filtered(vox, lambda s: gaussian_response(s, sigma), side, halo, shape)


def wiener(vox: DataFrame, sigma: float, side: int, halo: int, shape, reg: float = 0.015) -> DataFrame:
    """(z, y, x, v): a Gaussian blur of ``sigma`` taken back, as far as ``reg`` lets weak frequencies rise.

    The filter's own reach must be inside the halo: some six sigmas; what lies beyond it is lost, and tests bound it.
    """

    def response(size):
        h = gaussian_response(size, sigma)
        return h / (h * h + reg)

    return _filtered(vox, response, side, halo, shape)


def _binomial(block: np.ndarray) -> np.ndarray:
    """Weights 1, 4, 6, 4, 1 along each axis; beyond the block its last voxel stands."""
    for axis in range(3):
        wide = np.pad(block, [(2, 2) if k == axis else (0, 0) for k in range(3)], mode="edge")
        taps = [np.take(wide, range(k, k + block.shape[axis]), axis) for k in range(5)]
        block = (taps[0] + 4 * taps[1] + 6 * taps[2] + 4 * taps[3] + taps[4]) / 16
    return block


def gain_levels(block: np.ndarray, levels: int, power: float, core: float, top: float) -> np.ndarray:
    """A block's details, octave by octave, under a sublinear gain; voxels at 0 and ``top`` say nothing and stay."""
    base = block / top
    sure = (base > 0) & (base < 1)
    value, weight = np.where(sure, base, 0.0), sure.astype(float)
    start, raised = base, np.zeros(block.shape)
    for level in range(levels):
        for _ in range(1 << level):
            value, weight = _binomial(value), _binomial(weight)
        mean = np.where(weight > 1e-6, value / np.maximum(weight, 1e-6), base)
        detail = base - mean
        size = np.abs(detail)
        gained = 0.5 * np.sign(detail) * (size / 0.5) ** power
        if core > 0:
            gained = np.where(size < core, detail * size / (core + 1e-8), gained)
        raised += gained
        base = mean
    return np.where(sure, np.clip(base + raised, 0, 1), start) * top


def gain_pyramid(vox: DataFrame, levels: int, side: int, shape, power: float = 0.7, core: float = 0.0, top: float = 255.0) -> DataFrame:
    """(z, y, x, v): ``gain_levels`` on chunks, with a halo as deep as all octaves' blurs reach: 2 (2^levels - 1) voxels."""
    return on_chunks(vox, lambda b: {"v": gain_levels(b, levels, power, core, top)}, ["v"], side, 2 * ((1 << levels) - 1), shape, mirrored=False)
