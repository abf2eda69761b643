"""Wiener deconvolution and the gain pyramid against whole-volume numpy."""

import numpy as np
import pandas as pd
import pytest

from laminae.operators import dense

SHAPE = (20, 26, 23)
KEY = ["z", "y", "x"]


def table(spark, block):
    at = np.indices(block.shape).reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame(dict(zip(KEY, at, strict=True)) | {"v": block.reshape(-1)}))


def back(df, shape):
    out, p = np.full(shape, np.nan), df.toPandas()
    out[p.z, p.y, p.x] = p.v
    return out


def smooth(seed=1):
    noise = np.random.default_rng(seed).random(SHAPE)
    return dense.blur(noise, 0.8) * 100


@pytest.mark.parametrize("side", [8, 13])
def test_wiener_equals_the_whole_transform(spark, side):
    block = smooth()
    wide = np.pad(block, 30, mode="symmetric")
    h = dense.gaussian_response(wide.shape, 0.8)
    want = np.fft.irfftn(np.fft.rfftn(wide) * h / (h * h + 0.05), wide.shape, axes=(0, 1, 2))[tuple(slice(30, -30) for _ in range(3))]
    got = back(dense.wiener(table(spark, block), 0.8, side, 8, SHAPE, 0.05), SHAPE)
    assert np.abs(got - want).max() < 0.005 * np.ptp(want)


def test_a_blur_is_taken_back(spark):
    sharp = smooth(3)
    blurred = back(dense.point_spread(table(spark, sharp), 0.8, 16, 8, SHAPE), SHAPE)
    again = back(dense.wiener(table(spark, blurred), 0.8, 16, 8, SHAPE, 0.001), SHAPE)
    assert np.abs(again - sharp).mean() < 0.35 * np.abs(blurred - sharp).mean()


@pytest.mark.parametrize("side", [7, 32])
def test_gain_does_not_depend_on_chunks(spark, side):
    block = np.clip(smooth(2) * 4 - 120, 0, 255)
    got = back(dense.gain_pyramid(table(spark, block), 3, side, SHAPE, core=0.02), SHAPE)
    assert np.allclose(got, dense.gain_levels(block, 3, 0.7, 0.02, 255.0))


def test_identity_gain_gives_the_volume_back():
    block = np.clip(smooth(2) * 4 - 120, 0, 255)
    assert np.allclose(dense.gain_levels(block, 4, 1.0, 0.0, 255.0), block)
    assert (dense.gain_levels(block, 2, 0.5, 0.0, 255.0)[block == 0] == 0).all()
