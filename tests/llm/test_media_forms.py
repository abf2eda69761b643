"""Forms of stored media: every text gets the transforms that shorten it, and both decoders read them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from laminae.llm import webp

DRAW = random.Random(6)
WORDS = ["".join(DRAW.choices("abcdefghijklmnopqrstuvwxyz", k=DRAW.randint(2, 9))) for _ in range(3000)]


def wave(n):
    at, out = 64, []
    for _ in range(n):
        at = min(max(at + DRAW.randint(-1, 1), 33), 126)
        out.append(chr(at))
    return "".join(out)


TEXTS = {
    "digits": "".join(DRAW.choices("0123456789", k=6000)),
    "bits": "".join(DRAW.choices("01", k=6000)),
    "wave": wave(60_000),
    "rows": "\n".join(["".join(chr(33 + (7 * k * k + n) % 90) for k in range(575)) for n in range(80)]),
    "passage": " ".join(WORDS[:300] * 2),
    "words": " ".join(DRAW.choices(WORDS, k=2000)),
    "none": "",
}


def form(data):
    return [t[0] for t in webp._header(webp._chunks(data)[b"VP8L"])[4]]


def media(texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    return [r["media"] for out in webp._store([batch]) for r in out.to_pylist()]


def test_transforms_are_chosen_by_content():
    files = dict(zip(TEXTS, media(list(TEXTS.values())), strict=True))
    forms = {name: form(data) for name, data in files.items()}
    assert forms["digits"] == forms["bits"] == [webp.PALETTE]
    assert forms["wave"] == [webp.SUBTRACT_GREEN, webp.PREDICTOR]
    assert forms["words"] == [webp.SUBTRACT_GREEN]
    # the second half of a passage is one reference to the first
    half = media([" ".join(WORDS[:300])])[0]
    assert len(files["passage"]) < len(half) + 60
    assert len(files["wave"]) < 0.4 * len(TEXTS["wave"]) and len(files["bits"]) < 0.15 * len(TEXTS["bits"])


@pytest.mark.parametrize("together", [1, 1000])
def test_both_decoders_read_every_form(monkeypatch, together):
    monkeypatch.setattr(webp, "TOGETHER", together)
    payloads = [webp.padded(t.encode()) for t in TEXTS.values()]
    files = media(list(TEXTS.values()))
    for want, data, got in zip(payloads, files, webp.decode_grey(files), strict=True):
        assert (got == want).all()
        assert (webp.decode(data) == np.stack([want, want, want, np.full_like(want, 255)], -1).reshape(*webp.decode(data).shape)).all()


def test_predictors_are_undone_in_mixed_blocks():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (13, 19, 4)).astype(np.uint8)
    image[..., 0] = image[..., 2] = image[..., 1]
    image[..., 3] = 255
    modes = rng.integers(0, 5, 20).tolist()
    data = webp.encode(image, modes=modes)
    reader, _, _, _, transforms = webp._header(webp._chunks(data)[b"VP8L"])
    bits, own = transforms[0][2]
    assert (webp.decode(data) == image).all()
    grey = image[..., 1]
    residuals = np.array(webp._read_image(reader, 19, 13, True), np.uint32).reshape(13, 19) >> 8 & 255
    assert (webp._unpredicted(residuals.astype(np.uint8), (np.array(own) >> 8) & 15, bits) == grey).all()


def test_stretches_make_one_stream(monkeypatch):
    monkeypatch.setattr(webp, "STRETCH", 1000)
    for text in TEXTS.values():
        samples = webp.padded(text.encode())
        assert (webp.decode_grey([webp.encode_grey(samples)])[0] == samples).all()
