"""What storing and reading media costs in calls, and that the bytes do not depend on it."""

import hashlib
import random

import numpy as np
import pytest

from laminae.llm import webp

DRAW = random.Random(12)
WORDS = ["".join(DRAW.choices("abcdefghijklmnopqrstuvwxyz", k=DRAW.randint(2, 9))) for _ in range(500)]
TEXTS = [" ".join(DRAW.choices(WORDS, k=n)) for n in (1, 30, 300, 3000)] + ["".join(DRAW.choices("01", k=3000)), "", "ab" * 9000]
PAYLOADS = [webp.padded(t.encode()) for t in TEXTS]


def test_files_are_those_of_the_first_writer():
    files = [webp.encode_grey(p) for p in PAYLOADS]
    assert hashlib.sha256(b"".join(files)).hexdigest() == "a615ade1020551e89bb3b02d20fe1a6ddc3c41435bd4b9043f21bf8f29482821"


def test_code_lengths_are_read_without_a_call_a_bit(monkeypatch):
    files = [webp.encode_grey(p) for p in PAYLOADS]
    calls = 0
    peek = webp.BitReader.peek

    def counted(self, n):
        nonlocal calls
        calls += 1
        return peek(self, n)

    monkeypatch.setattr(webp.BitReader, "peek", counted)
    got = webp.decode_grey(files)
    assert all((a == b).all() for a, b in zip(got, PAYLOADS, strict=True))
    assert calls < 80 * len(files)


@pytest.mark.parametrize("limit", [5, 7, 9, 15])
def test_codes_are_complete_and_read_back(limit):
    for size in (2, 3, 19, 30):
        counts = [DRAW.choice((0, 1, 2, 3, 50, 10_000)) for _ in range(size)]
        counts[0] = counts[-1] = 1
        lengths = webp.code_lengths(counts, limit)
        assert sum(2.0**-n for n in lengths if n) == 1 and max(lengths) <= limit
        assert [n > 0 for n in lengths] == [c > 0 for c in counts]
    # the lengths of a whole code survive the stream at any bit position
    for lead in range(8):
        lengths = webp.code_lengths(DRAW.choices((0, 0, 0, 1, 7, 300), k=280), 9)
        out = webp.BitWriter()
        out.write(0, lead)
        webp.write_prefix_code(out, lengths)
        out.write(5, 3)
        reader = webp.BitReader(out.value.to_bytes(out.bits // 8 + 1, "little"), lead)
        assert webp.read_prefix_code(reader, 280) == lengths and reader.read(3) == 5


def test_far_references_are_read_alone_and_together(monkeypatch):
    own = np.frombuffer(random.Random(2).randbytes(60_000), np.uint8) % 90
    samples = np.concatenate([own, own[:25_000], own[100:40_000], np.zeros(700, np.uint8)])
    samples = samples[: len(samples) // webp.ROW * webp.ROW]
    data = webp.encode_grey(samples)
    for together in (1, 1000):
        monkeypatch.setattr(webp, "TOGETHER", together)
        assert (webp.decode_grey([data])[0] == samples).all()
