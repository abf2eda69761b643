"""Token ids of whole texts, at one encoding for each distinct chunk.

Byte-level BPE never merges across matches of the pre-token pattern, and a match never spans the border between a
character that is no white space and a white space after it. Cutting there gives chunks, words with the white space
before them, whose ids just follow each other. A worker hashes the chunks of a piece of text in place, asks the
library for those that its bounded cache lacks, and gathers all ids with numpy. A match also ends between an ASCII
letter or digit and an ASCII punctuation mark, so chunks are cut there too.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .grams import IS_SPACE, Piece, byte_hashes, ragged

CACHE_CHUNKS = 500_000
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: The last bytes of white space that is neither space nor tab to carriage return, with those before.
ODD_SPACE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A, 0x80), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80), *((0xE2, 0x80, b) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x1C,), (0x1D,), (0x1E,), (0x1F,))


_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_PUNCT = np.array([33 <= b < 127 for b in range(256)]) & ~_ALNUM


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_spans(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each document's first chunk): spans that tile every document."""
    data, n = piece.data, len(piece.data)
    space = IS_SPACE[data]
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    before = data[at - 1]
    for odd in ODD_SPACE:
        hit = at[before == odd[-1]]
        for back, byte in enumerate(reversed(odd[:-1]), 2):
            hit = hit[(hit >= back) & (data[np.maximum(hit - back, 0)] == byte)]
        cut[hit] = False
    cut[1:] |= _PUNCT[data[1:]] & _ALNUM[data[:-1]]
    inside = piece.offsets[:-1][piece.offsets[:-1] < n]
    cut[inside] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, piece.offsets)


class ChunkCache:
    """Ids of distinct chunks: sorted hashes, offsets and lengths into one array of ids and one of the chunks' bytes.

    A hash only finds a chunk: every span is compared with the chunk's bytes, and one that differs is encoded by itself.
    """

    def __init__(self, encode, kind=np.uint16):
        self.encode, self.kind = encode, kind
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size, self.text_at, self.text_size = (np.zeros(0, np.int64) for _ in range(4))
        self.ids = np.zeros(0, self.kind)
        self.text = np.zeros(0, np.uint8)

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        lists = self.encode([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), self.kind, int(sizes.sum())), sizes

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        ids, sizes = self._encoded(data, starts, ends)
        lengths = ends - starts
        self.at = np.append(self.at, len(self.ids) + np.cumsum(sizes) - sizes)
        self.text_at = np.append(self.text_at, len(self.text) + np.cumsum(lengths) - lengths)
        self.size, self.text_size = np.append(self.size, sizes), np.append(self.text_size, lengths)
        self.ids, self.text = np.append(self.ids, ids), np.append(self.text, data[ragged(starts, lengths)])
        self.keys = np.append(self.keys, keys)
        order = np.argsort(self.keys, kind="stable")
        for name in ("keys", "at", "size", "text_at", "text_size"):
            setattr(self, name, getattr(self, name)[order])

    def ids_of_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of data[start:end] of all spans one after another, number of ids of each span)."""
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        keys = byte_hashes(data, starts, ends)
        distinct, place, back = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, distinct)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == distinct[known]
        if not known.all():
            if len(self.keys) > CACHE_CHUNKS:
                self.clear()
                known[:] = False
            new = place[~known]
            self._learn(data, starts[new], ends[new], distinct[~known])
            slot = np.searchsorted(self.keys, distinct)
        slot = slot[back]
        sizes, at, ids = self.size[slot], self.at[slot], self.ids
        lengths = ends - starts
        other = self.text_size[slot] != lengths
        same = np.flatnonzero(~other)
        unlike = self.text[ragged(self.text_at[slot[same]], lengths[same])] != data[ragged(starts[same], lengths[same])]
        if unlike.any():
            other[same[np.searchsorted(np.cumsum(lengths[same]), np.flatnonzero(unlike), "right")]] = True
        if other.any():
            own, counts = self._encoded(data, starts[other], ends[other])
            at[other], sizes[other] = len(ids) + np.cumsum(counts) - counts, counts
            ids = np.append(ids, own)
        return ids[ragged(at, sizes)], sizes

    def ids_of(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, number of ids of each document)."""
        starts, ends, first = chunk_spans(piece)
        ids, sizes = self.ids_of_spans(piece.data, starts, ends)
        return ids, np.diff(np.append(0, np.cumsum(sizes))[first])


_caches: dict[str, ChunkCache] = {}


def library_cache(path: str) -> ChunkCache:
    """This worker's cache over the tokenizers library and the vocabulary file at ``path``."""
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # the names of special tokens in a text are ordinary text
        kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        _caches[path] = ChunkCache(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], kind)
    return _caches[path]
