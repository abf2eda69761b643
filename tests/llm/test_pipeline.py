import zlib

import brute
import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from laminae.llm import langid, packing
from laminae.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"


def test_rows_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clear = {r.doc_id for r in langid.identify(docs, docs.filter(~langid.held_out())).collect() if not r.ambiguous}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in clear}
    last = {t: max(d for d, x in rows.items() if x == t) for t in set(rows.values())}
    rows = {d: t for d, t in rows.items() if last[t] == d}
    near = brute.near(rows.items(), 5, 80)
    rows = {d: t for d, t in rows.items() if near[d][1] == d}
    cut = brute.kept_texts(rows.items())
    rows = {d: cut[d] if cut[d] is not None else t for d, t in rows.items() if cut[d] != ""}
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    want = {}
    for d, t in rows.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    out = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    assert len(out) == len(want)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 60)
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in np.concatenate([rng.integers(1, 1024, 500), rng.integers(1, 90, 300), [512, 512, 1, 1023, 1024]])]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long").repartition(4)
    rows = packing.best_fit(items, 1024).collect()
    assert sorted(r.uid for r in rows) == list(range(len(sizes)))
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append((r.offset, sizes[r.uid]))
    for placed in bins.values():
        at = 0
        for offset, size in sorted(placed):
            assert offset == at
            at += size
        assert at <= 1024
    assert len(bins) <= 1.03 * -(-sum(sizes) // 1024) + 1
