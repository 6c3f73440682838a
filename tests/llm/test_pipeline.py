"""Each stage of the pipeline on its own input, against plain Python."""

import base64
import hashlib
import os
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from galena.llm import quality as Q
from galena.llm.scratch import Scratch
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_dedup import brute as brute_classes
from tests.llm.test_quality import brute_judge

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages_against_brute_force(spark):
    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(scratch.keep(f"s{i}", stage(spark, tables[-1], DATA)))
    for table in tables[1:5]:
        assert table.columns == docs.columns
    kept = [{r.doc_id: r.text for r in t.select("doc_id", "text").collect()} for t in tables[:5]]
    trust = {}
    for r in labels.collect():
        trust.setdefault(r.doc_id, []).append(r.quality == 1 and r.toxic == 0)
    good = {i for i, own in trust.items() if all(own)}
    hashes = dict(map(tuple, docs.selectExpr("doc_id", "xxhash64(doc_id)").collect()))
    verdicts = brute_judge([(r.doc_id, r.text, r.lang) for r in docs.collect()], good, hashes, Q.QUANTILE, Q.MARGIN, Q.TRAIN_TEXTS)
    assert kept[1].keys() == {int(v[0]) for v in verdicts if v[6]}

    best = {}
    for i, t in kept[1].items():
        n = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[n] = min(best.get(n, (0, 1 << 60)), (-len(t), i))
    assert kept[2].keys() == {i for _, i in best.values()}
    assert kept[3].keys() == {i for (i, _, _, stays), _ in brute_classes(list(kept[2].items())).items() if stays}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert kept[4].keys() == {row[0] for row in brute_hits(list(kept[3].items()), items) if not row[5]}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    true = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = tables[5].collect()
    assert {r.doc_id for r in out} == kept[4].keys()
    for r in out:
        raw = np.array(true.encode_ordinary(kept[4][r.doc_id]), "<u4").tobytes()
        assert bytes(r.ids) == raw and r.decoded_sha256 == hashlib.sha256(kept[4][r.doc_id].encode()).hexdigest()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _sha string, _hit int, row long, node string, keep int"
ODD = [
    (1, "the same words here and there", "en", "a", 5, 1, "s", 2, 3, "n", 9), (1, "the same words here and there", "en", "a", 5, 1, "s", 2, 3, "n", 9),
    (2, "the  same words here and there", "en", "b", 5, 1, "s", 2, 4, "n", 9), (3, None, None, None, None, None, None, None, None, None, None),
    (None, "", "en", "c", 0, 1, "s", 2, 5, "n", 9), (None, None, "de", "c", 0, 1, "s", 2, 6, "n", 9), (4, "another " * 30000, "en", "d", 1, 1, "s", 2, 7, "n", 9),
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages_on_odd_tables(spark):
    """Nulls, repeated rows, a long text and columns with names that operators might use: every column comes through, nothing fails."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    scratch = Scratch(spark, "odd")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(scratch.keep(f"o{i}", stage(spark, tables[-1], DATA)))
    for table in tables[1:5]:
        assert table.columns == docs.columns
        for r in table.collect():
            assert tuple(r) in ODD
    texts = [r.text for r in tables[2].collect()]
    assert sum((t or "").startswith("the") for t in texts) == 1 and sum(not t for t in texts) == 1
    assert tables[5].columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    empty = docs.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = scratch.keep(f"e{i}", stage(spark, empty, DATA))
        assert empty.count() == 0
