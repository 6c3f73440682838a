import hashlib
import re
from collections import Counter

import pytest

from galena.llm.exact_dedup import drop_copies, exact_groups

ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b  c"), (4, None), (5, ""), (6, " \n\t"), (None, "abc"), (None, "solo"),
    (7, "x" * 5000), (8, "x" * 4999 + "y"), (9, "x" * 2500 + " " + "x" * 2500), (10, "é日本😀" * 900), (11, "é日本😀" * 900 + " "),
    (2, "abc"), (12, "ab" * 1024), (13, "ab" * 1024 + "a"), (14, "only"), (1, "other"),
]


def expected(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    size, out = Counter(norm), []
    best = {}
    for (i, t), n in zip(rows, norm):
        key = (-len(t or ""), i is None, i or 0)
        best[n] = min(best.get(n, key), key)
    taken = set()
    for (i, t), n in sorted(zip(rows, norm), key=str):
        kept = (-len(t or ""), i is None, i or 0) == best[n] and n not in taken
        if kept:
            taken.add(n)
        out.append((i, None if best[n][1] else best[n][2], size[n], kept, hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits,block", [(64, 2048), (2, 7), (1, 2048), (64, 1)])
def test_against_brute_force(spark, bits, block):
    rows = [r for r in ROWS if len(r[1] or "") < 100] if block == 1 else ROWS
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, name string, h int")
    got = exact_groups(docs, block_bytes=block, hash_bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(docs).collect() == [] and drop_copies(docs).collect() == []


def test_drop_copies_leaves_one_row_of_each_text(spark):
    docs = spark.createDataFrame([(i, t, "z", 7, n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, _sha string, _len int, row int")
    left = drop_copies(docs)
    assert left.columns == docs.columns and {(r._sha, r._len) for r in left.collect()} == {("z", 7)}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert sorted(norm(r.text) for r in left.collect()) == sorted({norm(t) for _, t in ROWS})


def test_a_row_that_is_repeated_often(spark):
    docs = spark.range(3000).selectExpr("1L doc_id", "'same text' text")
    got = Counter(exact_groups(docs).select("keep_id", "group_size", "kept").collect())
    assert got == {(1, 3000, True): 1, (1, 3000, False): 2999} and drop_copies(docs).count() == 1
