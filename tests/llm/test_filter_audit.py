"""Filter interactions against plain Python."""

import random
from collections import Counter
from itertools import permutations

import pytest

from galena.llm.filter_audit import FILTERS, interactions, masks, text_mask

WHITE = " \t\n\x0b\x0c\r"


def _mask(text):
    words = "".join(" " if c in WHITE else c for c in text).split(" ")
    words = [w for w in words if w]
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text)]
    return sum(1 << i for i, bad in enumerate(fails) if bad)


def _brute(docs, labels):
    good, bad = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for doc_id, text, part in docs:
        same = [i for i, t, _ in docs if (t or "") == (text or "") and i is not None]
        mask = _mask(text or "") + 16 * (doc_id is not None and bool(same) and doc_id > min(same))
        rows.append((part or "", mask, doc_id in good, doc_id in bad))
    out = []
    for part in {r[0] for r in rows}:
        own, removed_by, lines = [r for r in rows if r[0] == part], Counter(), []
        for order in permutations(FILTERS):
            before = 0
            for step, name in enumerate(order, 1):
                bit = 1 << FILTERS.index(name)
                gone = [r for r in own if r[1] & bit and not r[1] & before]
                removed_by[name] += len(gone)
                lines.append(["".join(order), step, name, sum(not r[1] & (before | bit) for r in own), len(gone), sum(bool(r[1] & bit and r[1] & before) for r in own), sum(r[1] == bit for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                before |= bit
        out += [(part, *line, removed_by[line[2]]) for line in lines]
    return sorted(out)


def _docs(n=160):
    rng, texts = random.Random(3), []
    words = ["alpha", "Beta", "gamma", "d#lta", "naïve", "日本", " ", "ZETA"] + [f"w{i}" for i in range(90)]
    for _ in range(n):
        texts.append("".join(rng.choice(words[: rng.choice((6, 98))]) + rng.choice(WHITE) for _ in range(rng.choice((0, 3, 49, 50, 51, 90)))))
    texts += [texts[i] for i in range(0, n, 3)] + [None, "", "same"] + ["same"] * 40
    ids = [rng.randrange(10**6) for _ in texts]
    rows = [(i, t, rng.choice(("x", "x", "y", None, ""))) for i, t in zip(ids, texts, strict=True)]
    return rows + rows[5:9] + [(None, "same", "x"), (None, None, None)]


@pytest.mark.parametrize("bits, block", [(64, 1 << 20), (2, 900), (0, 1)])
def test_masks_do_not_depend_on_hash_or_blocks(spark, bits, block):
    docs = _docs()
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    got = sorted(masks(table, hash_bits=bits, block_bytes=block).collect(), key=repr)
    want = []
    for doc_id, text, part in docs:
        same = [i for i, t, _ in docs if (t or "") == (text or "") and i is not None]
        want.append((doc_id, part or "", _mask(text or "") + 16 * (doc_id is not None and bool(same) and doc_id > min(same))))
    assert [tuple(r) for r in got] == sorted(want, key=repr) or sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_interactions_against_brute_force(spark):
    docs = _docs()
    ids = [d[0] for d in docs if d[0] is not None]
    labels = [(i, k % 2, k % 3 == 0) for k, i in enumerate(ids[::2])] + [(ids[0], 1, 1), (None, 1, 1), (ids[1], None, None), (-5, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, quality int, mask int").repartition(3)
    got = sorted(tuple(r) for r in interactions(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())
    assert got == _brute(docs, labels)


def test_texts_at_the_limits():
    assert text_mask(b"") == 1 and text_mask(b" \t\r") == 1
    fifty = [f"w{i}" for i in range(50)]
    assert text_mask(" ".join(fifty).encode()) == 0
    assert text_mask(" ".join(fifty[:32] + ["w"] * 18).encode()) == 0 + 0 * 2  # 33 of 50 are distinct
    assert text_mask(" ".join(fifty[:31] + ["w"] * 19).encode()) == 2
    assert text_mask(("a " * 47 + "AAAAA").encode()) & 4 == 4 and text_mask(("é" * 95 + "AAAAA").encode()) & 4 == 0 and text_mask(("é" * 94 + "AAAAA").encode()) & 4 == 4
    assert text_mask(("x" * 200_000 + "|").encode()) == 1 + 8


def test_string_ids_and_empty_tables(spark):
    rows = [("b", "t", "p"), ("a", "t", "p"), ("c", "u", "p")]
    got = {r.doc_id: r.mask & 16 for r in masks(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()}
    assert got == {"a": 0, "b": 16, "c": 0}
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert interactions(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
