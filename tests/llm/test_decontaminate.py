import hashlib
import random
import re
from collections import Counter

import pytest

from galena.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, t in items:
            v = words(t)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                p = v[k : k + window]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def tables(spark, seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "c9", "é", "日本", "D", "e", "f"]
    line = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "\n", ", ", "--"]) for _ in range(n))
    items = [(r.choice([None, 7, i, i]), r.choice([line(r.randint(1, 25)), line(r.randint(1, 25)), "", None, "..."])) for i in range(25)]
    docs = [(r.choice([None, 3, i]), "".join(r.choice([line(r.randint(0, 12)), r.choice(items)[1] or "", "x "]) for _ in range(r.randint(0, 9)))) for i in range(60)]
    docs += [(1, None), (2, ""), docs[0]]
    return docs, items, spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed,block,shard", [(1, 10**6, 1 << 22), (2, 30, 200)])
def test_against_brute_force(spark, monkeypatch, seed, block, shard):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    docs, items, d, b = tables(spark, seed)
    assert Counter(map(tuple, D.contamination(d, b).collect())) == brute(docs, items)


def test_empty_tables_and_clean(spark):
    d = spark.createDataFrame([(1, "one two", 1), (2, "three", 2), (None, None, 3)], "doc_id long, text string, _hit int")
    b = spark.createDataFrame([(1, "Two")], "item_id long, text string")
    assert D.contamination(d.limit(0), b).collect() == []
    assert [r.contaminated for r in D.contamination(d, b.limit(0)).collect()] == [False] * 3
    assert sorted(D.clean(d, b).collect(), key=str) == sorted(d.filter("doc_id is null or doc_id = 2").collect(), key=str)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x a q b r c y"), (2, "a b"), (3, "c"), (4, "a b c"), (5, "b a c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in D.matches(d, b, slop=2).collect()}
    assert got == {1: [(1, 6)], 2: [], 3: [], 4: [(0, 3)], 5: []}


def test_index_of_all_words(spark):
    d = spark.createDataFrame([(1, "A b a"), (2, None)], "doc_id long, text string")
    got = {r.word: r.n for r in D.build_index(d).collect()}
    assert got == {None: None, "a": 2, "b": 1}


def test_many_blocks_have_one_index(spark, monkeypatch):
    built = []
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    monkeypatch.setattr(D, "build_index", lambda *a, f=D.build_index: built.append(a[1]) or f(*a))
    docs, items, d, b = tables(spark, 3)
    assert Counter(map(tuple, D.contamination(d, b).collect())) == brute(docs, items)
    assert built == [None]
    monkeypatch.setattr(D, "BLOCK_WORDS", 10**6)
    D.contamination(d, b).collect()
    assert len(built) == 2 and built[1]


def test_released_runs_leave_nothing(spark):
    from galena.llm.scratch import Scratch, release

    scratch = Scratch(spark, "gone")
    kept = scratch.keep("t", spark.range(3))
    assert kept.count() == 3 and release(spark) >= 1
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and release(spark) == 0
