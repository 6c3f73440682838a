import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from galena.llm import suffixes as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans(hit):
    out, at = [], None
    for i in sorted(hit):
        if at is None or i != at:
            out.append([i, i])
        out[-1][1] = at = i + 1
    return tuple(map(tuple, out))


def brute(rows, passage):
    words = [WORD.findall((t or "").lower()) for _, t in rows]
    seen = defaultdict(set)
    for d, w in enumerate(words):
        for i in range(len(w) - passage + 1):
            seen[tuple(w[i : i + passage])].add(d)
    out = Counter()
    for d, (doc_id, _) in enumerate(rows):
        hit = {j for i in range(len(words[d]) - passage + 1) if len(seen[tuple(words[d][i : i + passage])]) > 1 for j in range(i, i + passage)}
        out[doc_id, len(words[d]), len(hit), spans(hit)] += 1
    return out


def corpus(seed, passage):
    r = random.Random(seed)
    text = lambda n, v=10**6: [f"w{r.randrange(v)}" for _ in range(n)]
    shared = [text(r.randint(passage - 1, 3 * passage)) for _ in range(5)] + [["the"] * passage * 2]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts += r.choice([text(r.randint(0, 30)), s, s[a:], s[: len(s) - a], text(40, 3)])
        rows.append((r.choice([None, 5, i]), ", ".join(parts)))
    return rows + [(1, None), (2, ""), rows[0], (9, " ".join(text(20000)))]


@pytest.mark.parametrize("seed,passage,k,shard,bits", [(1, 50, 8, 60_000, 1 << 27), (2, 12, 3, 40, 1 << 27), (3, 12, 4, 40, 1 << 15), (4, 12, 3, 3, 1 << 27)])
def test_against_brute_force(spark, monkeypatch, seed, passage, k, shard, bits):
    monkeypatch.setattr(S, "SHARD_SUFFIXES", shard)
    monkeypatch.setattr(S, "BITMAP_BITS", bits)
    monkeypatch.setattr(S, "BATCH_CHARS", 3000)
    rows = corpus(seed, passage)
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, key string")
    got = S.repeated_passages(docs, passage, k).collect()
    assert Counter((r.doc_id, r.n_words, r.n_repeated, tuple((s.start, s.end) for s in r.repeated)) for r in got) == brute(rows, passage)
    assert all(r.n_extra <= r.n_repeated for r in got) and 0 < sum(r.n_extra for r in got) < sum(r.n_repeated for r in got)


def test_every_passage_has_a_minimiser():
    words = np.random.default_rng(1).integers(0, 2**63, 3000, dtype="u8")
    at, _ = S.minimisers(words, 50, 8)
    assert np.diff(np.concatenate([[-1], at, [3000 - 7]])).max() <= 43 and len(at) < 300


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeated_passages(docs).collect() == []


def test_removal_leaves_one_copy_of_each_passage(spark):
    rows = corpus(5, 12)
    docs = spark.createDataFrame([(*x, "k", n) for n, x in enumerate(rows)], "doc_id long, text string, key string, row int")
    left = S.drop_repeats(docs, 12, 4)
    assert left.columns == docs.columns
    after = sorted(left.collect(), key=lambda r: r.row)
    assert [r.doc_id for r in after] == [i for i, _ in rows] and [r.text is None for r in after] == [t is None for _, t in rows]
    grams = lambda texts: [{tuple(w[i : i + 12]) for i in range(len(w) - 11)} for w in (WORD.findall((t or "").lower()) for t in texts)]
    before, now = grams([t for _, t in rows]), grams([r.text for r in after])
    old, new = (Counter(g for d in texts for g in d) for texts in (before, now))
    repeated = {g for g, n in old.items() if n > 1}
    assert repeated <= set(new)
    # A later copy stays where its words belong to the first copies of others that overlap it.
    assert sum(new[g] - 1 for g in repeated) < 0.1 * sum(old[g] - 1 for g in repeated)


def test_a_start_that_all_texts_share(spark, monkeypatch):
    """No shard gets more suffixes of one start than it is to hold, and all are found."""
    monkeypatch.setattr(S, "SHARD_SUFFIXES", 50)
    monkeypatch.setattr(S, "BATCH_CHARS", 4000)
    most = []
    r = random.Random(3)
    hot = [f"h{i}" for i in range(14)]
    rows = [(i, " ".join([*(f"w{r.randrange(10**6)}" for _ in range(r.randrange(20))), *hot, *(f"v{r.randrange(10**6)}" for _ in range(20))])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    suffixes = S._suffixes

    def counted(*x):
        out = suffixes(*x)
        most.append(out.filter("batch is null and data is not null").groupBy("shard").sum("n").agg({"sum(n)": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(S, "_suffixes", counted)
    got = S.repeated_passages(docs, 12, 3).collect()
    assert Counter((x.doc_id, x.n_words, x.n_repeated, tuple((s.start, s.end) for s in x.repeated)) for x in got) == brute(rows, 12)
    assert most[0] < 300 and sum(len(x.own) > 0 for x in got) == 1 and sum(len(x.extra) > 0 for x in got) == 299
    # Two texts of one line, over and over.
    rows = [(1, "buy now " * 4000), (2, "buy now " * 3000), (3, "something else")]
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 12, 3).collect()
    assert {x.doc_id: x.n_repeated for x in got} == {1: 8000, 2: 6000, 3: 0} and most[1] < 100


def test_cutting():
    assert S.without_spans("One, two -- three. Four", [(1, 3)]) == "One, Four"
    assert S._rest([(0, 10), (20, 30)], [(2, 4), (8, 22), (40, 50)]) == [(0, 2), (4, 8), (22, 30)] and S._rest([(1, 2)], [(0, 3)]) == []
    assert S.without_spans("a b c", [(0, 1), (2, 3)]) == "b " and S.without_spans("\u0130x y z", [(1, 2)]) == "\u0130x z"
