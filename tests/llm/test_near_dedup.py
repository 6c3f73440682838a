import random
from collections import Counter

import numpy as np
import pytest

from galena.llm import near_dedup as N
from galena.llm.shingles import multisets, overlap, words_of


def bag(text, k=5):
    w = words_of(text or "")
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1) if w else 0))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def brute(rows, threshold=0.8):
    bags, up = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= threshold:
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = Counter()
    for g in groups.values():
        ids = [rows[i][0] for i in g]
        best = min(ids, key=lambda x: (x is None, x or 0))
        first = True
        for x in sorted(ids, key=lambda x: (x is None, x or 0)):
            out[x, best, len(g), first and x == best] += 1
            first = False
    return out


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


def corpus(seed, n):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([3, 40, 150, 400]))]
        for _ in range(r.choice([1, 1, 2, 6, 30])):
            rows.append(" ".join(edited(r, base, r.choice([0, 0, 1, 2, len(base) // 40, len(base) // 10]))))
    rows += ["a b c d e f g " * 50, "A b c d, e f g " * 50, "a b c d e f g " * 30, "", None, " .. ", "one", "One!", "two"]
    rows = [(i, t) for i, t in enumerate(rows)]
    return rows + [(None, rows[0][1]), (0, rows[0][1]), (None, "lonely words that stand on their own here")]


def test_overlap_is_exact():
    r = random.Random(5)
    for _ in range(30):
        a, b = (" ".join(r.choices("abc", k=r.randint(0, 30))) for _ in range(2))
        sets = [multisets([words_of(t)])[1:] for t in (a, b)]
        assert overlap(*sets) == pytest.approx(similarity(bag(a), bag(b)))


@pytest.mark.parametrize("times", [(1, 1), (3, 1), (7, 20), (64, 5)])
def test_signatures_are_unbiased(times):
    r = np.random.default_rng(7)
    n, size = 60, 128
    common = r.integers(1, 2**63, n, dtype="u8")
    own = r.integers(1, 2**63, n, dtype="u8")
    a = np.sort(np.concatenate([common, own[:10]]))
    b = np.sort(np.concatenate([common, own[10:]]))
    wa, wb = np.where(np.isin(a, common), times[0], 1), np.where(np.isin(b, common), times[1], 1)
    true = n * min(times) / (n * max(times) + 10 + 50)
    seen = []
    for shift in range(40):
        shingles = np.concatenate([a, b]) * np.uint64(2 * shift + 1)
        best = N.signatures(np.repeat([0, 1], [len(a), len(b)]), shingles, np.concatenate([wa, wb]), 2, size)
        assert np.isfinite(best).all()
        seen.append((best[0] == best[1]).mean())
    assert abs(np.mean(seen) - true) < 4 * (true * (1 - true) / (size * 40)) ** 0.5 + 0.002


@pytest.mark.parametrize("seed,small", [(1, 8), (2, 2)])
def test_classes_against_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(N, "SMALL", small)
    rows = corpus(seed, 12)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, row long")
    assert Counter(map(tuple, N.near_classes(docs).collect())) == brute(rows)


def test_crowds_make_few_pairs(spark, monkeypatch):
    """A large group around 0.8 and a family of half-similar texts: right classes, and pairs that grow with the rows."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    near = [" ".join(edited(r, base, r.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8]))) for _ in range(300)]
    passage = [f"p{r.randrange(10**6)}" for _ in range(120)]
    half = [" ".join([*passage, *(f"h{r.randrange(10**6)}" for _ in range(r.randrange(30, 90)))]) for _ in range(200)]
    rows = list(enumerate([*near, *half]))
    made = []
    verify = N._Verifier.verify

    def counted(self, pairs):
        out = verify(self, pairs)
        made.append(out.count())
        return out

    monkeypatch.setattr(N._Verifier, "verify", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, N.near_classes(docs).collect())) == brute(rows)
    assert sum(made) < 10 * len(rows)


def test_empty_and_drop(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b  c d e f", 2), (3, None, 3), (4, "", 4)], "doc_id long, text string, _gone int")
    assert N.near_classes(docs.limit(0)).collect() == []
    left = N.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r._gone for r in left.collect()) == [1, 3, 4]
    assert [r.doc_id for r in N.drop_near_copies(docs.filter("doc_id = 1").union(docs.filter("doc_id = 1"))).collect()] == [1]
