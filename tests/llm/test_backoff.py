import math
import random
import re
from collections import Counter

import pytest

from galena.llm import backoff as B

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, corpus, order, alpha=0.4, own=False):
    """By the definition; ``own``: docs are the corpus, and each is scored by the others."""
    split = lambda t: WORD.findall((t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    counts = sum((grams(split(t)) for _, t in corpus), Counter())
    total = sum(len(split(t)) for _, t in corpus)
    out = []
    for i, t in docs:
        w, s = split(t), 0.0
        left = counts - grams(w) if own else counts
        n_all = max(total - len(w) * own, 1)
        for k in range(len(w)):
            most = min(order, k + 1)
            for n in range(most, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if left[g] or n == 1:
                    s += math.log((left[g] or 0.5) / (left[g[:-1]] if n > 1 else n_all)) + (most - n) * math.log(alpha)
                    break
        out.append((i, len(w), round(s / len(w), 6) if w else None))
    return Counter(out)


def rows(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, 3, i]), r.choice([None, "", " ".join(r.choices(["a", "B", "c,", "é", "dog", f"w{i}"], k=r.randint(1, 40)))])) for i in range(n)] + [(9, "a a " * 3000)]


def got(df):
    return Counter((r.doc_id, r.n_words, None if r.score is None else round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("order,shards,batch", [(1, 1, 10**6), (2, 5, 900), (3, 3, 400), (3, 2, 1)])
def test_corpus_scores(spark, monkeypatch, order, shards, batch):
    monkeypatch.setattr(B, "BATCH_CHARS", batch)
    data = rows(order, 60)
    docs = spark.createDataFrame([(*x, "k", 1) for x in data], "doc_id long, text string, key string, words int")
    assert got(B.corpus_scores(docs, order, shards=shards)) == brute(data, data, order, own=True)


def test_backing_off(spark):
    data = [(1, "a b c d"), (2, "a b c e"), (3, "x b c"), (4, "zz")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    score = {r.doc_id: r.score for r in B.corpus_scores(docs).collect()}
    # 3 of 12 words: x is in no other text, "x b" neither, "x b c" neither but "b c" twice after two b.
    assert score[3] == pytest.approx((math.log(0.5 / 9) + math.log(0.4 * 2 / 9) + math.log(0.4 * 2 / 2)) / 3)
    assert score[4] == pytest.approx(math.log(0.5 / 11))
    assert B.corpus_scores(docs.limit(1)).count() == 1


def test_other_corpus_and_empty(spark):
    data, known = rows(7, 25), rows(8, 25)
    docs, corpus = (spark.createDataFrame(x, "doc_id long, text string") for x in (data, known))
    assert got(B.backoff_scores(docs, corpus, 3)) == brute(data, known, 3)
    assert got(B.backoff_scores(docs, corpus.limit(0), 2)) == brute(data, [], 2)
    assert B.corpus_scores(docs.limit(0)).collect() == [] and B.backoff_scores(docs.limit(0), corpus).collect() == []
