import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from galena.llm import quality as Q
from galena.llm.scratch import Scratch


class Brute:
    """Interpolated modified Kneser-Ney, straight from its definition."""

    def __init__(self, texts):
        self.c = [Counter(), Counter(), Counter()]
        for t in texts:
            w = ["<", "<", *t, ">"]
            self.c[2].update(zip(w, w[1:], w[2:]))
        for i in (1, 0):
            self.c[i] = Counter(g[1:] for g in self.c[i + 1])
        self.d, self.next = [], []
        for counts in self.c:
            self.d.append(Q.discounts(Counter(counts.values())))
            after = defaultdict(list)
            for g, n in counts.items():
                after[g[:-1]].append(n)
            self.next.append(after)

    def p(self, gram):
        order = len(gram) - 1
        lower = self.p(gram[1:]) if order else 1 / (len(self.c[0]) + 1)
        held = self.next[order].get(gram[:-1])
        if not held:
            return lower
        d = self.d[order]
        cut = lambda n: d[min(n, 3) - 1]
        n = self.c[order].get(gram, 0)
        return ((n - cut(n)) if n else 0) / sum(held) + sum(map(cut, held)) / sum(held) * lower

    def nats(self, t):
        w = ["<", "<", *t, ">"]
        return -sum(math.log(self.p(g)) for g in zip(w, w[1:], w[2:]))


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choices("the a of cat dog sat ran far home é".split(), [9, 8, 7, 5, 4, 3, 2, 2, 1, 1], k=r.randint(0, 25))) for _ in range(n)]


def brute_judge(rows, good, hashes, quantile, margin, n_texts):
    """judge() in plain Python: (doc_id as text, lang, words, perplexity, adjusted, threshold, keep), sorted."""
    chosen = set(sorted((i for i in good if hashes[i] % 2 == 1), key=lambda i: (hashes[i], i))[:n_texts])
    split = lambda t: [w.decode() for w in Q.tokens_of(t or "")]
    brute = Brute([split(t) for i, t, _ in rows if i in chosen])
    scored = [(i, g or "", brute.nats(split(t)), len(split(t)) + 1) for i, t, g in rows]
    held = [x for x in scored if x[0] in good - chosen]
    of = lambda g: own if len(own := [x for x in held if x[1] == g]) >= Q.LEAST else held
    mean = {g: sum(x[2] / x[3] for x in of(g)) / len(of(g)) for g in {x[1] for x in scored}}
    adjusted = lambda x: (x[2] + Q.PRIOR * mean[x[1]]) / (x[3] + Q.PRIOR)
    limit = {}
    for g in mean:
        cells = sorted(math.floor(adjusted(x) * Q.CELLS) for x in of(g))
        limit[g] = (cells[math.ceil(len(cells) * quantile) - 1] + 1) / Q.CELLS + margin
    return sorted((str(x[0]), x[1], x[3], round(math.exp(x[2] / x[3]), 2), round(math.exp(adjusted(x)), 2), round(math.exp(limit[x[1]]), 2), adjusted(x) <= limit[x[1]]) for x in scored)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, t, g in rows], "doc_id long, text string, lang string")


def nats(spark, model, new, shards):
    got = Q.perplexities(frame(spark, [(i, t, "") for i, t in enumerate(new)]), model, shards).collect()
    got = sorted(got, key=lambda r: r.doc_id)
    return [r.nats for r in got], [r.n_words for r in got]


@pytest.mark.parametrize("batch,shards", [(4 << 20, 1), (90, 3)])
def test_model_against_the_definition(spark, monkeypatch, batch, shards):
    monkeypatch.setattr(Q, "BATCH_CHARS", batch)
    known, new = texts(1, 80), [*texts(2, 20), "", "never seen words", "the the the", None]
    model = Q.train(spark.createDataFrame([(t,) for t in known], "text string"), Scratch(spark, "kn"))
    brute = Brute([t.split() for t in known])
    got, words = nats(spark, model, new, shards)
    assert words == [len((t or "").split()) + 1 for t in new]
    assert got == pytest.approx([brute.nats((t or "").split()) for t in new], rel=1e-4)
    total = sum(brute.p(("the", "a", w)) for w in [*(g[0] for g in brute.c[0]), "?"])
    assert total == pytest.approx(1)


def test_without_training_text(spark):
    model = Q.train(spark.createDataFrame([], "text string"), Scratch(spark, "kn"))
    got, _ = nats(spark, model, ["a b", ""], 2)
    assert got == pytest.approx([Brute([]).nats(["a", "b"]), Brute([]).nats([])])


def test_whole_output_against_brute_force(spark):
    """Sample, model, means, thresholds and verdicts once more in plain Python."""
    r = random.Random(11)
    odd = [" ".join(r.choices("qq zz the xx of yy".split(), k=r.randint(1, 40))) for _ in range(60)]
    rows = [(i, t, r.choice(["en", "en", "en", "de", "fr"][: 5 if i % 9 == 0 else 4])) for i, t in enumerate([*texts(8, 400), *odd, "", None])]
    rows += [rows[3], (4, "dog dog", "en"), (None, "the cat", None)]
    docs = spark.createDataFrame([(*x, 1.0, "k") for x in rows], "doc_id long, text string, lang string, rate double, adjusted string")
    trust = {i: i < 400 and i % 7 > 0 for i in range(0, 455)}
    labels = spark.createDataFrame([(i, int(q), 0) for i, q in trust.items()] + [(9, 0, 0), (10, 1, 1), (11, None, 0)], "doc_id long, quality int, toxic int")
    good = {i for i, q in trust.items() if q} - {9, 10, 11}
    hashes = dict(map(tuple, docs.select("doc_id").distinct().selectExpr("doc_id", "xxhash64(doc_id)").collect()))
    want = brute_judge(rows, good, hashes, 0.9, 0.01, 100)
    got = Q.judge(docs, labels, quantile=0.9, margin=0.01, texts=100).collect()
    got = sorted((str(x.doc_id), x.lang, x.n_words, round(x.perplexity, 2), round(x.adjusted, 2), round(x.threshold, 2), x.keep) for x in got)
    assert len(got) == len(want) and [x[:3] + x[6:] for x in got] == [x[:3] + x[6:] for x in want]
    for x, y in zip(got, want):
        assert x[3:6] == pytest.approx(y[3:6], abs=0.02)
    assert 0 < sum(not x[6] for x in got) < len(got) / 2
    assert all(x.keep == (x.adjusted <= x.threshold) for x in Q.judge(docs, labels).collect())


def test_held_out_accuracy_and_edges(spark):
    good, r = texts(3, 600), random.Random(4)
    bad = [" ".join(f"{w.upper()}!!" for w in t.split()) + " ## !! ##" for t in texts(5, 60)]
    rows = [(i, t, r.choice(["en", "de"]), "x") for i, t in enumerate([*good, *bad])] + [(None, None, None, "x"), (0, "", "en", "x"), (5000, "the cat " * 9000, "fr", "x")]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, lang string, keep string, _bad int")
    labels = spark.createDataFrame([(i, int(i < 600), 0) for i in range(0, 660, 1)] + [(None, 1, 0), (7, None, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.judge(docs, labels).collect()
    assert len(got) == len(rows) and {x.lang for x in got} == {"en", "de", "fr", ""}
    kept = {x.doc_id: x.keep for x in got if x.doc_id not in (None, 0)}
    assert sum(kept[i] for i in range(1, 600)) > 590
    assert sum(kept[i] for i in range(600, 660) if len(bad[i - 600]) > 90) <= 1
    left = Q.keep_good(docs, labels)
    assert left.columns == docs.columns and left.filter("doc_id >= 600 and doc_id < 660").count() < 30
    assert all(x.keep for x in Q.judge(docs.limit(9), labels.limit(0)).collect())
    assert Q.judge(docs.limit(0), labels).collect() == []


def test_model_takes_every_trusted_text_of_its_half(spark, monkeypatch):
    rows = [(i, f"word{i}", "en") for i in range(3400)]
    odd = spark.range(3400).selectExpr("id", "pmod(xxhash64(id), 2) = 1 as odd").filter("odd").count()
    assert odd > 1500
    seen, own = [], Q.train
    monkeypatch.setattr(Q, "train", lambda trusted, scratch: seen.append(trusted.count()) or own(trusted, scratch))
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    assert Q.judge(frame(spark, rows), labels).count() == 3400 and seen == [odd]


def test_counts_take_a_few_bytes_an_ngram(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    known, scratch = [" ".join(r.choices(words, k=500)) for _ in range(300)], Scratch(spark, "kn")
    Q.train(spark.createDataFrame([(t,) for t in known], "text string"), scratch)
    size = sum(x.stat().st_size for x in Path(scratch.root.removeprefix("file://")).rglob("*.parquet"))
    assert 0 < size < 15 * 300 * 500


def test_parts_and_shards_change_nothing(spark, monkeypatch):
    rows = [(i, t, "en") for i, t in enumerate(texts(13, 150))] + [(None, "the cat", None), (3, "zz", "de")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    values = lambda: sorted((str(x.doc_id), x.n_words, x.perplexity, x.adjusted, x.threshold, x.keep) for x in Q.judge(frame(spark, rows), labels).collect())
    want = values()
    monkeypatch.setattr(Q, "SHARD_BYTES", 2000)
    monkeypatch.setattr(Q, "TRAIN_BYTES", 1000)
    got = values()
    assert len(got) == len(rows) and all(x[2:5] == pytest.approx(y[2:5]) and x[:2] + x[5:] == y[:2] + y[5:] for x, y in zip(got, want))


def test_scoring_reads_the_model_where_it_lies(spark):
    """Shuffled for each part of the documents, the model would be on disk twice."""
    known, new = texts(14, 60), texts(15, 12)
    model = Q.keyed(Q.train(spark.createDataFrame([(t,) for t in known], "text string"), Scratch(spark, "kn")), 5, Scratch(spark, "dealt"))
    scored = Q.perplexities(frame(spark, [(i, t, "") for i, t in enumerate(new)]), model)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(shard") == 1 and plan.count("Exchange hashpartitioning(batch") > 1
    brute = Brute([t.split() for t in known])
    assert [r.nats for r in sorted(scored.collect(), key=lambda r: r.doc_id)] == pytest.approx([brute.nats(t.split()) for t in new], rel=1e-4)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt")]


def test_parts_have_equal_shares_of_what_the_model_knows(spark, monkeypatch):
    rows = [(i, t, "en") for i, t in enumerate(texts(16, 600))]
    odd = {r.id for r in spark.range(600).filter("pmod(xxhash64(id), 2) = 1").collect()}
    seen, own = [], Q.perplexities
    monkeypatch.setattr(Q, "SHARD_BYTES", 2000)
    monkeypatch.setattr(Q, "perplexities", lambda docs, model: seen.append([r.doc_id for r in docs.select("doc_id").collect()]) or own(docs, model))
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    assert Q.judge(frame(spark, rows), labels).count() == 600
    assert len(seen) > 3 and sorted(i for part in seen for i in part) == list(range(600))
    assert all(0.5 < sum(i in odd for i in part) * len(seen) / len(odd) < 2 for part in seen)
