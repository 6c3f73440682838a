"""Registered queries on small tables, against plain Python."""

import math
import random

from galena.operators import stats as S
from galena.plans import REGISTRY


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_statistics_has_every_document(spark, tmp_path):
    texts = ["plain words here", "  naïve\u00a0Straße\u2003größer \n", "日本語 テスト\u3000です", "🙂 ok", "\u2028", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(i, len((t or "").split()), len(t or ""), math.ceil(len(t or "") / 4)) for i, t in enumerate(texts)]
    assert rows(REGISTRY["text_statistics"](spark, str(tmp_path))) == want


def test_bootstrap_ci_takes_every_order(spark, tmp_path):
    prices = {"low": [1000.0 * i for i in range(1, 401)], "one": [70000.0] * 5, "none": [None]}
    spark.createDataFrame([(g, v) for g, of in prices.items() for v in of], "o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    low, none, one = rows(REGISTRY["bootstrap_ci"](spark, str(tmp_path)))
    assert none == ("none", None, None, None, 0) and one == ("one", 70.0, 70.0, 70.0, 5)
    half = 1.96 * math.sqrt((400**2 - 1) / 12 / 400)
    assert low[1] == 200.5 and low[4] == 400 and abs(low[2] - (200.5 - half)) < 2 and abs(low[3] - (200.5 + half)) < 2


def test_bootstrap_is_the_same_in_chunks(spark):
    held = spark.createDataFrame([("g", float(i % 300)) for i in range(3000)] + [(None, float(i)) for i in range(9)], "g string, v double")
    whole, dealt = ({r.g: r for r in S.bootstrap(held, ["g"], "v", chunk=c).collect()} for c in (8192, 2))
    again = {r.g: r for r in S.bootstrap(held.repartition(7), ["g"], "v", chunk=2).collect()}
    half = 1.96 * math.sqrt((300**2 - 1) / 12 / 3000)
    assert again == dealt
    for got in (whole, dealt):
        assert got["g"].n == 3000 and got[None].n == 9 and abs(got["g"]["mean"] - 149.5) < 1e-9
        assert abs(got["g"].hi - 149.5 - half) < 0.5 and abs(149.5 - half - got["g"].lo) < 0.5


def _conversations(spark, path, n):
    spark.createDataFrame([(7 * i + 3, t) for i in range(n) for t in (0, 1)], "conv_id long, turn int").write.parquet(str(path / "conversations.parquet"))
    return [7 * i + 3 for i in range(n)]


def test_seeded_sample_draws_from_all_conversations(spark, tmp_path):
    ids = _conversations(spark, tmp_path, 500)
    drawn = random.Random(42).sample(range(500), 10)
    assert rows(REGISTRY["seeded_sample"](spark, str(tmp_path)).select("draw_pos", "pos", "conv_id")) == [(i, p, ids[p]) for i, p in enumerate(drawn)]


def test_scaffold_expand_schedules_all_conversations(spark, tmp_path):
    ids = _conversations(spark, tmp_path, 500)
    want = [(s, s % 500, s // 8, m, s // 8 / 63, ids[s % 500]) for s in range(504) for m in range(4)]
    want = [(s, p, t, m, round(1 / (1 + math.exp(10 * (x - 0.5))) * (1 - m / 3), 6), c) for s, p, t, m, x, c in want]
    got = rows(REGISTRY["scaffold_expand"](spark, str(tmp_path)))
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want] and max(abs(g[4] - w[4]) for g, w in zip(got, want)) < 2e-6


def test_embedding_queries_see_the_whole_vector(spark, tmp_path):
    vectors = [[math.sin(i * j + 1) for j in range(64)] for i in range(5)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    mass = dict(rows(REGISTRY["array_mass"](spark, str(tmp_path))))
    jsd = dict(rows(REGISTRY["truncated_divergence"](spark, str(tmp_path))))
    for i, v in enumerate(vectors):
        assert abs(mass[i] - sum(map(abs, v))) < 1e-3
        top = sorted((math.exp(x) / sum(map(math.exp, v)) for x in v), reverse=True)[:4]
        p = [x / sum(top) for x in top]
        kl = lambda a: sum(x * math.log(x / ((y + 0.25) / 2)) for x, y in zip(a, p))
        assert abs(jsd[i] - (kl(p) + kl([0.25] * 4)) / 2) < 1e-6
