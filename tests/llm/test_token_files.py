import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from galena.llm import token_files as T
from galena.llm.scratch import Scratch

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def true(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library_on_whole_texts():
    encoder, r = T.Encoder(PATH, P.PATTERN), random.Random(3)
    encoder.spaced.limit = encoder.pieces.limit = 200
    texts = ["".join(r.choices([" ", " ", "\n", "\t", "a", "the", "é", "日本", "😀", ".", "'s", "12", "<|endoftext|>", "\xa0", "x" * 60], k=r.randint(0, 60))) for _ in range(400)]
    assert true("<|endoftext|>") == [50256]
    for text in [*texts, "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\nx", "<|endoftext", " <|endoftext|>"]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == true(text), text
    assert encoder.encode_many(texts) == [np.array(true(t), "<u2").tobytes() for t in texts]


@pytest.mark.parametrize("n", [0, 3, 300])
def test_round_trip(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, 5, i, -i]), r.choice([None, "", "a b", "x <|endoftext|>y", " ".join(r.choices(["some", "words", "é!"], k=r.randint(1, 900)))]), "x") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    path = Scratch(spark, "t").root
    T.write_token_files(docs, path, PATH, P.PATTERN)
    got = T.read_token_files(spark, path).orderBy("start").collect()
    key = lambda i: (i is not None, i or 0)
    assert [g.doc_id for g in got] == sorted((i for i, _, _ in rows), key=key)
    start, want = 0, {}
    for i, t, _ in rows:
        want.setdefault(i, []).append([*true(t or ""), 0])
    for g in got:
        assert g.start == start and list(g.ids) in want[g.doc_id] and g.n_tokens == len(g.ids)
        assert g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes())
        want[g.doc_id].remove(list(g.ids))
        start += g.n_tokens
    assert not any(want.values())
    if n == 300:
        shared = T.read_dictionary(spark, path)
        images = [(bytes(x.image), shared) for x in spark.read.parquet(f"{path}/images").collect()]
        some = next(g for g in got if g.doc_id not in (None, 5))
        assert T.read_document(images, some.doc_id) is not None and T.read_document(images, 10**9) is None
        with pytest.raises(ValueError):
            T.Image(images[0][0], b"other")


def test_dictionary_of_few_texts_that_repeat(spark):
    """Trained although nearly all rows are copies; whole id arrays, not their beginnings."""
    r = random.Random(2)
    texts = [" ".join(r.choices(["some", "words", "of", "text", "é!", "tokens"], k=400)) for _ in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(3000)], "doc_id long, text string")
    dictionary, trained = T.train_dictionary(docs, PATH, P.PATTERN)
    assert trained and len(dictionary) > 200
    tiny, trained = T.train_dictionary(docs.limit(0), PATH, P.PATTERN)
    assert (tiny, trained) == (bytes(8), False)
    path = Scratch(spark, "t").root
    T.write_token_files(docs.filter("doc_id = 1").selectExpr("doc_id", "'ab' text"), path, PATH, P.PATTERN)
    assert not spark.read.parquet(f"{path}/dictionary").first().trained and T.read_token_files(spark, path).first().n_tokens == 2
