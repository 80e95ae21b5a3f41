import random

import numpy as np
import pyarrow as pa

from chainloom.llm import encode as E

SIGNS = ["a", "the ", "  ", "\n", "\t", "'s", "'", "don't", "é", "e\u0301", "日本", "ｆ", "\u00a0", "\u3000", "😀", "12", "-", "_", "<|endoftext|>", "\u200b", "É", ".", "...", "(x)", "Straße"]


def encoder():
    return E._encoder(E.tokenizer_dir(), E.VOCABULARY)


def test_cut_fragments_give_the_ids_of_the_whole_text():
    enc, rng = encoder(), random.Random(2)
    texts = ["", None, "x", " "] + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(400)]
    array = pa.array(texts, pa.string())
    whole = [enc._bpe.encode_ordinary(t or "") for t in texts]
    for least in (1, 5, 1024):
        E.FRAGMENT = least
        ids, bounds = enc.encode(array)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole
        ids, bounds = enc.encode(array.slice(3, 50))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole[3:53]
    E.FRAGMENT = 1024


def test_texts_are_cut_and_fragments_are_long():
    enc = encoder()
    body = ("measured (Tm) 66.3 °C; " * 4000).encode()
    cuts = enc.fragments(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    assert len(cuts) > 20 and np.diff(cuts).min() >= 1024


def test_rows_of_ids(spark):
    df = spark.createDataFrame([(1, "Tm of the Fab"), (2, ""), (3, None), (3, None)], "doc_id long, text string").selectExpr("*", "0 as ids")
    got = sorted(tuple(r) for r in E.encode(df).collect())
    assert [r[1] for r in got[1:]] == [[], [], []] and len(got[0][1]) > 2
    assert E.encode(df.limit(0)).count() == 0
