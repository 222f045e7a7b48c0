import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wayline.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "It's HAHAHAHA aaaaaaa", "<|endoftext|> hi<|startoftext|>", "ΑΣ éü é 中文😀½²٣", "a" * 3000, "word, " * 3000, "It's HAHAHAHA aaaaaaa"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_equals_the_library(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, decoded int")
    library = Tokenizer.from_file(PATH)
    for r in bpe.decode(bpe.encode(df, PATH), PATH).collect():
        want = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (want, library.decode(want, skip_special_tokens=False))


def test_query_equals_the_library(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_bpe(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got.pop(d.doc_id) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert not got


def test_pair_index_on_random_words():
    rng = np.random.default_rng(5)
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(bpe._load(PATH))
    texts = ["".join(rng.choice(list("abeinorst'19 "), rng.integers(1, 40))) for _ in range(500)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_decode_of_odd_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [-1, 10**6, 320])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got[1] == got[2] == "" and " " not in got[3]
    assert bpe.decode(df.limit(0), PATH).count() == 0
