import hashlib
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from wayline.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a", "a  b ", "▁x", "a▁▁b", "é😀\x00z", "<s>hi</s><unk>", "<0x41>", "\n\tq\r\n", "a" * 3000, "ab" * 5000, " " * 5000, "word, " * 3000,
    "中文字符漢字かなカナ한국어 тест " * 20, "\x1c\x85  ‍", "x².y", "word, " * 3000,
]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts():
    rng, lib = random.Random(7), library()
    known = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, lib.get_piece_size())]
    letters = "abcdeinorst  ▁'.,-(){}\n\t019éüñß中文字😀"
    return ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(1500)] + ["".join(rng.choices(known, k=rng.randrange(60))) for _ in range(1500)]


def test_round_trip_equals_the_library(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1)], "doc_id long, text string, ids string, decoded int")
    lib = library()
    rows = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = lib.encode("no id" if r.doc_id is None else TEXTS[r.doc_id] or "")
        assert (r.ids, r.decoded) == (want, lib.decode(want))
    assert pieces.round_trip(df.limit(0), PATH).count() == 0


def test_the_library_agrees_batch_by_batch(spark, sf_dir):
    df = spark.createDataFrame(list(enumerate(random_texts())), "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert pieces.differences(df.union(docs), PATH).count() == 0


def test_query_equals_the_library(spark, sf_dir):
    lib = library()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_pieces(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = lib.encode(d.text or "")
        assert got.pop(d.doc_id) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert not got


def test_decode_of_odd_lists(spark):
    lists = [[195, 5, 6, 300], [0, 1, 2, 300], [1, 259, 300], [28705, 28705, 300], [2], [], [0xF3, 0xA2, 0x9B], [0xF0, 0xA3, 0x83, 0xC3, 0x83], [1, 0, 300], [13, 300]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    lib = library()
    for r in pieces.decode(df, PATH).collect():
        assert r.decoded == lib.decode(r.ids)
    odd = spark.createDataFrame([(1, None), (2, [-1, 10**6])], "doc_id long, ids array<int>")
    assert {r.decoded for r in pieces.decode(odd, PATH).collect()} == {""}


def test_a_stretch_is_encoded_as_within_its_text():
    whole, cut = pieces.Encoder(PATH), pieces.Encoder(PATH)
    for t in random_texts()[:300]:
        assert cut.encode([t])[0].tolist() == (whole.stretch("▁" + t.replace(" ", "▁")) if t else [])


def test_other_vocabularies_are_refused(tmp_path):
    import pytest

    path = tmp_path / "x.model"
    path.write_bytes(b"\x0a\x05\x0a\x03abc")
    with pytest.raises(ValueError):
        pieces.Vocabulary(str(path))


def test_ids_do_not_depend_on_batches(spark):
    df = spark.createDataFrame(list(enumerate(random_texts()[:200])), "doc_id long, text string").repartition(7)
    one = {r.doc_id: r.ids for r in pieces.encode(df, PATH).collect()}
    two = {r.doc_id: r.ids for r in pieces.encode(df.coalesce(1).orderBy(F.desc("doc_id")), PATH).collect()}
    assert one == two
