import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from wayline.llm import alignment, queries
from wayline.llm.token_counts import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  two", "It's <|endoftext|> or <s>?", "a▁b", "▁", "é😀\x00z 中文字", "\n\n\tx \x1c\x85", "aaaa" * 500, "Hello, world. " * 200, "Hello, world. " * 200,
    "naïve café — “quotes” … 1234567 <0x41>", "\r\n", "antidisestablishmentarianism", " " * 300,
]


def slow(texts):
    """The contract by the libraries and loops over all token pairs."""
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    names, letters = {i: t for t, i in lib_a.get_vocab(with_added_tokens=False).items()}, byte_alphabet()
    tokens = []
    for t in texts:
        a = b = []
        if t:
            a, b = lib_a.encode(" " + t, add_special_tokens=False).ids, lib_b.encode(t)
            raw_a = [bytes(letters[c] for c in names[i]) for i in a]
            raw_b = [bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, lib_b.id_to_piece(i)) for i in b)]
            if not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                a = b = []
        spans = [[], []]
        for out, ids, raw in ((spans[0], a, raw_a if a else []), (spans[1], b, raw_b if b else [])):
            at = 0
            for i, r in zip(ids, raw):
                out.append((at, at + len(r), i))
                at += len(r)
        tokens.append(spans)
    every = [[(x[2], y[2]) for x in sa for y in sb if x[0] < y[1] and y[0] < x[1]] for sa, sb in tokens]
    counts = Counter(p for links in every for p in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for (sa, sb), links in zip(tokens, every):
        ends = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups, at = [], 0
        for e in ends:
            groups.append(",".join(str(i) for s, _, i in sa if at <= s < e) + "|" + ",".join(str(i) for s, _, i in sb if at <= s < e))
            at = e
        out.append((len(sa), len(sb), len(ends), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), ";".join(groups)))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair int, chunk string")


def test_equals_loops_over_all_pairs(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choices("abeinorst  '.,\n019éß中😀", k=rng.randrange(60))) for _ in range(150)]
    want = slow(texts)
    for chunk in (alignment.CHUNK, 500):
        got = {r.doc_id: tuple(r)[1:] for r in alignment.align(frame(spark, texts).repartition(3), A, B, chunk=chunk).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert want[5] == want[0] == (0, 0, 0, 0, 0, 0, "")  # a text that one side does not spell again


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "one two"), (None, None), (3, "one two")], "doc_id long, text string")
    rows = alignment.align(df, A, B).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 2
    assert alignment.align(df.limit(0), A, B).count() == 0
    assert {tuple(r)[1:] for r in alignment.align(df.where("text IS NULL"), A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_query_equals_loops(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_alignment(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, w in zip(rows, slow([d.text for d in rows])):
        assert got[d.doc_id] == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "")
