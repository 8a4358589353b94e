"""SentencePiece ids and token counts against the libraries on whole texts."""

import hashlib
import sys
import unicodedata

import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from provenant.llm import queries, sentencepieces, tokencounts

HARD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b\n c  ", "ab▁c ▁▁ d", "<s> a</s> <unk> <0x0A> <|endoftext|>", "ﬁ Å é́ \t x y　z", "\x00 nul\x00",
    "日本語 テキスト 🙂🙃 👩‍👩‍👧", "don't we'll THEY'RE 's 'S", "x" * 70_000, "the " * 30_000, " ".join(map(str, range(3000))), "\r\n\r\n  \n\tq", "<|endoftext|>", "a<|endoftext|>  <|endoftext|> b",
    "end<|endoftext|", "   \n  <|endoftext|>\n", "١٢٣ ²³ ½ Ⅷ", "a​b ﻿ \u0085   ᠎ \x1c \x1d\x1e\x1f z",
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)] + [(3, "a ", "y"), (None, "a b", "z")], "doc_id long, text string, n_tokens string")


def test_sentencepiece_equals_the_library(spark, hard):
    model = queries.tokenizer_file("piece_bpe_32k.model").read_bytes()
    whole = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in sentencepieces.encode(hard, model).collect()), key=str)
    want = []
    for r in hard.collect():
        ids = whole.encode(r.text or "")
        want.append((r.doc_id, ids, whole.decode(ids) if ids else ""))
    assert got == sorted(want, key=str)
    assert sentencepieces.encode(hard.limit(0), model).count() == 0


def test_blocks_end_by_letters_and_documents_too(spark, monkeypatch):
    """Texts without blanks are one chunk each and null texts none; neither may fill one block without end."""
    monkeypatch.setattr(sentencepieces, "BLOCK_LETTERS", 3000)
    monkeypatch.setattr(sentencepieces, "BLOCK_DOCS", 100)
    monkeypatch.setattr(sentencepieces, "LETTERS_AT_ONCE", 500)
    model = queries.tokenizer_file("piece_bpe_32k.model").read_bytes()
    whole = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [(i, "".join(chr(0x4E00 + (i * 37 + k * k) % 5000) for k in range(200)) if i % 5 else None) for i in range(500)] + [(1000 + i, None) for i in range(1000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    blocks = df.mapInArrow(sentencepieces._blocks(4), sentencepieces.BLOCK).selectExpr("size(docs) AS n").collect()
    assert len(blocks) > 30 and max(r.n for r in blocks) <= 100
    got = {r.doc_id: (r.ids, r.decoded) for r in sentencepieces.encode(df, model).collect()}
    assert got == {i: (whole.encode(t or ""), whole.decode(whole.encode(t)) if t else "") for i, t in texts}


def test_sentencepiece_over_a_table(spark):
    folder = "/root/testdata/sf0.001"
    whole = sentencepiece.SentencePieceProcessor(model_file=str(queries.tokenizer_file("piece_bpe_32k.model")))
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        ids = whole.encode(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(whole.decode(ids).encode()).hexdigest()


def test_models_with_crossing_pieces_are_refused():
    class Crossing:
        get_piece_size = lambda self: 2
        id_to_piece = lambda self, i: ["▁a", "a▁b"][i]

    with pytest.raises(ValueError, match="cross"):
        sentencepieces._check(Crossing())


def test_counts_equal_the_library(spark, hard):
    model = queries.tokenizer_file("byte_bpe_50k.json").read_text()
    whole = Tokenizer.from_str(model)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencounts.count_tokens(hard, model).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in hard.collect()]
    assert got == sorted(want, key=str)
    assert tokencounts.count_tokens(hard.limit(0), model).count() == 0


def test_counts_over_a_table(spark):
    folder = "/root/testdata/sf0.001"
    whole = Tokenizer.from_file(str(queries.tokenizer_file("byte_bpe_50k.json")))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, folder).collect()}
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        n = len(whole.encode(d.text or "", add_special_tokens=False).ids)
        assert got[d.doc_id] == (len((d.text or "").encode()), n, n > 1024)


def test_the_store_of_merged_pre_tokens_may_start_anew(monkeypatch):
    model = queries.tokenizer_file("byte_bpe_50k.json").read_text()
    whole = Tokenizer.from_str(model)
    monkeypatch.setattr(tokencounts, "REMEMBERED", 3)
    count = tokencounts.counter(model, tokencounts.whole_tokens(whole))
    text = " ".join(f"zq{i}xv the" for i in range(50))
    assert count(text) == len(whole.encode(text, add_special_tokens=False).ids)


def test_every_character_is_split_as_by_the_library():
    whole = Tokenizer.from_file(str(queries.tokenizer_file("byte_bpe_50k.json")))
    split = regex.compile(tokencounts.PATTERN).findall
    for first in range(0, sys.maxunicode, 64):
        text = "".join(f"a{c} {c}1{c}\n" for c in map(chr, range(first, min(first + 64, sys.maxunicode))) if unicodedata.category(c) not in ("Cs", "Cn"))
        found = whole.pre_tokenizer.pre_tokenize_str(text)
        assert [text[a:b] for _, (a, b) in found] == split(text), hex(first)
