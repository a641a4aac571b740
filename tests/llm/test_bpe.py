import random

import public_tokenizers
from tokenizers import Tokenizer

from tidegrid.llm import bpe as module
from tidegrid.llm.bpe import Bpe, encode_digests, encode_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "\n", "  a   b\n\n  c ", "\x1c\x1d a\x85b　 x", "<|endoftext|>hi <|endoftext|><|endoftext|>  x",
         "日本語 émile ́ x", "a" * 3000, "=-" * 700 + " z", "'s't I'll don't", "x\t y\t\tz", "🙂 \U0001F468‍🙃"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [",".join(map(str, e.ids)) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_same_as_the_library(spark):
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice(" \n\t'sab1.é\x1c　-<|>") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bpe = Bpe(open(PATH, encoding="utf-8").read())
    got = bpe.encode_batch(texts)
    assert got == library(texts)
    assert [bpe.decode(i) for i in got] == texts


def test_small_stores_and_long_words_change_nothing(monkeypatch):
    monkeypatch.setattr(module, "STORE_ENTRIES", 3)
    monkeypatch.setattr(module, "TRIE_BYTES", 5)
    bpe = Bpe(open(PATH, encoding="utf-8").read())
    for _ in range(2):
        assert [bpe.encode_batch([t])[0] for t in TEXTS] == library(TEXTS)


def test_edges(spark, edge_docs, no_docs):
    rows = encode_ids(edge_docs, PATH, "lang").collect()
    assert len(rows) == edge_docs.count() and all(r.round_trip for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert encode_ids(no_docs, PATH).count() == 0
    assert encode_digests(edge_docs, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
