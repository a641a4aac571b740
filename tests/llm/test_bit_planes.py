from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm.bit_planes import IdEncoder, from_planes, read_documents, to_planes, write_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("unit", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_transpose(unit, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes = to_planes(ids, unit)
    assert len(planes) == (32 if unit == "bit" else 4)
    assert (from_planes(planes, n, unit) == ids).all()


def test_encoder_is_the_library():
    texts = ["", "\x1c<|endoftext|> Hi", "á ́b", "ΑΣ ΣΑ İ", "x\x85y　 z's", " a  b\n\nc "]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert IdEncoder(open(PATH, encoding="utf-8").read()).encode(texts) == want


@pytest.mark.parametrize("unit, block", [("bit", 64), ("byte", 1000), ("bit", 65536)])
def test_files_read_back(spark, small_docs, unit, block):
    files = write_ids(small_docs, PATH, 1, unit, block)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_documents(spark, files).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in small_docs.collect())
    want, position = {}, 0
    encoded = Tokenizer.from_file(PATH).encode_batch([t for _, t in docs], add_special_tokens=False)
    for (i, _), e in zip(docs, encoded):
        ids = np.array([*e.ids, 1], "<u4")
        want[i] = (position, len(ids), crc32(ids.tobytes()))
        position += len(ids)
    assert got == want
    index = files.table(spark, "index").collect()
    assert sum(r.n_ids for r in index) == position and all(r.n_ids <= block for r in index)


def test_edges(spark, edge_docs, no_docs):
    rows = read_documents(spark, write_ids(edge_docs, PATH, 1, block_ids=128)).orderBy("start").collect()
    assert len(rows) == edge_docs.count()
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert read_documents(spark, write_ids(no_docs, PATH, 1)).count() == 0


def test_some_documents_are_read_by_the_index(spark, small_docs):
    files = write_ids(small_docs, PATH, 1, "byte", 500, shard_bytes=60_000)
    documents = files.table(spark, "documents")
    assert documents.select("shard").distinct().count() > 2
    every = {r.doc_id: r for r in read_documents(spark, files).collect()}
    ids = sorted(every)[3:50:9]
    wanted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = read_documents(spark, files, wanted)
    assert {r.doc_id: r for r in got.collect()} == {i: every[i] for i in ids}
    assert read_documents(spark, files, wanted.limit(0)).count() == 0
