import math
import random
import re
from collections import Counter

import pytest

from tidegrid.llm import lexical_search
from tidegrid.llm.lexical_search import search, terms_of

from .plain import lower

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain(docs, items, k):
    """item, rank, doc and score by scoring every pair."""
    tf = [Counter(re.findall(TERM, lower(t or ""))) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in tf), sum(sum(c.values()) for c in tf)
    df = Counter(w for c in tf for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for (i, _), c in zip(docs, tf):
            score = 0
            for w in set(re.findall(TERM, lower(text or ""))) & set(c):
                m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return out


def check(spark, docs, items, k, parts=4):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string").repartition(parts)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in search(d, q, k).select("item_id", "rank", "doc_id", "score").collect()]
    want = plain(docs, items, k)
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def texts(rnd, n, words=400, most=60):
    pool = ["".join(rnd.choice("abcdeéö") for _ in range(3)) for _ in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [" ".join(rnd.choices(pool, weights, k=rnd.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("bucket,head", [(1024, 1 / 16), (16, 1 / 16), (50, 1 / 2)])
def test_against_every_pair(spark, monkeypatch, bucket, head):
    monkeypatch.setattr(lexical_search, "BUCKET", bucket)
    monkeypatch.setattr(lexical_search, "HEAD", head)
    rnd = random.Random(bucket)
    docs = list(enumerate(texts(rnd, 600)))
    docs += [(1000 + k, docs[5][1]) for k in range(40)] + [(7, docs[8][1]), (None, docs[9][1]), (2000, " ".join(t for _, t in docs))]
    items = [(k, t) for k, t in enumerate(texts(rnd, 25, most=12))] + [(3, docs[5][1]), (90, None), (91, "!?"), (92, "unknown")]
    check(spark, docs, items, 10)


def test_blocks_of_items_and_edges(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 30)
    docs = [(None, "Hello wörld"), (1, None), (2, ""), (3, "hello-HELLO 1"), (3, "hello-HELLO 1"), (4, "日本 x\x00y"), (5, "..."),
            (6, "x" * 300_000)]
    items = [(1, "hello"), (1, "hello"), (2, "1 hello y and more words of no use"), (2, "日本"), (None, "hello"), (5, "x" * 300_000)]
    assert check(spark, docs, items, 2)
    check(spark, [(1, None)], items, 2)
    check(spark, docs, [], 2)
    assert terms_of("Az09_é-Z") == [b"az09", "é".encode(), b"z"]


def test_buckets_are_skipped(spark, monkeypatch):
    """With the longest vectors searched first, later buckets are dropped by their length or coordinates."""
    docs = [(i, f"rare{i % 7} common " * 9 if i < 100 else f"common filler{i} other{i} words{i} " * 40) for i in range(1500)]
    items = [(k, f"rare{k} common") for k in range(7)]
    check(spark, docs, items, 5)
    bucket = lexical_search._Bucket(
        *(lambda r: (lexical_search.np.arange(len(r)), lexical_search.np.array([float(x) for x in r]),
                     [lexical_search.np.array([0], "i4").tobytes()] * len(r),
                     [lexical_search.np.array([x], "i8").tobytes() for x in r]))([9, 5, 2]))
    weights, postings = lexical_search.np.array([10]), bucket.postings(lexical_search.np.array([0]))
    assert bucket.reaching(weights, 10.0, postings, 50).tolist() == [True, True, False]
