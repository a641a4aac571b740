import random
import re
from math import ceil

import pytest

from tidegrid.llm.license_scan import PHRASES, THRESHOLD, WORD, scan_licenses
from tidegrid.llm.license_texts import TEMPLATES
from tidegrid.llm.queries import license_columns

from .plain import lower


def plain(text, templates=TEMPLATES, threshold=THRESHOLD):
    """n_words, places of phrases, labels and score by looking at every block with every template."""
    words = re.findall(WORD, lower(text or ""))
    places = sorted((i, label) for phrase, label in PHRASES for i in range(len(words))
                    if words[i:i + len(phrase.split())] == phrase.split())
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for label, body in templates:
        own = re.findall(WORD, lower(body))
        step = 1
        while step < len(own):
            step *= 2
        for start in range(0, max(len(words), 1), step):
            share = len(set(own) & set(words[start:start + 2 * step])) / len(set(own))
            if share * len(set(own)) >= ceil(threshold * len(set(own)) - 1e-9):
                labels.add(label)
                score = max(score, share)
    return len(words), places, sorted(labels), score


def check(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, sorted((p.pos, p.label) for p in r.places), r.labels, r.score)
           for r in scan_licenses(df, **how).collect()}
    assert got == {i: plain(t, **how) for i, t in enumerate(texts)}
    return got


def test_against_every_block_with_every_template(spark):
    rnd = random.Random(3)
    common = "the of and to in a is under license software this or version free copy permission work".split()
    texts = []
    for k in range(150):
        words = [rnd.choice(common) for _ in range(rnd.randrange(0, 300))]
        _, body = rnd.choice(TEMPLATES)
        body = body.split()
        for _ in range(rnd.randrange(0, 4)):  # losses around the threshold
            body.pop(rnd.randrange(len(body)))
        at = rnd.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + body * (k % 3) + words[at:]))
    got = check(spark, texts)
    assert sum(bool(r[2]) for r in got.values()) > 20 and sum(not r[2] for r in got.values()) > 20
    check(spark, texts[:40], threshold=0.5)


def test_edges(spark, edge_docs, no_docs):
    check(spark, [None, "", "MIT", "license", "mit  LICENSE mit\nlicense", "the General-Public License, apache license 日本"])
    assert scan_licenses(no_docs).count() == 0
    got = license_columns(scan_licenses(edge_docs)).collect()
    assert len(got) == edge_docs.count()
    assert all(r.labels == "" and r.first_word is None and r.score == 0 for r in got)


def test_a_long_text_of_nothing_but_licences(spark):
    text = " ".join(body for _, body in TEMPLATES) * 300 + " Released under the MIT License."
    got = check(spark, [text])
    assert len(text) > 500_000 and got[0][2][0] == "agpl"


@pytest.mark.parametrize("name", ["Python", "Pandas", "Arrow"])
def test_no_python_in_the_plan(spark, small_docs, name):
    plan = scan_licenses(small_docs)._jdf.queryExecution().executedPlan().toString()
    assert name not in plan.replace("PythonRDD", "")
