import random
from collections import Counter

from brindle.llm import simhash as S
from brindle.llm.near import Near, shingles, sketch
from tests.llm.test_near import brute, edited


def family(edits):
    """Texts from one template, alike by less than 0.8, each third with a near copy after it: bands are crowded with
    texts of many components."""
    rnd, texts, copies = random.Random(11), [], []
    base = [f"b{i}" for i in range(150)]
    for i in range(60):
        words = base + [f"w{rnd.randrange(10**6)}" for _ in range(26)]
        texts.append(" ".join(words))
        if i % 3 == 0:
            copies.append(len(texts))
            texts.append(" ".join(edited(rnd, words, edits)))
    return texts, copies


def kept(spark, texts, plan):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in S.keep_one(docs, plan).collect())


def test_crowded_bands_against_brute_force(spark):
    for edits in (1, 3):
        texts, copies = family(edits)
        want = brute(texts)
        assert len(want) == len(texts) - len(copies)
        assert kept(spark, texts, Near(crowd=4, hubs=1)) == want


def test_texts_of_a_crowd_meet_on_rarer_minima(spark):
    plan = Near(bands=4, rows=4, crowd=4, hubs=1)
    texts, copies = family(3)
    left = set(kept(spark, texts, plan))
    assert left >= set(brute(texts))  # nothing else goes
    prints = [sketch(shingles(t.encode().split(), plan), plan).tolist() for t in texts]
    bands = [[(i, *p[4 * i : 4 * i + 4]) for i in range(4)] for p in prints]
    many, rare = Counter(b for own in bands for b in own), Counter(x for p in prints for x in enumerate(p))
    only_here = 0
    for c in copies:
        shared = set(bands[c]) & set(bands[c - 1])
        minima = set(enumerate(prints[c])) & set(enumerate(prints[c - 1]))
        if shared and any(rare[x] <= 4 for x in minima) and len(minima) >= 8:
            assert c not in left
            only_here += all(many[b] > 4 for b in shared)
    assert only_here >= 2
