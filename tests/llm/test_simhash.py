import random
import re
from collections import Counter

import xxhash

from brindle.llm import simhash as S
from brindle.llm.common import components
from tests.llm.conftest import corpus


def brute_print(text):
    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(range(len(prints)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                ids[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_query_against_brute_force(spark, folder):
    rows = corpus()
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, roots, strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in S.op5_simhash_components(spark, folder).collect())
    assert got == want


def test_ball_links_lose_no_link(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = list({b ^ sum(1 << k for k in rnd.sample(range(64), d)) for b in base for d in (0, 1, 2, 3, 4, 5)} | {0, 1 << 63, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in components(S.ball_links(df)).collect()}
    roots = brute_components(prints)
    groups = {}
    for p, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(found.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (-5, -9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(101)) and all(found[1000 + i] == 1000 for i in range(200)) and found[-5] == -9
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(docs, empty):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(ids.values()) == 1 and ids[5] == 1 and 100 not in ids and ids[7] == 1 and ids[200] == 1 and 201 not in ids and ids[None] == 1
    assert S.keep_one(empty).count() == 0


def test_empty_table(spark, tmp_path, docs):
    docs.select("doc_id", "text").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op5_simhash_components(spark, str(tmp_path)).count() == 0
