import random
import re
from collections import Counter

from brindle.llm import decontam as D
from tests.llm.conftest import corpus


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, least=0.8):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            k = min(5, len(v))
            s, t = ([" ".join(x[j : j + k]) for j in range(len(x) - k + 1)] for x in (w, v))
            c, best = Counter(t), 0
            for at in range(max(1, len(s) - len(t) + 1)) if s else ():
                own = Counter(s[at : at + len(t)])
                z = sum((own & c).values())
                best = max(best, z / (sum(own.values()) + len(t) - z))
            if best >= least:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 5, 6, 12, 20, 35, 50, 50])] + [(20, None), (21, "  ")]
    docs = [(i, text(rnd.randint(0, 80))) for i in range(40)]
    for d in range(100, 220):
        own = rnd.choice(items[2:9])[1].split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            at = rnd.randrange(len(own))
            change = rnd.choice(["drop", "add", "swap", "turn"])
            if change == "drop":
                own = own[:at] + own[at + 1 :]
            elif change == "add":
                own = own[:at] + ["new"] + own[at:]
            elif change == "swap":
                own = own[:at] + ["other"] + own[at + 1 :]
            else:
                own = own[at:] + own[:at]
        passage = " ".join(own)
        docs.append((d, f"{text(rnd.randint(0, 30))} {passage.upper() if d % 4 == 0 else passage}{rnd.choice([' ', '. ', ','])}{text(rnd.randint(0, 30))}"))
    docs += [(300, None), (301, ""), (302, items[6][1]), (302, items[6][1])]
    want = brute(docs, items)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for plan in (D.Windows(), D.Windows(broadcast_words=0)):
        got = {}
        for r in D.matches(a, b, plan).collect():
            got[r.doc_id, r.item_id] = max(r.similarity, got.get((r.doc_id, r.item_id), 0))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 100


def test_query_and_stage(spark, folder, docs, empty):
    got = {(r.doc_id, r.item_id) for r in D.op9_benchmark_windows(spark, folder).collect()}
    assert got == {(9, 1)}
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(corpus()) - 1 and kept.where("doc_id = 9").count() == 0
    assert D.keep_clean(empty, items).count() == 0 and D.keep_clean(docs, items.limit(0)).count() == len(corpus())
