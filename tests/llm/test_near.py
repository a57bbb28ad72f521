import random
from itertools import combinations

from brindle.llm import simhash as S


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rnd, words, n):
    words = list(words)
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"new{rnd.randrange(10**9)}"
    return words


def brute(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def test_edited_copies_go_against_brute_force(spark):
    rnd = random.Random(5)
    line, texts = [f"common{i}" for i in range(30)], []
    for n, edits in [(300, 1), (300, 3), (300, 5), (1000, 5), (100, 2), (100, 5), (300, 9), (60, 1), (3, 1)] * 6:
        words = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(words), " ".join(edited(rnd, words, edits))]
    texts += [" ".join(line + [f"w{rnd.randrange(5000)}" for _ in range(60)]) for _ in range(40)]  # one line, else unlike
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    texts += [" ".join(edited(rnd, base, 1)) for _ in range(60)]  # more than a band's crowd
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == brute(texts)
