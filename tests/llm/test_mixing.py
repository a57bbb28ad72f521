import re
from collections import Counter, defaultdict

import duckdb

from brindle.llm import mixing as M
from tests.llm.conftest import corpus


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_targets(sizes, mix):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(order)}
    free, out, left = set(order), {}, mix.share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= mix.max_epochs * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = mix.max_epochs * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_query(spark, folder):
    rows = M.op7_mix_to_weights(spark, folder).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((c[0], len(words(c[1]))) for c in corpus())
    sizes = defaultdict(int)
    for _, text, _, source in corpus():
        sizes[source] += len(words(text))
    want = brute_targets(sizes, M.Mix())
    by = defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert {round(t, 6) for _, t in by} == {round(t, 6) for t in want.values()}
    total = defaultdict(int)
    for (size, target), own in by.items():
        total[round(target, 6)] += sum(r.taken for r in own)
    for t, n in total.items():
        same = sum(1 for v in want.values() if round(v, 6) == t)
        assert abs(n - t * same) <= same


def test_query_against_sql_and_reruns(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({M.SQL})").fetchall())
    first, again = (Counter(map(tuple, M.op7_mix_to_weights(spark, folder).select(names).collect())) for _ in range(2))
    assert first == again
    drop_id = lambda c: Counter((r[1], r[2], round(r[3], 6), r[4]) for r in c.elements())
    assert drop_id(first) == drop_id(want)


def test_water_filling_in_rounds(spark):
    sizes = {f"s{i}": 10 * (i + 1) ** 2 for i in range(9)} | {None: 3}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    for mix in (M.Mix(), M.Mix(share=2.5), M.Mix(weights=(100, 1), max_epochs=1.0, share=0.7)):
        got = {r.source: r.target for r in M.targets(df, mix).collect()}
        want = brute_targets(sizes, mix)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_rows_of_the_mix(docs, empty):
    out = M.mixed_rows(docs)
    assert out.columns == docs.columns and M.mixed_rows(empty).count() == 0
    rows = out.collect()
    assert all(r.n_chars == len(r.text) and r.text.strip() for r in rows)
    taken = sum(len(words(r.text)) for r in rows)
    assert abs(taken - 1.5 * sum(len(words(c[1])) for c in corpus())) <= 10
