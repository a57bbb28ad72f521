import re
from collections import Counter

import corpus_pipeline as P
from brindle.llm.mixing import Mix
from tests.llm.conftest import corpus
from tests.llm.test_decontam import brute as brute_matches
from tests.llm.test_mixing import brute_targets, words
from tests.llm.test_quality_rules import brute as brute_counts
from tests.llm.test_sharding import check
from tests.llm.test_simhash import brute_components, brute_print


def test_run_against_brute_force(spark, folder):
    docs = []
    for row in corpus():
        n, chars, symbols, dup, repeats = brute_counts(row[1])
        if n >= 20 and 100 * repeats <= 30 * n and 10 * symbols <= 2 * n and 10 * dup <= 2 * n and 1.25 * n <= chars <= 24 * n:
            docs.append(row)
    roots = brute_components([brute_print(r[1]) for r in docs])
    best = {}
    for r, c in zip(docs, roots, strict=True):
        if c not in best or (r[0] is None, r[0]) < (best[c][0] is None, best[c][0]):
            best[c] = r
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in brute_matches([(i, r[1]) for i, r in enumerate(best.values())], items)}
    docs = [r for i, r in enumerate(best.values()) if i not in bad]
    out = P.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in docs}
    check(out)
    alike = {r.doc_id: r.source for r in out}  # of rows that differ in the source alone, either may stay
    docs = [(*r[:3], alike.get(r[0], r[3])) for r in docs]
    sizes, taken = Counter(), Counter()
    for r in docs:
        sizes[r[3]] += len(words(r[1]))
    for r in out:
        taken[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    for source, target in brute_targets(dict(sizes), Mix()).items():
        assert abs(taken[source] - target) <= 1
    whole = {r[0]: r[1] for r in docs}
    assert all(r.text == whole[r.doc_id] or whole[r.doc_id].split()[: len(r.text.split())] == r.text.split() for r in out)
    assert sum(r.text != whole[r.doc_id] for r in out) <= len(sizes)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [re.sub("_", " ", n) for n, _ in P.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d", n)} == set(range(1, 11))
    assert {"op1_arc_to_warc", "op7_mix_to_weights"} <= set(entry.oracle_sql()) <= set(names)
