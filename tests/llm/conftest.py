"""A small corpus with what operators must stand: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(20_000))


def corpus(n=60):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["tha", "ing", "ére", "ou", "on", "ß", "st"]) for _ in range(rnd.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(25, 90))) + ("\n" if i % 3 else "."), "en", f"s{min(i % 7, 3)}") for i in range(n)]
    rows += [(100, rows[5][1], "en", "s1"), (101, rows[5][1] + " more", "en", "s1"), (5, rows[5][1], "en", "s0")]  # copies; a repeated id
    rows += [(rows[7][0], *rows[7][1:])] * 2  # repeated rows
    rows += [(200, None, None, None), (201, "", "fr", None), (202, " \t\n ", "fr", "s9"), (203, LONG, "en", "s2"), (None, "no id but some words here", "en", "s0")]
    rows += [(204, "one", "en", "s1"), (205, "same line\nsame line\nsame line " * 9, "en", "s1"), (206, "#$%& " * 30, "en", "s1")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    """With further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus(), SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("size", "fp", "n_words", "kept", "verdict", "slot", "__id", "__text", "__k1", "row", "word", "b"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """The corpus as the tables that queries read."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(corpus()[9][1].split()[3:24])), (2, "nothing like it at all in any of them"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), int(i % 5 == 0)) for i in range(60)] + [(1, None, None), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    html = "<p>é" + "x" * 2000
    pages = [(i, f"http://h/{i} a b" if i % 2 else None, f"<p>{i}</p>" + html[: i * 100]) for i in range(20)]
    pages += [(50, "u", html), (51, "u", html), (52, "v", html), (52, "v", html), (60, "u", "short"), (61, "u", "short"), (62, None, None), (None, "x", html + "y")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return path
