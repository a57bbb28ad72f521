"""Entities from reference pages, and questions from entities; token sets of a corpus; gold validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as X


def bullets(text: Column) -> Column:
    """array<struct<name, summary>> of `- name - summary` lines; a line that is no bullet goes on with the last."""
    joined = F.regexp_replace(text, r"\n(?!\s*- )\s*(\S)", " $1")
    lines = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^\s*- \S"))
    part = lambda x, i: F.regexp_extract(x, r"^\s*- (\S.*?)(?:\s+-\s+(.*))?$", i)
    return F.transform(lines, lambda x: F.struct(F.trim(part(x, 1)).alias("name"), F.trim(part(x, 2)).alias("summary")))


def section(text: Column, heading: str) -> Column:
    """What stands between `## heading` and the next heading; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s)(?:^|\n)## {heading}\s*\n(.*?)(?=\n## |\z)", 1)), F.lit(""))


def examples(text: Column) -> Column:
    own = F.coalesce(section(text, "Examples"), F.lit(""))
    return F.filter(F.transform(F.split(own, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")  # trim by itself would take the place as characters


def valid_events(text: Column) -> Column:
    line = F.coalesce(section(text, "Valid Events"), F.regexp_extract(text, r"Valid Events:?\s*([^\n]*)", 1))
    return F.filter(F.transform(F.split(F.replace(line, F.lit(" and "), F.lit(",")), r"[,\n]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-.]+|[\s.]+$", ""))), lambda x: x != "")


def modules(urls: DataFrame) -> DataFrame:
    """Names of modules in page urls (upper case, before .html), each once, sorted."""
    name = F.regexp_extract("url", r"/([A-Z0-9]+)\.html$", 1)
    return urls.select(name.alias("module")).where("module <> ''").distinct().orderBy("module")


def entities(index: DataFrame, pages: DataFrame, base: str, order: DataFrame | None = None) -> DataFrame:
    """Entities of module pages (module, text): the bullets under their headings of commands and events, with summary,
    description, examples and events of the detail page at the url that the name gives, and the event's place."""
    each = index.select("module", F.explode(bullets(F.coalesce(section(F.col("text"), "Commands"), F.lit("")))).alias("e"), F.lit("command").alias("kind"))
    each = each.union(index.select("module", F.explode(bullets(F.coalesce(section(F.col("text"), "Events"), F.lit("")))).alias("e"), F.lit("event").alias("kind")))
    named = each.select("module", "kind", "e.name", "e.summary", F.concat(F.lit(base), X.entity_path(F.col("e.name"))).alias("source_url"))
    t = F.col("text")
    detail = pages.select(F.col("url").alias("source_url"), section(t, "Description").alias("description"), section(t, "Syntax").alias("syntax"), examples(t).alias("examples"), valid_events(t).alias("valid_events"))
    found = named.join(detail, "source_url", "left")
    return found if order is None else found.join(order.withColumnRenamed("event", "name"), "name", "left")


def entity_questions(rows: DataFrame) -> DataFrame:
    """(question, answer, context, source_url): questions by kind of entity, without those that have no answer."""
    e = rows.withColumn("context", F.concat_ws("\n", "name", "summary", "description", "syntax", F.array_join("examples", "\n")))
    ask = lambda form, answer: F.struct(F.format_string(form, "name").alias("question"), answer.alias("answer"))
    all_ = F.array(
        ask("What does %s do?", F.coalesce("description", "summary")), ask("What is the syntax of %s?", F.col("syntax")), ask("Show an example of %s.", F.try_element_at("examples", F.lit(1))), ask("In which events can %s be used?", F.nullif(F.array_join("valid_events", ", "), F.lit(""))),
    )
    return e.select("context", "source_url", F.explode(F.filter(all_, lambda q: F.coalesce(F.trim(q["answer"]), F.lit("")) != "")).alias("q")).select("q.question", "q.answer", "context", "source_url")


def rulebook(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(kind, token): commands, events and operators of all chunks, each once."""
    t = F.col(text)
    kinds = (("command", X.commands(t)), ("event", X.declared_events(t)), ("operator", X.operators(t)))
    return chunks.select(F.explode(F.concat(*[_tagged(k, v) for k, v in kinds])).alias("t")).select("t.*").distinct()


def _tagged(kind: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token")))


def validated_gold(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """questions (id, expected) with the document found by its id, or by the id without its leading letter and zeros
    (the first such), or none."""
    norm = lambda c: F.regexp_replace(F.upper(c), "^K0*", "")
    exact = docs.select(F.col("doc_id").alias("_exact")).distinct()
    near = docs.groupBy(norm(F.col("doc_id")).alias("_norm")).agg(F.min("doc_id").alias("_near"))
    rows = questions.join(exact, F.col("expected") == F.col("_exact"), "left").join(near, norm(F.col("expected")) == F.col("_norm"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "normalised").otherwise("missing")
    return rows.select("id", "expected", F.coalesce("_exact", "_near").alias("doc_id"), how.alias("how"))


def sampled_advisories(docs: DataFrame, first_source: str, k: int) -> DataFrame:
    """The first advisory that each document names, each advisory once (of first_source before others)."""
    from brindle.operators.retrieval import ADVISORY

    own = docs.select("id", "source", F.upper(F.regexp_extract("content", ADVISORY, 1)).alias("cve")).where("cve <> ''")
    w = Window.partitionBy("cve").orderBy((F.col("source") != first_source).cast("int"), "id")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("id").limit(k)


def code_query(text: Column, stop: list[str]) -> Column:
    """The question rewritten for code: its distinct commands, or its first five words that say something."""
    commands = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]+::[A-Za-z_]+)\b"), F.lit(1)))
    plain = F.slice(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: ~w.isin(*stop) & (w != "")), 1, 5)
    return F.array_join(F.when(F.size(commands) > 0, commands).otherwise(plain), " ")


def slug_class(slug: Column, buckets: dict[str, list[str]], default: str = "other") -> Column:
    """The first bucket, in order, one of whose words is in the slug."""
    out = F.lit(default)
    for name, words in reversed(list(buckets.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(slug, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def command_manual(lines: DataFrame, headings: tuple[str, ...] = ("NAME", "MODULE", "SYNTAX", "DESCRIPTION", "EXAMPLES", "OPTIONS", "SEE ALSO")) -> DataFrame:
    """(file, command, section, text) of manual lines (file, i, line): NAME begins a command, whose id is the last line
    before it that isn't empty; headings begin sections."""
    w = Window.partitionBy("file").orderBy("i")
    line = F.trim("line")
    r = lines.withColumn("line", line).withColumn("before", F.last(F.when(line != "", line), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("no", F.sum(F.when(F.col("line") == "NAME", 1).otherwise(0)).over(w)).withColumn("section", F.last(F.when(F.col("line").isin(*headings), F.col("line")), ignorenulls=True).over(w))
    r = r.withColumn("command", F.last(F.when(F.col("line") == "NAME", F.col("before")), ignorenulls=True).over(w))
    kept = r.where((F.col("no") > 0) & ~F.col("line").isin(*headings) & (F.col("line") != ""))
    return kept.groupBy("file", "no", "command", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text")).drop("no")


def options(text: Column) -> Column:
    """array<struct<name, text>> of option lines (`name` or `[name]` alone on a line, indented lines after it)."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^(\[?[a-z][a-z0-9-]*\]?)[ \t]*\n((?:[ \t]+\S.*\n?)*)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_replace(F.trim(F.substring_index(x, "\n", 1)), r"[\[\]]", "").alias("name"), F.trim(F.regexp_replace(F.substring(x, F.locate("\n", x) + 1, F.length(x)), r"\s+", " ")).alias("text")))
