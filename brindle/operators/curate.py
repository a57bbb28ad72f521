"""Curation of question and answer data: grounding, grades, splits, quotas, packages."""

from __future__ import annotations

import json
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as X

SCORES = ("factual", "linguistic", "domain", "overall")
VERDICT = "struct<scores:struct<factual:double,linguistic:double,domain:double,overall:double>,verdict:string,feedback:string,notes:string,tags:array<string>,missing_facts:array<string>>"


def ungrounded(question: Column, answer: Column, context: Column, known: Column | None = None) -> Column:
    """Commands of question and answer that the context lacks, or that aren't known (if known isn't empty); sorted."""
    own = F.array_union(X.commands(question), X.commands(answer))
    out = F.array_except(own, X.commands(context))
    if known is not None:
        out = F.array_union(out, F.when(F.size(known) > 0, F.array_except(own, known)).otherwise(F.slice(own, 1, 0)))
    return F.array_sort(out)


def unknown_events(question: Column, answer: Column, context: Column) -> Column:
    return F.array_sort(F.array_except(F.array_union(X.capital_tokens(question), X.capital_tokens(answer)), X.declared_events(context)))


def mislabelled(question: Column, answer: Column, events: Column) -> Column:
    """An event is called a command."""
    return F.exists(events, lambda e: F.contains(F.lower(question), F.concat(F.lower(e), F.lit(" command"))) | F.contains(F.lower(answer), F.concat(F.lower(e), F.lit(" command"))))


def reasons(rows: DataFrame, known_commands: Column | None = None) -> DataFrame:
    """rows (question, answer, context) with a reason for rejection, or null: commands, events, labels, deprecated."""
    q, a, c = F.col("question"), F.col("answer"), F.col("context")
    reason = (
        F.when(F.contains(F.lower(c), F.lit("deprecated")), "deprecated").when(F.size(ungrounded(q, a, c, known_commands)) > 0, "commands").when(F.size(unknown_events(q, a, c)) > 0, "events").when(mislabelled(q, a, X.declared_events(c)), "mislabelled")
    )
    return rows.withColumn("reason", reason)


def balanced(text: str, opening: str = "{", closing: str = "}"):
    """Balanced stretches of text from each opening, aware of JSON strings."""
    for start in (m.start() for m in re.finditer(re.escape(opening), text)):
        depth, quoted, i = 0, False, start
        while i < len(text):
            ch = text[i]
            if quoted:
                if ch == "\\":
                    i += 1
                elif ch == '"':
                    quoted = False
            elif ch == '"':
                quoted = True
            elif ch == opening:
                depth += 1
            elif ch == closing:
                depth -= 1
                if depth == 0:
                    yield text[start : i + 1]
                    break
            i += 1


def find_json(text: str | None, keys: tuple[str, ...] = (), kind: type = dict):
    """The first JSON object (with all keys) or list in a model's answer: fenced, the whole, or in the prose."""
    text = text or ""
    fenced = re.findall(r"```(?:[A-Za-z]*)\s*(.*?)```", text, re.S)
    marks = ("{", "}") if kind is dict else ("[", "]")
    for candidate in [*fenced, text, *balanced(text, *marks)]:
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, kind) and (kind is list or all(k in value for k in keys)):
            return value
    return None


def valid_grade(value: dict | None) -> dict | None:
    """The grade with its types made right, or None: four numbers, and a verdict of pass or fail."""
    if not isinstance(value, dict) or not isinstance(value.get("scores"), dict):
        return None
    try:
        scores = {k: float(value["scores"][k]) for k in SCORES}
    except (KeyError, TypeError, ValueError):
        return None
    verdict = str(value.get("verdict", "")).strip().lower()
    if verdict not in ("pass", "fail"):
        return None
    listed = lambda x: [str(v) for v in x] if isinstance(x, list) else [str(x)] if x else []
    return {"scores": scores, "verdict": verdict, "feedback": str(value.get("feedback") or ""), "notes": str(value.get("notes") or ""), "tags": listed(value.get("tags")), "missing_facts": listed(value.get("missing_facts"))}


def grade(answer: Column) -> Column:
    """The struct VERDICT of a judge's answer, null if it has none."""

    def run(answers: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(g) if (g := valid_grade(find_json(a, ("scores",)))) else None for a in answers], dtype=object)

    return F.from_json(F.pandas_udf(run, "string")(answer), VERDICT)


def judged(answer: Column) -> Column:
    """struct<score, verdict> of an evaluation judge's answer."""

    def run(answers: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({"score": v["score"], "verdict": v["verdict"]}) if (v := find_json(a, ("score", "verdict"))) else None for a in answers], dtype=object)

    return F.from_json(F.pandas_udf(run, "string")(answer), "score double, verdict string")


def question_list(answer: Column) -> Column:
    """array<struct<question, answer>> of a generator's answer."""

    def run(answers: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(v) if (v := find_json(a, kind=list)) is not None else None for a in answers], dtype=object)

    return F.from_json(F.pandas_udf(run, "string")(answer), "array<struct<question:string,answer:string>>")


def retained(graded: DataFrame, least: float = 0.7) -> DataFrame:
    return graded.where((F.col("judge.scores.overall") >= least) & (F.col("judge.verdict") == "pass"))


def validated(records: DataFrame, least: int = 1) -> DataFrame:
    """One row: records, mean and median of overall scores, fields that some record lacks, and whether there are enough.
    Questions and answers may be under their other names."""
    q = F.coalesce(*[F.col(c) for c in ("question", "prompt") if c in records.columns], F.lit(None).cast("string"))
    a = F.coalesce(*[F.col(c) for c in ("answer", "completion") if c in records.columns], F.lit(None).cast("string"))
    lacks = lambda c, n: F.when(F.max(F.coalesce(F.trim(c), F.lit("")) == ""), n)
    return records.agg(F.count("*").alias("n"), F.avg("overall").alias("mean"), F.median("overall").alias("median"), F.array_compact(F.array(lacks(q, "question"), lacks(a, "answer"))).alias("missing"), (F.count("*") >= least).alias("enough"))


def first_questions(rows: DataFrame, order: str) -> DataFrame:
    """The first of equal questions, blanks around them aside."""
    first = F.row_number().over(Window.partitionBy(F.trim("question")).orderBy(order))
    return rows.withColumn("_n", first).where((F.col("_n") == 1) & (F.trim("question") != "")).drop("_n")


def split_by_hash(rows: DataFrame, key: Column, ratio: float, seed: str = "42") -> DataFrame:
    """rows with part, train or eval: a row's digest decides, so parts are near the ratio, need no order, and a row
    stays in its part when others come."""
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return rows.withColumn("part", F.when(unit < ratio, "train").otherwise("eval"))


def split_exact(rows: DataFrame, position: str, ratio: float, seed: int = 42) -> DataFrame:
    """The split that a seeded shuffle of the row numbers gives, cut at int(n * ratio). The numbers (not the rows) are
    permuted on the driver: for data sets of up to some millions of rows."""
    n = rows.count()
    order = list(range(n))
    random.Random(seed).shuffle(order)
    place = rows.sparkSession.createDataFrame(pd.DataFrame({"_row": order, "_at": range(n)}), "_row long, _at long")
    numbered = rows.withColumn("_row", F.row_number().over(Window.orderBy(position)) - 1)
    return numbered.join(place, "_row").withColumn("part", F.when(F.col("_at") < int(n * ratio), "train").otherwise("eval")).drop("_row", "_at")


def seeded_sample(rows: DataFrame, key: Column, k: int, by: list[str] | None = None, seed: str = "42") -> DataFrame:
    """k rows (of each value of by) with the smallest digests."""
    rows = rows.withColumn("_d", F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256))
    if not by:
        return rows.orderBy("_d").limit(k).drop("_d")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_d"))).where(F.col("_n") <= k).drop("_n", "_d")


def quotas(rows: DataFrame, tag: str, order: str, per_tag: int = 10, total: int = 50) -> DataFrame:
    """At most per_tag rows of each tag, taken in turns, total in all."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(tag).orderBy(order))).where(F.col("_n") <= per_tag)
    return ranked.orderBy("_n", tag, order).limit(total).drop("_n")


def permutation(seed: str, n: int) -> list[int]:
    """An order of n letters drawn from a text's SHA-256, by division of the number it spells."""
    import hashlib

    number, left, out = int(hashlib.sha256(seed.encode()).hexdigest(), 16), list(range(n)), []
    while left:
        number, at = divmod(number, len(left))
        out.append(left.pop(at))
    return out


def package_summary(records: DataFrame, order: str, samples: int = 5, width: int = 120) -> DataFrame:
    """One row: the number of records and the first questions, cut short."""
    few = records.orderBy(order).limit(samples).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.substring("question", 1, width).alias("q")))), lambda x: x["q"]).alias("samples"))
    return records.agg(F.count("*").alias("n")).crossJoin(few)


def last_turns(turns: DataFrame, most: int = 50, width: int = 32_768) -> DataFrame:
    """The last turns of each conversation, cut to width, of conversations whose last turn is the user's."""
    w = Window.partitionBy("conv_id")
    known = turns.where(F.col("role").isNotNull() & F.col("text").isNotNull())
    rows = known.withColumn("_back", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("_last", F.max_by("role", "turn").over(w))
    return rows.where((F.col("_back") <= most) & (F.col("_last") == "user")).withColumn("text", F.substring("text", 1, width)).drop("_back", "_last")


def training_text(turns: DataFrame, system: str = "") -> DataFrame:
    """A text for each conversation: the turns in order, each after its role."""
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    head = [F.lit(f"<|system|>\n{system}")] if system else []
    return turns.groupBy("conv_id").agg(F.concat_ws("\n", *head, F.transform(ordered, lambda x: x["line"])).alias("text"))


def context_blocks(docs: Column, most: int, width: int = 1000, rule: str = "\n\n---\n\n") -> Column:
    """The first documents (structs of title and content) as blocks, contents cut."""
    return F.array_join(F.transform(F.slice(docs, 1, most), lambda d: F.concat(F.lit("["), d["title"], F.lit("]\n"), F.substring(d["content"], 1, width))), rule)


def code_findings(code: Column) -> Column:
    """struct<valid, errors, warnings, profiles> of a script: braces, commands outside their events, costly words."""
    low = F.lower(code)
    has = lambda s: F.contains(low, F.lit(s))
    opened, closed = (F.length(code) - F.length(F.replace(code, F.lit(b), F.lit(""))) for b in "{}")
    request = low.rlike(r"when\s+http_request\s+\{") | low.rlike(r"when\s+http_response\s+\{")
    errors = F.array_compact(F.array(F.when(opened != closed, F.format_string("mismatched braces: %d open, %d close", opened, closed))))
    warnings = F.array_compact(F.array(
        F.when(has("http::") & ~request, "http commands without an http event"), F.when(low.rlike(r"when\s+client_accepted\s+\{") & has("http::"), "http commands beside client_accepted"),
        F.when(has("regexp"), "regexp is costly"), F.when(has("table set") | has("table add"), "table entries need timeouts"),
    ))
    profiles = F.array_compact(F.array(F.when(has("http::"), "http"), F.when(has("ssl::"), "clientssl or serverssl"), F.when(has("persist "), "persistence")))
    return F.struct((opened == closed).alias("valid"), errors.alias("errors"), warnings.alias("warnings"), profiles.alias("profiles"))
