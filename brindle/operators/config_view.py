"""Views over configuration objects: chains from member to virtual server, applications, partitions."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import stanzas as Z

_OBJECT = "source string, module string, kind string, path string, partition string, folder string, name string, body string, attributes string"


def objects(texts: DataFrame) -> DataFrame:
    """Objects of configuration texts (source, text); attributes as a JSON text, which variant functions read."""
    names = [x.split()[0] for x in _OBJECT.split(", ")]

    def run(batches):
        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [[source, *(o[n] for n in names[1:-1]), json.dumps(o["attributes"])] for o in Z.objects(text or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    return texts.select("source", "text").mapInArrow(run, _OBJECT)


def pools(texts: DataFrame) -> DataFrame:
    """(source, path, name, monitor, members array<struct<name,address,port>>)."""
    schema = "source string, path string, name string, monitor string, members array<struct<name:string,address:string,port:int>>"

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame([{"source": r.source, **p} for r in pdf.itertuples() for p in Z.pools(r.text or "")], columns=["source", "path", "name", "monitor", "members"])

    return texts.select("source", "text").mapInPandas(run, schema)


def virtual_servers(texts: DataFrame) -> DataFrame:
    schema = "source string, path string, name string, destination string, address string, port int, pool string, profiles array<string>, rules array<string>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame([{"source": r.source, **v} for r in pdf.itertuples() for v in Z.virtual_servers(r.text or "")], columns=names)

    return texts.select("source", "text").mapInPandas(run, schema)


def chain(pool_rows: DataFrame, servers: DataFrame, address: str) -> DataFrame:
    """Member, pool and virtual server of members whose name or address is, or contains, the address; (none) where no
    server uses the pool. Few members pass the filter before the join."""
    m = pool_rows.select("source", F.col("path").alias("pool_path"), F.col("name").alias("pool_name"), F.explode("members").alias("m"))
    m = m.where((F.col("m.address") == address) | F.contains("m.name", F.lit(address)))
    s = servers.select(F.col("source").alias("_s"), F.col("path").alias("server"), "destination", F.element_at(F.split("pool", "/"), -1).alias("_name"), F.col("pool").alias("_pool"))
    joined = m.join(s, (F.col("source") == F.col("_s")) & (F.col("pool_name") == F.col("_name")) & ((F.col("_pool") == F.col("pool_path")) | F.col("pool_path").endswith(F.concat(F.lit("/"), F.col("_name")))), "left")
    return joined.select("source", F.col("m.name").alias("member"), F.col("pool_path").alias("pool"), F.coalesce("server", F.lit("(none)")).alias("server"), "destination")


def partitions(rows: DataFrame) -> DataFrame:
    """Common, partitions that are declared, and those of objects, by source."""
    declared = rows.where("module = 'auth' AND kind = 'partition'").select("source", F.col("name").alias("partition"))
    common = rows.select("source", F.lit("Common").alias("partition"))
    return common.union(declared).union(rows.where("partition <> ''").select("source", "partition")).distinct().orderBy("source", "partition")


def apps(rows: DataFrame, partition: str | None = None) -> DataFrame:
    """Virtual servers as applications: name, path, partition, folder, destination, pool."""
    own = rows.where("module = 'ltm' AND kind = 'virtual'")
    own = own.where(F.col("path").startswith(f"/{partition}/")) if partition else own
    get = lambda k: F.get_json_object("attributes", f"$.{k}")
    return own.select("source", "name", F.col("path").alias("full_path"), "partition", "folder", get("destination").alias("destination"), get("pool").alias("pool")).orderBy("full_path")


def app_details(rows: DataFrame, full_path: str) -> DataFrame:
    """The virtual server with its pool's body and monitor, and the bodies of the objects that it names (profiles,
    rules), whatever module and kind they are of."""
    names = lambda k: F.coalesce(F.from_json(F.get_json_object("attributes", f"$.{k}"), "array<string>"), F.map_keys(F.from_json(F.get_json_object("attributes", f"$.{k}"), "map<string,string>")), F.expr("cast(array() as array<string>)"))
    vs = rows.where((F.col("path") == full_path) & (F.col("module") == "ltm") & (F.col("kind") == "virtual")).select("source", "path", F.get_json_object("attributes", "$.pool").alias("pool"), F.concat(names("profiles"), names("rules")).alias("uses"))
    pool = rows.where("module = 'ltm' AND kind = 'pool'").select(F.col("source").alias("_s"), F.col("path").alias("_p"), F.col("body").alias("pool_body"), F.get_json_object("attributes", "$.monitor").alias("monitor"))
    joined = vs.join(pool, (F.col("source") == F.col("_s")) & (F.col("pool") == F.col("_p")), "left").drop("_s", "_p")
    used = vs.select("source", F.explode("uses").alias("path")).join(rows.select("source", "path", "kind", "body"), ["source", "path"], "left")
    parts = used.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("path", "kind", "body"))).alias("parts"))
    return joined.join(parts, "source", "left").drop("uses")


def merged_context(base: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with null or empty fields filled from other, and rows that only other has."""
    a, b = base.alias("a"), other.alias("b")
    pick = lambda f: F.coalesce(F.nullif(F.col(f"a.{f}"), F.lit("")), F.col(f"b.{f}")).alias(f)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(f) for f in fields])


def health_findings(rows: DataFrame) -> DataFrame:
    """Unhealthy rows (component, severity, description) as findings."""
    severity = F.when(F.col("severity").isin("critical", "error"), "critical").otherwise("warning")
    return rows.select(F.concat(F.lit("unhealthy: "), F.col("component")).alias("rule"), severity.alias("severity"), F.lit("health").alias("category"), F.lit(1).alias("hits"), F.col("description").alias("note"))


def tallies(tenants: DataFrame) -> DataFrame:
    return tenants.groupBy("running_state", "status").agg(F.count("*").alias("n"))


def readiness(nodes: DataFrame) -> DataFrame:
    """One row: ready/total."""
    return nodes.agg(F.format_string("%d/%d ready", F.count_if("ready"), F.count("*")).alias("summary"))


def best_candidate(*values: Column) -> Column:
    """The first that isn't blank, for fields that several files may tell."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])
