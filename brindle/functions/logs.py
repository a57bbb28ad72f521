"""Log lines to rows: four line grammars, continuation lines, and the event-log grammar, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.search import severity_number

# Parts of the line formats (fixed values).
ISO_TIME = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2}))"
SHORT_TIME = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
HOST = r"(\S+)"
PROCESS = r"([^\[:\s]+)(?:\[(\d+)\])?:\s*"
PRIORITY = r"priority=\"([^\"]+)\"(?:\s+version=\S+)?(?:\s+msgid=(\S+))?(?:\s+msg=\"([^\"]*)\")?(.*)"
CODE = r"(?:([0-9a-fA-F]{8}):(\d):)?\s*"
GRAMMARS = {
    "iso_structured": rf"^{ISO_TIME}\s+{HOST}\s+{PROCESS}(?:nodename=\S+\s+)?{PRIORITY}",
    "short_structured": rf"^{SHORT_TIME}\s+{HOST}\s+{PROCESS}{PRIORITY}",
    "syslog": rf"^{SHORT_TIME}\s+{HOST}\s+(\w+)\s+{PROCESS}{CODE}(.*)",
    "iso_plain": rf"^{ISO_TIME}\s+{HOST}\s+(\w+)\s+{PROCESS}(.*)",
}
#: Groups of each grammar.
GROUPS = {"iso_structured": 8, "short_structured": 8, "syslog": 8, "iso_plain": 6}
EVENT = r'^(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"'
#: Names of priorities that differ from severities (fixed values).
PRIORITIES = {"emergency": "emerg", "critical": "crit", "error": "err", "warn": "warning"}
CONTINUATION_CAP = 32 * 1024
#: Line ends as text readers know them.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"

ENTRY = "struct<ts:timestamp_ntz,hostname:string,severity:string,severity_num:int,process:string,pid:int,msg_code:string,own_severity:int,message:string>"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _short_time(text: Column, now: Column) -> Column:
    """The year is that of now, or the one before if the day would be later than now; null for no such day."""
    parts = F.split(F.regexp_replace(text, r"\s+", " "), " ")
    months = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    month = F.array_position(months, F.get(parts, F.lit(0)))
    at = lambda y: F.try_to_timestamp(F.format_string("%d-%02d-%02d %s", y, month, F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2))), F.lit("y-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    day = F.try_to_timestamp(F.format_string("%d-%02d-%02d", F.year(now), month, F.get(parts, F.lit(1)).try_cast("int")), F.lit("y-MM-dd"))
    return F.when(month > 0, at(F.when(day > now, F.year(now) - 1).otherwise(F.year(now))))


def _iso_time(text: Column) -> Column:
    """In UTC."""
    return F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def parse_line(line: Column, now: Column) -> Column:
    """A struct ENTRY, or null. The first grammar that matches decides, even if its time is none. now is an argument,
    so that the same log always gives the same rows."""

    def entry(g, ts, severity, process, pid, code, own, message):
        name = F.lower(severity)
        for k, v in PRIORITIES.items():
            name = F.when(F.lower(severity) == k, v).otherwise(name)
        fields = [ts.alias("ts"), g(2).alias("hostname"), name.alias("severity"), severity_number(name).alias("severity_num"), process.alias("process"), pid.try_cast("int").alias("pid"), code.alias("msg_code"), own.try_cast("int").alias("own_severity"), F.coalesce(message, F.lit("")).alias("message")]
        return F.when(ts.isNotNull(), F.struct(*fields)).cast(ENTRY)

    def made(name: str):
        def of(groups: Column) -> Column:
            g = lambda i: F.nullif(F.get(groups, F.lit(i - 1)), F.lit(""))
            ts = _iso_time(g(1)) if name.startswith("iso") else _short_time(g(1), now)
            if name.endswith("structured"):
                return entry(g, ts, g(5), g(3), g(4), g(6), none, F.coalesce(g(7), F.trim(g(8))))
            if name == "syslog":
                return entry(g, ts, g(3), g(4), g(5), g(6), g(7), g(8))
            return entry(g, ts, g(3), g(4), g(5), none, none, g(6))

        return of

    # A grammar's groups are taken out by one replacement and bound by a lambda, so that each line is matched once.
    none, out = F.lit(None).cast("string"), F.lit(None).cast(ENTRY)
    for name in reversed(list(GRAMMARS)):
        groups = F.split(F.regexp_replace(line, GRAMMARS[name], "\u0001".join(f"${i}" for i in range(1, GROUPS[name] + 1))), "\u0001")
        out = F.when(line.rlike(GRAMMARS[name]), F.get(F.transform(F.array(groups), made(name)), F.lit(0))).otherwise(out)
    return out


def effective_severity(own: Column, severity_num: Column) -> Column:
    return F.coalesce(own, severity_num)


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(source_file, line_number, line) of files (source_file, content)."""
    return files.select("source_file", F.posexplode(F.split(content, LINE_ENDS)).alias("i", "line")).select("source_file", (F.col("i") + 1).alias("line_number"), "line")


def parse_logs(numbered: DataFrame, now: Column, cap: int = CONTINUATION_CAP) -> DataFrame:
    """Rows of log lines (source_file, line_number, line): each entry with the indented lines after it, up to cap
    characters (tested before a line is added); other lines that are no entries go, and don't close an entry."""
    w = Window.partitionBy("source_file").orderBy("line_number")
    parsed = numbered.withColumn("entry", parse_line(F.col("line"), now)).withColumn("n", F.count("entry").over(w))
    more = F.col("entry").isNull() & F.col("line").rlike(r"^[ \t]") & (_strip(F.col("line")) != "")
    parsed = parsed.where((F.col("n") > 0) & (F.col("entry").isNotNull() | more))
    inside = Window.partitionBy("source_file", "n").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("entry").isNull(), F.length("line") + 1)).over(inside), F.lit(0))
    parsed = parsed.withColumn("over", F.col("entry").isNull() & (before >= cap))
    text = lambda own: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("over"), F.struct("line_number", own.alias("t"))))), lambda x: x["t"]), "\n")
    mark = F.when(F.max("over"), F.lit(f"\n…[continuation truncated at {cap} bytes]")).otherwise("")
    found = parsed.groupBy("source_file", "n").agg(
        F.min("line_number").alias("line_number"), F.first("entry", ignorenulls=True).alias("entry"),
        F.concat(text(F.when(F.col("entry").isNotNull(), F.col("entry.message")).otherwise(_strip(F.col("line")))), mark).alias("message"), F.concat(text(F.col("line")), mark).alias("raw_line"),
    )
    names = ["ts", "hostname", "severity", "severity_num", "process", "pid", "msg_code", "own_severity"]
    return found.select("source_file", "line_number", *[F.col(f"entry.{c}").alias(c) for c in names], "message", "raw_line")


def parse_events(numbered: DataFrame) -> DataFrame:
    """Rows of event-log lines; times are cut to microseconds."""
    line = _strip(F.col("line"))
    g = lambda i: F.regexp_extract(line, EVENT, i)
    kind, event = F.lower(g(5)), F.lower(g(3))
    severity = F.when(kind.isin("critical", "crit"), "crit").when(kind.isin("error", "err"), "err").when(kind.isin("warning", "warn") | (event == "assert"), "warning").otherwise("notice")
    found = numbered.where(line.rlike(EVENT)).select(
        "source_file", "line_number", F.trim(F.replace(g(7), F.lit(" UTC"), F.lit(""))).try_cast("timestamp_ntz").alias("ts"), g(2).alias("hostname"), severity.alias("severity"), severity_number(severity, 5).alias("severity_num"),
        g(3).alias("process"), F.lit(None).cast("int").alias("pid"), g(1).alias("msg_code"), F.lit(None).cast("int").alias("own_severity"), g(6).alias("message"), line.alias("raw_line"),
    )
    return found.where("ts is not null")


def merged(*logs: DataFrame) -> DataFrame:
    """All rows in order of time, then file and line."""
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return out.orderBy("ts", "source_file", "line_number")
