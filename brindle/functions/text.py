"""Text expressions: cleaning, keys for de-duplication, tokens of code, chunks, urls."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of tokens in code and questions (fixed values).
COMMAND = r"\b([A-Z][A-Z0-9_:]*::[A-Za-z0-9_:-]+)"
EVENT = r"\bwhen\s+([A-Z][A-Z0-9_]+)\b"
SPACED_COMMAND = r"\b([A-Z][A-Z0-9_:]*)\s+::\s+([A-Za-z0-9_:-]+)"
WORD_OPERATORS = ("contains", "ends_with", "equals", "matches_glob", "matches_regex", "starts_with", "switch", "and", "not", "or")
SYMBOL_OPERATORS = ("~", "!", "*", "/", "%", "+", "-", "<<", ">>", "<", ">", "<=", ">=", "==", "!=", "eq", "ne", "&", "^", "|", "&&", "||")

#: Space characters as Unicode has them.
_SPACES = r"[\s\x1C-\x1F\x85   -     　]+"


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def sanitize(text: Column, snippets: tuple[str, ...] = ()) -> Column:
    """Without the given snippets (whatever their case and spacing), with plain spaces, and without blank lines."""
    import re

    for s in snippets:
        text = F.regexp_replace(text, "(?i)" + r"\s+".join(re.escape(w) for w in s.split()), " ")
    text = F.translate(text, " ¶", " ")
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), collapse_spaces)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def dedupe_key(text: Column, length: int = 40) -> Column:
    return F.substring(F.replace(F.lower(text), F.lit(" "), F.lit("")), 1, length)


def title_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def distinct_ordered(items: Column) -> Column:
    """Items with spaces collapsed, each once, in order of first sight, without empty ones."""
    return F.array_distinct(F.filter(F.transform(items, collapse_spaces), lambda x: x != ""))


def commands(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(COMMAND), F.lit(1))))


def declared_events(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(EVENT), F.lit(1))))


def known_events(text: Column, events: Column) -> Column:
    return F.array_sort(F.filter(events, lambda e: F.contains(text, e)))


def operators(text: Column) -> Column:
    words = [F.when(F.lower(text).rlike(rf"\b{w}\b"), F.lit(w)) for w in WORD_OPERATORS]
    return F.array_sort(F.array_compact(F.array(*words, *[F.when(F.contains(text, F.lit(s)), F.lit(s)) for s in SYMBOL_OPERATORS])))


def join_commands(text: Column) -> Column:
    return F.regexp_replace(text, SPACED_COMMAND, "$1::$2")


def capital_tokens(text: Column) -> Column:
    """Words in capitals with an underscore: names of events, as prose has them."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9_]+)\b"), F.lit(1)), lambda x: F.contains(x, F.lit("_"))))


def strip_tags(html: Column) -> Column:
    return collapse_spaces(unescape(F.regexp_replace(html, "<[^>]+>", " ")))


def unescape(text: Column) -> Column:
    """Named entities (those of HTML, with a semicolon) and numeric ones as their characters, each once; others stay."""
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    valid = lambda code: F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), code)

    def shown(token: Column) -> Column:
        name = F.regexp_extract(token, r"^&(.*);$", 1)
        decimal, hexadecimal = F.regexp_extract(name, r"^#([0-9]{1,7})$", 1).try_cast("bigint"), F.regexp_extract(name, r"^#[xX]([0-9a-fA-F]{1,6})$", 1)
        number = F.coalesce(decimal, F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10).try_cast("bigint"))
        return F.coalesce(F.try_element_at(names, name), char(valid(number)), token)

    tokens = F.regexp_extract_all(text, F.lit(r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&)"), F.lit(1))
    known = F.transform(tokens, lambda t: F.when(t.startswith("&") & t.endswith(";"), shown(t)).otherwise(t))
    return F.when(F.contains(text, F.lit("&")), F.array_join(known, "")).otherwise(text)


def page_title(html: Column) -> Column:
    own = lambda tag: F.nullif(collapse_spaces(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return F.coalesce(own("title"), F.nullif(strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")), F.lit(""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def resolve(base: Column, link: Column) -> Column:
    """The link as seen from the page at base, without its fragment: absolute, host-relative, query or sibling."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(bare.rlike("^[^/]*//[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    joined = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link)).when(link.startswith("?"), F.concat(bare, link)).when(link == "", F.regexp_replace(base, "#.*$", "")).otherwise(F.concat(folder, link))
    )
    plain = F.regexp_replace(joined, r"(?<=/)\./", "")
    for _ in range(4):
        plain = F.regexp_replace(plain, r"/[^/:?]+/\.\./", "/")
    return plain


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def allowed_links(base: Column, html: Column, domains: list[str]) -> Column:
    """Links of a page over http to one of the hosts, each once, in order."""
    found = F.transform(hrefs(html), lambda x: resolve(base, x))
    return F.array_distinct(F.filter(found, lambda x: x.rlike("^https?://") & host(x).isin(*domains)))


def allowed_extension(url: Column, extensions: tuple[str, ...]) -> Column:
    p = F.lower(path(url))
    out = (p == "") | p.endswith("/")
    for e in extensions:
        out = out | p.endswith(e.lower())
    return out


def skipped_content_type(kind: Column, allowed: tuple[str, ...] = ("text/html", "application/xhtml")) -> Column:
    ok = F.lit(False)
    for a in allowed:
        ok = ok | F.contains(F.lower(kind), F.lit(a))
    return F.when(F.coalesce(kind, F.lit("")) == "", False).otherwise(~ok)


def file_name(url: Column) -> Column:
    """The path with / as _, index if there is none, of 200 characters at most."""
    own = F.regexp_replace(F.regexp_replace(path(url), "^/+|/+$", ""), "/", "_")
    return F.substring(F.when(own == "", "index").otherwise(own), 1, 200)


def slug(text: Column, length: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)


def entity_path(name: Column) -> Column:
    return F.concat(F.replace(name, F.lit("::"), F.lit("__")), F.lit(".html"))


def cut_at_first(text: Column, markers: tuple[str, ...]) -> Column:
    """The text before the first of the markers."""
    at = F.array_min(F.array_compact(F.array(*[F.nullif(F.locate(m, text), F.lit(0)) for m in markers])))
    return F.trim(F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1)))


def without_thoughts(text: Column) -> Column:
    """Without think blocks and code fences around the whole."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?m)^```[A-Za-z]*\s*$", ""), r"^\s+|\s+$", "")


def char_chunks(text: Column, size: int = 3000, overlap: int = 300, most: int | None = 8) -> Column:
    """array<struct<i, chunk>>: one chunk up to size characters (even an empty one), else windows a step apart; at most
    so many, if most is given."""
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step) if most is None else F.ceil(n / step))
    count = count if most is None else F.least(count, F.lit(most))
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))


def sliding_chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """array<struct<start, stop, chunk>>: windows until the end is covered; none for an empty text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the size")
    step, n = size - overlap, F.length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("stop"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))
    return F.when(count > 0, spans).otherwise(F.slice(spans, 1, 0))


def token_chunks(tokens: Column, size: int = 512, overlap: int = 64, least_chars: int = 120, joint: str = " ") -> Column:
    """array<struct<start, stop, chunk>> over an array of tokens; stop isn't clipped; short chunks go."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(step))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + size).alias("stop"), F.trim(F.array_join(F.slice(tokens, s + 1, size), joint)).alias("chunk")))
    return F.filter(made, lambda c: F.length(c["chunk"]) >= least_chars)
