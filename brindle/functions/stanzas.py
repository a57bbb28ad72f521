"""Configuration texts of nested braces, and command outputs in stanzas and tables, to records."""

from __future__ import annotations

import re
from collections.abc import Iterator


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """(header, body) of each `header {` ... `}` at the top level. Braces in quotes and comments don't count."""
    at, n = 0, len(text)
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end]
        bare = line.strip()
        if not bare or bare.startswith("#") or "{" not in line:
            at = end + 1
            continue
        depth, quoted, i, opened = 0, False, at, None
        while i < n:
            ch = text[i]
            if ch == "\\":
                i += 1
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch == "{":
                depth += 1
                opened = i if opened is None else opened
            elif not quoted and ch == "}":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        if opened is None:
            at = end + 1
            continue
        yield text[at:opened].strip(), text[opened + 1 : i]
        at = i + 1


def attributes(body: str) -> dict:
    """A body as a tree: `key value`, `key { ... }` (a tree, or a list if it only has bare words), bare keys as ''."""
    out: dict = {}
    at, inner = 0, body
    nested = {h: b for h, b in blocks(inner)}
    rest = inner
    for header, own in nested.items():
        start = rest.find(header)
        stop = rest.find(own, start + len(header)) + len(own)
        stop = rest.find("}", stop) + 1
        rest = rest[:start] + rest[stop:]
        single = own.strip()
        if single and "\n" not in own and "{" not in single:
            out[header] = single.split()
        elif single and all(len(x.split()) == 1 and "{" not in x for x in single.split("\n")):
            out[header] = [x.strip() for x in single.split("\n")]
        else:
            out[header] = attributes(own)
    for line in rest[at:].split("\n"):
        words = line.strip().split(None, 1)
        if words and words[0] not in ("}", "{"):
            out[words[0]] = words[1].strip().strip('"') if len(words) > 1 else ""
    return out


def objects(text: str) -> Iterator[dict]:
    """Flat rows of a configuration: module, kind, path, partition, folder, name, body and the tree of attributes.

    A header is `module kind... path`; paths begin with /; objects without a path are named by their last word.
    Bodies of code (kind rule) stay as they are.
    """
    for header, body in blocks(re.sub(r"(?m)^\s*#(?![\w-]+\s*\{).*$", "", text)):
        words = header.split()
        path = words[-1] if len(words) > 1 else ""
        parts = [p for p in path.split("/") if p] if path.startswith("/") else [path] if path else []
        kind = " ".join(words[1:-1]) or (words[0] if len(words) == 1 else "")
        code = kind.split()[-1:] == ["rule"]
        yield {
            "module": words[0], "kind": kind, "path": path, "partition": parts[0] if path.startswith("/") and len(parts) > 1 else "", "folder": "/".join(parts[1:-1]) if path.startswith("/") else "",
            "name": parts[-1] if parts else "", "body": body.strip("\n"), "attributes": {} if code else attributes(body),
        }


def endpoint(text: str) -> tuple[str, int]:
    """Address and port of `address:port` (or address.port for IPv6); a port that is no number is 0."""
    address, _, port = text.rpartition(":") if text.count(":") <= 1 else text.rpartition(".")
    address = address or port
    return address.rsplit("/", 1)[-1], int(port) if port.isdigit() else 0


def pools(text: str) -> Iterator[dict]:
    """Pools with their members, and where each member is."""
    for o in objects(text):
        if (o["module"], o["kind"]) == ("ltm", "pool"):
            members = o["attributes"].get("members") or {}
            rows = []
            for name, own in members.items() if isinstance(members, dict) else ():
                host, port = endpoint(name)
                rows.append({"name": name, "address": own.get("address", host) if isinstance(own, dict) else host, "port": port})
            yield {"path": o["path"], "name": o["name"], "monitor": str(o["attributes"].get("monitor", "")), "members": rows}


def virtual_servers(text: str) -> Iterator[dict]:
    for o in objects(text):
        if (o["module"], o["kind"]) == ("ltm", "virtual"):
            a = o["attributes"]
            address, port = endpoint(str(a.get("destination", "")))
            listed = lambda x: list(x) if isinstance(x, dict | list) else []
            yield {"path": o["path"], "name": o["name"], "destination": str(a.get("destination", "")), "address": address, "port": port, "pool": str(a.get("pool", "")), "profiles": listed(a.get("profiles")), "rules": listed(a.get("rules"))}


def key_values(text: str) -> dict[str, str]:
    """`k: v` and `k=v` lines, keys in lower case, the first of equal keys."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        m = re.match(r"\s*([^:=]+?)\s*[:=]\s*(.*?)\s*$", line)
        if m and m[1]:
            out.setdefault(m[1].lower(), m[2].strip('"'))
    return out


def table_rows(text: str) -> list[dict[str, str]]:
    """Rows of a table that a command line prints: names over a line of dashes, whose groups are the columns' places.
    Lines after a blank one begin a new table; values that go beyond their column are cut there, but for the last."""
    out: list[dict[str, str]] = []
    spans: list[tuple[int, int]] = []
    names: list[str] = []
    before = ""
    for line in text.splitlines():
        if re.fullmatch(r"\s*-+(\s+-+)*\s*", line):
            starts = [m.start() for m in re.finditer(r"-+", line)]
            spans = list(zip(starts, [*starts[1:], 1 << 30], strict=True))
            names = [before[a:z].strip().lower().replace(" ", "_") for a, z in spans]
        elif not line.strip():
            spans = []
        elif spans:
            out.append({n: line[a:z].strip() for n, (a, z) in zip(names, spans, strict=True)})
        before = line
    return out


def stanzas(text: str, header: str) -> list[dict[str, str]]:
    """Records that begin at lines matching header (whose groups are name, or name and value) and end at the next line
    that isn't indented; indented `key value` lines are fields, later ones winning."""
    out: list[dict[str, str]] = []
    on = False
    for line in text.splitlines():
        m = re.match(header, line)
        if m:
            out.append({"name": m[1], **({"value": m[2]} if len(m.groups()) > 1 and m[2] else {})})
            on = True
        elif line[:1] not in (" ", "\t"):
            on = False
        elif on and line.strip():
            k, _, v = line.strip().partition(" ")
            k, v = (f"{k} {v.split(' ', 1)[0]}", v.split(" ", 1)[1].strip()) if k == "state" and " " in v else (k, v.strip())
            out[-1][k] = v.strip('"')
    return out


def unhealthy(text: str) -> list[dict[str, str]]:
    """Rows of a health table that are unhealthy: component (carried on where it is a dash), severity (the last of
    critical, error, warning) and description. Rows without either of the last two go."""
    out, component = [], ""
    for line in text.splitlines():
        words = line.split()
        if "unhealthy" not in words or len(words) < 3:
            continue
        component = words[0] if words[0] != "-" else component
        severities = [w for w in words if w in ("critical", "error", "warning")]
        states = [i for i, w in enumerate(words) if w in ("unhealthy", "ok")]
        stop = states[1] if len(states) > 1 else len(words)
        about = " ".join(w for w in words[states[0] + 1 : stop] if w not in ("critical", "error", "warning", "info", "-"))
        if about and severities and component:
            out.append({"component": component, "health": "unhealthy", "severity": severities[-1], "description": about})
    return out


def snapshot_path(path: str) -> dict[str, str] | None:
    """Roles of the parts of a statistics file's path: family, root, blade, type, interval, scope, segment."""
    parts = [p for p in path.split("/") if p]
    if "tmstat" not in parts or parts.index("tmstat") + 1 == len(parts):
        return None
    at = parts.index("tmstat")
    tail = parts[at + 1 :]
    out = dict.fromkeys(("family", "root", "blade", "type", "interval", "scope", "segment"), "")
    out |= {"root": parts[at - 1] if at else "", "segment": tail[-1]}
    if tail[0] == "snapshots":
        out["family"] = "snapshot"
        for p in tail[1:-1]:
            out["interval" if p.isdigit() else "blade" if re.match(r"blade\d+$", p) else "type"] = p
    else:
        out |= {"family": "segment", "scope": tail[0]}
        if m := re.match(r"(blade\d+)-(\w+)$", tail[-1]):
            out |= {"blade": m[1], "type": m[2]}
    return out
