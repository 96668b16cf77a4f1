"""Reads nested structure from JavaScript and TypeScript text without a parser.

Only balanced brackets, strings, comments and tags are understood, which is enough for
route tables, nested route elements and decorated classes. Computed values are not
followed; unbalanced text gives what was read so far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

_OPEN, _CLOSE = "([{", ")]}"
_STRING = re.compile(r"^([\"'`])((?:\\.|(?!\1).)*)\1$", re.S)


def without_comments(text: str) -> str:
    """The text with comments blanked; strings are kept."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c in "\"'`":
            j = i + 1
            while j < n and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = n if end < 0 else end + 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``; the end of the text if none does."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            i += 1
            while i < len(text) and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return len(text)


def parts(body: str) -> list[str]:
    """The comma-separated parts of a bracket's body, at its own level."""
    out, start, i = [], 0, 0
    while i < len(body):
        c = body[i]
        if c in "\"'`":
            i += 1
            while i < len(body) and body[i] != c:
                i += 2 if body[i] == "\\" else 1
        elif c in _OPEN:
            i = closing(body, i)
        elif c == ",":
            out.append(body[start:i])
            start = i + 1
        i += 1
    out.append(body[start:])
    return [p.strip() for p in out if p.strip()]


def fields(obj: str) -> dict[str, str]:
    """Key -> value text of an object literal."""
    out = {}
    for part in parts(obj.strip()[1:-1] if obj.strip().startswith("{") else obj):
        m = re.match(r"^[\"']?([\w$]+)[\"']?\s*(?::\s*(.*))?$", part, re.S)
        if m:
            out[m[1]] = (m[2] or m[1]).strip()
    return out


def string(value: str | None) -> str | None:
    m = _STRING.match(value.strip()) if value else None
    return m[2] if m else None


def join_paths(parent: str, path: str) -> str:
    if path.startswith("/"):
        full = path
    else:
        full = parent.rstrip("/") + "/" + path
    full = re.sub(r"/{2,}", "/", full)
    return full[:-1] if len(full) > 1 and full.endswith("/") else full or "/"


def _object_routes(array: str, parent: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    for part in parts(array.strip()[1:-1]):
        if not part.startswith("{"):
            continue
        f = fields(part)
        path, index = string(f.get("path")), f.get("index") == "true"
        full = parent if path is None else join_paths(parent, path)
        kids = f.get("children", "")
        tags = tuple(sorted(k for k in ("loader", "action", "lazy", "errorElement", "canActivate", "canMatch", "resolve", "loadChildren", "loadComponent", "redirectTo", "outlet") if k in f))
        if path is not None or index:
            kind = "redirect" if "redirectTo" in f else "error" if "errorElement" in f else "catch-all" if path in ("*", "**") else "layout" if kids.startswith("[") and path else "page"
            yield full, kind, tags
        if kids.startswith("["):
            yield from _object_routes(kids, full)


_ROUTE_START = re.compile(r"<(/?)Route\b")
#: A tag longer than this is not read.
_TAG_LENGTH = 2000


def _tags(text: str) -> list[tuple[bool, str, bool]]:
    """(is an end tag, attribute text, closes itself) of the Route tags of a text."""
    out = []
    for m in _ROUTE_START.finditer(text):
        window, i = text[m.end() : m.end() + _TAG_LENGTH], 0
        while i < len(window) and window[i] not in "><":
            if window[i] in "\"'`":
                end = window.find(window[i], i + 1)
                i = len(window) if end < 0 else end
            elif window[i] in _OPEN:
                i = closing(window, i)
            i += 1
        if i < len(window) and window[i] == ">":
            inner = window[:i]
            out.append((bool(m[1]), inner.rstrip("/"), inner.endswith("/")))
    return out


_ATTRIBUTE = re.compile(r"(\w+)(?:\s*=\s*(?:\{?\s*[\"']([^\"']*)[\"']\s*\}?|\{))?")


def _tag_routes(text: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    stack = ["/"]
    found = _tags(text)
    for k, (is_end, inner, alone) in enumerate(found):
        if is_end:
            if len(stack) > 1:
                stack.pop()
            continue
        attributes = {a[1]: a[2] for a in _ATTRIBUTE.finditer(inner)}
        path, index = attributes.get("path"), "index" in attributes
        full = stack[-1] if path is None else join_paths(stack[-1], path)
        has_children = not alone and k + 1 < len(found) and not found[k + 1][0]
        if path is not None or index:
            kind = "error" if "errorElement" in attributes else "catch-all" if path == "*" else "layout" if has_children and path else "page"
            yield full, kind, tuple(sorted(a for a in attributes if a in ("loader", "action", "lazy", "errorElement", "handle", "Component")))
        if not alone:
            stack.append(full)


_TABLE = re.compile(r"(?:create(?:Browser|Hash|Memory)Router|useRoutes|RouterModule\.for(?:Root|Child)|provideRouter)\s*\(\s*(?=\[)|(?:const|let|var)\s+\w+\s*:\s*(?:Routes?|RouteObject)(?:\[\])?\s*=\s*(?=\[)|\broutes\s*:\s*(?=\[)")


def routes(text: str | None) -> list[tuple[str, str, tuple[str, ...]]]:
    """(path, type, tags) of nested route elements and route tables."""
    if not text or ("Route" not in text and "route" not in text):
        return []
    clean = without_comments(text)
    out = list(_tag_routes(clean))
    at = 0
    while m := _TABLE.search(clean, at):
        at = closing(clean, m.end()) + 1
        out += _object_routes(clean[m.end() : at], "/")
    return list(dict.fromkeys(out))


_DECORATOR = re.compile(r"@(Component|Directive|Injectable|NgModule|Pipe|Prop|Event|Method|State|Input|Output)\s*\(")
_CLASS = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)")
_MEMBER = re.compile(r"\s*(?:(?:public|private|readonly|async|static)\s+)*(\w+)[!?]?\s*(?::\s*([^=;{\n]+))?")
_SLOT = re.compile(r"<slot\b(?:[^<>]*?\bname\s*=\s*[\"']([^\"'<>]*)[\"'])?[^<>]*>")


def members(text: str | None) -> list[tuple[str, str, str, str]]:
    """(owner, kind, name, detail) of decorated classes and members; slots count with their owner.

    The owner is the tag or selector of the class, else its name; detail is the type,
    or for classes the options that matter to users.
    """
    if not text or "@" not in text:
        return []
    clean = without_comments(text)
    owner, out, end = "", [], -1
    while m := _DECORATOR.search(clean, end + 1):
        end = closing(clean, m.end() - 1)
        if end - m.end() > 50_000 or end == len(clean):
            break
        argument, after = clean[m.end() : end].strip(), clean[end + 1 : end + 400]
        options = fields(argument) if argument.startswith("{") else {}
        kind = m[1].lower()
        if kind in ("component", "directive", "injectable", "ngmodule", "pipe"):
            c = _CLASS.match(after)
            owner = string(options.get("tag")) or string(options.get("selector")) or string(options.get("name")) or (c[1] if c else "")
            detail = ",".join(f"{k}={options[k]}" for k in ("shadow", "standalone", "changeDetection", "providedIn") if k in options)
            out.append((owner, kind, c[1] if c else "", detail))
            if kind == "component" and "tag" in options:
                following = re.compile(r"@Component\s*\(").search(clean, end)
                body = clean[end : following.start() if following else len(clean)]
                out += [(owner, "slot", s[1] or "", "") for s in _SLOT.finditer(body)]
        elif (n := _MEMBER.match(after)) and owner:
            name = string(options.get("eventName")) or n[1]
            out.append((owner, kind, name, (n[2] or "").strip()))
    return list(dict.fromkeys(out))


def export_paths(exports, prefix: str = "") -> list[str]:
    """Subpaths that an exports field of a manifest offers; conditions are looked through."""
    if not exports:
        return []
    if isinstance(exports, str):
        return [prefix or "."]
    if isinstance(exports, dict):
        return list(dict.fromkeys(p for k, v in exports.items() if k.startswith(".") or isinstance(v, (str, dict)) for p in export_paths(v, k if k.startswith(".") else prefix)))
    return []


def flatten_keys(value, prefix: str = "") -> list[str]:
    """Dotted keys of the leaves of a nested object (translation files)."""
    if not isinstance(value, dict):
        return [prefix] if prefix else []
    return [k for key, child in value.items() for k in flatten_keys(child, f"{prefix}.{key}" if prefix else key)]


def read_sources(blobs: DataFrame) -> DataFrame:
    """changeset_id, path, side, relation (route, member, export or key), a, b, c, d read from source texts.

    blobs: changeset_id, path, side (base or head), content. Routes give path, type and
    tags, members owner, kind, name and detail, manifests their export paths, translation
    files their keys. Null or unreadable content gives nothing.
    """
    import json

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cs, path, side, content in zip(batch["changeset_id"], batch["path"], batch["side"], batch["content"]):
                if not content:
                    continue
                head = (cs, path, side)
                if path.endswith(".json"):
                    try:
                        value = json.loads(content)
                    except (ValueError, RecursionError):
                        continue
                    if path.endswith("package.json") and isinstance(value, dict):
                        rows += [(*head, "export", p, "", "", "") for p in export_paths(value.get("exports"))]
                    else:
                        rows += [(*head, "key", k, "", "", "") for k in flatten_keys(value)]
                    continue
                rows += [(*head, "route", p, kind, ",".join(tags), "") for p, kind, tags in routes(content)]
                rows += [(*head, "member", *m) for m in members(content)]
            yield pd.DataFrame(rows, columns=["changeset_id", "path", "side", "relation", "a", "b", "c", "d"])

    used = blobs.select("changeset_id", "path", "side", "content").where("changeset_id is not null and path is not null")
    return used.mapInPandas(run, "changeset_id string, path string, side string, relation string, a string, b string, c string, d string")


def source_changes(blobs: DataFrame) -> DataFrame:
    """changeset_id, path, relation, name, kind, change of what base and head of a source file offer.

    Things on both sides whose remaining attributes differ are changed; equal ones are left out.
    """
    from pyspark.sql import functions as F

    read = read_sources(blobs)
    is_member = F.col("relation") == "member"
    keyed = read.select(
        "changeset_id", "path", "side", "relation",
        F.when(is_member, F.concat_ws(".", F.col("a"), F.col("c"))).otherwise(F.col("a")).alias("name"),
        F.when(is_member, F.col("b")).otherwise(F.col("relation")).alias("kind"),
        F.when(is_member, F.col("d")).otherwise(F.concat_ws("|", "b", "c")).alias("attributes"),
    )
    sides = keyed.groupBy("changeset_id", "path", "relation", "name", "kind").agg(
        F.max(F.when(F.col("side") == "base", F.col("attributes"))).alias("old"), F.max(F.when(F.col("side") == "head", F.col("attributes"))).alias("new")
    )
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return sides.withColumn("change", change).where("change is not null").drop("old", "new")
