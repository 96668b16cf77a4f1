"""Credentials embedded in source code (problem 3).

A keyword automaton finds the lines worth looking at. On those, issuer formats are
matched, their published checksums or structures are validated, and values given to names that mean a
secret are judged: placeholders, masked values, references to variables or vaults,
plain words and type names are no credentials. Every credential is replaced by a
placeholder of the same length and alphabet, so the code around it stays as it was.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of which a line must hold one to be looked at (lower case). Every match of every pattern
# below holds one of them; tests/llm/test_credentials.py spells the patterns out and checks it.
KEYWORDS = (
    "pass", "pwd", "pw", "pin-code", "pin_code", "pin code", "pincode", "secret", "key", "token", "auth", "bearer", "basic", "credential",
    "://", "login", "identified", "mysql", "mariadb", "-u ", "-u=", "--user ", "--user=",
    "akia", "asia", "abia", "acca", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "gldt-", "glrt-", "glptt-", "glsoat-", "xoxa-", "xoxb-", "xoxe-", "xoxp-", "xoxr-", "xoxs-",
    "sk_live_", "sk_test_", "sk_prod_", "rk_live_", "rk_test_", "rk_prod_", "pk_live_", "pk_test_", "pk_prod_", "npm_", "pypi-", "dckr_pat_", "shpat_", "hf_", "aiza", "sg.", "sk-", "eyj",
)

# Issuer formats; the group is what is masked.
ISSUER = [
    ("aws_access_key_id", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ABIA|ACCA)([A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("forge_token", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{30,255})(?![A-Za-z0-9])")),
    ("forge_token", re.compile(r"(?<![A-Za-z0-9])github_pat_([A-Za-z0-9_]{22,255})")),
    ("forge_token", re.compile(r"(?<![A-Za-z0-9])gl(?:pat|dt|rt|ptt|soat)-([A-Za-z0-9_-]{20,64})")),
    ("chat_token", re.compile(r"(?<![A-Za-z0-9])xox[abeprs]-([A-Za-z0-9-]{16,})")),
    ("payment_key", re.compile(r"(?<![A-Za-z0-9])[srp]k_(?:live|test|prod)_([A-Za-z0-9]{16,})")),
    ("registry_token", re.compile(r"(?<![A-Za-z0-9])npm_([A-Za-z0-9]{30,})")),
    ("registry_token", re.compile(r"(?<![A-Za-z0-9])(?:pypi-|dckr_pat_|shpat_|hf_)([A-Za-z0-9_-]{24,})")),
    ("cloud_key", re.compile(r"(?<![A-Za-z0-9])AIza([A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])")),
    ("mail_key", re.compile(r"(?<![A-Za-z0-9])SG\.([A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})")),
    ("model_key", re.compile(r"(?<![A-Za-z0-9])sk-(?:proj-|ant-)?([A-Za-z0-9_-]{24,})")),
    ("signed_token", re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{6,}={0,2}\.eyJ[A-Za-z0-9_-]{6,}={0,2}\.[A-Za-z0-9_-]{10,}={0,2})")),
]
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_JOINED = re.compile(r"""(["'`])[ \t]*(?:\+[ \t]*)?\1""")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@'\"`<>]*:([^\s'\"`<>]+)@[A-Za-z0-9\[$({]")
_AUTH = re.compile(r"(?i)\b(basic|bearer|token)\s+([A-Za-z0-9+/_.~=-]{8,})")
_AUTH_NEAR = re.compile(r"(?i)auth|bearer|basic")

#: Last part of a name that means a secret.
_NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|pw|pin[-_ ]?code|secret(?:[-_]?(?:access)?[-_]?key)?|(?:api|access|auth|private|secret|master|signing|encryption|hmac|crypt|session|storage|account|shared|"
    r"client|service|webhook|deploy|license)[-_]?key|apikey|token|credentials?|auth)"
)
_ASSIGNED = re.compile(
    r"(?i)(?<![A-Za-z0-9])[A-Za-z0-9]*?" + _NAME + r"[\"'`]?\]?\s*(?::=|=>|:|=)\s*"
    r"(?:(?P<q>[\"'`])(?P<quoted>(?:\\.|(?!(?P=q)).)*)(?P=q)|(?P<bare>[^\s\"'`,;<>(){}\[\]]+)(?P<next>[(\[{]?))"
)
_NAMED_VALUE = re.compile(r"(?i)\b(?:key|name|id)\s*=\s*[\"'][^\"']*?" + _NAME + r"[\"'][^<>]*?\bvalue\s*=\s*([\"'])(?P<value>[^\"']*)\1")
_HEADER = re.compile(r"(?i)\bx-[a-z-]*(?:auth|token|key)[a-z-]*[\"']?\s*[:,=]\s*[\"']?([^\s\"']{8,})")
_SQL = re.compile(r"(?i)\b(?:password|identified\s+by)\s+([\"'`])([^\"'`]+)\1")
_NETRC = re.compile(r"(?i)\blogin\s+\S+\s+password\s+(\S+)")
_DB_CLIENT = re.compile(r"\b(?:mysql|mysqldump|mariadb|mysqladmin|sshpass)\b.*?\s-p\s*([^\s'\"-][^\s'\"]*)")
_HTTP_CLIENT = re.compile(r"\b(?:curl|wget|http)\b.*?\s(?:-u|--user)[ =]['\"]?[^\s:'\"]+:([^\s'\"]+)")
_TOLD = re.compile(r"(?i)\b(?:password|passwd|pwd|pw|passphrase|passcode|login|secret|token|pass|credentials?)(?:\s+for\s+\S+)?(?:\s+(?:is|was)\s*:?|:)?\s+[\"'`]?([^\s\"'`]+)")

# Placeholder words and the starts of references.
_PLACEHOLDER = re.compile(
    r"(?i)example|placeholder|changeme|change[-_ ]me|your[-_ ]|redacted|masked|hidden>|dummy|sample|insert[-_ ]|fixme|xxxx|\*\*\*|\.\.\.|not[-_ ]?set|replace[-_ ]|secret[-_ ]?here|"
    r"key[-_ ]?here|token[-_ ]?here|^\W*(?:todo|tbd)\W*$|^<.*>$|^\[.*\]$|^(?:none|null|nil|undefined|true|false|string|password|secret|token|test|foo|bar|required|optional)$"
)
_REFERENCE = re.compile(
    r"^[&*]?(?:\$[A-Za-z_({]|\$\$|%[A-Za-z_]+%$|\{\{|\{[A-Za-z_]|#\{|<%|process\.env|os\.(?:environ|getenv)|env[.(\[]|ENV\[|System\.|vault[:.(]|secrets?[.:\[]|config[.\[(]|settings\.|"
    r"arn:|ssm:|op://|file:|kms:|ref\+|!Ref|!Sub|import\.meta|self\.|this\.|args\.|opts\.|options\.|params\.|getenv|keyring)"
)
_CALL = re.compile(r"^[A-Za-z_$][\w$.:]*[(\[]")
_DOTTED = re.compile(r"^[A-Za-z_$][A-Za-z_$]*(?:\??\.[A-Za-z_$][A-Za-z_$]*)+[;,)]*$")
_NUMBERISH = re.compile(r"^[\d.,:x+-]+[a-z%]{0,3}$")
_BASE64 = re.compile(r"^[A-Za-z0-9+/_-]{8,}={0,2}$")


def _decoded(value: str) -> str | None:
    """The text in a base64 value, or None."""
    if not _BASE64.match(value):
        return None
    try:
        raw = base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4), validate=True)
        text = raw.decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return text if text.isprintable() else None


def is_masked(value: str) -> bool:
    """All letters and digits are the fillers of mask(), or hardly any character differs."""
    body = {c for c in value if c.isalnum()}
    return not body or body <= {"x", "X", "0"} or len(value) >= 8 and (len(body) <= 2 or body <= {"a", "A", "0"})


def is_placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.search(value)) or is_masked(value)


def is_secret(value: str, quoted: bool, words: bool = False) -> bool:
    """Whether a value given to a secret's name is itself one.

    quoted: it stood in quotes, so it is no expression. words: several plain words may
    be a pass phrase.
    """
    value = value.strip()
    if len(value) < 6 or is_placeholder(value) or _REFERENCE.match(value) or "${" in value or "{{" in value:
        return False
    if " " in value:
        parts = value.split(" ")
        return words and quoted and len(parts) >= 3 and all(3 <= len(p) and p.isalnum() for p in parts)
    if _NUMBERISH.match(value) and not (value.isdigit() and len(value) >= 8):
        return False
    if not quoted and (_CALL.match(value) or _DOTTED.match(value) or value.endswith(("()", "?;"))):
        return False
    if value.startswith(("/", "./", "../", "~/")) and "/" in value[1:] and not re.search(r"[+=]|\d", value):
        return False
    plain = _decoded(value)
    if plain is not None and len(plain) >= 4 and is_placeholder(plain):
        return False
    letters = sum(c.isalpha() for c in value)
    if letters == len(value):
        mixed = len(value) >= 10 and re.search(r"[a-z][A-Z].*[a-z][A-Z]|[A-Z]{2}.*[a-z].*[A-Z]", value)
        return len(value) >= 16 and (value.islower() or value.isupper()) or quoted and len(value) >= 12 and value.islower() or bool(mixed) and len(value) >= 16
    if re.fullmatch(r"[a-z]+(?:[-_./:][a-z]+)+", value, re.I):
        return False
    return letters > 0 and (any(c.isdigit() for c in value) or bool(re.search(r"[^A-Za-z0-9_.:/-]", value))) or value.isdigit()


def _jwt_ok(token: str) -> bool:
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


#: Fixed value: digits of the checksums at the end of forge and registry tokens, in order.
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_PYPI_SITE = "AgEIcHlwaS5vcmc"


def _crc_ok(body: str) -> bool:
    """Whether the last six characters are the CRC-32 of the others in base 62, as some issuers publish it."""
    n, digits = zlib.crc32(body[:-6].encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = _BASE62[r] + digits
    return digits.rjust(6, "0") == body[-6:]


def check_token(line: str, start: int, end: int, kind: str) -> str:
    """passed, failed or none: whether the checksum or structure that the issuer publishes holds.

    A failed check is told, but the token stays a credential: revoked, test-mode and mistyped ones count too.
    """
    body, before = line[start:end], line[max(0, start - 12) : start]
    if kind == "aws_access_key_id":
        return "passed" if re.fullmatch("[A-Z2-7]{16}", body) else "failed"
    if len(body) == 36 and (kind == "forge_token" and re.search("gh[pousr]_$", before) or kind == "registry_token" and before.endswith("npm_")):
        return "passed" if _crc_ok(body) else "failed"
    if kind == "registry_token" and before.endswith("pypi-"):
        return "passed" if body.startswith(_PYPI_SITE) else "failed"
    if kind == "signed_token":
        return "passed" if _jwt_ok(body) else "failed"
    if kind == "authorization" and before.lower().rstrip().endswith("basic"):
        return "passed"
    return "none"


def _basic_ok(value: str) -> bool:
    plain = _decoded(value)
    return plain is not None and ":" in plain and not is_placeholder(plain.split(":", 1)[1])


def find_credentials(line: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential of one line, in order, not overlapping."""
    spans: list[tuple[int, int, str]] = []
    at = 0
    while m := KEY_BEGIN.search(line, at):
        end, after = KEY_END.search(line, m.end()), KEY_BEGIN.search(line, m.end())
        stop = min(x.start() for x in (end, after) if x) if end or after else len(line)
        spans.append((m.end(), stop, "private_key"))
        at = stop if stop < len(line) else len(line) + 1
    for kind, pattern in ISSUER:
        for m in pattern.finditer(line):
            if is_placeholder(m[1]) or kind == "signed_token" and not _jwt_ok(m[1]):
                continue
            spans.append((m.start(1), m.end(1), kind))
    if not spans and _JOINED.search(line):
        spans += _joined(line)
    for m in _URL.finditer(line):
        if not is_placeholder(m[1]) and not _REFERENCE.match(m[1]) and "${" not in m[1] and m[1].lower() not in ("pass", "pw", "port"):
            spans.append((m.start(1), m.end(1), "url_password"))
    if _AUTH_NEAR.search(line):
        for m in _AUTH.finditer(line):
            scheme, value = m[1].lower(), m[2]
            if scheme == "basic" and _basic_ok(value) or scheme != "basic" and len(value) >= 16 and is_secret(value, True) and any(c.isdigit() for c in value):
                spans.append((m.start(2), m.end(2), "authorization"))
    for m in _ASSIGNED.finditer(line):
        if m["quoted"] is not None:
            if is_secret(m["quoted"], True, True):
                spans.append((m.start("quoted"), m.end("quoted"), "assigned"))
        else:
            value = m["bare"].rstrip(":?")
            if not m["next"] and is_secret(value, False):
                spans.append((m.start("bare"), m.start("bare") + len(value), "assigned"))
    for pattern, group, quoted in ((_NAMED_VALUE, "value", True), (_HEADER, 1, False), (_SQL, 2, True), (_NETRC, 1, True), (_DB_CLIENT, 1, True), (_HTTP_CLIENT, 1, True), (_TOLD, 1, False)):
        for m in pattern.finditer(line):
            value = m[group]
            if pattern is _TOLD:
                value = value.rstrip(".,;*/)")
                if not (len(value) >= 8 and (any(c.isdigit() for c in value) or len(value) >= 20)) or re.search(r"[(){}=<>|]", value):
                    continue
            if is_secret(value, quoted, quoted):
                spans.append((m.start(group), m.start(group) + len(value), "told" if pattern is _TOLD else "command"))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[1] > out[-1][1]:
            out[-1] = (out[-1][0], s[1], out[-1][2])
    return out


def _joined(line: str) -> list[tuple[int, int, str]]:
    """Issuer formats spread over adjacent string literals."""
    kept, at, last = [], [], 0
    for m in _JOINED.finditer(line):
        kept.append(line[last : m.start()])
        at += range(last, m.start())
        last = m.end()
    kept.append(line[last:])
    at += range(last, len(line))
    whole, spans = "".join(kept), []
    for kind, pattern in ISSUER:
        for m in pattern.finditer(whole):
            if not is_placeholder(m[1]) and (kind != "signed_token" or _jwt_ok(m[1])):
                spans.append((at[m.start(1)], at[m.end(1) - 1] + 1, kind))
    return spans


_cached = lru_cache(maxsize=50_000)(find_credentials)
_CACHED_LENGTH = 300


def mask(text: str) -> str:
    """A placeholder of the same length and alphabet; characters that are no letters or digits stay.

    Hexadecimal values get a, A and 0, base-32 ones (capitals and 2 to 7) X and 2, all others x, X and 0.
    """
    body = {c for c in text if c.isalnum()}
    letters, digit = ("x", "X"), "0"
    if body <= _HEX and any(c.isdigit() for c in body):
        letters = ("a", "A")
    elif body <= _BASE32 and body & _LOW_DIGITS:
        digit = "2"
    return "".join(letters[0] if c.islower() else letters[1] if c.isupper() else digit if c.isdigit() else letters[0] if c.isalpha() else c for c in text)


_HEX, _BASE32, _LOW_DIGITS = set("0123456789abcdefABCDEF"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), set("234567")


def mask_spans(line: str, spans: list[tuple[int, int, str]]) -> str:
    for start, end, _ in spans:
        line = line[:start] + mask(line[start:end]) + line[end:]
    return line


_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{8,}")


def scan_lines(lines: list[str | None], wanted: list[int]) -> list[tuple[int, str, int, str, str]]:
    """(place, kinds, spans, checks, masked line) of lines with credentials.

    wanted: places the automaton found, ascending. Lines inside a key block come out
    masked with the kind key_body; the block's first line has the kind private_key.
    """
    out: list[tuple[int, str, int, str, str]] = []
    skip_to = -1
    for i in wanted:
        line = lines[i]
        if line is None or i <= skip_to:
            continue
        spans = _cached(line) if len(line) <= _CACHED_LENGTH else find_credentials(line)
        if not spans:
            continue
        checks = dict.fromkeys(check_token(line, *s) for s in spans)
        out.append((i, ",".join(dict.fromkeys(s[2] for s in spans)), len(spans), ",".join(checks), mask_spans(line, spans)))
        if spans[-1][2] == "private_key" and spans[-1][1] == len(line):
            j = i + 1
            while j < len(lines) and lines[j] is not None and not KEY_END.search(lines[j]) and not KEY_BEGIN.search(lines[j]):
                if _KEY_BODY.search(lines[j]):
                    out.append((j, "key_body", 1, "none", _KEY_BODY.sub(lambda m: mask(m[0]), lines[j])))
                elif lines[j].strip(" +-#/*") and not re.match(r"^[ +-]?\s*(?:#|//|\*)?\s*[A-Za-z-]+: ", lines[j]):
                    break
                j += 1
            skip_to = j - 1
    return out


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, word in enumerate(KEYWORDS):
        a.add_word(word, i)
    a.make_automaton()
    return a


def _candidates(automaton: ahocorasick.Automaton, text: str) -> list[int]:
    """Places of the lines of a text that hold a keyword, as written or with adjacent string literals joined."""
    low = text.lower()
    found = _keyword_lines(automaton, low)
    if _JOINED.search(low):
        return sorted({*found, *_keyword_lines(automaton, _JOINED.sub("", low))})
    return found


def _keyword_lines(automaton: ahocorasick.Automaton, low: str) -> list[int]:
    hits = [end for end, _ in automaton.iter(low)]
    if not hits:
        return []
    if len(hits) == 1:
        return [low.count("\n", 0, hits[0])]
    starts, at = [0], low.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = low.find("\n", at + 1)
    return sorted({bisect_right(starts, h) - 1 for h in hits})


RESULT_SCHEMA = "origin string, record_id bigint, item_ord int, line_ord int, kinds string, spans int, checks string, masked string"
_RESULT = pa.schema([("origin", pa.string()), ("record_id", pa.int64()), ("item_ord", pa.int32()), ("line_ord", pa.int32()), ("kinds", pa.string()), ("spans", pa.int32()), ("checks", pa.string()), ("masked", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_RESULT)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _RESULT)], schema=_RESULT)


def scan_items(automaton: ahocorasick.Automaton, items: list[str | None]) -> list[tuple[int, str, int, str, str]]:
    """scan_lines of an array whose entries are lines; line feeds inside an entry part no line and stay as they are."""
    plain = [x if x is None or "\n" not in x else x.replace("\n", "\r") for x in items]
    found = scan_lines(plain, _candidates(automaton, "\n".join([x or "" for x in plain])))
    return [(i, *rest, masked if plain[i] is items[i] else "".join("\n" if o == "\n" else m for o, m in zip(items[i], masked))) for i, *rest, masked in found]


def scan_text(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, str, int, str, str]]:
    """scan_lines of a text parted at line feeds."""
    found = _candidates(automaton, text)
    return scan_lines(text.split("\n"), found) if found else []


def redact_text(automaton: ahocorasick.Automaton, text: str | None) -> str | None:
    """The text with every credential masked, of the same length."""
    if not text or not (found := scan_text(automaton, text)):
        return text
    lines = text.split("\n")
    for i, *_, masked in found:
        lines[i] = masked
    return "\n".join(lines)


def redact_items(automaton: ahocorasick.Automaton, items: list[str | None] | None) -> list[str | None] | None:
    """The array with every credential in its entries masked."""
    if not items or not (found := scan_items(automaton, items)):
        return items
    out = list(items)
    for i, *_, masked in found:
        out[i] = masked
    return out


def _scan_arrays(origin: str, key: str, column: str):
    """Each entry of an array column is one line (additions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out = []
            for record, items in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist()):
                if not items:
                    continue
                out += [(origin, record, i, 0, *rest) for i, *rest in scan_items(automaton, items)]
            yield _batch(out)

    return run


def _scan_texts(origin: str, key: str, column: str):
    """Each entry of a column (string, or array of strings) is a text of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out = []
            for record, items in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist()):
                for item, text in enumerate(items if isinstance(items, list) else [items]):
                    if text:
                        out += [(origin, record, item, i, *rest) for i, *rest in scan_text(automaton, text)]
            yield _batch(out)

    return run


def scan_credentials(hunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Every line of additions, content and evidence excerpts that holds a credential, with its masked form.

    Result: RESULT_SCHEMA, distinct. kinds lists what was found, key_body marks the
    further lines of a key block; checks tells whether published checksums or structures hold. Places count from 0; lines are parted at line feeds.
    Null texts, arrays and entries hold nothing but keep their place; repeated rows
    count once. The scan needs no shuffle but for dropping repeats of its few rows.
    """
    parts = [
        hunks.select("hunk_id", "additions").where("hunk_id is not null and additions is not null").mapInArrow(_scan_arrays("additions", "hunk_id", "additions"), RESULT_SCHEMA),
        hunks.select("hunk_id", "content").where("hunk_id is not null and content is not null").mapInArrow(_scan_texts("content", "hunk_id", "content"), RESULT_SCHEMA),
        findings.select("row_id", F.col("evidence.excerpt").alias("excerpts")).where("row_id is not null and size(excerpts) > 0").mapInArrow(_scan_texts("excerpt", "row_id", "excerpts"), RESULT_SCHEMA),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def credential_lines(scanned: DataFrame) -> DataFrame:
    """origin, record_id, item_ord, line_ord: a key block counts once, at its first line."""
    return scanned.where("kinds <> 'key_body'").select("origin", "record_id", "item_ord", "line_ord").distinct()


def _redactor(columns: dict[str, bool]):
    """Masks the named columns (whether each is an array of lines) and passes all others through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for name, is_array in columns.items():
                at = batch.schema.get_field_index(name)
                mask_one = redact_items if is_array else redact_text
                kept = batch.column(at)
                masked = pa.array([mask_one(automaton, v) for v in kept.to_pylist()], kept.type)
                batch = batch.set_column(at, batch.schema.field(at), masked)
            yield batch

    return run


def redact_hunks(hunks: DataFrame) -> DataFrame:
    """The hunks with every credential in content, additions and deletions masked; all else, extra columns too, stays.

    One pass without shuffle. Null texts, arrays and entries stay null, repeated rows stay repeated.
    """
    return hunks.mapInArrow(_redactor({"content": False, "additions": True, "deletions": True}), hunks.schema)


def redact_findings(findings: DataFrame) -> DataFrame:
    """The findings with every credential in their evidence excerpts masked; all else stays."""
    texts = findings.withColumn("_excerpts", F.col("evidence.excerpt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            at = batch.schema.get_field_index("_excerpts")
            kept = batch.column(at)
            masked = pa.array([v and [redact_text(automaton, x) for x in v] for v in kept.to_pylist()], kept.type)
            yield batch.set_column(at, batch.schema.field(at), masked)

    masked = texts.mapInArrow(run, texts.schema)
    replaced = F.transform("evidence", lambda e, i: F.when(e.isNotNull(), e.withField("excerpt", F.get("_excerpts", i))))
    return masked.withColumn("evidence", replaced).drop("_excerpts")
