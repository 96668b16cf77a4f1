"""Words of a text apart from case, markup, encoding, look-alike characters and layout."""

from __future__ import annotations

import base64
import binascii
import html
import re
import unicodedata
from urllib.parse import unquote

# Letters of other alphabets that look like Latin ones (lower case).
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "з": "3", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
        "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
        "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ß": "ss", "ø": "o", "đ": "d", "ł": "l",
    }
)
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
#: A tag, of any length if it has an attribute with a value; a comment.
TAG = re.compile(r"</?[A-Za-z!][^<>]{0,300}>|<[A-Za-z][\w:-]*+\s[^<>=]*+=[^<>]*+>|<!--[^<>]*+>")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}[^%\s]*+){3,}")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})")
_ENCODED = re.compile(r"((?:[A-Za-z0-9+/]{20,}\r?\n?)+)([A-Za-z0-9+/]{0,59}={0,2})")
#: Twelve words of two characters with blanks between, encoded.
_LEAST_ENCODED = 44
_HYPHENATED = re.compile(r"([A-Za-z])-[ \t]*\r?\n[ \t>#/|*]*([a-z])")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]")
_OTHER_LETTERS = re.compile("[\u0370-\u052f\u0251\u0261\u0131\u0269\xdf\xf8\u0111\u0142]")
_SPLIT = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))


def _decoded(m: re.Match) -> str:
    # The shorter last line may be no part of the run but text behind it.
    if len(m[0]) < _LEAST_ENCODED:
        return m[0]
    for encoded, rest in ((m[0], ""), (m[1], m[2])):
        raw = re.sub(r"\s", "", encoded)
        try:
            text = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True).decode("utf-8")
        except (binascii.Error, ValueError):
            continue
        if text.isprintable() or "\n" in text:
            return f" {text} {rest}"
    return m[0]


def plain_text(text: str) -> str:
    """The text in lower case and plain Latin letters, without markup and encodings."""
    if "&" in text:
        text = html.unescape(text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m[0]), text)
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "*" in text:
        text = text.replace("*", "")
    if "`" in text:
        text = text.replace("`", "")
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = _COMBINING.sub("", text).lower()
        if _OTHER_LETTERS.search(text):
            text = text.translate(LOOKALIKES)
    if "-\n" in text or "-\r" in text:
        text = _HYPHENATED.sub(r"\1\2", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    """Words of letters and digits of plain_text; long base64 runs that hold text are read too."""
    if not text:
        return []
    found = _split(plain_text(text))
    if found and len(max(found, key=len)) >= 20 and _ENCODED.search(text):
        found = _split(plain_text(_ENCODED.sub(_decoded, text)))
    return found


def _split(text: str) -> list[str]:
    return text.encode("ascii", "replace").translate(_SPLIT).decode("ascii").split()
