"""Replacing one string value inside JSON text, leaving all other characters as they were written."""

from __future__ import annotations

import json
from collections.abc import Callable
from json.decoder import scanstring

_WS = " \t\r\n"


def replace_string(text: str, key: str, fn: Callable[[str], str]) -> str:
    """text (an object) with the string value of the top-level `key` replaced by fn of it; unchanged if the text is no
    object, the key is missing, its value is no string, or fn changes nothing."""
    dec = json.JSONDecoder()
    i = _skip(text, 0)
    if text[i : i + 1] != "{":
        return text
    i = _skip(text, i + 1)
    out, at = [], 0
    try:
        while text[i] == '"':
            k, i = scanstring(text, i + 1)
            i = _skip(text, i)
            if text[i] != ":":
                return text
            start = _skip(text, i + 1)
            v, i = dec.raw_decode(text, start)
            if k == key and isinstance(v, str) and (new := fn(v)) != v:
                out += [text[at:start], json.dumps(new, ensure_ascii=text.isascii())]
                at = i
            i = _skip(text, i)
            if text[i] != ",":
                break
            i = _skip(text, i + 1)
    except (ValueError, IndexError):
        return text
    return "".join([*out, text[at:]])


def _skip(text: str, i: int) -> int:
    while i < len(text) and text[i] in _WS:
        i += 1
    return i
