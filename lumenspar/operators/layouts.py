"""Layouts of log lines, written as the programs' own format strings and compiled to anchored expressions.

A format is literal text with fields `%(name)s`, `%(name)d` or `%(name)f`; two spaces stand for one or more, and what
stands in braces may be missing. What a field can look like is told once, for all layouts. Text of the end of a line
(`message`, `reason`) may hold line breaks, since continuation lines may have been joined to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Level names of Python's logging, what the fields of the formats look like, and the formats themselves.
PYTHON_LEVELS = ("DEBUG", "INFO", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL")
_DAY, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
FIELDS = {
    "levelname": "|".join(PYTHON_LEVELS),
    "severity": r"[A-Z]+\d?",
    "mark": r"[.\-*#]",
    "asctime": rf"{_DAY}[ T]{_TIME}(?:Z|[+-]\d\d:?\d\d)?",
    "stamp": rf"{_DAY} {_TIME}(?: [A-Z]{{1,5}})?",
    "date": rf"\d{{2}} [A-Z][a-z]{{2}} \d{{4}} {_TIME}",
    "clock": r"\d{2}:\d{2}:\d{2}",
    "name": r"[\w.\-]+",
    "role": "[XCSM]",
    "user": r"[^@\s]+",
    "client": r"\d[\d.]*|\[[\da-fA-F:]+\]",
    "method": "[A-Z]+",
    "request": r"[\da-fA-F][\da-fA-F-]{7,}",
    "message": ".*",
    "reason": ".*",
}
KINDS = {"s": r"\S+", "d": r"\d+", "f": r"[\d.]+"}
LEVEL_FIELDS, TIME_FIELDS, COMPONENT_FIELDS = ("levelname", "severity", "mark"), ("asctime", "stamp", "date", "utc"), ("name", "class", "db", "role")
_BEFORE_COLON = tuple(f"{x}:" for x in PYTHON_LEVELS)
_BEFORE_SPACE = tuple(f"{x} " for x in PYTHON_LEVELS)


@dataclass(frozen=True)
class Layout:
    """A source's format and the literals of which each line in it holds at least one."""

    source: str
    format: str
    anchors: tuple[str, ...]


# of one source the first that fits holds
LAYOUTS = (
    Layout("python", '%(severity)s:  %(client)s:%(port)d - "%(method)s %(path)s HTTP/%(http_version)f" %(status_code)d{ %(reason)s}', (' - "',)),
    Layout("python", "%(levelname)s:  %(message)s", _BEFORE_COLON),
    Layout("python", "%(asctime)s %(levelname)s %(name)s %(message)s", _BEFORE_SPACE),
    Layout("python", "%(levelname)s %(name)s %(message)s", _BEFORE_SPACE),
    Layout("python", "%(levelname)s:%(name)s:%(message)s", _BEFORE_COLON),
    Layout("python", "%(clock)s:  %(message)s", (": ",)),
    Layout("sidekiq", "%(utc)s pid=%(pid)d tid=%(tid)s{ class=%(class)s}{ jid=%(jid)s}{ elapsed=%(elapsed)f} %(severity)s: %(message)s", (" pid=",)),
    Layout("postgres", "%(stamp)s [%(pid)d]{ %(user)s@%(db)s} %(severity)s:  %(message)s", ("] ",)),
    Layout("redis", "%(pid)d:%(role)s %(date)s %(mark)s %(message)s", (":X ", ":C ", ":S ", ":M ")),
    Layout("rails", "[%(request)s]{ }%(message)s", ("[",)),
)

_PIECE = re.compile(r"%\((\w+)\)([sdf])|([{}])|( {2,})|((?:[^%{} ]|%(?!\()| (?! ))+)")


def compiled(fmt: str) -> tuple[re.Pattern[str], dict[str, str]]:
    """(expression that fits whole lines, kind of each field) of a format."""
    out, kinds = [], {}
    for m in _PIECE.finditer(fmt):
        name, kind, brace, spaces, text = m.groups()
        if name:
            kinds[name] = kind
            out.append(f"(?P<{name}>{FIELDS.get(name, KINDS[kind])})")
        else:
            out.append({"{": "(?:", "}": ")?"}[brace] if brace else " +" if spaces else re.escape(text))
    return re.compile("".join(out) + r"\Z", re.S), kinds


def value(text: str, kind: str) -> object:
    """A captured field in its kind; text if it isn't a number after all."""
    try:
        return int(text) if kind == "d" else float(text) if kind == "f" else text
    except ValueError:
        return text
