"""Secrets in log text and attributes hidden.

Text is read as names and what is assigned to them. The names before a separator are listed first and looked up, part by
part, in the words of secret keys; only for the names of a line that are secret is the line searched again and the value
after each replaced. A line without such a name costs one pass. Both forms, for columns (in the JVM) and for the strings
inside attributes (in Python), are built from the same pieces.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of secret keys, parameters of URLs, schemes of authorization, and the marks that end a bare value.
SECRET_PARTS = ("password", "passwd", "secret", "apikey", "privatekey", "credential", "cookie", "authorization", "phone", "ssn", "cardnumber", "cvv", "cvc")
TWO_PARTS = ("api_key", "private_key", "card_number", "access_key")
SECRET_ENDS = ("token", "accesskey")
URL_PARAMETERS = ("token", "code", "key", "signature", "sig", "apikey", "api_key", "access_token", "id_token", "refresh_token", "password", "secret", "reset_token", "verify_token")
SCHEMES = ("bearer", "basic", "token", "digest")
ENDS = r"\s\"',;&})\]"
REDACTED = "[REDACTED]"

_NAME = r"[A-Za-z0-9_.-]+"
_SEPARATOR = r"[\"']?\s*(?:=>|[:=])\s*"
_SHOWN = r"\[REDACTED\]"
_VALUE = rf"(?:(\")[^\"]*\"|(')[^']*'|{_SHOWN}|[^{ENDS}>][^{ENDS}]*)"
_CREDENTIALS = rf"(?:(\")[^\"]*\"|(')[^']*'|{_SHOWN}|(?i:(?:{'|'.join(SCHEMES)})\s+)?[^\s\"',;]+)"
_NAMES = rf"{_NAME}(?={_SEPARATOR})"
_PARAMETERS = r"[?&]([A-Za-z_]+)="
_TOKEN = r"\beyJ[\w-]{4,}\.[\w-]{4,}\.[\w-]*"  # header.payload.signature of a JSON web token
_MAIL = r"\b[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"


def _parts(name: str) -> list[str]:
    n = name.lower().replace("-", "_")
    for two in TWO_PARTS:
        n = n.replace(two, two.replace("_", ""))
    return re.split(r"[._]", n)


def secret_name(name: str) -> bool:
    """True if a part of the name is a secret word, or its end is one (also in the plural)."""
    parts = _parts(name)
    last = parts[-1].removesuffix("s")
    return last in SECRET_PARTS or last.endswith(SECRET_ENDS) or any(p in SECRET_PARTS for p in parts)


def secret_key(key: str) -> bool:
    """secret_name of an attribute, whose words may be told apart by capitals."""
    return secret_name(re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", key))


def _secret_name(name: Column) -> Column:
    n = F.translate(F.lower(name), "-", "_")
    for two in TWO_PARTS:
        n = F.replace(n, F.lit(two), F.lit(two.replace("_", "")))
    parts = F.split(n, "[._]")
    last = F.regexp_replace(n, "^.*[._](?=[^._]*$)|s$", "")
    end = last.endswith(SECRET_ENDS[0])
    for e in SECRET_ENDS[1:]:
        end = end | last.endswith(e)
    return last.isin(*SECRET_PARTS) | end | F.arrays_overlap(parts, F.array(*map(F.lit, SECRET_PARTS)))


def redact(c: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """Text with the values of secret names and URL parameters, web tokens and e-mail addresses hidden; null stays null.

    The name, the separator and the quotes of a value are kept. Applying it twice changes nothing more. extra: further
    (expression, replacement) pairs, applied last.
    """
    lit = F.lit
    out = F.regexp_replace(c, _TOKEN, REDACTED)
    params = F.array_distinct(F.filter(F.regexp_extract_all(c, lit(_PARAMETERS), lit(1)), lambda n: F.lower(n).isin(*URL_PARAMETERS)))
    out = F.aggregate(params, out, lambda text, n: F.regexp_replace(text, F.concat(lit("([?&]"), n, lit(r"=)[^&\s\"'#]+")), lit(rf"$1{REDACTED}")))
    names = F.array_distinct(F.filter(F.regexp_extract_all(c, lit(_NAMES), lit(0)), _secret_name))
    value = lambda n: F.when(n.rlike(r"(?i)(?:^|[.-])authorization$"), lit(_CREDENTIALS)).otherwise(lit(_VALUE))
    out = F.aggregate(names, out, lambda text, n: F.regexp_replace(text, F.concat(lit(r"(?<![A-Za-z0-9_.-])(\Q"), n, lit(rf"\E{_SEPARATOR})"), value(n)), lit(rf"$1$2$3{REDACTED}$2$3")))
    out = F.regexp_replace(out, _MAIL, REDACTED)
    for rx, rep in extra:
        out = F.regexp_replace(out, rx, rep)
    return out


def redact_text(s: str) -> str:
    """redact() of one string."""
    out = re.sub(_TOKEN, REDACTED, s, flags=re.A)
    for n in dict.fromkeys(re.findall(_PARAMETERS, s)):
        if n.lower() in URL_PARAMETERS:
            out = re.sub(rf"([?&]{n}=)[^&\s\"'#]+", rf"\g<1>{REDACTED}", out)
    for n in dict.fromkeys(re.findall(_NAMES, s, re.A)):
        if secret_name(n):
            value = _CREDENTIALS if re.search(r"(?:^|[.-])authorization$", n.lower()) else _VALUE
            out = re.sub(rf"(?<![A-Za-z0-9_.-])({re.escape(n)}{_SEPARATOR}){value}", lambda m: f"{m[1]}{m[2] or ''}{m[3] or ''}{REDACTED}{m[2] or ''}{m[3] or ''}", out, flags=re.A)
    return re.sub(_MAIL, REDACTED, out, flags=re.A)


_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def redact_object(text: str) -> str:
    """A JSON object with the whole value of secret keys hidden at any depth, and redact_text of all other strings; what
    isn't hidden keeps its spelling. Text that isn't a JSON object comes back as it is."""
    try:
        if not isinstance(json.loads(text), dict):
            return text
    except (ValueError, RecursionError):
        return text
    out: list[str] = []
    kept = depth = 0  # text up to `kept` is written
    open_: list[str] = []
    key, hide, hidden_from = True, False, -1  # hidden_from: where a bracketed value that is hidden begins
    closing = 0
    for m in _JSON.finditer(text):
        tok = m[0]
        if tok in "{[":
            if hide and hidden_from < 0:
                hidden_from, closing = m.start(), depth
            open_.append(tok)
            depth += 1
            key = tok == "{"
        elif tok in "}]":
            open_.pop()
            depth -= 1
            if hidden_from >= 0 and depth == closing:
                out += [text[kept:hidden_from], f'"{REDACTED}"']
                kept, hidden_from, hide = m.end(), -1, False
        elif tok == ",":
            key = open_[-1] == "{"
        elif tok == ":":
            key = False
        elif hidden_from >= 0:
            continue
        elif key:
            hide = secret_key(json.loads(tok))
        else:
            s = json.loads(tok) if tok[0] == '"' else None
            new = REDACTED if hide else redact_text(s) if s is not None else None
            if new is not None and new != s:
                out += [text[kept : m.start()], json.dumps(new, ensure_ascii="\\u" in tok)]
                kept = m.end()
            hide = False
    return "".join([*out, text[kept:]])


def redact_attrs(c: Column) -> Column:
    """redact_object of a column. Only rows that hold a secret key, a mark of what the text rules look for, or an escape
    that may hide one are handed to Python."""
    snake = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    work = F.exists(F.regexp_extract_all(snake, F.lit(_NAMES), F.lit(0)), _secret_name) | c.contains("@") | c.contains("eyJ") | c.contains("\\") | c.rlike(_PARAMETERS)
    hide = F.udf(lambda s: None if s is None else redact_object(s), "string", useArrow=True)
    return F.coalesce(hide(F.when(work, c)), c)
