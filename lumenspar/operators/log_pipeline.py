"""The agent's log pipeline as one chain over a table of raw lines: exclude, rate limit, parse, remap, redact.

Parsing gives each line its fields as attributes: custom patterns of a source first, then what the source's programs write
(`layouts.py`, JSON objects). Custom patterns stay in the JVM, one regular expression each; built-in layouts go through the
Aho-Corasick router on Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspar.operators import pipeline
from lumenspar.operators.log_entries import Router, log_entries

# The parsers of each source; others know JSON objects only.
PARSERS = {"json": ("json",), "winston": ("json",), "caddy": ("json",), "python": ("json", "layouts"), "sidekiq": ("json", "layouts"), "rails": ("json", "layouts"), "postgres": ("layouts",), "redis": ("layouts",), "plain": ()}
_SUFFIX = {"_int": "bigint", "_float": "double"}


@dataclass(frozen=True)
class Pattern:
    """A custom pattern: a regular expression with named groups, `(?P<name>...)`; names that end in _int or _float become
    numbers (text if they are none). message is a template of the fields, `${name}`."""

    regex: str
    message: str = ""


@dataclass(frozen=True)
class SourceConfig:
    """What happens to a source's lines."""

    patterns: tuple[Pattern, ...] = ()
    exclude_at_match: tuple[str, ...] = ()
    per_second: int = 0  # 0: no limit
    redact_rules: tuple[tuple[str, str], ...] = field(default=())


def _fields(c: Column, p: Pattern) -> dict[str, Column]:
    """Each field of a pattern as JSON text of its value, null where the group is empty."""
    rx = re.compile(p.regex)
    java = re.sub(r"\(\?P<\w+>", "(", p.regex)
    out = {}
    for name, i in rx.groupindex.items():
        text = F.nullif(F.regexp_extract(c, java, i), F.lit(""))
        suffix = next((s for s in _SUFFIX if name.endswith(s)), "")
        value = F.to_json(F.struct(text.alias("v")))
        if suffix:
            number = text.try_cast(_SUFFIX[suffix])
            value = F.when(number.isNotNull(), F.to_json(F.struct(number.alias("v")))).otherwise(value)
        out[name.removesuffix(suffix)] = F.when(text.isNotNull(), F.regexp_extract(value, r'(?s)^\{"v":(.*)\}$', 1))
    return out


def grok(c: Column, patterns: tuple[Pattern, ...]) -> Column:
    """Attributes (a JSON object) by the first pattern that fits, null if none does."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        fields = _fields(c, p)
        if p.message:
            pieces = re.split(r"\$\{(\w+)\}", p.message)
            plain = lambda n, fields=fields: F.coalesce(F.when(fields[n].startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), fields[n], F.lit("}")), "$.v")).otherwise(fields[n]), F.lit("")) if n in fields else F.lit("")
            text = F.concat(*(plain(x) if i % 2 else F.lit(x) for i, x in enumerate(pieces)))
            fields["message"] = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        body = F.array_join(F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(json.dumps(k) + ":"), v)) for k, v in fields.items()))), ",")
        java = re.sub(r"\(\?P<\w+>", "(", p.regex)
        out = F.when(c.rlike(java), F.concat(F.lit("{"), body, F.lit("}"))).otherwise(out)
    return out


def _built_in(lines: DataFrame, source: str, line: str) -> DataFrame:
    """lines with `built_in`: the attributes by the source's own layouts, null if the line is in none of them."""
    cols = lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Router()
        for b in batches:
            got = []
            for s, x in zip(b.column(cols.index(source)).to_pylist(), b.column(cols.index(line)).to_pylist(), strict=True):
                f = None
                if x is not None:
                    of = PARSERS.get(s or "", ("json",))
                    if "json" in of and x[:1] == "{":
                        hit = r._object(s, x)
                        f = hit and x.strip()
                    if f is None and "layouts" in of:
                        hit = r.parse(s, x)
                        if hit:
                            keys = dict(hit["fields"])
                            level = keys.pop("levelname", None) or keys.pop("severity", None) or keys.pop("mark", None)
                            time = next((keys.pop(k) for k in ("asctime", "stamp", "date", "utc") if k in keys), None)
                            f = json.dumps({k: v for k, v in (("message", hit["message"]), ("level", level), ("timestamp", time)) if v is not None} | {k: v for k, v in keys.items() if k != "message"}, ensure_ascii=False)
                got.append(f)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*cols, "built_in"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + ", built_in string"
    return lines.mapInArrow(run, schema)


# The attributes that become a log's own fields, in order of preference.
REMAPPED = {"message": ("message", "msg"), "level": ("level", "levelname", "severity"), "time": ("timestamp", "time", "ts", "@timestamp")}


def run(lines: DataFrame, configs: dict[str, SourceConfig] | None = None, source: str = "source", line: str = "line", arrival_ms: str = "arrival_ms", stderr: str | None = None, order: str | None = None) -> DataFrame:
    """lines with message, status, ts_ms, attrs and parsed.

    Order of stages: lines that fit a source's exclude patterns go; what is past the source's limit of a second of arrival
    goes (by `order`); custom patterns, then built-in parsers, give attributes; the first of their message, level and time
    keys become the log's own; secrets are hidden in message and attributes. A line that no parser fits is its own message,
    with status error if `stderr` (a boolean column) says it came from there, else info, and the arrival as its time. Null
    lines have a null message. Empty in, empty out; other columns stay.
    """
    configs = configs or {}
    is_ = lambda s: F.coalesce(F.col(source) == s, F.lit(False))
    d = lines
    for s, c in configs.items():
        for rx in c.exclude_at_match:
            d = d.where(~(is_(s) & F.coalesce(F.col(line).rlike(rx), F.lit(False))))
    for s, c in configs.items():
        if c.per_second:
            d = pipeline.rate_limit(d.where(is_(s)), source, arrival_ms, c.per_second, order or line).unionByName(d.where(~is_(s)))
    custom = F.lit(None).cast("string")
    for s, c in configs.items():
        if c.patterns:
            custom = F.when(is_(s), grok(F.col(line), c.patterns)).otherwise(custom)
    d = _built_in(d, source, line).withColumn("attrs", F.coalesce(custom, "built_in")).drop("built_in")
    first = lambda k: F.coalesce(*(F.get_json_object("attrs", f"$['{x}']") for x in REMAPPED[k]))
    fallback = F.when(F.coalesce(F.col(stderr), F.lit(False)), "error").otherwise("info") if stderr else F.lit("info")
    status = F.when(F.col("attrs").isNull(), fallback).otherwise(pipeline.severity(first("level")))
    d = d.withColumns({"message": F.coalesce(first("message"), F.col(line)), "status": status, "ts_ms": F.coalesce(pipeline.parse_time(first("time")), F.col(arrival_ms)), "parsed": F.col("attrs").isNotNull()})
    message, attrs = pipeline.redact(F.col("message")), pipeline.redact_attrs(F.col("attrs"))
    for s, c in configs.items():
        if c.redact_rules:
            message = F.when(is_(s), pipeline.redact(F.col("message"), c.redact_rules)).otherwise(message)
    return d.withColumns({"message": message, "attrs": attrs})


def requests(lines: DataFrame, source: str = "source", **columns: str) -> DataFrame:
    """One row per request of the `rails` lines: file_name, first_line, method, path, query, controller, action, status_code,
    duration_ms, exception, n_lines, complete (a Completed line was seen) and level.

    Lines of a request are joined by their id, however interleaved (log_entries); what isn't there is null.
    """
    e = log_entries(lines.where(F.col(source) == "rails"), source=source, **columns)
    get = lambda rx, i=1: F.nullif(F.regexp_extract("message", rx, i), F.lit(""))
    started = r'(?m)^Started ([A-Z]+) "([^"?]*)(?:\?([^"]*))?"'
    return e.select(
        "file_name", "first_line", get(started).alias("method"), get(started, 2).alias("path"), get(started, 3).alias("query"),
        get(r"(?m)^Processing by ([\w:]+)#\w+").alias("controller"), get(r"(?m)^Processing by [\w:]+#(\w+)").alias("action"),
        get(r"(?m)^Completed (\d{3})\b").try_cast("int").alias("status_code"), get(r"(?m)^Completed \d{3} .*? in (\d+(?:\.\d+)?)ms").try_cast("double").alias("duration_ms"),
        get(r"(?m)^([A-Z]\w*(?:::[A-Z]\w*)*) \(.*\):\s*$").alias("exception"), "n_lines", get(r"(?m)^(Completed) \d{3}\b").isNotNull().alias("complete"), "level",
    )
