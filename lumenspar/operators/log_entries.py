"""Log lines of different programs into entries with timestamp, level, component and message.

Literal routing: an Aho-Corasick automaton over the layouts' anchor literals scans each line once and retrieves the
layouts (`layouts.py`) that can apply; their anchored expressions, most specific first, verify the line and extract its fields. A line
without a header joins its predecessor; lines that carry a request id form one entry per id, however interleaved.

Files are cut into blocks of lines. A block's lines find their entry within the block; lines before a block's first
header get the last header of the blocks before it, found on one row per block. So a file of any size is spread over
tasks, and only its blocks' last headers meet.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta, timezone

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.operators.layouts import COMPONENT_FIELDS, LAYOUTS, LEVEL_FIELDS, TIME_FIELDS, Layout, compiled, value
from lumenspar.session import cut

# Level names, zones and JSON keys of the log formats read here.
LEVELS = {
    "DEBUG": "debug", "DEBUG1": "debug", "DEBUG2": "debug", "DEBUG3": "debug", "DEBUG4": "debug", "DEBUG5": "debug", "SILLY": "debug", "20": "debug", ".": "debug", "-": "debug",
    "WARN": "warn", "WARNING": "warn", "40": "warn", "#": "warn",
    "ERROR": "error", "50": "error",
    "CRITICAL": "critical", "FATAL": "critical", "PANIC": "critical", "60": "critical",
}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "CET": 1}
LEVEL_KEYS = ("level", "levelname", "severity")
TIME_KEYS = ("timestamp", "time", "ts", "@timestamp")
MESSAGE_KEYS = ("message", "msg")

OBJECT_COMPONENT = {"python": "logger", "winston": "tag"}


def level_of(name: object) -> str:
    return LEVELS.get(str(name).upper(), "info") if name is not None and not isinstance(name, bool) else "info"


def epoch_ms(x: object) -> int:
    """UTC ms of a time as text (ISO 8601, `29 Sep 2026 ...`, or with a zone name) or number (unit told by magnitude);
    0 if it is none with a date."""
    if isinstance(x, bool) or x is None:
        return 0
    if isinstance(x, (int, float)):
        for bound, scale in ((1e9, 0), (1e11, 1e3), (1e14, 1), (1e17, 1e-3), (1e20, 1e-6)):
            if abs(x) < bound:
                return int(x * scale) if scale != 1 else int(x)
        return 0
    s = str(x).strip()
    zone = None
    head, _, tail = s.rpartition(" ")
    if tail in ZONES and head:
        s, zone = head, timezone(timedelta(hours=ZONES[tail]))
    try:
        d = datetime.fromisoformat(s.replace(" +", "+").replace(" -", "-") if len(s) > 20 and s[-6:-4] in (" +", " -") else s)
    except ValueError:
        part = s.split(" ")
        if len(part) != 4 or part[1] not in MONTHS:
            return 0
        try:
            d = datetime.fromisoformat(f"{part[2]}-{MONTHS.index(part[1]) + 1:02d}-{int(part[0]):02d}T{part[3]}")
        except ValueError:
            return 0
    if len(s) < 11:
        return 0
    if d.tzinfo is None:
        d = d.replace(tzinfo=zone or UTC)
    return (d - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


class Router:
    """Aho-Corasick over the anchors of all layouts; a line's candidates are verified in the order of LAYOUTS."""

    def __init__(self) -> None:
        self.of: dict[str, list[tuple[int, Layout, re.Pattern[str], dict[str, str]]]] = {}
        masks: dict[str, int] = {"{": 1}  # bit 0: a JSON object
        for i, x in enumerate(LAYOUTS, 1):
            self.of.setdefault(x.source, []).append((1 << i, x, *compiled(x.format)))
            for a in x.anchors:
                masks[a] = masks.get(a, 0) | 1 << i
        self.automaton = ahocorasick.Automaton()
        for a, m in masks.items():
            self.automaton.add_word(a, m)
        self.automaton.make_automaton()

    def parse(self, source: str | None, line: str) -> dict | None:
        """The fields of a header line, or None for a line that continues an entry."""
        found = 0
        for _, m in self.automaton.iter(line):
            found |= m
        for bit, layout, rx, kinds in self.of.get(source or "", ()) if found else ():
            if found & bit and (m := rx.match(line)):
                f = {k: value(x, kinds[k]) for k, x in m.groupdict().items() if x is not None}
                if layout.source == "rails":
                    return self._request(f)
                first = lambda names, f=f: next((f[n] for n in names if n in f), None)
                ts = epoch_ms(first(TIME_FIELDS))
                if "utc" in f and not ts:
                    continue  # any word can stand where sidekiq's time does
                if "method" in f:
                    f["message"] = line[m.end("port") + 3 :]
                return {"level": level_of(first(LEVEL_FIELDS)), "component": first(COMPONENT_FIELDS) or "", "ts": ts, "message": f.get("message", ""), "fields": f}
        return self._object(source, line) if found & 1 and line[0] == "{" else None

    def _object(self, source: str | None, line: str) -> dict | None:
        try:
            o = json.loads(line)
        except (ValueError, RecursionError):
            return None
        first = lambda keys: next((o[k] for k in keys if k in o), None)
        comp, msg = o.get(OBJECT_COMPONENT.get(source or "", "")), first(MESSAGE_KEYS)
        return {"level": level_of(first(LEVEL_KEYS)), "component": comp if isinstance(comp, str) else "", "ts": epoch_ms(first(TIME_KEYS)), "message": msg if isinstance(msg, str) else line, "fields": o}

    def _request(self, f: dict) -> dict:
        """A line of a request, told by the words it begins with."""
        msg = f["message"]
        out = {"request": f["request"], "message": msg, "level": "info", "component": "", "ts": 0, "fields": f}
        begin, _, rest = msg.partition(" ")
        if begin == "Started":
            out["ts"] = epoch_ms(" ".join(rest.rstrip().rsplit(" at ", 1)[-1:]))
        elif begin == "Processing" and rest.startswith("by "):
            out["component"] = rest[3:].split("#", 1)[0] if "#" in rest else ""
        elif begin == "Completed":
            code = rest[:3]
            if code.isdigit() and len(code) == 3 and not rest[3:4].isalnum():
                out["code"] = int(code)
        elif msg.rstrip().endswith("):") and rest.startswith("(") and all(x.isidentifier() and x[0].isupper() for x in begin.split("::")):
            out["failed"] = True
        return out


FIELDS = "file string, line_no bigint, line string, request string, head boolean, level string, component string, ts bigint, message string, code int, failed boolean"


def parse_lines(lines: DataFrame, file: str, line_no: str, source: str, line: str, text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Router()
        names = [x.split()[0] for x in FIELDS.split(", ")]
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_())
        for b in batches:
            got = [r.parse(s, x) if x is not None else None for s, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            none: dict = {}
            get = lambda k, got=got, none=none: [(g or none).get(k) for g in got]
            blank = pa.nulls(b.num_rows, pa.string())
            cols = [b.column(0), b.column(1), b.column(3) if text else blank, get("request"), [g is not None for g in got], get("level"), get("component"), get("ts"), get("message") if text else blank, get("code"), [bool((g or none).get("failed")) for g in got]]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    d = lines.select(F.col(file).cast("string").alias("file"), F.col(line_no).cast("bigint").alias("line_no"), F.col(source).alias("source"), F.col(line).alias("line")).where("file is not null and line_no is not null")
    return d.mapInArrow(run, FIELDS)


def log_entries(lines: DataFrame, file: str = "file_name", line_no: str = "line_no", source: str = "source", line: str = "line", message: bool = True, block: int = 4096) -> DataFrame:
    """One row per entry: <file>, first_line, n_lines, level, component, ts_ms and, if asked for, message.

    Lines are ordered by line_no; rows with the same (file, line_no) are one line read twice. Rows with a null file or
    line_no are ignored; a null or empty line continues an entry; an unknown or null source knows JSON objects only.
    Lines before a file's first header form an entry of their own with level info, component '' and ts_ms 0. message is
    the header's message followed by the other lines of the entry. Empty in, empty out; further columns are ignored.
    """
    parsed = cut(parse_lines(lines, file, line_no, source, line, message).withColumn("block", F.floor(F.col("line_no") / block)))
    mark = F.when(F.col("head"), F.struct("line_no", F.coalesce("request", F.col("line_no").cast("string")).alias("entry")))
    first = F.min("line_no").over(Window.partitionBy("file"))
    ends = parsed.groupBy("file", "block").agg(F.max(mark).alias("m"), F.min("line_no").alias("line_no"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("file", "block", F.coalesce(F.last("m", ignorenulls=True).over(before)["entry"], first.cast("string")).alias("carry"))
    w = Window.partitionBy("file", "block").orderBy("line_no", F.desc("head"), F.desc("line"))
    d = parsed.join(carry, ["file", "block"]).withColumn("again", F.coalesce(F.lag("line_no").over(w) == F.col("line_no"), F.lit(False))).withColumn("entry", F.coalesce(F.last(mark, ignorenulls=True).over(w)["entry"], "carry")).where("not again")
    by = lambda c, cond: F.min_by(c, F.when(cond, F.col("line_no")))
    aggs = [
        F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.max(F.col("request").isNotNull()).alias("req"), by("level", F.col("head")).alias("level0"), F.max("failed").alias("failed"),
        by("code", F.col("code").isNotNull()).alias("code"), by("component", F.col("component") != "").alias("component0"), by("ts", F.col("ts") != 0).alias("ts0"),
    ]
    if message:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("message", "line").alias("x")))), lambda s: s["x"]), "\n").alias("message"))
    e = d.groupBy("file", "entry").agg(*aggs)
    level = F.when(~F.col("req"), F.coalesce("level0", F.lit("info"))).when(F.col("failed"), "error").when(F.col("code").isNull(), "warn").when(F.col("code") >= 500, "error").when(F.col("code") >= 400, "warn").otherwise("info")
    return e.select(F.col("file").alias(file), "first_line", "n_lines", level.alias("level"), F.coalesce("component0", F.lit("")).alias("component"), F.coalesce("ts0", F.lit(0)).cast("bigint").alias("ts_ms"), *(["message"] if message else []))
