"""Sentence units of documents in many languages and scripts.

A text is first cut where its layout cuts it: empty lines, headings, indented log excerpts, list items. Inside a block the
quotations and brackets are matched over its whole length, each mark by what it may do where it stands, and marks that match
nothing are set aside; so a stray one costs nothing but itself, and a boundary inside a matched pair is none, however long
the quotation. Then a semi-Markov dynamic programme selects whole spans: every span between two candidate boundaries, however
far apart, is scored by its closing (terminator, and whether the word before it is an abbreviation, an initial, an ordinal),
by how the text after it opens (capital, digit, opening mark, lower case, no space) and by its length. The length scores are
flat, then linear, so the best span that ends at a boundary is a maximum over a sliding window and a running one: the
programme looks at all spans in time linear in the boundaries.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations (lower case, without the last full stop) and marks.
NEVER_END = frozenset(
    "dr mr mrs ms mx prof st no nr vs viz e.g i.e approx inc fig figs eq cf pp vol ed eds jr dept sec rev gen col capt "
    "hr fr ca vgl bzw evtl ggf sog inkl zzgl abs art str tel z.b d.h u.a "
    "mme mlle env ex "
    "sr sra srta dra ud uds ej pág págs núm n.º ee "
    "см рис стр напр тыс млн млрд ул им проф г-н г-жа "
    "डॉ श्री प्रो د".split()
)
MAY_END = frozenset("etc a.m p.m am pm u.s u.k u.n usw uu г гг мин сек час т.д т.п д п al co corp ltd".split())
ORDINAL_NEXT = frozenset("januar februar märz april mai juni juli august september oktober november dezember quartal jahrhundert halbjahr mal stock kapitel januars".split())
# small words that go on with a sentence after a quotation
CONTINUES = frozenset(
    "and or but nor so yet then while when because as in on at to from with for of is was he she they said says asked wrote replied added "
    "und oder aber dann als weil sagte schrieb fragte et ou mais puis dit écrit demande y o pero luego dijo preguntó escribió "
    "и а но или затем сказал сказала написал написала спросил спросила".split()
)
TERMINATORS = ".!?…。！？।؟"
OPEN = {"„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "“": "”", "‚": "‘’"}
CLOSE = frozenset("”»」』)]）")
CJK_END = frozenset("。！？…")

_TERM = re.compile(r"[.!?…。！？।؟]+(?:[\"”’»)\]」』）“]|[   ]»)*")
_TOKEN = re.compile(r"[^\s(\[\"“„«]+")
_SPACED = re.compile(r"\S+")
_THAI = re.compile(r"[฀-๿]")
_QUOTES = re.compile(r"[„“”«»「」『』()\[\]（）\"]")
_FIRST = re.compile(r"\w*")
_WORDISH = re.compile(r"\w")
_JOINT = frozenset("abcdefghijklmnopqrstuvwxyz)") | frozenset("àâäáãåçéèêëíìîïñóòôöõúùûüýßœæабвгдежзийклмнопрстуфхцчшщъыьэюя")
_CLOSES = {c: tuple(o for o, cs in OPEN.items() if c in cs) for c in "”»」』)]）“"} | {'"': ('"',)}
_CLOSES["“"] = ("„", "“")

ABBREVIATION = 40  # no abbreviation or row of initials is longer than this
LONG = 400  # characters from which on a span loses by its length


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯"


def _closing(text: str, at: int, term: str, token: int, before: int) -> float:
    """Score of ending at a run of terminators that begins at `at`, after the token that begins at `token`; before: the end
    of the run of terminators before this one."""
    marks = term.rstrip("\"”’»)]」』）“   ")
    if any(c in "!?。！？।؟" for c in marks):
        return 3.0
    if "…" in marks or len(marks) > 1:
        spaced = at == 0 or text[at - 1].isspace()
        return -0.5 if spaced else 1.5 if "…" in marks else 0.7
    word = text[token:at]
    if not word:
        return 0.5  # a full stop on its own
    if before > token and at - before > 1 and text[before].isupper() and text[before - 2 : before - 1].strip() and text[before - 2] in _JOINT and "_" not in text[before:at] and text[before:at].isalnum() and before - 1 > token + 1:
        word = text[before:at]  # a sentence begun without a space
    if len(word) > ABBREVIATION:
        return 2.0
    word = word.lower()
    bare = word.strip("'’»”\")")
    if bare in MAY_END:
        return -1.0
    if bare in NEVER_END:
        return -6.0
    if len(bare) == 1 and bare.isalpha():
        if text[at - len(word) : at].isupper() or not _numeric_before(text, token):
            return -6.0 if not _is_cjk(bare) else 2.0
    elif re.fullmatch(r"(?:\w\.)+\w", bare) and not any(c.isdigit() for c in bare):
        return -1.0
    return 2.0


def _numeric_before(text: str, at: int) -> bool:
    i = at - 1
    while i >= 0 and text[i].isspace():
        i -= 1
    return i >= 0 and (text[i].isdigit() or text[i] in "%")


def _opening(text: str, term: str, end: int, nxt: int, stop: int) -> float | None:
    """Score of the text at nxt opening a sentence after a boundary at end; None if nothing can open there."""
    c = text[nxt]
    spaced = nxt > end
    quoted = term[-1] in "\"”’»)]」』）“"
    if not spaced:
        if quoted:
            return -5.0 if _is_cjk(c) or c.islower() else -1.5 if c.isalpha() else None
        if term[-1] in CJK_END:
            return 1.0
        if term[-1] in "!?।؟":  # in a URL a question mark is followed by a small letter
            return 0.5 if c.isalpha() and not c.islower() or c in "¿¡“„«(「" else None
        # a full stop without a space: only before a capital that opens a word
        after = text[nxt + 1] if nxt + 1 < stop else " "
        if c.isupper() and (after.islower() or after.isspace() or after in "'’"):
            return 0.5
        return 0.5 if c in "¿¡“„«「" or _is_cjk(c) else None
    if c in ",;:)]»”、，；：":
        return -6.0
    if quoted and c.islower() and (term[0] != "." and term[-1] not in ")]）" or _FIRST.match(text, nxt, stop).group() in CONTINUES):
        return -4.0  # "...?" asked
    if c.islower():
        return -1.0
    if c.isupper() or c in "¿¡“„«\"'(「『[" or _is_cjk(c) or c.isalpha():
        return 1.5
    return 0.5  # digits and the like


def _pairs(text: str, start: int, stop: int) -> tuple[list[int], list[int], set[int]]:
    """Matched quotations and brackets: (begins, ends) of the outermost pairs in order, and the marks that open a pair."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}  # how many of each mark are open
    pairs: list[tuple[int, int]] = []
    for m in _QUOTES.finditer(text, start, stop):
        c, at = m.group(), m.start()
        may_close = at > start and not text[at - 1].isspace()
        may_open = at + 1 < stop and not text[at + 1].isspace()
        closes = None
        if may_close or c not in '"“':
            for o in _CLOSES.get(c, ()):
                if held.get(o) and not (c == o == "“" and may_open):
                    closes = o
                    break
        if closes:
            while True:  # what was opened inside and never closed is stray
                o, begin = stack.pop()
                held[o] -= 1
                if o == closes:
                    pairs.append((begin, at))
                    break
        elif c in OPEN or c == '"':
            if may_open or c not in "\"“":
                if held.get(c) and c == '"':  # the one before was stray, and what came since is no longer inside it
                    i = max(i for i, (o, _) in enumerate(stack) if o == c)
                    del stack[i]
                    held[c] -= 1
                stack.append((c, at))
                held[c] = held.get(c, 0) + 1
    pairs.sort()
    begins, ends = [], []
    for a, b in pairs:
        if not ends or a > ends[-1]:
            begins.append(a)
            ends.append(b)
    return begins, ends, {a for a, _ in pairs}


def _short(text: str, a: int, b: int) -> float:
    """Length score of a span of less than four characters."""
    return -6.0 if b - a < 3 and not _WORDISH.search(text, a, b) else -0.5  # nothing but marks


def best_spans(text: str, begins: list[int], ends: list[int], gain: list[float]) -> list[tuple[int, int]]:
    """The spans (begins[i], ends[j]), i <= j, that follow one another from begins[0] to ends[-1] with the highest sum of
    gain[j] and length score: _short below 4 characters, 0 up to LONG, then -(n - LONG) / LONG."""
    n = len(ends)
    best, back = [0.0], [0]
    window: deque[int] = deque()  # of the starts at 4 to LONG characters, those not beaten by a later one
    far, far_at = float("-inf"), 0  # best[i] + begins[i] / LONG of the starts farther back
    near = gone = 0  # starts put into the window; starts that left it
    for j in range(n):
        end = ends[j]
        while near <= j and end - begins[near] >= 4:
            while window and best[window[-1]] < best[near]:
                window.pop()
            window.append(near)
            near += 1
        while gone < near and end - begins[gone] > LONG:
            if (x := best[gone] + begins[gone] / LONG) > far:
                far, far_at = x, gone
            if window and window[0] == gone:
                window.popleft()
            gone += 1
        top, at = far - (end - LONG) / LONG, far_at
        if window and best[window[0]] >= top:
            top, at = best[window[0]], window[0]
        for i in range(near, j + 1):  # starts less than 4 characters away
            if (x := best[i] + _short(text, begins[i], end)) > top:
                top, at = x, i
        best.append(top + gain[j])
        back.append(at)
    cuts, j = [], n
    while j:
        cuts.append((begins[back[j]], ends[j - 1]))
        j = back[j]
    return cuts[::-1]


def segment(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Best segmentation of one block [start, stop) into spans without white space around them."""
    while start < stop and text[start].isspace():
        start += 1
    while stop > start and text[stop - 1].isspace():
        stop -= 1
    if start >= stop:
        return
    opens, closes, opening = _pairs(text, start, stop)
    cands: dict[int, tuple[int, float]] = {}  # end -> next start, closing + opening
    tokens = _TOKEN.finditer(text, start, stop)
    token = next(tokens, None)
    before = start
    for m in _TERM.finditer(text, start, stop):
        end, term = m.end(), m.group()
        while token and token.end() < m.start():
            token = next(tokens, None)
        first = token.start() if token and token.start() <= m.start() <= token.end() else m.start()
        last, before = before, end
        if term[-1] == "“" and end - 1 in opening:
            end, term = end - 1, term[:-1]
        nxt = end
        while nxt < stop and text[nxt].isspace():
            nxt += 1
        if nxt >= stop:
            continue
        o = _opening(text, term, end, nxt, stop)
        if o is None:
            continue
        score = _closing(text, m.start(), term, first, last) + o
        if term == "." and text[m.start() - 1 : m.start()].isdigit() and text[nxt : nxt + 12].split(" ")[0].split("\n")[0].strip(".,").lower() in ORDINAL_NEXT:
            score = -4.0
        cands[end] = nxt, score
    if _THAI.search(text, start, stop):
        left = None
        for m in _SPACED.finditer(text, start, stop):
            thai = _THAI.search(m.group()) is not None
            if left and left[1] and thai:
                cands[left[0]] = m.start(), 4.0
            left = m.end(), thai
    begins, ends, gain = [start], [], []
    for end in sorted(cands):
        i = bisect_right(opens, end - 1) - 1
        if i >= 0 and end <= closes[i]:
            continue  # inside a quotation or brackets
        nxt, score = cands[end]
        ends.append(end)
        begins.append(nxt)
        gain.append(score)
    yield from best_spans(text, begins, [*ends, stop], [*gain, 0.0])


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in order, in code points."""
    out: list[tuple[int, int]] = []
    at, run = 0, -1  # run: where the current paragraph begins
    for line in text.split("\n"):
        end = at + len(line)
        bare = line.strip()
        own = "list" if line.startswith("- ") else "unit" if re.match(r"#{1,6}\s|    |\t", line) and bare else ""
        if (not bare or own) and run >= 0:
            out += segment(text, run, at)
            run = -1
        if own == "list":
            out += segment(text, at, end)
        elif own:
            a = at + len(line) - len(line.lstrip())
            out.append((a, a + len(bare)))
        elif bare and run < 0:
            run = at
        at = end + 1
    if run >= 0:
        out += segment(text, run, len(text))
    return out


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, start_pos, end_pos[, sentence]): the sentence units of every document, one row each.

    Null, empty and blank texts give no row; a repeated document gives its rows again; positions are code points of the
    whole text. Texts of any length are handled: a block is scored in time linear in its candidate boundaries.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ix, a, z, s = [], [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                for p, q in sentences(x):
                    ix.append(i)
                    a.append(p)
                    z.append(q)
                    if with_text:
                        s.append(x[p:q])
            cols = [b.column(0).take(pa.array(ix, pa.int64())), pa.array(a, pa.int64()), pa.array(z, pa.int64())]
            yield pa.record_batch(cols + ([pa.array(s, pa.string())] if with_text else []), names=["k", "start_pos", "end_pos", *(["sentence"] if with_text else [])])

    d = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("x")).where("x is not null and x <> ''")
    return d.mapInArrow(run, f"k {kind}, start_pos bigint, end_pos bigint" + (", sentence string" if with_text else "")).withColumnRenamed("k", doc_id)
