"""Personal information in free text, replaced by typed placeholders.

Weak supervision: independent labelers (shape expressions, a gazetteer, words around the span) propose or vote on spans.
No labeler is trusted by hand: expectation-maximisation over the counts of vote patterns estimates, for each kind, how
often each labeler is right, and from that how likely each pattern is to mean a true span. A span classifier (logistic
regression over votes, shape and neighbouring words) is trained on those probabilities and decides every span, so that a
span can be kept or dropped against its votes when its shape and context say so.

Only two things reach the driver: counts of vote patterns (at most 2 ** labelers per kind) and the bounded sample of
candidate spans the classifier is fitted on (`sample_rows`, by hash of the text; everything else covers all rows).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspar.session import cut

KINDS = ("email", "phone", "id_number", "address", "name")
CLAIMS = ("email", "id_number", "phone", "address", "name")  # the order in which kinds claim text

# Shapes and words of personal data.
_L, _R = r"(?<![\w@+./-])", r"(?![\w@])"
_W = r"(?:\p{Lu}[\p{Ll}\p{M}]+(?:['’\-]\p{Lu}[\p{Ll}\p{M}]+)*|\p{Lu}['’]\p{Lu}[\p{Ll}\p{M}]+|\p{Lu}{2,}(?:['’\-]\p{Lu}{2,})*|\p{Lu}['’]\p{Lu}{2,})"
_TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Mx|Herr|Frau|Sra?|Mme)\.?"
_GREET = r"(?i:Dear|Hello|Hi|Hey|Liebe|Lieber|Sehr|Querido|Querida|Cher|Chère|Bonjour|Hallo|Hola|Kennwort|GET|POST|PUT)"
# words that open a sentence or an order, not a name
_OPENER = r"(?i:Call|Ask|Tell|Email|Mail|Contact|Meet|Thanks|Thank|From|With|And|The|This|That|These|Our|Your|My|His|Her|Their|When|Where|What|Who|Why|How|If|But|Please|Note|See|Send|Sent|Paid|Call[ei]ng|Called|Regards|Sincerely|Best|Yours|Signed|Attn|Re|Fwd|Subject|User|Name|Customer|Patient|Client|Contacto|Llamar|Für|Von|Por|Para|Pour)"
_HELLO = r"(?:Dear|Hello|Hi|Hey|Hallo|Hola|Bonjour|Liebe|Lieber|Querido|Querida|Cher|Chère|Caro|Cara|Ciao)"
_EAST = r"(?:\p{Han}{1,3}[ ·]?(?:\p{Han}{1,3}|\p{Hangul}{1,3}|[\p{Hiragana}\p{Katakana}]{1,4})|\p{Hangul}{1,2} ?\p{Hangul}{1,3})"
_TOWN = rf"(?:[,\s]\s*(?:(?:Apt|Flat|Unit|Suite) \d+\w?|\d{{1,2}}\.º ?\w|\d{{4,5}}(?= \p{{Lu}})|{_W}(?: {_W})?(?: \d{{4,6}})?)){{0,3}}"
_STREET = r"(?i:Lane|Road|Rd|Street|St|Avenue|Ave|Blvd|Boulevard|Court|Ct|Drive|Way|Square|Place|Terrace|Close|Crescent)\b\.?"
SHAPES: dict[str, tuple[str, str]] = {  # labeler -> (kind, expression)
    "email_plain": ("email", r"(?<![\w.+-])[\p{L}\d_.+%-]+@(?:[\p{L}\d-]+\.)+\p{L}{2,}\b"),
    "email_spelt": ("email", r"(?<![\w.+-])[\w.+-]+\s?(?:\(at\)|\[at\]|\{at\}|\bAT\b|\bat\b(?=\s?[\w-]+\s?(?:\(dot\)|\[dot\]|\bdot\b)))\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b|\bDOT\b)\s?[\w-]+)+"),
    "id_keyed": ("id_number", rf"\b(?i:SSN|Steuer-ID|national id|ID card no\.?|passport(?: no\.?| number| nr\.?)?|driving licen[cs]e(?: no\.?| number)?|tax id|identity card|personal id|NHS number|CPF|DNI|NIE|Ausweisnummer|numéro de sécurité sociale)[:# ]*(?=[A-Z0-9])[A-Z]{{0,2}} ?\d[\dA-Z]*(?:[ .\-][\dA-Z]*\d[\dA-Z]*)*(?: [A-D])?{_R}"),
    "id_shape": ("id_number", rf"{_L}(?:\d{{3}}-\d{{2}}-\d{{4}}|[A-CEGHJ-PR-TW-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]|QQ ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]|\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}|\d{{6}}-\d{{5}}|[A-Z]\d{{3}}-\d{{4}}-\d{{4}}|[A-Z]\d{{2}}[A-Z]\d{{5}}|[A-Z]\d{{7}}|\d{{2}} \d{{3}} \d{{3}} \d{{3}})(?![\w-])"),
    "phone_world": ("phone", r"(?<![\w.+-])(?:tel:)?(?:\+\d{1,3}|00\d{1,3}(?=[ .-]))(?:[ .-]?\(?\d{1,5}\)?){2,6}(?![\w@]|[.-]\d)"),
    "phone_local": ("phone", r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?:,? ?(?:ext|x)\.? ?\d{1,5})?(?![\w@]|[.-]\d)|(?<![\w.+-])0\d{1,4}[ -]\d{3,4}[ -]?\d{2,4}(?![\w@]|[.-]\d)|(?<=\b(?i:tel|telephone|phone|mobile|cell|fax|telefon|teléfono|téléphone)(?:\.|:|\.:)? )\d{7,15}(?![\w@])|(?<![\w.+-])\d{3}-\d{4},? (?:ext|x)\.? ?\d{1,5}\b"),
    "address_number": ("address", rf"(?:(?:Flat|Apt|Unit|Suite) \d+\w?, ?)?\b\d{{1,5}}[a-zA-Z]?,? (?:[NSEW]\. )?(?:\p{{Lu}}[\p{{L}}'’.\-]* ){{1,3}}{_STREET}{_TOWN}"),
    "address_other": ("address", rf"\b\d{{1,4}}(?: ?(?:bis|ter))?,? (?i:rue|avenue|boulevard|place|chemin|allée|quai) (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?\p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}\-]+)?{_TOWN}|\b(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera) (?:(?:de la|de los|del|de) )?\p{{Lu}}[\p{{L}}\-]+(?: \p{{Lu}}[\p{{L}}\-]+)? \d{{1,4}}\w?{_TOWN}|\b\p{{Lu}}[\p{{Ll}}\-]+(?:str\.|straße|strasse|weg|platz|allee|gasse) \d{{1,4}} ?[a-z]?{_TOWN}|\b(?:Am|An der|An den|Im|Zum|Zur|Auf der|Auf dem) \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)? \d{{1,4}} ?[a-z]?\b{_TOWN}"),
    "name_shape": ("name", rf"(?<![\w'’\-@.])(?!{_GREET}\b)(?!{_OPENER} )(?:{_TITLE} {_W}(?: {_W})?|{_W}(?: \p{{Lu}}\.)? {_W}|\p{{Lu}}\. {_W}|{_W}, {_W})(?![\w@])"),
    "name_east": ("name", rf"(?<![\p{{Han}}\p{{Hangul}}\p{{Hiragana}}\p{{Katakana}}]){_EAST}(?![\p{{Han}}\p{{Hangul}}\p{{Hiragana}}\p{{Katakana}}])|\p{{Han}}{{2,5}}(?=さん|さま|様|先生|女士)|\p{{Hangul}}{{2,4}}(?= ?(?:씨|님))|(?<=\b{_HELLO} ){_W}(?=[,!.:;]|$)"),
}
# words beside personal data: what introduces it and what goes on after it
BEFORE = {
    "email": r"(?i)(?:e-?mails?|mails?|address|account|contact|from|to|at|is|and|or|cc|bcc|for|of|with|[:=(<\[\"'])[\s\"'(<:=]*$",
    "phone": r"(?i)(?:sms|text(?:ed)?|call(?:ed|back)?|dial(?:led)?|ring|number|phone|tel|telephone|fax|mobile|cell|handy|rückruf|to|from|at|al|on|under|unter|a|or|and|[:=/(])[\s:=/.(]*$",
    "id_number": r"(?i)(?:doc(?:ument)?|passport|licen[cs]e|card|identity|id|ssn|tax|number|no|nr|gave|is|was|same|failed|[:=])[\s:=.]*$",
    "address": r"(?i)(?:ships?|deliver(?:ed|y)?|lives?|moved|from|to|at|in|address|home|street|find|inconnue|is|[:=,])[\s:=]*$",
    "name": r"(?i)(?:\b(?:dear|hello|hi|hey|mr|mrs|ms|dr|as|by|for|with|of|is|from|to|and|or|cc|user|name|holder|owner|customer|patient|contact|call|called|ask|tell|met|said|für|von|an|a|por|para|pour|de)|['’]s|[=:])[\s\"'(<]*$",
}
AFTER = {
    "name": r"(?i)^(?:\s(?:said|says|asked|asks|wrote|writes|called|calls|replied|refused|has|was|is|at|al|and|zurückgesetzt|\(|<)|,\s(?:your|i\b|you\b|flat|apt|\d)|;|,?\s?\d)",
    "phone": r"(?i)^(?:\s(?:texted|called|rang|not|is|was|antes|before|after|or|and|ext|mail)|;|,|/\d|\)|$)",
    "email": r"(?i)^(?:\s(?:after|before|is|was|bounced|thx|and|or|for)|[)>\"':;,\]]|\?subject|$)",
    "id_number": r"(?i)^(?:\s(?:for|is|was|expired|and)|[;,.)]|$)",
    "address": r"(?i)^(?:$|[;.)]|\s(?:to|and|is|was)\b)",
}
# gazetteers of the gazetteer labeler: widespread given names, family names, and places; the lists may be replaced
GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew george kevin brian edward peter henry jack oliver harry samuel adam simon martin alexander "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy margaret sandra ashley emily anna emma olivia sophia alice grace chloe lucy julia laura maria helen ruth jane kate claire "
    "hans peter klaus jürgen wolfgang stefan andreas thomas uwe karl heinz lukas felix jonas ursula renate monika petra sabine heike anja katrin lena jan "
    "josé juan luis carlos miguel antonio manuel francisco javier pedro pablo jorge diego carmen ana isabel pilar lucía sofía marta elena rosa "
    "jean pierre michel philippe alain nicolas françois jacques marie nathalie isabelle sylvie catherine camille chloé amélie anaïs "
    "ivan sergey dmitry alexei mikhail nikolai olga tatiana natalia svetlana irina ahmed mohammed ali omar hassan fatima aisha layla raj amit priya anil sunita wei li ming yuki hiroshi kenji sakura min ji".split()
)
FAMILY = frozenset(
    "smith johnson williams brown jones miller davis wilson anderson taylor thomas moore martin jackson thompson white harris clark lewis robinson walker young allen king wright scott green baker adams nelson hill campbell mitchell roberts carter phillips evans turner parker collins edwards stewart morris murphy cook rogers "
    "müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz zimmermann braun krüger "
    "garcía garcia rodríguez rodriguez martínez martinez hernández lópez lopez gonzález gonzalez pérez perez sánchez sanchez ramírez torres flores rivera gómez díaz moreno álvarez romero ruiz alonso "
    "bernard dubois robert petit durand leroy moreau simon laurent lefebvre michel roux david bertrand morel fournier girard "
    "ivanov smirnov kuznetsov popov petrov sokolov khan singh kumar sharma patel gupta nguyen tran kim lee park choi wang chen zhang liu yang huang wu zhou tanaka suzuki sato takahashi watanabe ito yamamoto nakamura kobayashi".split()
)
EAST_FAMILY = tuple("王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何高林罗羅郑鄭梁谢謝宋唐许許邓鄧韩韓冯馮曹彭曾田董潘袁蔡蒋蔣余于杜叶葉程苏蘇魏吕呂丁任卢盧김이박최정강조윤장임한오서신권황안송류홍") + ("佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "松本", "井上", "木村", "清水", "山口")
PLACES = frozenset(
    "london paris berlin madrid rome vienna dublin lisbon munich hamburg cologne frankfurt zürich geneva brussels amsterdam barcelona valencia sevilla lyon marseille lille york boston chicago houston dallas austin denver seattle portland miami atlanta toronto sydney melbourne "
    "flat apt suite unit lane road rd street st avenue ave blvd boulevard court ct drive way square place terrace close crescent rue calle avenida plaza paseo chemin allée quai straße strasse weg platz gasse".split()
)
# words of programs, not of people
TECH = frozenset(
    "worker pool health check main loop grace period lane cache queue build deploy token order session chunk trace peer range address space name resolution email user limit phone home database error slow query api get post put delete patch head http https json key value node shard index disk memory cpu load thread process service server client request response job task retry timeout lease stop start done info warn warning debug fatal critical system control plane data center control group access gateway load balancer rate limiter circuit breaker event bus message broker garbage collector heap dump stack".split()
)
KINDS_OF = {n: k for n, (k, _) in SHAPES.items()}
VOTES = ("shape_a", "shape_b", "before", "after", "gazetteer")  # of one kind: its two shapes, context on either side, gazetteer
RX = {n: regex.compile(x) for n, (_, x) in SHAPES.items()}
RX_BEFORE = {k: regex.compile(x) for k, x in BEFORE.items()}
RX_AFTER = {k: regex.compile(x) for k, x in AFTER.items()}
WORD = regex.compile(r"\w+")
ORDER = ("email_plain", "email_spelt", "id_keyed", "id_shape", "phone_world", "phone_local", "address_number", "address_other", "name_shape", "name_east")
SHAPES_OF = {k: [n for n in ORDER if KINDS_OF[n] == k] for k in KINDS}
# what a text must hold for a shape to be looked for at all: cheaper than the shape, and never narrower
DIGIT = regex.compile(r"\d")
NUMBERED = frozenset(("id_number", "phone", "address"))
NEEDS = {"email_plain": regex.compile("@"), "email_spelt": regex.compile(r"(?i)at"), "name_east": regex.compile(rf"[\p{{Han}}\p{{Hangul}}]|{_HELLO}"), "name_shape": regex.compile(r"\p{Lu}")}
TLD = frozenset("com org net test example invalid io dev de fr es uk edu gov info local".split())
TITLES = regex.compile(rf"^{_TITLE} ")
WORTH = regex.compile(r"[@\p{Lu}\p{Han}\p{Hangul}\d]|\bat\b")
DIM = 1 << 12


@dataclass
class Span:
    start: int
    end: int
    kind: str
    votes: tuple[int, ...]  # 1 for, 0 abstains, -1 against


def _gazetteer(kind: str, text: str) -> int:
    words = [w.lower() for w in WORD.findall(text)]
    if kind == "name":
        if TITLES.match(text) or text.startswith(EAST_FAMILY):
            return 1
        if words and sum(w in TECH for w in words) * 2 >= len(words):
            return -1
        return int(any(w in GIVEN or w in FAMILY for w in words))
    if kind == "email":
        return 1 if words and words[-1] in TLD else 0
    if kind == "address":
        return 1 if any(w in PLACES or w.endswith(("straße", "strasse", "str", "weg", "platz", "gasse", "allee")) for w in words) else 0
    if kind == "phone":
        return 1 if 7 <= sum(c.isdigit() for c in text) <= 15 else -1
    return 1 if any(not w.isdigit() for w in words) else 0


def candidates(text: str) -> list[Span]:
    """Spans proposed by at least one shape labeler, not overlapping, with everybody's votes. Kinds with stricter shapes
    claim their text first, so a name is never looked for inside an e-mail address or a street."""
    if not WORTH.search(text):
        return []
    out: list[Span] = []
    masked = text
    numbers = DIGIT.search(text) is not None
    for kind in CLAIMS:
        if kind in NUMBERED and not numbers:
            continue
        shapes = SHAPES_OF[kind]
        got: list[tuple[int, int, set[str]]] = []
        for n in shapes:
            if n in NEEDS and not NEEDS[n].search(text):
                continue
            for m in RX[n].finditer(masked):
                a, b = m.span()
                while a < b and masked[a].isspace():
                    a += 1
                if a < b:
                    got.append((a, b, {n}))
        got.sort(key=lambda x: (x[0], -x[1]))
        merged: list[tuple[int, int, set[str]]] = []
        for a, b, who in got:
            if merged and a < merged[-1][1]:
                p = merged[-1]
                merged[-1] = (p[0], max(p[1], b), p[2] | who)
            else:
                merged.append((a, b, who))
        for a, b, who in merged:
            left, right = text[max(0, a - 40) : a], text[b : b + 24]
            votes = tuple(int(n in who) for n in shapes) + (int(bool(RX_BEFORE[kind].search(left)) or a == 0 and b == len(text)), int(bool(RX_AFTER[kind].search(right))), _gazetteer(kind, text[a:b]))
            out.append(Span(a, b, kind, votes))
            masked = masked[:a] + "\x00" * (b - a) + masked[b:]
    return out


def pattern(s: Span) -> int:
    """The votes as one number, base 3."""
    p = 0
    for v in s.votes:
        p = p * 3 + v + 1
    return p


def _votes_of(p: int) -> tuple[int, ...]:
    out = []
    for _ in VOTES:
        out.append(p % 3 - 1)
        p //= 3
    return tuple(reversed(out))


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Probability that a vote pattern means a true span, by EM over two classes with conditionally independent labelers.

    The start takes the majority of votes; Laplace smoothing keeps rare votes from becoming certain; the class with the
    more votes for is the true one.
    """
    pats = list(counts)
    if not pats:
        return {}
    votes, n = np.array([_votes_of(p) for p in pats]), np.array([counts[p] for p in pats], float)
    post = 1 / (1 + np.exp(-(votes.sum(1) - 1.0)))
    one = np.stack([(votes == v) for v in (-1, 0, 1)], 2).astype(float)  # pattern, labeler, vote
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        prior = np.clip(w.sum(1) / n.sum(), 0.02, 0.98)
        theta = np.stack([np.einsum("p,plv->lv", w[c], one) + 0.5 for c in (0, 1)])
        # a vote for is never evidence against, a vote against never evidence for, and abstaining is no evidence
        theta /= theta.sum(2, keepdims=True)
        # labelers are better than chance: a true span is seldom voted against, a false one seldom has context (shapes
        # propose every candidate, so their votes are free)
        theta[1, :, 0], theta[0, 2:, 2] = np.minimum(theta[1, :, 0], 0.02), np.minimum(theta[0, 2:, 2], 0.1)
        ratio = np.log(theta[1]) - np.log(theta[0])
        ratio[:, 2], ratio[:, 1], ratio[:, 0] = np.maximum(ratio[:, 2], 0), 0, np.minimum(ratio[:, 0], 0)
        score = np.log(prior[1] / prior[0]) + np.einsum("plv,lv->p", one, ratio)
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return dict(zip(pats, post.tolist(), strict=True))


def features(text: str, s: Span) -> list[int]:
    """Hashed features of a span: votes, shape, words beside it."""
    inner = text[s.start : s.end]
    words = WORD.findall(inner)
    left, right = WORD.findall(text[max(0, s.start - 30) : s.start])[-2:], WORD.findall(text[s.end : s.end + 30])[:2]
    shape = "".join(sorted({"9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "." for c in inner}))
    raw = [f"v{i}{v}" for i, v in enumerate(s.votes)] + [f"s{shape}", f"n{min(len(words), 8)}", f"d{min(sum(c.isdigit() for c in inner), 16) // 3}", f"b{s.start == 0}", f"e{s.end == len(text)}"]
    raw += [f"l{i}{w.lower()}" for i, w in enumerate(reversed(left))] + [f"r{i}{w.lower()}" for i, w in enumerate(right)] + [f"t{w.lower()}" for w in words if w.lower() in TECH]
    return [zlib.crc32(f"{s.kind}|{x}".encode()) % DIM for x in raw]


def train(rows: list[tuple[list[int], float]], rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on soft labels (full-batch Adam; the last weight is the bias)."""
    w = np.zeros(DIM + 1)
    if not rows:
        return w
    at = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    ix, y = np.concatenate([f for f, _ in rows]), np.array([p for _, p in rows])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(at, w[ix], len(rows)) + w[-1])))
        e = (p - y) / len(rows)
        g = np.append(np.bincount(ix, e[at], DIM), e.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fields(logs: DataFrame, message: str = "message", attrs: str = "attrs", names: tuple[str, ...] = ("user", "token"), key: str = "seq") -> DataFrame:
    """(key, field, text): the message and the named string attributes of each log; null and empty texts are left out."""
    get = [F.struct(F.lit(n).alias("field"), F.get_json_object(attrs, f"$.{n}").alias("text")) for n in names]
    return logs.select(F.col(key), F.explode(F.array(F.struct(F.lit("message").alias("field"), F.col(message).alias("text")), *get)).alias("f")).select(key, "f.field", "f.text").where("text is not null and text <> ''")


SPAN = "kind string, start int, end int, pattern bigint, h bigint, features array<int>"


def candidate_spans(texts: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """(key, field, kind, start, end, pattern, h, features): the candidates of every text with their votes as one number,
    a hash of where they stand, and their features. The rest of the work needs no text."""
    keys = [c for c in (key, "field") if c in texts.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ix, cols = [], ([], [], [], [], [], [])
            for i, x in enumerate(b.column(len(keys)).to_pylist()):
                for s in candidates(x):
                    ix.append(i)
                    for c, v in zip(cols, (s.kind, s.start, s.end, pattern(s), zlib.crc32(f"{s.start}|{x}".encode()), features(x, s)), strict=True):
                        c.append(v)
            at = pa.array(ix, pa.int64())
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.record_batch([*(b.column(j).take(at) for j in range(len(keys))), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*keys, *(x.split()[0] for x in SPAN.split(", "))])

    schema = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keys)
    return texts.select(*keys, text).where(F.col(text).isNotNull()).mapInArrow(run, schema + SPAN)


class PiiFinder:
    """Fitted reliabilities and span classifier; apply with spans() or redact()."""

    def __init__(self, weights: np.ndarray, reliability: dict[str, dict[int, float]]) -> None:
        self.weights, self.reliability = weights, reliability

    @classmethod
    def fit(cls, texts: DataFrame, sample_rows: int = 20_000, text: str = "text") -> PiiFinder:
        return cls.fit_spans(cut(candidate_spans(texts, text=text), "spans"), sample_rows)

    @classmethod
    def fit_spans(cls, spans: DataFrame, sample_rows: int = 20_000) -> PiiFinder:
        """Vote patterns are counted over all candidate_spans; the classifier is fitted on at most `sample_rows` of them:
        of each pattern the 400 with the smallest hashes, whatever the partitions."""
        counts: dict[str, dict[int, int]] = {k: {} for k in KINDS}
        for r in spans.groupBy("kind", "pattern").agg(F.count("*").alias("n")).collect():  # at most 3 ** 5 patterns a kind
            counts[r["kind"]][r["pattern"]] = r["n"]
        reliability = {k: estimate(c) for k, c in counts.items()}
        one = spans.groupBy("kind", "pattern", "h").agg(F.min("features").alias("features"))
        rank = F.row_number().over(Window.partitionBy("kind", "pattern").orderBy("h"))  # cut to 400 in each partition first
        own = one.withColumn("r", rank).where("r <= 400")
        rows = own.orderBy("h", "kind", "pattern").limit(sample_rows).select("kind", "pattern", "features").collect()
        return cls(train([(list(r["features"]), reliability[r["kind"]][r["pattern"]]) for r in rows]), reliability)

    def classify(self, spans: DataFrame) -> DataFrame:
        """Those candidate_spans that the classifier takes for personal information."""
        w = self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = b.column(b.schema.get_field_index("features"))
                off = f.offsets.to_numpy()
                z = np.add.reduceat(np.append(w[f.values.to_numpy()], 0.0), off[:-1]) + w[-1] if b.num_rows else np.zeros(0)
                yield b.filter(pa.array(z > 0))

        return spans.mapInArrow(run, spans.schema)

    def find(self, text: str) -> list[Span]:
        out = []
        for s in candidates(text):
            z = self.weights[features(text, s)].sum() + self.weights[-1]
            if z > 0:
                out.append(s)
        return sorted(out, key=lambda s: s.start)

    def redact_text(self, text: str) -> str:
        out, at = [], 0
        for s in self.find(text):
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        return "".join([*out, text[at:]])

    def spans(self, texts: DataFrame, key: str = "seq") -> DataFrame:
        """(key, field, kind, start, end) of every span found, in code points of the text."""
        return self.classify(candidate_spans(texts, key)).select(key, "field", "kind", "start", "end")

    def redact(self, logs: DataFrame, message: str = "message", attrs: str = "attrs", names: tuple[str, ...] = ("user", "token")) -> DataFrame:
        """logs with the message and the named attributes redacted; all other columns, rows and attributes as they were.

        An attribute that changes is written back into its JSON object by replacing the value alone.
        """
        from lumenspar.llm.jsontext import replace_string

        def one(m: str | None) -> str | None:
            return m if m is None else self.redact_text(m)

        def all_of(a: str | None) -> str | None:
            for n in names if a else ():
                a = replace_string(a, n, self.redact_text)
            return a

        import pandas as pd

        msg = F.pandas_udf(lambda s: pd.Series([one(x) for x in s], dtype=object), "string")
        att = F.pandas_udf(lambda s: pd.Series([all_of(x) for x in s], dtype=object), "string")
        return logs.withColumns({message: msg(F.col(message)), attrs: att(F.col(attrs))})
