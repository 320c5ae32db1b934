"""Personal data: labelers vote on candidate spans, EM estimates their reliabilities, a span classifier decides.

Candidates are the matches of fixed patterns and of looser ones (obfuscated addresses, phone-like digits without a plus,
secrets after a key word, long hex strings). Three labelers vote 1, 0 or abstain on each: *pattern* (does the strict form
with its checks hold), *gazetteer* (lists of endings, special address blocks, first digits, token prefixes and
placeholders) and *context* (cue words before the span). Votes are counted over all documents by (kind, votes, shape), a
table whose size the pattern bounds; expectation-maximisation on those counts gives each labeler's reliability and the
posterior of each cell, on which a logistic classifier over span features is trained. Training and use see the same
candidates. Spans that it accepts are added; the matches of the fixed patterns always stay.

Defined results: null texts count as empty and have no spans; texts are searched whole, in time that grows with their
length; repeated rows get equal results; spans are code points, end exclusive; of two added spans that overlap the
earlier, then the longer one stays, and none overlaps a fixed match; an empty table gives an empty result, and a model
trained on one adds no span. Columns named like a new one (found; n_email to n_added) are replaced, others pass through
under any name.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches, with_columns_from_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP_TAIL = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
LOOSE = {
    "email": re.compile(r"(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)+"),
    "phone": re.compile(r"(?:\([0-9]{2,4}\) ?|(?<![0-9.+(])[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,4}(?![0-9])"),
    "secret": re.compile(r"(?<![0-9A-Za-z])[A-Fa-f0-9]{24,}(?![0-9A-Za-z])|(?<![A-Za-z])(?:[Pp]assword|[Tt]oken|[Ss]ecret|[Aa]pi_?[Kk]ey)s?[\"']? ?[:=] ?[\"']?([^\s\"',;]{6,})"),
}
#: Cue words by kind, and the gazetteer: known endings, special-use address blocks (no person's), first
#: digits of cards, prefixes of issued tokens, lengths of hexadecimal keys, and words that stand where a secret would.
CUES = {
    "email": frozenset(("mail", "email", "contact", "write", "address")),
    "ip": frozenset(("ip", "host", "server", "address", "from")),
    "card": frozenset(("card", "visa", "credit", "payment", "number")),
    "phone": frozenset(("phone", "telephone", "call", "tel", "mobile", "fax")),
    "secret": frozenset(("token", "password", "secret", "key", "api")),
}
ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"))
NO_HOST = ("0.", "127.", "255.", *(f"{n}." for n in range(224, 256)))
CARD_FIRST = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
TOKEN_FIRST = ("sk-", "sk_", "pk_", "ghp_", "gho_", "glpat-", "AKIA", "AIza", "xox", "eyJ")
KEY_LENGTHS = frozenset((32, 40, 64, 128))
PLACEHOLDERS = frozenset(("password", "changeme", "example", "secret", "required", "optional", "default", "undefined", "string", "xxxxxx", "xxxxxxxx"))
LABELERS = ("pattern", "gazetteer", "context")


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in back[1::2])) % 10 == 0


def small(part: str) -> bool:
    return len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255


DIGITS = frozenset("0123456789")


def before(text: str, end: int, least: int, letters: frozenset) -> int:
    """Where the run of ``letters`` that ends at ``end`` begins, not below ``least``."""
    while end > least and text[end - 1] in letters:
        end -= 1
    return end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed matches as (start, end, kind), by start, then kind in the listed order."""
    out, last = [], 0
    if "@" in text:
        for m in AT.finditer(text):
            i = before(text, m.start(), last, LOCAL)
            if i < m.start():
                out.append((i, last := m.end(), "email"))
    at, last = 0, 0
    while m := IP_TAIL.search(text, at):
        i = before(text, m.start(), last, DIGITS)
        if i == m.start():
            at = i + 1
            continue
        at = last = m.end()
        if all(map(small, text[i:last].split("."))):
            out.append((i, last, "ip"))
    for m in CARD.finditer(text):
        if 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, bool]]:
    """Matches of the looser patterns that overlap none of ``base`` (by start): start, end, kind, whether the strict form
    holds; by start, longer ones first."""
    out = []
    if "(at)" in text or "[at]" in text:
        last = 0
        for m in LOOSE["email"].finditer(text):
            end = m.start() - (m.start() > last and text[m.start() - 1] == " ")
            if (i := before(text, end, last, LOCAL)) < end:
                out.append((i, last := m.end(), "email", False))
    out += [(*m.span(), "phone", False) for m in LOOSE["phone"].finditer(text)]
    out += [(*(m.span(1) if m[1] else m.span()), "secret", bool(m[1])) for m in LOOSE["secret"].finditer(text)]
    out.sort(key=lambda x: (x[0], -x[1]))
    free, i, reach = [], 0, 0
    for c in out:
        while i < len(base) and base[i][0] < c[1]:
            reach = max(reach, base[i][1])
            i += 1
        # Fixed matches that begin before this one's end: none may end beyond its start.
        if reach <= c[0]:
            free.append(c)
    return free


WORD = re.compile(r"[a-z]+")


def cued(text: str, s: int, kind: str) -> bool:
    """Whether a cue word of the kind, or its plural, stands whole in the 40 characters before s."""
    lo = max(0, s - 40)
    while 0 < lo < s and text[lo].isalpha() and text[lo - 1].isalpha():
        lo += 1
    cues = CUES[kind]
    return any(w in cues or w[-1] == "s" and w[:-1] in cues for w in WORD.findall(text[lo:s].lower()))


def votes(text: str, s: int, e: int, kind: str, strict: bool) -> tuple[int, int, int, int]:
    """Votes of the three labelers (1, 0, or -1: abstains) and the span's shape: length class by digits and letters."""
    span = text[s:e]
    letters, digits = bool(re.search("[A-Za-z]", span)), bool(re.search("[0-9]", span))
    if kind == "email":
        gaz = int(span.rpartition(".")[2].lower() in ENDINGS)
    elif kind == "card":
        gaz = int(span.startswith(CARD_FIRST))
    elif kind == "ip":
        gaz = int(not span.startswith(NO_HOST))
    elif kind == "phone":
        gaz = 1 if span[0] == "+" and span[1] != "0" else -1
    else:
        gaz = 0 if span.lower() in PLACEHOLDERS or not digits else 1 if span.startswith(TOKEN_FIRST) or len(span) in KEY_LENGTHS or letters else -1
    return int(strict), gaz, 1 if cued(text, s, kind) else -1, min(3, (e - s) // 10) * 4 + 2 * letters + digits


@dataclass
class SpanModel:
    """For each labeler the chance of its vote 1 in true and in false spans, and the span classifier's weights."""

    reliability: dict[str, tuple[float, float]]
    prior: float
    weights: np.ndarray


def row_of(kind: str, v: tuple[int, int, int], shape: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + 5)
    x[0] = 1
    x[1 + KINDS.index(kind)] = 1
    for i, vote in enumerate(v):
        if vote >= 0:
            x[1 + len(KINDS) + 2 * i + vote] = 1
    x[-5 + shape // 4] = 1
    x[-1] = shape & 1
    return x


def estimate(cells: dict[tuple[str, int, int, int, int], int], rounds: int = 50) -> SpanModel:
    """EM over counted votes (abstentions of labelers that also vote 0 say nothing), then a logistic classifier trained on the posteriors."""
    keys = sorted(cells)
    n = np.array([cells[k] for k in keys], float)
    v = np.array([k[1:4] for k in keys]).reshape(-1, 3)
    # The silence of a labeler that never votes 0 is its other answer.
    v = np.where((v == -1) & ~(v == 0).any(0), 0, v)
    theta, prior = np.tile([[0.8, 0.3]], (3, 1)), 0.7
    post = np.zeros(len(keys))
    for _ in range(rounds if len(keys) else 0):
        log = np.tile(np.log([prior, 1 - prior]), (len(keys), 1))
        for i in range(3):
            for c in range(2):
                log[:, c] += np.where(v[:, i] == 1, np.log(theta[i, c]), np.where(v[:, i] == 0, np.log(1 - theta[i, c]), 0))
        post = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
        prior = float(np.clip((n @ post + 7) / (n.sum() + 10), 0.05, 0.95))
        for i in range(3):
            for c, w in ((0, n * post), (1, n * (1 - post))):
                said = v[:, i] >= 0
                theta[i, c] = np.clip((w[v[:, i] == 1].sum() + 8 - 5 * c) / (w[said].sum() + 10), 0.02, 0.98)
    x = np.array([row_of(k[0], k[1:4], k[4]) for k in keys]).reshape(len(keys), -1) if keys else np.zeros((0, 1 + len(KINDS) + 2 * len(LABELERS) + 5))
    w = np.zeros(x.shape[1])
    weight = np.sqrt(n)
    for _ in range(30 if len(keys) else 0):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - post)) + 0.1 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return SpanModel({name: (float(theta[i, 0]), float(theta[i, 1])) for i, name in enumerate(LABELERS)}, prior, w)


def train(df: DataFrame, text_col: str = "text") -> SpanModel:
    """Counts the votes over all rows; the driver gets at most one row for each (kind, votes, shape)."""

    small_batches(df.sparkSession)

    def count(batches):
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            seen: Counter = Counter()
            for t in texts:
                base = base_spans(t)
                for s, e, k, strict in (*((*x, True) for x in base), *candidates(t, base)):
                    seen[k, *votes(t, s, e, k, strict)] += 1
            yield pa.RecordBatch.from_pylist([dict(zip(("kind", "a", "b", "c", "shape", "n"), (*key, n), strict=True)) for key, n in seen.items()], schema=schema)

    schema = pa.schema([("kind", pa.string()), *((x, pa.int32()) for x in ("a", "b", "c", "shape")), ("n", pa.int64())])
    cells = df.select(text_col).mapInArrow(count, "kind string, a int, b int, c int, shape int, n long").groupBy("kind", "a", "b", "c", "shape").agg(F.sum("n").alias("n"))
    return estimate({(r.kind, r.a, r.b, r.c, r["shape"]): r.n for r in cells.collect()})


class Finder:
    def __init__(self, model: SpanModel):
        self.w, self.seen = model.weights, {}

    def __call__(self, text: str) -> tuple[list, list]:
        """Fixed spans, and all spans, each as (start, end, kind)."""
        base = base_spans(text)
        added, end = [], 0
        for s, e, k, strict in candidates(text, base):
            if s < end:
                continue
            cell = (k, *votes(text, s, e, k, strict))
            if cell not in self.seen:
                self.seen[cell] = float(row_of(k, cell[1:4], cell[4]) @ self.w) >= 0
            if self.seen[cell]:
                added.append((s, e, k))
                end = e
        return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("fixed", T.BooleanType())]))


def find(df: DataFrame, model: SpanModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds found: an array of spans (start, end, kind, fixed) by start, then kind."""

    def maker():
        finder = Finder(model)

        def make(texts):
            rows = []
            for t in texts:
                base, spans = finder(t)
                fixed = set(base)
                rows.append([{"start": s, "end": e, "kind": k, "fixed": (s, e, k) in fixed} for s, e, k in spans])
            return [rows]

        return make

    return with_columns_from_text(df, text_col, [T.StructField("found", SPANS)], maker, keep)


def digests(df: DataFrame, model: SpanModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]

    def maker():
        finder = Finder(model)

        def make(texts):
            cols = [[] for _ in fields]
            for t in texts:
                base, spans = finder(t)
                n = Counter(k for _, _, k in base)
                for col, x in zip(cols, (*(n[k] for k in BASE_KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)), strict=True):
                    col.append(x)
            return cols

        return make

    return with_columns_from_text(df, text_col, fields, maker, keep)


def masked(df: DataFrame, model: SpanModel, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with each span of each text replaced by [KIND]; overlapping spans become one, named by the first. Null
    texts stay null. ``length_col`` is set to the new length."""

    def maker():
        finder = Finder(model)

        def make(texts):
            out = []
            for t in texts:
                parts, at = [], 0
                for s, e, k in finder(t)[1]:
                    if s >= at:
                        parts += [t[at:s], f"[{k.upper()}]"]
                    at = max(at, e)
                out.append("".join(parts) + t[at:])
            return [out]

        return make

    had, new = df.columns, fresh(df.columns, "masked")
    out = with_columns_from_text(df, text_col, [T.StructField(new, T.StringType())], maker)
    out = out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(new)))
    if length_col and length_col in had:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(length_col)).cast(df.schema[length_col].dataType))
    return out.select(*had)
