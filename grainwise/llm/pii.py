"""Personal data by weak supervision: three labelers vote on spans, EM weighs them, a span classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import chance, logistic, per_text, ready

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
BASE = KINDS[:4]
# Endings, key prefixes and words that the gazetteer and the context labelers look for.
ENDINGS = frozenset("com org net edu gov mil info io co de fr es it uk eu us ca ch nl se biz name dev app".split())
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-")
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE".split())
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel", "reach"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "master", "amex", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf", "appel", "llam"),
    "secret": ("key", "token", "secret", "password", "passwd", "pwd", "credential"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "konto", "account", "compte", "cuenta", "bank"),
}
CONTEXT = 32
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
# The two separators of a spelled-out address: no text without both has one.
_AT = (" at ", "[at]", "(at)", "[at)", "(at]")
_DOT = (".", " dot ", "[dot]", "(dot)", "[dot)", "(dot]")
# Spans that the method adds: the same data in other spellings, and three further kinds. A match holds one of each group of
# marks, so texts without them are not searched.
_BROAD = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}(?: at | ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}(?:(?: dot | ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63})+"), (_AT, _DOT)),
    ("phone", re.compile(r"(?<![\w+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"), ()),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), (("-",),)),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), ()),
    ("secret", re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)"), (("AKIA", "ASIA"),)),
    ("secret", re.compile(r"(?<!\w)(?:gh[po]_|sk-|xox[bp]-|AIza|glpat-)[0-9A-Za-z_-]{16,}"), (("ghp_", "gho_", "sk-", "xox", "AIza", "glpat-"),)),
    ("secret", re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,4}[=:]\s{0,4}[\"']?(?P<v>[0-9A-Za-z_+/-]{8,})"), (("=", ":"),)),
)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern; around each at sign once, so a long run without a match costs no more."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        floor = at + 1
        if m:
            out.append((begin, m.end()))
            floor = m.end()
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four fixed kinds, in the order of the kinds and of their starts."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Base spans, and broad ones that no span before them touches.

    Matches of one pattern do not overlap, so each is held against the ranges taken before its pattern, by bisection.
    """
    out = base_spans(text)
    for kind, pattern, marks in _BROAD:
        if not marks and kind in ("phone", "iban") and not _DIGIT.search(text):
            continue
        if all(any(m in text for m in group) for group in marks):
            begins, ends = _taken(out)
            for m in pattern.finditer(text):
                a, b = m.span("v") if "v" in pattern.groupindex else m.span()
                at = bisect_right(ends, a)
                if at == len(ends) or begins[at] >= b:
                    out.append((kind, a, b))
    return out


def _taken(found: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the ranges that the spans cover together, in order."""
    begins, ends = [], []
    for a, b in sorted((a, b) for _, a, b in found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, int, int]:
    """Votes of the regex, gazetteer and context labelers: 1 for, -1 against, 0 no opinion."""
    span, digits = text[a:b], sum(c.isdecimal() for c in text[a:b])
    if kind == "email":
        by_regex = 1 if "@" in span else -1 if "." in span else 0
        by_list = 1 if re.split(r"[.\s\[\]()]+", span.rstrip(")] "))[-1].lower() in ENDINGS else 0
    elif kind == "ip":
        parts = [int(p[-4:]) for p in span.split(".")]
        by_regex, by_list = 1 if all(len(p) <= 3 for p in span.split(".")) else -1, 1 if 0 < parts[0] < 224 else -1
    elif kind == "card":
        by_regex, by_list = 1 if digits in (13, 14, 15, 16, 19) else 0, 1 if span[0] in "3456" else -1
    elif kind == "phone":
        by_regex, by_list = 1 if span[0] == "+" or "(" in span else 0, 1 if span[0] == "+" and span[1] != "0" else 0
    elif kind == "secret":
        by_list = 1 if span.startswith(KEY_PREFIXES) else 0
        by_regex = 1 if digits >= 3 and any(map(str.isalpha, span)) else -1
    elif kind == "ssn":
        by_regex, by_list = 1, -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    else:
        plain = span.replace(" ", "")
        by_regex = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
        by_list = 1 if plain[:2] in COUNTRIES else -1
    near = text[max(0, a - CONTEXT): a].lower()
    return by_regex, by_list, 1 if any(c in near for c in CUES[kind]) else 0


def _features(kind: str, seen: tuple[int, int, int], size: int) -> list[float]:
    one_hot = [float(kind == k) for k in KINDS]
    return [*map(float, seen), float(seen[0] * seen[1]), min(size, 64) / 64, *one_hot]


@dataclass(frozen=True)
class Model:
    """prior and reliability (chance of each vote given a true and a false span) by kind, and the span classifier."""
    beta: tuple[float, ...]
    priors: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[str, int], dict[int, tuple[float, float]]] = field(default_factory=dict)

    def chance(self, kind: str, seen: tuple[int, int, int], size: int) -> float:
        return chance(self.beta, *_features(kind, seen, size))


def learn(docs: DataFrame, rounds: int = 30) -> Model:
    """Counts of (kind, votes, size) over the candidates of all documents, then EM and the regression on those counts.

    The counts are bounded: seven kinds, 27 vote patterns and 17 sizes, however many documents there are.
    """
    ready(docs.sparkSession)

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                text = text or ""
                for kind, a, b in candidates(text):
                    seen[(kind, *votes(text, kind, a, b), min(b - a, 64) // 4 * 4)] += 1
        names = ("kind", "v1", "v2", "v3", "size")
        yield pa.RecordBatch.from_pydict({n: [k[i] for k in seen] for i, n in enumerate(names)} | {"n": list(seen.values())},
                                         schema=pa.schema([("kind", pa.string()), *[(n, pa.int64()) for n in (*names[1:], "n")]]))

    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "kind string, v1 bigint, v2 bigint, v3 bigint, size bigint, n bigint")
            .groupBy("kind", "v1", "v2", "v3", "size").agg(F.sum("n").alias("n")).orderBy("kind", "v1", "v2", "v3", "size").collect())
    cells = [(r["kind"], (r["v1"], r["v2"], r["v3"]), r["size"], r["n"]) for r in rows]
    priors, reliability = reliabilities(cells, rounds)
    posterior = np.array([_posterior(priors[k], [reliability[k, j][v[j]] for j in range(3)]) for k, v, _, _ in cells])
    x = np.array([_features(k, v, s) for k, v, s, _ in cells], dtype=float).reshape(-1, 5 + len(KINDS))
    weight = np.array([n for *_, n in cells], dtype=float)
    return Model(tuple(logistic(x, posterior, weight).tolist()), priors, reliability)


def _posterior(prior: float, given: list[tuple[float, float]]) -> float:
    yes, no = prior, 1 - prior
    for t, f in given:
        yes, no = yes * t, no * f
    return yes / (yes + no)


def reliabilities(cells: list[tuple], rounds: int) -> tuple[dict, dict]:
    """EM over vote patterns, by kind; a start that trusts agreement, smoothed so that no vote is certain."""
    priors, chances = {}, {}
    for kind in KINDS:
        mine = [(v, n) for k, v, _, n in cells if k == kind]
        if not mine:
            continue
        belief = np.array([1 / (1 + np.exp(-1.5 * sum(v))) for v, _ in mine])
        n = np.array([c for _, c in mine], dtype=float)
        for _ in range(rounds):
            yes, no = float((belief * n).sum()), float(((1 - belief) * n).sum())
            prior = (yes + 2) / (yes + no + 3)
            table = []
            for j in range(3):
                of = {}
                for value in (-1, 0, 1):
                    here = np.array([v[j] == value for v, _ in mine])
                    # A vote for the span is taken to be likelier on a true one; that fixes which class is which.
                    lean = {-1: (0.5, 2.0), 0: (1.0, 1.0), 1: (2.0, 0.5)}[value]
                    of[value] = ((float((belief * n)[here].sum()) + lean[0]) / (yes + 3.5), (float(((1 - belief) * n)[here].sum()) + lean[1]) / (no + 3.5))
                table.append(of)
            belief = np.array([_posterior(prior, [table[j][v[j]] for j in range(3)]) for v, _ in mine])
        priors[kind] = prior
        for j in range(3):
            chances[kind, j] = table[j]
    return priors, chances


def spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(base spans, all spans with their chance): base ones always stay, others if the classifier says so."""
    base = base_spans(text)
    fixed, out = set(base), []
    for kind, a, b in candidates(text):
        p = model.chance(kind, votes(text, kind, a, b), min(b - a, 64) // 4 * 4)
        if (kind, a, b) in fixed or p >= 0.5:
            out.append((kind, a, b, p))
    return base, sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base (spans of the fixed kinds) and spans (all, with their chance) of every whole text; NULL is empty."""
    span = "array<struct<kind:string,begin:bigint,until:bigint{}>>"
    return per_text(docs, lambda: lambda text: spans(text, model), f"base {span.format('')}, spans {span.format(',chance:double')}")


def redact(text: str, found: list[tuple]) -> str:
    """The text with [KIND] for every span; spans that overlap are replaced together, under the kind of the first."""
    parts, at = [], 0
    for kind, a, b, *_ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])
