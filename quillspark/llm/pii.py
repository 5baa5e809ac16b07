"""Personal data by weak supervision.

Patterns propose spans. Labelers (patterns' own checks, gazetteers, context) vote on each: for, against, or not at all. The votes of the
whole corpus are counted by pattern of votes; expectation-maximisation over these counts estimates how reliable each labeler is and how
likely each pattern is personal data, and a logistic span classifier is trained on that. Spans of the base patterns that pass their
checks always stay; the classifier decides on all other proposals.

The counts have at most a row for each kind and pattern of votes (a few thousand), whatever the corpus's size.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret", "name")
ORDER = {k: i for i, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Proposals beyond the base patterns.
MORE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{2,63}){1,5}"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?|(?<![0-9+.-]))\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{16,200})(?![A-Za-z0-9])"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-zà-ÿ]{1,30}(?: [A-Z][a-zà-ÿ]{1,30})?"),
}
#: What every match of a pattern holds: texts without it are not searched.
NEEDS = {
    "email": ("at)", "at]"), "secret": ("AKIA", "ghp_", "sk-", "sk_"), "name": ("Mr", "Ms", "Dr", "Herr", "Frau", "Mme", "Sr"),
}
DIGIT = re.compile("[0-9]")
#: Gazetteers, as fixed values: words that announce personal data, given names, and top-level domains.
CUES = {
    "email": ("mail", "contact", "write to", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile"),
    "ssn": ("ssn", "social security"),
    "iban": ("iban", "account", "konto", "bank"),
    "secret": ("key", "token", "secret", "password"),
    "name": ("name", "dear", "contact", "signed"),
}
GIVEN = frozenset("james mary john anna maria peter paul laura sofia carlos jean marie pierre hans julia thomas michael sarah david".split())
ENDS = frozenset("com org net edu gov io de fr es uk eu info biz".split())
LABELERS = ("check", "cue", "edges", "line", "gazetteer", "size")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    raw = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, '@' and dotted domain, found from each '@' so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Matches of the base patterns, leftmost and without overlap in a kind, and whether each passes its kind's check."""
    for a, b in emails(text):
        yield "email", a, b, True
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if len(digits) >= 12:
                yield "card", m.start(), m.end(), len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


def votes(text: str, kind: str, a: int, b: int, valid: bool) -> tuple[int, ...]:
    """Each labeler's vote on a proposed span: 1 for, -1 against, 0 none."""
    span, before = text[a:b], text[max(0, a - 30) : a].lower()
    if kind == "iban":
        valid = iban_valid(span)
    elif kind == "ssn":
        valid = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
    edges = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    around = text[max(0, a - 60) : a] + text[b : b + 60]
    crowded = sum(c.isdigit() for c in around) > 0.4 * max(len(around), 1)
    if kind == "email":
        listed = span.rpartition(".")[2].lower() in ENDS
    elif kind == "ip":
        listed = not span.startswith(("0.", "127.", "255."))
    elif kind == "card":
        listed = span[0] in "3456"
    elif kind == "name":
        listed = any(w.lower() in GIVEN for w in span.split())
    else:
        listed = None
    n = len(_digits(span))
    size = {"card": 13 <= n <= 16, "phone": 10 <= n <= 13, "name": len(span) <= 40, "iban": 15 <= len(span.replace(" ", "")) <= 34}.get(kind)
    sign = lambda x: 0 if x is None else 1 if x else -1
    return (sign(valid), int(any(c in before for c in CUES[kind])), sign(edges), -1 if crowded else 0, sign(listed), sign(size))


def proposals(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, tuple[int, ...]]]]:
    """The base spans, and every proposed span that is no base span and meets none, with its votes."""
    found = list(base_matches(text))
    base = [(k, a, b) for k, a, b, ok in found if ok]
    taken = sorted((a, b) for _, a, b in base)
    numbers = DIGIT.search(text)
    likely = [k for k in MORE if (any(x in text for x in NEEDS[k]) if k in NEEDS else numbers)]
    offered = [(kind, m.start(), m.end(), kind != "card" or luhn(_digits(m[0]))) for kind in likely for m in MORE[kind].finditer(text)]
    # a base match that fails its check is proposed, if no part of it is: a phone number and a card number side by side fail as one
    inner = sorted((a, b) for _, a, b, _ in offered)
    for k, a, b, ok in found:
        at = bisect_left(inner, (a, 0))
        if not ok and not any(s < b for s, _ in inner[at : at + 1]):
            offered.append((k, a, b, False))
    out, done, i = [], 0, 0
    for kind, a, b, ok in sorted(offered, key=lambda x: (x[1], -x[2], ORDER[x[0]])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a < done or any(s < b and a < e for s, e in taken[i : i + len(BASE) + 1]):
            continue
        done = b
        out.append((kind, a, b, votes(text, kind, a, b, ok)))
    return base, out


def vote_counts(texts: list[str]) -> Counter:
    counts: Counter = Counter()
    for text in texts:
        base, more = proposals(text)
        counts.update((k, votes(text, k, a, b, True)) for k, a, b in base)
        counts.update((k, v) for k, _, _, v in more)
    return counts


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """By expectation-maximisation, each pattern's probability of being personal data, and by labeler and class the probabilities of its votes -1, 0 and 1.

    Labelers are taken to be independent given the class. It starts from the balance of votes; counts of one keep probabilities off 0 and 1.
    """
    p = 1 / (1 + np.exp(-patterns.sum(axis=1)))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        given = np.stack([[[((patterns[:, j] == v) * weight[c]).sum() + 1 for v in (-1, 0, 1)] for c in (0, 1)] for j in range(patterns.shape[1])])
        given /= given.sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + sum(np.log(given[j][:, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return p, given


def features(kinds: list[str], patterns: np.ndarray) -> np.ndarray:
    own = np.zeros((len(kinds), len(KINDS)))
    own[np.arange(len(kinds)), [ORDER[k] for k in kinds]] = 1
    return np.concatenate([patterns, own, np.ones((len(kinds), 1))], axis=1)


def train(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 100) -> np.ndarray:
    """The span classifier's weights: a logistic regression on votes and kind, fitted to the estimated probabilities of all patterns by their counts."""
    if not counts:
        return np.zeros(len(LABELERS) + len(KINDS) + 1)
    counts = sorted(counts)
    patterns, n = np.array([v for _, v, _ in counts]), np.array([c for *_, c in counts], dtype=float)
    target, _ = reliabilities(patterns, n)
    x = features([k for k, *_ in counts], patterns)
    n = n / n.sum() * min(n.sum(), 1e6)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (target - p)) - w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


def accepts(weights: np.ndarray, kind: str, pattern: tuple[int, ...]) -> bool:
    return float((features([kind], np.array([pattern])) @ weights)[0]) > 0


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


def corpus_counts(docs: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """How often each pattern of votes occurs in all documents, by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total += vote_counts(batch.column(0).to_pylist())
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in keys], "votes": [",".join(map(str, v)) for _, v in keys], "n": pa.array([total[k] for k in keys], pa.int64())})

    counted = docs.select(text_or_empty("text").alias("text")).mapInArrow(run, "kind string, votes string, n long")
    rows = counted.groupBy("kind", "votes").sum("n").collect()  # at most kinds times 3 ** labelers rows
    return [(k, tuple(map(int, v.split(","))), n) for k, v, n in rows]


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Offsets are code points, ends exclusive. A null text counts as empty: no spans, the digest of nothing. Repeated rows and null doc_ids
    each give a row; other columns are dropped; an empty table gives no row. There is no shuffle but that of the vote counts. Without
    weights the classifier is trained on docs.
    """
    w = train(corpus_counts(docs)) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, bool] = {}

        def good(kind: str, pattern: tuple[int, ...]) -> bool:
            if (kind, pattern) not in known:
                known[kind, pattern] = accepts(w, kind, pattern)
            return known[kind, pattern]

        for batch in batches:
            base, every = [], []
            for text in batch.column("text").to_pylist():
                own, more = proposals(text)
                base.append(own)
                every.append([*own, *((k, a, b) for k, a, b, v in more if good(k, v))])
            n = {f"n_{k}": pa.array([sum(x[0] == k for x in own) for own in base], pa.int64()) for k in BASE}
            digest = pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **n, "base_sha256": digest, "spans": pa.array([joined(s) for s in every], pa.string())})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
