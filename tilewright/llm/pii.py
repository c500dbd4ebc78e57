"""Personal data by weak supervision.

Base spans (e-mail, IP, card, phone) come from fixed patterns and always stay.
Wider candidates (secrets such as tokens and passwords, local phone numbers,
spelled-out e-mail addresses, other long numbers, names) are judged: labelers of
three sorts (regex, gazetteer, context) each vote personal, not personal, or
nothing; for each kind, expectation maximisation over the counts of vote patterns
of all spans estimates how reliable each labeler is, and a probability for each
pattern; a logistic classifier over features of the span and its surroundings,
which don't hold the votes, is trained on these probabilities and alone decides.

The counts of patterns that reach the driver are at most ``len(KINDS) * 2 *
3**LABELERS``, whatever the corpus; the classifier is fitted to ``TRAIN_SPANS``
spans of each kind at most, a documented bound, and then judges every span.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import saved

KINDS = ("email", "ip", "card", "phone", "name", "secret")
#: Spans of each kind to fit the classifier to at most, and columns of its features.
TRAIN_SPANS, COLUMNS = 1500, 1024
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"([0-9](?<![0-9].)[0-9]*+)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# each begins with a plain set of characters, which is found fast; what must stand before is looked at then
_LOCAL_PHONE = re.compile(r"[0-9](?<![0-9].)(?:[0-9]{2,3}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}|[0-9]{2}-[0-9]{4})(?![\w-]|\.[0-9])")
_AT, _AFTER_AT = re.compile(r"[\[(]at[\])]"), re.compile(r" ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]++(?!\w)")
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Señora", "Sr", "Sra")
_TITLED = re.compile(r"\b(?:" + "|".join(_TITLES) + r")\b\.? ([A-ZÀ-Þ][\w'-]*+(?: [A-ZÀ-Þ][\w'-]*+)?)")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]*+={0,2}(?![\w@])")
_TOKEN_END = re.compile(r"[A-Za-z0-9+/_-]++")
_TOKEN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "api key", "apikey", "access_key", "access-key", "access key")
_ASSIGNED = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{6,}+)")
_PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+(?:-----END [A-Z ]*PRIVATE KEY-----)?")
_DIGIT = re.compile("[0-9]")

# fixed values: gazetteers
TOP_DOMAINS = frozenset("com org net edu gov info io eu de fr es uk it nl ch at be pt us ca au".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35", "36", "38")
GIVEN_NAMES = tuple("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Hans Peter Klaus Ursula Monika Petra Sabine Andreas Stefan Pierre Michel Jean Marie Nathalie Isabelle Juan Carlos Maria Carmen Luis Pablo Lucia Ana Jose".split())
_TWO_NAMES = re.compile("(" + "|".join(GIVEN_NAMES) + r") [A-ZÀ-Þ][\w'-]*+")
#: what announces each kind, in the order of KINDS
NEAR_WORDS = [re.compile(rf"(?i)\b(?:{w})\b") for w in ("e-?mail|mail|contact|kontakt|contacto|write to", "ip|address|adresse|host|server|client", "card|karte|carte|tarjeta|visa|credit", "phone|tel|téléphone|telefon|teléfono|call|mobile|fax", "name|nom|nombre|signed|author|regards", "token|secret|password|passwd|pwd|key|bearer|credentials?|authorization")]
FAR_WORDS = re.compile(r"(?i)\b(?:version|v|isbn|issn|doi|sum|total|price|chapter|section|page|hash|sha|sha1|sha256|md5|checksum|digest|commit|revision|order|invoice|figure|table|license|uuid)\b")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "AIza", "eyJ", "-----BEGIN")
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; per kind leftmost, without overlap."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-6:]) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m:
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out)


def _long_tokens(text: str) -> Iterator[tuple[int, int, int]]:
    """Runs of 16 letters, digits, +, /, _ and - at least, of letters and digits both, by their digits."""
    at = _DIGIT.search(text)
    last = 0
    while at:
        start = at.start()
        while start > last and text[start - 1] in _TOKEN_CHARACTERS:
            start -= 1
        m = _TOKEN.match(text, at.start())
        if m and m.end() - start >= 16 and (not start or text[start - 1] not in ".@=") and any(c.isalpha() for c in text[start : m.end()]):
            yield start, 5, m.end()
        last = m.end() if m else _TOKEN_END.match(text, at.start()).end()
        at = _DIGIT.search(text, last)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Wider candidates, (start, kind, end)."""
    out, last = list(_long_tokens(text)), 0
    for m in _LOCAL_PHONE.finditer(text):
        start = m.start() - (text[m.start() - 1 : m.start()] == "(")
        before = text[start - 1 : start] if start else ""
        if not (before.isalnum() or before in "_+(.-" and before):
            out.append((start, 3, m.end()))
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= sum(c.isdigit() for c in m[0]) <= 19]
    for m in _AT.finditer(text):
        stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = stop
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        after = _AFTER_AT.match(text, m.end()) if start < stop else None
        if after:
            out.append((start, 0, after.end()))
            last = after.end()
    if any(t in text for t in _TITLES):
        out += [(m.start(1), 4, m.end(1)) for m in _TITLED.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in _TWO_NAMES.finditer(text) if not text[m.start() - 1 : m.start()].isalnum() or not m.start()]
    low = text.lower()
    low = low if len(low) == len(text) else text  # where lower case is longer, the words are looked for as they stand
    for word in _SECRET_WORDS:
        at = low.find(word)
        while at >= 0:
            m = _ASSIGNED.match(text, at + len(word))
            if m:
                out.append((m.start(1), 5, m.end(1)))
            at = low.find(word, at + len(word))
    if "PRIVATE KEY" in text:
        out += [(m.start(), 5, m.end()) for m in _PRIVATE_KEY.finditer(text)]
    return out


def _entropy(span: str) -> float:
    """Bits a character, of the span's first 256."""
    n = np.unique(np.frombuffer(span[:256].encode("utf-32-le"), np.uint32), return_counts=True)[1]
    return float(-(n / n.sum() * np.log2(n / n.sum())).sum())


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing.

    0 regex: a strict form of the kind. 1 gazetteer: top domains, calling codes,
    card issuers, given names, prefixes of keys. 2 regex: stands alone, not inside
    a longer token. 3 context: a word that announces the kind. 4 context: one that
    announces other numbers. 5 statistic: check digit, number of digits, entropy."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == 0:
        strict = 1 if re.fullmatch(r"[\w.%+-]++(?:@| ?[\[(]at[\])] ?).+", span) else 0
        top = re.split(r"[.\])]", span)[-1].strip().lower()
        known, sum_ok = (1, 1) if top in TOP_DOMAINS else (-1, 0)
    elif kind == 1:
        parts = span.split(".")
        strict = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        known, sum_ok = (-1 if parts[0] in ("0", "255") else 0), 0
    elif kind == 2:
        right = luhn(digits)
        strict = 1 if 13 <= len(digits) <= 19 and right else -1
        known, sum_ok = (1 if digits.startswith(ISSUERS) else -1), (1 if right else -1)
    elif kind == 3:
        strict = 1 if span[0] == "+" or re.fullmatch(r"\([0-9]{3,4}\) [0-9]{3,4}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}", span) else -1
        known, sum_ok = (1 if span[0] == "+" and digits.startswith(CALLING_CODES) else 0), (1 if len(digits) >= 9 else -1)
    elif kind == 4:
        strict = 1 if " " in span else 0
        known, sum_ok = (1 if span.split(" ")[0] in GIVEN_NAMES else -1), 0
        if text[max(0, start - 6) : start].rstrip(". ").endswith(_TITLES):
            sum_ok = 1
    else:
        strict = 1 if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9+/_-]{32,}={0,2}", span) else 0
        known = 1 if span.startswith(KEY_PREFIXES) else 0
        bits = _entropy(span)
        sum_ok = 1 if bits >= 3.2 else -1 if bits < 2.5 else 0
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    alone = -1 if before.isalnum() or after.isalnum() or before in "#/\\_&?" and before else 1
    near = text[max(0, start - 40) : start]
    return strict, known, alone, 1 if NEAR_WORDS[kind].search(near) else 0, -1 if FAR_WORDS.search(near) else 0, sum_ok


def _class(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c.isspace() else c


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """Columns of the classifier that are on for a span: its length, characters and
    shape, and what stands around it."""
    span = text[start:end]
    head = span[:64]
    n = len(head)
    runs = re.sub(r"(.)\1+", r"\1", "".join(map(_class, head)))
    word = re.findall(r"\w+", text[max(0, start - 24) : start].lower())[-1:]
    said = (
        f"len{min(len(span), 64) // 4}", f"digits{4 * sum(c.isdigit() for c in head) // n}", f"upper{4 * sum(c.isupper() for c in head) // n}",
        f"entropy{int(2 * _entropy(span))}", f"shape{runs[:12]}", f"before{_class(text[start - 1 : start] if start else '')}{_class(text[start - 2 : start - 1] if start > 1 else '')}",
        f"after{_class(text[end : end + 1])}", f"word{word}", f"first{head[0] if head[0].isdigit() else _class(head[0])}",
        f"check{luhn(''.join(c for c in head if '0' <= c <= '9'))}", "",
    )
    return [zlib.crc32(f"{kind}:{x}".encode()) % COLUMNS for x in said]


def scan(text: str) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """All spans and candidates of a text: (start, kind, end, base, votes, features)."""
    base = base_spans(text)
    taken = set(base)
    ends = [0]  # ends[k]: how far the first k base spans reach
    for span in base:
        ends.append(max(ends[-1], span[2]))
    kept, last = [], -1
    for c in sorted(candidates(text), key=lambda c: (c[0], -c[2], c[1])):  # those clear of base spans; the leftmost and longest where candidates overlap
        before = bisect.bisect_left(base, (c[2],))
        if c[0] >= last and ends[before] <= c[0]:
            kept.append(c)
            last = c[2]
    out = []
    for s, k, e in [*base, *kept]:
        out.append((s, k, e, (s, k, e) in taken, ",".join(map(str, votes(text, s, k, e))), features(text, s, k, e)))
    return sorted(out)


def fit_labelers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Expectation maximisation with two classes and labelers that err
    independently; returns the probability of ``personal`` for each row of votes."""
    seen = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # row, labeler, vote
    p = 1 / (1 + np.exp(-patterns.sum(axis=1) * 1.5))  # majority vote to begin with
    for _ in range(rounds):
        w = np.stack([(1 - p) * counts, p * counts], axis=1)  # row, class
        prior = (w.sum(axis=0) + 1) / (w.sum() + 2)
        says = np.einsum("rc,rlv->clv", w, seen) + 1.0
        # labelers are taken to be better than chance: +1 is never likelier for the wrong class
        says /= says.sum(axis=2, keepdims=True)
        swap = says[0, :, 2] > says[1, :, 2]
        mean = says.mean(axis=0)
        says[:, swap] = mean[swap]
        like = np.log(prior)[None] + np.einsum("rlv,clv->rc", seen, np.log(says))
        like -= like.max(axis=1, keepdims=True)
        e = np.exp(like)
        p = e[:, 1] / e.sum(axis=1)
    return p


def fit_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method, with a ridge."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    n = counts / counts.sum() * min(counts.sum(), 1e4)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (q - target)) + w
        h = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Classifier:
    """Weights by column, the bias last."""

    weights: tuple[float, ...]
    least: float = 0.5

    def takes(self, columns: list[int]) -> bool:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[-1] + sum(self.weights[c] for c in columns))))) >= self.least


def pattern_probabilities(counts: dict[tuple[int, str], int]) -> dict[tuple[int, str], float]:
    """The probability of ``personal`` for each (kind, votes), by expectation maximisation within each kind."""
    out = {}
    for kind in range(len(KINDS)):
        mine = sorted(v for k, v in counts if k == kind)
        if mine:
            p = fit_labelers(np.array([[int(x) for x in v.split(",")] for v in mine]), np.array([counts[kind, v] for v in mine], float))
            out |= {(kind, v): float(q) for v, q in zip(mine, p, strict=True)}
    return out


def fit_spans(spans: list[tuple[list[int], float]]) -> Classifier:
    """The classifier for (columns, probability) of spans."""
    weights = np.zeros(COLUMNS + 1)
    if spans:
        kinds = sorted(Counter((tuple(columns), p) for columns, p in spans).items())  # equal spans are one row
        used = sorted({c for (columns, _), _ in kinds for c in columns})
        place = {c: k for k, c in enumerate(used)}
        x = np.zeros((len(kinds), len(used)))
        for row, ((columns, _), _) in enumerate(kinds):
            x[row, [place[c] for c in columns]] = 1
        w = fit_classifier(x, np.array([p for (_, p), _ in kinds]), np.array([n for _, n in kinds], float))
        weights[used], weights[-1] = w[:-1], w[-1]
    return Classifier(tuple(weights.tolist()))


_FOUND = "array<struct<start:bigint,kind_no:int,end:bigint,base:boolean,votes:string,features:array<int>>>"


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): every base span and candidate of each whole text."""
    names = ("start", "kind_no", "end", "base", "votes", "features")
    kind = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32())), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in scan(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, found {_FOUND}")


def train(found: DataFrame) -> Classifier:
    """Counts the vote patterns of all spans, then fits the classifier to a bounded sample of each kind."""
    spans = saved(found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*"), "pii-spans")
    counts = {(r["kind_no"], r["votes"]): r["count"] for r in spans.groupBy("kind_no", "votes").count().collect()}
    p = pattern_probabilities(counts)
    order = Window.partitionBy("kind_no").orderBy(F.xxhash64("doc_id", "start", "end"), "doc_id", "start", "end")  # the limit is applied before rows are shuffled
    sample = spans.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRAIN_SPANS).select("kind_no", "votes", "features").collect()
    return fit_spans([(r["features"], p[r["kind_no"], r["votes"]]) for r in sample])


def _equals(value: int) -> Callable[[Column], Column]:
    return lambda x: x == value


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data per document.

    Null and empty texts, and texts without any, have counts 0 and empty
    strings; repeated rows give repeated results; an empty table gives no rows;
    further columns are not read.  ``n_added`` counts the spans beside base ones."""
    found = saved(find_candidates(docs), "pii-found")
    model = train(found)
    weights = F.array(*map(F.lit, model.weights[:-1]))
    logit = math.log(model.least / (1 - model.least))
    base = F.filter("found", lambda s: s["base"])
    kept = F.filter("found", lambda s: s["base"] | (F.aggregate(s["features"], F.lit(model.weights[-1]), lambda a, c: a + F.element_at(weights, c + 1)) >= logit))
    kinds = F.transform(base, lambda s: s["kind_no"])
    n = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    added = (F.size(kept) - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(kept).alias("spans"), added)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, all other
    columns as they are.  Overlapping spans are masked as one, by the first's kind.

    Null texts stay null and empty ones empty; repeated rows are masked alike; an
    empty table stays empty; columns may have any names."""
    model = train(find_candidates(docs))

    @F.pandas_udf("string")
    def mask(texts):
        def one(text):
            if text is None:
                return None
            out, last = [], 0
            for start, kind, end, base, _, columns in scan(text):
                if not base and not model.takes(columns):
                    continue
                if start >= last:
                    out += [text[last:start], f"[{KINDS[kind].upper()}]"]
                last = max(last, end)
            return text if not out else "".join([*out, text[last:]])

        return texts.map(one)

    return docs.withColumn("text", mask("text"))


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()
