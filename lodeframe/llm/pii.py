"""Personal data by weak supervision (operator 6).

Fixed patterns give the base spans, which always stay. Looser patterns propose further spans. Labelers (formats, word
lists, the words around, how random the value looks, how many alike the text holds) vote on every proposal;
expectation-maximisation over the counted vote patterns of the whole corpus estimates how far each labeler can be trusted,
and a logistic span classifier over votes, kind and length is fitted to its posteriors. It scores every proposal, of votes
that were seen when learning or not, and those that it accepts are added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.base import serve, small_batches, table, texts_of

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = KINDS[:4]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: The same matches as a digit followed by digits with at most one space or hyphen before each.
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth")
KEYED = re.compile(r"(?i)(?<![A-Za-z])(?:" + "|".join(SECRET_WORDS) + r")[\w-]{0,16}[\x20\t]?[=:][\x20\t]?[\"']?([^\s\"'&,;<>]{6,}+)")
CLOUD_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![\w+().-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
NATIONAL_ID = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
SPELT_EMAIL = re.compile(r"(?i)(?<![\w.+-])[a-z0-9][\w.+-]{0,63}[\x20]?[\[(][\x20]?at[\x20]?[\])][\x20]?[a-z0-9-]{1,63}(?:[\x20]?(?:\.|[\[(][\x20]?dot[\x20]?[\])])[\x20]?[a-z0-9-]{2,63}){1,4}")

#: Words before a span that speak for each kind, and words that speak against any.
CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "credit", "payment", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "dial"),
    "secret": SECRET_WORDS,
    "id": ("ssn", "social", "tax", "passport", "identity", "id"),
}
AGAINST = ("version", "isbn", "issn", "page", "figure", "table", "order", "invoice", "example", "section", "rfc", "doi")
#: Gazetteers. Values and names that only stand in for real ones:
STAND_INS = frozenset(
    """password passwd secret token changeme change_me example test testing none null nil true false undefined unknown default placeholder dummy sample
    your_password yourpassword your_token your_api_key your-api-key my_password mypassword my_secret mysecret secret_key secretkey api_key apikey access_token
    user_password db_password root admin administrator guest public private redacted removed hidden masked xxxxxx xxxxxxxx ******** 12345678 123456 qwerty letmein
    foobar foobarbaz todo fixme string value required optional""".split()
)
RESERVED_DOMAINS = ("example.com", "example.org", "example.net", "localhost", ".test", ".invalid", ".example")
PUBLISHED_IDS = frozenset("078-05-1120 219-09-9999 457-55-5462 123-45-6789 987-65-4321 111-11-1111 333-33-3333 555-55-5555 000-00-0000".split())
TEST_CARDS = frozenset("4111111111111111 4012888888881881 4242424242424242 5555555555554444 5105105105105100 378282246310005 371449635398431 6011111111111117 6011000990139424 30569309025904 38520000023237 3530111333300000 3566002020360505".split())
#: Mail providers, top-level domains and given names that speak for an address:
MAIL_HOSTS = frozenset("gmail googlemail yahoo ymail hotmail outlook live msn icloud me mac aol proton protonmail zoho gmx web mail email fastmail yandex qq 163 126 naver orange wanadoo free laposte libero t-online freenet comcast verizon att btinternet sky".split())
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co me us uk de fr es it nl be ch at se no dk fi pl pt gr ie cz hu ro ru ua tr il in cn jp kr au nz br mx ar cl za ng eg sa ae eu dev app".split())
GIVEN_NAMES = frozenset(
    """james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna maria peter paul
    mark daniel andrew alex sam chris kevin brian laura emma julia sofia lucas leon max felix jonas marie pierre jean louis claire camille hans klaus petra carlos jose juan luis pablo carmen ana""".split()
)
#: Area codes of no place (toll-free, premium) and the number range kept for fiction:
FREE_CODES = frozenset("800 833 844 855 866 877 888 900".split())
FICTION = re.compile(r"555[\x20.-]01[0-9]{2}")
AROUND, MANY = 32, 40
#: Characters from which on a secret may hold base spans (a signed token with an address in it).
LONG = 257
LABELERS = 6
#: Length classes of a span.
LENGTHS = 4
ROUNDS, STEPS = 60, 400


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost matches per kind that pass their checks; a match that fails is dropped, not retried."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def luhn(digits: str) -> bool:
    odd = [int(d) for d in reversed(digits)]
    return (sum(odd[::2]) + sum(d * 2 - 9 * (d > 4) for d in odd[1::2])) % 10 == 0


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Further spans that could be personal data."""
    found, low = [], text.lower()
    if any(w in low for w in SECRET_WORDS):
        found += [(*m.span(1), "secret") for m in KEYED.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [(*m.span(), "secret") for m in CLOUD_KEY.finditer(text)]
    if "(at)" in low or "[at]" in low or "( at )" in low or "[ at ]" in low:
        found += [(*m.span(), "email") for m in SPELT_EMAIL.finditer(text)]
    if DIGIT.search(text):
        found += [(*m.span(), "phone") for m in LOCAL_PHONE.finditer(text)]
        found += [(*m.span(), "id") for m in NATIONAL_ID.finditer(text)]
    return found


def entropy(value: str) -> float:
    counts = np.array(list(Counter(value).values()), float)
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def gazetteer(low: str, kind: str) -> int:
    """The word lists' vote on a value in lower case."""
    if kind == "email":
        parts = re.findall(r"[a-z0-9-]+", low.replace("(at)", "@").replace("[at]", "@").replace("(dot)", ".").replace("[dot]", "."))
        if any(d in low for d in RESERVED_DOMAINS):
            return -1
        return 1 if MAIL_HOSTS & set(parts[1:]) or (parts and parts[0] in GIVEN_NAMES) or (parts and parts[-1] in TOP_DOMAINS) else 0
    if kind == "ip":
        return -1 if low.startswith(("0.", "127.", "255.", "192.0.2.", "198.51.100.", "203.0.113.")) else 0
    if kind == "card":
        return -1 if re.sub("[^0-9]", "", low) in TEST_CARDS else 0
    if kind == "phone":
        return -1 if FICTION.search(low) or re.sub("[^0-9]", "", low)[:3] in FREE_CODES else 0
    if kind == "id":
        return -1 if low in PUBLISHED_IDS else 0
    return -1 if low.strip("\"'") in STAND_INS else 0


def votes(text: str, span: tuple[int, int, str], alike: int, base: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal data, -1 not, 0 no opinion."""
    start, end, kind = span
    value = text[start:end]
    low = value.lower()
    near = text[max(0, start - AROUND) : start].lower()
    both = near + " " + text[end : end + AROUND].lower()
    if base:
        strict = 1
    elif kind == "secret":
        strict = 1 if CLOUD_KEY.fullmatch(value) or re.fullmatch(r"[0-9a-fA-F]{16,}|(?=.*[0-9])(?=.*[A-Za-z])[\w+/=.-]{16,}", value) else 0
    elif kind == "id":
        strict = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1
    elif kind == "phone":
        strict = 1 if re.sub(r"\D", "", value)[0] in "23456789" else -1
    else:
        strict = 0
    listed = gazetteer(low, kind)
    cue = 1 if any(w in near for w in CUES[kind]) else 0
    against = -1 if any(w in both for w in AGAINST) else 0
    random = 0
    if kind == "secret":
        random = 1 if entropy(value) >= 3 and DIGIT.search(value) else -1
    elif kind in ("card", "phone", "id"):
        random = -1 if len(set(value) - set(" -().+")) <= 2 else 1
    crowd = -1 if alike > MANY else 0
    return strict, listed, cue, against, random, crowd


def pattern(text: str, span: tuple[int, int, str], alike: int, base: bool) -> str:
    """What the classifier sees of a span: kind, votes and length class. There are few different ones."""
    return "|".join([span[2], ",".join(map(str, votes(text, span, alike, base))), str(min(LENGTHS - 1, (span[1] - span[0]) // 12)), str(int(base))])


def judged(text: str) -> tuple[list, list, list[str]]:
    """Base spans, proposals that lie apart from them and from each other, and their patterns (base first)."""
    base = base_spans(text)
    starts, ends = [], []  # base spans, with those that overlap joined
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    more, done = [], 0
    for s in sorted(proposals(text), key=lambda s: (s[0], -s[1])):
        i = bisect_right(ends, s[0])  # the first base span that ends after this one's start
        free = s[0] >= done and (i == len(starts) or starts[i] >= s[1])
        if free or s[2] == "secret" and s[1] - s[0] >= LONG:
            more.append(s)
            done = max(done, s[1])
    alike = Counter(s[2] for s in base + more)
    return base, more, [*(pattern(text, s, alike[s[2]], True) for s in base), *(pattern(text, s, alike[s[2]], False) for s in more)]


def spans_of(text: str) -> tuple[list, list, list[str]]:
    return judged(text) if "@" in text or DIGIT.search(text) or any(w in text.lower() for w in (*SECRET_WORDS, "(at)", "[at]", "( at )", "[ at ]")) else ([], [], [])


def features(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Votes as one-hot (n, LABELERS, 3), and the classifier's whole input (n, .), of patterns."""
    parts = [n.split("|") for n in names]
    one = np.eye(3)[np.array([[int(x) + 1 for x in p[1].split(",")] for p in parts]).reshape(-1, LABELERS)]
    kind, length = np.eye(len(KINDS))[[KINDS.index(p[0]) for p in parts]], np.eye(LENGTHS)[[int(p[2]) for p in parts]]
    return one, np.concatenate([one.reshape(len(names), -1), kind, length], 1)


@dataclass
class SpanModel:
    """reliability[labeler][class][vote]: P(vote | class); weights: the span classifier's, over features()."""

    reliability: np.ndarray
    weights: np.ndarray

    def score(self, pattern: str) -> float:
        """Probability that a span of this pattern, seen when learning or not, is personal data."""
        return float(1 / (1 + np.exp(-np.clip(features([pattern])[1] @ self.weights, -50, 50)))[0])

    def accepts(self) -> Callable[[str], bool]:
        """The decision on patterns, with a memo of its own."""
        return cache(lambda pattern: self.score(pattern) >= 0.5)


def fit(counts: dict[str, int]) -> SpanModel:
    """Reliabilities by expectation-maximisation over counted patterns, then the classifier on the posteriors. Without any
    pattern the classifier goes by the votes alone."""
    names = sorted(counts)
    if not names:
        votes_alone = np.tile([-1.0, 0.0, 1.0], LABELERS)
        return SpanModel(np.full((LABELERS, 2, 3), 1 / 3), np.r_[votes_alone, np.zeros(len(KINDS) + LENGTHS)])
    weight = np.array([counts[n] for n in names], float)
    one, x = features(names)
    # at first: more votes for than against
    belief = 1 / (1 + np.exp(-1.5 * (one @ [-1.0, 0.0, 1.0]).sum(1)))
    for _ in range(ROUNDS):
        mass = np.stack([(1 - belief) * weight, belief * weight])
        seen = np.einsum("cn,njk->jck", mass, one) + np.array([[1.0, 1.0, 0.2], [0.2, 1.0, 1.0]])  # a labeler is likelier right than wrong
        trust = seen / seen.sum(2, keepdims=True)
        share = np.clip(mass.sum(1) / weight.sum(), 0.02, 0.98)
        logs = np.log(share)[None] + np.einsum("njk,jck->nc", one, np.log(trust))
        fresh = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if np.abs(fresh - belief).max() < 1e-6:
            break
        belief = fresh
    w, share = np.zeros(x.shape[1]), np.sqrt(weight) / np.sqrt(weight).sum()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 2.0 * (x.T @ (share * (p - belief)) + 1e-4 * w)
    return SpanModel(trust, w)


def learn(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """A model from all spans of all texts. What comes to the driver is a count for each pattern, of which there are few."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("pii")
        counts: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch, "text").to_pylist():
                counts.update(spans_of(text)[2])
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    seen = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pattern string, n bigint")
    return fit({r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find_spans(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans of every row, from whole texts.

    Positions are code points. Null text is empty: no spans. Null and repeated ids are judged row by row. Other columns are
    ignored. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("pii")
        accepts = model.accepts()
        for batch in batches:
            out = []
            for text in texts_of(batch, "text").to_pylist():
                base, more, seen = spans_of(text)
                more = [s for s, p in zip(more, seen[len(base) :], strict=True) if accepts(p)]
                n = Counter(s[2] for s in base)
                out.append((*(n[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more), len(base) + len(more)))
            columns = zip(*out, strict=True) if out else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    out = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, n_added bigint, n_spans bigint")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """docs with every span in text_col replaced by its kind in brackets (`[EMAIL]`). Null text stays null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(text: str | None, accepts: Callable[[str], bool]) -> str | None:
        base, more, seen = spans_of(text or "")
        spans = sorted(base + [s for s, p in zip(more, seen[len(base) :], strict=True) if accepts(p)])
        if not spans:
            return text
        out, done = [], 0
        for a, b, k in spans:
            if a >= done:  # of base spans that overlap, the first names the mark
                out += [text[done:a], f"[{k.upper()}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("pii")
        accepts = model.accepts()
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t, accepts) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_spans(docs, learn(docs))
