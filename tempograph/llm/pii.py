"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and checks, and always stay. For further kinds (secret, name,
address, national id, IBAN, phone without +, disguised email) broad patterns propose candidate spans, and labelers vote on
each: regular expressions and checksums, gazetteers of words, and the words before the span. Expectation-maximisation over
the vote patterns estimates each labeler's reliability without labels and gives each pattern its probability; a logistic
span classifier over votes, kind and shape is trained on these and decides. One scan of the texts finds and describes
candidates; what the driver gets is the count of each feature pattern, whose number is bounded by the features' design
(kinds x 3^labelers x shapes), never by the data.

Cases: a null text counts as empty; every row gives one row, repeated rows too; an empty table gives no rows; long texts are
scanned whole in linear time; a null doc_id stays null; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import ids_and_text, small_batches, stored

BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # a local part has no @, so each @ decides about one match
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, last := found.end()))
        at = text.find("@", last if found else at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], BASE.index(s[0])))
    return out


KINDS = ("secret", "name", "address", "national_id", "iban", "phone", "email")
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Sr", "Sra")
FIRST_NAMES = frozenset("Anna Anne Carlos Charles Christian David Elena Elizabeth Emily Emma Eva Hans Isabel James Jan Jean John José Juan Julia Karl Klaus Laura Linda Louis Lucas Luis Maria Marie Mark Martin Mary Michael Miguel Paul Pedro Peter Pierre Robert Sarah Sophie Susan Thomas Ursula William".split())
STREETS = frozenset("street st avenue ave road rd lane ln drive dr boulevard blvd court ct way square straße strasse weg platz allee rue calle avenida plaza".split())
#: Street words that have other meanings too: a gazetteer doesn't vouch for them.
DOUBTFUL_STREETS = frozenset("st drive dr court ct way square platz weg plaza place rue calle".split())
SECRET_WORDS = frozenset("password passwd pwd secret token apikey api_key api-key access_key auth bearer credential credentials private_key passphrase kennwort passwort contraseña".split())
CUES = {
    "secret": SECRET_WORDS | frozenset("key login pin".split()),
    "name": frozenset("name dear hello hi contact sincerely regards named".split()) | frozenset(t.lower() for t in TITLES),
    "address": frozenset("address lives live living at resides located ship mail home".split()),
    "national_id": frozenset("ssn social security id passport number tax".split()),
    "iban": frozenset("iban account bank transfer konto compte cuenta".split()),
    "phone": frozenset("phone call tel telephone mobile cell fax telefon téléphone teléfono whatsapp".split()),
    "email": frozenset("email mail contact write e-mail correo".split()),
}
AGAINST = frozenset("version page isbn order invoice figure chapter section table vol no doi".split())
#: The labelers, in the order of their votes: shape and checksum patterns, gazetteers, context.
LABELERS = ("shape", "checksum", "entropy", "gazetteer", "assigned", "cue_before", "against_before")

DIGIT_TOKEN = re.compile(r"[0-9]\S*+")
LONG_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{12,}+")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
REACH = 44  # one more than the longest national id, phone or IBAN, which begin in a token with a digit
#: What is assigned to a secret's name, be it letters alone.
ASSIGNED = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(SECRET_WORDS - {"auth", "bearer"}, key=len, reverse=True)) + r")[\"']?\s*+[=:]\s*+[\"']?([^\s\"',;]{4,}+)", re.I)
ADDRESS = re.compile(r"(?<!\S)[0-9]{1,5}((?: [^\W\d_]+){2,4})")
DISGUISED = re.compile(r"[\[(] ?at ?[\])]", re.I)
DISGUISED_RIGHT = re.compile(r" ?[A-Za-z0-9-]+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+", re.I)
TITLED = re.compile(r"(?<!\w)(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? ([A-ZÀ-Þ][^\W\d_]+(?: [A-ZÀ-Þ][^\W\d_]+)?)")
NAMED = re.compile(r"(?<!\w)(?:" + "|".join(sorted(FIRST_NAMES)) + r") [A-ZÀ-Þ][^\W\d_]+")
WORD = re.compile(r"[^\W\d_][\w-]*")


def iban_ok(text: str) -> bool:
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def entropy(text: str) -> float:
    counts = {c: text.count(c) for c in set(text)}
    return -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, features) of spans that touch no base span and not each other; the patterns' order decides."""
    found: list[tuple[str, int, int]] = []
    for m in DISGUISED.finditer(text):
        stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = stop
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        right = DISGUISED_RIGHT.match(text, m.end())
        if start < stop and right:
            found.append(("email", start, right.end()))
    found += [("secret", *m.span(1)) for m in ASSIGNED.finditer(text)]
    tokens = []
    for m in DIGIT_TOKEN.finditer(text):
        start = m.start()
        while start > 0 and not text[start - 1].isspace():  # a token has one first digit, so no stretch is walked twice
            start -= 1
        tokens.append((start, m.end()))
    if tokens:
        for start, end in tokens:
            for m in LONG_TOKEN.finditer(text, start, end):
                word = m.group()
                if any("0" <= c <= "9" for c in word) and any(c.isalpha() for c in word):
                    found.append(("secret", *m.span()))
        for kind, pattern in (("national_id", NATIONAL), ("phone", LOCAL_PHONE), ("iban", IBAN)):
            for start, end in tokens:
                for m in pattern.finditer(text, start, min(len(text), end + REACH)):
                    if m.start() < end:
                        found.append((kind, *m.span()))
        for start, end in tokens:
            if end - start <= 5 and (m := ADDRESS.match(text, start)):
                ends = [w.end() for w in list(WORD.finditer(text, m.start(1), m.end()))[1:] if w.group().lower() in STREETS]
                if ends:
                    found.append(("address", start, ends[-1]))
    found += [("name", *m.span(1)) for m in TITLED.finditer(text)] + [("name", *m.span()) for m in NAMED.finditer(text)]
    out: list[tuple[str, int, int, str]] = []
    if not found:
        return out
    blocked: list[tuple[int, int]] = []  # disjoint, in order
    for _, start, end in sorted(taken, key=lambda s: s[1:]):
        if blocked and start < blocked[-1][1]:
            blocked[-1] = (blocked[-1][0], max(end, blocked[-1][1]))
        else:
            blocked.append((start, end))
    for kind, start, end in found:
        at = bisect(blocked, (start, end))
        if end <= start or at and blocked[at - 1][1] > start or at < len(blocked) and blocked[at][0] < end:
            continue
        blocked.insert(at, (start, end))
        out.append((kind, start, end, features(text, kind, start, end)))
    return out


def features(text: str, kind: str, start: int, end: int) -> str:
    """The kind, each labeler's vote (+, - or 0 for none), the length class and the share of digits."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    words = [w.lower() for w in WORD.findall(before)][-4:]
    digits = len(digits_of(span))
    votes = ["0"] * len(LABELERS)

    def vote(name: str, yes: bool, no: bool = False) -> None:
        votes[LABELERS.index(name)] = "+" if yes else "-" if no else "0"

    if kind == "secret":
        vote("shape", bool(re.fullmatch(r"[0-9a-f]{16,}|[0-9A-Z]{16,}|[A-Za-z0-9_+/=-]{20,}", span)), "-" in span)
    elif kind == "name":
        vote("shape", " " in span)
    elif kind == "address":  # capitals in all its words, in none, or in some
        capitals = [w[:1].isupper() for w in span.split(" ")[1:]]
        vote("shape", all(capitals), not any(capitals))
    elif kind in ("phone", "national_id"):  # the same mark between its parts, and no digits glued to it
        marks = re.sub(r"[0-9()]", "", span)
        vote("shape", len(set(marks)) == 1, len(set(marks)) > 1)
    elif kind == "iban":  # in fours or without spaces
        parts = span.split(" ")
        vote("shape", len(parts) == 1 or all(len(x) == 4 for x in parts[:-1]), True)
    else:
        vote("shape", "dot" in span.lower())
    if kind == "iban":
        vote("checksum", iban_ok(span), True)
    elif kind == "national_id":
        vote("checksum", span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000", True)
    if kind == "secret":
        vote("entropy", entropy(span) > 3.0 and digits >= 3, entropy(span) < 2.5)
    vote("gazetteer", {"name": span.split(" ")[0] in FIRST_NAMES, "address": span.split(" ")[-1].lower() not in DOUBTFUL_STREETS, "secret": bool(words) and words[-1] in SECRET_WORDS}.get(kind, False))
    vote("assigned", kind != "name" and bool(re.search(r"[=:]\s*[\"']?$", before)))
    vote("cue_before", any(w in CUES[kind] for w in words), False)
    vote("against_before", False, any(w in AGAINST for w in words[-2:]))
    length = min(4, (end - start) // 8)
    return f"{kind}|{''.join(votes)}|{length}|{min(3, 4 * digits // (end - start))}"


def estimate(counts: dict[str, int], rounds: int = 100, prior: float = 0.5) -> dict[str, float]:
    """Two-class expectation-maximisation over vote patterns: P(personal | votes) for each feature pattern.

    Labelers are taken as independent within a class. A labeler starts at 80 % right when it votes, and Beta counts keep
    every estimate inside (0, 1).
    """
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[v] for v in k.split("|")[1]] for k in keys], float).reshape(len(keys), -1)
    shape = (2, len(LABELERS), 3)
    start = np.array([[[0.5, 0.4, 0.1]], [[0.1, 0.4, 0.5]]])  # by class: votes -, none, +
    rates, share = np.broadcast_to(start, shape).copy(), prior
    which = (votes + 1).astype(int)
    cols = np.arange(len(LABELERS))
    for _ in range(rounds):
        logs = np.stack([np.log(rates[c][cols, which]).sum(axis=1) for c in (0, 1)])
        logs += np.log([[1 - share], [share]])
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        share = float(np.clip((n * post).sum() + 1, 1e-9, None) / (n.sum() + 2))
        for c, weight in ((0, n * (1 - post)), (1, n * post)):
            got = np.stack([(weight[:, None] * (which == v)).sum(axis=0) for v in range(3)], axis=1) + 4 * start[c]
            rates[c] = got / got.sum(axis=1, keepdims=True)
    return dict(zip(keys, post.tolist()))


def design(keys: list[str]) -> np.ndarray:
    """Feature patterns as rows of a design matrix."""
    rows = []
    for key in keys:
        kind, votes, length, share = key.split("|")
        row = [1.0] + [float(kind == k) for k in KINDS]
        row += [float(v == "+") for v in votes] + [float(v == "-") for v in votes]
        row += [float(int(length) == i) for i in range(5)] + [float(int(share) == i) for i in range(4)]
        rows.append(row)
    return np.array(rows)


def classifier(counts: dict[str, int], soft: dict[str, float], rounds: int = 500, ridge: float = 1.0) -> dict[str, float]:
    """Logistic regression on the estimated labels, by Newton steps; the probability of each feature pattern."""
    keys = sorted(counts)
    if not keys:
        return {}
    x, y = design(keys), np.array([soft[k] for k in keys])
    w = np.array([counts[k] for k in keys], float)
    beta = np.zeros(x.shape[1])
    for _ in range(min(rounds, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * beta
        step = np.linalg.solve((x.T * (w * p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(beta)), gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist()))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPAN = "array<struct<kind:string,s:int,e:int,key:string>>"


def find(docs: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, s, e, score, base>> by start, then kind."""
    spark = docs.sparkSession
    small_batches(spark)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("key", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                rows.append([(k, s, e, None) for k, s, e in base] + candidates(text, base))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "s", "e", "key"), x)) for x in r] for r in rows], span_type)], names=["doc_id", "found"])

    found = stored(ids_and_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, found {SPAN}"), "pii-candidates")
    patterns = found.select(F.explode("found.key").alias("key")).where("key is not null").groupBy("key").count()
    counts = {r["key"]: r["count"] for r in patterns.collect()}  # bounded by the features' design
    scores = classifier(counts, estimate(counts))
    kept = {k: p for k, p in scores.items() if p >= threshold}
    out_type = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
    order = {k: i for i, k in enumerate(dict.fromkeys((*BASE, *KINDS)))}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                stay = [{"kind": x["kind"], "s": x["s"], "e": x["e"], "score": kept.get(x["key"], 1.0), "base": x["key"] is None} for x in spans if x["key"] is None or x["key"] in kept]
                rows.append(sorted(stay, key=lambda x: (x["s"], order[x["kind"]], x["e"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, out_type)], names=["doc_id", "spans"])

    return found.mapInArrow(decide, "doc_id long, spans array<struct<kind:string,s:int,e:int,score:double,base:boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from find()'s rows, and n_spans, the number of all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                every = [(x["kind"], x["s"], x["e"]) for x in spans]
                base = [s for s, x in zip(every, spans) if x["base"]]
                rows.append([sum(k == b for k, _, _ in base) for b in BASE] + [hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)])
            columns = [batch.column(0)] + [pa.array([r[i] for r in rows], pa.string() if i in (4, 5) else pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{b}" for b in BASE), "base_sha256", "spans", "n_spans"])

    return found.select("doc_id", "spans").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
