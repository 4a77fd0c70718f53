"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation finds how far each is to be
trusted, and a span classifier is trained on the resulting soft labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, give_back

KINDS = ("email", "phone", "ip", "card", "national_id", "iban", "secret")
LABELERS = ("regex", "check", "gazetteer", "context")
THRESHOLD = 0.5
#: Share of personal spans that fail their check (a checksum, a range), at most. Without this bound two labelers that vary
#: don't determine the model, and it would drift to one where the check counts for little.
FAILING = 0.01

_DIGIT = re.compile(r"[0-9]")
_EMAIL_LEFT = re.compile(r"[\w.+%'-]{1,64}\Z")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}\b")
_NUMBER = re.compile(r"[+(]?\(?\d[\d ().\-/]{4,40}\d|\d{5,}")
_NANP = re.compile(r"\+?1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)")
_CARD = re.compile(r"\d{4}(?:[ -]\d{4}){3}(?![ -]?\d)|\d{4}[ -]\d{6}[ -]\d{5}(?![ -]?\d)")
_LONG_RUN = re.compile(r"(?<!\d)\d{12,}")
_ISSUER = re.compile(r"3[04-9]|4|5[0-8]|6|2[2-7]")
_IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_TOKEN = re.compile(r"[A-Za-z0-9_\-/+=]{16,}")
_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|bearer)\b\s*[:=]\s*[\"']?([^\s\"']{6,})")
_SECRET_CUE = re.compile(r"(?i)(token|secret|passw|pwd|key|bearer|auth|credential)")
_CUE = {
    "email": re.compile(r"(?i)mail|contact|write|schreib|escrib|écri|kontakt"),
    "phone": re.compile(r"(?i)tel|phone|call|fax|mobil|cell|ruf|llam|appel"),
    "ip": re.compile(r"(?i)\bip\b|host|server|addr|address|login"),
    "card": re.compile(r"(?i)card|visa|master|karte|tarjeta|carte|credit"),
    "national_id": re.compile(r"(?i)ssn|social|nif|dni|insee|ausweis"),
    "iban": re.compile(r"(?i)iban|account|konto|cuenta|compte|bank"),
    "secret": _SECRET_CUE,
}
#: Words before a number that speak for a version, a page or an amount.
_AGAINST = re.compile(r"(?i)(?:\bv|\bver\.?|version|release|page|seite|página|isbn|\$|€|£|chapter|section|no\.|nr\.|rfc)\s*\Z")
_TLDS = frozenset("com org net edu gov mil int info biz io co us uk de fr es eu at ch it nl be pt pl ru cn jp br in ca au example test me dev app ai".split())
_MAIL_HOSTS = re.compile(r"(?i)\b(?:mail\d*|smtp|gmail|yahoo|outlook|hotmail|gmx|web|proton\w*|icloud|aol|orange|free)\.")
_CALLING = ("+1", "+20", "+27", "+30", "+31", "+32", "+33", "+34", "+36", "+39", "+40", "+41", "+43", "+44", "+45", "+46", "+47", "+48", "+49", "+52", "+55", "+61", "+62", "+7", "+81", "+82", "+86", "+90", "+91")
_IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "PL": 28}


def _luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _numeric(text: str, at: int) -> tuple[str, int, int] | None:
    """The candidate among numbers that covers the digit at `at`."""
    if m := _IP.match(text, at):
        return "ip", *m.span()
    lo = at
    while lo and text[lo - 1] in "+(" and at - lo < 2:
        lo -= 1
    m = _NUMBER.match(text, lo) or _NUMBER.match(text, at)
    if not m:
        return None
    s, e = m.span()
    if one := _NANP.match(text, s):
        return "phone", *one.span()
    if one := _CARD.match(text, s):
        return "card", *one.span()
    # numbers side by side are candidates of their own: an address or a long run of digits ends what stands before it
    for other in (_IP, _LONG_RUN):
        if (x := other.search(text, s + 1, e + 20)) and x.start() < e:
            e = x.start()
    body = text[s:e].rstrip(" ().-/")
    run = re.match(r"\d+", body)
    if run and len(run.group()) >= 9:
        body = run.group()
    digits = re.sub(r"\D", "", body)
    while len(digits) > 15 and " " in body:
        body = body.rpartition(" ")[0].rstrip(" ().-/")
        digits = re.sub(r"\D", "", body)
    e = s + len(body)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", body):
        return "national_id", s, e
    if body.isdigit() and 13 <= len(digits) <= 19:
        return "card", s, e
    if 7 <= len(digits) <= 15 and (len(digits) >= 9 or not body.isdigit()) and re.search(r"\d{3}", body):
        return "phone", s, e
    return None


def candidates(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all candidate spans of the whole text, in order and without overlap. None for null."""
    if not text:
        return
    found: list[tuple[int, int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = _EMAIL_LEFT.search(text, max(0, at - 64), at), _EMAIL_RIGHT.match(text, at + 1)
        if left and right:
            found.append((left.start(), right.end(), 0, "email"))
        at = text.find("@", at + 1)
    if "=" in text or ":" in text:
        found += [(*m.span(1), 1, "secret") for m in _SECRET.finditer(text)]
    place, seen = 0, len(text)
    while m := _DIGIT.search(text, place):
        at = m.start()
        lo = at
        while lo and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "_-/+=")):
            lo -= 1
        tok = _TOKEN.match(text, lo)
        if tok and tok.end() > at and not tok.group().strip("-/+=").replace("-", "").isdigit():
            iban = _IBAN.match(text, lo)
            if iban:
                found.append((*iban.span(), 2, "iban"))
                place = iban.end()
            else:
                s, e = tok.span()
                while e > s and text[e - 1] in "=-/+":
                    e -= 1
                while s < e and text[s] in "=-/+":
                    s += 1
                if e - s >= 20:
                    found.append((s, e, 3, "secret"))
                place = tok.end()
        elif iban := (_IBAN.match(text, lo) if lo < at else None):
            found.append((*iban.span(), 2, "iban"))
            place = iban.end()
        elif number := _numeric(text, at):
            found.append((number[1], number[2], 4, number[0]))
            place = max(number[2], at + 1)
        else:
            place = at + 1
            while place < seen and text[place].isdigit():
                place += 1
    end = -1
    for s, e, _, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if s >= end:
            yield kind, s, e
            end = e


def votes(text: str, kind: str, s: int, e: int) -> tuple[int, int, int, int]:
    """Votes of regex, check, gazetteer and context: 1 personal, -1 not, 0 abstains."""
    span, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 20]
    digits = re.sub(r"\D", "", span)
    lone = (not before or not before[-1].isalnum()) and (not after or not after[0].isalnum())
    cue = 1 if _CUE[kind].search(before) else -1 if kind != "email" and _AGAINST.search(before) else 1 if lone and kind in ("ip", "phone") else 0
    if kind == "email":
        host = span.rpartition("@")[2]
        return 1, 1 if ".." not in span and span[0] != "." else -1, 1 if host.rpartition(".")[2].lower() in _TLDS or _MAIL_HOSTS.search(host) else -1, cue
    if kind == "phone":
        plus = span.startswith("+")
        shape = 1 if plus or re.fullmatch(r"\(?\d{2,5}\)?[ .\-/]\d{2,4}(?:[ .\-/]?\d{2,4}){1,4}", span) else -1
        return shape, 1 if 9 <= len(digits) <= 15 else -1, 1 if plus and span.startswith(_CALLING) else 0, cue
    if kind == "ip":
        parts = [int(x) for x in span.split(".")]
        fits = all(p < 256 for p in parts)
        return 1 if fits else -1, 1 if fits and parts[0] else -1, -1 if span in ("0.0.0.0", "127.0.0.1", "255.255.255.255") or parts[0] in (0, 127) else 1, cue
    if kind == "card":
        return 1 if len(digits) == 16 else 0, 1 if _luhn(digits) else -1, 1 if _ISSUER.match(digits) else -1, cue
    if kind == "national_id":
        return 1, -1 if span[:3] in ("000", "666") or span[0] == "9" else 1, 0, cue
    if kind == "iban":
        flat = span.replace(" ", "")
        return 1, 1 if _mod97(flat) else -1, 1 if _IBAN_LENGTH.get(flat[:2]) == len(flat) else 0, cue
    mixed = sum(bool(re.search(p, span)) for p in ("[a-z]", "[A-Z]", r"\d"))
    long_hex = bool(re.fullmatch(r"[0-9a-fA-F]{32,}", span))
    entropy = len(set(span)) / min(len(span), 16)
    known = bool(re.match(r"(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live|xox[bap]-|AIza|eyJ)", span))
    return 1 if long_hex or (mixed >= 2 and len(span) >= 20) else 0, 1 if entropy >= 0.6 else -1, 1 if known or _SECRET_CUE.search(before) else 0, cue


def shape(text: str, kind: str, s: int, e: int) -> int:
    """Further features of a span as bits: whether it stands alone, is long, is mostly digits, has separators."""
    span = text[s:e]
    lone = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
    return lone | (len(span) >= 20) << 1 | (sum(c.isdigit() for c in span) * 2 >= len(span)) << 2 | any(c in " ().-" for c in span) << 3


def features(text: str, kind: str, s: int, e: int) -> int:
    """Everything the classifier sees, in one integer: kind, four votes, shape. There are at most 7 * 81 * 16 such."""
    code = KINDS.index(kind)
    for v in votes(text, kind, s, e):
        code = code * 3 + v + 1
    return code * 16 + shape(text, kind, s, e)


def unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes of shape (n, 4), shape) of packed features."""
    code = np.asarray(code, dtype=np.int64)
    form, code = code % 16, code // 16
    v = np.stack([code // 3 ** (3 - i) % 3 - 1 for i in range(4)], -1)
    return code // 81, v, form


def reliabilities(v: np.ndarray, weight: np.ndarray, rounds: int = 100, prior: float = 0.8, failing: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of positives, P(vote | class) of shape (labeler, 2, 3), posterior of each row) by expectation-maximisation.

    Starts from the mean vote, or with a bound on failing from 'not personal' where the check votes no; smoothed by counts that favour labelers better
    than chance, so that with little evidence (or none) a labeler that votes yes speaks for yes. failing: the share of
    personal spans whose check votes no, at most.
    """
    n, m = v.shape
    check = LABELERS.index("check")
    post = np.clip(0.5 + 0.45 * v.sum(1) / np.maximum((v != 0).sum(1), 1), 0.05, 0.95)
    if failing < 1:
        post[v[:, check] < 0] = 0.05
    pseudo = np.array([[3.0, 2.0, 1.0], [0.5, 2.0, 3.0]])  # class 0 and 1, vote -1, 0, 1
    share, table = prior, np.tile(pseudo / pseudo.sum(1, keepdims=True), (m, 1, 1))
    for _ in range(rounds):
        share = float((weight @ post + 2 * prior) / (weight.sum() + 2))
        for j in range(m):
            for c, w in ((0, weight * (1 - post)), (1, weight * post)):
                counts = np.bincount(v[:, j] + 1, weights=w, minlength=3) + pseudo[c]
                table[j, c] = counts / counts.sum()
        row = table[check, 1]
        if row[0] > failing:
            row[1:] *= (1 - failing) / row[1:].sum()
            row[0] = failing
        logs = np.log([1 - share, share])[:, None] + sum(np.log(table[j][:, v[:, j] + 1]) for j in range(m))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))) if n else post
        if np.allclose(new, post, atol=1e-7):
            break
        post = new
    return share, table, post


def _design(code: np.ndarray) -> np.ndarray:
    kind, v, form = unpack(code)
    voted = [v[:, j] == s for j in range(4) for s in (-1, 1)]
    cols = [np.ones(len(kind))] + [kind == k for k in range(len(KINDS))] + voted + [(form >> b) & 1 for b in range(4)] + [(kind == k) & x for k in range(len(KINDS)) for x in voted]
    return np.stack([np.asarray(c, dtype=float) for c in cols], 1)


def train(counts: dict[int, int], rounds: int = 50, ridge: float = 0.01) -> np.ndarray:
    """Weights of the span classifier from how often each feature code occurs in the whole corpus.

    For each kind, expectation-maximisation gives the soft labels; one logistic regression over all kinds is then fitted to
    them by Newton steps. The counts are sufficient: the fit equals one over all spans. No span: zero weights.
    """
    code = np.array(sorted(counts), dtype=np.int64)
    x = _design(code)
    w = np.array([counts[c] for c in code.tolist()], dtype=float)
    y = np.zeros(len(code))
    kind, v, _ = unpack(code)
    for k in np.unique(kind):
        y[kind == k] = reliabilities(v[kind == k], w[kind == k], failing=FAILING)[2]
    beta = np.zeros(x.shape[1])
    if not len(code):
        return beta
    w = w / w.sum() * min(w.sum(), 1e6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta += step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def probability(code: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(np.atleast_1d(code)) @ beta, -30, 30)))


def _spans(text: Column) -> Column:
    """array<struct<kind, start, len, code>> of a text's candidates."""

    @F.arrow_udf("array<struct<kind:string,start:int,len:int,code:int>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("len", pa.int32()), ("code", pa.int32())]))
        return pa.array([[{"kind": k, "start": s, "len": e - s, "code": features(t, k, s, e)} for k, s, e in candidates(t)] for t in map(pa.StringScalar.as_py, texts)], kind)

    return run.asNondeterministic()(text)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, len, code of each candidate span of each row (characters, from 0)."""
    return docs.select("doc_id", F.explode(_spans(F.col("text"))).alias("s")).select("doc_id", "s.*")


def count_codes(found: DataFrame) -> dict[int, int]:
    """How often each feature code occurs: one row for each of the few thousand possible codes reaches the driver."""
    return {r[0]: r[1] for r in found.groupBy("code").count().collect()}


def held(counts: dict[int, int], threshold: float) -> dict[int, float]:
    """Probability of each code that is held to be personal, by the classifier that the counts give."""
    codes = np.array(sorted(counts), dtype=np.int64)
    p = probability(codes, train(counts)) if len(codes) else np.zeros(0)
    return {int(c): float(q) for c, q in zip(codes, p) if q >= threshold}


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each span held to be personal data: doc_id, kind, start, len, probability (6 places).

    Null, empty and clean texts give no row; repeated rows give their spans once each; an empty table gives an empty
    result; further columns don't matter. Overlapping candidates: the first, then the longest.
    """
    found = cut(spans(docs))
    known = docs.sparkSession.createDataFrame([(c, round(q, 6)) for c, q in held(count_codes(found), threshold).items()], "code int, probability double")
    return found.join(F.broadcast(known), "code").select("doc_id", "kind", "start", "len", "probability")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, each personal span in `text` replaced by its kind in angle brackets, n_chars set anew if there is such a column.

    Null texts stay null; texts without such spans stay as they are. An empty table gives an empty one; repeated rows are
    treated alike; columns of whatever name stay as they are.
    """
    codes = frozenset(held(count_codes(spans(docs)), threshold))  # 7 * 81 * 16, at most

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = pa.array([_redacted(t.as_py(), codes) for t in texts], pa.string())
        give_back()
        return out

    out = docs.withColumn("text", run.asNondeterministic()(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _redacted(text: str | None, codes: frozenset[int]) -> str | None:
    out, done = [], 0
    for kind, s, e in candidates(text):
        if features(text, kind, s, e) in codes:
            out += [text[done:s], f"<{kind.upper()}>"]
            done = e
    return "".join([*out, text[done:]]) if out else text
