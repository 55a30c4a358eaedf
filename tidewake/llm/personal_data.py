"""Personal data by weak supervision.

The project keeps no free text, so the operators are general: records are any table with a text column.

Four base kinds are exact patterns and are always reported. Everything that only may be personal data is a candidate: a
loose pattern finds it, and labelers vote for or against it. Three read its shape by regular expressions and check digits, two look
words near it up in gazetteers, three read the context. Expectation-maximisation over the vote patterns of the whole table
estimates how reliable each labeler is for each kind; the chances it gives train a logistic classifier of spans, which
decides. A table may hold nothing but secrets, or none, so made-up examples of both sorts are voted on and learned from as well.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewake.operators.sizing import checkpointed

from .columns import put_columns

BASE_KINDS = ["email", "ip", "card", "phone"]
LOOSE_KINDS = ["masked_email", "local_phone", "national_id", "secret"]
KINDS = BASE_KINDS + LOOSE_KINDS
SPAN_TYPE = "array<struct<kind:string,first:int,end:int>>"
#: Bound of the candidates that the classifier is fitted on.
SAMPLE_CANDIDATES = 20_000
BUCKETS = 64
NEAR = 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each holds one @, begins where its run of local characters does, and ends its domain greedily.
    Every character is read a fixed number of times."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind as listed, then place. Offsets are code points, ends exclusive."""
    spans = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return spans


_MASK = re.compile(r"[\[(] ?at ?[\])] ?", re.I)
_MASK_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
_MASK_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+", re.I)
_LOOSE = [
    ("local_phone", re.compile(r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\)[ ./-]?)?[0-9]{2,6}(?:[ ./-][0-9]{2,8}){0,4}(?![0-9A-Za-z-])")),
    ("national_id", re.compile(r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{1,2}[0-9]{6,8}[A-Z]?|[0-9]{8}[A-Z])(?![A-Za-z0-9-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{14,}+")),
]
# gazetteers: words that stand near personal data, and near what only looks like it, in the languages of the corpus
WORDS = {
    "masked_email": {"email", "mail", "contact", "write", "correo", "courriel", "kontakt", "address", "reach", "escriba", "schreiben", "ecrivez"},
    "local_phone": {"phone", "tel", "call", "fax", "mobile", "telefon", "telephone", "telefono", "appelez", "cell", "contact", "ring", "dial", "llame", "anrufen",
                    "handy", "movil", "portable", "rufen", "whatsapp", "hotline", "number", "nummer", "numero"},
    "national_id": {"ssn", "social", "security", "id", "passport", "ausweis", "dni", "insurance", "iban", "account", "konto", "reisepass", "pasaporte", "passeport",
                    "nie", "nif", "steuer", "licence", "license", "compte", "cuenta", "identity"},
    "secret": {"password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "access_key", "secret_key", "access_token", "auth", "bearer", "kennwort", "passwort",
               "contrasena", "credential", "credentials", "passphrase", "login", "clave", "motdepasse", "authorization"},
}
INNOCENT = {"version", "isbn", "issn", "page", "pages", "doi", "commit", "sha", "md5", "http", "https", "www", "figure", "table", "no", "release", "branch", "hash",
            "checksum", "revision", "uuid", "guid", "build", "digest", "file", "class", "since", "until", "between", "from", "year", "vol", "pp", "chapter", "section", "etag"}
_WORD_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
LABELERS = ["shape", "form", "mixture", "delimiters", "words_before", "innocent_words", "assignment", "line"]
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
_SLUG = re.compile(r"(?:[A-Za-z]{2,}|[0-9]{1,4}|[A-Za-z]{3,}[0-9]{1,4})(?:[-_](?:[A-Za-z]{1,}|[0-9]{1,4}|[A-Za-z]{3,}[0-9]{1,4}))*\Z")
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}|(?:1[0-9]|20)[0-9]{2}[ -]?[/-][ -]?(?:1[0-9]|20)[0-9]{2})(?: [0-9]{2,6})?\Z")
_ISSUED = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk_|pk_|rk_|xox[abprs]-|eyJ|AIza|glpat-|npm_)")
FORMS = ["uuid", "digest", "slug", "date", "thousands", "issued", "valid", "plain"]
_THOUSANDS = re.compile(r"[0-9]{1,3}(?:[ .][0-9]{3})+\Z")


def _iban(value: str) -> bool:
    """Whether the check digits of an account number are right."""
    text = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def form_of(kind: str, value: str) -> str:
    """What a value looks like: one of FORMS."""
    if kind == "secret":
        return ("issued" if _ISSUED.match(value) else "uuid" if _UUID.match(value) else "digest" if _DIGEST.match(value) else "slug" if _SLUG.match(value) else "plain")
    if kind == "local_phone":
        return "date" if _DATE.match(value) else "thousands" if _THOUSANDS.match(value) and value[0] != "0" else "plain"
    if kind == "national_id" and len(value) >= 15:
        return "valid" if _iban(value) else "plain"
    return "plain"


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose matches that touch no base span."""
    found = []
    for m in _MASK.finditer(text):
        left, right = _MASK_LEFT.search(text[max(0, m.start() - 66):m.start()]), _MASK_RIGHT.match(text, m.end())
        if left and right:
            found.append(("masked_email", m.start() - len(left[0]), right.end()))
    for kind, pattern in _LOOSE if _DIGIT.search(text) else _LOOSE[-1:]:
        for m in pattern.finditer(text):
            value = m[0]
            if kind == "secret":
                fine = sum(map(str.isalpha, value)) >= 4 and (_DIGIT.search(value) or "_" in value or "-" in value)
            else:
                fine = kind != "local_phone" or 7 <= sum("0" <= c <= "9" for c in value) <= 12
            if fine:
                found.append((kind, *m.span()))
    if not found or not base:
        return found
    taken = sorted((a, b) for _, a, b in base)
    starts, reach, out = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]), []
    for kind, a, b in found:
        k = bisect_left(starts, b) - 1
        if k < 0 or reach[k] <= a:
            out.append((kind, a, b))
    return out


def votes(text: str, kind: str, first: int, end: int) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    value, before, after = text[first:end], text[max(0, first - NEAR):first], text[end:end + NEAR]
    digits = sum("0" <= c <= "9" for c in value)
    near = set(re.findall(r"[a-z_]+", before.lower()))
    form = form_of(kind, value)
    groups = re.findall("[0-9]+", value)
    if kind == "secret":
        sorts = sum((any(map(str.isupper, value)), any(map(str.islower, value)), digits > 0))
        shape = -1 if form in ("slug", "uuid") else 1 if sorts == 3 or digits >= 6 or form == "issued" else 0
    elif kind == "local_phone":
        shape = -1 if form == "thousands" or digits < 9 and value[0] != "0" else 1 if value[0] in "0(" or len(groups) == 3 else 0
    elif kind == "national_id":
        shape = 1 if len(value) == 11 and value[3] == "-" and value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" else -1 if len(value) == 11 and value[3] == "-" else 0
    else:
        shape = 1
    formed = {"issued": 1, "valid": 1, "uuid": -1, "digest": -1, "slug": -1, "date": -1, "thousands": -1}.get(form, -1 if kind == "national_id" and len(value) >= 15 else 0)
    changes = sum((a.isdigit() != b.isdigit()) for a, b in zip(value, value[1:]))
    mixture = (1 if changes >= 4 or form == "issued" else -1 if changes <= 2 else 0) if kind == "secret" else 1 if digits >= 9 and shape >= 0 else 0
    attached = before[len(before.rstrip("/._-?&=#:%" + _WORD_CHARS)):]               # what the value hangs on
    in_path = "/" in attached or before[-1:] in ("#", "?", "&") and bool(before) or after[:1] == "/"
    delimiters = -1 if in_path else 1 if before[-1:] in ("\"", "'", "=", ":") else 0
    assignment = 1 if re.search(r"[=:]\s?[\"']?\Z", before) and not in_path else -1 if kind == "secret" and form != "issued" else 0
    line = -1 if "|" in before[-3:] or "|" in after[:3] else 0
    cue = 1 if near & WORDS[kind] else 0 if kind == "masked_email" or form in ("issued", "valid") else -1
    return (shape, formed, mixture, delimiters, cue, -1 if near & INNOCENT else 0, assignment, line)


def features(text: str, kind: str, first: int, end: int) -> np.ndarray:
    """Features of a span for the classifier: kind, form, shape, surroundings and hashed words before it; the votes are not among them."""
    value, before, after = text[first:end], text[max(0, first - NEAR):first], text[end:end + 3]
    k, f = len(LOOSE_KINDS), len(FORMS)
    x = np.zeros(WIDTH)
    kind_at = LOOSE_KINDS.index(kind)
    x[kind_at] = 1
    x[k + kind_at * f + FORMS.index(form_of(kind, value))] = 1
    n = len(value)
    words = re.findall(r"[a-z_]+", before.lower())
    path = before[-1:] in ("/", "#", "?", "&") and bool(before) or after[:1] == "/"
    shape = (min(n, 64) / 64, sum(map(str.isdigit, value)) / n, sum(map(str.isalpha, value)) / n, sum(map(str.isupper, value)) / n,
             min(16, sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))) / 16, bool(re.search(r"[=:]\s?[\"']?\Z", before)) and not path,
             after[:1] in ('"', "'"), path, bool(WORDS[kind] & set(words)), bool(INNOCENT & set(words)), value[:1] in ("0", "("))
    start = k + k * f + kind_at * SHAPES
    x[start:start + SHAPES] = shape
    for word in words[-3:]:
        x[k + k * (f + SHAPES) + crc32(word.encode()) % BUCKETS] = 0.5
    return x


SHAPES = 11
WIDTH = len(LOOSE_KINDS) * (1 + len(FORMS) + SHAPES) + BUCKETS


def examples() -> list[tuple[str, str, int, int]]:
    """Made-up candidates (text, kind, first, end) of every sort, the same at every run. They carry no labels: labelers vote
    on them as on any other."""
    out = []
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for i in range(40):
        h = sha256(str(i).encode()).hexdigest()
        d = str(int(h, 16))
        code = "".join(letters[b % 62] for b in bytes.fromhex(h)[:18 + i % 9])
        word = ["configuration", "international", "documentation", "administration", "transformation", "implementation"][i % 6]
        account = "DE" + str(98 - int(d[:18] + "131400") % 97).zfill(2) + d[:18]
        texts = [f"password={code}", f'token: "{code}"', f"the api_key = {h[:24 + i % 20]} works", f"secret is {code} ok", f"login with clave: {code}",
                 f"at commit {h[:40]} of", f"sha {h[:32]} matches", f"see https://a.org/f/{h[:32]}/x", f"uuid {h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]} was", f"the {word}{2000 + i % 25}-release came",
                 f"in version {i}-{word}", f"a {word}-of-the-{word} thing", f"file {code}.png in /{code}/", f"class {word}_{word}_{i} of", f"uses AKIA{h[:16].upper()} there", f"uses ghp_{code} there", f"order {code} shipped",
                 f"call 0{d[:2]} {d[2:8]} now", f"phone ({d[:3]}) {d[3:6]}-{d[6:10]}", f"tel. {d[:3]}-{d[3:6]}-{d[6:10]}", f"on {2000 + i % 25}-0{1 + i % 9}-1{i % 9} we", f"between 19{10 + i}-20{10 + i % 15} and",
                 f"had {d[:3]} {d[3:6]} {d[6:9]} people", f"pages {d[:4]} {d[4:8]} of", f"IBAN {account} please", f"passport C{d[:8]} of", f"ssn {100 + i}-{10 + i}-{d[:4]} on",
                 f"part no AB{d[:6]} fits", f"lot 9{d[:2]}-00-{d[:4]} left", f"write to ann{i} [at] mail{i} [dot] org", f"ask bob{i}(at)post.example.com"]
        for text in texts:
            out += [(text, *c) for c in candidates(text, base_spans(text))]
    return out


@dataclass
class SpanModel:
    """Reliability of each labeler, and the classifier that decides over candidates."""

    prior: dict[str, float]
    reliability: dict[str, np.ndarray]         # kind: labeler, class, vote + 1
    weights: np.ndarray
    bias: float

    def chance(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50))))


#: Votes that a labeler is taken to have cast before any is seen, and how many of them were right.
PRIOR_VOTES, PRIOR_RIGHT = 10.0, 8.0


def expectation(kinds: list[str], patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[dict, dict, np.ndarray]:
    """Expectation-maximisation over vote patterns and how often each occurs, for each kind by itself. A labeler that abstains says
    nothing. Starts from the sum of votes, so that class 1 is what labelers vote for; reliabilities start from PRIOR_VOTES and may end
    anywhere, also below a half."""
    chance = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))
    kinds_of = np.array(kinds)
    prior, tables = {}, {}
    for kind in sorted(set(kinds)):
        own = kinds_of == kind
        votes_of, n, c1 = patterns[own], counts[own], chance[own]
        table = np.ones((patterns.shape[1], 2, 3))
        for _ in range(rounds):
            prior[kind] = float(np.clip((c1 @ n + 2) / (n.sum() + 4), 0.02, 0.98))
            for k in range(patterns.shape[1]):
                for c, share in enumerate((1 - c1, c1)):
                    yes, no = (float(n @ (share * (votes_of[:, k] == v))) for v in (1, -1))
                    right = ((no if c == 0 else yes) + PRIOR_RIGHT) / (yes + no + PRIOR_VOTES)
                    table[k, c, 2], table[k, c, 0] = (1 - right, right) if c == 0 else (right, 1 - right)
            odds = np.full(own.sum(), np.log(prior[kind] / (1 - prior[kind])))
            for k in range(patterns.shape[1]):
                odds += np.log(table[k, 1, votes_of[:, k] + 1] / table[k, 0, votes_of[:, k] + 1])
            c1 = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        chance[own], tables[kind] = c1, table
    return prior, tables, chance


def _fit(x: np.ndarray, chance: np.ndarray, weight: np.ndarray, rounds: int = 40, penalty: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of given weights, by Newton steps with a small penalty."""
    z, weight = np.column_stack([x, np.ones(len(x))]), weight / weight.sum()
    beta = np.zeros(z.shape[1])
    shrink = np.full(z.shape[1], penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ ((p - chance) * weight) + shrink * beta
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(shrink)
        beta -= np.linalg.solve(curve, slope)
    return beta[:-1], float(beta[-1])


def learn(records: DataFrame, text: str = "text", sample: int = SAMPLE_CANDIDATES) -> SpanModel:
    """Estimate the labelers and fit the classifier on the candidates of all texts.

    Vote patterns are counted over the whole table (at most 3 to the power of the labelers, for each kind, whatever its
    size), with those of examples(). The classifier is fitted on at most `sample` distinct candidates, those with the least hash, and on
    the examples, which weigh a fifth of all. A table without candidates gives a model that accepts nothing. Null and empty
    texts have no candidates.
    """
    kind = "array<struct<kind:string,votes:array<int>,features:array<float>,h:long>>"

    @F.arrow_udf(kind)
    def voted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for value in batch:
                value = value.as_py() or ""
                rows.append([{"kind": k, "votes": list(votes(value, k, a, b)), "features": features(value, k, a, b).tolist(),
                              "h": crc32(value[max(0, a - NEAR):b].encode("utf-8", "surrogatepass"))}
                             for k, a, b in candidates(value, base_spans(value))])
            yield pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("votes", pa.list_(pa.int32())),
                                                     ("features", pa.list_(pa.float32())), ("h", pa.int64())])))

    seen = checkpointed(records.select(F.explode(voted(F.col(text).cast("string"))).alias("c")).select("c.*"))
    groups = seen.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    drawn = seen.groupBy("kind", "votes", "h").agg(F.min("features").alias("features")).orderBy("h").limit(sample).collect()
    counted = {(r.kind, tuple(r.votes)): float(r.n) for r in groups.collect()}
    if not counted:
        return SpanModel({}, {}, np.zeros(WIDTH), -50.0)
    made = [(k, votes(t, k, a, b), features(t, k, a, b)) for t, k, a, b in examples()]
    for k, v, _ in made:
        counted[k, v] = counted.get((k, v), 0.0) + 1.0
    keys = sorted(counted)
    prior, tables, chance = expectation([k for k, _ in keys], np.array([v for _, v in keys]), np.array([counted[key] for key in keys]))
    known = dict(zip(keys, chance))
    x = np.array([r.features for r in drawn] + [f for _, _, f in made])
    y = np.array([known[r.kind, tuple(r.votes)] for r in drawn] + [known[k, v] for k, v, _ in made])
    weight = np.concatenate([np.ones(len(drawn)), np.full(len(made), max(1.0, len(drawn) / (4 * len(made))))])
    weights, bias = _fit(x, y, weight)
    return SpanModel(prior, tables, weights, bias)


def find(records: DataFrame, model: SpanModel, text: str = "text", spans: str = "pii", threshold: float = 0.5) -> DataFrame:
    """Append all personal data of a text: an array of kind, first and end (code points, end exclusive), by kind in the
    order of KINDS, then place.

    Base kinds are always in; a candidate is in if the classifier gives it over `threshold`. Null and empty texts give an
    empty array. Other columns are kept, one named like `spans` is replaced; rows do not change in number.
    """
    @F.arrow_udf(SPAN_TYPE)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            rows = []
            for value in batch:
                value = value.as_py() or ""
                base = base_spans(value)
                more = [s for s in candidates(value, base) if model.chance(features(value, *s)) > threshold]
                rows.append([{"kind": k, "first": a, "end": b} for k, a, b in sorted(base + more, key=lambda s: (order[s[0]], s[1], s[2]))])
            yield pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32())])))

    return put_columns(records, **{spans: found(F.col(text).cast("string"))})


def mask(records: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace each span of a text by its kind in angle brackets. Of spans that overlap, the first is named and all are
    covered. Null texts stay null; other columns are kept. Column names are compared as Spark does, without case."""
    @F.arrow_udf("string")
    def masked(values: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in values:
            out = []
            for value, found in zip(texts, places):
                value, found = value.as_py(), found.as_py()
                if value is not None and found:
                    parts, done = [], 0
                    for s in sorted(found, key=lambda s: (s["first"], s["end"])):
                        if s["first"] >= done:
                            parts += [value[done:s["first"]], f"<{s['kind'].upper()}>"]
                        done = max(done, s["end"])
                    value = "".join([*parts, value[done:]])
                out.append(value)
            yield pa.array(out, pa.string())

    kept = [masked(F.col(text), F.col(spans)).alias(c) if c.lower() == text.lower() else records[c] for c in records.columns]
    return records.select(*kept)
