"""Personal data: base patterns, and candidates that boosted trees decide on.

Base spans follow fixed patterns, leftmost and without overlap for each kind.
Beyond them, generators of high recall propose spans that may overlap: written
out or spaced addresses, bracketed and hexadecimal internet addresses, and all
runs of digit groups that could be a phone or card number. Boosted trees score
a candidate by its format and by what stands around it; isotonic calibration
on held-out rows turns scores into probabilities, and a kind's threshold is
the lowest score from which they stay at ``PRECISION`` or more. Of overlapping
chosen candidates the likelier stays, then the longer, then the earlier; none
overlaps a base span, which is a redaction already.

The trees are fitted on ``EXAMPLES`` texts made by a seeded rule, whose planted
spans give the labels; the same generators propose the candidates there. So
the model is the same in every run and reads no table.

Defined results: a null or empty text has no spans; repeated rows give repeated
rows; null ids pass through; an empty table gives an empty result. Offsets are
code points, the end is exclusive. The report reads doc_id and text alone;
``redact`` keeps all columns, whatever their names. Scanning takes time in
proportion to the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Made texts of the fit; one in three is held out for calibration.
EXAMPLES, TREES, DEPTH, RATE, BINS, LEAST_LEAF = 6000, 60, 4, 0.25, 32, 10
#: Calibrated probability from which a candidate is redacted.
PRECISION = 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest run before it, so that a long run without one is walked once."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            low = domain.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = [(s, EMAIL, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                found.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), PHONE, m.end()))
    return sorted(found)


# generators

_AT = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s|\s?@\s?", re.IGNORECASE)
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_LABEL = re.compile(r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\s?\.\s?)[A-Za-z0-9-]{1,63}(?![A-Za-z0-9-])", re.IGNORECASE)
_FIRST_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}(?![A-Za-z0-9-])")
_SPLIT_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?|\s\.\s|\.)[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_HEX_IP = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])")
_RUN = re.compile(r"[0-9](?:[ ().\-/ ‑–]{0,3}[0-9])++")
_GROUP = re.compile(r"[0-9]+")
MOST_LABELS, MOST_GROUPS = 6, 8


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) proposals; for every anchor a bounded number."""
    for m in _AT.finditer(text):
        local, first = _BEFORE.search(text[max(0, m.start() - 65) : m.start()]), _FIRST_LABEL.match(text, m.end())
        if local and first:
            start, end = m.start() - len(local.group()), first.end()
            for _ in range(MOST_LABELS):
                label = _LABEL.match(text, end)
                if not label:
                    break
                end = label.end()
                yield start, EMAIL, end
    for m in _SPLIT_IP.finditer(text):
        yield m.start(), IP, m.end()
    if ":" in text:
        for m in _HEX_IP.finditer(text):
            if m.end() - m.start() > 2:
                yield m.start(), IP, m.end()
    for run in _RUN.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, run.start(), run.end())]
        for k, (start, _) in enumerate(groups):
            n = 0
            starts = {start, start - 1} if start > 0 and text[start - 1] in "+(" else {start}
            for begin, end in groups[k : k + MOST_GROUPS]:
                n += end - begin
                if n > 19:
                    break
                for first in starts:
                    if 7 <= n <= 15:
                        yield first, PHONE, end
                    if n >= 12:
                        yield first, CARD, end


# features

#: Words that go with a kind, and words that speak against all; chosen by hand.
CUES = {
    "email": "email mail e-mail contact write reach correo courriel adresse",
    "ip": "ip host server client login logged node gateway address dns ping",
    "card": "card visa mastercard amex credit debit cvv kreditkarte carte tarjeta paid payment",
    "phone": "phone tel telephone call mobile cell fax sms whatsapp telefon teléfono téléphone dial ring",
    "against": "order invoice version isbn ref reference serial build sku page pages total price table figure date time part id ticket score ratio",
}
_CUE_SETS = [frozenset(words.split()) for words in CUES.values()]
_WORD = re.compile(r"[^\W\d_][\w-]*")
_TLDS = frozenset("com org net edu gov io de fr es it nl uk us info eu co ch at".split())
_CLASSES = [str.isspace, str.isalpha, str.isdigit]
REACH = 40


def _class(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    return next((k + 1 for k, test in enumerate(_CLASSES) if test(text[at])), 4)


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of one candidate, as numbers."""
    start, kind, end = span
    own = text[start:end]
    groups = _GROUP.findall(own)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - REACH) : start].lower(), text[end : end + REACH // 2].lower()
    near = _WORD.findall(before)
    cues = [sum(w in cue for w in near) for cue in _CUE_SETS] + [sum(w in cue for w in _WORD.findall(after)) for cue in _CUE_SETS[-1:]]
    letters = sum(c.isalpha() for c in own)
    labels = re.split(r"[^A-Za-z0-9-]+", own)
    low = own.lower()
    separators = [own.count(c) for c in " -./():["]
    return [
        *[float(kind == k) for k in range(4)], len(own), len(digits), letters, len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], *separators, sum(s > 0 for s in separators), own[0] == "+",
        own[0] == "(", 12 <= len(digits) <= 19 and luhn(digits), float(digits[:1] or -1), len(set(digits)), len(labels), len(labels[-1]), labels[-1].lower() in _TLDS, labels[-1] in _TLDS, "::" in own,
        bool(re.search(r"[\[({]\s?at\s?[\])}]", low)), bool(re.search(r"\sat\s", low)), "@" in own, bool(re.search(r"dot", low)), bool(re.search(r"\.\s", own)), any(int(g[:4]) > 255 for g in groups),
        sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups), len(set(sizes)), digits[:2] == "00", digits[:1] == "0", digits[:3] in ("978", "979"),
        max((len(x) for x in re.findall("[0-9a-fA-F]+", own)), default=0), min((len(x) for x in re.findall("[0-9a-fA-F]+", own)), default=0),
        _class(text, start - 1), _class(text, start - 2), _class(text, end), _class(text, end + 1), text[end : end + 1] in "%$€£°", text[max(0, start - 2) : start].strip() in ("$", "€", "£", "#"), *cues, len(near),
    ]


# boosted trees

def _bins(x: np.ndarray) -> list[np.ndarray]:
    """Cut points of each feature, at most BINS - 1."""
    return [np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower")) for column in x.T]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1)


def _tree(b: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree of DEPTH levels by second-order gains: feature and bin of each inner node, value of each leaf."""
    node, inner = np.zeros(len(b), np.int64), (1 << DEPTH) - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)  # rows with a bin up to the cut go left
    for level in range(DEPTH):
        first, width = (1 << level) - 1, 1 << level
        best = np.zeros(width)
        for f in range(b.shape[1]):
            place = (node - first) * BINS + b[:, f]
            g, h, n = (np.bincount(place, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (gradient, curvature, None))
            gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
            gain[(n < LEAST_LEAF) | (n[:, -1:] - n < LEAST_LEAF)] = 0
            at = gain.argmax(axis=1)
            found = gain[np.arange(width), at]
            better = found > best + 1e-9
            best[better] = found[better]
            feature[first : first + width][better], cut[first : first + width][better] = f, at[better]
        node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
    leaf = node - inner
    value = -np.bincount(leaf, gradient, 1 << DEPTH) / (np.bincount(leaf, curvature, 1 << DEPTH) + 1)
    return feature, cut, RATE * value


def _margins(b: np.ndarray, trees: list) -> np.ndarray:
    total = np.zeros(len(b))
    for feature, cut, value in trees:
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        total += value[node - len(feature)]
    return total


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], list]:
    """Cut points and trees of a logistic gradient boosting."""
    cuts, trees = _bins(x), []
    b, margin = _binned(x, cuts), np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_tree(b, p - y, p * (1 - p)))
        margin += _margins(b, trees[-1:])
    return cuts, trees


def isotonic(y: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to ``y``, by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for value in y:
        blocks.append([float(value), 1.0])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, n = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + mean * n) / (blocks[-1][1] + n), blocks[-1][1] + n]
    return np.concatenate([np.full(int(n), mean) for mean, n in blocks]) if blocks else np.zeros(0)


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Scores in order, their probabilities, and the lowest score whose probability is PRECISION; infinity where there is none."""
    order = np.argsort(margin, kind="stable")
    p = isotonic(y[order])
    good = np.flatnonzero(p >= PRECISION)
    return margin[order], p, float(margin[order][good[0]]) if len(good) else float("inf")


# made examples

def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card_digits(rng: random.Random, valid: bool) -> str:
    while True:
        found = rng.choice("3456") + _digits(rng, 15)
        if luhn(found) == valid:
            return found


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) + rng.choice(["", "n", "r", "s"])


def _positive(rng: random.Random, kind: int) -> tuple[str, bool]:
    """A written form, and whether it speaks for itself without a cue."""
    if kind == EMAIL:
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), (" @ ", " . "), ("{at}", "{dot}"), (" at ", ".")])
        local = _name(rng) + rng.choice(["", ".", "_"]) + rng.choice(["", _name(rng), _digits(rng, 2)])
        labels = [_name(rng) for _ in range(rng.choice([1, 1, 2]))]
        return local.rstrip("._") + at + dot.join([*labels, rng.choice(sorted(_TLDS))]), (at, dot) != (" at ", ".")
    if kind == IP:
        if rng.random() < 0.5:
            dot = rng.choice(["[.]", "(.)", "[dot]", " . "])
            return dot.join(str(rng.randint(0, 255)) for _ in range(4)), True
        parts = [f"{rng.randint(0, 65535):x}" for _ in range(8)]
        parts[0] = rng.choice(["2001", "2a02", "fe80", "2607"])
        return (":".join(parts) if rng.random() < 0.5 else ":".join(parts[: rng.randint(2, 4)]) + "::" + ":".join(parts[-rng.randint(1, 2) :])), True
    if kind == CARD:
        valid = rng.random() < 0.7
        d, sep = _card_digits(rng, valid), rng.choice([".", "/", "  ", " - ", " ", "-", ""])
        return (sep.join(d[k : k + 4] for k in range(0, 16, 4))), valid and sep not in (" ", "-", "")
    d = _digits
    forms = [
        (f"({d(rng, 3)}) {d(rng, 3)}-{d(rng, 4)}", True), (f"{d(rng, 3)}-{d(rng, 3)}-{d(rng, 4)}", True), (f"{d(rng, 3)}.{d(rng, 3)}.{d(rng, 4)}", True), (f"00{rng.randint(20, 59)} {d(rng, 3)} {d(rng, 7)}", True),
        (" ".join(["0" + rng.choice("123456789"), *[d(rng, 2) for _ in range(4)]]), True), (f"0{d(rng, 3)}/{d(rng, 6)}", False), (f"0{d(rng, 3)} {d(rng, 6)}", False), (f"{d(rng, 3)} {d(rng, 3)} {d(rng, 3)}", False),
        (f"{d(rng, 3)}-{d(rng, 4)}", False), (d(rng, 10), False), (f"+{rng.randint(20, 59)}/{d(rng, 3)}/{d(rng, 7)}", True),
    ]
    return rng.choice(forms)


def _negative(rng: random.Random) -> str:
    d, r = _digits, rng.randint
    date = f"{r(1900, 2030)}-{r(1, 12):02d}-{r(1, 28):02d}"
    return rng.choice([
        f"{_name(rng)} at {_name(rng)}. {_name(rng).title()} {_name(rng)}", f"{_name(rng)} at {_name(rng)}. {_name(rng)}", *[f"{_name(rng)} at {_name(rng)}. {tld} {_name(rng)}" for tld in (rng.choice(sorted(_TLDS)).title(), "It", "at", "It is")], f"at {r(1, 12)}.{r(10, 59)} at {_name(rng)}.", f"{r(0, 23):02d}:{r(0, 59):02d}:{r(0, 59):02d}",
        ":".join(f"{r(0, 255):02x}" for _ in range(6)), f"{r(1, 9)}:{r(1, 9)}:{r(1, 9)}", date, f"{date} {r(0, 23):02d}:{r(0, 59):02d}:{r(0, 59):02d}", f"{r(1, 28):02d}/{r(1, 12):02d}/{r(1900, 2030)}",
        f"{r(1, 28):02d}.{r(1, 12):02d}.{r(1900, 2030)}", f"{r(0, 9)}.{d(rng, r(7, 15))}", f"{r(1, 999)}.{d(rng, 3)}.{d(rng, 3)}", f"{r(1, 99)} {d(rng, 3)} {d(rng, 3)}", f"978-{r(0, 9)}-{d(rng, 2)}-{d(rng, 6)}-{r(0, 9)}",
        f"979 {r(0, 9)} {d(rng, 4)} {d(rng, 4)} {r(0, 9)}", d(rng, r(7, 14)), _card_digits(rng, False), "0" * r(7, 19), f"{r(1950, 2020)}-{r(1950, 2030)} {r(1950, 2030)}", f"{r(10, 90)}.{d(rng, 4)} {r(1, 99)}.{d(rng, 4)}",
        " ".join(str(r(0, 999)) for _ in range(r(4, 9))), f"{d(rng, 4)}/{d(rng, 4)}", f"{_name(rng)}::{_name(rng)}", f"{r(1, 9)}.{r(0, 20)}.{r(0, 20)} {r(1, 9)}.{r(0, 20)}.{r(0, 20)}", f"{d(rng, 3)}-{d(rng, 2)}-{d(rng, 3)}-{d(rng, 2)}",
        f"{r(1, 30)}-{r(31, 99)} {r(1990, 2030)}", _card_digits(rng, rng.random() < 0.1), f"{_name(rng)} @ {r(1, 99)}.{d(rng, 2)}", " - ".join(d(rng, 4) for _ in range(4)),
    ])


def examples(seed: int, n: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with the spans planted in them; half of the texts hold look-alikes."""
    rng = random.Random(seed)
    cues = {k: CUES[name].split() for k, name in enumerate(KINDS)}
    against = CUES["against"].split()
    for _ in range(n):
        prose = lambda low, high: [_name(rng) for _ in range(rng.randint(low, high))]
        before, after, spans = prose(0, 8), prose(0, 8), []
        if rng.random() < 0.5:
            kind = rng.randrange(4)
            form, plain = _positive(rng, kind)
            if not plain or rng.random() < 0.4:
                before += [rng.choice(cues[kind])] + [_name(rng)] * rng.randint(0, 2)
        else:
            kind, form = None, _negative(rng)
            if rng.random() < 0.5:
                before += [rng.choice(against)] + [_name(rng)] * rng.randint(0, 2)
            elif rng.random() < 0.1:
                before.append(rng.choice(cues[rng.randrange(4)]))
        head = " ".join(before) + rng.choice([" ", " ", ": ", " (", "\n", ", ", ' "'])
        if kind is not None:
            spans.append((len(head), kind, len(head) + len(form)))
        tail = rng.choice([" ", " ", ". ", ", ", ") ", "\n", "!! ", '" ', ""])
        yield head + form + tail + " ".join(after if tail else []), spans


def _rows(texts: Iterator[tuple[str, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of all open candidates."""
    x, y, kinds = [], [], []
    for text, spans in texts:
        for span in open_candidates(text, base_spans(text)):
            x.append(features(text, span))
            y.append(span in spans)
            kinds.append(span[1])
    return np.array(x, float), np.array(y, float), np.array(kinds)


@lru_cache(maxsize=2)
def model(n: int = EXAMPLES, seed: int = 13) -> dict:
    """Cut points, trees, and each kind's calibration; fitted once a process, in some seconds."""
    made = list(examples(seed, n))
    x, y, _ = _rows(t for k, t in enumerate(made) if k % 3)
    cuts, trees = boost(x, y)
    x, y, kinds = _rows(made[::3])
    margin = _margins(_binned(x, cuts), trees)
    return {"cuts": cuts, "trees": trees, "kinds": [calibrated(margin[kinds == k], y[kinds == k]) for k in range(len(KINDS))]}


# detection

def open_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Distinct candidates that overlap no base span."""
    covered: list[list[int]] = []
    for start, _, end in base:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    ends = [c[1] for c in covered]
    free = lambda s, e: (k := bisect_left(ends, s + 1)) == len(covered) or covered[k][0] >= e
    return sorted({c for c in candidates(text) if free(c[0], c[2])})


def choose(found: list[tuple[int, int, int]], margin: np.ndarray, fitted: dict) -> list[tuple[int, int, int, float]]:
    """The candidates over their kind's threshold, with probabilities; of overlapping ones the likeliest."""
    rated = []
    for span, m in zip(found, margin.tolist(), strict=True):
        scores, p, threshold = fitted["kinds"][span[1]]
        if m >= threshold:
            rated.append((-float(p[min(np.searchsorted(scores, m, "right"), len(p)) - 1]), -m, span[0] - span[2], span))
    taken: list[tuple[int, int, int, float]] = []
    starts: list[int] = []
    for p, _, _, span in sorted(rated):
        k = bisect_left(starts, span[2])
        if k == 0 or taken[k - 1][2] <= span[0]:
            starts.insert(k, span[0])
            taken.insert(k, (*span, -p))
    return taken


def detect(texts: list[str], fitted: dict) -> list[tuple[list, list]]:
    """Base spans, and added ones with probabilities, of each text; all candidates are scored together."""
    base = [base_spans(t) for t in texts]
    found = [open_candidates(t, b) for t, b in zip(texts, base, strict=True)]
    rows = [features(t, span) for t, spans in zip(texts, found, strict=True) for span in spans]
    margin = _margins(_binned(np.array(rows, float), fitted["cuts"]), fitted["trees"]) if rows else np.zeros(0)
    ends = np.cumsum([len(f) for f in found])
    return [(b, choose(f, margin[end - len(f) : end], fitted)) for b, f, end in zip(base, found, ends, strict=True)]


def _listed(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(x[:3] for x in spans))


_REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def private_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans of every row."""
    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = detect([t or "" for t in batch.column(1).to_pylist()], fitted)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans, added = pa.array([_listed(base + more) for base, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans, added], names=[c.split(" ")[0] for c in _REPORT.split(", ")])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, _REPORT)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text, overlapping ones as one, replaced by the kind of its first in brackets; null stays null."""
    fitted = model()

    names = docs.columns
    at = names.index("text")
    docs = docs.withColumn("text", F.col("text").cast("string")).toDF(*[f"c{k}" for k in range(len(names))])  # plain names for the time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(at).to_pylist(), []
            for text, (base, more) in zip(texts, detect([t or "" for t in texts], fitted), strict=True):
                parts, done = [], 0
                for start, kind, end in sorted(x[:3] for x in base + more):
                    if start >= done:
                        parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
                    done = max(done, end)
                out.append(None if text is None else "".join(parts) + text[done:])
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def op13_private(spark, sf_dir):
    return private_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
