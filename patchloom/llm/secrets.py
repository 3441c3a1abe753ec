"""Secret scans: fixed patterns, and a battery of randomness tests on further tokens.

A candidate is a run of token characters that no pattern has matched. Its encoding is inferred from its characters, and
three tests ask how likely ordinary prose or identifiers would look as random as the token does: chi-squared
uniformity over the alphabet, the number of runs of character classes, and the serial correlation of neighbours.
Fisher's method joins them into one p-value. Within a document the p-values are judged together by the
Benjamini-Hochberg procedure with weights that grow with the token's length, as short tokens carry little evidence.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import lean_worker

#: Kinds in the order that ties in a list of spans follow.
KINDS = ("assign", "access", "hex", "random_hex", "random_base32", "random_base36", "random_base64")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_ENCODINGS = (
    ("random_hex", re.compile(r"[0-9a-fA-F]+\Z"), 16), ("random_base32", re.compile(r"[A-Z2-7]+\Z"), 32),
    ("random_base36", re.compile(r"(?:[0-9a-z]+|[0-9A-Z]+)\Z"), 36), ("random_base64", re.compile(r"[A-Za-z0-9+/_-]+\Z"), 64),
)
_SEPARATED, _CLASSES = re.compile("[-_/+]"), [re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]")]
#: Characters of the shortest token that is tested.
LEAST = 16
_NO_SEPARATORS = {ord(c): None for c in "-_/+"}
#: Of prose: the chance that two letters are equal, that neighbours differ in class, and the neighbours' correlation.
PROSE_COINCIDENCE, PROSE_CHANGE, PROSE_CORRELATION = 0.066, 0.08, 0.45


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind, end) of the fixed patterns, each leftmost and non-overlapping, failing ones dropped."""
    found = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _below(z: float) -> float:
    """Normal distribution function."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def battery(token: str, alphabet: int) -> float:
    """p-value of the hypothesis that prose or an identifier made the token; small for tokens that look random."""
    n = len(token)
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    expected = n / alphabet
    chi = sum(k * k for k in counts.values()) / expected - n
    shift = n * max(0.25, alphabet * PROSE_COINCIDENCE - 1)  # of the noncentral distribution that prose gives
    uniform = _below((chi - (alphabet - 1 + shift)) / math.sqrt(2 * (alphabet - 1) + 4 * shift))
    body = token.translate(_NO_SEPARATORS)  # separators would count as changes in paths and dates
    n = len(body)
    if n < 8:
        return 1.0
    classes = [_class(c) for c in body]
    changes = sum(x != y for x, y in zip(classes, classes[1:], strict=False))
    mean = PROSE_CHANGE * (n - 1)
    runs = _below(-(changes - 0.5 - mean) / math.sqrt(mean * (1 - PROSE_CHANGE)))
    # Correlation of (class, place in class), scaled so that a class change is a large step.
    values = [40 * k + (ord(c) & 31) for k, c in zip(classes, body, strict=True)]
    centre = sum(values) / n
    spread = sum((v - centre) ** 2 for v in values)
    serial = sum((x - centre) * (y - centre) for x, y in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    correlation = _below((serial - PROSE_CORRELATION) * math.sqrt(n))
    statistic = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, correlation))  # Gamma(3, 1) by Fisher's method
    return math.exp(-statistic) * (1 + statistic + statistic * statistic / 2)


def _beside(start: int, end: int, taken: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """What is left of start to end beside the spans taken, in order."""
    out = []
    for low, _, _, high in taken:
        if low < end and start < high:
            out.append((start, low))
            start = max(start, high)
    return [(i, j) for i, j in [*out, (start, end)] if j - i >= LEAST]


def _judged(token: str) -> tuple[float, int, str]:
    """p-value, length of what was tested, and kind of a token.

    A token with separators is base64 if it has letters of either case and digits. Otherwise separators join parts: the
    longest is tested if it is long enough, and else all parts as one, as in a UUID.
    """
    if _SEPARATED.search(token) and not all(p.search(token) for p in _CLASSES):
        parts = re.split("[-_/+]", token)
        longest = max(parts, key=len)
        token = longest if len(longest) >= LEAST else "".join(parts)
    kind, alphabet = next((k, a) for k, pattern, a in _ENCODINGS if pattern.match(token))
    return battery(token, alphabet), len(token), kind


def random_spans(text: str, taken: list[tuple[int, int, str, int]], rate: float = 1e-5) -> list[tuple[int, int, str, int]]:
    """Spans that the battery adds beside those taken, at a false-discovery rate within the text."""
    tested = []
    for m in _CANDIDATE.finditer(text):
        for start, end in _beside(m.start(), m.end(), taken):
            token = text[start:end].rstrip("=")
            if len(token) >= LEAST:
                p, n, kind = _judged(token)
                tested.append((p, n, start, kind, end))
    if not tested:
        return []
    mean = sum(n for _, n, *_ in tested) / len(tested)
    ranked = sorted((p / (n / mean), start, kind, end) for p, n, start, kind, end in tested)
    last = max((i for i, (p, *_) in enumerate(ranked, 1) if p <= rate * i / len(ranked)), default=0)
    return [(start, KINDS.index(kind), kind, end) for _, start, kind, end in ranked[:last]]


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, rate: float = 1e-5, text: str = "text") -> DataFrame:
    """docs' doc_id with n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, in code points, end exclusive).

    One row for each row of docs. A null or empty text has no spans, and base_sha256 is that of the empty string; null
    and repeated doc_ids are kept; other columns are ignored. Results depend on a row's text alone.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        for batch in batches:
            out = []
            for value in batch["text"]:
                value = value or ""
                base = base_spans(value)
                kinds = [s[2] for s in base]
                every = base + random_spans(value, base, rate)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, joined(every)))
            frame = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield frame

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(scan, schema)


def redact_secrets(docs: DataFrame, rate: float = 1e-5, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its text replaced by mark, and n_chars of the new text where docs has that column.

    All rows and columns are kept; a null text stays null.
    """

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        lean_worker()

        def one(value: str | None) -> str | None:
            if not value:
                return value
            base = base_spans(value)
            out, at = [], 0
            for start, _, _, end in sorted(base + random_spans(value, base, rate)):
                if end > at:
                    if start >= at:
                        out += [value[at:start], mark]
                    at = end
            return "".join([*out, value[at:]])

        return texts.map(one, na_action="ignore")

    changed = docs.withColumn("text", redacted(F.col("text")))
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed
