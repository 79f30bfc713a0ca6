"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

The entropy of a window is that of its character counts. Sliding it by one changes two counts,
so a candidate costs one step per character whatever the width. The sum of c * log2(c) is kept
in whole units of 2**-32, so it never drifts and reruns agree.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import column

# The base patterns and the least lengths of what they keep.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_base64", "entropy_hex", "entropy_lower", "entropy_upper", "entropy_short")
BASE_KINDS = KINDS[:3]

_UNIT = 1 << 32
_SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are maximal runs of ``alphabet``; a window of ``width`` characters at or above
    ``bits`` is suspicious. Random strings mix kinds of characters: ``mixed`` asks for digits and
    for letters in the candidate, ``cased`` for letters of both cases. ``extra`` classes only
    report what no other span covers."""

    kind: str
    alphabet: str
    width: int
    bits: float
    mixed: bool = True
    cased: bool = False
    extra: bool = False


CLASSES = (
    EntropyClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 3.9, cased=True),
    EntropyClass("entropy_hex", "A-Fa-f0-9", 24, 3.0),
    # Thresholds that a thousandth of random tokens stays below; the last one is above that of
    # words in paths, which its alphabet lets in.
    EntropyClass("entropy_lower", "a-z0-9", 20, 3.2, extra=True),
    EntropyClass("entropy_upper", "A-Z0-9", 20, 3.1, extra=True),
    EntropyClass("entropy_short", "A-Za-z0-9", 20, 3.45, cased=True, extra=True),
    EntropyClass("entropy_short", "A-Za-z0-9+/_=-", 20, 3.8, cased=True, extra=True),
)

#: A segment of a candidate, between separators, with one of these is known to be harmless. A word that
#: ends with a separator reaches into the segment behind it.
ALLOWED_WORDS = r"example|placeholder|changeme|redacted|dummy|sample|xxxxxx|your[_-]"
SEPARATORS = r"[/=_-]"
#: Candidates, or what such segments leave of them, that these match as a whole are known to be harmless.
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"[A-Za-z]+([-_/=+]+[A-Za-z]+)*",
    r"[0-9]+([-_/=+]+[0-9]+)*",
    r"(.{1,6})\1{3,}.{0,6}",
)


@dataclass(frozen=True)
class SecretRules:
    classes: tuple[EntropyClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    allowed_words: str = ALLOWED_WORDS
    separators: str = SEPARATORS
    least_run: int = field(default=20)


def entropy_runs(text: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Maximal stretches of ``text`` covered by windows whose entropy is at least ``bits``."""
    n = len(text)
    if n < width:
        return []
    weight = [0] + [round(c * math.log2(c) * _UNIT) for c in range(1, width + 1)]
    most = round((math.log2(width) - bits) * width * _UNIT)  # of the sum of c * log2(c)
    counts: dict[str, int] = {}
    total, found, start, stop = 0, [], -1, -1
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += weight[c + 1] - weight[c]
        if i >= width:
            old = text[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += weight[c - 1] - weight[c]
        if i >= width - 1 and total <= most:
            if i - width + 1 > stop:
                if start >= 0:
                    found.append((start, stop))
                start = i - width + 1
            stop = i + 1
    return found + [(start, stop)] if start >= 0 else found


class _Cover:
    """Whether one of some spans holds all of a stretch."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        ordered = sorted((s, e) for s, _, e in spans)
        self.starts = [s for s, _ in ordered]
        self.reach = list(accumulate((e for _, e in ordered), max))

    def holds(self, a: int, b: int) -> bool:
        at = bisect_right(self.starts, a)
        return at > 0 and self.reach[at - 1] >= b


class Scanner:
    def __init__(self, rules: SecretRules):
        self.assign, self.access, self.hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
        self.classes = [(c, re.compile(f"[{c.alphabet}]{{{c.width},}}")) for c in rules.classes]
        self.allowed = [re.compile(x, re.S) for x in rules.allowed]
        self.words = re.compile(f"(?i)(?=({rules.allowed_words}))")  # also where words overlap
        self.separators = re.compile(rules.separators)

    def spans(self, text: str, long_run: bool) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in order. Without a long run only assignments can occur."""
        found = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if long_run:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
            found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
            base = _Cover(found)
            for c, pattern in self.classes:
                cover = _Cover(found) if c.extra else base
                for start, run in self.candidates(pattern, text):
                    if len(run) < c.width or not self.suspicious(run, c):
                        continue
                    for a, b in entropy_runs(run, c.width, c.bits):
                        a, b = a + start, b + start
                        if not cover.holds(a, b):
                            found.append((a, KINDS.index(c.kind), b))
        return sorted(found)

    def candidates(self, pattern: re.Pattern, text: str) -> Iterator[tuple[int, str]]:
        """Starts and characters of the runs, without their segments with an allowed word."""
        for m in pattern.finditer(text):
            at = m.start()
            for a, b in self.harmless(m[0]):
                yield at, text[at:m.start() + a]
                at = m.start() + b
            yield at, text[at:m.end()]

    def harmless(self, run: str) -> Iterator[tuple[int, int]]:
        """Stretches of whole segments with an allowed word. Each word's segment is looked up among the
        separators, so the time grows with the length of the run and not with its square."""
        hits = [m.span(1) for m in self.words.finditer(run)]
        if not hits:
            return
        marks = [m.start() for m in self.separators.finditer(run)]
        first = last = -1
        for a, b in hits:
            if b <= last:
                continue
            i, j = bisect_left(marks, a), bisect_left(marks, b)
            start, end = marks[i - 1] + 1 if i else 0, marks[j] if j < len(marks) else len(run)
            if start == first:
                last = max(last, end)
            elif start > last:
                if last >= 0:
                    yield first, last
                first, last = start, end
        yield first, last

    def suspicious(self, run: str, c: EntropyClass) -> bool:
        digits = sum(ch.isdigit() for ch in run)
        letters = sum(ch.isalpha() for ch in run)
        if c.mixed and not (digits and letters):
            return False
        if c.cased and (run.lower() == run or run.upper() == run):
            return False
        return not any(a.fullmatch(run) for a in self.allowed)


def _run_table(rules: SecretRules) -> np.ndarray:
    alphabet = re.compile("[A-Za-z0-9" + "".join(c.alphabet for c in rules.classes) + "]")
    return np.array([b < 128 and bool(alphabet.match(chr(b))) for b in range(256)])


def has_long_run(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """For each text whether ``least`` bytes in a row are of the set. Runs over the edge of two
    texts count for both, which only costs a look."""
    if not len(data):
        return np.zeros(len(offsets) - 1, bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside[data].view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    marks = np.zeros(len(data) + 1, np.int32)
    np.add.at(marks, starts, 1)
    opened = np.concatenate(([0], np.cumsum(marks)))
    over = np.zeros(len(data) + 1, np.int32)
    np.add.at(over, ends, 1)
    closed = np.concatenate(([0], np.cumsum(over)))
    # a run that starts before the end of the text and ends behind its start
    return opened[offsets[1:]] - closed[offsets[:-1] + 1] > 0


def _texts(col: pa.Array, rules: SecretRules) -> Iterator[tuple[str, bool]]:
    inside = _run_table(rules)
    least = min([rules.least_run, *(c.width for c in rules.classes)])
    for a, b, data, offsets in K.text_slices(col, K.SMALL_SLICE_BYTES):
        flags = has_long_run(data, offsets, inside, least)
        yield from zip(col.slice(a, b - a).to_pylist(), flags)


def _scan(rules: SecretRules) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(text or "", long)]
                for text, long in _texts(batch.column(1), rules)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])
    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SecretRules = SecretRules()) -> DataFrame:
    """doc_id and the spans (kind, start, end in code points) of every row, by start and kind.

    A null or empty text has no spans. Rows are handled one by one: repeated rows give repeated
    results, an empty table gives an empty result, other columns are not read.
    """
    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return source.mapInArrow(_scan(rules), f"doc_id long, spans {_SPAN}")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: SecretRules = SecretRules()) -> DataFrame:
    """The same rows and columns, every stretch of found secrets replaced by ``mark``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            out = []
            for text, long in _texts(batch.column(at), rules):
                spans = scanner.spans(text, long) if text else []
                parts, done = [], 0
                for start, _, end in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                out.append("".join(parts) + text[done:] if spans else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def spans_text(spans: F.Column, kinds: tuple[str, ...] = KINDS) -> F.Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans as one string."""
    def n(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(spans_text(F.col("spans"), BASE_KINDS), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
