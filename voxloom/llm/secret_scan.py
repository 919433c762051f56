"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are always reported.  Weak candidates
(identifier-like, key-like and endpoint-like strings) are too common to report alone: an interval join within a scope
(the paragraph; with a ``radius``, at most so many characters between the spans as well) looks for complementary parts, and only candidates
whose complement is there are reported: an identifier near a secret, a key near an identifier, an endpoint near both.
The join runs over the sorted intervals of one document by bisection; it asks whether a partner exists, so its output
has at most one row per candidate, however many parts crowd into a scope.

Defined results: null counts as empty text, without spans; offsets count code points, ends exclusive; repeated rows
give repeated rows; equal starts are ordered by kind as listed in ``KINDS``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from voxloom.llm.common import arrow_map

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])[A-Z0-9]{16,40}(?![A-Za-z0-9])")
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,88}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:@%-]+")
TRIGGER = ("password", "passwd", "secret", "token", "api")

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "key", "endpoint")
#: Default of ``scan`` for the characters between two parts (``find`` and ``clean`` take whole paragraphs); bits of entropy
#: a character of a weak key.
RADIUS, KEY_ENTROPY = 200, 3.5
#: How each kind serves as a part.
PARTS = {"access": "id", "identifier": "id", "assign": "secret", "hex": "secret", "key": "secret", "endpoint": "endpoint"}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    low = text.lower()
    if any(t in low for t in TRIGGER):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Candidates that overlap no strong span."""
    taken = sorted((a, b) for a, b, _ in strong)
    starts, reach = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]

    def free(a: int, b: int) -> bool:
        """No strong span that starts before ``b`` reaches beyond ``a``."""
        return reach[bisect_left(starts, b)] <= a

    found = [(m.start(), m.end(), "identifier") for m in WEAK_ID.finditer(text)]
    if found or any(k == "access" for _, _, k in strong):  # a key is reported near an identifier only
        found += [(m.start(), m.end(), "key") for m in WEAK_KEY.finditer(text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and entropy(m[0]) >= KEY_ENTROPY]
    if "://" in text and (found or strong):
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    return [s for s in found if free(s[0], s[1])]


def linked(text: str, strong: list[Span], weak: list[Span], radius: int | None = RADIUS) -> list[Span]:
    """The weak candidates with complementary parts in their scope; without a radius, the scope alone is the bound."""
    if not weak:
        return []
    if radius is None:
        radius = len(text)
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    starts: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "endpoint": []}
    ends: dict[str, list[tuple[int, int]]] = {part: [] for part in starts}
    for a, b, kind in strong + weak:
        scope = bisect_right(breaks, a)
        starts[PARTS[kind]].append((scope, a))
        ends[PARTS[kind]].append((scope, b))
    for spans in (*starts.values(), *ends.values()):
        spans.sort()

    def near(part: str, a: int, b: int) -> bool:
        """Whether a span of the part ends at or before ``a``, or starts at or after ``b``, in the scope and the radius:
        the nearest on each side decides."""
        scope = bisect_right(breaks, a)
        i, j = bisect_right(ends[part], (scope, a)) - 1, bisect_left(starts[part], (scope, b))
        before, after = ends[part][i] if i >= 0 else (-1, 0), starts[part][j] if j < len(starts[part]) else (-1, 0)
        return (before[0] == scope and before[1] >= a - radius) or (after[0] == scope and after[1] <= b + radius)

    needs = {"identifier": ("secret",), "key": ("id",), "endpoint": ("id", "secret")}
    return [(a, b, kind) for a, b, kind in weak if all(near(part, a, b) for part in needs[kind])]


def written(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], rank[s[2]])))


def scan(text: str, radius: int | None = RADIUS) -> tuple[list[Span], list[Span]]:
    strong = base_spans(text)
    return strong, linked(text, strong, weak_spans(text, strong), radius)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts of the strong kinds, digest of the strong spans, and all spans."""

    def kernel(batch):
        got = [scan(t or "", radius) for t in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0),
            **{f"n_{k}": [sum(s[2] == k for s in strong) for strong, _ in got] for k in BASE},
            "base_sha256": [hashlib.sha256(written(strong).encode()).hexdigest() for strong, _ in got],
            "spans": [written(strong + weak) for strong, weak in got],
            "n_linked": [len(weak) for _, weak in got],
        }

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, schema, "text")


def clean(docs: DataFrame, radius: int | None = None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the texts; ``chars_col`` follows where it is not null.  Null stays null."""
    names = docs.columns

    def kernel(batch):
        k = names.index(text_col)
        texts = batch.column(k).to_pylist()
        new = [t if not t or not any(s := scan(t, radius)) else redact(t, s[0] + s[1]) for t in texts]
        out = {name: batch.column(i) for i, name in enumerate(names)} | {text_col: new}
        if chars_col in names:
            was = batch.column(names.index(chars_col)).to_pylist()
            out[chars_col] = [n if n is None or a is b else len(b) for n, a, b in zip(was, texts, new)]
        return out

    return arrow_map(docs, kernel, docs.schema, text_col)
