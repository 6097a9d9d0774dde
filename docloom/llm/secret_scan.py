"""Secret scans with linking of credentials that come in parts.

Base spans are the strong patterns: assignments, access identifiers and long hex runs. Weak candidates (named
identifiers, bare 40-character secrets, endpoints) mean little alone, so an interval join keeps one only if a
complementary part starts or ends within `scope` code points of it in the same text: an identifier needs a secret, a
secret an identifier, an endpoint either. Parts are sorted by position and each is joined by binary search, so a text
with many parts costs n log n and no pairs are listed.

Defined cases: null text is empty; whole texts are read; an empty table gives no rows; other columns are ignored;
rows with equal ids are scanned one by one. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMED = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Weak parts: a named identifier, a bare secret of 40 characters, an endpoint.
WEAK_ID = re.compile(r"""(?:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{4,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
ENDPOINT = re.compile(r"""(?:https?|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", re.I | re.A)
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

Span = tuple[int, int, int]  # start, kind's number, end


def base_spans(text: str) -> list[Span]:
    """The strong patterns, by start, then kind."""
    found: list[Span] = []
    if _NAMED.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _near(span: Span, starts: list[int], reach: list[int], scope: int) -> bool:
    """Whether a part lies within scope of span: of those that start in time, by start, the one that reaches farthest."""
    at = bisect_right(starts, span[2] + scope)
    return at > 0 and reach[at - 1] >= span[0] - scope


def linked_spans(text: str, base: list[Span], scope: int = 400) -> list[Span]:
    """Weak candidates with a complementary part in scope; those inside a base span are that span's."""
    ids = [(m.start(1), 3, m.end(1)) for m in WEAK_ID.finditer(text)] if "=" in text or ":" in text else []
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    strong_ids = [s for s in base if s[1] == 1]
    if not (ids or ends or strong_ids):
        return []
    bare = [s for m in WEAK_SECRET.finditer(text) if mixed(text[(s := (m.start(), 4, m.end()))[0] : s[2]])]

    def joined(some: list[Span], *parts: list[Span]) -> list[Span]:
        others = sorted(x for part in parts for x in part)
        starts, reach = [x[0] for x in others], list(accumulate((x[2] for x in others), max))
        return [s for s in some if _near(s, starts, reach, scope)]

    secrets = bare + [s for s in base if s[1] in (0, 2)]
    kept = joined(ids, secrets) + joined(bare, ids, strong_ids) + joined(ends, ids, strong_ids, secrets)
    # s is inside a base span if one that starts no later reaches its end
    starts, reach = [s[0] for s in base], [0, *accumulate((s[2] for s in base), max)]
    return sorted({s for s in kept if reach[bisect_right(starts, s[0])] < s[2]})


def mixed(token: str) -> bool:
    """Letters of both cases and a digit: not a word, a path or a number."""
    return any(c.islower() for c in token) and any(c.isupper() for c in token) and any(c.isdigit() for c in token)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_text(text: str | None, scope: int = 400) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of one text."""
    base = base_spans(text or "")
    more = linked_spans(text, base, scope) if text else []
    return base, sorted(base + more) if more else base


def redact(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", scope: int = 400) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), base and linked, by start."""

    def spans(texts: list) -> list:
        return [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan_text(t, scope)[1]] for t in texts]]

    return map_texts(docs.select("doc_id", F.col(text).alias("text")), spans, "spans array<struct<kind: string, start: long, end: long>>")


def scan_digest(docs: DataFrame, text: str = "text", scope: int = 400) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (written)."""

    def digests(texts: list) -> list:
        out: list[list] = [[], [], [], [], []]
        for t in texts:
            base, spans = scan_text(t, scope)
            kinds = [s[1] for s in base]
            for column, value in zip(out, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)), strict=True):
                column.append(value)
        return out

    return map_texts(docs.select("doc_id", F.col(text).alias("text")), digests, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text: str = "text", scope: int = 400) -> DataFrame:
    """docs with every found span replaced by a mark; n_chars, where there is one, follows the new text."""

    def clean(texts: list) -> list:
        return [[redact(t, s) if t and (s := scan_text(t, scope)[1]) else t for t in texts]]

    others = [c for c in docs.columns if c != text]
    out = map_texts(docs.select(*others, text).withColumnRenamed(text, "__text"), clean, "__new string").withColumnRenamed("__new", text)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
