"""Secret scans: plain patterns, and parts of multipart credentials linked within scopes.

Three kinds are reported wherever they stand: ``assign``, ``access`` and ``hex``. Weaker parts (a
login, an endpoint, a key-like token, a short hex run) are reported only where a complementary part
stands in the same scope: the interval of ``SCOPE`` characters around it, within one paragraph. Key-like
tokens and short hex runs need an identifier there, and count as secrets for others only then.

Null and empty texts have no spans. Texts are scanned whole, whatever their length; repeated rows
each give a row. An empty table gives no rows. Other columns are ignored by the scan and kept by
:func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import batches, small_batches

#: The patterns of base spans, in order; the group that counts and its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A run of at least that length, to find texts worth the full pattern.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weaker parts, and the kinds that complete each. A key is a whole run, of any length, with all of MIXED in it.
WEAK = {
    "login": re.compile(r"""\b(?:user(?:name)?|login|client_?id|account_?(?:id|name))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", re.I | re.A),
    "endpoint": re.compile(r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}|\b(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}""", re.I | re.A),
    "key": re.compile(r"[A-Za-z0-9+/_-]{30,}"),
    "short_hex": re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-f]{0,22}[0-9])(?=[0-9a-f]{0,22}[a-f])[0-9a-f]{16,23}(?![0-9A-Za-z])"),
}
#: Which parts complete which. Access identifiers and logins name, secrets open, endpoints place.
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "login": "id", "endpoint": "place", "key": "secret", "short_hex": "secret"}
COMPLETES = {"login": {"secret"}, "endpoint": {"secret", "id"}, "key": {"id"}, "short_hex": {"id"}}
KINDS = (*BASE, *WEAK)
#: Characters between two parts of one credential, at most.
SCOPE = 200
PARAGRAPH = re.compile(r"\n[\x20\t]*\n")
MIXED = tuple(map(re.compile, ("[0-9]", "[A-Z]", "[a-z]")))
#: What texts must hold for each weak pattern to be worth trying.
HINTS = {"login": ("user", "login", "client", "account"), "endpoint": ("://", "host", "server", "endpoint")}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """``start, end, kind`` of base spans, leftmost and non-overlapping within a kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of 24 is part of one whole run, and a leftmost match begins where the run does
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def _scopes(text: str) -> list[int]:
    return [0, *(m.end() for m in PARAGRAPH.finditer(text))]


class _Reach:
    """Intervals by their starts, and the furthest end so far, anew in each paragraph: what an interval meets in one bisection."""

    def __init__(self, spans: list[Span], cuts: list[int]):
        self.cuts, self.starts, self.ends, self.paragraphs = cuts, [], [], []
        for a, b, _ in sorted(spans):
            p = bisect_right(cuts, a)
            self.ends.append(max(b, self.ends[-1]) if self.paragraphs and self.paragraphs[-1] == p else b)
            self.starts.append(a), self.paragraphs.append(p)

    def meets(self, a: int, b: int, at: int, slack: int) -> bool:
        """Whether an interval of the paragraph that ``at`` is in comes within ``slack`` of ``[a, b)``."""
        i = bisect_right(self.starts, b + slack) - 1
        p = bisect_right(self.cuts, at)
        if i >= 0 and self.paragraphs[i] > p:  # a later paragraph begins within the slack
            i = bisect_right(self.paragraphs, p) - 1
        return i >= 0 and self.paragraphs[i] == p and self.ends[i] >= a - slack


def linked(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that have a complementary part in their scope, by an interval join: a sort and a bisection a part."""
    weak: list[Span] = []
    low = None
    for kind, pattern in WEAK.items():
        if kind in HINTS:
            low = text.lower() if low is None else low
            if not any(h in low for h in HINTS[kind]):
                continue
        elif not any(ROLE[s[2]] == "id" for s in base) and not any(s[2] == "login" for s in weak):
            continue  # keys are completed by identifiers alone
        for m in pattern.finditer(text):
            if kind != "key" or all(p.search(text, m.start(), m.end()) for p in MIXED):
                weak.append((m.start(), m.end(), kind))
    if not weak:
        return []
    whole = _Reach(base, [])
    # less than one character between: they overlap
    weak = [w for w in weak if w[2] in ("login", "endpoint") or not whole.meets(w[0] + 1, w[1] - 1, 0, 0)]
    cuts = [m.end() for m in PARAGRAPH.finditer(text)]

    def completed(some: list[Span], parts: list[Span]) -> list[Span]:
        reach = {role: _Reach([p for p in parts if ROLE[p[2]] == role], cuts) for role in set(ROLE.values())}
        return [w for w in some if any(reach[role].meets(w[0], w[1], w[0], SCOPE) for role in COMPLETES[w[2]])]

    named = [w for w in weak if w[2] in ("login", "endpoint")]
    keys = completed([w for w in weak if w[2] not in ("login", "endpoint")], base + named)
    return sorted(keys + completed(named, base + named + keys))  # a key that nothing names opens nothing


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both in order."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + linked(text, base), key=lambda s: (s[0], KINDS.index(s[2])))


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan_batches(rows):
    import pyarrow as pa

    for b in batches(rows):
        got = [scan(x.as_py()) for x in b.column(1)]
        told = [_told(base) for base, _ in got]
        counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in BASE]
        yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(t.encode()).hexdigest() for t in told], pa.string()), pa.array([_told(every) for _, every in got], pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` of each row; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scan_batches, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with every reported span replaced; overlapping spans are replaced once."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in scan(text)[1]:
        if b <= at:
            continue
        out += [text[at:a], mark] if a >= at else []
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in texts; ``n_chars`` follows where there is one. No row goes."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts):
        import pyarrow as pa

        return pa.array([redacted(x.as_py()) for x in texts], pa.string())

    out = docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.col(f"`{text_col}`")).cast(docs.schema["n_chars"].dataType)))
    return out.select(*[f"`{c}`" for c in docs.columns])
