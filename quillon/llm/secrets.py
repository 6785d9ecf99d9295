"""Secret scans: plain credential patterns, and weak candidates that count only beside a complementary part.

A credential is often split: an identifier here, a secret there, an endpoint next to them.  Alone, an upper-case
token or a random-looking word is no finding.  Strong parts and weak candidates are intervals in the text, widened by
a reach and clipped to their scope (a paragraph); a weak candidate is reported when its interval meets that of a
part of another role in the same scope, at least one of the two being strong or an endpoint.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
STRONG = {"assign": "secret", "hex": "secret", "access": "access"}
ROLES = {"secret", "access", "endpoint"}
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
URL = re.compile(r"[a-z][a-z0-9+.-]{1,12}://[^\s\"'<>]+", re.A)
#: A run that may hold a host name, and the last label that makes it one; runs don't overlap, so a text is read once.
HOST_RUN, HOST_END, PORT = re.compile(r"(?<![A-Za-z0-9_.-])[a-z0-9][a-z0-9.-]*", re.A), re.compile(r".*[a-z0-9-]\.(?:com|net|org|io|dev|cloud)(?![A-Za-z0-9_])", re.A), re.compile(r":\d+", re.A)
#: What every endpoint holds: a text without it has none.
ENDPOINT_HINT = re.compile(r"://|\.(?:com|net|org|io|dev|cloud)(?![A-Za-z0-9_])", re.A)
WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Z0-9]{16,}(?![A-Za-z0-9+/_=-])")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
INSIDE, OUTSIDE = re.compile(r"[A-Za-z0-9+/_=-]"), re.compile(r"[^A-Za-z0-9+/_=-]")
PARAGRAPH = re.compile(r"\n[ \t]*\n")

Span = tuple[int, int, str]  # start, end, kind


def base_spans(text: str) -> list[Span]:
    """The plain patterns' matches, leftmost and not overlapping within a kind."""
    low, out = text.lower(), []
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of hexadecimal digits is matched from its start to its end, so the least length can stand in the pattern.
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=order)


def order(x: Span) -> tuple[int, int, int]:
    return x[0], KINDS.index(x[2]), x[1]


def entropy(s: str) -> float:
    """Bits per character of a string by its own character counts."""
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def is_random(s: str) -> bool:
    """Whether a string mixes upper case, lower case and digits as generated secrets do."""
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and entropy(s) >= 3.5


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and host names under well-known top-level domains outside them with their ports, in order."""
    urls = [m.span() for m in URL.finditer(text)]
    out, starts = list(urls), [s for s, _ in urls]
    for m in HOST_RUN.finditer(text):
        k = bisect_right(starts, m.end())
        if k and urls[k - 1][1] > m.start():  # the run meets a URL
            continue
        if end := HOST_END.match(text, m.start(), m.end()):
            port = PORT.match(text, end.end())
            out.append((m.start(), port.end() if port else end.end()))
    return sorted(out)


class Intervals:
    """Spans (start, end, role) by paragraph and role, for asking whether one lies near a place."""

    def __init__(self, spans: list[Span], cuts: list[int]):
        self.cuts, self.of = cuts, {}
        for s, e, role in sorted(spans):
            starts, ends = self.of.setdefault((bisect_left(cuts, s), role), ([], []))
            starts.append(s)
            ends.append(max(e, ends[-1]) if ends else e)  # the farthest end so far

    def near(self, s: int, e: int, reach: int, roles: set[str]) -> bool:
        scope = bisect_left(self.cuts, s)
        for role in roles:
            starts, ends = self.of.get((scope, role), ((), ()))
            k = bisect_right(starts, e + reach)
            if k and ends[k - 1] >= s - reach:
                return True
        return False


def linked_spans(text: str, base: list[Span], reach: int = 200) -> list[Span]:
    """Weak candidates and endpoints that a complementary part lies within reach of, in the same paragraph."""
    if not base and not ENDPOINT_HINT.search(text):
        return []
    cuts = [m.start() for m in PARAGRAPH.finditer(text)]
    taken, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))

    def free(s: int, e: int) -> bool:
        k = bisect_left(taken, e)
        return not k or ends[k - 1] <= s

    anchors = sorted([(s, e, STRONG[k]) for s, e, k in base] + [(s, e, "endpoint") for s, e in endpoints(text)])
    out: set[Span] = set()
    done_to = 0
    for s, e, _ in anchors:  # only the neighbourhood of an anchor can hold a linked candidate
        lo, hi = max(done_to, s - reach), min(len(text), e + reach)
        if hi < lo:
            continue
        while lo > done_to and INSIDE.match(text, lo - 1):  # from the start of a token to the end of one
            lo -= 1
        end = OUTSIDE.search(text, hi)
        done_to = hi = end.start() if end else len(text)
        weak = [(m.start(), m.end(), "weak_access") for m in WEAK_ACCESS.finditer(text, lo, hi) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
        weak += [(m.start(), m.end(), "weak_secret") for m in WEAK_SECRET.finditer(text, lo, hi) if is_random(m[0])]
        out |= {x for x in weak if free(x[0], x[1])}
    parts = Intervals(anchors, cuts)
    found = [x for x in out if parts.near(x[0], x[1], reach, ROLES - {x[2].removeprefix("weak_")})]
    roles = Intervals([(s, e, STRONG.get(k) or k.removeprefix("weak_")) for s, e, k in [*base, *found]], cuts)
    return found + [(s, e, "endpoint") for s, e, role in anchors if role == "endpoint" and free(s, e) and roles.near(s, e, reach, ROLES - {role})]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, text_col: str = "text", reach: int = 200) -> DataFrame:
    """docs with their spans: kinds counted, base spans' digest, all spans, and the text with all spans blanked.

    Nothing is shuffled, and each row stands alone: equal or null ids, repeated rows and other columns pass through.
    Null texts count as empty and stay null in redacted.  Added columns (they replace ones of their names):
    n_assign, n_access, n_hex, base_sha256, spans, redacted.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            text = t or ""
            base = base_spans(text)
            spans = sorted([*base, *linked_spans(text, base, reach)], key=order)
            counts = Counter(k for _, _, k in base)
            rows.append((counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(t, spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")
    held = docs.withColumn("_found", found(F.col(text_col)))
    return held.withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")


def redact(text: str | None, spans: list[Span], mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by a mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
