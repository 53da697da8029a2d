"""Secret scans: keyword prefilter, anchored regular expressions near hits, checksum validation."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fieldweave.llm.common import bounded, lean, map_rows, need

# Kinds in their order, the keywords that announce them, and their patterns.
KINDS = ("assign", "access", "hex", "github", "npm", "slack", "google", "stripe", "pem")
BASE = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "slack": ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"),
    "google": ("aiza",),
    "stripe": ("sk_live_", "rk_live_"),
    "pem": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "github": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "slack": re.compile(r"xox[bpars]-[0-9A-Za-z-]{10,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "stripe": re.compile(r"[sr]k_live_[0-9A-Za-z]{16,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(payload: str) -> str:
    """CRC-32 of the payload as six base-62 digits, as such tokens carry it at their end."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        body = m[0].partition("_")[2]
        return checksum62(body[:30]) == body[30:]
    return True


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and then kind; code points, end exclusive.

    Keywords are found in one pass of the automaton over the text with its ASCII letters in lower case. At each hit the
    kind's pattern is tried at that place only, unless the kind's last match covers it; that gives the leftmost matches that
    do not overlap. A match that fails its length or checksum is dropped, but the text it covers stays taken. Runs of
    hexadecimal digits have no keyword and are found by one linear pass.
    """
    lower = text.lower() if text.isascii() else text.replace("İ", "I").lower()  # the only letter whose lower case is longer
    found, taken = [], {}
    hits = sorted((end - n + 1, kind) for end, (kind, n) in _automaton().iter(lower))
    for start, kind in hits:
        if start >= taken.get(kind, 0) and (m := PATTERNS[kind].match(text, start)):
            taken[kind] = m.end()
            if _valid(kind, m):
                found.append((kind, start, m.end()))
    found += [("hex", m.start(), m.end()) for m in PATTERNS["hex"].finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def spans_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each maximal run of covered characters replaced by a mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, s, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each row of `docs`: id, counts of the base kinds, digest of the base spans, all spans, redacted text.

    A null or empty text has no spans; its digest is that of the empty string and its redacted text is the text itself
    (null stays null). Repeated rows and null ids stay. A text is scanned whole, however long; an empty table gives an empty result.
    `with_text=False` leaves the redacted text null.
    """
    src = need(docs, id_col, text_col)

    @lean
    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for value in b.column(1):
                text = value.as_py()
                spans = scan(text) if text else []
                kinds = [k for k, _, _ in spans]
                for c, k in zip(cols, BASE, strict=False):
                    c.append(kinds.count(k))
                cols[3].append(hashlib.sha256(spans_text([x for x in spans if x[0] in BASE]).encode()).hexdigest())
                cols[4].append(spans_text(spans))
                cols[5].append((redact(text, spans) if spans else text) if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=[f"_{i}" for i in range(7)])

    counts = [StructField(c, LongType()) for c in ("n_assign", "n_access", "n_hex")]
    return map_rows(src, run, StructType([src.schema[id_col], *counts, *(StructField(c, StringType()) for c in ("base_sha256", "spans", "redacted"))]))


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of `docs` with secrets in `text_col` replaced by a mark and `length_col`, if there, set to the new length."""
    bounded(docs.sparkSession)
    at = docs.columns.index(text_col)

    @lean
    def run(batches):
        for b in batches:
            texts = [redact(t, scan(t)) if t else t for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return with_length(map_rows(docs, run), text_col, length_col)


def with_length(docs: DataFrame, text_col: str, length_col: str) -> DataFrame:
    if length_col not in docs.columns:
        return docs
    length = F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)).cast(docs.schema[length_col].dataType)
    return docs.select(*[length.alias(c) if c == length_col else F.col(f"`{c}`") for c in docs.columns])
