"""Secret scans by multipart credential linking.

Strong findings (assignments, access keys, long hexadecimal runs) stand alone. Weak parts - short access
identifiers, bare secret-like strings, endpoints - are found with their scopes and joined by interval: a weak
identifier or secret is reported only where complementary parts co-occur in one scope.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import map_text

ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
#: Weak parts, whole runs of any length; group "x" is the part. A weak secret also has what MIXED asks for.
WEAK = {
    "weak_id": re.compile(r"""(?<![A-Za-z0-9])(?P<x>(?:A[A-Z]IA[A-Z0-9]{8,}|(?i:user|username|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}))""", re.ASCII),
    "weak_secret": re.compile(r"(?<![A-Za-z0-9+/_=-])(?P<x>[A-Za-z0-9+/_=-]{20,})"),
    "endpoint": re.compile(r"(?P<x>(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20\"'<>]{3,})"),
}
#: The parts of an address that names its user: these are an identifier, a secret and the endpoint behind them.
USER_INFO = re.compile(r"://(?P<user>[^\x00-\x20:/@?#]+):(?P<secret>[^\x00-\x20/@?#]{6,})@")
MIXED = (re.compile("[0-9]"), re.compile("[a-z]"))
#: Which other kinds make up a credential with a weak part.
PARTNERS = {"weak_id": ("assign", "hex", "weak_secret"), "weak_secret": ("access", "weak_id"), "endpoint": ("assign", "access", "weak_secret")}
RANK = {kind: i for i, kind in enumerate((*KINDS, *WEAK))}
SCOPE_CHARS = 400


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong findings, by start and then by kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _scopes(text: str, parts: list[tuple[int, int, str]], gap: int) -> list[int]:
    """The scope of each part: a paragraph, cut further where neighbouring parts lie more than ``gap`` apart."""
    out, scope, last = [], 0, 0
    for i, (start, end, _) in enumerate(parts):
        if i and (start - last > gap or text.find("\n\n", last, start) >= 0):
            scope += 1
        last = max(last, end)
        out.append(scope)
    return out


def linked_spans(text: str, base: list[tuple[int, int, str]], gap: int = SCOPE_CHARS) -> list[tuple[int, int, str]]:
    """Weak parts that share a scope, within ``gap`` code points, with a complementary part not overlapping them.

    An address with a user and a secret before its host is three parts, so it is a credential by itself.
    """
    weak = [(m.start("x"), m.end("x"), kind) for kind, pattern in WEAK.items() for m in pattern.finditer(text) if kind != "weak_secret" or all(x.search(m["x"]) for x in MIXED)]
    for i, (start, end, kind) in enumerate(weak):
        if kind == "endpoint" and (m := USER_INFO.search(text, start, end)):
            weak[i] = (m.end(), end, "endpoint")
            weak += [(*m.span("user"), "weak_id"), (*m.span("secret"), "weak_secret")]
    weak = sorted({w for w in weak if w[1] > w[0]})
    if not weak:
        return []
    strong = sorted((s, e) for s, e, _ in base)
    firsts = [s for s, _ in strong]
    reach = []
    for _, e in strong:
        reach.append(max(e, reach[-1]) if reach else e)
    weak = [w for w in weak if not ((i := bisect.bisect_left(firsts, w[1])) and reach[i - 1] > w[0])]
    parts = sorted([*base, *weak])
    scope = _scopes(text, parts, gap)
    # An interval join: of each kind, the part that ends last before a part and the one that starts first after it. A part
    # further off is never in the scope if that one is not, as scopes are runs of the parts in order.
    ends: dict[str, list[tuple[int, int]]] = {}
    starts: dict[str, list[tuple[int, int]]] = {}
    for (start, end, kind), at in zip(parts, scope, strict=True):
        ends.setdefault(kind, []).append((end, at))
        starts.setdefault(kind, []).append((start, at))
    for found in ends.values():
        found.sort()

    def linked(start: int, end: int, at: int, kind: str) -> bool:
        before, after = ends.get(kind, []), starts.get(kind, [])
        i, j = bisect.bisect_left(before, (start + 1,)), bisect.bisect_left(after, (end,))
        return (i > 0 and before[i - 1][1] == at and start - before[i - 1][0] <= gap) or (j < len(after) and after[j][1] == at and after[j][0] - end <= gap)

    return [p for p, at in zip(parts, scope, strict=True) if any(linked(p[0], p[1], at, kind) for kind in PARTNERS.get(p[2], ()))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def all_spans(text: str | None, gap: int = SCOPE_CHARS) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, linked) of all findings of a text, by start and then by kind: strong kinds first."""
    text = text or ""
    base = base_spans(text)
    both = [(*x, False) for x in base] + [(*x, True) for x in linked_spans(text, base, gap)]
    return sorted(both, key=lambda x: (x[0], RANK[x[2]], x[1]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope_chars: int = SCOPE_CHARS) -> DataFrame:
    """One row for each input row: doc_id and spans, an array of (kind, start, end, linked) by start and kind.

    Positions are code points, ends exclusive. A null text counts as empty: no spans. A null id is kept. Repeated rows
    give repeated results. Other columns are not read, so their names cannot clash. An empty table gives no rows. A text
    is scanned whole whatever its length; nothing is shuffled, as all parts of a scope are in one text.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("linked", pa.bool_())]))

    def scan(batch: pa.RecordBatch) -> dict:
        rows = [[{"kind": k, "start": s, "end": e, "linked": x} for s, e, k, x in all_spans(t, scope_chars)] for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "spans": pa.array(rows, span)}

    kind = df.schema[id_col].dataType.simpleString()
    return map_text(df.select(df[id_col].alias("doc_id"), df[text_col].cast("string")), 1, scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,linked:boolean>>")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base, linked = F.filter("spans", lambda x: ~x["linked"]), F.filter("spans", lambda x: x["linked"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(linked).cast("long").alias("n_linked"))


def brute_base(text: str | None) -> tuple[int, int, int, str]:
    """The contract's base results by a plain character walk, for tests."""
    t, found = text or "", []
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    low = "".join(c.lower() if c.isascii() else c for c in t)
    for kind in KINDS:
        i = 0
        while i < len(t):
            j = 0
            if kind == "assign" and (w := next((w for w in words if low.startswith(w, i)), "")):
                p = i + len(w)
                p += t[p : p + 1] in ('"', "'") and p < len(t)
                while t[p : p + 1] == " ":
                    p += 1
                if t[p : p + 1] in (":", "=") and p < len(t):
                    p += 1
                    while t[p : p + 1] == " ":
                        p += 1
                    p += t[p : p + 1] in ('"', "'") and p < len(t)
                    q = p
                    while q < len(t) and (t[q].isascii() and (t[q].isalnum() or t[q] in "+/_.=-")):
                        q += 1
                    j, good = (q, q - p >= 12) if q > p else (0, False)
            elif kind == "access" and t.startswith("AKIA", i):
                q = i + 4
                while q < len(t) and t[q].isascii() and (t[q].isdigit() or t[q].isupper()):
                    q += 1
                j, good = (q, q - i >= 18) if q > i + 4 else (0, False)
            elif kind == "hex" and t[i] in "0123456789abcdef":
                q = i
                while q < len(t) and t[q] in "0123456789abcdef":
                    q += 1
                j, good = q, q - i >= 16
            if j:
                if good:
                    found.append((i, j, kind))
                i = j
            else:
                i += 1
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return (*(sum(x[2] == k for x in found) for k in KINDS), hashlib.sha256(joined(found).encode()).hexdigest())
