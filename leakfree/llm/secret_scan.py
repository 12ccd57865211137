"""Secrets by pattern, and by dictionary-primed compression novelty.

The base patterns find assignments, access keys and hexadecimal runs. Novelty looks at strings that
follow a sensitive word on the same line, or behind a colon or equals sign on the next, and that the base patterns left: each is compressed with a
zstandard dictionary made of common identifiers and of the text around it, so that what the
surroundings or usual code would predict costs few bytes. A string whose marginal bytes come near
its length is random to all that is known around it, and is reported. A PEM private key is reported
up to its END mark if a string in it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_SLICE = 256

ASSIGN = re.compile(
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# Greedy runs: one that is long enough is found from its start on, one that is too short holds no other.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN = 6
_ASSIGN_STEMS = ("passw", "secret", "token", "api")

CONTEXT = re.compile(
    r"(?i:passw(?:or)?d|passphrase|\bpwd\b|secret|token|api[_-]?key|access[_-]?key|private[\x20_-]?key|\bauth|credential|bearer|signature)",
    re.ASCII)
_CONTEXT_STEMS = ("passw", "passph", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "signature")
LEAST = 16
"""Code points of a candidate at least."""
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % LEAST)
REACH = 48
"""A candidate begins at most so many code points after the end of a sensitive word, on its line."""
NAME = re.compile(r"[\w-]*", re.ASCII)
NEXT_LINE = re.compile(r"""["']?[\x20\t]*[:=][\x20\t]*(?:[|>][+-]?[\x20\t]*)?["']?\r?\n[\x20\t]*(?:-[\x20\t]+)?["']?""", re.ASCII)
"""From the end of a name that a line's end parts from its value to that value."""
PEM_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_LINES = re.compile(r"(?:\s*[A-Za-z0-9+/=]{16,})*", re.ASCII)
"""A key goes to the END mark; without one these lines are it."""
AROUND = 512
"""Code points before and after a candidate that prime the dictionary."""
NOVELTY = 0.8
"""Least share of a candidate's bytes that must be left after compression."""

# Words of usual code and configuration; they prime the dictionary beside the surrounding text.
IDENTIFIERS = (
    "password passphrase username user_name user_id account authorization authenticate authentication authenticator "
    "credential credentials secret_key secret_token access_key access_token refresh_token api_key api_token api_version "
    "client_id client_secret private_key public_key session_id session_token bearer signature certificate "
    "configuration config_file environment variable parameter parameters arguments function return import export default "
    "class static public private protected interface implements extends constructor undefined null true false "
    "application service server endpoint request response headers content_type content_length timeout connection "
    "database_url hostname localhost example.com https:// http:// www. .internal .production .development .staging "
    "index length string number integer boolean array object value values keys items list dictionary "
    "create update delete select insert where from table column primary foreign references "
    "begin end private key public key certificate request placeholder your_password_here your_api_key_here changeme xxxxxxxxxxxxxxxx "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 0000000000000000 aaaaaaaaaaaaaaaa"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(s in low for s in _ASSIGN_STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def marginal_share(candidate: str, around: str) -> float:
    """Bytes that the candidate adds after its surroundings and the identifiers, per byte of it."""
    primed = zstandard.ZstdCompressionDict(
        IDENTIFIERS + around.replace(candidate, " ").encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(
        level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = candidate.encode()
    return (len(compressor.compress(data)) - len(compressor.compress(b""))) / len(data)


class _Spans:
    """Spans that do not overlap, by start; asks for overlaps cost a binary search."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        joined: list[list[int]] = []
        for start, end in sorted(spans):
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        self._starts, self._ends = [x[0] for x in joined], [x[1] for x in joined]

    def meet(self, start: int, end: int) -> bool:
        i = bisect_left(self._starts, end)
        return i > 0 and self._ends[i - 1] > start


def _pem_keys(text: str, novel: Callable[[int, int], bool]) -> list[tuple[int, int, int]]:
    """The bodies of PEM private keys that hold a novel string."""
    marks = [m.span() for m in PEM_BEGIN.finditer(text)]
    if not marks:
        return []
    ends, begins = ([m.start() for m in re.finditer(x, text)] for x in ("-----END ", "-----BEGIN "))
    keys = []
    for _, at in marks:
        stop, begun = (x[i] if (i := bisect_left(x, at)) < len(x) else -1 for x in (ends, begins))
        if stop < 0 or 0 <= begun < stop:
            stop = PEM_LINES.match(text, at).end()
        if any(novel(*c.span()) for c in CANDIDATE.finditer(text, at, stop)):
            keys.append((at, 3, stop))
    return keys


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive context that meet no base span. The time is linear in the text."""
    low = text.lower()
    if not any(s in low for s in _CONTEXT_STEMS):
        return []
    out, done, line_end, name_end = [], 0, -1, -1

    def novel(start: int, end: int) -> bool:
        return marginal_share(text[start:end], text[max(0, start - AROUND):start] + text[end:end + AROUND]) >= NOVELTY

    keys = _pem_keys(text, novel)
    known = _Spans([(a, b) for a, _, b in base + keys])
    for m in CONTEXT.finditer(text):
        if name_end < m.end():
            name_end = NAME.match(text, m.end()).end()
        if (x := NEXT_LINE.match(text, name_end)) and (c := CANDIDATE.match(text, x.end())) and c.start() >= done:
            start, end = c.span()
            if any(x.isalpha() for x in c.group()) and not known.meet(start, end) and novel(start, end):
                out.append((start, 3, end))
                done = end
        if line_end < m.end():
            line_end = text.find("\n", m.end())
            line_end = len(text) if line_end < 0 else line_end
        at, within = max(m.end(), done), min(line_end, m.end() + REACH + LEAST)
        # the search ends where a candidate that begins within reach has shown its least length
        while at < within and (c := CANDIDATE.search(text, at, within)):
            start = c.start()
            end = at = done = CANDIDATE.match(text, start, line_end).end()
            if any(x.isalpha() for x in text[start:end]) and not known.meet(start, end) and novel(start, end):
                out.append((start, 3, end))
    return out + keys


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans): spans is an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Null and empty texts have no spans. Repeated rows and null keys are kept, an empty table gives no rows,
    columns other than key and text are not read. Each whole text is scanned by itself.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("key", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in secret_spans(t.as_py())] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(span))], schema=schema)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string")).mapInArrow(
        run, "key long, spans array<struct<kind: string, start: long, end: long>>")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones together, replaced by the mark."""
    spans = secret_spans(text)
    if not spans:
        return text
    parts, at, until = [], 0, -1
    for start, _, end in spans:
        if start >= until:
            parts += [text[at:start], mark]
        at = until = max(until, end)
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; nulls and texts without secrets stay as they are."""

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        parts = [texts.slice(i, _SLICE) for i in range(0, len(texts), _SLICE)]  # few texts are Python strings at a time
        done = [pa.array([redact(t.as_py()) for t in part], pa.string()) for part in parts]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return docs.withColumn(text, cleaned(F.col(text)))


def op7_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(docs)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        F.col("key").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
