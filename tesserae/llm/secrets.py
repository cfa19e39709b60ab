"""Secret scans: fixed patterns, and novelty measured with dictionary-primed zstandard.

A random key is the part of a text that its surroundings do not help to compress.  For a candidate
string next to a sensitive word the scan compresses the surrounding code alone and with the
candidate appended, both primed with a dictionary of ordinary identifiers; the difference is the
candidate's marginal cost.  Names, paths and repeated values cost few bytes, keys about their own
length.  Candidates above ``min_novelty`` bytes per character are reported as kind ``novel``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._tables import over_rows
from ._text import pieces

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
SENSITIVE = re.compile(
    r"""(private|access|auth|authorization|bearer|credentials?|signing|encryption|session|client|secret|token|password|passwd|pwd|api)"""
    r"""[A-Za-z_\x20-]{0,24}["']?\x20*[:=\x20]\x20*["']?([A-Za-z0-9+/_.=-]{16,})""",
    re.A | re.I,
)
#: A text without a match of this holds no candidate of any kind.  Letters may match in a wider sense here than above.
PREFILTER = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
    r"""|(?i:private|access|auth|bearer|credential|signing|encryption|session|client|secret|token|password|passwd|pwd|api)[A-Za-z_\x20-]{0,36}["']?\x20*[:=\x20]\x20*["']?[A-Za-z0-9+/_.=-]{16}"""
)
#: Ordinary identifiers, so that they cost little wherever they occur.
IDENTIFIERS = (
    "access_token refresh_token token_type expires_in client_id client_secret grant_type authorization_code api_key apikey "
    "password username user_name email address first_name last_name session_id request_id response_type content_type "
    "application/json text/html charset=utf-8 http:// https:// www. .com .org .net /usr/local/bin /etc/passwd /var/log "
    "localhost 127.0.0.1 example.com config.settings environment variable parameter default_value configuration "
    "public private static void return function import from class self.options.get os.environ process.env getenv "
    "placeholder changeme your_api_key_here your-secret-here replace_with_your_own xxxxxxxxxxxxxxxx 0000000000000000 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 connection_string database_url "
    "authentication authorization encryption certificate signature algorithm implementation initialization "
)


@dataclass(frozen=True)
class Options:
    context: int = 160  # characters of surrounding text on either side
    min_novelty: float = 0.6  # marginal compressed bytes per character
    level: int = 3


class Novelty:
    """Marginal compressed bytes of a string, given its surroundings."""

    def __init__(self, options: Options = Options()):
        self.options = options
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=options.level, dict_data=primed, write_content_size=False, write_checksum=False)

    def marginal(self, text: str, start: int, end: int) -> float:
        n = self.options.context
        around = (text[max(0, start - n) : start] + "\n" + text[end : end + n] + "\n").encode("utf-8", "surrogatepass")
        what = text[start:end].encode("utf-8", "surrogatepass")
        return max(0, len(self.compressor.compress(around + what)) - len(self.compressor.compress(around)))


def find(text: str | None, novelty: Novelty) -> list[tuple[int, int, int, float]]:
    """(start, end, index into KINDS, marginal bytes) of every span, by start, then kind."""
    text = text or ""
    base = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    spans = [(s, e, k, novelty.marginal(text, s, e)) for s, e, k in base]
    at = done = 0
    while m := SENSITIVE.search(text, at):
        s, e = m.span(2)
        at = m.end(1)  # not its end: the string may be or hold the next sensitive word
        if s < done or any(bs < e and s < be for bs, be, _ in base):
            continue
        cost = novelty.marginal(text, s, e)
        if cost >= novelty.options.min_novelty * (e - s):
            spans.append((s, e, 3, cost))
            done = e
    return sorted(spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())]))


def scan(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``docs`` with one more column ``secret_spans``: kind, start, end (code points, end exclusive) and marginal bytes.

    Row by row, so rows, repeated rows, nulls in other columns and clashing names pass through (a
    column ``secret_spans`` of the input is replaced); a null text is empty; an empty table gives none.
    """
    docs = docs.drop("secret_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(options)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
        for whole in batches:
            for b in pieces(whole):
                texts = b.column("text")
                hit = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, PREFILTER), False).to_numpy(zero_copy_only=False))
                spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
                for i in hit:
                    spans[i] = [{"kind": KINDS[k], "start": s, "end": e, "novelty": float(c)} for s, e, k, c in find(texts[int(i)].as_py(), novelty)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, "secret_spans"])

    return over_rows(docs, run, T.StructField("secret_spans", SPANS))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "<SECRET>") -> str:
    """``text`` with every span, overlapping ones merged, replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, options: Options = Options(), mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; ``n_chars``, where there is one, follows.

    Edge cases are those of :func:`scan`: clean rows, null and empty texts, repeated rows, null ids
    and further columns pass through unchanged; very long texts are searched whole; an empty table
    gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(options)
        for whole in batches:
            for b in pieces(whole):
                texts = b.column("text")
                new: dict[int, str] = {}
                for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, PREFILTER), False).to_numpy(zero_copy_only=False)).tolist():
                    if spans := find(text := texts[i].as_py(), novelty):
                        new[i] = redact(text, [(s, e) for s, e, _, _ in spans], mark)
                if new:
                    columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                    changed = pa.array([i in new for i in range(b.num_rows)])
                    columns["text"] = pc.replace_with_mask(texts, changed, pa.array([new[i] for i in sorted(new)], texts.type))
                    if "n_chars" in columns:
                        columns["n_chars"] = pc.replace_with_mask(columns["n_chars"], changed, pa.array([len(new[i]) for i in sorted(new)], columns["n_chars"].type))
                    b = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                yield b

    return over_rows(docs, run)
