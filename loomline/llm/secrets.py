"""Secret scans: fixed patterns and dictionary-primed zstandard novelty.

Strings in a sensitive context that the patterns don't take are measured: the
compressor is primed with a dictionary of identifiers and with the text around a
candidate, and its marginal bytes are what the candidate adds. Names, paths and
words cost little; keys cost nearly their own length and are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded, table
from .words import pieces, tidy

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more characters of [0-9a-f]+
#: A sensitive word; the strings that begin at most REACH characters after it in its line; what stands behind an = in a string.
WORD = re.compile(r"(?i:pass|pwd|secret|token|auth|bearer|key|credential|private|signature)", re.A)
REACH = 48
STRING = re.compile(r"(?<=[\s\"'=:,(])[A-Za-z0-9+/_=.~-]{16,}", re.A)
PART = re.compile(r"(?<==)[A-Za-z0-9+/_.~-]{16,}=*", re.A)
# Literals without which a pattern cannot match, lower-cased.
OF_ASSIGN = (b"passw", b"secret", b"token", b"api_key", b"apikey")
OF_CONTEXT = (b"pass", b"pwd", b"secret", b"token", b"auth", b"bearer", b"key", b"credential", b"private", b"signature")
NEAR = 256  # characters on either side that prime the compressor
LEAST_RATIO, LEAST_BITS = 0.7, 3.2  # marginal bytes a character; bits a character of the candidate alone
LEAST_PART = 12  # characters between punctuation; paths and names have shorter parts

# Identifiers that stand around secrets in code and settings.
IDENTIFIERS = "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret authorization bearer credential signature username hostname localhost database connection config settings environment export import return function const string public static void class self None null true false http https www com org net example index main test default value name type data file path user admin root key id url uri json xml html version request response header content-type application utf-8 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"


class Novelty:
    """Marginal compressed bytes of a string after an identifier dictionary and its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_dict_id=False)

    def marginal(self, candidate: str, around: str) -> int:
        near = around.encode("utf-8", "replace")
        return len(self.pack.compress(near + candidate.encode())) - len(self.pack.compress(near))


def _bits(text: str) -> float:
    n = len(text)
    return -sum(c / n * log2(c / n) for c in Counter(text).values())


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True


def _rows_with(low: bytes, offsets: np.ndarray, literals: tuple[bytes, ...]) -> set[int]:
    """Rows of a lower-cased buffer in which a literal starts."""
    at = []
    for literal in literals:
        i = low.find(literal)
        while i >= 0:
            at.append(i)
            i = low.find(literal, i + 1)
    return set((np.searchsorted(offsets, np.array(at, np.int64), "right") - 1).tolist())


def _rows_with_hex(raw: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Rows near which 16 hexadecimal digits stand in a row."""
    run = _HEX_BYTE[raw]
    for step in (1, 2, 4, 8):
        run = run[:-step] & run[step:] if len(run) > step else run[:0]
    return set((np.searchsorted(offsets, np.flatnonzero(run), "right") - 1).tolist())


def candidates(column: pa.Array) -> Iterator[tuple[bool, ...]]:
    """For every row of a text column whether ASSIGN, ACCESS, HEX and CONTEXT are worth a search; literals tell."""
    for a, b, raw, offsets in pieces(column):
        plain = raw.tobytes()
        low = plain.lower()
        found = [_rows_with(low, offsets, OF_ASSIGN), _rows_with(plain, offsets, (b"AKIA",)), _rows_with_hex(raw, offsets), _rows_with(low, offsets, OF_CONTEXT)]
        for i in range(b - a):
            yield tuple(i in f for f in found)


def base_spans(text: str, search: tuple = (True, True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns; end exclusive, code points."""
    out = []
    if search[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if search[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if search[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _strings(text: str) -> Iterator[tuple[int, int]]:
    """Every string in the reach of a sensitive word, by start; the parts of a string come after it."""
    upto, parts = 0, None  # end of the last string; where the search for its parts goes on
    for m in WORD.finditer(text):
        line = text.find("\n", m.end(), m.end() + REACH)
        at, last = m.end() + 1, (m.end() + REACH if line < 0 else line) + 1
        while at <= last:
            if at < upto:
                part = PART.search(text, max(at, parts), min(upto, last + 16))
                if part and part.start() <= last:
                    part = PART.match(text, part.start(), upto)
                    yield part.span()
                    parts = at = part.end()
                    continue
                if upto > last:
                    break
                at = upto
            found = STRING.search(text, at, min(len(text), last + 16))
            if not found or found.start() > last:
                break
            found = STRING.match(text, found.start())
            yield found.span()
            upto, at = found.end(), found.start() + 1
            parts = at


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Spans that only the compressor finds; none overlaps another or a base span."""
    out, i, taken = [], 0, sorted((s, e) for s, _, e in base)
    ends = done = -1
    for a, b in _strings(text):
        while i < len(taken) and taken[i][0] <= a:
            ends = max(ends, taken[i][1])
            i += 1
        word = text[a:b]
        if max(ends, done) > a or (i < len(taken) and taken[i][0] < b) or max(map(len, re.split(r"[^A-Za-z0-9+]", word))) < LEAST_PART or _bits(word) < LEAST_BITS:
            continue
        if novelty.marginal(word, text[max(0, a - NEAR) : a] + text[b : b + NEAR]) >= LEAST_RATIO * len(word):
            out.append((a, 3, b))
            done = b
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty, nothing = Novelty(), (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    for batch in batches:
        rows = []
        for x, search in zip(batch.column(1), candidates(batch.column(1)), strict=True):
            if not any(search):
                rows.append(nothing)
                continue
            text = x.as_py()
            base = base_spans(text, search)
            kinds = Counter(k for _, k, _ in base)
            every = sorted(base + novel_spans(text, base, novelty)) if search[3] else base
            rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text.

    Spans are matches as kind:start:end, by start, then kind (assign, access,
    hex, novel); base_sha256 covers the first three. Overlapping matches of
    different kinds are all kept. Null and empty texts have no spans. Rows are
    scanned one by one: repeated rows repeat, other columns are not read.
    """
    bounded(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(tidy(_scan), f"doc_id {source.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; every span of the text is replaced by the mark, overlapping spans by one.

    Null and empty texts stay as they are, repeated rows repeat, columns may have
    any names, an empty input gives an empty result.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            texts = []
            for x, search in zip(batch.column(at), candidates(batch.column(at)), strict=True):
                text = x.as_py()
                if any(search):
                    base = base_spans(text, search)
                    parts, done = [], 0
                    for a, _, b in sorted(base + novel_spans(text, base, novelty)):
                        if a >= done:
                            parts += [text[done:a], mark]
                        done = max(done, b)
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
