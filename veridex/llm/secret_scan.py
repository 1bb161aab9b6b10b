"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, score
every candidate token; a token whose log-likelihood ratio is high enough is a secret. Both are trained from
labelled samples: values that the patterns find in a bounded sample of documents are random strings, other
long tokens of the same documents are ordinary. The models are mixed with a uniform distribution, so random
strings of alphabets that the sample lacks still score.

The least ratio is chosen on planted strings of shapes that the sample lacks and on identifiers of code (see README);
it doesn't depend on the corpus.

Patterns and candidates are searched in whole texts of any length. Nulls: a null text is empty; all columns but the
text are carried (one named spans gives way to the spans). Repeated rows each get their result; an empty table gives
an empty result. Without any labelled sample the models add nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS, MODEL_KIND = ("assign", "access", "hex"), "markov"
KINDS = (*BASE_KINDS, MODEL_KIND)
LEAST_VALUE = 8

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
SAMPLE_ROWS = 20_000
LEAST_RATIO = 16.0
PLACEHOLDER = "[secret]"

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(_ALPHABET) + 1  # and a string's border
_CODE = np.full(128, 0, dtype=np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, _SIZE)

Span = tuple[str, int, int]
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[Span]:
    """Kind, start, end (code points, end exclusive) of what the patterns find, by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:  # of a run that is long enough, the whole run; shorter runs have no other match
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


class Cover:
    """What spans cover, for quick questions."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for _, a, z in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(z, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(z)

    def apart(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start


def _codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]


def _pairs(tokens: list[str]) -> np.ndarray:
    """How often each character follows each other one, borders included."""
    flat = np.r_[np.concatenate([np.r_[0, _codes(t)] for t in tokens] or [np.zeros(0, np.int64)]), 0].astype(np.int64)
    return np.bincount(flat[:-1] * _SIZE + flat[1:], minlength=_SIZE * _SIZE)


def samples(text: str) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers of a text, as the patterns label them."""
    spans = base_spans(text)
    random = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if any(k == "assign" for k, _, _ in spans) else []
    random += [text[a:z] for k, a, z in spans if k != "assign"]
    cover = Cover(spans)
    return random, [m[0] for m in ORDINARY.finditer(text) if cover.apart(*m.span())]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often pairs of characters occur, numbered through both tables."""
    for part in T.slices(batches, "text"):
        random, ordinary = [], []
        for t in part.column("text").to_pylist():
            r, o = samples(t)
            random += r
            ordinary += o
        counts = np.concatenate([_pairs(random), _pairs(ordinary)])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["pair", "n"])


class Ratio:
    """Log-likelihood ratio of the two Markov models."""

    def __init__(self, counts: np.ndarray, uniform: tuple[float, float] = (0.3, 0.02)):
        table = counts.reshape(2, _SIZE, _SIZE).astype(np.float64)
        table[:, 0, 0] = 0  # two borders meet between no characters
        self.trained = bool((table.sum(axis=(1, 2)) > 0).all())
        logs = []
        for t, share in zip(table, uniform, strict=True):
            often = (t.sum(axis=0) + 0.01) / (t.sum() + 0.01 * _SIZE)  # stands in for what seldom follows a character
            seen = (t + 5 * often) / (t.sum(axis=1, keepdims=True) + 5)
            logs.append(np.log((1 - share) * seen + share / _SIZE))
        self.ratio = logs[0] - logs[1]

    def score(self, token: str) -> float:
        c = np.r_[0, _codes(token), 0]
        return float(self.ratio[c[:-1], c[1:]].sum())

    def added(self, text: str, base: list[Span], least: float = LEAST_RATIO) -> list[Span]:
        """Candidate tokens that score as random, outside of base spans. Tokens without letters, and those without digits whose
        letters are of one case or only begin with a capital, aren't scored."""
        if not self.trained:
            return []
        out, cover = [], Cover(base)
        for m in CANDIDATE.finditer(text):
            token = m[0]
            if not re.search("[A-Za-z]", token) or not re.search("[0-9]", token) and (token.isupper() or token[1:].islower()):
                continue
            if cover.apart(*m.span()) and self.score(token) >= least:
                out.append((MODEL_KIND, *m.span()))
        return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ratio:
    """Fit on about sample_rows different texts chosen by a hash; a table of pairs of characters reaches the driver."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    share = min(1.0, sample_rows / max(docs.count(), 1))
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = texts.where(u < share).dropDuplicates().mapInArrow(_count_batches, "pair long, n long").groupBy("pair").agg(F.sum("n"))
    counts = np.zeros(2 * _SIZE * _SIZE, dtype=np.int64)
    for pair, n in found.collect():
        counts[pair] = n
    return Ratio(counts)


def _scan_batches(ratio, least: float, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ratio = ratio.value
        for part in T.slices(batches, "text"):
            spans, texts = [], []
            for t in part.column("text").to_pylist():
                own = base_spans(t)
                own = ordered(own + model.added(t, own, least))
                spans.append([{"kind": k, "start": a, "end": z} for k, a, z in own])
                if redact:
                    texts.append(without(t, own))
            columns = {n: part.column(n) for n in part.schema.names} | {"spans": pa.array(spans, type=part.schema.field("spans").type)}
            if redact:
                columns["text"] = pa.array(texts, pa.string())
            else:
                del columns["text"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return T.releasing(run)


def without(text: str, spans: list[Span], placeholder: str = PLACEHOLDER) -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at, end = [], 0, -1
    for _, a, z in spans:
        if a > end:
            if end >= 0:
                out.append(placeholder)
                at = end
            out.append(text[at:a])
            end = z
        end = max(end, z)
    return "".join([*out, placeholder, text[end:]]) if spans else text


def scan(docs: DataFrame, model: Ratio | None = None, least: float = LEAST_RATIO, redact: bool = False) -> DataFrame:
    """docs without its text (with the redacted text, if asked for) and with spans, by start, then kind as listed."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    source = docs.select(*[F.col(c) for c in docs.columns if c not in ("text", "spans")], F.coalesce("text", F.lit("")).alias("text"), F.array().cast(_SPANS).alias("spans"))
    schema = source.schema if redact else source.drop("text").schema
    return source.mapInArrow(_scan_batches(shared, least, redact), schema)


def report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = scan(docs.select("doc_id", "text"), **settings)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != MODEL_KIND)
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"))


def redacted(docs: DataFrame, size: str = "n_chars", **settings) -> DataFrame:
    """docs with every secret replaced in its text; null texts stay null, and the size column, if any, follows.

    A struct carries the columns, so their names may be any.
    """
    whole = docs.select("text", F.struct(*docs.columns).alias("row"))
    found = scan(whole, redact=True, **settings)
    hit = F.size("spans") > 0
    new = {"text": F.when(hit, F.col("text")).otherwise(F.col("row.text"))}
    if size in docs.columns:
        kind = docs.schema[size].dataType
        new[size] = F.when(hit, F.length("text").cast(kind)).otherwise(F.col(f"row.{size}"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
