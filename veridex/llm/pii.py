"""PII: fixed patterns, and a semi-Markov conditional random field for what no pattern fits.

The field scores whole candidate segments: a segment of up to `MAX_TOKENS` tokens has features of the span as a
whole (its shape, numbers of digits and of separators, checks, the word before it), and dynamic programming
over a run of tokens chooses boundaries and types together. Its weights are fitted by gradient ascent on the
likelihood of labelled runs of a bounded sample of documents: as they stand, labelled by the patterns, and again with
what the patterns found in a notation that they don't know (see `rewritten`), labelled alike. So the field learns
more than the patterns: telephone numbers without a plus sign, dotted card numbers, masked dots and at signs.

Only runs with a digit, an at sign or a written-out one can hold personal data, so tokens elsewhere are outside and
are never scored. A segment that the best path takes and that the field finds likely enough is added, if no base span
touches it. Whole runs are scored, however long; long ones a window at a time (see pii_runs), so memory holds a few bytes a token.

Nulls: a null text is empty. All columns but the text are carried by scan (one named spans gives way to the spans).
Repeated rows each get their result; an empty table gives an empty result. Without samples nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_runs
from . import text as T

KINDS = ("email", "ip", "card", "phone")
LEAST_PROBABILITY, SAMPLE_ROWS, SAMPLE_RUNS = 0.8, 5000, 2500
#: Tokens of an entity at most, tokens of a run that is used in training at most, bits of a weight's place.
MAX_TOKENS, TRAIN_TOKENS, WEIGHT_BITS = 16, 60, 14
#: Runs of more characters go through pii_runs, which finds the same.
LONG_RUN = 100

_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs, tried at their start alone, keep long runs without a match linear.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]
_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their at signs, so that long runs are read once."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AFTER_AT.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    """Four numbers at a time of each run of dotted numbers."""
    for run in _DOTTED.finditer(text):
        numbers, at = run[0].split("."), run.start()
        ends = np.cumsum([len(n) + 1 for n in numbers]) - 1
        for i in range(0, len(numbers) - 3, 4):
            if all(len(n.lstrip("0")) <= 3 and int(n[-3:]) <= 255 for n in numbers[i : i + 4]):
                yield "ip", at + int(ends[i]) - len(numbers[i]), at + int(ends[i + 3])


def base_spans(text: str) -> list[Span]:
    """Kind, start, end (code points, end exclusive), by kind as listed, then start."""
    out = list(emails(text)) if "@" in text else []
    out += ips(text)
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# tokens and runs

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_AT = r"(?:[0-9@]|\[at\]|\(at\))"
_PLAIN = r"[^\s0-9@\[(]*+(?:[\[(](?!at[\])])[^\s0-9@\[(]*+)*+"
_RUN = re.compile(rf"(?<!\S){_PLAIN}{_AT}\S*+(?:[ ]{_PLAIN}{_AT}\S*+)*")
_HOLDS = re.compile(_AT)
_MARK = re.compile(r"@|\[at\]|\(at\)")
_DOMAIN = re.compile(r"(?:@|\[at\]|\(at\))[A-Za-z0-9-]+(?:(?:\.|\[\.\]|\(\.\))[A-Za-z0-9-]+)+$")
Token = tuple[int, int]


def _word_before(text: str, at: int) -> str:
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:end].lower()


def runs(text: str) -> Iterator[tuple[int, str, str]]:
    """Start and text of each run of chunks, one blank apart, with digits or at signs, and the word before it."""
    for m in _RUN.finditer(text):
        yield m.start(), m[0], _word_before(text, m.start())


def tokens_of(run: str) -> list[Token]:
    return [t.span() for t in _TOKEN.finditer(run)]


def rewritten(kind: str, span: str, choice: int) -> str:
    """A span that a pattern found, in another notation."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        name, _, host = span.partition("@")
        if choice & 4:
            name = re.sub("[^A-Za-z]+", "", name) or name
        if choice & 8:
            host = ".".join(host.split(".")[-2:])
        return [f"{name}[at]{host}", f"{name}(at){host}", f"{name}@{host.replace('.', '[.]')}"][choice % 3]
    if kind == "ip":
        return span.replace(".", ["[.]", "(.)"][choice % 2])
    if kind == "card":
        return [".", "/", "_"][choice % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"1-{area}-{first}-{last}"][choice % 4] if len(digits) >= 10 else span


def spoiled(kind, span: str, choice: int) -> str:
    """Something like a span that a pattern found, in such a notation, but none of its kind."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        return re.sub(r"[^A-Za-z0-9]+", "/", span)
    if kind == "ip":
        return span.replace(".", "[.]") + "[.]7" if choice % 2 else span.rpartition(".")[0].replace(".", "[.]")
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + choice % 9) % 10)
        return [".", "/", "_"][choice % 3].join(wrong[i : i + 4] for i in range(0, len(wrong), 4))
    return [f"{digits[:3]}-{digits[3:4]}-{digits[4:9]}-{digits[-2:]}", f"{digits[-5:-2]}-{digits[-4:]}-{digits}", f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", f"{digits[:3]}.{digits[-2:]}"][choice % 4]


def _kind_of(c: str) -> str:
    return "9" if c in "0123456789" else "a" if c.isalpha() else " " if c.isspace() else c


def features(text: str, tokens: list[Token], i: int, j: int, before: str) -> list[str]:
    """What a segment of tokens i to j (exclusive) looks like as a whole."""
    start, end = tokens[i][0], tokens[j - 1][1]
    span = text[start:end]
    digits = [c for c in span if c in "0123456789"]
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", span))
    numbers = re.findall(r"[0-9]+", span)
    out = ["bias", f"shape={shape}", f"tokens={j - i}", f"first={shape[0]}", f"last={shape[-1]}", f"at={span.count('@')}", f"dots={min(span.count('.'), 4)}"]
    out += [f"digits={len(digits)}", f"numbers={min(len(numbers), 6)}", f"spaces={min(span.count(' '), 4)}", f"letters={any(c.isalpha() for c in span)}"]
    coarse = re.sub(r"w(?:[.-]w)*", "W", re.sub(r"[A-Za-z0-9]+", "w", span))
    out.append(f"coarse={coarse}")
    out.append(f"groups={[len(n) for n in numbers] if not any(c.isalpha() for c in span) else ''}")
    out.append(f"mark={len(_MARK.findall(span))}:{bool(_DOMAIN.search(span))}")
    out.append(f"octets={len(numbers) == 4 and all(len(n) < 4 and int(n) < 256 for n in numbers)}")
    out.append(f"luhn={16 <= len(digits) <= 19 and luhn(''.join(digits))}")
    out.append(f"left={_kind_of(text[start - 1]) if start else ''}:{shape[0]}")
    out.append(f"right={shape[-1]}:{_kind_of(text[end]) if end < len(text) else ''}")
    out.append(f"plus={'+' in span}:{len(digits)}")
    if i == 0 and before:
        out.append(f"before={before}")
    return out


def _places(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(n) & ((1 << WEIGHT_BITS) - 1) for n in names], dtype=np.int64)


def segments(text: str, tokens: list[Token], before: str) -> list[tuple[int, int, np.ndarray]]:
    """All candidate segments of a run: those of at most MAX_TOKENS tokens with a digit or an at sign, with places of their features."""
    out = []
    has = [text[a] in "0123456789@" or text[a:z] == "at" and _HOLDS.match(text, a - 1) is not None for a, z in tokens]
    for i in range(len(tokens)):
        seen = False
        for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
            seen = seen or has[j - 1]
            if seen and text[tokens[i][0]] not in ".,:;" and text[tokens[j - 1][0]] not in ".,:;":
                out.append((i, j, _places(features(text, tokens, i, j, before))))
    return out


class Field:
    """Weights by kind and feature. A token outside of segments scores 0."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), 1 << WEIGHT_BITS)) if weights is None else weights

    def scores(self, places: list[np.ndarray]) -> np.ndarray:
        """Segment x kind."""
        return np.array([self.weights[:, p].sum(axis=1) for p in places]).reshape(-1, len(KINDS))

    def sums(self, n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of all segmentations of the tokens before, and from, each boundary."""
        whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        ahead, back = np.zeros(n + 1), np.zeros(n + 1)
        ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for s, (i, j) in enumerate(spans):
            ending[j].append((i, whole[s]))
            starting[i].append((j, whole[s]))
        for t in range(1, n + 1):
            ahead[t] = np.logaddexp.reduce([ahead[t - 1], *(ahead[i] + w for i, w in ending[t])])
        for t in range(n - 1, -1, -1):
            back[t] = np.logaddexp.reduce([back[t + 1], *(back[j] + w for j, w in starting[t])])
        return ahead, back

    def probabilities(self, n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
        """Of each segment with each kind, over all segmentations."""
        if not spans:
            return scores
        ahead, back = self.sums(n, spans, scores)
        i, j = np.array(spans).T
        return np.exp(np.minimum(0.0, ahead[i][:, None] + scores + back[j][:, None] - ahead[n]))

    def best(self, n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
        """(segment, kind) of the best segmentation."""
        top, kind = (scores.max(axis=1), scores.argmax(axis=1)) if len(scores) else (np.zeros(0), np.zeros(0, int))
        ending = [[] for _ in range(n + 1)]
        for s, (_, j) in enumerate(spans):
            ending[j].append(s)
        value, last = [0.0] * (n + 1), [-1] * (n + 1)
        for t in range(1, n + 1):
            value[t] = value[t - 1]
            for s in ending[t]:
                if value[spans[s][0]] + top[s] > value[t]:
                    value[t], last[t] = value[spans[s][0]] + top[s], s
        out, t = [], n
        while t:
            if last[t] < 0:
                t -= 1
            else:
                out.append((last[t], int(kind[last[t]])))
                t = spans[last[t]][0]
        return out[::-1]

    def fit(self, samples: list[tuple[int, list[tuple[int, int]], list[np.ndarray], dict[int, int]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """samples: tokens, segments, places, and the kind of each true segment. Gradient ascent with per-weight rates."""
        squares = np.full_like(self.weights, 1e-6)
        for r in range(rounds):
            for at in np.random.default_rng(r).permutation(len(samples)):
                n, spans, places, truth = samples[at]
                p = self.probabilities(n, spans, self.scores(places))
                for s, k in truth.items():
                    p[s, k] -= 1.0
                for s in np.flatnonzero(np.abs(p).max(axis=1, initial=0) > 1e-3):
                    step = p[s][:, None] + decay * self.weights[:, places[s]]
                    squares[:, places[s]] += step**2
                    self.weights[:, places[s]] -= rate * step / np.sqrt(squares[:, places[s]])
        return self


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans cover, as disjoint stretches in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((a, z) for _, a, z in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def sample_of(text: str, before: str, base: list[Span]):
    """A run with its labels; None if a base span doesn't fall on its segments."""
    tokens = tokens_of(text)
    found = segments(text, tokens, before)
    by_place = {(tokens[i][0], tokens[j - 1][1]): s for s, (i, j, _) in enumerate(found)}
    truth, end = {}, -1
    for k, a, z in sorted(base, key=lambda x: (x[1], -x[2])):
        if a >= end:
            if (a, z) not in by_place:
                return None
            truth[by_place[a, z]] = KINDS.index(k)
            end = z
    return len(tokens), [(i, j) for i, j, _ in found], [p for _, _, p in found], truth


def samples_of(run: str, before: str) -> Iterator[tuple]:
    """A run as the patterns label it, with what they found in other notations, and with such as is no such thing."""
    base, end = [], -1
    for k, a, z in sorted(base_spans(run), key=lambda x: (x[1], -x[2])):
        if a >= end:
            base.append((k, a, z))
            end = z
    if s := sample_of(run, before, base):
        yield s
    for i in range(4 if base else 0):
        out, spans, at, choice = "", [], 0, xxhash.xxh32_intdigest(run) + i
        for k, a, z in base:
            out += run[at:a]
            new = rewritten(k, run[a:z], choice) if i % 2 else spoiled(k, run[a:z], choice >> 1)
            if i % 2:
                spans.append((k, len(out), len(out) + len(new)))
            out, at = out + new, z
        if s := sample_of(out + run[at:], before, spans):
            yield s


@lru_cache(100_000)
def _place(name: str) -> int:
    return int(_places([name])[0])


def candidates(run: str, before: str, field: Field, least: float) -> list[Span]:
    """Segments of the best path of a run that are likely enough."""
    if len(run) > LONG_RUN:
        long = pii_runs.Run(run, before, field, len(KINDS), MAX_TOKENS, _place, luhn, _kind_of)
        return [(KINDS[k], a, z) for k, a, z in pii_runs.likely(long, least)]
    tokens = tokens_of(run)
    found = segments(run, tokens, before)
    spans, scores = [(i, j) for i, j, _ in found], field.scores([p for _, _, p in found])
    path = field.best(len(tokens), spans, scores)
    if not path:
        return []
    p = field.probabilities(len(tokens), spans, scores)
    return [(KINDS[k], tokens[spans[s][0]][0], tokens[spans[s][1] - 1][1]) for s, k in path if p[s, k] >= least]


def added(text: str, base: list[Span], find) -> list[Span]:
    """What find(run, word before) gives for the runs of the text, where it touches no base span."""
    out, taken = [], merged(base)
    starts = [a for a, _ in taken]
    for at, run, before in runs(text):
        end = at + len(run)
        near = [x for x in taken[max(0, bisect_right(starts, at) - 1) : bisect_left(starts, end)] if x[1] > at]
        if near and all(any(a <= at + m.start() and at + m.end() <= z for a, z in near) for m in _HOLDS.finditer(run)):
            continue  # every segment would touch the base
        for k, a, z in find(run, before):
            if all(at + z <= x or y <= at + a for x, y in near):
                out.append((k, at + a, at + z))
    return out


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with the word before them."""
    for part in T.slices(batches, "text"):
        rows = [(run, before) for t in part.column("text").to_pylist() for _, run, before in runs(t) if len(_TOKEN.findall(run)) <= TRAIN_TOKENS]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["run", "before"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_runs: int = SAMPLE_RUNS) -> Field:
    """Fit on at most sample_runs different runs of about sample_rows documents, chosen by hashes of their text."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike("[0-9@]"))
    total = texts.count()
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = texts.where(u < min(1.0, sample_rows / max(total, 1))).mapInArrow(_sample_batches, "run string, before string").distinct()
    rows = found.orderBy(F.xxhash64("run"), "run", "before").limit(sample_runs).collect()
    return Field().fit([s for run, before in rows for s in samples_of(run, before)])


def _scan_batches(field, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = field.value
        often = lru_cache(20_000)(lambda r, before: candidates(r, before, model, least))
        find = lambda r, before: often(r, before) if len(r) <= 100 else candidates(r, before, model, least)  # noqa: E731  results don't depend on it
        for part in T.slices(batches, "text"):
            spans = []
            for t in part.column("text").to_pylist():
                base = base_spans(t)
                own = [(*x, True) for x in base] + [(*x, False) for x in added(t, base, find)]
                own.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                spans.append([{"kind": k, "start": a, "end": z, "base": known} for k, a, z, known in own])
            columns = {n: part.column(n) for n in part.schema.names if n != "text"}
            columns["spans"] = pa.array(spans, type=part.schema.field("spans").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return T.releasing(run)


def scan(docs: DataFrame, model: Field | None = None, least: float = LEAST_PROBABILITY) -> DataFrame:
    """docs without its text and with spans, by kind as listed, then start; base tells what the patterns found."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    source = docs.select(*[F.col(c) for c in docs.columns if c not in ("text", "spans")], F.coalesce("text", F.lit("")).alias("text"), F.array().cast(_SPANS).alias("spans"))
    return source.mapInArrow(_scan_batches(shared, least), source.drop("text").schema)


def report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = scan(docs.select("doc_id", "text"), **settings)
    of = lambda k: F.size(F.filter("spans", lambda s: (s["kind"] == k) & s["base"])).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"))
