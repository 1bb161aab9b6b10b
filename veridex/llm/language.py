"""Language ID for mixed-language text.

A word's script narrows its candidate languages; its score in each candidate is the naive Bayes log-likelihood
of its letter grams. Viterbi over the words, with a penalty for each switch, labels spans, and the language
whose spans hold most letters is the document's.

The classifier is fitted on a bounded sample: of each language about `sample_rows` labelled documents (all, if
there are fewer), chosen by a hash of doc_id; whole texts. Scores are computed for every word of every text.

A path that switches pays the penalty for each switch. One language is the best path if against it no stretch of
words gains more than the penalty, nor a first and a last stretch together, which have one switch less than there
are stretches; words are walked one by one only in texts where a switch could pay.

Nulls: a null text, or one without a letter, is `und` with score 0; rows with null text or language don't train;
a row with null doc_id is predicted but never learned from. Without any labelled row all texts are `und`. Repeated rows each
get their prediction; an empty table gives an empty result. Texts of any length are read whole. identify returns its own columns
alone; accepted carries all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

UNDETERMINED = "und"
SAMPLE_ROWS, SWITCH_PENALTY, ORDERS, BUCKET_BITS = 1000, 12.0, (1, 2, 3, 4), 14
#: A language is a candidate for a script that at least this share of its letters has.
SCRIPT_SHARE = 0.005
_SMOOTHING = 0.5

# First code points of script ranges (Unicode blocks), in order.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([s for s, _ in SCRIPT_STARTS], dtype=np.uint32)
_NUMBER = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS], dtype=np.int64)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point of the first planes, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x30000)]))
    return _LETTER[0]


def _word_grams(texts: list[str]):
    """Code points of all texts; places of letters (plus one), the first letter and text of each word, gram buckets."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = np.zeros(len(points) + 2, dtype=bool)
    is_letter[1:-1] = _letters()[np.minimum(points, 0x2FFFF)]
    at = np.flatnonzero(is_letter)
    c = np.zeros(len(points) + 2, dtype=T.U)
    c[at] = points[at - 1]  # all else is 0, a word's border
    starts = np.flatnonzero(~is_letter[at - 1]) if len(at) else np.zeros(0, np.int64)
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), at[starts] - 1, side="right")
    h = c[at]
    grams = [_bucket(h, 0)]
    ended = np.zeros(len(at), dtype=bool)
    for order in range(1, len(ORDERS)):  # the letters before, up to the word's border
        before = np.where(ended, T.U(0), c[np.maximum(at - order, 0)])
        ended = before == 0
        h = h * T._M1 + before + T.U(1)
        grams.append(_bucket(h, order))
    return points, at, starts, row, grams


def _bucket(h: np.ndarray, order: int) -> np.ndarray:
    return (T.mixed(h * T._M2) >> T.U(64 - BUCKET_BITS)).astype(np.int64) + (order << BUCKET_BITS)


def _scripts(points: np.ndarray) -> np.ndarray:
    return _NUMBER[np.searchsorted(_STARTS, points, side="right") - 1]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: how often each gram bucket and each script occurs."""
    width = len(ORDERS) << BUCKET_BITS
    counts: dict[str, np.ndarray] = {}
    for part in T.slices(batches, "text", 1 << 20):
        langs = part.column("lang").to_pylist()
        texts = part.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = counts.setdefault(lang, np.zeros(width + len(SCRIPTS), dtype=np.int64))
            points, at, _, _, grams = _word_grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
            for g in grams:
                own[:width] += np.bincount(g, minlength=width)
            own[width:] += np.bincount(_scripts(points[at - 1]), minlength=len(SCRIPTS))
    names = sorted(counts)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[n].tobytes() for n in names], pa.binary())], names=["lang", "counts"])


class Model:
    """Log-likelihoods of gram buckets by language, and the languages of each script."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        width = len(ORDERS) << BUCKET_BITS
        table = np.array([counts[x] for x in self.langs], dtype=np.float64).reshape(len(self.langs), width + len(SCRIPTS))
        grams = table[:, :width].reshape(len(self.langs), len(ORDERS), 1 << BUCKET_BITS) + _SMOOTHING
        logs = np.log(grams / grams.sum(axis=2, keepdims=True)) / len(ORDERS)
        self.scores = np.ascontiguousarray(logs.reshape(len(self.langs), width).T).astype(np.float32)
        scripts = table[:, width:]
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.candidates = (share >= SCRIPT_SHARE).T  # script x language


def training_rows(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About sample_rows documents of each language; all of a language that has fewer."""
    labelled = docs.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = labelled.groupBy("lang").count().collect()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for r in totals:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample_rows / r["count"]))).otherwise(share)
    return labelled.where(u < share).select("doc_id", "lang", "text")


def train(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of the rows for which learn holds. Only one table of counts a language reaches the driver."""
    rows = training_rows(docs, learn, sample_rows).select("lang", "text").repartition("lang").mapInArrow(_count_batches, "lang string, counts binary")
    counts: dict[str, np.ndarray] = {}
    for r in rows.collect():
        own = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
        counts[r["lang"]] = counts[r["lang"]] + own if r["lang"] in counts else own
    return Model(counts)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word (rows of scores) on the path of most score less penalty for each switch."""
    total = scores.sum(axis=0)
    one = int(np.argmax(total))
    gains = np.cumsum(scores - scores[:, one : one + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gains[:-1]]), axis=0)
    last = (gains[-1] - np.minimum(low[-1], gains[-1])).max()
    if (gains - low).max(initial=0.0) <= penalty and max(gains.max(), 0.0) + last <= penalty:
        return np.full(len(scores), one)
    value, back = scores[0].tolist(), []
    span = range(scores.shape[1])
    for s in scores[1:].tolist():
        top = max(span, key=value.__getitem__)
        floor = value[top] - penalty
        back.append([k if value[k] >= floor else top for k in span])
        value = [s[k] + (value[k] if value[k] >= floor else floor) for k in span]
    path = [max(span, key=value.__getitem__)]
    for b in reversed(back):
        path.append(b[path[-1]])
    return np.array(path[::-1])


def label_words(texts: list[str], model: Model, penalty: float):
    """For all words of all texts: row, first letter and number of letters, and language (index)."""
    points, at, starts, row, grams = _word_grams(texts)
    lengths = np.diff(np.r_[starts, len(at)])
    if not len(starts):
        return row, at, starts, lengths, np.zeros(0, np.int64)
    sums = model.scores[grams[0]]
    for g in grams[1:]:
        sums += model.scores[g]
    word = np.add.reduceat(sums, starts, axis=0)
    allowed = model.candidates[_scripts(points[at[starts] - 1])]
    known = allowed.any(axis=1)
    word = np.where(allowed | ~known[:, None], word, np.float32(-1e4))
    word[~known] = 0.0  # of a script that no language has: no word for any
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    labels = np.zeros(len(starts), dtype=np.int64)
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if z > a:
            labels[a:z] = best_path(word[a:z], penalty)
    return row, at, starts, lengths, labels


def _predict_batches(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        k = len(m.langs)
        for part in T.slices(batches, "text", max(1 << 15, (1 << 21) // max(k, 4))):
            pred, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
            if k:
                row, _, _, lengths, labels = label_words(part.column("text").to_pylist(), m, penalty)
                letters = np.bincount(row * k + labels, weights=lengths, minlength=part.num_rows * k).reshape(-1, k)
                total = letters.sum(axis=1)
                best = letters.argmax(axis=1)
                for i in np.flatnonzero(total):
                    pred[i] = m.langs[best[i]]
                    score[i] = letters[i, best[i]] / total[i]
            columns = {n: part.column(n) for n in part.schema.names} | {"lang_pred": pa.array(pred), "score": pa.array(score)}
            del columns["text"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return T.releasing(run)


def predict(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, lang_pred, score): score is the share of the letters that lie in spans of the predicted language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = source.drop("text").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return source.mapInArrow(_predict_batches(shared, penalty), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learning from the documents that aren't held out."""
    model = train(docs, ~held_out(), sample_rows)
    return predict(docs, model, penalty).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.5, **settings) -> DataFrame:
    """The documents with a language that holds at least least_score of their letters, as they came."""
    model = train(docs, ~held_out(), **settings)
    whole = docs.select("text", F.struct(*docs.columns).alias("row"))
    found = predict(whole, model, keep=("row",))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")
