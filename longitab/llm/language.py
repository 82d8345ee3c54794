"""Language identification of mixed text.

Learning counts hashed byte trigrams of words, and script ranges of letters, for each language.
A word's script leaves the languages that are written in it; each of those scores the word by its
trigrams. A Viterbi path over the words, with a penalty for every switch, labels spans; the
language of a text is the one with the most letters on the path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitab.llm.common import bounded_batches, pieces, texts_of

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: The model has ``languages * BUCKETS`` numbers and goes to every task; more languages raise.
MAX_LANGUAGES = 256
#: Log odds that one switch of language costs.
SWITCH = 12.0
#: Share of a language's letters that a script needs to be one of its scripts.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.1
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: First code points of script ranges and the script from there on (fixed values).
SCRIPTS = ((0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
           (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
           (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
           (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
           (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
           (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"),
           (0x3130, "Hangul"), (0x3190, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"),
           (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
           (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
           (0x10000, "Other"), (0x20000, "Han"))
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([first for first, _ in SCRIPTS])
_NUMBER = np.array([NAMES.index(name) for _, name in SCRIPTS])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    score: np.ndarray    # log share of each trigram bucket, (buckets, languages)
    scripts: np.ndarray  # whether a language is written in a script, (scripts, languages)


def words_of(text: str) -> list[str]:
    """Runs of letters. A run of other numerals without a letter is not a word."""
    words = _WORD.findall(text)
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all words, spaces at both ends of each, and where each word's begin."""
    raw = [w.lower().encode("utf-8", "surrogatepass") for w in words]
    b = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).astype(np.uint32)
    tri = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)
    starts = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])[:-1]))
    keep = np.ones(len(tri), bool)
    keep[starts[1:] - 1] = False  # around the space between two words
    return tri[keep], starts - np.arange(len(starts))


def scripts_of(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first character."""
    return _NUMBER[np.searchsorted(_FIRST, np.array([ord(w[0]) for w in words]), "right") - 1]


def in_training(id_col: str) -> Column:
    """Documents to learn from: crc32 of the id as text, mod 4, is not 2. A null id is one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(True))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows of ``docs`` with a language, added up before their shuffle.

    At most ``MAX_LANGUAGES * (BUCKETS + scripts)`` sums reach the driver. Rows with a null
    language or without letters teach nothing; an empty table gives a model without languages.
    """
    bounded_batches(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, 0):
            by: dict[str, list[str]] = {}
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                by.setdefault(lang, []).extend(words_of(text))
            for lang, words in by.items():
                if words:
                    if len(sums) >= MAX_LANGUAGES and lang not in sums:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    s = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    s[:BUCKETS] += np.bincount(buckets_of(words)[0], minlength=BUCKETS)
                    s[BUCKETS:] += np.bincount(scripts_of(words), minlength=len(NAMES))
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()),
                                   "n": pa.array(s[at], pa.int64())})

    known = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter("l IS NOT NULL")
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    limit = MAX_LANGUAGES * (BUCKETS + len(NAMES))
    rows = sums.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((BUCKETS + len(NAMES), len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    counts[rows["bucket"].to_numpy(), np.array([place[x] for x in rows["lang"].to_pylist()], int)] = rows["n"].to_numpy()
    tri, scripts = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS:]
    return Model(languages, np.log(tri / tri.sum(axis=0)).astype(np.float32), scripts >= SCRIPT_SHARE * scripts.sum(axis=0))


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log score of each word for each language, less the best; a language not written in the
    word's script gets the score of one more switch unless no language is."""
    tri, starts = buckets_of(words)
    score = np.add.reduceat(model.score[tri], starts, axis=0)
    allowed = model.scripts[scripts_of(words)]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    score -= np.where(allowed, score, -np.inf).max(axis=1, keepdims=True)
    return np.where(allowed, np.maximum(score, -4 * SWITCH), -4 * SWITCH).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language number of every word; ``scores`` holds the texts' words one after another. All
    texts take one step together, so there are as many steps as the longest text has words."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    n, k = len(scores), scores.shape[1]
    came = np.zeros((n, k), np.uint8)
    path = np.zeros(n, np.int16)
    if not n:
        return path
    desc = lengths[order]
    active = len(desc) - np.searchsorted(desc[::-1], np.arange(1, desc[0] + 1), "left")  # texts with a word at each step
    best = np.zeros((len(desc), k), np.float32)
    for t, m in enumerate(active):
        v = best[:m]
        if t:
            top = v.argmax(axis=1)
            away = v[np.arange(m), top] - switch
            stay = v >= away[:, None]
            came[begin[:m] + t] = np.where(stay, np.arange(k), top[:, None])
            v = np.where(stay, v, away[:, None])
        best[:m] = v + scores[begin[:m] + t]
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        path[at] = now[:m]
        now[:m] = came[at, now[:m]] if t else now[:m]
    return path


def spans_of(text: str, path: np.ndarray, languages: list[str]) -> list[dict]:
    """Code points [begin, end) of runs of words with one language."""
    out: list[dict] = []
    words = (m for m in _WORD.finditer(text) if any(map(str.isalpha, m[0])))
    for m, i in zip(words, path.tolist()):
        if out and out[-1]["lang"] == languages[i]:
            out[-1]["end"] = m.end()
        else:
            out.append({"begin": m.start(), "end": m.end(), "lang": languages[i]})
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH,
             with_spans: bool = True) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``lang_pred``, ``score`` and ``spans``.

    ``score`` is the share of the letters that the path gives to ``lang_pred``; ties go to the
    smaller name. Null and empty texts, texts without a letter, and any text under a model without
    languages are ``und`` with score 0 and no spans. Whole texts are labelled. Columns of ``docs``
    may have any names, since they travel inside ``row``.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.languages, model.score, model.scripts))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        m = Model(*sent.value)
        for batch in pieces(batches, 1, 4 << 20):
            texts = texts_of(batch.column(1))
            cut = [words_of(t) if m.languages else [] for t in texts]
            lengths = np.array([len(c) for c in cut], np.int64)
            number = {w: i for i, w in enumerate(dict.fromkeys(w for c in cut for w in c))}
            words = list(number)
            at = np.fromiter((number[w] for c in cut for w in c), np.int64, lengths.sum())
            path = viterbi(word_scores(words, m)[at], lengths, switch) if words else np.zeros(0, np.int16)
            letters = np.array([len(w) for w in words], np.int64)[at] if words else np.zeros(0, np.int64)
            ends = np.cumsum(lengths)
            pred, score, spans = [], [], []
            for text, end, n in zip(texts, ends, lengths):
                if not n:
                    pred.append(UNDETERMINED), score.append(0.0), spans.append([])
                    continue
                own = path[end - n:end]
                share = np.bincount(own, letters[end - n:end], minlength=len(m.languages))
                pred.append(m.languages[int(share.argmax())])
                score.append(float(share.max() / share.sum()))
                spans.append(spans_of(text, own, m.languages) if with_spans else [])
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)],
                                  names=["row", "lang_pred", "score", "spans"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    found = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<begin: long, end: long, lang: string>>")
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *found]))
