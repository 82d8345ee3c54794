"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of all vote patterns estimates how often each labeller votes so on good and on bad
documents, without any true label. The posterior of a document's pattern is its soft label. These
labels train a linear scorer over hashed character-shape trigrams, which also tells apart documents
that no labeller speaks on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitab.llm.common import bounded_batches, pieces, texts_of

DIMENSIONS = 1 << 12
#: Distinct texts that the scorer is trained on, those with the smallest hashes; votes are counted over all.
TRAIN_ROWS = 5_000
GOOD, NONE, BAD = 2, 1, 0
_LETTER = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57
                else 32 if b in b" \t\n\r\v\f" else b for b in range(256))
_SPACE = re.compile(rb" +")
_ALONE = re.compile(rb"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")
_SIGNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")


def statistics(text: str) -> dict[str, float]:
    raw = text.encode("utf-8", "surrogatepass")
    shape = raw.translate(_LETTER)
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = shape.count(b"A"), shape.count(b"a")
    visible = max(1, len(shape) - shape.count(b" "))
    return {"words": len(words), "length": (upper + lower) / max(1, len(words)), "upper": upper / max(1, upper + lower),
            "symbols": 1 - (upper + lower + shape.count(b"0")) / visible, "distinct": len(set(words)) / max(1, len(words)),
            "lines": len(set(lines)) / max(1, len(lines)),
            "sentences": sum(w[-1:] in b".!?" for w in words) / max(1, len(words)), 
            "signs": len(_ALONE.findall(raw)) / max(1, len(words)), "runs": len(_SIGNS.findall(raw)) / max(1, len(words))}


def vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Labellers by name; each sees the statistics of a text.
LABELLERS = {
    "words": lambda s: vote(False, s["words"] < 5),
    "length": lambda s: vote(False, not 2 <= s["length"] <= 14),
    "upper": lambda s: vote(False, s["upper"] > 0.5),
    "symbols": lambda s: vote(s["symbols"] < 0.05, s["symbols"] > 0.1),
    "runs": lambda s: vote(s["runs"] < 0.01, s["runs"] > 0.1),
    "signs": lambda s: vote(s["signs"] < 0.02, s["signs"] > 0.1),
    "lines": lambda s: vote(False, s["lines"] < 0.7),
    "repeats": lambda s: vote(s["distinct"] > 0.5, s["distinct"] < 0.35),
    "sentences": lambda s: vote(0.02 <= s["sentences"] <= 0.3, s["sentences"] > 0.5 or s["words"] > 60 and s["sentences"] == 0),
}
#: Votes (bad, none, good) on bad and on good documents before the first round, and how much they
#: weigh against the counts, as a share of all documents.
EXPECTED = ((0.4, 0.4, 0.2), (0.02, 0.4, 0.58))
WEIGHT = 0.02


def votes_of(text: str, labellers=None) -> int:
    """All votes as one number in base 3."""
    s, code = statistics(text), 0
    for f in (labellers or LABELLERS).values():
        code = code * 3 + f(s)
    return code


def digits(codes: np.ndarray, k: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """Share of good documents, and P(vote | bad or good) of each labeller, (labellers, 2, 3)."""
    n, k = votes.shape
    expected = np.array(EXPECTED)
    p = np.tile(expected, (k, 1, 1))
    prior = 0.8
    for _ in range(rounds):
        post = posterior(votes, prior, p)
        w = np.stack([(1 - post) * counts, post * counts])
        for j in range(k):
            for c in (0, 1):
                p[j, c] = np.bincount(votes[:, j], w[c], minlength=3) + expected[c] * (WEIGHT * counts.sum() + 1)
                p[j, c] /= p[j, c].sum()
        new = (w[1].sum() + 1) / (w.sum() + 2)
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return prior, p


def posterior(votes: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    """P(good | votes)."""
    j = np.arange(votes.shape[1])
    odds = np.log(prior) - np.log1p(-prior) + (np.log(p[j, 1, votes]) - np.log(p[j, 0, votes])).sum(axis=1)
    return 1 / (1 + np.exp(-odds))


def features(texts: list[str]) -> np.ndarray:
    """Shares of hashed trigrams of character shapes, square roots, (texts, DIMENSIONS)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(_SPACE.sub(b" ", t.encode("utf-8", "surrogatepass").translate(_LETTER)), np.uint8).astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(20)
            out[i] = np.sqrt(np.bincount(h, minlength=DIMENSIONS) / len(h))
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full gradients with adaptive steps."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    y = y.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        e = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        g = np.append(e @ x / len(y) + ridge * w[:-1], e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * m / (1 - 0.9 ** t) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, ``votes`` (by labeller, 2 good, 1 none, 0 bad),
    ``weak_label`` (posterior), ``score`` (of the linear scorer, 0 to 1) and ``good`` (0.5 or more).

    Null text is empty; an empty text gets the score of the intercept. Vote patterns of all rows are
    counted; there are at most 3 to the number of labellers. The scorer alone is fitted on a sample:
    the ``train_rows`` distinct texts with the smallest hashes, each once, in the order of their
    hashes, so the order of rows changes nothing. Repeated rows each count as votes and each give a
    row. Texts of any length are read as a whole; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def count(batches):
        for batch in pieces(batches, 0):
            codes, n = np.unique(np.array([votes_of(t) for t in texts_of(batch.column(0))], np.int64), return_counts=True)
            yield pa.record_batch({"code": pa.array(codes), "n": pa.array(n)})

    patterns = d.select("t").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, counts = patterns["code"].to_numpy(), patterns["n"].to_numpy()
    k = len(LABELLERS)
    if not len(codes):
        codes, counts = np.array([(3 ** k - 1) // 2]), np.array([1])
    prior, p = expectation_maximisation(digits(codes, k), counts)
    # Hashes are counted before their shuffle, so a frequent text is one row a task.
    hashes = d.select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(train_rows)
    last = hashes.agg(F.max("h")).first()[0]
    under = d.select("t", F.xxhash64("t").alias("h")).filter(F.col("h") <= F.lit(last).cast("long"))
    sample = under.groupBy("h", "t").agg(F.count("*").alias("n")).orderBy("h", "t")

    def describe(batches):
        for batch in pieces(batches, 0):
            texts = texts_of(batch.column(0))
            x = features(texts)
            rows = [np.flatnonzero(r) for r in x]
            yield pa.record_batch({"code": pa.array([votes_of(t) for t in texts], pa.int64()),
                                   "at": pa.array([r.tolist() for r in rows], pa.list_(pa.int32())),
                                   "value": pa.array([x[i, r].tolist() for i, r in enumerate(rows)], pa.list_(pa.float32()))})

    rows = sample.select("t").mapInArrow(describe, "code long, at array<int>, value array<float>").toArrow()
    x = np.zeros((max(1, len(rows)), DIMENSIONS), np.float32)
    for i, (at, value) in enumerate(zip(rows["at"].to_pylist(), rows["value"].to_pylist())):
        x[i, at] = value
    y = posterior(digits(rows["code"].to_numpy(), k), prior, p) if len(rows) else np.array([prior])
    sent = spark.sparkContext.broadcast((prior, p, *train(x, y)))
    votes = T.ArrayType(T.IntegerType())
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("votes", votes), T.StructField("weak_label", T.DoubleType()),
                         T.StructField("score", T.DoubleType()), T.StructField("good", T.BooleanType())])

    def run(batches):
        prior, p, w, b = sent.value
        for batch in pieces(batches, 1):
            texts = texts_of(batch.column(1))
            v = digits(np.array([votes_of(t) for t in texts], np.int64), k)
            score = 1 / (1 + np.exp(-(features(texts) @ w + b).astype(float)))
            yield pa.record_batch([batch.column(0), pa.array(v.tolist(), pa.list_(pa.int32())), pa.array(posterior(v, prior, p)),
                                   pa.array(score), pa.array(score >= 0.5)], names=kind.names)

    return d.mapInArrow(run, kind).withColumnRenamed("id", id_col)
