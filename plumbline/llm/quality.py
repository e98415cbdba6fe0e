"""Quality rules and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to buckets.  One multinomial is counted over the trusted documents, one over
the whole corpus; a document's score is the mean log ratio of its n-grams.  The threshold is a low quantile of
the scores of trusted documents that took no part in the counts, and holds for every document alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import hashing
from plumbline.llm.common import schema_with, slices

#: Buckets of the n-gram hash: the size of the model, whatever the corpus.
BUCKETS = 1 << 16
#: One trusted document in so many sets the threshold instead of the counts; the share of those it may refuse.
HELD_OUT, REFUSED = 4, 0.002
PRIOR = 1.0
# fixed values of the base rules
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 10, 5, 20
_BLANK = b" \t\n\r\x0b\x0c"
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(_BLANK)] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    threshold: float


def _buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    owner, _, _, value, _ = hashing.words([(t or "").encode() for t in texts])
    pair_owner, pair = hashing.grams(owner, value, 2)
    both = np.concatenate([value, hashing.mix(pair ^ np.uint64(1))])
    return np.concatenate([owner, pair_owner]), (both >> np.uint64(48)).astype(np.int64)


def _scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    owner, bucket = _buckets(texts)
    count = np.bincount(owner, minlength=len(texts))
    return np.bincount(owner, weights[bucket], minlength=len(texts)) / np.maximum(count, 1)


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of all documents whose labels all say good and not toxic; `held` marks those that set the threshold."""
    good = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.where("q = 1 and t = 0").select(F.col(key), (F.pmod(F.xxhash64(key), F.lit(HELD_OUT)) == 0).alias("held"))


def _trusted(docs: DataFrame, labels: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    """Texts of the trusted documents of one part.  The part is told by the id, so only the texts of that part are shuffled; the ids
    are as many as the labels, so they are not broadcast."""
    return docs.select(key, text).join(trusted_ids(labels, key).where(F.col("held") == held).hint("merge"), key).select(text)


def count(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Counts per bucket, over the corpus and over the trusted documents of the fit part."""
    target = _trusted(docs, labels, key, text, F.lit(False)).withColumn("target", F.lit(True))
    marked = docs.select(text, F.lit(False).alias("target")).unionByName(target)

    def run(batches):
        whole, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in slices(batches, text):
            owner, bucket = _buckets(part.column(0).to_pylist())
            chosen = part.column(1).to_numpy(zero_copy_only=False)
            whole += np.bincount(bucket[~chosen[owner]], minlength=BUCKETS)
            target += np.bincount(bucket[chosen[owner]], minlength=BUCKETS)
        used = np.flatnonzero(whole + target)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(whole[used]), pa.array(target[used])], ["bucket", "whole", "target"])

    counted = marked.mapInArrow(run, "bucket long, whole long, target long").groupBy("bucket").agg(F.sum("whole").alias("whole"), F.sum("target").alias("target"))
    out = np.zeros((2, BUCKETS))
    for row in counted.collect():  # one row per bucket
        out[:, row["bucket"]] = row["whole"], row["target"]
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of a corpus.  Without trusted documents every weight is 0 and nothing is refused."""
    whole, target = count(docs, labels, key, text)
    if not target.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    weights = np.log((target + PRIOR) / (target.sum() + PRIOR * BUCKETS)) - np.log((whole + PRIOR) / (whole.sum() + PRIOR * BUCKETS))
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    held = _trusted(docs, labels, key, text, F.lit(True))

    def run(batches):
        for part in slices(batches, text):
            texts = part.column(0).to_pylist()
            enough = np.array([len((t or "").encode().split()) >= LEAST_WORDS for t in texts], bool)
            yield pa.RecordBatch.from_arrays([pa.array(_scores(texts, shipped.value)[enough])], ["score"])

    low = held.mapInArrow(run, "score double").agg(F.percentile("score", REFUSED)).first()[0]
    return Model(weights, -np.inf if low is None else float(low))


def _base(texts: list[str | None]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    owner, _, _, value, _ = hashing.words(raw)
    n_words = np.bincount(owner, minlength=n)
    chars = np.array([len(t or "") - sum(map(r.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))) for t, r in zip(texts, raw, strict=True)], np.int64)
    symbols = np.array([sum(r.count(s) for s in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))) for r in raw], np.int64)
    repeated_lines = np.zeros(n, np.int64)
    for i, r in enumerate(raw):
        lines = [x for x in r.split(b"\n") if x.strip(_BLANK)]
        repeated_lines[i] = len(lines) - len(set(lines))
    # words inside windows that occur twice or more in their text
    w = REPEAT_WINDOW
    covered = np.zeros(len(owner) + 1, np.int64)
    at = np.flatnonzero(owner[: max(len(owner) - w + 1, 0)] == owner[w - 1 :]) if len(owner) >= w else np.zeros(0, np.int64)
    gram_owner, held = hashing.grams(owner, value, w)
    order = np.lexsort((held, gram_owner))
    same = (held[order][1:] == held[order][:-1]) & (gram_owner[order][1:] == gram_owner[order][:-1])
    twice = np.zeros(len(held), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + w, -1)
    repeats = np.bincount(owner, np.cumsum(covered)[:-1] > 0, minlength=n).astype(np.int64)
    return [n_words, chars, symbols, repeated_lines, repeats]


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add the base counts, score, base_failed and kept to every row.

    A null text has no words: all counts are 0 and it fails the base rules, as does an empty one.  Lines are
    cut at \\n and count when they hold a word.  Repeated rows are judged alike.  Columns that bear the name of
    an added one are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model.weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for part in slices(batches, text):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            counts = [pa.array(x, pa.int64()) for x in _base(texts)]
            yield pa.RecordBatch.from_arrays([*part.columns, *counts, pa.array(_scores(texts, shipped.value))], [*part.schema.names, *names, "score"])

    docs = docs.drop(*names, "score", "base_failed", "kept")
    judged = docs.mapInArrow(run, schema_with(docs, (), ", ".join(f"{c} long" for c in names) + ", score double"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(model.threshold)))
