"""Toxicity by compression distance: which of two zstandard dictionaries makes a text's windows shorter.

zstandard trains one dictionary on toxic and one on ordinary text of a bounded labelled sample, in rounds. At first
the toxic one is trained on words of toxic documents that the ordinary one compresses badly. Each round then trains
the ordinary one further on what the toxic one compresses better in ordinary text, and the toxic one anew on what it
still compresses better in toxic text. What both kinds of text share so ends in the ordinary dictionary, and the
lengths of a window under the two differ where it holds what only toxic text has.

Words go into training as often as documents of the sample hold them, copies once. A part of the sample is left out
of the dictionaries, and a logistic curve over the differences of its windows calibrates the score.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, each, split_words

#: Labelled documents of each class in the sample, chosen by hash of their id; of four parts one calibrates.
SAMPLE_TOXIC, SAMPLE_ORDINARY, PARTS = 1_500, 3_000, 4
#: Distinct words of the sample that train the dictionaries, the commonest first; and how often a word is given at most.
WORDS, MOST, MOST_FIRST = 300_000, 60, 8
#: Words of a window.
WINDOW = 4
#: Bytes of the ordinary dictionary at first, of what a round adds to it, of all of it, and of the toxic one; and rounds.
FIRST_BYTES, MORE_BYTES, ORDINARY_BYTES, TOXIC_BYTES, ROUNDS = 32_768, 4_096, 65_536, 8_192, 6
#: Share of toxic text that the first round takes, that which compresses worst.
FIRST_SHARE = 0.2
#: Words that a dictionary is trained on at least.
LEAST = 100
#: Stands around each word, in windows and dictionaries. With it the start of a word is long enough for a match (MATCH bytes),
#: while four bytes within a word are not.
MARK, MATCH = b"\x01\x02", 6
#: Stands at each window's end and in both dictionaries: the compressor looks for no match in the last bytes of its input.
TAIL = b"<~0123456789~ABCDEFGHIJKLMNOPQRSTUVWXYZ~>"
THRESHOLD = 0.3
FEATURES = 5


@dataclass(frozen=True)
class Model:
    """What the executors need: two dictionaries' contents and the logistic curve (under 80 kilobytes)."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # the last one is the intercept


def _marked(w: list[bytes]) -> bytes:
    return MARK + MARK.join(w) + MARK


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=15, hash_log=15, search_log=5, min_match=MATCH, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Distance:
    """Features of a text from the differences of its windows' compressed lengths."""

    def __init__(self, model: Model):
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic + model.ordinary)

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        short, long = self.toxic.compress, self.ordinary.compress
        return np.fromiter((len(long(x)) - len(short(x)) for x in windows), float, len(windows))

    def features(self, text: str | None) -> list[float]:
        w = split_words(text)
        if not w:
            return [0.0] * FEATURES
        d = np.sort(self.gains([_marked(w[i : i + WINDOW]) + TAIL for i in range(0, len(w), WINDOW)]))[::-1]
        return [float(d[0]), float(d[:3].sum() / 3), float(d.mean()), float((d >= 2).mean()), math.log1p(float((d >= 1).sum()))]


def is_fold(doc_id: Column, fold: int, folds: int) -> Column:
    """Whether crc32 of the id as text falls in a fold; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Rows (text, toxic, part) of the bounded sample, and the count of all usable labels of each class."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    usable = cut(usable.where(~is_fold(F.col("doc_id"), 2, 4)))
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(usable.where("toxic = 0").orderBy(*order).limit(SAMPLE_ORDINARY))
    # a few thousand ids at most, as limited above
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(rows.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part")).distinct()), counts


def _word_counts(sample: DataFrame) -> dict[int, tuple[list[bytes], np.ndarray]]:
    """For each class: words, and in how many documents of the sample each is; WORDS words at most."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))))
    counts = sample.select(word.alias("w"), "toxic").groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    got = counts.orderBy(F.desc(F.col("t") + F.col("o")), "w").limit(WORDS).collect()
    own = {1: [(r.w.encode(), r.t) for r in got if r.t], 0: [(r.w.encode(), r.o) for r in got if r.o]}
    return {k: ([_marked([w]) for w, _ in v], np.array([n for _, n in v], np.int64)) for k, v in own.items()}


def _dictionary(size: int, words: tuple[list[bytes], np.ndarray], chosen: np.ndarray, most: int = MOST) -> bytes:
    """A zstandard dictionary trained on the chosen words, each as often as documents hold it; empty if they are too few."""
    samples = [x for i in chosen.tolist() for x in [words[0][i]] * min(most, int(words[1][i]))]
    random.Random(1).shuffle(samples)
    samples = [x for x in samples if len(x) >= 8]
    if len(samples) < LEAST:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text for its statistics: the text itself is the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(toxic: tuple[list[bytes], np.ndarray], ordinary: tuple[list[bytes], np.ndarray], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries, trained against each other in rounds."""
    inputs = lambda words: [x + TAIL for x in words[0]]
    common = _dictionary(FIRST_BYTES, ordinary, np.arange(len(ordinary[0])), MOST_FIRST)
    long = _compressor(common).compress
    length = np.array([len(long(x)) for x in inputs(toxic)], np.int64)
    chosen = np.flatnonzero(length >= np.quantile(np.repeat(length, toxic[1]), 1 - FIRST_SHARE))
    special = _dictionary(TOXIC_BYTES, toxic, chosen)
    for _ in range(rounds - 1):
        hard = np.flatnonzero(Distance(Model(common, special, ())).gains(inputs(ordinary)) > 0)
        common = (_dictionary(MORE_BYTES, ordinary, hard) + common)[:ORDINARY_BYTES]
        gain = Distance(Model(common, special, ())).gains(inputs(toxic))
        better = _dictionary(TOXIC_BYTES, toxic, np.flatnonzero(gain > 0))
        if not better:
            break
        special = better
    return common, special


def _logistic(x: np.ndarray, y: np.ndarray, shift: float) -> tuple[float, ...]:
    """Weights of a ridge logistic regression by Newton's steps; shift corrects the sample's class balance."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[-1] += shift
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit to a bounded sample of the labelled documents outside fold 2 of 4.

    docs: doc_id, text. labels: doc_id, toxic (over 0: toxic; the largest label of an id counts; null labels
    and ids do not). With labels of one class or none, every score is that class's share (or 0). Empty texts and
    copies are as good a sample as any; repeated rows count once.
    """
    sample, counts = _sample(docs, labels)
    words = _word_counts(sample.where("part > 0"))
    model = Model(b"", b"", ())
    if all(w for w, _ in words.values()):
        model = Model(*dictionaries(words[1], words[0]), ())
    rows = sample.where("part = 0").select("toxic", _udf(model)("text").alias("x")).collect()  # a row for each document of that part
    y = np.array([r.toxic for r in rows], float)
    if not y.size or y.min() == y.max():
        share = counts.get(1, 0) > 0 and counts.get(0, 0) == 0
        return Model(model.ordinary, model.toxic, (0.0,) * FEATURES + (4.0 if share else -30.0,))
    shift = math.log(counts[1] / counts[0]) - math.log(y.sum() / (y.size - y.sum()))
    return Model(model.ordinary, model.toxic, _logistic(np.array([r.x for r in rows]), y, shift))


def _udf(model: Model):
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        distance = Distance(model)
        for texts in batches:
            yield pa.array([distance.features(t) for t in each(texts)], pa.list_(pa.float64()))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `score` (0 to 1) and `predicted` (1 from THRESHOLD up), replacing columns of those names.

    Only the text is read; a null or empty text has no window and gets the score of no evidence. Whole texts
    are scored, window by window. Other columns pass through. Rows are judged alone, so repeated ones are alike,
    and an empty table gives an empty table.
    """
    x = docs.withColumn("__x", _udf(model)(F.col("text").cast("string")))
    z = F.lit(model.weights[-1])
    for i, w in enumerate(model.weights[:-1]):
        z = z + F.lit(w) * F.col("__x")[i]
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return x.withColumn("score", p).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop("__x")
