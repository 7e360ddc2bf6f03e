"""Quality classifier by supervised subword embeddings.

A document is the mean of learned vectors, one per hashed feature: its words, their character n-grams, pairs of adjoining
words, and ends of lines. A softmax over two labels sits on that mean; both are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows. At scoring time a feature counts only by its vector's part in the
difference of the two outputs, one number per feature, so a text is scored by sums over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import in_share, pieces, store, text_buffer
from feedloom.llm.hashing import mix, words

#: Feature buckets as a power of two, and the length of their vectors.
BITS, SIZE = 15, 16
#: Character n-grams, a word having a byte in front and one behind.
GRAMS = range(3, 6)
#: Steps of training, one example each, whatever the size of the sample; and the first rate.
STEPS, RATE = 20_000, 0.5
_SALT = np.random.default_rng(43).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(47).integers(1, 1 << 62, max(GRAMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FRONT, _BACK = 0x02, 0x03


def _bucket(value: np.ndarray, kind: int) -> np.ndarray:
    """Place of a hashed feature of a kind: 0 words, 1 pairs, 2 ends of lines, then n-grams."""
    return (mix(value * _SALT[kind]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Features:
    """Features of a run of texts.

    ``word``: which distinct word stands at each position, ``first[i]:first[i + 1]`` the positions of text i. ``gram`` and
    ``owner``: buckets of the distinct words and their n-grams, and the word each belongs to. ``pair``: bucket of each word with the
    next one, for positions that have a next one in their text. ``lines``: number of line ends of each text, the text's own included.
    """

    first: np.ndarray
    word: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    pair: np.ndarray
    paired: np.ndarray
    lines: np.ndarray


def features(column: pa.Array) -> Features:
    data, offsets = text_buffer(column)
    found = words(data, offsets)
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    _, where, word = np.unique(found.hash, return_index=True, return_inverse=True)
    length = found.end[where] - found.start[where]
    # The distinct words one after the other, each between a byte in front and one behind.
    ends = np.cumsum(length + 2)
    own = np.repeat(np.arange(len(where)), length + 2)
    starts = ends - (length + 2)
    place = np.arange(len(own)) - starts[own]
    inside = (place > 0) & (place <= length[own])
    spelled = np.full(len(own), _FRONT, np.uint64)
    spelled[place > length[own]] = _BACK
    spelled[inside] = data[found.start[where][own[inside]] + place[inside] - 1]
    grams, owners = [_bucket(found.hash[where], 0)], [np.arange(len(where))]
    for width in GRAMS:
        n = len(own) - width + 1
        if n <= 0:
            continue
        value = np.zeros(n, np.uint64)
        for at in range(width):
            value += (spelled[at : at + n] + np.uint64(1)) * _PLACE[at]
        whole = own[:n] == own[width - 1 :]
        grams.append(_bucket(value[whole], width))
        owners.append(own[:n][whole])
    # A word next to itself gives the same value whatever the word is.
    pair = _bucket(found.hash[:-1] ^ found.hash[1:], 1) if len(found.hash) else np.zeros(0, np.int64)
    last = np.zeros(len(found.hash), dtype=bool)
    filled = found.first[1:] > found.first[:-1]
    last[found.first[1:][filled] - 1] = True
    paired = np.flatnonzero(~last)
    return Features(found.first, word.astype(np.int64), np.concatenate(grams), np.concatenate(owners), pair[paired], paired, lines)


_LINE = int(_bucket(np.ones(1, np.uint64), 2)[0])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per example: its distinct buckets and how often each occurs, over the whole text."""
    for batch in batches:
        for part in pieces(batch):
            f = features(part.column("text"))
            order = np.argsort(f.owner, kind="stable")
            gram, at = f.gram[order], np.searchsorted(f.owner[order], np.arange(len(f.gram) + 1))
            buckets, counts = [], []
            for i in range(part.num_rows):
                a, b = f.first[i], f.first[i + 1]
                seen, times = np.unique(f.word[a:b], return_counts=True)
                own = [gram[at[w] : at[w + 1]] for w in seen]
                pair = f.pair[np.searchsorted(f.paired, a) : np.searchsorted(f.paired, b)]
                found = np.concatenate([*own, pair, [_LINE]]).astype(np.int64)
                weight = np.concatenate([np.repeat(times, [len(o) for o in own]), np.ones(len(pair)), [f.lines[i]]])
                total = np.bincount(found, weights=weight, minlength=1)
                buckets.append(np.flatnonzero(total).astype(np.int32))
                counts.append(total[buckets[-1]].astype(np.int32))
            columns = [part.column("doc_id"), part.column("label"), *(pa.array(c, pa.list_(pa.int32())) for c in (buckets, counts))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "buckets", "counts"])


@dataclass(frozen=True)
class Model:
    """``weight``: each bucket's part in the log-odds of label 1; ``offset``: what the sample's shares of labels differ from all."""

    weight: np.ndarray
    offset: float


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, rate: float = RATE, size: int = SIZE, seed: int = 5) -> np.ndarray:
    """Part of every bucket in the difference of the outputs, from (buckets, counts) and labels 0 or 1.

    One example a step, all of them in an order drawn anew each time round, with a rate that falls to nothing. Examples of
    the rarer label weigh as much in total as those of the other.
    """
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / size, 1 / size, (1 << BITS, size))
    output = np.zeros((2, size))
    share = np.bincount(labels, minlength=2) / len(labels)
    order = np.zeros(0, np.int64)
    for done in range(steps):
        if not len(order):
            order = draw.permutation(len(examples))
        at, order = order[0], order[1:]
        buckets, counts = examples[at]
        part = counts / counts.sum()
        mean = part @ vectors[buckets]
        z = output @ mean
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[at]] -= 1
        step = rate * (1 - done / steps) * 0.5 / share[labels[at]] * p
        back = step @ output
        output -= np.outer(step, mean)
        vectors[buckets] -= part[:, None] * back
    return vectors @ (output[1] - output[0])


def _runs(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column, as views of its numbers."""
    return np.split(np.asarray(column.flatten()), np.cumsum(column.value_lengths().to_numpy())[:-1])


def learn(documents: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), max_examples: int = 1500, **training) -> Model | None:
    """The model of (doc_id, text) and (doc_id, label). None if the examples hold fewer than two labels.

    At most ``max_examples`` of each label are drawn by a hash of the id. Their features, at most one number per bucket and
    example, are what reaches the driver. The log-odds are moved by how much rarer a label is in the sample than in all
    labelled rows that teach.
    """
    known = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").where(~in_share(F.col("doc_id"), *held_out)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = store(known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    drawn = [known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for label in (0, 1)]
    sample = store(drawn[0].unionByName(drawn[1]), "examples")
    # At most 2 * max_examples rows of two numbers. An id that stands on several rows gives one text.
    texts = documents.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(_counted, "doc_id long, label int, buckets array<int>, counts array<int>").toArrow()
    examples = [
        example
        for batch in rows.to_batches()
        for example in zip(batch["doc_id"].to_pylist(), batch["label"].to_pylist(), *(_runs(batch[c]) for c in ("buckets", "counts")))
    ]
    examples.sort(key=lambda e: e[0])
    weight = train([e[2:] for e in examples], np.array([e[1] for e in examples], np.int64), **training)
    # Training gives both labels the same weight; how frequent they are comes in here.
    return Model(weight, float(np.log(sizes[1] / sizes[0])))


def _segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]], each from its own values only."""
    out = np.zeros(len(first) - 1)
    filled = np.flatnonzero(first[1:] > first[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, first[:-1][filled])
    return out


def log_odds(column: pa.Array, model: Model) -> np.ndarray:
    """Log-odds of label 1 for each text."""
    f = features(column)
    order = np.argsort(f.owner, kind="stable")
    bounds = np.searchsorted(f.owner[order], np.arange(int(f.word.max(initial=-1)) + 2))
    of_word, size = _segment_sums(model.weight[f.gram[order]], bounds), np.diff(bounds)
    at = np.searchsorted(f.paired, f.first)
    total = _segment_sums(of_word[f.word], f.first) + _segment_sums(model.weight[f.pair], at) + f.lines * model.weight[_LINE]
    count = _segment_sums(size[f.word].astype(float), f.first) + np.diff(at) + f.lines
    return total / count + model.offset


def score_of(text: Column, model: Model | None) -> Column:
    """Probability of label 1; 0.5 without a model."""

    def judge(column: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(column), 0.5))
        batch = pa.RecordBatch.from_arrays([column.cast(pa.large_string())], ["text"])
        odds = np.concatenate([log_odds(part.column("text"), model) for part in pieces(batch)] or [np.zeros(0)])
        return pa.array(np.round(1 / (1 + np.exp(-np.clip(odds, -500, 500))), 12))

    return F.arrow_udf(judge, "double").asNondeterministic()(text.cast("string"))


def classify_quality(
    documents: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", **settings
) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, of label 1), predicted (1 from ``threshold`` on).

    Labels are learned from rows whose crc32(id) modulo the first number of ``held_out`` is not the second. Null and empty
    texts have the end of one line as their only feature. Labels other than 0 and 1 and null ids teach nothing; an id that
    is labelled twice counts with its larger label, one that stands on several rows with its smallest text. If the examples hold fewer
    than two labels, every score is 0.5. Repeated rows are judged alike; other columns are not looked at. An empty table
    gives no rows.
    """
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{label_column}`").alias("label"))
    model = learn(rows, known, held_out, **settings)
    return rows.select("doc_id", in_share(F.col("doc_id"), *held_out).alias("held_out"), score_of(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
