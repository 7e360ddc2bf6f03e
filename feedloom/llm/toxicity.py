"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The examples are a bounded sample of the labelled rows, dealt by a hash of the id, at most ``max_examples`` of each label.
Terms are the words and beginnings of words whose share of toxic examples differs significantly from their share of the
others; equal texts of one label, but for case and white space, count once. Document frequencies for the weights are counted over all documents. An inverted
index over the examples keeps, per term and block of examples, the largest weight: a query adds up these maxima, visits the
blocks from the best bound on, and stops when no block can reach its k-th best cosine any more, so the k nearest, and all
that tie with the last of them, are exact. Each text is split into words once; what is stored of it are its listed terms.
The votes of the neighbours are calibrated on the examples themselves, each judged without its own text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.calibration import calibrate
from feedloom.llm.common import in_share, pieces, store

WORD = re.compile(r"[^\W\d_]+")
#: Examples per block, and blocks visited at a time.
BLOCK, VISIT = 64, 8
NEIGHBOURS = 15
#: Beginnings of words that are terms besides the words themselves, for languages that build words from stems.
PREFIXES = range(4, 9)
_CACHED = 200_000


def _words(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def _terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many examples of each label hold a term."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            counts[toxic].update({t for w in _words(text) for t in _terms_of(w)})
    terms = list(counts[0].keys() | counts[1].keys())
    columns = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)]
    yield pa.RecordBatch.from_arrays(columns, ["term", "clean", "toxic"])


def _copy_key(text: Column) -> Column:
    """Equal for texts that differ by case and white space only."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), 256)


class Matcher:
    """Counts of known terms in a text, and of the words without one."""

    def __init__(self, terms: list[str]):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        found: dict[int, int] = {}
        rest = 0
        if len(self.cache) > _CACHED:
            self.cache.clear()
        for word, n in _words(text).items():
            known = self.cache.get(word)
            if known is None:
                known = self.cache[word] = tuple(self.terms[t] for t in _terms_of(word) if t in self.terms)
            if known:
                for term in known:
                    found[term] = found.get(term, 0) + n
            else:
                rest += n
        return found, rest


@dataclass
class Index:
    """Examples as term weights of length one: ``blocks[block, term, place]``, and the largest weight per term and block."""

    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray

    def vector(self, counts: dict[int, int], rest: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights. All other words together are one more term, so that a term in a long text weighs less."""
        which = np.array([*sorted(counts), len(self.idf)] if rest else sorted(counts), np.int64)
        weight = np.array([(1 + math.log(counts[t])) * self.idf[t] if t < len(self.idf) else 1 + math.log(rest) for t in which])
        norm = math.sqrt(float(weight @ weight)) if len(weight) else 0.0
        return which, weight / norm if norm else weight

    def nearest(self, which: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int | np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term, and of all that are as near as the k-th."""
        bounds = weight @ self.block_max[which]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(order), VISIT):
            visited = order[at : at + VISIT]
            if len(places) >= k and bounds[visited[0]] < cosines.min() - 1e-9:
                break
            scores = np.round(np.matmul(weight, self.blocks[visited[:, None], which]), 12).ravel()
            new = (visited[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = (scores > 0) & ~np.isin(new, -1 if without is None else without)
            places, cosines = np.concatenate([places, new[found]]), np.concatenate([cosines, scores[found]])
            if len(places) > k:
                near = cosines >= np.partition(cosines, -k)[-k]
                places, cosines = places[near], cosines[near]
        best = np.lexsort((places, -cosines))
        return places[best], cosines[best]

    def vote(self, which: np.ndarray, weight: np.ndarray, without: int | np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Share of toxic votes, weighted by cosine over distance; without a neighbour 0."""
        places, cosines = self.nearest(which, weight, without=without)
        if not len(places):
            return 0.0, places
        strength = cosines / (1.05 - np.minimum(cosines, 1.0))
        return float(strength @ self.labels[places] / strength.sum()), places


def build_index(idf: np.ndarray, examples: list[tuple[int, int, dict[int, int], int]]) -> Index:
    """Index of (id, label, term counts, other words)."""
    blocks = np.zeros((-(-len(examples) // BLOCK), len(idf) + 1, BLOCK))
    index = Index(idf, np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], float), blocks, np.zeros((0, 0)))
    for place, (_, _, counts, rest) in enumerate(examples):
        which, weight = index.vector(counts, rest)
        blocks[place // BLOCK, which, place % BLOCK] = weight
    index.block_max = blocks.max(axis=2).T if len(examples) else np.zeros((len(idf) + 1, 0))
    return index


@dataclass
class Scorer:
    terms: list[str]
    index: Index
    slope: float
    offset: float

    def scores(self, counted: Iterable[tuple[dict[int, int], int]], known: dict[bytes, tuple] | None = None) -> list[tuple[float, list[int]]]:
        """Calibrated score and ids of the three nearest examples for the term counts of each text.

        ``known`` keeps the results of vectors that were met before; texts with few listed terms are often alike.
        """
        out, known = [], {} if known is None else known
        for counts, rest in counted:
            which, weight = self.index.vector(counts, rest)
            key = which.tobytes() + np.round(weight, 12).tobytes()
            if key not in known:
                if len(known) >= _CACHED:
                    known.clear()
                raw, places = self.index.vote(which, weight)
                known[key] = 1 / (1 + math.exp(-(self.slope * raw + self.offset))), [int(self.index.ids[p]) for p in places[:3]]
            out.append(known[key])
        return out


_MATCHED = "terms array<int>, counts array<int>, rest int"


def matched_rows(rows: DataFrame, terms: list[str], *columns: str) -> DataFrame:
    """The columns, and of each text the listed terms, how often each occurs, and the number of other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            for part in pieces(batch):
                made = [matcher.counts(t) for t in part.column("text").to_pylist()]
                found = [
                    pa.array([list(c) for c, _ in made], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in made], pa.list_(pa.int32())), pa.array([r for _, r in made], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *found], [*columns, "terms", "counts", "rest"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), _MATCHED]))


def _frequencies(size: int):
    """In how many texts of a partition each listed term stands; under -1 the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(size, np.int64), 0
        for batch in batches:
            found += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=size)
            total += batch.num_rows
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(found[seen], total))], ["term", "n"])

    return run


def learn(documents: DataFrame, labels: DataFrame, **settings) -> Scorer | None:
    """The scorer of (doc_id, text) and (doc_id, toxic). None if the examples hold fewer than two labels."""
    fitted = fit(documents, labels, **settings)
    return fitted[0] if fitted else None


def fit(documents: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), max_examples: int = 3000, z: float = 5.0) -> tuple[Scorer, DataFrame] | None:
    """The scorer of (doc_id, text) and (doc_id, toxic), and the matched terms of all documents, each text read once.

    A term's shares of the two labels differ by ``z`` standard errors, as the signed root of the likelihood ratio tells,
    which holds for rare terms too: of equally many examples, 18 of one label and none of the other are enough at 5.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~in_share(F.col("doc_id"), *held_out)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # A limit per label instead of a window, which would read a label's rows in one task.
    drawn = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for label in (0, 1)]
    sample = store(drawn[0].unionByName(drawn[1]), "examples")
    # At most 2 * max_examples rows of two numbers.
    texts = documents.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.struct(_copy_key(F.col("text")).alias("key"), "text").alias("it"))
    # An id that stands on several rows gives one text, copies of a text within a label one example.
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("it").alias("it")).groupBy("toxic", "it.key").agg(F.min(F.struct("doc_id", "it.text")).alias("first"))
    single = store(texts.select("first.doc_id", "toxic", "first.text", "key"), "texts")

    sizes = {r.toxic: r["count"] for r in single.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    counts = single.mapInArrow(_example_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    of, total = F.col("toxic") + F.col("clean"), sizes[0] + sizes[1]
    cells = [(F.col(name), of, n) for name, n in (("toxic", sizes[1]), ("clean", sizes[0]))]
    cells += [(n - F.col(name), total - of, n) for name, n in (("toxic", sizes[1]), ("clean", sizes[0]))]
    ratio = sum((F.when(seen > 0, seen * F.log(seen * total / (row * n))).otherwise(0.0) for seen, row, n in cells), F.lit(0.0))
    # Each such term needs several of the bounded examples, so the list follows the sample, not the corpus.
    terms = sorted(r.term for r in counts.where(2 * ratio >= z * z).select("term").collect())
    everywhere = store(matched_rows(documents, terms, "doc_id"), "matched")
    rows = everywhere.select("terms").mapInArrow(_frequencies(len(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    total = found.pop(-1, 0)
    idf = np.array([math.log((1 + total) / (1 + found.get(i, 0))) + 1 for i in range(len(terms))])

    matched = matched_rows(single, terms, "doc_id", "toxic", "key").orderBy("doc_id", "toxic").collect()
    examples = [(r.doc_id, r.toxic, dict(zip(r.terms, r.counts)), r.rest) for r in matched]
    index = build_index(idf, examples)
    # A text that has both labels stands there twice: neither row judges the other.
    own: dict[str, list[int]] = {}
    for place, r in enumerate(matched):
        own.setdefault(r.key, []).append(place)
    raw = np.array([index.vote(*index.vector(counts, rest), without=np.array(own[r.key]))[0] for r, (_, _, counts, rest) in zip(matched, examples)])
    return Scorer(terms, index, *calibrate(raw, index.labels)), everywhere


def _scored(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("terms", "counts", "rest"))
            found = scorer.scores(((dict(zip(t, c)), r) for t, c, r in zip(*columns)), known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"]
            )

    return run


def toxicity(
    documents: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text", **settings
) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on), evidence (ids of nearest examples).

    Labels are learned from rows whose crc32(id) modulo the first number of ``held_out`` is not the second. Null and empty
    texts share no term with any example and get the score of no votes. Examples as near as the last neighbour all vote, so
    a text without a listed term is judged by all examples without one. Labels other than 0 and 1 and null ids teach
    nothing; an id that is labelled twice counts with its larger label. If the examples hold fewer than two labels, every
    score is 0. Repeated rows are judged alike; other columns are not looked at. An empty table gives no rows.
    """
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    fitted = fit(rows, labels.select("doc_id", "toxic"), held_out, **settings)
    if fitted is None:
        judged = rows.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("evidence"))
    else:
        # What is stored of a text is small, judging it is not: the rows are dealt to all tasks.
        dealt = fitted[1].repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        judged = dealt.mapInArrow(_scored(fitted[0]), "doc_id long, score double, evidence array<long>")
    return judged.select(
        "doc_id", in_share(F.col("doc_id"), *held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence"
    )
