"""URL filter: rules first, then the likelihood ratio of two character language models.

Rules name hosts and path beginnings. The urls they decide train two variable-order Markov models, one of accepted and one of
rejected urls: counts of every character after its last 0 to 4 characters, smoothed by Witten-Bell interpolation from the
longest known context down. A url that no rule decides is judged by the difference of the two log-likelihoods per character,
calibrated by a logistic curve on the trained urls, each scored without its own counts.

The count table grows with the urls and is never sent to tasks whole: urls are dealt into blocks, each block asks for its
distinct n-grams, the answers are joined and travel back to the block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.calibration import calibrate
from feedloom.llm.common import store

ORDER = 4
#: Urls per block, and n-grams a task counts before it hands them on.
BLOCK, HELD = 8192, 500_000
MAX_RULES = 1000
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = [("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("label", pa.int32())]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (``host/path``, verdict) that fits: host or a subdomain of it, and a path that begins alike."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"More than {MAX_RULES} rules; join them as a table instead.")
    found = F.lit(None).cast("string")
    for name, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = name.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{rest}"))
        found = F.when(fits, name).otherwise(found)
    return found


def _grams(host: str, path: str) -> list[str]:
    text = f"{_START}{host}{path}{_END}"
    return [text[i - k : i + 1] for i in range(1, len(text)) for k in range(min(ORDER, i) + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (gram, accepted, rejected) of the labelled urls."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def held() -> pa.RecordBatch:
        grams = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(grams, pa.string()), pa.array([counts[1][g] for g in grams], pa.int64()), pa.array([counts[0][g] for g in grams], pa.int64())], ["gram", "accepted", "rejected"]
        )
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for host, path, label in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "label"))):
            counts[label].update(_grams(host, path))
            if len(counts[0]) + len(counts[1]) > HELD:
                yield held()
    yield held()


def count_table(labelled: DataFrame) -> DataFrame:
    """Per n-gram its counts, and as a context the number of characters and of different characters that follow it."""
    counts = store(labelled.mapInArrow(_counted, "gram string, accepted long, rejected long").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams")
    contexts = counts.groupBy(F.expr("left(gram, char_length(gram) - 1)").alias("gram")).agg(
        *[F.sum(c).alias(f"{c}_after") for c in ("accepted", "rejected")], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in ("accepted", "rejected")]
    )
    zero = {c: 0 for c in ("accepted", "rejected", "accepted_after", "rejected_after", "accepted_kinds", "rejected_kinds")}
    return counts.join(contexts, "gram", "full").fillna(zero)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, rows, grams = TaskContext.get().partitionId() << 32, [], set()

    def made() -> pa.RecordBatch:
        lists = [pa.array([list(c)], pa.list_(kind)) for c, (_, kind) in zip(zip(*rows), _ROW)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, pa.array([[*grams, ""]], pa.list_(pa.string()))], ["block", *(n for n, _ in _ROW), "grams"])

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n, _ in _ROW)):
            rows.append(row)
            # The contexts of a character are n-grams of the characters before it, the start mark apart.
            grams.update(_grams(row[1], row[2]))
            grams.add(_START)
            if len(rows) >= BLOCK:
                yield made()
                block, rows, grams = block + 1, [], set()
    if rows:
        yield made()


def log_likelihood(text: str, stats: dict[str, tuple[int, int, int]], own: Counter | None) -> float:
    """Of a marked url under one model; ``own`` are counts to leave out, those of the url itself."""
    total = 0.0
    for i in range(1, len(text)):
        p = 1 / 256
        for k in range(min(ORDER, i) + 1):
            context = text[i - k : i]
            _, after, kinds = stats.get(context, (0, 0, 0))
            n = stats.get(context + text[i], (0, 0, 0))[0]
            if own is not None:
                after -= own.get(("after", context), 0)
                kinds -= own.get(("kinds", context), 0)
                n -= own.get(context + text[i], 0)
            if after <= 0:
                break
            p = (n + kinds * p) / (after + kinds)
        total += math.log(p)
    return total


def _own(host: str, path: str, stats: dict[str, tuple[int, int, int]]) -> Counter:
    """What a trained url has added to its model."""
    own = Counter(_grams(host, path))
    for gram, n in list(own.items()):
        own["after", gram[:-1]] += n
        if stats.get(gram, (0, 0, 0))[0] == n:
            own["kinds", gram[:-1]] += 1
    return own


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            answers = batch.column("answers")[i].as_py() or []
            accepted = {a["gram"]: (a["accepted"], a["accepted_after"], a["accepted_kinds"]) for a in answers}
            rejected = {a["gram"]: (a["rejected"], a["rejected_after"], a["rejected_kinds"]) for a in answers}
            columns = [batch.column(n)[i].as_py() for n, _ in _ROW]
            ratios = []
            for host, path, label in zip(columns[1], columns[2], columns[4]):
                text = f"{_START}{host}{path}{_END}"
                ratio = log_likelihood(text, accepted, _own(host, path, accepted) if label == 1 else None)
                ratio -= log_likelihood(text, rejected, _own(host, path, rejected) if label == 0 else None)
                ratios.append(ratio / (len(text) - 1))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, (_, kind) in zip(columns, _ROW)), pa.array(ratios, pa.float64())], [*(n for n, _ in _ROW), "ratio"])


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block), ratio, probability (of being acceptable).

    A null url or one without ``://`` has empty host and path, which are judged by the models like any other. If the rules
    accept or reject no url at all, there is nothing to compare, and urls without a rule are allowed. Repeated rows are
    judged alike; other columns are not looked at. An empty table gives no rows.
    """
    url = F.col(f"`{url_column}`")
    read = pages.select(F.col(f"`{id_column}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    verdicts = dict(rules)
    accepts = F.lit(None).cast("int")
    for name, verdict in rules:
        accepts = F.when(F.col("rule") == name, int(verdict == "allow")).otherwise(accepts)
    ruled = read.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("label", accepts)
    assert set(verdicts.values()) <= {"allow", "block"}

    answers = count_table(ruled.where("label IS NOT NULL").select("host", "path", "label"))
    schema = "block long, page_id array<long>, host array<string>, path array<string>, rule array<string>, label array<int>, grams array<string>"
    blocks = store(ruled.mapInArrow(_blocks, schema), "urls")
    stats = [c for c in answers.columns if c != "gram"]
    asked = blocks.select("block", F.explode("grams").alias("gram")).join(answers, "gram")
    given = asked.groupBy("block").agg(F.collect_list(F.struct("gram", *stats)).alias("answers"))
    scored = store(blocks.drop("grams").join(given, "block", "left").mapInArrow(_scored, "page_id long, host string, path string, rule string, label int, ratio double"), "ratios")

    # Two thousand steps of the ratio at most, whatever the number of urls.
    step = F.round(F.greatest(F.least(F.col("ratio"), F.lit(10)), F.lit(-10)), 2)
    bins = scored.where("label IS NOT NULL").groupBy(step.alias("ratio"), "label").count().collect()
    if len({b.label for b in bins}) < 2:
        probability: Column = F.lit(1.0)
    else:
        slope, offset = calibrate(*(np.array(c, float) for c in zip(*sorted((b.ratio, b.label, b["count"]) for b in bins))))
        probability = 1 / (1 + F.exp(-(F.lit(slope) * F.col("ratio") + F.lit(offset))))
    return scored.withColumn("probability", probability).select(
        "page_id", "host", "path", "rule",
        F.when(F.coalesce(F.col("label") == 1, F.col("probability") >= 0.5), "allow").otherwise("block").alias("verdict"), "ratio", "probability",
    )
