"""Compression of vectors to codes of eight bytes' worth of codebook entries, in whole numbers throughout.

Vectors are cut into parts; every part has a codebook of its own, learned by rounds of assignment and averaging over all rows.
Distances come from dot products of limbs: integers are broken into pieces so small that a float64 matrix product of them is
exact (below 2^53), the pieces' products are put together in int64, and the first least distance decides. Results are
therefore the same whatever the order of rows and the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import store
from feedloom.llm.vectors import decimals, fits, largest, longs, matrices, stored_vectors, sums

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def _limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x as float64 pieces: x is the sum of piece i times 2^(bits * i); all but the last are not negative."""
    out, size = [], largest(x)
    while size >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(float))
        x, size = x >> bits, (size >> bits) + 1
    return [*out, x.astype(float)]


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All dot products of rows of x and c. They have to fit int64; every float64 product stays below 2^53."""
    bits = (52 - (max(x.shape[1], 1) - 1).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    right = _limbs(c, bits)
    for i, a in enumerate(_limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows of x and c, exact: int64, or Python integers where those would not hold them."""
    if x.shape[1] * (largest(x) + largest(c)) ** 2 >= 1 << 62:
        return np.stack([((x.astype(object) - row.astype(object)) ** 2).sum(axis=1) for row in c], axis=1)
    return (x * x).sum(axis=1)[:, None] - 2 * exact_products(x, c) + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and part: index of the nearest entry, ties to the lower one, and its squared distance."""
    parts, _, width = codebooks.shape
    codes, errors = [], []
    for p in range(parts):
        d = distances(x[:, p * width : (p + 1) * width], codebooks[p])
        codes.append(np.argmin(d, axis=1))
        errors.append(d[np.arange(len(d)), codes[-1]])
    return np.stack(codes, axis=1), np.stack(errors, axis=1)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _assigned(codebooks: np.ndarray, dimensions: int):
    """Sum and number of the parts of each entry in this partition."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[[0] * width for _ in range(entries)] for _ in range(parts)]
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x in matrices(batch, dimensions):
                x = _padded(x, parts * width)
                codes, _ = nearest(x, codebooks)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    part = x[:, p * width : (p + 1) * width]
                    for e in np.unique(codes[:, p]):
                        total[p][e] = [a + b for a, b in zip(total[p][e], sums(part[codes[:, p] == e]))]
        used = [(p, e) for p in range(parts) for e in range(entries) if count[p, e]]
        places = [(p, e, i) for p, e in used for i in range(width)]
        columns = [pa.array([at[k] for at in places], pa.int32()) for k in range(3)]
        values = decimals([total[p][e][i] for p, e, i in places]), pa.array([int(count[p, e]) for p, e, _ in places], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, *values], ["part", "entry", "place", "total", "n"])

    return run


def first_codebooks(rows: DataFrame, dimensions: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the smallest ids, at most ``entries``; equal ids by vector, null ids last."""
    width = -(-dimensions // parts)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = _padded(np.array([r.x for r in seeds], np.int64).reshape(len(seeds), dimensions), parts * width)
    return np.stack([x[:, p * width : (p + 1) * width] for p in range(parts)])


def learn_codebooks(rows: DataFrame, dimensions: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) after the rounds; only sums per entry, ``entries`` x dimensions numbers, reach the driver."""
    codebooks = first_codebooks(rows, dimensions, parts, entries)
    for _ in range(rounds):
        found = rows.select("x").mapInArrow(_assigned(codebooks, dimensions), "part int, entry int, place int, total decimal(38,0), n long")
        moved = codebooks.copy()
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r.part, r.entry, r.place] = int(r.total) // r.n
        codebooks = moved
    return codebooks


def codebook_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all numbers in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _encoded(codebooks: np.ndarray, dimensions: int):
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in matrices(batch, dimensions):
                codes, errors = nearest(_padded(x, parts * width), codebooks)
                error = errors.sum(axis=1) if errors.dtype != object and fits(errors, parts) else errors.astype(object).sum(axis=1)
                code = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), longs(error)], ["vec_id", "label", "code", "error"])

    return run


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """Per usable row: vec_id, label, code, error, label_error, codebooks_sha256.

    Entries become ``floor(scale * entry)``; a length that ``parts`` does not divide is filled up with zeros. Rows whose vector
    is null, empty or holds null, infinite or undefined entries are dropped, also those of another length than the commonest.
    A table of fewer rows than ``entries`` has smaller codebooks. Repeated rows and null ids get rows of their own, null
    labels are one label; other columns are not looked at. An error beyond long is null, a sum beyond long too. An empty
    table gives no rows. At most 256 entries, as a code has two digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("A codebook has 1 to 256 entries.")
    rows, dimensions = stored_vectors(embeddings, scale, 0, vector_column, "vectors", vec_id=id_column, label=label_column)
    kind = rows.schema["label"].dataType.simpleString()
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    if not dimensions:
        return embeddings.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    codebooks = learn_codebooks(rows, dimensions, parts, entries, rounds)
    coded = store(rows.mapInArrow(_encoded(codebooks, dimensions), f"vec_id long, label {kind}, code string, error long"), "codes")
    own = coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(CAST(error AS DECIMAL(38,0))) AS LONG)").alias("label_error"))
    return coded.join(own, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "label", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256")
    )
