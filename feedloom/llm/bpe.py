"""Byte-level BPE encoding and decoding around a global shuffle of distinct words.

Texts are cut into pre-tokens. Within a block of documents (some MB of whole texts) every distinct pre-token becomes a word
of the block's dictionary, and the documents become sequences of positions in it. The dictionaries, not the texts, are
shuffled by word hash, so that all occurrences of a word meet in one task, which merges its bytes once. The ids travel back
to the blocks in the same packed form and are put in place by position. Each block is a row of a stored table, so a lost
executor costs the blocks it was working on.

Decoding joins ids with the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import picked, store_bucketed

#: Bytes of text in a block, and the largest vocabulary that may be sent to tasks.
BLOCK, MAX_VOCABULARY = 12 << 20, 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, and the pattern that cuts a text into pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From lines of base64 bytes and rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"More than {MAX_VOCABULARY} tokens.")
        return cls(ranks, pattern)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all neighbouring pairs, the one of lowest rank (leftmost first) merges until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    none = len(ranks) + (1 << 40)
    pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs and (low := min(pairs)) < none:
        at = pairs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for pre-tokens of any length."""
    n = len(parts)
    after, before, piece = list(range(1, n + 1)), list(range(-1, n - 1)), list(parts)
    heap: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n and (rank := ranks.get(piece[left] + piece[right])) is not None:
            heapq.heappush(heap, (rank, left, len(piece[left]) + len(piece[right])))

    for i in range(n - 1):
        offer(i)
    while heap:
        rank, left, size = heapq.heappop(heap)
        right = after[left] if piece[left] else n
        if right >= n or len(piece[left]) + len(piece[right]) != size or ranks.get(piece[left] + piece[right]) != rank:
            continue  # one of the two has merged meanwhile
        piece[left] += piece[right]
        piece[right] = b""
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    return [ranks[p] for p in piece if p]


def _pack(codes: np.ndarray) -> bytes:
    """32-bit numbers by byte plane, which compresses well."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


_BLOCKS = "block long, ids array<long>, words array<int>, codes binary, dictionary array<struct<bucket: int, lengths: binary, bytes: binary>>"
_DICTIONARY = pa.list_(pa.struct([("bucket", pa.int32()), ("lengths", pa.binary()), ("bytes", pa.binary())]))


def _cut(pattern: str, buckets: int):
    def finished(block: int, ids: list, sizes: list[int], codes: list[np.ndarray], known: dict[str, int]) -> pa.RecordBatch:
        words = [w.encode() for w in known]
        bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(words) else np.zeros(0, np.int64)
        runs = [order[a:b] for a, b in zip(starts, [*starts[1:], len(words)])]
        dictionary = [
            {"bucket": int(bucket[run[0]]), "lengths": _pack(np.array([len(words[i]) for i in run])), "bytes": b"".join(words[i] for i in run)} for run in runs
        ]
        all_codes = place[np.concatenate(codes)] if codes and len(words) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_pack(all_codes)], pa.binary()), pa.array([dictionary], _DICTIONARY)],
            ["block", "ids", "words", "codes", "dictionary"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        ids, sizes, codes, known, size = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                found = find(text)
                codes.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.uint32, len(found)))
                ids.append(doc_id)
                sizes.append(len(found))
                size += len(text)
                if size >= BLOCK:
                    yield finished(block, ids, sizes, codes, known)
                    block, ids, sizes, codes, known, size = block + 1, [], [], [], {}, 0
        if ids:
            yield finished(block, ids, sizes, codes, known)

    return run


def _encode_words(ranks):
    """Ids of every word of a dictionary run; a bucket's words are merged once, whatever number of blocks they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, known = ranks.value, None, {}
        for batch in batches:
            out = []
            for bucket, lengths, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lengths", "bytes"))):
                if bucket != now:
                    now, known = bucket, {}
                at, ids, counts = 0, [], []
                for n in _unpack(lengths).tolist():
                    word = raw[at : at + n]
                    at += n
                    made = known.get(word)
                    if made is None:
                        made = known[word] = merge(word, table)
                    ids += made
                    counts.append(len(made))
                out.append((_pack(np.array(ids)), _pack(np.array(counts))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array([i for i, _ in out], pa.binary()), pa.array([c for _, c in out], pa.binary())],
                ["block", "bucket", "tokens", "counts"],
            )

    return run


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of a flat array, one after the other."""
    taken = lengths[which]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - taken), taken) + np.arange(total)]


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, sizes, codes, parts = (batch.column(c)[i].as_py() for c in ("ids", "words", "codes", "parts"))
            parts = sorted(parts or [], key=lambda p: p["bucket"])
            flat = np.concatenate([_unpack(p["tokens"]) for p in parts] or [np.zeros(0, np.int64)]).astype(np.int32)
            counts = np.concatenate([_unpack(p["counts"]) for p in parts] or [np.zeros(0, np.int64)])
            codes, starts, at = _unpack(codes), np.cumsum(counts) - counts, 0
            for low in range(0, len(ids), 256):
                offsets, values = [0], []
                for size in sizes[low : low + 256]:
                    values.append(gather(flat, starts, counts, codes[at : at + size]))
                    offsets.append(offsets[-1] + len(values[-1]))
                    at += size
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + 256], pa.int64()), tokens], ["doc_id", "tokens"])


def _placed(documents: DataFrame, vocabulary: Vocabulary, id_column: str, text_column: str) -> DataFrame:
    """Blocks of documents, each with the ids of its words."""
    spark = documents.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = picked(documents, doc_id=id_column, text=text_column).mapInArrow(_cut(vocabulary.pattern, buckets), _BLOCKS)
    blocks = store_bucketed(cut, "blocks", "block")
    ranks = spark.sparkContext.broadcast(vocabulary.ranks)
    words = blocks.select("block", F.explode("dictionary").alias("d")).select("block", "d.bucket", "d.lengths", "d.bytes")
    tokens = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks), "block long, bucket int, tokens binary, counts binary")
    # A block has at most one part per distinct word.
    parts = tokens.groupBy("block").agg(F.collect_list(F.struct("bucket", "tokens", "counts")).alias("parts"))
    return blocks.select("block", "ids", "words", "codes").join(parts, "block", "left")


def encode(documents: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id and tokens (array of ids). No special tokens; their strings are ordinary text.

    Null and empty texts have no tokens. Repeated rows and null ids are rows like any other. Other columns are not looked
    at. An empty table gives no rows.
    """
    return _placed(documents, vocabulary, id_column, text_column).mapInArrow(_reassemble, "doc_id long, tokens array<int>")


@dataclass(frozen=True)
class _Strings:
    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, values: list[bytes]) -> _Strings:
        lengths = np.array([len(v) for v in values], np.int64)
        return cls(np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths)

    def joined(self, tokens: pa.Array) -> Iterator[bytes]:
        """For each list of ids, their strings joined; texts one at a time, whole."""
        offsets, values = np.asarray(tokens.offsets), np.asarray(tokens.values)
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield gather(self.flat, self.starts, self.lengths, values[a:b]).tobytes()


def _token_bytes(vocabulary: Vocabulary) -> list[bytes]:
    table = [b""] * (max(vocabulary.ranks.values(), default=-1) + 1)
    for token, rank in vocabulary.ranks.items():
        table[rank] = token
    return table


def decoded(tokens: Column, vocabulary: Vocabulary) -> Column:
    """Bytes of an array of ids; a null array is empty."""
    table = _Strings.of(_token_bytes(vocabulary))

    def decode(column: pa.Array) -> pa.Array:
        return pa.array(list(table.joined(column.fill_null([]) if column.null_count else column)), pa.binary())

    return F.arrow_udf(decode, "binary").asNondeterministic()(tokens)


def _digested(table: _Strings, decimal: _Strings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _reassemble(batches):
            tokens = batch.column("tokens")
            ids = [hashlib.sha256(s[:-1]).hexdigest() for s in decimal.joined(tokens)]
            texts = [hashlib.sha256(s).hexdigest() for s in table.joined(tokens)]
            yield batch.append_column("ids_sha256", pa.array(ids, pa.string())).append_column("decoded_sha256", pa.array(texts, pa.string()))

    return run


def round_trip(documents: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, tokens, ids_sha256, decoded_sha256: of the decimal ids joined by commas, and of the bytes
    decoded from the ids. Ids are decoded where they are put in place, in one Python worker. Edge cases as in ``encode``."""
    pieces = _token_bytes(vocabulary)
    finish = _digested(_Strings.of(pieces), _Strings.of([b"%d," % i for i in range(len(pieces))]))
    schema = "doc_id long, tokens array<int>, ids_sha256 string, decoded_sha256 string"
    done = _placed(documents, vocabulary, id_column, text_column).mapInArrow(finish, schema)
    return done.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", "ids_sha256", "decoded_sha256")
