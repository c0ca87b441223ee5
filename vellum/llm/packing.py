"""Cost-balanced packing of documents into fixed-length training sequences.

A sequence's cost is estimated as ``LINEAR`` per token plus ``QUADRATIC`` per squared length of each
piece in it (attention stays within a piece).  A document longer than a sequence first fills whole
sequences; what is left goes, longest first, to the cheapest sequence that has room for it.  As many
sequences are opened as the tokens need; a piece for which no sequence has room is cut over those
with the most.

Documents are packed in runs of ``RUN_TOKENS`` as they come in a partition, so nothing is shuffled
and a task holds one run; at most the last sequence of a run is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import table, text_or_empty, tidy
from vellum.llm.tokens import encoder

CAPACITY = 2048
END = 1
LINEAR = 1.0
#: Cost of a squared token: attention's share at a model width of about 4096.
QUADRATIC = 1 / 4096
RUN_TOKENS = 2_000_000
#: Texts that are tokenised at once, in bytes.
TEXT_BYTES = 8_000_000


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, int]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of these lengths, and how many sequences.

    Equal lengths go in the documents' order, equal costs to the lower sequence.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    whole = lengths // capacity
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            pieces.append((int(d), k * capacity, capacity, sequence, 0))
            sequence += 1
    rest = lengths - whole * capacity
    n = -(-int(rest.sum()) // capacity)
    room, cost = np.full(n, capacity, dtype=np.int64), np.zeros(n)

    def put(d: int, start: int, length: int, s: int) -> None:
        pieces.append((d, start, length, sequence + s, int(capacity - room[s])))
        room[s] -= length
        cost[s] += linear * length + quadratic * length * length

    for d in np.argsort(-rest, kind="stable"):
        length, start, d = int(rest[d]), int(whole[d]) * capacity, int(d)
        if not length:
            break
        masked = np.where(room >= length, cost, np.inf)
        s = int(masked.argmin())
        if masked[s] < np.inf:
            put(d, start, length, s)
            continue
        while length:
            s = int(room.argmax())
            part = min(length, int(room[s]))
            put(d, start, part, s)
            start, length = start + part, length - part
    return np.array(pieces, dtype=np.int64).reshape(-1, 5), sequence + n


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds a piece's token ids as little-endian unsigned 32-bit numbers.  A document's ids are
    its text's (null: none) and ``end``.  Repeated rows are packed as often as they come; a null
    doc_id stays null.  Empty tables give no rows.  ``tokenizer`` is a file that all workers can
    open.  A sequence_id is a partition's number and a count, so a rerun over the same partitions
    gives the same rows.
    """

    def flush(ids: list, tokens: list[bytes], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(t) // 4 for t in tokens], dtype=np.int64)
        pieces, opened = assign(lengths, capacity)
        d, start, length, sequence, offset = pieces.T
        cuts = [tokens[i][4 * s : 4 * (s + n)] for i, s, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
        columns = [
            pa.array([ids[i] for i in d.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(lengths[d]),
            pa.array(sequence + first), pa.array(offset), pa.array(cuts, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), first + opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder(tokenizer).encode, np.array([end], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[bytes] = []
        held = 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary())
            at = 0
            while at < len(texts):
                part: list[bytes] = []
                size = 0
                while at + len(part) < len(texts) and size < TEXT_BYTES:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1])
                for i, t in zip(own[at : at + len(part)], encode(part), strict=True):
                    ids.append(i)
                    tokens.append(t + stop)
                    held += len(t) // 4 + 1
                    if held >= RUN_TOKENS:
                        out, first = flush(ids, tokens, first)
                        yield out
                        ids, tokens, held = [], [], 0
                at += len(part)
        if ids:
            yield flush(ids, tokens, first)[0]
        tidy()

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return picked.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces into which all documents are packed."""
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
