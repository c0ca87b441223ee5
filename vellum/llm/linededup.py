"""Line dedup: winnowing over line hashes.

A line ends at a newline, and a long line also after a sentence (``.``, ``!`` or ``?`` and white
space), so passages that are set into a paragraph are runs of lines too.  A line's hash is of its
words.  A run is a sequence of following lines; wanted are runs of ``MIN_WORDS`` words or more that
came before, earlier in the same document or in a document of lower id.

1. Winnow.  A gram is the shortest run of ``GRAM_WORDS`` words from a line on.  The window of line i
   is the shortest run of ``MIN_WORDS`` words from i on; of the grams inside it, the one of least
   hash is kept as a fingerprint.  Two equal runs of ``MIN_WORDS`` words hence share a fingerprint,
   guaranteed, and most windows share theirs with their neighbours.
2. Join.  Only fingerprints that occur twice can mark repeats; the windows that chose them are
   matched by their whole content, each with the first place where that stands.
3. Extend.  Matched windows grow from the fingerprint both ways: forward, as windows that start at a
   line, and backward, as windows that end at one.  Together these cover every line of every
   repeated run, and no other line.
4. Delete the later runs' lines from the texts.

Nothing pairs all occurrences: a hash is first summed to its first place (a partial aggregate, so a
passage that half of the corpus repeats costs a row per task), then joined back.

``dedup_lines`` deletes whole lines only.  ``dedup_passages``, which the query and the pipeline take,
goes word by word, so that a passage may begin and end inside a line (``passages``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut, free_name, table, text_or_empty, tidy

MIN_WORDS = 50
GRAM_WORDS = 15
#: Bytes of line ranges up to which they are sent to the texts; beyond, texts are dealt by document to meet them.
SENT_BYTES = 16 << 20
LINE_END = re.compile(r"\n|[.!?]+[ \t]+")
#: Multiplier of the rolling hash over line hashes (odd).
MIX = np.uint64(0x9E3779B97F4A7C15)


def lines(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, each with what ends it, and their end offsets; the lines add up to the text."""
    ends = [m.end() for m in LINE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    start, out = 0, []
    for e in ends:
        out.append(text[start:e])
        start = e
    return out, ends


def line_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (uint64) and number of words of each line of all texts, and where each text's lines start."""
    digest = xxhash.xxh3_64_intdigest
    hashes: list[int] = []
    words: list[int] = []
    starts = [0]
    for text in texts:
        for x in lines(text)[0]:
            w = x.split()
            hashes.append(digest(" ".join(w)))
            words.append(len(w))
        starts.append(len(words))
    return np.array(hashes, dtype=np.uint64), np.array(words, dtype=np.int64), np.array(starts, dtype=np.int64)


#: The inverse of MIX modulo 2 ** 64.
UNMIX = np.uint64(pow(int(MIX), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Runs:
    """Hashes of runs of lines, of many documents at once; ``starts`` has where each one's lines start."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, starts: np.ndarray) -> None:
        n = len(hashes)
        # sum of hash * MIX^i; a run's sum is brought down to power zero, so equal runs agree anywhere
        self.down = _powers(UNMIX, n)
        self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_finish(hashes) * _powers(MIX, n)[:n], dtype=np.uint64)))
        self.words = np.concatenate(([0], np.cumsum(words)))
        self.owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.first, self.last = starts[:-1][self.owner], starts[1:][self.owner]  # of each line's document

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of lines a to b - 1."""
        return _finish((self.sum[b] - self.sum[a]) * self.down[a] ^ (b - a).astype(np.uint64))

    def forward(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of the shortest run of ``least`` words from each line that has one in its document."""
        b = np.searchsorted(self.words, self.words[:-1] + least)
        a = np.flatnonzero(b <= self.last)
        return a, b[a]

    def backward(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of the shortest run of ``least`` words up to each line that has one in its document."""
        a = np.searchsorted(self.words, self.words[1:] - least, side="right") - 1
        b = np.flatnonzero(a >= self.first)
        return a[b], b + 1


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each range (none empty), by doubling."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        step = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))
    level = np.floor(np.log2(hi - lo)).astype(np.int64)
    out = np.empty(len(lo), dtype=values.dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(rows[k][lo[at]], rows[k][hi[at] - (1 << int(k))])
    return out


def windows(runs: Runs, least: int = MIN_WORDS, gram: int = GRAM_WORDS) -> tuple[np.ndarray, ...]:
    """(a, b, hash, fingerprint) of each window, forward and backward ones, and the hashes of all grams with their lines."""
    ga, gb = runs.forward(gram)
    fa, fb = runs.forward(least)
    ba, bb = runs.backward(least)
    a, b = np.concatenate((fa, ba)), np.concatenate((fb, bb))
    grams = runs.hash(ga, gb)
    if not len(a):
        none = np.zeros(0, np.uint64)
        return a, b, none, none, grams, ga
    # grams inside a window: from its first line on, as far as they end in it; their ends ascend
    first, last = np.searchsorted(ga, a), np.searchsorted(gb, b, side="right")
    return a, b, runs.hash(a, b), _range_least(grams, first, np.maximum(last, first + 1)), grams, ga


def _distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, in order, and how often each comes."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))))
    return owner[heads], value[heads], np.diff(np.append(heads, len(owner)))


def _word_kind(least: int) -> np.dtype:
    return np.dtype("u1") if least < 256 else np.dtype("<u4")


def _hash_lines(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, starts = line_hashes(batch.column(2).to_pylist())
            n = len(starts) - 1
            runs = Runs(h, w, starts)
            a, _, _, prints, grams, at = windows(runs, least, gram)
            owner, chosen, _ = _distinct(runs.owner[a], prints)
            # one that stands twice in its document is listed twice
            g_owner, g_value, times = _distinct(runs.owner[at], grams)
            twice = times > 1
            seen = np.isin(_finish(g_owner[twice].astype(np.uint64)) ^ g_value[twice], _finish(owner.astype(np.uint64)) ^ chosen)
            owner, chosen = np.concatenate((owner, g_owner[twice][seen])), np.concatenate((chosen, g_value[twice][seen]))
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
            # of a line's words only as many matter as a run needs
            kind = _word_kind(least)
            raw, raw_words, width = h.tobytes(), np.minimum(w, least).astype(kind).tobytes(), kind.itemsize
            bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            columns = [
                batch.column(0), batch.column(1), pa.array([raw[8 * i : 8 * j] for i, j in bounds], pa.binary()),
                pa.array([raw_words[width * i : width * j] for i, j in bounds], pa.binary()),
                pa.ListArray.from_arrays(ends, pa.array(chosen[order].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "hashes", "words", "prints"])
        tidy()

    return run


def _matched_windows(least: int, gram: int):
    """The windows that chose one of their document's repeated fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
            words = batch.column(3).to_pylist()
            kind = _word_kind(least)
            w = np.frombuffer(b"".join(words), kind).astype(np.int64)
            starts = np.concatenate(([0], np.cumsum([len(x) // kind.itemsize for x in words]))).astype(np.int64)
            runs = Runs(h, w, starts)
            a, b, whole, prints, _, _ = windows(runs, least, gram)
            repeated = batch.column(4)
            sizes = repeated.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = _finish(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)) ^ repeated.flatten().to_numpy().view(np.uint64)
            owner = runs.owner[a]
            keep = np.isin(_finish(owner.astype(np.uint64)) ^ prints, wanted)
            # a forward and a backward window may be the same run
            a, b, whole, owner = a[keep], b[keep], whole[keep], owner[keep]
            order = np.lexsort((b, a))
            a, b, whole, owner = a[order], b[order], whole[order], owner[order]
            first = np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b, whole, owner = a[first], b[first], whole[first], owner[first]
            at = starts[owner]
            pick = pa.array(owner)
            columns = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array((a - at).astype(np.int32)), pa.array((b - at).astype(np.int32)), pa.array(whole.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "a", "b", "h"])
        tidy()

    return run


def repeated_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = MIN_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """``(id, mark, runs)``: of each document with repeats, the line ranges [a, b) that came before.

    ``mark`` is a hash of the text: rows of one id and one text are the same document and share one
    fate, rows of one id and different texts are documents in the order of their marks.  A null id
    comes before all others.  A null text has no lines.
    """
    text = text_or_empty(text_column)
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("t"))
    hashed = cut(own.mapInArrow(_hash_lines(least, gram), "id long, mark long, hashes binary, words binary, prints array<long>"))
    # fingerprints go with a hash of their document; two documents that share one are looked at once more
    owner = F.xxhash64("id", "mark")
    prints = hashed.select(owner.alias("owner"), F.explode("prints").alias("print"))
    # cut, so that the join reads its sides as they are dealt and can split a hot fingerprint
    repeated = cut(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    chosen = prints.join(repeated, "print").groupBy("owner").agg(F.collect_set("print").alias("repeated"))
    picked = hashed.select(owner.alias("owner"), "id", "mark", "hashes", "words").join(chosen, "owner").select("id", "mark", "hashes", "words", "repeated")
    found = cut(picked.mapInArrow(_matched_windows(least, gram), "id long, mark long, a int, b int, h long"))
    first = cut(found.groupBy("h").agg(F.min(F.struct("id", "mark", "a")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("a") == F.col("first.a"))
    later = found.join(first, "h").where(~is_first)
    return later.groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("runs"))


def without_runs(text: str, runs: list) -> str:
    """The text without the lines in ``runs``, which may overlap."""
    own, _ = lines(text)
    drop = np.zeros(len(own) + 1, dtype=np.int64)
    for r in runs:
        drop[r["a"]] += 1
        drop[r["b"]] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return "".join([x for x, g in zip(own, gone.tolist(), strict=True) if not g])



def _delete(texts: pd.Series, runs: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or r is None else without_runs(t, r) for t, r in zip(texts, runs, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars", least: int = MIN_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """``docs`` with all later repeated runs deleted from the texts; no row goes.

    A text that is all repeats becomes empty; null texts stay null.  ``length_column``, where the
    frame has it, becomes the new number of characters of texts that changed.
    """
    return _deleted(docs, repeated_runs(docs, id_column, text_column, least, gram), _delete, id_column, text_column, length_column)


def dedup_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars", least: int = MIN_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """As ``dedup_lines``, for repeats that begin and end at any word instead of at lines."""
    from vellum.llm import passages

    def delete(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or r is None else passages.without_words(t, r) for t, r in zip(texts, runs, strict=True)], dtype=object)

    return _deleted(docs, passages.repeated_passages(docs, id_column, text_column, least, gram), delete, id_column, text_column, length_column)


def _deleted(docs: DataFrame, found: DataFrame, delete, id_column: str, text_column: str, length_column: str | None) -> DataFrame:
    id_, mark, runs, new = (free_name(docs, n) for n in ("run_id", "run_mark", "line_runs", "new_text"))
    found = cut(found.select(F.col("id").alias(id_), F.col("mark").alias(mark), F.col("runs").alias(runs)))
    size = found.agg(F.sum(64 + 24 * F.size(runs))).first()[0] or 0
    found = F.broadcast(found) if size <= SENT_BYTES else found
    keys = F.col(id_column).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty(text_column)) == F.col(mark))
    joined = docs.join(found, keys, "left")
    joined = joined.withColumn(new, F.pandas_udf(delete, "string")(F.when(F.col(runs).isNotNull(), F.col(text_column)), F.col(runs)))
    columns = []
    for c in docs.columns:
        if c == text_column:
            columns.append(F.coalesce(new, F.col(c)).alias(c))
        elif c == length_column:
            columns.append(F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their later repeated passages.

    One row per row of the table; null texts stay null, repeated rows lose the same, and extra columns stay.
    """
    docs = table(spark, sf_dir, "documents")
    return dedup_passages(docs.withColumn("old_chars", F.length("text")))
