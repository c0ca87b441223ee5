"""Repeated passages, word by word: winnowing at every word, wherever lines begin.

Wanted is every word of a run of ``MIN_WORDS`` words or more that came before, earlier in the same
document or in one of lower id.  Words are what white space parts, so blank lines and line ends don't
count, and a passage may begin and end inside a line.

1. Winnow.  Of the grams (``GRAM_WORDS`` words) inside each window of ``MIN_WORDS`` words, the least
   hash is kept.  Equal windows keep the same one.
2. Windows whose fingerprint occurs twice are compared by their whole content.  Of equal windows in
   one batch only the first goes on to meet those of other batches, in the order of documents; all
   others came before.  So a passage that half of the corpus repeats costs a row per batch.
3. The windows that came before add up to the words that go.

Windows are equal if their fingerprint and 128 bits of hash agree: two sums of their words' hashes, the
words of the second hashed on their own, modulo 2 ** 64 and with multipliers of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, text_or_empty, tidy
from vellum.llm.linededup import GRAM_WORDS, MIN_WORDS, MIX, UNMIX, _distinct, _finish, _powers

#: Characters of the texts that are hashed at once (a longer text is hashed alone).
AT_ONCE = 4 << 20
WORD = re.compile(r"\S+")
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The second sum's multiplier (odd), its inverse, and the bytes that a window's two hashes take.
MIX_2 = np.uint64(0xD6E8FEB86659FD93)
UNMIX_2 = np.uint64(pow(int(MIX_2), -1, 1 << 64))
WIDE = 16


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:])


class Words:
    """The words of many texts in a row, their grams and windows."""

    def __init__(self, texts: list[str], least: int, gram: int, wide: bool = False) -> None:
        hashed = [np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, t.split())), ">u8").reshape(-1, 2) for t in texts]
        sizes = np.array([len(x) for x in hashed], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.n = int(self.starts[-1])
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.least, self.width = least, least - gram + 1
        if self.n < least:
            return
        both = np.concatenate(hashed).astype(np.uint64)
        self.sums = [self._summed(both[:, k], m, u) for k, m, u in ((1, MIX, UNMIX), (0, MIX_2, UNMIX_2))[: 1 + wide]]
        self.grams = self.hash(gram)
        self.prints = _sliding(self.grams, self.width, np.minimum)
        places = np.arange(self.n - least + 1)
        self.valid = places + least <= self.starts[1:][self.owner[: len(places)]]
        edge = np.zeros(self.width - 1, np.uint64)
        most = _sliding(np.concatenate((edge, np.where(self.valid, self.prints, np.uint64(0)), edge)), self.width, np.maximum)
        #: Places of the grams that are the least of some window.
        self.chosen = np.flatnonzero(most == self.grams)

    def _summed(self, hashes: np.ndarray, mix: np.uint64, unmix: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_finish(hashes) * _powers(mix, self.n)[: self.n], dtype=np.uint64))), _powers(unmix, self.n)

    def hash(self, size: int, which: int = 0) -> np.ndarray:
        """Of the ``size`` words from each on."""
        sums, down = self.sums[which]
        return _finish((sums[size:] - sums[:-size]) * down[: self.n - size + 1] ^ np.uint64(size))

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Places of the windows whose fingerprint is at one of the places ``repeated``."""
        kept = np.full(len(self.grams), NEVER)
        kept[repeated] = self.grams[repeated]
        return np.flatnonzero(self.valid & (_sliding(kept, self.width, np.minimum) == self.prints))


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _fingerprints(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _portions(texts):
                words = Words(texts[i:j], least, gram)
                if words.n < least:
                    continue
                owner, value, times = _distinct(words.owner[words.chosen], words.grams[words.chosen])
                # one that stands twice in its document is listed twice
                at = np.concatenate((np.arange(len(owner)), np.flatnonzero(times > 1)))
                at.sort()
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner[at], minlength=j - i)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(value[at].view(np.int64)))], names=["owner", "prints"])
        tidy()

    return run


def _before(place: list[np.ndarray], prints: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in the order of their places: which are the first of their kind, and which came before.

    A window whose place is the first one's is the same window again (a repeated row): it is neither.
    """
    order = np.lexsort((*hashes, prints))
    p = prints[order]
    other = p[1:] != p[:-1]
    for h in (x[order] for x in hashes):
        other |= h[1:] != h[:-1]
    head = np.concatenate((np.ones(min(1, len(p)), bool), other))
    lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    other = np.zeros(len(order), bool)
    for part in place:
        other |= part[order] != part[lead]
    first, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order], later[order] = head, other
    return first, later


def _heads(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches that ``breaks`` parts n things into."""
    at = np.flatnonzero(breaks) + 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(([0], at)), np.concatenate((at - 1, [n - 1]))) if n else (none, none)


FOUND = ["print", "id", "mark", "at", "upto", "hashes"]


def _windows(least: int, gram: int):
    """Rows of ranges that came before in the same batch (no print), and of windows that others may have had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            # rows of one id and one text are one document
            order = np.lexsort((marks, number, ~nulls))
            ranks = np.empty(len(order), np.int64)
            m, k, z = marks[order], number[order], nulls[order]
            ranks[order] = np.cumsum(np.concatenate(([False], (m[1:] != m[:-1]) | (k[1:] != k[:-1]) | (z[1:] != z[:-1]))))
            texts, listed = batch.column(2).to_pylist(), batch.column(3)
            for i, j in _portions(texts):
                words = Words(texts[i:j], least, gram, wide=True)
                if words.n < least:
                    continue
                mine = listed.slice(i, j - i)
                sizes = mine.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                wanted = _finish(np.repeat(np.arange(j - i), sizes).astype(np.uint64)) ^ mine.flatten().to_numpy().view(np.uint64)
                at = words.chosen
                at = at[np.isin(_finish(words.owner[at].astype(np.uint64)) ^ words.grams[at], wanted)]
                a = words.windows(at)
                owner, prints, hashes = words.owner[a], words.prints[a], [words.hash(least, k)[a] for k in (0, 1)]
                inside = a - words.starts[owner]
                rank = ranks[i + owner]
                by = np.lexsort((inside, rank))
                first, later = np.zeros(len(a), bool), np.zeros(len(a), bool)
                first[by], later[by] = _before([rank[by], inside[by]], prints[by], [h[by] for h in hashes])
                # windows that overlap are one range; those of different documents never do
                went = a[later]
                lo, hi = _heads(np.diff(went) >= least, len(went))
                doc = pa.array(i + owner[later][lo])
                none = pa.nulls(len(lo), pa.int64())
                own = inside[later]
                yield pa.RecordBatch.from_arrays(
                    [none, ids.take(doc), batch.column(1).take(doc), pa.array(own[lo].astype(np.int32)), pa.array((own[hi] + least).astype(np.int32)), pa.nulls(len(lo), pa.binary())], names=FOUND
                )
                sent, p = a[first], prints[first]
                lo, hi = _heads((np.diff(sent) != 1) | (p[1:] != p[:-1]), len(sent))
                doc, raw = pa.array(i + owner[first][lo]), np.stack([h[first] for h in hashes], axis=1).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p[lo].view(np.int64)), ids.take(doc), batch.column(1).take(doc), pa.array(inside[first][lo].astype(np.int32)),
                        pa.nulls(len(lo), pa.int32()), pa.array([raw[WIDE * x : WIDE * y + WIDE] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()),
                    ],
                    names=FOUND,
                )
        tidy()

    return run


def _resolve(least: int):
    """Rows sorted by print, id, mark and place: the ranges that came before.  Those without a print are such ranges already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["print", "null", "id", "mark", "at", "hash", "other"]
        held = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint64)] * 2  # first windows of the print that may go on
        for batch in batches:
            known = batch.column(0).is_null()
            if known.true_count:
                yield batch.filter(known).select(["id", "mark", "at", "upto"])
                batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
            raw = batch.column(5).to_pylist()
            sizes = np.array([len(x) // WIDE for x in raw], dtype=np.int64)
            row = np.repeat(np.arange(len(raw)), sizes)
            ids = batch.column(1)
            step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [
                batch.column(0).to_numpy(zero_copy_only=False)[row], ids.is_null().to_numpy(zero_copy_only=False)[row].astype(np.int64),
                ids.fill_null(0).to_numpy(zero_copy_only=False)[row], batch.column(2).to_numpy(zero_copy_only=False)[row],
                batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)[row] + step, *np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2).T,
            ]
            known = len(held[0])
            every = dict(zip(names, (np.concatenate(x) for x in zip(held, columns, strict=True)), strict=True))
            first, later = _before([every[x] for x in ("null", "id", "mark", "at")], every["print"], [every["hash"], every["other"]])
            keep = first & (every["print"] == every["print"][-1])
            held = [every[x][keep] for x in names]
            later = np.flatnonzero(later[known:])
            at = columns[4][later]
            lo, hi = _heads((row[later][1:] != row[later][:-1]) | (np.diff(at) >= least), len(later))
            doc = pa.array(row[later][lo])
            yield pa.RecordBatch.from_arrays([ids.take(doc), batch.column(2).take(doc), pa.array(at[lo].astype(np.int32)), pa.array((at[hi] + least).astype(np.int32))], names=["id", "mark", "at", "upto"])
        tidy()

    return run


def _merged(ranges: pd.Series) -> pd.Series:
    out = []
    for rows in ranges:
        joined: list[list[int]] = []
        for a, b in sorted((r["at"], r["upto"]) for r in rows):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        out.append([{"a": a, "b": b} for a, b in joined])
    return pd.Series(out, dtype=object)


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = MIN_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """``(id, mark, runs)``: of each document with repeats, the word ranges [a, b) that came before.

    ``mark`` and the order of documents are those of ``linededup.repeated_runs``.
    """
    text = text_or_empty(text_column)
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("t"))
    owner = F.xxhash64("id", "mark")
    prints = cut(own.select(owner.alias("owner"), "t").mapInArrow(_fingerprints(least, gram), "owner long, prints array<long>"))
    prints = prints.select("owner", F.explode("prints").alias("print"))
    # cut, so that the join reads its sides as they are dealt and can split a hot fingerprint
    repeated = cut(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    chosen = prints.join(repeated, "print").groupBy("owner").agg(F.collect_set("print").alias("repeated"))
    picked = own.withColumn("owner", owner).join(chosen, "owner").select("id", "mark", "t", "repeated")
    found = picked.mapInArrow(_windows(least, gram), "print long, id long, mark long, at int, upto int, hashes binary")
    # ranges that a batch has settled go along, dealt by document, so windows are written once
    dealt = found.repartition(F.coalesce("print", F.xxhash64("id", "mark"))).sortWithinPartitions("print", "id", "mark", "at")
    ranges = dealt.mapInArrow(_resolve(least), "id long, mark long, at int, upto int")
    merged = F.pandas_udf(_merged, "array<struct<a: int, b: int>>")
    return ranges.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "upto")).alias("ranges")).select("id", "mark", merged("ranges").alias("runs"))


def without_words(text: str, runs: list) -> str:
    """The text without the words in ``runs``, which don't overlap, and the white space after them.

    Where a run begins inside a line and ends with it, the white space before it goes instead.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for r in sorted((r["a"], r["b"]) for r in runs):
        a, b = r
        start = spans[a][0] if a else 0
        stop = spans[b][0] if b < len(spans) else len(text)
        before = text[spans[a - 1][1] : start] if a else "\n"
        if b < len(spans) and "\n" in text[spans[b - 1][1] : stop] and "\n" not in before:
            start, stop = spans[a - 1][1], spans[b - 1][1]
        out.append(text[done:start])
        done = stop
    out.append(text[done:])
    return "".join(out)
