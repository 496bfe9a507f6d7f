"""Substring deduplication with one FM-index per shard.

A window is a run of consecutive words of one document. The gram of GRAM words
that is least by its hash inside a window is the window's anchor; equal windows
have equal anchors, and neighbouring windows mostly share theirs, so that a
document falls into short passages, each the windows of one anchor. Passages
are dealt to shards by their anchors, which brings all places of a window
together without comparing documents with each other:

1. anchors that occur once are left behind, as no window of theirs can repeat;
2. of equal passages one is fetched from its document, with their number;
3. every shard holds its passages in an FM-index, and streams them against it:
   backward search over the wavelet matrix computes the matching statistics,
   and intervals of a window or more that occur twice are reported;
4. the reports go back to all places of their passages.

Rows are told apart by two hashes of id and text; words are compared by hashes
of 64 bits.

Defined results: a null text has no words; documents shorter than a window lose
nothing; rows that repeat id and text are documents of their own and repeat each
other; null ids are kept; other columns are not read. Windows overlap freely,
also with themselves, and are judged on the input only. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.fmindex import FmIndex, repeated_windows
from lodestrata.llm.scratch import Scratch
from lodestrata.llm.shingles import BASE, CHUNK_BYTES, LETTERS, U, _bytes, _powers, mixed

WINDOW = 35
#: Words of an anchor; a passage has at most WINDOW - GRAM + 1 windows.
GRAM = 8
#: Words of passages in one index, about.
SHARD_WORDS = 1 << 20
#: An anchor with more different passages is dealt out by whole windows.
MOST_PASSAGES = 4096
FOUND = "h long, x long, bits long"


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, where each text's words begin) of about a
    megabyte of texts at a time; words are runs of ``[^\\x20\\x09-\\x0D]``."""
    data, ends = _bytes(texts)
    at = 0
    while at < len(texts):
        stop = min(len(texts), max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1))
        part, edges = data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
        inside = (part != 32) & ((part < 9) | (part > 13))
        edge = np.zeros(len(part) + 1, bool)
        edge[edges] = True
        start = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
        end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
        up, down = _powers(1 << max(20, len(part).bit_length()))
        total = np.concatenate([np.zeros(1, U), np.cumsum(LETTERS[part] * up[: len(part)], dtype=U)])
        yield at, mixed((total[end] - total[start]) * down[start]), np.searchsorted(start, edges)
        at = stop


def _passages(word: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash, passage hash) of the passages of texts
    whose words begin at ``first``; starts count from the first word of all."""
    none = np.zeros(0, np.int64)
    if len(word) < window:
        return none, none, none, none, none
    grams = np.zeros(len(word) - gram + 1, U)
    for k in range(gram):
        grams = grams * BASE + word[k : len(word) - gram + 1 + k]
    grams = mixed(grams)
    wide = window - gram + 1
    anchor = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(1) + np.arange(len(word) - window + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = owner[: len(anchor)] == owner[window - 1 :]
    begins = own & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~own[:-1]])
    start = np.flatnonzero(begins)
    if not len(start):
        return none, none, none, none, none
    count = np.add.reduceat(own.astype(np.int64), start)  # windows that are not own never follow one of their run but end it
    after = start + count + window - 1
    up, down = _powers(1 << max(20, len(word).bit_length()))
    total = np.concatenate([np.zeros(1, U), np.cumsum(word * up[: len(word)], dtype=U)])
    passage = mixed((total[after] - total[start]) * down[start] + count.astype(U))
    return owner[start], start, count, grams[anchor[start]].view(np.int64), passage.view(np.int64)


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.asarray(batch.column(c)) for c in ("u", "v"))
            for at, word, first in hashed_words(batch.column("text")):
                text, start, count, h, x = _passages(word, first, window, gram)
                place = v[at + text] << 38 | count << 32 | (start - first[text])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), pa.array(u[at + text]), pa.array(place)], ["h", "x", "u", "place"])

    return run


def _fetched(window: int):
    """Words of the passages that ``wanted`` names in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            edges, rows = np.asarray(wanted.offsets), wanted.values
            place = np.asarray(rows.field("place"))
            start, size = place & 0xFFFFFFFF, (place >> 32 & 63) + window - 1
            for at, word, first in hashed_words(batch.column("text")):
                a, b = int(edges[at]), int(edges[at + len(first) - 1])
                if a == b:
                    continue
                begin = start[a:b] + np.repeat(first[:-1], np.diff(edges[at : at + len(first)]))
                flat = np.repeat(begin - np.concatenate([[0], np.cumsum(size[a:b])[:-1]]), size[a:b]) + np.arange(int(size[a:b].sum()))
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)), pa.array(word[flat].view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.field(c).slice(a, b - a) for c in ("h", "x", "n", "hot")] + [words], ["h", "x", "n", "hot", "words"])

    return run


def _single_windows(window: int):
    """Passages of crowded anchors as windows: (h, y, x, at, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            edges, word = np.asarray(words.offsets), np.asarray(words.values).view(U)
            size = np.diff(edges) - window + 1
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            begin = edges[:-1][row] + at
            up, down = _powers(1 << max(20, len(word).bit_length()))
            total = np.concatenate([np.zeros(1, U), np.cumsum(word * up[: len(word)], dtype=U)])
            y = mixed((total[begin + window] - total[begin]) * down[begin]).view(np.int64)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("h").take(rows), pa.array(y), batch.column("x").take(rows), pa.array(at), batch.column("n").take(rows)], ["h", "y", "x", "at", "n"])

    return run


def _searched(window: int):
    """One index over the passages of a shard, and what each of them finds in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"h": [], "x": [], "n": [], "words": pa.array([], pa.list_(pa.int64()))})])
        if not table.num_rows:
            return
        passage = np.rec.fromarrays([np.asarray(table.column(c).combine_chunks()) for c in ("h", "x")])
        # two rows that repeat id and text fetch their passages twice
        table = table.take(pa.array(np.unique(passage, return_index=True)[1]))
        words = table.column("words").combine_chunks()
        size = np.diff(np.asarray(words.offsets).astype(np.int64))
        _, symbol = np.unique(np.asarray(words.flatten()), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        text = np.zeros(int((size + 1).sum()), np.int64)
        text[np.arange(len(symbol)) + np.repeat(np.arange(len(size)), size)] = symbol + 1
        index = FmIndex(text, np.asarray(table.column("n").combine_chunks()), int(size.max()))
        bits = repeated_windows(index, text, first, first + size - 1, window)
        met = pa.array(np.flatnonzero(bits))
        yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(met) for c in ("h", "x")] + [pa.array(bits[bits != 0])], ["h", "x", "bits"])

    return run


def _cut(window: int):
    """What is left of every text: words, spans removed, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text").cast(pa.large_binary()), batch.column("found")
            out: dict[str, list] = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
            for text, rows in zip(texts, found, strict=True):
                words = (text.as_py() or b"").split()  # the same six bytes of white space
                keep, spans = np.ones(len(words), bool), []
                if rows.is_valid and len(rows):
                    place, bits = (np.asarray(rows.values.field(c)) for c in ("place", "bits"))
                    start, bit = np.nonzero(bits[:, None] >> np.arange(63) & 1)
                    start = (place & 0xFFFFFFFF)[start] + bit
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + window, -1)
                    keep = np.cumsum(change)[:-1] == 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[1], keep, [1]])))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - int(keep.sum()))
                out["spans"].append(spans)
                out["kept"].append(b" ".join(words if keep.all() else compress(words, keep)).decode())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], span), pa.array(out["kept"], pa.string())], ["doc_id", *out])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, most_passages: int = MOST_PASSAGES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans of words removed, kept): every document
    without the words that a window covers which also starts anywhere else."""
    if not 0 < window - gram + 1 <= 60:
        raise ValueError("a window has as many words as its anchor at least, and 59 more at most")
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    ident = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("u"), F.shiftrightunsigned(F.xxhash64(F.lit("text"), text, "doc_id"), 38).alias("v"))
    places = texts.select("u", "v", "text").mapInArrow(_anchors(window, gram), "h long, x long, u long, place long")

    twice = scratch.keep(places.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    places = scratch.keep(places.join(twice, "h", "left_semi"))
    scratch.drop(twice)
    each = places.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"), F.min_by("place", "u").alias("place"))
    each = scratch.keep(each)
    # written, so that the join can split the rows of a crowded anchor
    crowded = scratch.keep(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most_passages).select("h", F.lit(True).alias("hot")))
    wanted = each.join(crowded, "h", "left").select("u", F.shiftrightunsigned("place", 38).alias("v"), F.struct("place", "h", "x", "n", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = wanted.groupBy("u", "v").agg(F.collect_list("w").alias("wanted"))
    passages = scratch.keep(texts.join(wanted, ["u", "v"]).select("text", "wanted").mapInArrow(_fetched(window), "h long, x long, n long, hot boolean, words array<long>"))
    scratch.drop(each)

    def search(shard: DataFrame, words: int) -> DataFrame:
        return shard.select("h", "x", "n", "words").repartition(max(1, -(-words // shard_words)), "h").mapInArrow(_searched(window), FOUND)

    plain, hot_words = passages.agg(F.sum(F.when(~F.col("hot"), F.size("words"))), F.sum(F.when(F.col("hot"), F.size("words")))).first()
    found = search(passages.where("not hot"), plain or 0)
    if hot_words:
        hot = passages.where("hot").dropDuplicates(["h", "x"])
        single = scratch.keep(hot.select("h", "x", "n", "words").mapInArrow(_single_windows(window), "h long, y long, x long, at long, n long"))
        again = single.groupBy("h", "y").agg(F.sum("n").alias("n"), F.min("x").alias("x"), F.min_by("at", "x").alias("at")).where("n > 1")
        shown = scratch.keep(hot.select("h", "x", "words").join(again, ["h", "x"]).select(F.col("y").alias("h"), F.col("h").alias("x"), "n", F.slice("words", F.col("at").cast("int") + 1, window).alias("words")))
        sure = search(shown, window * shown.count()).select(F.col("x").alias("h"), F.col("h").alias("y"))
        found = found.unionByName(single.join(sure, ["h", "y"], "left_semi").groupBy("h", "x").agg(F.bit_or(F.expr("shiftleft(1L, int(at))")).alias("bits")))
    found = scratch.keep(found)

    gone = places.join(found, ["h", "x"]).select("u", F.shiftrightunsigned("place", 38).alias("v"), F.struct("place", "bits").alias("w"))
    gone = scratch.only(gone.groupBy("u", "v").agg(F.collect_set("w").alias("found")))
    return texts.join(gone, ["u", "v"], "left").select("doc_id", "text", "found").mapInArrow(_cut(window), f"doc_id {ident}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
