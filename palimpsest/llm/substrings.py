"""Substring dedup with repeated-phrase automata.

Three rounds over durable blocks of documents (see ``blocks``):

1. *Candidates.* Of the k-word phrases inside a window the one of least hash is the window's anchor, so equal windows
   have equal anchors, and a window whose anchor occurs once in the corpus cannot repeat. Only anchors travel.
2. *Confirmation.* Windows over recurring anchors are counted over the whole corpus by 128-bit fingerprint.
3. *Location.* The confirmed windows of a block are reduced to covering phrases, which are compiled to one
   Aho-Corasick automaton for each block (the shard: its size is bounded by the block's), over word ids; all documents
   of the block stream through it, and every word under an occurrence goes.

A phrase that is common to a third of all documents reaches a bucket once for each block.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import blocks as B
from palimpsest.llm.rolling import Words, sliding_min, starts_in_row, windows
from palimpsest.llm.shared import durable

WINDOW = 35
ANCHOR = 8
ASKED = "bucket long, block string, kind int, keys binary, more binary, flags binary"
ANSWERED = "block string, bucket long, kind int, payload binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Each document without the words of repeated windows: ``doc_id, n_words, n_removed, kept_text``.

    A window is ``window`` consecutive words of one document; each word is removed that is covered by a window whose
    words also start anywhere else in the corpus, the same document included. Kept words are joined by one space.
    A null or empty text has no words and gives an empty kept text; texts shorter than a window are kept whole; a
    repeated row repeats its windows; null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    anchor = min(anchor, window)
    span = window - anchor + 1
    blocks = B.build(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    buckets = blocks.buckets()

    def first(block: str, rows: pa.Table, _: None) -> pa.Table:
        _, grams, valid, chosen = _anchors(rows, window, anchor, span)
        values, counts = np.unique(grams[valid], return_counts=True)
        keys = np.unique(chosen)
        return _dealt(block, 1, buckets, keys, None, counts[np.searchsorted(values, keys)] > 1 if len(keys) else np.zeros(0, bool))

    def second(block: str, rows: pa.Table, said: pa.Table) -> pa.Table:
        keys, more, counts, _, _ = _candidates(rows, said, window, anchor, span)
        return _dealt(block, 2, buckets, keys, more, counts > 1)

    def third(block: str, rows: pa.Table, said: pa.Table) -> pa.Table:
        keys, _, _, inverse, (words, positions) = _candidates(rows, said, window, anchor, span)
        confirmed = np.zeros(len(keys), bool)
        bucket = keys % np.uint64(buckets)
        for b, kind, payload in zip(said["bucket"].to_pylist(), said["kind"].to_pylist(), said["payload"].to_pylist(), strict=True):
            if kind == 2:
                at = np.flatnonzero(bucket == np.uint64(b))
                confirmed[at] = np.unpackbits(np.frombuffer(payload, np.uint8), count=len(at)).astype(bool)
        starts = positions[confirmed[inverse]] if len(keys) else positions[:0]
        return _without(rows, words, _located(words, starts, window))

    asked = B.ask(blocks, first, ASKED)
    anchors = durable(B.answer(asked, _recurring_keys, ANSWERED).unionByName(blocks.df.selectExpr("block", "-1L AS bucket", "0 AS kind", "CAST('' AS binary) AS payload")))
    confirmed = B.answer(B.ask(blocks, second, ASKED, anchors), _recurring_bits, ANSWERED)
    return B.resolve(blocks, anchors.unionByName(confirmed), third, RESULT)


def _anchors(rows: pa.Table, window: int, anchor: int, span: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words; all phrases' hashes; which phrases are of one document; the anchors of all windows, in order."""
    words = Words(rows["text"])
    grams = windows(words.hashes(1), anchor, 1)
    chosen = sliding_min(grams, span)
    return words, grams, starts_in_row(words, anchor), chosen[starts_in_row(words, window)]


def _candidates(rows: pa.Table, said: pa.Table, window: int, anchor: int, span: int):
    """Distinct 128-bit fingerprints of windows over recurring anchors, in order: halves, counts, each window's index, where windows are."""
    words, _, _, chosen = _anchors(rows, window, anchor, span)
    at = np.flatnonzero(starts_in_row(words, window))
    recurring = [np.frombuffer(p, np.uint64) for p, kind in zip(said["payload"].to_pylist(), said["kind"].to_pylist(), strict=True) if kind == 1]
    recurring = np.sort(np.concatenate(recurring)) if recurring else np.zeros(0, np.uint64)
    if len(recurring) and len(at):
        near = np.minimum(np.searchsorted(recurring, chosen), len(recurring) - 1)
        at = at[recurring[near] == chosen]
    else:
        at = at[:0]
    left = windows(words.hashes(1), window, 2)[at] if len(at) else np.zeros(0, np.uint64)
    right = windows(words.hashes(3), window, 4)[at] if len(at) else np.zeros(0, np.uint64)
    first, inverse, counts = distinct(left, right)
    return left[first], right[first], counts, inverse, (words, at)


def distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of halves: an index of each distinct pair in order, each row's place among these, and their counts."""
    order = np.argsort(left)
    a, b = np.take(left, order), np.take(right, order)
    new = np.ones(len(order), bool)
    new[1:] = a[1:] != a[:-1]
    if (~new[1:] & (b[1:] != b[:-1])).any():  # equal left halves with different right ones, which hardly ever happens
        order = np.lexsort((right, left))
        a, b = left[order], right[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse, np.diff(np.append(np.flatnonzero(new), len(order)))


def _dealt(block: str, kind: int, buckets: int, keys: np.ndarray, more: np.ndarray | None, flags: np.ndarray) -> pa.Table:
    """A row for each bucket that any of the sorted keys falls in."""
    bucket = keys % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1)), len(order))
    out = {"bucket": [], "keys": [], "more": [], "flags": []}
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[lo:hi]
        out["bucket"].append(int(bucket[at[0]]))
        out["keys"].append(keys[at].tobytes())
        out["more"].append(more[at].tobytes() if more is not None else b"")
        out["flags"].append(np.packbits(flags[at]).tobytes())
    n = len(out["bucket"])
    return pa.table(
        [pa.array(out["bucket"], pa.int64()), pa.array([block] * n, pa.string()), pa.array([kind] * n, pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("keys", "more", "flags"))],
        names=["bucket", "block", "kind", "keys", "more", "flags"],
    )


def _gathered(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys = [np.frombuffer(x, np.uint64) for x in asked["keys"].to_pylist()]
    more = [np.frombuffer(x, np.uint64) for x in asked["more"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(k)).astype(bool) for f, k in zip(asked["flags"].to_pylist(), keys, strict=True)]
    all_keys = np.concatenate(keys)
    return all_keys, np.concatenate(more) if len(more[0]) else np.zeros_like(all_keys), np.concatenate(flags), np.cumsum([0, *map(len, keys)])


def _recurs(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a bucket's keys occur in two places or more: in two blocks, or flagged by one."""
    keys, more, flags, cuts = _gathered(asked)
    _, inverse, counts = distinct(keys, more)
    flagged = np.bincount(inverse, weights=flags, minlength=len(counts)) > 0
    return keys, ((counts > 1) | flagged)[inverse], cuts


def _answers(asked: pa.Table, kind: int, payloads: list[bytes]) -> pa.Table:
    n = len(payloads)
    return pa.table([asked["block"].combine_chunks(), asked["bucket"].combine_chunks(), pa.array([kind] * n, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "bucket", "kind", "payload"])


def _recurring_keys(asked: pa.Table) -> pa.Table:
    keys, recurs, cuts = _recurs(asked)
    return _answers(asked, 1, [keys[lo:hi][recurs[lo:hi]].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])


def _recurring_bits(asked: pa.Table) -> pa.Table:
    _, recurs, cuts = _recurs(asked)
    return _answers(asked, 2, [np.packbits(recurs[lo:hi]).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])


def _located(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether each word is under an occurrence of a phrase that confirmed windows, given by their first words, are covered by."""
    n = len(words.starts)
    if not len(starts):
        return np.zeros(n, bool)
    # Windows that follow one another cover what every window-th of them and the last one cover.
    new = np.diff(starts, prepend=-2) != 1
    run = np.cumsum(new) - 1
    begin = starts[new][run]
    last = np.append(new[1:], True)
    chosen = starts[((starts - begin) % window == 0) | last]
    _, ids = np.unique(words.hashes(1), return_inverse=True)
    ids = ids + 1
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for start in chosen.tolist():
        automaton.add_word(tuple(ids[start : start + window].tolist()))
    automaton.make_automaton()
    # One stream for the block: a 0 stands between documents and is in no phrase.
    place = np.arange(n) + words.rows()
    stream = np.zeros(n + len(words.n), np.int64)
    stream[place] = ids
    ends = np.fromiter((end for end, _ in automaton.iter(tuple(stream.tolist()))), np.int64)
    depth = np.zeros(len(stream) + 1, np.int64)
    np.add.at(depth, ends + 1, -1)
    np.add.at(depth, ends + 1 - window, 1)
    return np.cumsum(depth)[place] > 0


def _without(rows: pa.Table, words: Words, covered: np.ndarray) -> pa.Table:
    """Documents of the block without covered words."""
    keep = ~covered
    starts, sizes = words.starts[keep], (words.ends - words.starts)[keep] + 1  # a word and the separator that follows it
    before = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    index = np.repeat(starts - before, sizes) + np.arange(total)
    text = words.data[index]
    text[before + sizes - 1] = 0x20
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    low, high = kept_before[words.first[:-1]], kept_before[words.first[1:]]
    offsets = np.append(before, total)
    raw = text.tobytes()
    kept = [raw[a : b - 1].decode() if b > a else "" for a, b in zip(offsets[low].tolist(), offsets[high].tolist(), strict=True)]
    return pa.table(
        [rows["doc_id"].combine_chunks(), pa.array(words.n, pa.int64()), pa.array(words.n - (high - low), pa.int64()), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_text"],
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
