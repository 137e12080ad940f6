"""LM scoring: a causal self-attention model on subword ids, and the counts that it is held against.

Texts are read once, and their words hashed once.

Words. Counts over the whole training part are exact: blocks of documents exchange their distinct words with buckets (see
``blocks``); they give the base score and nothing of the model's.

Subword ids. Texts are segmented once, into a table dealt by round. Counts of all training ids become the network's biases
(see ``attention``); then every round sums the network's gradients over all windows of its share of the training texts,
which are dealt by id, and takes one step. So every training id is learned from, and once; sums don't depend on how rows are
partitioned, and so neither do the scores, but for the rounding of sums. ``score`` is the network's alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import attention as A
from palimpsest.llm import blocks as B
from palimpsest.llm.pieces import MODEL, loaded
from palimpsest.llm.rolling import Words
from palimpsest.llm.shared import durable, numbered, released, shared_folder
from palimpsest.llm.substrings import distinct

#: Larger blocks than the default have fewer distinct words in all.
BLOCK_BYTES = 4 << 20
#: Words that a task keeps the ids of: some 50 MB.
SEGMENTS = 1 << 20
ROUNDS, RATE = 16, 0.1
BEGIN, END = 1, 2
ANSWERED = "block string, bucket long, counts binary, known long, words long"
BASE = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"
IDS = "payload binary, block string, bucket long, more binary, counts binary, round int"
#: The round of counts of ids, that of texts that are not for training, those of blocks' texts as places of their distinct words
#: and of what these ask the buckets.
COUNTS, HELD, PLACES, ASKED = -1, ROUNDS, -2, -3


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id's decimal text leaves 2 modulo 7; no id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


@dataclass
class _Read:
    """A block's texts: words, which are for training, distinct words and each word's place among these."""

    words: Words
    training: np.ndarray
    keys: np.ndarray
    more: np.ndarray
    inverse: np.ndarray
    sample: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> _Read:
        words = Words(rows["text"], lower=True)
        left, right = words.hashes(21), (words.hashes(22) >> np.uint64(32)).astype(np.uint32)
        first, inverse, _ = distinct(left, right)
        return cls(words, ~np.array([held_out(x) for x in rows["doc_id"].to_pylist()], bool), left[first], right[first], inverse, first)

    def counts(self) -> np.ndarray:
        """Of distinct words, in texts for training."""
        return np.bincount(self.inverse, weights=self.training[self.words.rows()], minlength=len(self.keys)).astype(np.int64)

    def subwords(self, known: Segments) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with an end; how many each text has."""
        raw = self.words.data.tobytes()
        starts, ends = self.words.starts[self.sample], self.words.ends[self.sample]
        first, sizes, flat = known.of(self.keys, self.more, lambda at: [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        # Tokens in order: the words of a text, then its end, which has one id kept behind those of words.
        n = self.words.n
        of_token = np.full(int(n.sum()) + len(n), len(sizes), np.int32)
        of_token[np.arange(int(n.sum())) + self.words.rows()] = self.inverse
        first, sizes, flat = np.append(first, len(flat)), np.append(sizes, 1), np.append(flat, np.int32(END))
        per_token = sizes[of_token]
        # Where an id stands is its place in the stream, moved by as much as its token is.
        moved = first[of_token] - (np.cumsum(per_token) - per_token)
        stream = np.take(flat, np.repeat(moved, per_token) + np.arange(int(per_token.sum())))
        per_text = np.add.reduceat(per_token, np.cumsum(n + 1) - (n + 1)) if len(n) else np.zeros(0, np.int64)
        return stream, per_text


class Segments:
    """Ids of the words that a task has met, by 96 bits of hash; begun anew when it holds too many."""

    def __init__(self, model_file: str, most: int = SEGMENTS):
        self.pieces, self.most = loaded(model_file), most
        self.clear()

    def clear(self) -> None:
        self.keys, self.more = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.first, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _at(self, keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are, and whether they are there. Words whose first halves are the same share a place, and have none."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.more[at] == more)

    def of(self, keys: np.ndarray, more: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of distinct words begin in an array of ids, how many each has, and that array."""
        if len(self.keys) > self.most:
            self.clear()
        at, there = self._at(keys, more)
        missing = np.flatnonzero(~there)
        if not len(missing):
            return self.first[at], self.sizes[at], self.flat
        flat, sizes = self.pieces.segment_words(words(missing))
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        first, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        first[there], size[there] = self.first[at[there]], self.sizes[at[there]]
        first[missing], size[missing] = begins, sizes
        self.flat = np.concatenate([self.flat, flat])
        all_keys = np.concatenate([self.keys, keys[missing]])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.more = all_keys[order], np.concatenate([self.more, more[missing]])[order]
        self.first, self.sizes = np.concatenate([self.first, begins])[order], np.concatenate([self.sizes, sizes])[order]
        return first, size, self.flat


def score(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for all rows.

    Tokens are lower-cased words and one end for each text. The base score sums log10((c + 1) / (N + V + 1)) with counts of
    the training part; the score is the log10 probability of the text's subword ids and its end by the attention model. A
    null or empty text is an end alone; null ids count as held in by the empty text's checksum; repeated rows count each by
    itself; texts of any length are scored whole; other columns are ignored; an empty table gives no rows. With an empty
    training part the model is untrained and every count is 0.
    """
    model_file = model_file or public_tokenizers.path(MODEL)
    rows, row = numbered(docs.select("doc_id", "text"))
    rows = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = B.Blocks(rows, n_bytes, 0).buckets()
    ids = _segmented(rows, model_file, buckets)
    base = durable(_base(rows, ids))
    size = loaded(model_file).model.get_piece_size()
    vocabulary = rows.sparkSession.sparkContext.broadcast(_vocabulary(ids, size))  # its size is the vocabulary's, not the corpus's
    weights = _trained(ids, vocabulary)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["payload"]:
                numbers, lengths, stream = _unpacked(blob.as_buffer())
                by_id = A.log10_probabilities(weights, vocabulary.value, stream, lengths, BEGIN)
                total = np.add.reduceat(by_id, np.cumsum(lengths) - lengths)  # no text is without an end
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(total, pa.float64())], ["row", "score"])

    judged = durable(ids.filter(F.col("round").between(0, HELD)).select("payload").mapInArrow(judge, "row long, score double"))
    vocabulary.unpersist()
    return base.join(judged, "row").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _base(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """What counts of words say: BASE and ``train_tokens``."""
    blocks = B.Blocks(ids.filter(F.col("round") == PLACES).select("block", F.col("payload").alias("blob")), 0, 0)
    asked = ids.filter(F.col("round") == ASKED).select("bucket", "block", F.col("payload").alias("keys"), "more", "counts")

    def reply(asked: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in asked["keys"].to_pylist()]
        more = np.concatenate([np.frombuffer(x, np.uint32) for x in asked["more"].to_pylist()])
        opened = zstandard.ZstdDecompressor()
        counts = np.concatenate([np.frombuffer(opened.decompress(x), np.int32) for x in asked["counts"].to_pylist()])
        _, inverse, _ = distinct(np.concatenate(keys), more)
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        cuts, press = np.cumsum([0, *map(len, keys)]), zstandard.ZstdCompressor(level=1)
        said = [press.compress(total[inverse[lo:hi]].tobytes()) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        nothing = [0] * (len(keys) - 1)
        known, words = [int((total > 0).sum()), *nothing], [int(total.sum()), *nothing]
        return pa.table([asked["block"].combine_chunks(), asked["bucket"].combine_chunks(), pa.array(said, pa.binary()), pa.array(known, pa.int64()), pa.array(words, pa.int64())], names=["block", "bucket", "counts", "known", "words"])

    none = blocks.df.selectExpr("block", "-1L AS bucket", "CAST('' AS binary) AS counts", "0L AS known", "0L AS words")
    answers = durable(B.answer(asked, reply, ANSWERED).unionByName(none))
    for_training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    n_texts = rows.filter(for_training).count()
    sums = answers.agg(F.sum("known").alias("known"), F.sum("words").alias("words")).first()
    total = (sums.words or 0) + n_texts
    floor = float(total + (sums.known or 0) + (n_texts > 0) + 1)

    def finish(block: str, rows: pa.Table, said: pa.Table) -> pa.Table:
        press, lists = zstandard.ZstdDecompressor(), rows["words"].combine_chunks()
        # Distinct words are in the order of buckets.
        got = {b: np.frombuffer(press.decompress(x), np.int64) for b, x in zip(said["bucket"].to_pylist(), said["counts"].to_pylist(), strict=True) if b >= 0}
        counts = np.concatenate([np.zeros(0, np.int64), *(got[b] for b in sorted(got))])
        n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        token = np.full(int(n.sum()) + len(n), len(counts), np.int64)
        token[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = lists.flatten().to_numpy()
        c = np.append(counts, n_texts)[token]
        text = np.repeat(np.arange(len(n)), n + 1)
        known, base = (np.bincount(text, weights=x, minlength=len(n)) for x in (c > 0, np.log10((c + 1) / floor)))
        return pa.table(
            [rows["row"].combine_chunks(), rows["doc_id"].combine_chunks(), pa.array(rows["held_out"].to_pylist(), pa.bool_()), pa.array(n + 1, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base, pa.float64())],
            names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"],
        )

    scored = B.resolve(blocks, answers.select("block", "bucket", "counts"), finish, BASE)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def _block(read: _Read, table: pa.Table, buckets: int) -> list[tuple]:
    """IDS rows that the counts of words need of a block: its texts, and the distinct words that each bucket is asked about."""
    press = zstandard.ZstdCompressor(level=1)
    block, counts, bucket = uuid.uuid4().hex, read.counts(), (read.keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(read.words.n)), pa.int32()), pa.array(np.take(place, read.inverse), pa.int32()))
    texts = pa.table([table["row"].combine_chunks(), table["doc_id"].combine_chunks(), pa.array(~read.training), words], names=["row", "doc_id", "held_out", "words"])
    out = [(B.pack(texts), block, None, None, None, PLACES)]
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[lo:hi]
        out.append((read.keys[at].tobytes(), block, int(bucket[at[0]]), read.more[at].tobytes(), press.compress(counts[at].astype(np.int32).tobytes()), ASKED))
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of IDS."""
    kinds = {"payload": pa.binary(), "block": pa.string(), "bucket": pa.int64(), "more": pa.binary(), "counts": pa.binary(), "round": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def _segmented(rows: DataFrame, model_file: str, buckets: int) -> DataFrame:
    """IDS, a folder for each round: packed texts as ids, and counts of the ids of training texts; what counts of words need.

    Each text is read and its words are hashed here, and nowhere else.
    """
    size = loaded(model_file).model.get_piece_size()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n_bytes, counts, known = 0, np.zeros(size, np.int64), Segments(model_file)

        def told() -> pa.RecordBatch:
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            read = _Read.of(table)
            stream, lengths = read.subwords(known)
            np.add(counts, np.bincount(stream[np.repeat(read.training, lengths)], minlength=size), out=counts)
            deal = np.array([round_of(x) for x in table["doc_id"].to_pylist()], np.int64)
            deal[~read.training] = HELD
            numbers, first, kind = table["row"].to_numpy(), np.cumsum(lengths) - lengths, _kept_as(size)
            out = _block(read, table, buckets)
            for r in np.unique(deal).tolist():
                mine = np.flatnonzero(deal == r)
                n = lengths[mine]
                place = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                texts = pa.table([pa.array([numbers[mine].tobytes(), n.tobytes(), np.take(stream, place).astype(kind).tobytes()], pa.binary())], names=["x"])
                out.append((B.pack(texts), None, None, None, None, r))
            return _rows(out)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.cumsum(pa.compute.binary_length(table["text"].fill_null("").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)) if table.num_rows else np.zeros(0, np.int64)
            start = 0
            while start < table.num_rows:
                before = int(sizes[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES - n_bytes, "right")))
                held.append(table.slice(start, stop - start))
                n_bytes += int(sizes[stop - 1]) - before
                start = stop
                if n_bytes >= BLOCK_BYTES or start < table.num_rows:
                    yield told()
                    n_bytes = 0
                    released()
        if held:
            yield told()
        if counts.any():
            yield _rows([(counts.tobytes(), None, None, None, None, COUNTS)])

    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    rows.mapInArrow(run, IDS).write.partitionBy("round").option("compression", "none").parquet(path)
    return rows.sparkSession.read.schema(IDS).parquet(path)


def round_of(doc_id: int | None) -> int:
    return zlib.crc32(b"round:" if doc_id is None else f"round:{doc_id}".encode()) % ROUNDS


def _kept_as(size: int) -> type:
    """Ids of a vocabulary of so many pieces are kept in two bytes if they fit."""
    return np.int16 if size <= 1 << 15 else np.int32


def _unpacked(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, lengths, and ids of packed texts."""
    numbers, lengths, stream = B.unpack(blob)["x"].to_pylist()
    numbers, lengths = np.frombuffer(numbers, np.int64), np.frombuffer(lengths, np.int64)
    kind = np.int16 if len(stream) == 2 * int(lengths.sum()) else np.int32
    return numbers, lengths, np.frombuffer(stream, kind).astype(np.int32)


def _training(ids: DataFrame) -> DataFrame:
    return ids.filter(F.col("round").between(0, ROUNDS - 1)).select("payload")


def _summed(rows: DataFrame, function: Callable[[pa.Buffer], np.ndarray], size: int) -> np.ndarray:
    """The sum of what a function gives of each payload, an array of so many numbers, in a tree of tasks."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            for blob in batch["payload"]:
                total, n = total + function(blob.as_buffer()), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["payload"])

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(blob.as_buffer(), np.float64) for batch in batches for blob in batch["payload"]), np.zeros(size))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["payload"])

    parts = rows.mapInArrow(add, "payload binary")
    width = max(1, isqrt(rows.rdd.getNumPartitions()))
    got = parts.repartition(width).mapInArrow(again, "payload binary").collect()  # a model's size for each of the few
    return sum((np.frombuffer(r.payload, np.float64) for r in got), np.zeros(size))


def _counted(rows: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all training texts, of which there are no more than contexts times ids, and how often each occurs."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        fresh = 0
        for batch in batches:
            for blob in batch["payload"]:
                _, lengths, stream = _unpacked(blob.as_buffer())
                found, n = np.unique(keys_of(stream, lengths), return_counts=True)
                keys.append(found)
                counts.append(n)
                fresh += len(found)
                if fresh > 1 << 21:
                    keys, counts, fresh = *_merged(keys, counts), 0
        keys, counts = _merged(keys, counts)
        for low in range(0, len(keys[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][low : low + (1 << 16)]), pa.array(counts[0][low : low + (1 << 16)])], ["key", "n"])

    # Few tasks, each with many payloads: a key is then told a few times, not once for each small file.
    few = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return found["key"].to_numpy(), found["n"].to_numpy()


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return [found], [np.bincount(inverse, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)]


def _vocabulary(ids: DataFrame, size: int) -> A.Vocabulary:
    """Contexts from counts of ids, classes from counts of pairs, and biases from counts of threes; of all training texts."""
    counts = _summed(ids.filter(F.col("round") == COUNTS).select("payload"), lambda blob: np.frombuffer(blob, np.int64).astype(np.float64), size)
    context = A.contexts_of(counts)

    def after(stream: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        before = np.empty_like(stream)
        before[1:] = stream[:-1]
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = BEGIN
        return context[before].astype(np.int64) * size + stream

    keys, n = _counted(_training(ids), after)
    classes = A.classes_of(counts, keys, n)
    bare = A.Vocabulary(context, classes, *[np.zeros(0, np.float32)] * 5)

    def threes(stream: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        _, row, of = bare.read(stream, lengths, BEGIN)
        return row.astype(np.int64) * A.CLASSES + of

    found, many = _counted(_training(ids), threes)
    pairs = np.zeros(A.CONTEXTS * A.CLASSES * A.CLASSES)
    pairs[found] = many
    return A.Vocabulary.of(counts, context, classes, keys, n, pairs)


def _trained(ids: DataFrame, vocabulary) -> dict[str, np.ndarray]:
    """One step a round along the mean gradient over all windows of the round's texts."""
    weights = A.start()
    steps = A.Adam(RATE, ROUNDS)
    size = len(A.flat(weights))
    for number in range(ROUNDS):

        def learn(blob: pa.Buffer, p=weights) -> np.ndarray:
            _, lengths, stream = _unpacked(blob)
            return A.epoch(p, vocabulary.value, stream, lengths, BEGIN)

        got = _summed(ids.filter(F.col("round") == number).select("payload"), learn, size + 2)
        if got[-1]:
            weights = steps.stepped(weights, got[:size] / got[-1])
    return weights


def op5(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
