"""SentencePiece encoding and decoding with a distinct-chunk table.

In the model's normal form spaces are markers, and no piece has a marker after another character. So a text falls into
chunks - a run of markers with the word that follows it - that pieces never cross. Blocks of documents send their distinct
chunks to buckets, which make up the table: a bucket segments each distinct chunk once, and decodes it once, and answers
every block that has it. Block and answers meet again, and ids are joined back to texts by position. A third of all
words being one word, it reaches its bucket once for each block. Blocks are cut anew from the scan where they are needed
again, so that texts move once, compressed.

A bucket is asked by no more than ``ASKERS`` blocks; beyond that many there are several tables, each for its own blocks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import blocks as B
from palimpsest.llm.shared import numbered, partitions, released

MODEL = "piece_bpe_32k.model"
MARK = "▁"
BLOCK_BYTES = 4 << 20
#: Bytes of text that a bucket holds the distinct chunks of, and blocks that one table answers.
BUCKET_BYTES, ASKERS = 8 << 20, 4096
ASKED = "bucket int, part int, block string, chunks binary"
ANSWERED = "block string, bucket int, sizes binary, ids binary, other array<struct<at:int,text:string>>"


class Pieces:
    """Encodes and decodes whole texts exactly as the library does."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross word markers; encode whole texts instead")
        self.marker = self.model.piece_to_id(MARK)
        #: Ids are kept in two bytes if they fit.
        self.kept_as = np.int16 if len(pieces) <= 1 << 15 else np.int32
        #: Which pieces begin with a marker, and which are nothing but markers.
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        self.blank = np.array([not p.strip(MARK) for p in pieces])
        #: Pieces that are not decoded to their own characters.
        self.special = np.array([self.model.is_unknown(i) or self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unused(i) for i in range(len(pieces))])
        #: Each id in decimal digits and a comma, and how many bytes that is.
        said = [f"{i},".encode() for i in range(len(pieces))]
        self.width = np.array([len(x) for x in said])
        self.digits = np.frombuffer(b"".join(x.ljust(self.width.max()) for x in said), np.uint8).reshape(len(said), -1)

    def segment_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, each after the one space that stands for its marker, and how many each has."""
        ids, sizes = [], []
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            found = np.array(self.model.encode(" ".join(part)), np.int32)
            edge = np.flatnonzero(self.opens[found[1:]] & ~self.blank[found[:-1]]) + 1
            if len(edge) != len(part) - 1 or any(MARK in w for w in part):  # a marker that stands in a word itself
                each = self.model.encode(part)
                found, edge = np.array(list(chain.from_iterable(each)), np.int32), np.cumsum([len(x) for x in each])[:-1]
            ids.append(found)
            sizes.append(np.diff(edge, prepend=0, append=len(found)))
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *ids]), np.concatenate([none, *sizes]).astype(np.int64)

    def _segment(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct chunks. Many go to the library as one text, which is cheaper than one by one."""
        words, out = [c for c in chunks if c[-1] != " "], {}
        for start in range(0, len(words), 512):
            part = words[start : start + 512]
            # The library puts a marker before what it is given, so the text goes without its first one.
            ids = self.model.encode("".join(part)[1:])
            at = np.array(ids)
            edge = [0, *(np.flatnonzero(self.opens[at[1:]] & ~self.blank[at[:-1]]) + 1).tolist(), len(ids)]
            for chunk, lo, hi in zip(part, edge[:-1], edge[1:], strict=True):
                out[chunk] = tuple(ids[lo:hi])
        for chunk in chunks:
            if chunk[-1] == " ":  # markers at the end of a text
                out[chunk] = tuple(self.model.encode(chunk[1:])) if len(chunk) > 1 else (self.marker,)
        return out

    def read(self, chunks: Iterable[str]) -> dict[str, tuple[tuple[int, ...], str]]:
        """Ids of chunks, and what these are decoded to amid a text, where a marker at the beginning stays."""
        chunks = list(dict.fromkeys(chunks))
        ids, before = self._segment(chunks), self.model.encode("x")
        texts = self.model.decode([[*before, *ids[c]] for c in chunks]) if chunks else []
        return {c: (ids[c], text[1:]) for c, text in zip(chunks, texts, strict=True)}

    def table(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
        """The same in arrays, of chunks that end in a word: their ids one after another, how many each has, and what those
        are decoded to, by their places, that are not decoded to themselves.
        """
        none, before = np.zeros(0, np.int32), self.model.encode("x")
        flat, sizes, new = [none], [none], {}
        for start in range(0, len(chunks), 512):
            part = chunks[start : start + 512]
            ids = self.model.encode("".join(part)[1:])
            at = np.array(ids, np.int32)
            edge = np.flatnonzero(self.opens[at[1:]] & ~self.blank[at[:-1]]) + 1
            if len(edge) != len(part) - 1:
                raise ValueError("the library's pieces don't fall apart into chunks")
            size = np.diff(edge, prepend=0, append=len(at))
            odd = np.add.reduceat(self.special[at].astype(np.int32), np.append(0, edge)) > 0
            # Without special pieces only a chunk's first ones have markers, so if all together are themselves, each is.
            plain = [*before, *at[~np.repeat(odd, size)].tolist()]
            if self.model.decode(plain) != "x" + "".join(c for c, x in zip(part, odd.tolist(), strict=True) if not x):
                odd[:] = True
            apart, ends = np.flatnonzero(odd).tolist(), np.cumsum(size).tolist()
            texts = self.model.decode([[*before, *ids[ends[i] - int(size[i]) : ends[i]]] for i in apart]) if apart else []
            new |= {start + i: text[1:] for i, text in zip(apart, texts, strict=True) if text[1:] != part[i]}
            flat.append(at)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes).astype(np.int64), new

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        """The text of each list of ids, as the library's ``decode(ids)``."""
        return [self._decode(x) for x in ids]

    def _decode(self, ids: Sequence[int]) -> str:
        return self.model.decode(list(ids))


_CHUNK = re.compile(" *[^ ]+| +")


def _chunks(text: str) -> list[str]:
    """Chunks of the normal form, with spaces for markers. The empty text has none."""
    if not text:
        return []
    text = " " + text.replace(MARK, " ")
    if "  " in text or "\0" in text or text[-1] == " ":
        return _CHUNK.findall(text)
    return (" " + text[1:].replace(" ", "\0 ")).split("\0")


@lru_cache(maxsize=2)
def loaded(model_file: str) -> Pieces:
    return Pieces(model_file)


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, ids``: the pieces of each whole text, as the library encodes it without begin or end ids and without sampling.

    A null or empty text has no ids; null ids of documents and repeated rows stay as they are; a text of any length is
    encoded whole; other columns are ignored; an empty table gives no rows.
    """
    return _joined(docs, model_file, ["ids"])


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text, and a null among ids is passed over."""
    model_file = model_file or public_tokenizers.path(MODEL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            texts = loaded(model_file).decode([[i for i in x or () if i is not None] for x in batch["ids"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("CAST(doc_id AS long) AS doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for.

    Edge cases are those of ``encode`` and ``decode``.
    """
    return _joined(docs, model_file, ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)


_KINDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}


def _joined(docs: DataFrame, model_file: str | None, wanted: list[str]) -> DataFrame:
    """``doc_id`` and wanted columns, through the distinct-chunk table."""
    model_file = model_file or public_tokenizers.path(MODEL)
    rows, _ = numbered(docs.select("doc_id", "text"))  # a scan, or what was written to be one
    rows = rows.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * partitions(docs.sparkSession), -(-n_bytes // BUCKET_BYTES))
    parts = -(-n_bytes // (ASKERS * BLOCK_BYTES)) or 1
    blocks = B.cut(rows, BLOCK_BYTES).select("block", "blob")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["blob"], strict=True):
                dealt = _dealt((_chunks(x or "") for x in B.unpack(blob.as_buffer())["text"].to_pylist()), buckets)
                part = zlib.crc32(block.encode()) % parts
                # Chunks one after another fall apart into the same chunks.
                packed = [press.compress("".join(chunks).encode()) for chunks in dealt.values()]
                columns = [pa.array(list(dealt), pa.int32()), pa.array([part] * len(dealt), pa.int32()), pa.array([block] * len(dealt), pa.string()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "part", "block", "chunks"])
                released()

    def reply(asked: pa.Table) -> pa.Table:
        press, opened, pieces = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), loaded(model_file)
        each = [_chunks(opened.decompress(packed).decode()[1:]) for packed in asked["chunks"].to_pylist()]
        number = {c: at for at, c in enumerate(dict.fromkeys(chain.from_iterable(each)))}
        flat, size, new = pieces.table(list(number))
        first, unlike = np.cumsum(size) - size, np.zeros(len(size), bool)
        unlike[list(new)] = True
        sizes, ids, other = [], [], []
        for chunks in each:
            at = np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))
            sizes.append(press.compress(size[at].astype(np.int32).tobytes()))
            ids.append(press.compress(flat[_runs(first[at], size[at])].astype(pieces.kept_as).tobytes()))
            other.append([{"at": i, "text": new[int(at[i])]} for i in np.flatnonzero(unlike[at]).tolist()])
        columns = [asked["block"].combine_chunks(), asked["bucket"].combine_chunks(), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary()), pa.array(other, pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())])))]
        return pa.table(columns, names=["block", "bucket", "sizes", "ids", "other"])

    def meet(left: pa.Table, said: pa.Table) -> pa.Table:
        rows = pa.concat_tables([B.unpack(x.as_buffer()).select(["doc_id", "text"]) for x in left["blob"]])
        texts = [x or "" for x in rows["text"].to_pylist()]
        each = [_chunks(x) for x in texts]
        opened, pieces = zstandard.ZstdDecompressor(), loaded(model_file)
        dealt = _dealt(each, buckets)
        # Each distinct chunk has a number; its ids are a run of ``flat``.
        chunks: list[str] = []
        sizes, flat, new = [], [], {}
        for bucket, packed, ids, other in zip(*(said[c].to_pylist() for c in ("bucket", "sizes", "ids", "other")), strict=True):
            new |= {dealt[bucket][x["at"]]: x["text"] for x in other}
            chunks += dealt[bucket]
            sizes.append(np.frombuffer(opened.decompress(packed), np.int32))
            flat.append(np.frombuffer(opened.decompress(ids), pieces.kept_as))
        last = pieces.read({x[-1] for x in each if x and x[-1][-1] == " "})
        new |= {c: text for c, (_, text) in last.items() if text != c}
        chunks += last
        sizes.append(np.array([len(x) for x, _ in last.values()], np.int32))
        flat.append(np.fromiter(chain.from_iterable(x for x, _ in last.values()), pieces.kept_as))
        size, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
        number = {c: at for at, c in enumerate(chunks)}
        n = np.fromiter(map(len, each), np.int64, len(each))
        token = np.fromiter(map(number.__getitem__, chain.from_iterable(each)), np.int64, int(n.sum()))
        many = size[token]
        past = np.append(0, np.cumsum(many))
        stream = flat[_runs((np.cumsum(size) - size)[token], many)]
        edge = past[np.append(0, np.cumsum(n))]
        out = [rows["doc_id"].combine_chunks().cast(pa.int64())]
        for name in wanted:
            if name == "ids":
                out.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(stream.astype(np.int32))))
            elif name == "n_tokens":
                out.append(pa.array(np.diff(edge), pa.int64()))
            elif name == "ids_sha256":
                out.append(pa.array(_digests(pieces, stream, edge), pa.string()))
            else:
                out.append(pa.array([hashlib.sha256(_decoded(x, its, new).encode()).hexdigest() for x, its in zip(texts, each, strict=True)], pa.string()))
        released()
        return pa.table(out, names=["doc_id", *wanted])

    answers = blocks.mapInArrow(ask, ASKED).groupBy("bucket", "part").applyInArrow(reply, ANSWERED)
    schema = ", ".join(["doc_id long", *(f"{c} {_KINDS[c]}" for c in wanted)])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... so many times, one run after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _digests(pieces: Pieces, stream: np.ndarray, edge: np.ndarray) -> list[str]:
    """sha256 of the decimal ids, joined by commas, of texts whose ids are runs of a stream."""
    out, low = [], 0
    while low < len(edge) - 1:
        high = max(low + 1, int(np.searchsorted(edge, edge[low] + (1 << 18), "right")) - 1)
        ids = stream[edge[low] : edge[high]].astype(np.int64)
        width = pieces.width[ids]
        data = pieces.digits[ids][np.arange(pieces.digits.shape[1]) < width[:, None]].tobytes()
        at = np.append(0, np.cumsum(width))[edge[low : high + 1] - edge[low]].tolist()
        out += [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        low = high
    return out


def _decoded(text: str, chunks: list[str], new: dict[str, str]) -> str:
    """What a text's ids are decoded to, given the chunks that are decoded to anything but themselves."""
    if not chunks or not new or new.keys().isdisjoint(chunks):
        return text.replace(MARK, " ")
    return "".join(new.get(c, c) for c in chunks)[1:]  # the first marker is the library's own


def _dealt(texts: Iterable[list[str]], buckets: int) -> dict[int, list[str]]:
    """Distinct chunks of texts, but for markers at their ends, by bucket; in order, in which they and their ids pack well."""
    out: dict[int, list[str]] = {}
    for chunk in sorted(set(chain.from_iterable(texts))):
        if chunk[-1] != " ":
            out.setdefault(zlib.crc32(chunk.encode()) % buckets, []).append(chunk)
    return out


def _of(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")


def _small(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def op2(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
