"""Token-ID files: concatenated id arrays with Elias-Fano encoded document boundaries.

A shard file is a run of blocks and a footer::

    block   = ids (uint16 or uint32, little-endian) + EF(boundaries) + EF(document ids)
    footer  = JSON of the blocks' offsets and counts, its length (uint32), b"SLEFIDS1"

EF(v) keeps n ascending integers below u in about n * (2 + log2(u / n)) bits: the low bits of each packed,
the high bits in unary, and a sample of every 64th one-bit for select(i). No 64-bit offset table exists; a
document's place in the corpus is the shard's start + the block's start + select(i), where shards follow each other
by number and their lengths stand in their footers: the files alone give all that is read.

Edge cases: null and empty texts hold the end id alone; null ids come first and are kept as nulls; repeated
rows are documents of their own; documents of one id, or without, are ordered by a hash of their texts and may be
dealt over many shards; an empty table gives no files and no rows. Other columns are never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, file_system, new_dir, table

MAGIC = b"SLEFIDS1"
#: A block ends after so many ids or documents; it bounds the memory of writers and readers.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 15
SAMPLE = 64
#: Bytes of text that are encoded together; a batch more than that at most.
CHUNK = 1 << 23


class EliasFano:
    """n ascending integers in [0, universe]."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<IBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        n, bits, a, b, c = struct.unpack_from("<IBIII", data, at)
        at += 17
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, read from a sample and at most the bits up to the next one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, start // 8
        word = int(self.high[byte]) >> (start % 8) << (start % 8)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return ((at - i) << self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high + (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)


class Encoder:
    """Whole texts to id bytes with the tokenizers library.

    Byte-level BPE never merges over the pieces of its pre-tokenizer, so each piece is encoded once by the library's
    model and kept, and so is what lies between two spaces, for as long as no space is followed by white space or the
    end (there a piece can span the space). Such texts, and those with a special token's string, are encoded whole;
    with ``pattern`` None, the pre-tokenizer's pattern, all are.
    """

    KEPT = 250_000

    def __init__(self, path: str, pattern: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tokenizers

        #: Kept by the worker process, for all of its tasks.
        kept = tokenizers.__dict__.setdefault("_sl_kept", {})
        if path not in kept:
            kept[path] = tokenizers.Tokenizer.from_file(path), {}, {}
        self.tok, self.words, self.pieces = kept[path]
        self.model = self.tok.model.tokenize
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.split, self.odd = regex.compile(pattern).findall if pattern else None, re.compile(r" (?:\s|\Z)").search
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _ids(self, piece: str) -> bytes:
        shown = piece if piece.isalnum() and piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of what stands before a space or between two; of several pieces each is kept."""
        parts = self.split(word)
        if len(parts) == 1:
            return self._ids(word)
        found = []
        for p in parts:
            if (ids := self.pieces.get(p)) is None:
                ids = self._ids(p)
                if len(self.pieces) < self.KEPT:
                    self.pieces[p] = ids
            found.append(ids)
        return b"".join(found)

    def _after_space(self, word: str) -> bytes:
        got = self._word(" " + word)
        if len(self.words) < self.KEPT:
            self.words[word] = got
        return got

    def __call__(self, texts) -> list[bytes]:
        """Id bytes of each text of an Arrow array without nulls; each different word of the array is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = texts.to_pylist()
        if not plain:
            return []
        if self.split is None:
            return list(map(self._whole, plain))
        lists = pc.split_pattern(texts, " ")
        starts, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        starts -= starts[0]
        known, at = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        own = []
        for k, text in enumerate(plain):
            # The first word has no space before it; an odd text is one entry, and its other words are empty ones.
            if self.odd(text) or any(s in text for s in self.special):
                own.append(self._whole(text))
                at[starts[k] : starts[k + 1]] = len(known) + len(plain)
            else:
                own.append(self._word(text.partition(" ")[0]))
        at[starts[:-1]] = len(known) + np.arange(len(plain))
        kept = map(self.words.get, known)
        entries = [self._after_space(w) if g is None else g for g, w in zip(kept, known, strict=True)] + own + [b""]
        found = pa.array(entries, pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(at) + 1)[starts]
        data = found.buffers()[2].to_pybytes() if found.buffers()[2] is not None else b""
        return [data[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def write_shards(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str, pattern: str | None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` in ascending id order to shard files under ``folder``; returns the written list of them (shard, path).
    A lost task writes its shard anew under another name and only committed names enter the manifest."""
    arrow_batches(docs.sparkSession, 500)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("h"))
    # The place of a row in its input breaks ties, so that a third of all rows with one id, even equal ones, can be split.
    by = ("id", "h", "place")
    ordered = ordered.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).select("id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, shard = Encoder(tokenizer, pattern), TaskContext.get().partitionId()
        path, out, blocks, at, before = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.efids", None, [], 0, 0
        ids, parts, ends, total = [], [], [], 0
        end = np.array([end_id], encode.dtype).tobytes()

        def flush() -> None:
            nonlocal at, before, ids, parts, ends, total, out
            if out is None:
                fs, name = file_system(path)
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(name, compression=None)
            data = b"".join(parts)
            nulls = sum(i is None for i in ids)
            known = np.array([i for i in ids if i is not None], np.int64)
            base = int(known[0]) if len(known) else 0
            bounds, names = EliasFano.encode(np.array(ends)).to_bytes(), EliasFano.encode((known - base).astype(np.uint64)).to_bytes()
            out.write(data + bounds + names)
            blocks.append({"at": at, "ids_bytes": len(data), "size": len(data) + len(bounds) + len(names), "docs": len(ids), "ids": total, "nulls": nulls, "base": base, "width": encode.dtype.itemsize, "before": before})
            at, before = at + blocks[-1]["size"], before + total
            ids, parts, ends, total = [], [], [], 0

        def chunks():
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.nbytes
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
            yield held

        for held in chunks():
            names = [i for b in held for i in b.column(0).to_pylist()]
            for i, got in zip(names, encode(pa.concat_arrays([b.column(1) for b in held])) if held else [], strict=True):
                got += end
                ids.append(i)
                parts.append(got)
                total += len(got) // encode.dtype.itemsize
                ends.append(total)
                if total >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                    flush()
        if ids:
            flush()
        if out is not None:
            foot = json.dumps(blocks).encode()
            out.write(foot + struct.pack("<I", len(foot)) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path]})

    return table(ordered.mapInArrow(run, "shard long, path string"), "token-shards")


BLOCK_FIELDS = ("at", "size", "ids_bytes", "docs", "ids", "nulls", "base", "width", "before")


def decode_block(data: bytes, ids_bytes: int, nulls: int, base: int, width: int):
    """(document ids, ends, ids) of a block; an end is found by select, as for any single document."""
    ids = np.frombuffer(data, f"<u{width}", ids_bytes // width)
    bounds, at = EliasFano.from_bytes(data, ids_bytes)
    names, _ = EliasFano.from_bytes(data, at)
    ends = np.fromiter(map(bounds.select, range(bounds.n)), np.int64, bounds.n)
    return [None] * nulls + (names.decode() + base).tolist(), ends, ids


def read_footer(path: str) -> list[dict]:
    """A shard's blocks, from the file alone."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        tail = f.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        n = struct.unpack("<I", tail[:4])[0]
        return json.loads(f.read_at(n, size - 12 - n))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from shard files (shard, path)."""
    spark = shards.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def footers(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                found = read_footer(r["path"])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([r["shard"]] * len(found), pa.int64()), "path": [r["path"]] * len(found), **{k: pa.array([x[k] for x in found], pa.int64()) for k in BLOCK_FIELDS}})

    # A row per block: far fewer than documents, and no text or id is among them.
    listed = shards.repartition(n, "path").mapInArrow(footers, "shard long, path string, " + ", ".join(f"{k} long" for k in BLOCK_FIELDS))
    listed = table(listed, "token-blocks")
    totals = listed.groupBy("shard").agg(F.sum("ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    blocks = listed.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("before"))
    blocks = blocks.select("path", "at", "size", "ids_bytes", "nulls", "base", "width", "start").repartition(n, "path", "at")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                fs, name = file_system(r["path"])
                with fs.open_input_file(name) as f:
                    data = f.read_at(r["size"], r["at"])
                ids, ends, tokens = decode_block(data, r["ids_bytes"], r["nulls"], r["base"], r["width"])
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(tokens[a:z].astype("<u4").tobytes()) for a, z in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(begins + r["start"], pa.int64()), "n_tokens": pa.array(ends - begins, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all of ``docs`` as token files with the public 50k byte-level BPE and return what reading them gives."""
    import public_tokenizers

    folder = folder or new_dir(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, folder, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN))


def op2_elias_fano_tokens(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
