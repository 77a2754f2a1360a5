"""Token ids in sorted-string-table shards.

A shard holds the token ids of documents in ascending key order::

    magic
    data blocks    zstd frames of prefix-compressed entries
    block index    one entry per block: first key, place, length, documents, ids
    Bloom filter   over all keys
    footer         places of index and filter, totals, magic

An entry is ``shared, unshared, value length`` as varints, the key's
unshared bytes, then the value: one byte of width (2 or 4) and the ids as
little-endian unsigned integers. Keys share a prefix only within a block,
so a reader finds a key with the filter, a binary search of the sparse
index and one block.

Spark range-partitions documents by key, and each task encodes and writes
one shard under an unused name; a shard counts only once its row is in
the manifest, which Spark commits. A lost executor or a repeated task thus
leaves a file that no manifest names.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_fs, mix64, shared_dir

MAGIC = b"TMSSTAB1"
FOOTER = struct.Struct("<QQQQQQ8s")  # index place, length; filter place, length; documents; ids
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 1
#: Words kept per Python worker; beyond it the memory is emptied, never the result.
CACHE_WORDS = 1_200_000


# ---------------------------------------------------------------- keys


def encode_key(doc_id: int | str | None) -> bytes:
    """Bytes that sort as the identifiers do; null sorts first."""
    if doc_id is None:
        return b""
    if isinstance(doc_id, str):
        return b"\x02" + doc_id.encode()
    return b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def decode_key(key: bytes) -> int | str | None:
    if not key:
        return None
    if key[:1] == b"\x02":
        return key[1:].decode()
    return struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    """The filter's bit places of each key: double hashing of two crc32 mixes."""
    raw = np.array([zlib.crc32(k) | zlib.crc32(k, 0x9E3779B9) << 32 for k in keys], dtype=np.uint64)
    h = mix64(raw)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


# ---------------------------------------------------------------- shard files


class ShardWriter:
    """Writes entries, which must come in ascending key order, to a binary file."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES, level: int = 1):
        import zstandard

        self.out, self.block_bytes = out, block_bytes
        self.zip = zstandard.ZstdCompressor(level=level)
        self.place = out.write(MAGIC) or len(MAGIC)
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block, self.size = [], 0
        self.first = self.last = b""
        self.in_block = self.ids_in_block = self.docs = self.ids = 0

    def add(self, key: bytes, width: int, ids: bytes) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) + 1) + key[shared:] + bytes([width])
        self.block += (entry, ids)
        self.size += len(entry) + len(ids)
        self.last = key
        self.keys.append(key)
        n = len(ids) // width
        self.in_block, self.ids_in_block = self.in_block + 1, self.ids_in_block + n
        self.docs, self.ids = self.docs + 1, self.ids + n
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        data = self.zip.compress(b"".join(self.block))
        self.out.write(data)
        self.index.append(
            _varint(len(self.first)) + self.first
            + b"".join(map(_varint, (self.place, len(data), self.in_block, self.ids_in_block, zlib.crc32(data))))
        )
        self.place += len(data)
        self.block, self.size, self.in_block, self.ids_in_block = [], 0, 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        filled = np.zeros(bits, dtype=np.uint8)
        for at in range(0, len(self.keys), 65536):
            filled[_bloom_places(self.keys[at : at + 65536], bits).ravel()] = 1
        bloom = _varint(bits) + np.packbits(filled).tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), self.docs, self.ids, MAGIC))


@dataclass
class Block:
    first: bytes
    place: int
    length: int
    docs: int
    ids: int
    crc: int


class ShardReader:
    """Reads a shard from a seekable file: in order, or one key at a time."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zip = file, zstandard.ZstdDecompressor()
        at, length, bloom_at, bloom_length, self.docs, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.blocks: list[Block] = []
        data, i = self._read(at, length), 0
        while i < len(data):
            n, i = _read_varint(data, i)
            first, i = data[i : i + n], i + n
            numbers = []
            for _ in range(5):
                n, i = _read_varint(data, i)
                numbers.append(n)
            self.blocks.append(Block(first, *numbers))
        bloom = self._read(bloom_at, bloom_length)
        self.bits, i = _read_varint(bloom, 0)
        self.bloom = bloom[i:]

    def _read(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def _entries(self, block: Block) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self._read(block.place, block.length)
        if zlib.crc32(data) != block.crc:
            raise ValueError("a block is damaged")
        data, i, key = self.zip.decompress(data), 0, b""
        while i < len(data):
            shared, i = _read_varint(data, i)
            unshared, i = _read_varint(data, i)
            length, i = _read_varint(data, i)
            key, i = key[:shared] + data[i : i + unshared], i + unshared
            yield key, np.frombuffer(data, dtype=f"<u{data[i]}", count=(length - 1) // data[i], offset=i + 1)
            i += length

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in self.blocks:
            yield from self._entries(block)

    def may_hold(self, key: bytes) -> bool:
        places = _bloom_places([key], self.bits)[0].astype(np.int64)
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in places.tolist())

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document under the key, by filter, index and blocks."""
        if not self.may_hold(key):
            return []
        found = []
        at = max(0, bisect.bisect_left([b.first for b in self.blocks], key) - 1)
        for block in self.blocks[at:]:
            if block.first > key:
                break
            found += [ids for k, ids in self._entries(block) if k == key]
        return found


# ---------------------------------------------------------------- encoding

#: What the vocabulary file's pre-tokenizer cuts a lower-case run without
#: blanks into, for the characters below.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Runs of only these go piece by piece; any other run goes whole to the tokenizer.
_PLAIN = re.compile(r"[!-~À-ÿ]+")
_ODD_BLANKS = re.compile(r"[\x1c-\x1f]")


def _byte_letters() -> str:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(shown))
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
    return "".join(letters[b] for b in range(256))


_LETTERS = _byte_letters()


class WordEncoder(dict):
    """Blank-free run of characters -> its ids as bytes, filled on demand.

    The tokenizer never joins characters across white space, so a text's
    ids are those of its runs. The model's merges come from the library; a
    run with characters beyond ASCII and Latin-1 letters goes through the
    whole library path.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.end = END_ID.to_bytes(self.width, "little")
        self.special = any(re.search(r"\s", t.content) for t in self.tokenizer.get_added_tokens_decoder().values())

    def _pack(self, ids: Iterable[int]) -> bytes:
        return np.array(list(ids), dtype=f"<u{self.width}").tobytes()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if run.isascii() and run.isalpha():
            ids = [t.id for t in self.model.tokenize(run.lower())]
        elif _PLAIN.fullmatch(run) and "<|" not in run:
            ids = []
            for piece in _PIECES.findall(run.lower()):
                if not piece.isascii():
                    piece = piece.encode().decode("latin-1").translate(_LETTERS)
                ids += [t.id for t in self.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(run, add_special_tokens=False).ids
        # Very long runs (encoded images, hashes) aren't worth keeping.
        packed = self._pack(ids)
        if len(run) <= 64:
            self[run] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text with the end id, as little-endian bytes."""
        if not text:
            return self.end
        if self.special or _ODD_BLANKS.search(text):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end
        return b"".join(map(self.__getitem__, text.split())) + self.end


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- Spark operator

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("n_docs", T.LongType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("first_key", T.BinaryType()),
    T.StructField("last_key", T.BinaryType()),
    T.StructField("shard", T.IntegerType()),
])


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, partitions: int | None = None) -> DataFrame:
    """Encode ``text`` by ``doc_id`` into sorted shards; return the manifest.

    ``docs`` needs ``doc_id`` (long or string) and ``text``; other columns
    are ignored. Null text is the empty text, a null id sorts first,
    repeated ids are kept side by side (ordered by a hash of the text), so
    a hot id spreads over tasks. An empty table gives an empty manifest.
    One shuffle moves the texts; ids are made after it, in key order.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "shards")
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("split", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "split"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = kept.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = arrow_fs(folder)
        fs.create_dir(root, recursive=True)
        encoder, shard = _encoder(tokenizer_path), TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.tms"
        writer = file = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids, texts):
                if writer is None:
                    file = fs.open_output_stream(path)
                    writer = ShardWriter(file)
                    first = encode_key(doc_id)
                writer.add(encode_key(doc_id), encoder.width, encoder.encode(text.as_py()))
        if writer is None:
            return
        writer.close()
        file.close()
        size = fs.get_file_info(path).size
        row = [path, size, writer.docs, writer.ids, first, writer.last, shard]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row[:4]] + [pa.array([v], pa.binary()) for v in row[4:6]] + [pa.array([shard], pa.int32())], names=MANIFEST.fieldNames())

    rows = placed.mapInArrow(write, MANIFEST)
    manifest = f"{folder}/manifest"
    rows.write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_shards(manifest: DataFrame, folder_uri: str, id_type: T.DataType) -> DataFrame:
    """One row per document from the shard files: place, ids and their crc32.

    ``start`` counts the ids of all documents before it. The running total
    over shards is a window over the manifest alone: one row per shard.
    """
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "path", "size", before.cast("long").alias("start"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([
        T.StructField("doc_id", id_type),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("shard", T.IntegerType()),
    ])

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        fs, _ = arrow_fs(folder_uri)
        for batch in batches:
            for shard, path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(path) as file:
                    rows = []
                    for key, ids in ShardReader(file, size):
                        rows.append((decode_key(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return shards.repartition(n, "shard").mapInArrow(read, schema)


def tokenize_to_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shards and read them back, one row per document."""
    folder = folder or shared_dir(docs.sparkSession, "shards")
    manifest = write_shards(docs, tokenizer_path, folder)
    return read_shards(manifest, folder, docs.schema["doc_id"].dataType)


def lookup(manifest: DataFrame, folder_uri: str, doc_id: int | str | None) -> list[list[int]]:
    """Ids of every document under one id: the manifest narrows to the shards
    whose key range holds it, then filter, index and block are read."""
    key = encode_key(doc_id)
    fs, _ = arrow_fs(folder_uri)
    found = []
    fits = manifest.where((F.col("first_key") <= F.lit(bytearray(key))) & (F.col("last_key") >= F.lit(bytearray(key)))).orderBy("shard")
    for row in fits.select("path", "size").toLocalIterator():
        with fs.open_input_file(row.path) as file:
            found += [ids.tolist() for ids in ShardReader(file, row.size).get(key)]
    return found
