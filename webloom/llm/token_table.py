"""Token-ID output: sorted-string-table shards of tokenised documents, and their reader.

write() deals the documents by range of doc_id, and each task encodes its range
in order and writes one shard file in the shared folder. A second, tiny pass adds
up the shards' token counts, so that each shard knows how many ids come before it.

Encoding gives what the tokenizers library gives for the whole text: texts are
cut where the library's byte-level pre-tokenizer cuts them, by one vectorised pass over
code points; each distinct piece is encoded by the library once and kept. Texts
with code points whose class is not the same in all Unicode versions since 3.2,
marks, white space outside ASCII, or a special token's string go through the
library whole.

Shard layout (little-endian unless said):
- blocks of about BLOCK bytes, each compressed by zstd: entries (shared u32, rest
  u32, length u32, key rest, value). A key is doc_id in 8 big-endian bytes, sign bit flipped, after a
  byte 1 (a single byte 0 for a null doc_id), then a 4-byte sequence number for
  repeated keys; shared counts the bytes it has in common with the key before it
  in the block, whose first key is whole. A value is a byte with the width of its
  ids, 2 or 4, and the ids.
- index: for each block its offset u64, stored size u32, size u32, first row u64,
  first token u64, and first key (u16 length and bytes); then the last key.
- Bloom filter over doc_id keys, 10 bits a key, 7 hash functions.
- footer, 64 bytes: offsets and sizes of index and filter (4 u64), rows u64,
  tokens u64, blocks u32, version u32, magic of 8 bytes.

Files go to their final name in one rename after they are complete; the manifest
lists those of tasks that Spark committed, so a lost executor or a repeated task
leaves at most an unlisted file.

Defined cases: null text counts as empty (one id, the end id); null doc_id sorts
first; repeated doc_id are separate entries, ordered by text; an empty table gives
a manifest without shards; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import mmap
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm._common import map_arrow, partitions_for
from webloom.llm._text import column, same_spans, slices, span_hashes

MAGIC, VERSION, BLOCK, FOOTER = b"WLTOKSST", 1, 1 << 16, struct.Struct("<4Q2Q2I8s")
INDEX_ENTRY, ENTRY = struct.Struct("<QIIQQH"), struct.Struct("<3I")
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 2
CODEC = pa.Codec("zstd", compression_level=1)

# Classes of code points for cutting: letter, number, white space, other, and those that go through the library.
_L, _N, _S, _O, _RARE = range(5)
_CLASS: list[np.ndarray] = []
#: The byte alphabet of byte-level models: visible characters of Latin-1 stand for themselves, other bytes for U+0100 on.
BYTE_ALPHABET = np.arange(256, dtype="<u2")
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_ALPHABET[_HIDDEN] = 0x100 + np.arange(len(_HIDDEN))
#: Pieces kept per worker while writing shards, and while only counting.
CACHE, COUNT_CACHE = 300_000, 200_000
#: Pieces encoded at a time.
GROUP = 8_192


def _classes() -> np.ndarray:
    """Class of every code point below 65,536; those that Unicode versions differ about, and some rare ones, are left to the library."""
    if not _CLASS:
        table = np.full(1 << 16, _RARE, np.uint8)
        for c in range(1 << 16):
            kind = unicodedata.category(chr(c))
            if kind != unicodedata.ucd_3_2_0.category(chr(c)):
                continue
            if kind[0] == "L":
                table[c] = _L
            elif kind[0] == "N":
                table[c] = _N
            elif kind[0] in "PS":
                table[c] = _O
        table[[0x20, 0x0A, 0x0D, 0x09, 0x0B, 0x0C]] = _S
        _CLASS.append(table)
    return _CLASS[0]


class Encoder:
    """Token ids of whole texts by one of the public tokenizers with byte-level cutting."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.limit = Tokenizer.from_file(path), cache
        parts = json.loads(self.lib.to_str())
        before = parts["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not parts["normalizer"]
        self.model = self.lib.model if plain else None
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # ids of all known pieces, and where each one's begin

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the slice's texts in order, where each text's ids begin, with the end)."""
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        joined, code, starts, ends, text, whole = cut_pieces(texts, self.specials)
        parts: list[np.ndarray | None] = [None] * len(texts)
        for i, e in zip(whole, self.lib.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.uint32)
        plain = np.setdiff1d(np.arange(len(texts)), whole)
        if len(plain):
            which = self._lookup(joined, code, starts, ends)
            n = self.begin[which + 1] - self.begin[which]
            at = np.concatenate([[0], np.cumsum(n)])
            flat = self.flat[np.repeat(self.begin[which] - at[:-1], n) + np.arange(at[-1])]
            bounds = at[np.searchsorted(text, np.arange(len(texts) + 1))]
            if not len(whole):
                return flat, bounds
            for i in plain:
                parts[i] = flat[bounds[i] : bounds[i + 1]]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _lookup(self, joined: str, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index into ids of each piece; new pieces are encoded by the library. Pieces are known by their text; hashes only sort them."""
        units = code.astype("<u2")  # plain texts have no other code points
        where, back = distinct_pieces(units, starts, ends)
        texts = [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        if len(self.known) + len(texts) > self.limit:
            self._clear()
        known = self.known
        missing = [t for t in texts if t not in known]
        if missing:
            known.update(zip(missing, range(len(self.begin) - 1, len(self.begin) - 1 + len(missing)), strict=True))
            flat, sizes = [self.flat], []
            for i in range(0, len(missing), GROUP):  # the library's results take much room
                new = self._encode_pieces(missing[i : i + GROUP])
                flat.append(np.fromiter(chain.from_iterable(new), np.uint32))
                sizes += map(len, new)
            self.flat = np.concatenate(flat)
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        return np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))[back]

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces, which the library wouldn't cut further: straight from its model, in the byte alphabet. No piece holds U+FFFF."""
        if self.model is None:
            return [e.ids for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
        spell = lambda t: BYTE_ALPHABET[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-16-le")
        tokenize = self.model.tokenize
        return [[x.id for x in tokenize(p)] for p in spell("\uffff".join(pieces)).split(spell("\uffff"))]


def cut_pieces(texts: list[str], specials: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts joined, their code points, pieces' starts and ends, each piece's text, texts that must go through the library and have no pieces here)."""
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    kind = np.full(len(code), _RARE, np.uint8)
    low = code < 1 << 16
    kind[low] = _classes()[code[low]]
    whole = np.unique(np.searchsorted(first, np.flatnonzero(kind == _RARE), "right") - 1)
    if specials:
        whole = np.union1d(whole, [i for i, t in enumerate(texts) if any(s in t for s in specials)]).astype(np.int64)
    starts, ends, owner = _cut(code, kind, first)
    if len(whole):
        keep = ~np.isin(owner, whole)
        starts, ends, owner = starts[keep], ends[keep], owner[keep]
    return joined, code, starts, ends, owner, whole


def distinct_pieces(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a first piece of each content, which of these each piece is): sorted by hash, then compared with its first."""
    raw = units.view(np.uint8)
    _, where, back = np.unique(span_hashes(raw, starts * 2, ends * 2), return_index=True, return_inverse=True)
    if not same_spans(raw, starts * 2, ends * 2, (starts * 2)[where][back], (ends * 2)[where][back]).all():
        kinds: dict[bytes, int] = {}
        back = np.array([kinds.setdefault(raw[2 * a : 2 * b].tobytes(), len(kinds)) for a, b in zip(starts, ends, strict=True)])
        where = np.unique(back, return_index=True)[1]
    return where, back


def _cut(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (start, end, text index): runs of one class with a leading blank; of white space before more text, the last character stands apart; contractions."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new_text = np.zeros(n + 1, bool)
    new_text[first] = True
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= new_text[:n]
    # White space before something else in the same text: its last character opens a piece; a blank takes the run after it along.
    last_space = np.zeros(n, bool)
    last_space[:-1] = (kind[:-1] == _S) & (kind[1:] != _S) & ~new_text[1:n]
    after = np.flatnonzero(last_space) + 1
    begins |= last_space
    begins[after[code[after - 1] == 0x20]] = False
    # An apostrophe that opens a piece takes s, t, m, d, re, ve or ll along, and no more letters.
    marks = np.flatnonzero((code == ord("'")) & begins)
    if len(marks):
        padded = np.concatenate([code, [0, 0]])
        a, b = padded[marks + 1], padded[marks + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~new_text[marks + 1]
        cross = np.concatenate([new_text, [True]])[marks + 2]
        two = ~one & ~new_text[marks + 1] & ~cross & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for found, length in ((one, 2), (two, 3)):
            begins[marks[found] + 1] = False
            after = marks[found] + length
            begins[after[after < n]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(first, starts, "right") - 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, cache)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def _pack(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" + ids.astype("<u2").tobytes()) if narrow else b"\4" + ids.astype("<u4").tobytes()


def _unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Collects entries in key order; finish() writes index, filter and footer."""

    def __init__(self, out):
        self.out, self.at, self.rows, self.tokens = out, 0, 0, 0
        self.block, self.index, self.keys = bytearray(), [], []
        self.last, self.first_key, self.first_row, self.first_token, self.repeat = b"", b"", 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = _key(doc_id)
        self.repeat = self.repeat + 1 if self.keys and self.keys[-1] == key else 0
        if not self.repeat:
            self.keys.append(key)
        full = key + struct.pack(">I", self.repeat)
        if not self.block:
            self.first_key, self.first_row, self.first_token, shared = full, self.rows, self.tokens, 0
        else:
            shared = len(os.path.commonprefix([self.last, full]))
        value = _pack(ids)
        self.block += ENTRY.pack(shared, len(full) - shared, len(value)) + full[shared:] + value
        self.last, self.rows, self.tokens = full, self.rows + 1, self.tokens + len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = CODEC.compress(bytes(self.block), asbytes=True)
            self.index.append((self.at, len(stored), len(self.block), self.first_row, self.first_token, self.first_key))
            self.out.write(stored)
            self.at += len(stored)
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        index = b"".join(INDEX_ENTRY.pack(*entry, len(k)) + k for *entry, k in self.index) + struct.pack("<H", len(self.last)) + self.last
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.rows, self.tokens, len(self.index), VERSION, MAGIC))


class ShardReader:
    """Random access to one shard: size and read(offset, length) of its file."""

    def __init__(self, file, size: int):
        self.file = file
        at, n, bloom_at, bloom_n, self.rows, self.tokens, blocks, version, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        raw, pos, self.index = self._read(at, n), 0, []
        for _ in range(blocks):
            *entry, k = INDEX_ENTRY.unpack_from(raw, pos)
            pos += INDEX_ENTRY.size
            self.index.append((*entry, raw[pos : pos + k]))
            pos += k
        self.last_key = raw[pos + 2 :]
        packed = self._read(bloom_at, bloom_n)
        (self.bits,) = struct.unpack_from("<Q", packed)
        self.bloom = np.frombuffer(packed, np.uint8, offset=8)
        self.firsts = [k for *_, k in self.index]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> bytes:
        at, stored, size, *_ = self.index[i]
        return CODEC.decompress(self._read(at, stored), size, asbytes=True)

    def block(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        for key, value in self._entries(self._block(i)):
            yield (None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)), _unpack(value)

    @staticmethod
    def _entries(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
        pos, key = 0, b""
        while pos < len(raw):
            shared, rest, length = ENTRY.unpack_from(raw, pos)
            pos += ENTRY.size
            key = key[:shared] + raw[pos : pos + rest]
            pos += rest
            yield key, raw[pos : pos + length]
            pos += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(_key(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The entries of a document: filter, then binary search over the block index, then one block (or more for repeats)."""
        key = _key(doc_id)
        if not self.index or not self.may_hold(doc_id):
            return []
        i = max(0, bisect.bisect_right(self.firsts, key) - 1)
        out = []
        while i < len(self.index) and self.firsts[i][: len(key)] <= key:
            out += [_unpack(v) for k, v in self._entries(self._block(i)) if k[:-4] == key]
            i += 1
        return out


def _open(uri: str):
    """(file system, path) of a URI that this worker can reach."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _write_task(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        enc, writer, out = encoder(vocabulary), None, None
        name, least = f"{uuid.uuid4().hex}.sst", None
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for lo, hi, offs, data in slices(column(batch, "text"), 2 << 20):
                flat, at = enc.encode_slice(data, offs)
                for i in range(hi - lo):
                    if writer is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}.part")
                        writer, least = ShardWriter(out), ids[lo + i]
                    writer.add(ids[lo + i], np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)))
        if writer is not None:
            writer.finish()
            out.close()
            store.move(f"{path}/{name}.part", f"{path}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "first_id": least, "rows": writer.rows, "tokens": writer.tokens}], pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("rows", pa.int64()), ("tokens", pa.int64())]))

    return run


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write shards and folder/manifest; the manifest (shard, file, first_id, rows, tokens, start): one row for each file, about 64 MB of input."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions_for(rows), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    map_arrow(dealt, _write_task(folder, vocabulary or default_vocabulary(), end_id), "file string, first_id long, rows long, tokens long").write.parquet(f"{folder}/parts")
    shards = sorted(map(tuple, spark.read.parquet(f"{folder}/parts").collect()), key=lambda x: (x[1] is not None, x[1] or 0))
    table, start = [], 0
    for i, (file, least, n, tokens) in enumerate(shards):
        table.append((i, file, least, n, tokens, start))
        start += tokens
    manifest = spark.createDataFrame(table, "shard long, file string, first_id long, rows long, tokens long, start long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _read_task(folder: str, digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        for batch in batches:
            for file, start in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{file}") as f:
                    reader = ShardReader(f, f.size())
                    for b in range(len(reader.index)):
                        at = start + reader.index[b][4]
                        ids, starts, sizes, values = [], [], [], []
                        for doc_id, tokens in reader.block(b):
                            ids.append(doc_id)
                            starts.append(at)
                            sizes.append(len(tokens))
                            values.append(zlib.crc32(tokens.tobytes()) if digest_only else tokens.astype(np.int32))
                            at += len(tokens)
                        last = pa.array(values, pa.int64() if digest_only else pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"])

    return run


def read(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """Documents from the shards: doc_id, start (ids of all documents before), n_tokens, ids (or their crc32)."""
    files = spark.read.schema("shard long, file string, first_id long, rows long, tokens long, start long").parquet(f"{folder}/manifest")
    spread = files.select("file", "start").repartition(partitions_for(files, 1 << 12), "file")
    return map_arrow(spread, _read_task(folder, digest_only), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest_only else "ids array<int>"))


class TokenTable:
    """Point lookups over all shards of a folder from one process."""

    def __init__(self, spark: SparkSession, folder: str):
        shards = spark.read.parquet(f"{folder}/manifest").orderBy("shard").select("file", "first_id").collect()
        self.files, self.firsts = [r[0] for r in shards], [_key(r[1]) for r in shards]
        self.store, self.path = _open(folder)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        key, out = _key(doc_id), []
        i = max(0, bisect.bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key:  # a repeated key may have begun in the shard before
            i -= 1
        while i < len(self.files) and self.firsts[i] <= key:
            with self.store.open_input_file(f"{self.path}/{self.files[i]}") as f:
                out += ShardReader(f, f.size()).get(doc_id)
            i += 1
        return out


def token_counts(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs without their text column but with its number of token ids (no end id)."""
    rest = [f for f in docs.schema.fields if f.name not in (text_col, name)]
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, COUNT_CACHE)
        for batch in batches:
            for lo, hi, offs, data in slices(column(batch, text_col)):
                _, at = enc.encode_slice(data, offs)
                yield pa.RecordBatch.from_arrays([*(column(batch, f.name).slice(lo, hi - lo) for f in rest), pa.array(np.diff(at), pa.int64())], [*(f.name for f in rest), name])
        _ENCODERS.clear()  # the worker may serve other operators next

    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in rest)
    return map_arrow(docs, run, f"{fields}`{name}` long")


def open_local(path: str) -> ShardReader:
    """Reader over a memory-mapped local shard."""
    with Path(path).open("rb") as f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return ShardReader(m, len(m))
