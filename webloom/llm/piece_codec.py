"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi search.

The pieces of a model file go into an Aho-Corasick automaton. One pass over a
normalised text visits, at each position, the pieces that end there by following
output links (longest first), and relaxes the best score of that position:
best[end] = max(best[start] + score). A character that is no piece itself may also
be unknown, at the least score minus 10; it becomes byte pieces where the model
has them. Ties go to the longest last piece.

No piece spans a place where a space mark follows another character (checked when
the model is loaded), so a text falls into words whose searches are independent;
each distinct word is searched once per worker while it is kept.

Scores are those of the file. A file of merge type ranks its pieces by score; the
search then gives the segmentation of best total score, which is what the library's
lattice gives for the same pieces as a unigram model, not the merge-order segmentation.

Defined cases: null text counts as empty; empty text has no ids; other columns are
carried by encode() and replaced where names clash; null and repeated doc_id are
ordinary rows; an empty table gives an empty table. Texts that hold the space mark
U+2581 itself, or a character that the model's normaliser changes, decode to the
normalised text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import map_arrow
from webloom.llm._text import column, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept per worker.
CACHE = 300_000


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class PieceCodec(dict):
    """Maps words to tuples of ids; missing words are searched."""

    def __init__(self, path: str, limit: int = CACHE):
        super().__init__()
        import ahocorasick
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.pieces = limit, [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        special = [self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) for i in range(len(self.pieces))]
        self.unknown = self.lib.unk_id()
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if self.lib.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.control = {i for i, x in enumerate(special) if x and i not in self.bytes}
        self.raw = [bytes([self.bytes[i]]) if i in self.bytes else b"" if i in self.control - {self.unknown} else b" \xe2\x81\x87 " if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.automaton, scores = ahocorasick.Automaton(), []
        for i, piece in enumerate(self.pieces):
            if not special[i] and not self.lib.is_unused(i):
                scores.append(self.lib.get_score(i))
                self.automaton.add_word(piece, (i, len(piece), scores[-1]))
        self.automaton.make_automaton()
        self.single = {p for i, p in enumerate(self.pieces) if len(p) == 1 and not special[i]}
        self.unknown_score = min(scores) - UNKNOWN_PENALTY
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for i, p in enumerate(self.pieces) if not special[i])
        self.cut = re.compile(r"(?s).+" if inner else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = self.search(word)
        return ids

    def search(self, word: str) -> tuple[int, ...]:
        """Ids of the best segmentation of a normalised word."""
        n, none = len(word), float("-inf")
        best, origin, last = [0.0, *[none] * n], [0] * (n + 1), [0] * (n + 1)
        strange = [] if self.single.issuperset(word) else [i for i, c in enumerate(word) if c not in self.single]
        at = 0
        for end, (piece, length, score) in self.automaton.iter(word):
            while at < len(strange) and strange[at] < end:
                self._unknown(best, origin, last, strange[at])
                at += 1
            end += 1
            if (total := best[end - length] + score) > best[end]:
                best[end], origin[end], last[end] = total, end - length, piece
        for i in strange[at:]:
            self._unknown(best, origin, last, i)
        out: list[int] = []
        pos = n
        while pos:
            start, piece = origin[pos], last[pos]
            if piece < 0:
                raw = [self.byte_ids.get(b, self.unknown) for b in word[start:pos].encode("utf-8", "replace")] if self.byte_ids else [self.unknown]
                if not self.byte_ids and out and out[-1] == self.unknown:
                    raw = []  # neighbouring unknown characters are one unknown piece
                out += raw[::-1]
            else:
                out.append(piece)
            pos = start
        return tuple(out[::-1])

    def _unknown(self, best: list[float], origin: list[int], last: list[int], i: int) -> None:
        if (total := best[i] + self.unknown_score) > best[i + 1]:
            best[i + 1], origin[i + 1], last[i + 1] = total, i, -1

    def encode(self, text: str) -> np.ndarray:
        words = self.cut.findall(self.lib.normalize(text)) if text else []
        return np.fromiter(chain.from_iterable(map(self.__getitem__, words)), np.uint32)

    def decode(self, ids) -> str:
        """Text of ids: bytes joined, space marks as spaces, without the leading space that normalising added."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """docs without the text but with ids; or, digest_only, with n_tokens, ids_crc32 (ids as little-endian u32) and round_trip (decoding gives the text again)."""
    path = model or default_model()
    made = ("n_tokens", "ids_crc32", "round_trip") if digest_only else ("ids",)
    rest = [f for f in docs.schema.fields if f.name != text_col and f.name not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = column(batch, text_col)
            for lo, hi, _, _ in slices(texts):
                rows = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                ids = [c.encode(t) for t in rows]
                kept = [column(batch, f.name).slice(lo, hi - lo) for f in rest]
                if digest_only:
                    cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([c.decode(x.tolist()) == t for x, t in zip(ids, rows, strict=True)], pa.bool_())]
                else:
                    cols = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*kept, *cols], [*(f.name for f in rest), *made])

    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in rest)
    return map_arrow(docs, run, fields + ("n_tokens long, ids_crc32 long, round_trip boolean" if digest_only else "ids array<int>"))


def decode(rows: DataFrame, model: str | None = None, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """rows without ids but with the decoded text; null ids give null."""
    path = model or default_model()
    rest = [f for f in rows.schema.fields if f.name not in (ids_col, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in column(batch, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in rest), pa.array(texts, pa.string())], [*(f.name for f in rest), name])

    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in rest)
    return map_arrow(rows, run, f"{fields}`{name}` string")


def table_of(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id with the digest of its ids."""
    return encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, digest_only=True)
