"""Token counts of whole texts by rank-synchronous merging of arrays.

The pieces that a byte-level pre-tokenizer cuts are held as one ragged array of
symbols. In each round every piece that still has a pair of the merge table finds
its lowest rank, and all pieces merge the pairs of that rank at once, from left to right
where they overlap; pieces without such a pair leave the array with the
number of symbols they have left. Pieces of more than LONG bytes would need as many
rounds as they have merges, so all of a slice's long pieces share one ascending sweep
over ranks instead: each rank keeps the places where its pair may stand, and a merge
looks at its two neighbours only. Both merge in order of rank, which equals merging one pair
after the other because a pair made of a merged symbol always ranks after the merge
that made the symbol; Merges checks this of the table and refuses others.

Vocabularies are JSON files of the tokenizers library with a byte-level BPE model and its
usual cut. Added special tokens are found in the texts first and count as one, as by the
library's default. Texts with code points of uncertain class are cut by the
library's pre-tokenizer; their pieces are merged here like all others.

Memory is bounded: slices of about SLICE bytes; a longer text is cut before a single blank that follows
a non-blank, where the pre-tokenizer cuts in any case. Counts of pieces are
kept per worker, at most CACHE of them.

Defined cases: null and empty texts have 0 bytes and 0 tokens; every row gives one row, repeated ones too; null
doc_id stays null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import map_arrow
from webloom.llm._text import IS_SPACE, column, slices
from webloom.llm.token_table import BYTE_ALPHABET, cut_pieces, default_vocabulary, distinct_pieces

LIMIT = 512
SLICE, CACHE = 1 << 20, 300_000
#: Longer pieces (bytes) go to the sweep over ranks.
LONG = 64
_NONE = np.int64(1 << 62)


class Merges:
    """A byte-level merge table as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        parts = json.loads(self.lib.to_str())
        model, before = parts["model"], parts["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or parts["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError("not a byte-level BPE vocabulary with the usual cut")
        self.specials = [t["content"] for t in parts["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            raise ValueError("added tokens that take their surroundings along aren't supported")
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[chr(c)] for c in BYTE_ALPHABET.tolist()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.result = np.array([vocab["".join(p)] for p in pairs], np.int64)
        made = np.full(max(vocab.values()) + 1, len(pairs))  # the rank that makes a symbol
        made[self.byte_id] = -1
        rank = np.arange(len(pairs))
        first = made.copy()
        np.minimum.at(first, self.result, rank)
        if len(np.unique(self.result)) != len(pairs) or (first[left] >= rank).any() or (first[right] >= rank).any() or (made[self.result] == -1).any():
            raise ValueError("the merge table isn't in order of creation")
        self.size = len(made)
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.rank_of = np.append(key[order], _NONE), np.append(order, len(pairs)).astype(np.int64)
        self.none = len(pairs)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; none where there is no such merge."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], self.none)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols left of each piece of bytes."""
        size = ends - starts
        out = np.minimum(size, 1)
        for which, merge in ((np.flatnonzero((size > 1) & (size <= LONG)), self._rounds), (np.flatnonzero(size > LONG), self._sweep)):
            if len(which):
                n = size[which]
                at = np.cumsum(n) - n
                symbols = self.byte_id[data[np.repeat(starts[which] - at, n) + np.arange(n.sum())]]
                out[which] = merge(symbols, n)
        return out

    def _rounds(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each piece's lowest-ranked pair at once, in rounds, until no piece has one."""
        out, piece = size.copy(), np.arange(len(size))  # which piece each row of the ragged array is
        pair = self._pairs(symbols, size)
        while len(piece):
            first = np.cumsum(size) - size
            lowest = np.minimum.reduceat(pair, first)
            live = lowest < self.none
            if not live.all():
                keep = np.repeat(live, size)
                symbols, pair, piece, size, lowest = symbols[keep], pair[keep], piece[live], size[live], lowest[live]
                if not len(piece):
                    break
            row = np.repeat(np.arange(len(piece)), size)
            hit = _alternate(np.flatnonzero(pair == lowest[row]))
            symbols[hit] = self.result[pair[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            size = size - np.bincount(row[hit], minlength=len(piece))
            out[piece] = size
            # Only pairs that touch a merged symbol change.
            at = (np.cumsum(keep) - 1)[hit]
            symbols, pair, row = symbols[keep], pair[keep], row[keep]
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(symbols)]
                fresh = self.ranks(symbols[i], symbols[i + 1])
                pair[i] = np.where(row[i] == row[i + 1], fresh, self.none)
            pair[-1] = self.none
        return out

    def _pairs(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rank of each symbol with the next one of its piece."""
        pair = np.full(len(symbols), self.none)
        pair[:-1] = self.ranks(symbols[:-1], symbols[1:])
        pair[np.cumsum(size) - 1] = self.none
        return pair

    def _sweep(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same over linked lists, rank after rank for all pieces together: time grows with symbols and distinct ranks."""
        n = len(symbols)
        end = np.zeros(n + 1, bool)
        end[np.cumsum(size)] = True
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[end[1:]] = n  # n: no neighbour
        prv[end[:-1]] = n
        prv[0] = n
        prv, nxt, symbols = np.append(prv, n), np.append(nxt, n), np.append(symbols, -1)
        alive = np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[(places < n) & (nxt[places] < n)]
            rank = self.ranks(symbols[places], symbols[nxt[places]])
            places, rank = places[rank < self.none], rank[rank < self.none]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            edge = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
            for r, group in zip(rank[edge].tolist(), np.split(places, edge[1:]), strict=True) if len(rank) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(group)

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (nxt[at] < n)]
            at = at[self.ranks(symbols[at], symbols[nxt[at]]) == r]
            # Of places that follow one another, every second one is taken.
            chained = np.zeros(len(at), bool)
            chained[1:] = nxt[at[:-1]] == at[1:]
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            symbols[at], alive[gone] = self.result[r], False
            after = nxt[gone]
            nxt[at] = after
            inside = after < n
            prv[after[inside]] = at[inside]
            wait(np.unique(np.concatenate([at, prv[at]])))
        return np.add.reduceat(alive[:n].astype(np.int64), np.cumsum(size) - size)


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of each run of consecutive places, every second one from its first."""
    index = np.arange(len(at))
    follows = np.zeros(len(at), bool)
    follows[1:] = at[1:] == at[:-1] + 1
    return at[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]


def safe_cuts(data: np.ndarray, most: int) -> list[int]:
    """Bounds of parts of a text of about most bytes, each but the first beginning with a single blank after a non-blank."""
    if len(data) <= most:
        return [0, len(data)]
    blank = np.flatnonzero((data[1:-1] == 0x20) & ~IS_SPACE[data[:-2]] & ~IS_SPACE[data[2:]]) + 1
    # A byte above 0x7F may end white space outside ASCII, and another may begin it.
    blank = blank[(data[blank - 1] < 0x80) & (data[blank + 1] < 0x80)]
    cuts = [0]
    while len(data) - cuts[-1] > most:
        i = np.searchsorted(blank, cuts[-1] + most)
        if i == len(blank):
            break
        cuts.append(int(blank[i]))
    return [*cuts, len(data)]


class Counter:
    """Token counts of texts; remembers pieces."""

    def __init__(self, path: str):
        self.merges, self.known = Merges(path), {}

    def texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice."""
        if len(offs) == 2 and len(data) > SLICE and not any(" " in s for s in self.merges.specials):
            cuts = safe_cuts(data, SLICE)
            return np.array([sum(int(self._slice(data[a:b], np.array([0, b - a]))[0]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))])
        return self._slice(data, offs)

    def _slice(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        joined, code, starts, ends, owner, whole = cut_pieces(texts, self.merges.specials)
        out = np.zeros(len(texts), np.int64)
        if len(starts):
            where, back = distinct_pieces(code.astype("<u2"), starts, ends)
            counts = self._pieces([joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            out += np.bincount(owner, counts[back], len(texts)).astype(np.int64)
        for i in whole:
            out[i] = self._by_library(texts[i])
        return out

    def _by_library(self, text: str) -> int:
        """A text with special tokens or uncertain code points: cut at its special tokens and by the library's pre-tokenizer, merged here."""
        parts = self.merges.special.split(text) if self.merges.special else [text]
        total = len(parts) - 1
        for part in parts:
            pieces = [text_of for text_of, _ in self.merges.lib.pre_tokenizer.pre_tokenize_str(part)] if part else []
            total += int(self._pieces([bytes(_BYTE_OF[c] for c in p) for p in pieces]).sum()) if pieces else 0
        return total

    def _pieces(self, pieces: list) -> np.ndarray:
        """Counts of pieces (str, or bytes where the library cut); new ones are merged together."""
        raw = [p.encode() if isinstance(p, str) else p for p in pieces]
        if len(self.known) + len(raw) > CACHE:
            self.known.clear()
        missing = list(dict.fromkeys(p for p in raw if p not in self.known))
        if missing:
            size = np.fromiter(map(len, missing), np.int64, len(missing))
            ends = np.cumsum(size)
            counts = self.merges.count(np.frombuffer(b"".join(missing), np.uint8), ends - size, ends)
            self.known.update(zip(missing, counts.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, raw), np.int64, len(raw))


_BYTE_OF = {chr(c): b for b, c in enumerate(BYTE_ALPHABET.tolist())}
_COUNTERS: dict[str, Counter] = {}


def counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            ids = column(batch, "doc_id")
            for lo, hi, offs, data in slices(column(batch, "text"), SLICE):
                n = counter.texts(data, offs)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
