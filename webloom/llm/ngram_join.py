"""N-gram Jaccard join with prefix trees: exact links between documents, as components.

A document's set holds its distinct k-word shingles (words are runs of anything
but \\x20 and \\x09-\\x0D, A-Z lower-cased; fewer than k words: one shingle of all;
no words: empty set, linked with nothing). Sets are ordered globally by shingle
hash. Two documents link when 100 * |A & B| >= percent * |A | B|.

1. Every set is signed. Linked sets of sizes a <= b differ in at most
   (a + b) * (100 - percent) / (100 + percent) shingles. Sizes fall into bands;
   within a band the hash range is cut into more segments than a linked pair can
   have differences, so some segments are equal in both. The content hash of a segment
   is a signature; empty segments are signed only by a set that has so many that these could be all it shares. A task signs equal sets once, so copies cost each task one set of rows.
2. Sets that share a signature form groups; equal groups are merged. In a group of up to GROUP
   sets two stay together if their sketches (counts of shingles by low hash bits) allow
   the overlap that a link needs: the sum of the smaller counts is never below it.
   That parts documents that only share a passage. A larger group is never held by a task: each of
   its sets is compared with one of them, the pivot. Where nearly all may link with it, the
   group is a star; otherwise it is compared by chunks, or, if it has many, its sets are signed again after another hash, once more together with
   the group, which parts those that have no more than a passage in common. What stays large after LEVELS levels
   is compared by chunks of GROUP sets, each pair of chunks in a task of its own.
   Signatures that are frequent within a slice of texts are dealt over SALTS tasks.
   Components of all these edges are the blocks. No link crosses two blocks.
3. A block is cut into pieces of bounded size. In each piece sets are ordered by frequency, then hash, and
   stored in a trie with compressed paths. Probes walk the trie together, sharing the
   overlaps of common prefixes; a probe leaves a subtree when its overlap so far plus
   what can remain in probe and subtree is below the overlap that a link needs,
   or when the subtree's sets are all known to be connected with the probe.
   Where a block has several pieces, one set of its largest component then visits every piece, which
   joins what belongs together in a large group of near copies. Sets that are still outside the block's largest
   component, and only these, visit all pieces of the block.
4. Links found span the components.

Whether two documents link is decided on the counts of equal 64-bit shingle
hashes over whole sets.

Defined cases: null text has no words; null or repeated doc_id are ordinary rows
(the smallest doc_id of a component ignores nulls; a component of nulls only has
null); an empty table gives an empty table; other columns are ignored by
components_of() and carried by dedup().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import attach, components, fresh, keyed_filter, map_arrow, save
from webloom.llm._text import U64, column, mix, shingle_sets, slices

#: What one piece of a block may hold: shingles, and about so many sets.
PIECE_SHINGLES, PIECE_SETS = 400_000, 128
#: Largest group whose sets are compared with each other; levels of signing; sets of a slice that make a signature frequent; tasks it is dealt over.
GROUP, LEVELS, FREQUENT, SALTS = 512, 2, 32, 64
#: Percent of a big group's sets that may link with its pivot where it is a star.
DENSE = 95


class Bands:
    """Size bands and the number of hash segments in each, for one threshold."""

    def __init__(self, percent: int):
        low, ratio = [1], max(2**0.5, 100 / percent)  # so that a link leads to the next band at most
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * ratio)))
        self.top = np.array(low[1:]) - 1
        #: Largest partner of a band's sets.
        self.reach = self.top * 100 // percent
        differences = (self.top + self.reach) * (100 - percent) // (100 + percent)
        #: Segments beyond the differences: up to so many empty segments a linked pair has others in common.
        self.slack = 1 + differences // 25
        self.segments = differences + 1 + self.slack

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, sizes)


def _keys(text: np.ndarray, sh: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's set begins, set sizes, and a content key for each set (0 for the empty set)."""
    first = np.searchsorted(text, np.arange(n + 1))
    keys = np.array([int.from_bytes(hashlib.blake2b(sh[first[i] : first[i + 1]].tobytes(), digest_size=8).digest(), "little", signed=True) if first[i + 1] > first[i] else 0 for i in range(n)], np.int64)
    return first, np.diff(first), keys


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Counts (255: or more) of tokens by their low bits: 32 to 4096 buckets, 4 to 8 tokens each on average."""
    buckets = 32
    while buckets * 8 < len(tokens) and buckets < 4096:
        buckets *= 2
    return np.minimum(np.bincount((tokens & U64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows over the same buckets; a count of 255 may be any."""
    arrays = [np.frombuffer(x, np.uint8).astype(np.int32) for x in sketches]
    least = min(map(len, arrays))
    return np.stack([np.where(a == 255, 1 << 24, a).reshape(-1, least).sum(0) for a in arrays])


def may_link(sketches: list[bytes], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning edges of the graph of sets whose sketches allow a link."""
    rows, part, edges = _folded(sketches), np.arange(len(sizes)), []
    for i in range(len(sizes) - 1):
        other = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        if not len(other):
            continue
        overlap = np.minimum(rows[other], rows[i]).sum(1)
        for j in other[overlap * (100 + percent) >= percent * (sizes[other] + sizes[i])].tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                edges.append((i, j))
    return edges


def _sets_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = column(batch, "doc_id"), column(batch, "rep")
            for lo, hi, offs, data in slices(column(batch, "text")):
                text, sh = shingle_sets(data, offs, k)
                first, sizes, keys = _keys(text, sh, hi - lo)
                sketches = pa.array([sketch(sh[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(keys, mask=sizes == 0), rows.slice(lo, hi - lo), sketches], ["doc_id", "n_shingles", "set_key", "rep", "sketch"])

    return run


def _signatures(first: np.ndarray, sizes: np.ndarray, sh: np.ndarray, bands: Bands, chosen: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set index, signature) of the chosen sets in the given bands. sh: ordered within each set."""
    segments = bands.segments[band]
    length = sizes[chosen]
    base = np.concatenate([[0], np.cumsum(segments)])
    at = np.repeat(first[chosen] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    tokens = sh[at]
    seg = ((tokens >> U64(32)) * np.repeat(segments.astype(U64), length)) >> U64(32)
    group = np.repeat(base[:-1], length) + seg.astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    sums = np.add.reduceat(mix(tokens), edge) if len(edge) else np.zeros(0, U64)
    used = group[edge]
    owner = np.searchsorted(base, used, "right") - 1
    place = (used - base[owner]).astype(U64)
    filled = np.bincount(owner, minlength=len(chosen))
    # A set with more empty segments than the slack covers signs its empty segments as well.
    for i in np.flatnonzero(segments - filled > bands.slack[band]):
        empty = np.setdiff1d(np.arange(segments[i]), place[owner == i].astype(np.int64))
        owner, place, sums = np.concatenate([owner, np.full(len(empty), i)]), np.concatenate([place, empty.astype(U64)]), np.concatenate([sums, np.zeros(len(empty), U64)])
    return chosen[owner], mix(sums + mix(place + (band[owner].astype(U64) << U64(32)) + U64(1)))


def _sign_task(k: int, percent: int, level: int = 0):
    """(sig, salt, set_key): salt 0, or for signatures frequent in a slice 1 to SALTS, and one row with salt -1 that tells of it.

    level 0 takes text; others take text, want (the set key) and grps, the groups that are signed again.
    """
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, offs, data in slices(column(batch, "text")):
                text, sh = shingle_sets(data, offs, k)
                first, sizes, keys = _keys(text, sh, hi - lo)
                _, once = np.unique(keys, return_index=True)
                new = np.array([i for i in once if sizes[i] and keys[i] not in seen], np.int64)
                if not len(new):
                    continue
                seen.update(keys[new].tolist())
                if level:
                    sh = mix(sh + U64(level) * U64(0x9E3779B97F4A7C15))
                    sh = sh[np.lexsort((sh, text))]
                own = bands.of(sizes[new])
                # A set also stands in the band below while a set of that band can link with it.
                lower = (own > 0) & (sizes[new] <= bands.reach[np.maximum(own - 1, 0)])
                parts = [_signatures(first, sizes, sh, bands, new, own), _signatures(first, sizes, sh, bands, new[lower], own[lower] - 1)]
                who, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
                if level:
                    lists = column(batch, "grps").slice(lo, hi - lo)
                    n = np.diff(lists.offsets.to_numpy())
                    begin, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy().view(U64)
                    times = n[who]
                    at = np.repeat(begin[who] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                    who, sig = np.repeat(who, times), mix(np.repeat(sig, times) ^ mix(flat[at]))
                _, where, back, count = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
                often = count >= FREQUENT
                salt = np.where(often[back], 1 + (mix(keys[who].view(U64)) % U64(SALTS)).astype(np.int64), 0)
                told = where[often]
                sig, salt, who = np.concatenate([sig, sig[told]]), np.concatenate([salt, np.full(len(told), -1)]), np.concatenate([who, who[told]])
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(salt, pa.int32()), pa.array(keys[who])], ["sig", "salt", "set_key"])

    return run


def _groups_task(limit: int):
    """Rows come sorted by signature, salt (-1 and 0 meet) and key. Out: (grp, set_key, big) for signatures of several sets.

    A group of up to limit sets is told by its members, so that equal groups are one; a big one by its signature, and passes through without being held.
    """

    def out(grp: np.ndarray, key: np.ndarray, big: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grp.view(np.int64)), pa.array(key), pa.array(np.full(len(key), big))], ["grp", "set_key", "big"])

    def groups(sig: np.ndarray, salt: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = np.concatenate([[True], (sig[1:] != sig[:-1]) | (np.maximum(salt[1:], 0) != np.maximum(salt[:-1], 0))])
        owner = np.cumsum(run) - 1
        told = np.zeros(owner[-1] + 1, bool)
        told[owner[salt != 0]] = True
        told |= np.bincount(owner) > limit
        big = told[owner]
        if big.any():
            yield out(sig[big], key[big], True)
        sig, key = sig[~big], key[~big]
        if not len(sig):
            return
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[new], key[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        tag = mix(np.add.reduceat(mix(key.view(U64)), start) + size.astype(U64))
        several = np.repeat(size > 1, size)
        yield out(np.repeat(tag, size)[several], key[several], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("sig", "salt", "set_key")
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        passing = None  # the (signature, salt) of a big group whose rows still come
        for batch in batches:
            sig, salt, key = (np.concatenate([h, column(batch, c).to_numpy()]) for h, c in zip(held, names, strict=True))
            if not len(sig):
                continue
            dealt = np.maximum(salt, 0)
            same = int(np.argmin(np.append((sig == passing[0]) & (dealt == passing[1]), False))) if passing else 0
            if same:
                yield out(sig[:same], key[:same], True)
            last = (sig == sig[-1]) & (dealt == dealt[-1])
            cut = max(same, int(np.argmax(last)))
            if cut > same:
                yield from groups(sig[same:cut], salt[same:cut], key[same:cut])
            if cut < len(sig) and (len(sig) - cut > 2 * limit or salt[cut] != 0):
                passing = (sig[-1], dealt[-1])
                yield out(sig[cut:], key[cut:], True)
                cut = len(sig)
            elif cut < len(sig):
                passing = None
            held = [sig[cut:], salt[cut:], key[cut:]]
        if len(held[0]):
            yield from groups(*held)

    return run


def _edges_task(percent: int):
    """Rows come sorted by group, two chunks of about GROUP sets at most: edges (a, b) between sets of a group that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sizes, sketches = None, [], [], []

        def done() -> pa.RecordBatch:
            edges = may_link(sketches, np.array(sizes), percent) if len(keys) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[e[i]] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for g, k, n, x in zip(*(column(batch, c).to_pylist() for c in ("grp", "set_key", "n_shingles", "sketch")), strict=True):
                if g != group:
                    if len(keys) > 1:
                        yield done()
                    group, keys, sizes, sketches = g, [], [], []
                keys.append(k)
                sizes.append(n)
                sketches.append(x)
        if len(keys) > 1:
            yield done()

    return run


def _pivot_task(percent: int):
    """Whether each set may link with its group's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in ("sketch", "pivot_sketch", "n_shingles", "pivot_size")]
            may = [bool(may_link([a, b], np.array([n, m]), percent)) for a, b, n, m in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "grp"), column(batch, "set_key"), column(batch, "pivot"), pa.array(may, pa.bool_())], ["grp", "set_key", "pivot", "may"])

    return run


def _stars(big: DataFrame, chosen: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, middling, rest): big groups of whose sets DENSE percent may link with their pivot, as stars; (grp, set_key) of others, of some chunks, and larger."""
    # The set that stands in most of the big groups is nearest to what their sets have in common.
    often = big.groupBy("set_key").agg(F.count(F.lit(1)).alias("times"))
    by = big.join(often, "set_key").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max_by("set_key", F.struct("times", "set_key")).alias("pivot"))
    told = chosen.select(F.col("set_key").alias("pivot"), F.col("sketch").alias("pivot_sketch"), F.col("n_shingles").alias("pivot_size"))
    pivots = save(by.join(told, "pivot"), "pivots")
    both = attach(big.join(chosen.select("set_key", "n_shingles", "sketch"), "set_key"), pivots, "grp", "n", big.count())
    seen = save(map_arrow(both.select("grp", "set_key", "pivot", "sketch", "pivot_sketch", "n_shingles", "pivot_size"), _pivot_task(percent), "grp long, set_key long, pivot long, may boolean"), "pivoted")
    dense = save(seen.groupBy("grp").agg(F.avg(F.col("may").cast("int") * 100).alias("share"), F.count(F.lit(1)).alias("n")), "dense")
    of = lambda which: keyed_filter(seen, dense.filter(which).select("grp"), "grp", "left_semi")
    loose = F.col("share") < DENSE
    return of(~loose).select(F.col("set_key").alias("a"), F.col("pivot").alias("b")), of(loose & (F.col("n") <= 4 * GROUP)).select("grp", "set_key"), of(loose & (F.col("n") > 4 * GROUP)).select("grp", "set_key")


def _by_chunks(rest: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Edges within groups that signing again doesn't part: about GROUP sets at a time meet as many others of their group, for each pair of such chunks in a task of its own."""
    sizes = save(rest.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / GROUP).cast("int")), "chunks")
    rows = attach(rest.join(chosen.select("set_key", "n_shingles", "sketch"), "set_key"), sizes, "grp", "n", rest.count())
    rows = rows.withColumn("x", F.pmod(F.xxhash64("set_key"), F.col("chunks")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = rows.select(F.xxhash64("grp", F.least("x", "y"), F.greatest("x", "y")).alias("grp"), "set_key", "n_shingles", "sketch")
    return map_arrow(met.repartition("grp").sortWithinPartitions("grp"), _edges_task(percent), "a long, b long")


def _blocks(docs: DataFrame, rows: DataFrame, chosen: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root): sets by the block that holds all their links."""
    signed = map_arrow(docs.select("text"), _sign_task(k, percent), "sig long, salt int, set_key long")
    edges: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        dealt = signed.repartition(F.col("sig"), F.greatest("salt", F.lit(0))).sortWithinPartitions("sig", F.greatest("salt", F.lit(0)), "salt", "set_key")
        groups = save(map_arrow(dealt, _groups_task(GROUP), "grp long, set_key long, big boolean").distinct(), "groups")
        small = groups.filter("not big").join(chosen, "set_key").select("grp", "set_key", "n_shingles", "sketch")
        edges.append(map_arrow(small.repartition("grp").sortWithinPartitions("grp"), _edges_task(percent), "a long, b long"))
        big = groups.filter("big").select("grp", "set_key")
        if big.isEmpty():
            break
        star, middling, rest = _stars(big, chosen, percent)
        edges += [star, _by_chunks(middling, chosen, percent)]
        if rest.isEmpty():
            break
        if level == LEVELS:
            edges.append(_by_chunks(rest, chosen, percent))
            break
        # A set has no more groups than signatures.
        again = save(rest.groupBy("set_key").agg(F.collect_list("grp").alias("grps")).join(chosen.select("set_key", "rep"), "set_key").select("rep", "grps"), "again")
        signed = map_arrow(keyed_filter(rows.select("text", "rep"), again, "rep", "inner").select("text", "grps"), _sign_task(k, percent, level), "sig long, salt int, set_key long")
    return components(reduce(DataFrame.union, edges), "blocks")


def _content_task(k: int):
    """The ordered sets of those rows whose own key is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "pieces", "piece", "want")
        for batch in batches:
            for lo, hi, offs, data in slices(column(batch, "text")):
                text, sh = shingle_sets(data, offs, k)
                first, sizes, keys = _keys(text, sh, hi - lo)
                cols = [column(batch, c).slice(lo, hi - lo) for c in names]
                right = np.flatnonzero((keys == cols[3].to_numpy()) & (sizes > 0))
                tokens = pa.array([sh[first[i] : first[i + 1]].tobytes() for i in right], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(right)) for c in cols), tokens], ["block", "pieces", "piece", "set_key", "tokens"])

    return run


class Trie:
    """Prefix tree over rank-ordered sets, walked by many probes at once.

    Sets stand in lexicographic order, so a node is a run [a, b) of them with a common prefix, and
    prefix lengths of neighbours give its children; paths without branches are one step. A walk
    carries, down each path, the probes that can still reach the needed overlap with some set below,
    and their overlaps so far.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.order, self.sets = np.array(order), [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        #: Length of the prefix that each set has in common with the one before it.
        self.common = np.zeros(len(sets) + 1, np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.common[i] = differ[0] if len(differ) else n

    def depth(self, a: int, b: int) -> int:
        """Length of the prefix of all sets of a run."""
        return int(self.sizes[a]) if b == a + 1 else int(self.common[a + 1 : b].min())

    def children(self, a: int, b: int, depth: int) -> list[tuple[int, int]]:
        cuts = [a, *(np.flatnonzero(self.common[a + 1 : b] == depth) + a + 1).tolist(), b]
        return list(zip(cuts[:-1], cuts[1:], strict=True))


class Probes:
    """Sets that walk: which of them hold a token. Frequent tokens (the first ranks) have a row of flags, others a list."""

    def __init__(self, sets: list[np.ndarray], vocabulary: int):
        self.sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        self.vocabulary, self.keys = vocabulary, owner * vocabulary + flat  # ascending
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        order = np.argsort(flat, kind="stable")
        self.owners, self.start = owner[order], np.searchsorted(flat[order], np.arange(vocabulary + 1))
        count = np.diff(self.start)
        # Flags take 1 byte a set: 16 bytes for each token of the sets at most.
        frequent = np.flatnonzero(count * 16 >= len(sets))
        self.row = np.full(vocabulary, -1)
        self.row[frequent] = np.arange(len(frequent))
        self.flags = np.zeros((len(frequent), len(sets)), np.uint8)
        inside = self.row[flat] >= 0
        self.flags[self.row[flat[inside]], owner[inside]] = 1

    def count(self, tokens: np.ndarray, live: np.ndarray) -> np.ndarray:
        """How many of at most 255 tokens each live probe holds."""
        rows = self.row[tokens]
        dense = rows[rows >= 0]
        part = self.flags[dense].sum(0, dtype=np.uint8)[live] if len(live) * 2 > len(self.sizes) else self.flags[dense[:, None], live].sum(0, dtype=np.uint8)
        out = part.astype(np.int64)
        if rare := [self.owners[self.start[t] : self.start[t + 1]] for t in tokens[rows < 0].tolist() if self.start[t] != self.start[t + 1]]:
            out += np.bincount(np.concatenate(rare), minlength=len(self.sizes))[live]
        return out

    def left(self, rank: int, live: np.ndarray) -> np.ndarray:
        """How many tokens after a rank each live probe has."""
        return self.first[live + 1] - np.searchsorted(self.keys, live * self.vocabulary + rank, "right")


#: Tokens of a path taken at a time, between two looks at the bounds.
STRIDE = 48


def walk(trie: Trie, probes: Probes, percent: int, names: np.ndarray, offset: int | None) -> list[tuple[int, int]]:
    """Spanning links (set, probe) between the trie's sets and probes; numbers below len(names).

    names: a component for each number; the trie's set i is number order[i]; probe j is number j + offset, or
    number j where offset is None: then the probes are the trie's own sets, and each pair is tried once.
    """
    links: list[tuple[int, int]] = []
    place = np.empty(len(trie.sets), np.int64)
    place[trie.order] = np.arange(len(trie.sets))
    shift = offset or 0
    everyone = np.arange(len(probes.sizes))
    stack = [(0, len(trie.sets), 0, everyone, np.zeros(len(everyone), np.int64))]
    while stack:
        a, b, depth, live, overlap = stack.pop()
        low, high = int(trie.sizes[a:b].min()), int(trie.sizes[a:b].max())
        keep = (probes.sizes[live] * percent <= high * 100) & (low * percent <= probes.sizes[live] * 100)
        if offset is None:
            keep &= place[live] < b - 1
        below = names[trie.order[a:b]]
        if (below == below[0]).all():
            keep &= names[live + shift] != below[0]
        live, overlap = live[keep], overlap[keep]
        end = trie.depth(a, b)
        path = trie.sets[a]
        while depth < end and len(live):
            tokens = path[depth : min(end, depth + STRIDE)]
            overlap = overlap + probes.count(tokens, live)
            depth += len(tokens)
            n = probes.sizes[live]
            least = -(-percent * (n + np.maximum(low, -(-n * percent // 100))) // (100 + percent))
            ok = overlap + (high - depth) >= least
            live, overlap, least = live[ok], overlap[ok], least[ok]
            ok = overlap + probes.left(int(tokens[-1]), live) >= least
            live, overlap = live[ok], overlap[ok]
        if not len(live):
            continue
        full = a
        while full < b and trie.sizes[full] == end:  # equal sets are one set, so at most one
            n = probes.sizes[live]
            hits = live[(100 * overlap >= percent * (n + end - overlap))]
            for j in hits[names[hits + shift] != names[trie.order[full]]].tolist():
                x, y = int(trie.order[full]), j + shift
                if names[x] != names[y]:
                    names[names == names[y]] = names[x]
                    links.append((x, y))
            full += 1
        if full < b:
            stack += [(x, y, end, live, overlap) for x, y in trie.children(a, b, end) if y > full]
    return links


def join_block(sets: list[tuple[int, int, np.ndarray]], percent: int, apart: bool, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning links among (side, key, tokens); apart: only between the two sides. roots: components that are known already."""
    if apart:
        order = sorted(range(len(sets)), key=lambda i: sets[i][0])
        sets, roots = [sets[i] for i in order], roots and [roots[i] for i in order]
    vocabulary, rank, count = np.unique(np.concatenate([t for _, _, t in sets]), return_inverse=True, return_counts=True)
    order = np.empty(len(vocabulary), np.int64)
    order[np.lexsort((vocabulary, -count))] = np.arange(len(vocabulary))
    rank = order[rank]
    ends = np.cumsum([len(t) for _, _, t in sets])
    ranks = [np.sort(rank[e - len(t) : e]) for e, (_, _, t) in zip(ends.tolist(), sets, strict=True)]
    half = sum(p == sets[0][0] for p, _, _ in sets) if apart else len(sets)
    if apart and half == len(sets):
        return []
    trie, probes = Trie(ranks[:half]), Probes(ranks[half:] if apart else ranks, len(vocabulary))
    names = np.unique(np.array(roots, np.int64), return_inverse=True)[1] if roots else np.arange(len(sets))
    found = walk(trie, probes, percent, names, half if apart else None)
    return [(sets[x][1], sets[y][1]) for x, y in found]


def _join_task(percent: int):
    """Rows (block, x, y, side, set_key, root, tokens) come sorted by block, x, y; each such group has bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, int | None]] = {}
        group = None

        def done() -> pa.RecordBatch:
            sides = {s for s, _ in held}
            roots = [r for _, r in held.values()]
            sets = [(s, k, t) for (s, k), (t, _) in held.items()]
            wanted = len(held) > 1 and (group[2] < 0 or len(sides) > 1)
            links = join_block(sets, percent, group[2] >= 0, None if None in roots else roots) if wanted else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            block, x, y, side, key, root = (column(batch, c).to_pylist() for c in ("block", "x", "y", "side", "set_key", "root"))
            for i, tokens in enumerate(column(batch, "tokens")):
                if (g := (block[i], x[i], y[i])) != group:
                    if held:
                        yield done()
                    group, held = g, {}
                held[side[i], key[i]] = (np.frombuffer(tokens.as_buffer(), U64).copy(), root[i])
        if held:
            yield done()

    return run


def _joined(rows: DataFrame, percent: int, what: str) -> DataFrame:
    """Links within the groups (block, x, y) of rows, saved."""
    dealt = rows.select("block", "x", "y", "side", "set_key", "root", "tokens").repartition("block", "x", "y").sortWithinPartitions("block", "x", "y")
    return save(map_arrow(dealt, _join_task(percent), "a long, b long"), what)


def _across(contents: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between the pieces of the blocks that have several: contents (block, pieces, piece, set_key, tokens), links within pieces."""
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def rooted(found: DataFrame, what: str) -> DataFrame:
        root = components(found, what).select(F.col("node").alias("set_key"), "root")
        return save(contents.join(root, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")), what)

    known = rooted(links, "within")
    largest = lambda rows: rows.groupBy("block", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    pivots = known.join(largest(known).select(F.col("main").alias("set_key")), "set_key", "left_semi")
    visits = pivots.select("block", number("pieces").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("side"), "set_key", "root", "tokens")
    home = known.select("block", F.col("piece").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "set_key", "root", "tokens")
    found = links.union(_joined(home.union(visits), percent, "pivot-links"))
    known = rooted(found, "pivoted-blocks")
    main = save(largest(known), "main")
    out = keyed_filter(known, main, "block", "inner").filter("root <> main")
    parts = out.groupBy("block").agg(F.ceil(F.greatest(F.sum(F.octet_length("tokens")) / 8 / PIECE_SHINGLES, F.count(F.lit(1)) / PIECE_SETS)).cast("int").alias("parts"))
    parts = save(parts, "outside")
    if parts.isEmpty():
        return found
    visits = keyed_filter(out, parts, "block", "inner").select("block", number("pieces").alias("x"), F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("parts")).cast("int").alias("y"), F.lit(1).alias("side"), "set_key", "root", "tokens")
    home = keyed_filter(known, parts, "block", "inner").select("block", F.col("piece").alias("x"), number("parts").alias("y"), F.lit(0).alias("side"), "set_key", "root", "tokens")
    return found.union(_joined(home.union(visits), percent, "outside-links"))


def links_of(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_id, n_shingles, set_key of each document, and spanning links (a, b) between set keys. docs: doc_id, text."""
    rows = docs.withColumn("rep", F.xxhash64("doc_id", "text"))
    sets = save(map_arrow(rows, _sets_task(k), "doc_id long, n_shingles long, set_key long, rep long, sketch binary"), "sets")
    chosen = sets.filter("set_key is not null").groupBy("set_key").agg(F.min("rep").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    chosen = save(chosen, "chosen")
    blocks = _blocks(docs, rows, chosen, k, percent)
    members = save(blocks.join(chosen, blocks.node == chosen.set_key).select(F.col("root").alias("block"), "set_key", "n_shingles", "rep"), "members")
    weight = members.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.greatest(F.sum("n_shingles") / PIECE_SHINGLES, F.count(F.lit(1)) / PIECE_SETS)).cast("int").alias("pieces"))
    sized = attach(members, save(weight, "weight"), "block", "n", members.count())
    placed = save(sized.select("rep", "block", "pieces", F.pmod(F.xxhash64("set_key"), F.col("pieces")).cast("int").alias("piece"), F.col("set_key").alias("want")), "placed")
    texts = keyed_filter(rows.select("text", "rep"), placed, "rep", "inner").select("text", "block", "pieces", "piece", "want")
    contents = save(map_arrow(texts, _content_task(k), "block long, pieces int, piece int, set_key long, tokens binary"), "contents")
    none = F.lit(None).cast("long").alias("root")
    links = _joined(contents.select("block", F.col("piece").alias("x"), F.lit(-1).alias("y"), F.lit(0).alias("side"), "set_key", none, "tokens"), percent, "links")
    cut = contents.filter("pieces > 1")
    return sets, links if cut.isEmpty() else _across(cut, links, percent)


def components_of(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id reachable by links (its own where it has none)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets, links = links_of(rows, k, percent)
    roots = components(links, "links").select(F.col("node").alias("set_key"), "root")
    by_key = sets.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    rooted = save(by_key.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = save(rooted.join(least, "root").select("set_key", "size", "component_id"), "told")
    out = attach(sets.filter("set_key is not null"), told, "set_key", "size", sets.count())
    return out.select("doc_id", "n_shingles", "component_id").unionByName(sets.filter("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with its smallest identifier (null ones last, then by a hash of identifier and text). Rows without a word stay."""
    doc_id, text = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    sets, links = links_of(docs.select(doc_id, text), k, percent)
    sets = sets.filter("set_key is not null")
    roots = components(links, "links").select(F.col("node").alias("set_key"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rep")
    by_key = sets.groupBy("set_key").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("size"))
    rooted = save(by_key.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")), "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    told = save(rooted.join(first, "root").select("set_key", "size", F.col("first.rep").alias("kept")), "told")
    verdicts = attach(sets, told, "set_key", "size", sets.count()).groupBy("rep").agg(F.max(F.col("rep") == F.col("kept")).alias("kept"), F.count(F.lit(1)).alias("n"))
    mark = fresh(docs, "rep")
    verdicts = save(verdicts.select(F.col("rep").alias(mark), "kept", "n"), "verdicts")
    rest = keyed_filter(docs.withColumn(mark, F.xxhash64(doc_id, text)), verdicts.filter(~F.col("kept")).select(mark), mark, "left_anti")
    twice = verdicts.filter("kept and n > 1").select(mark)
    if twice.isEmpty():
        return rest.drop(mark)
    return keyed_filter(rest, twice, mark, "left_anti").union(keyed_filter(rest, twice, mark, "left_semi").dropDuplicates([mark])).drop(mark)


def brute_force(rows: list[tuple[int, str | None]], k: int, percent: int) -> list[tuple[int, int, int]]:
    """What components_of gives, from all pairs of explicit sets: for tests."""
    sets = []
    for _, text in rows:
        words = bytes((text or "").encode()).lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and sets[j] and 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))

