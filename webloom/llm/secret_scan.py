"""Secret scan: fixed patterns, plus a randomness test battery with false-discovery control.

Base kinds, leftmost and non-overlapping: assign (a credential name, a separator
and a value of 8 or more characters), access (AKIA and more, 16 or more
characters), hex (runs of 32 or more of 0-9a-f). The method adds kind random:

1. Candidates are maximal runs of [A-Za-z0-9+/_-] of 20 or more characters whose
   encoding can be inferred: hex, HEX, base32, one case of letters with digits and marks,
   base64, or letters alone; runs of digits only are numbers.
2. Each candidate is tested against the hypothesis that it is text-like, at its own length:
   (a) chi-squared uniformity of the inferred alphabet, digits, marks and both cases included:
   hexadecimal digits one by one, of other alphabets the characters pooled into cells that each
   expect enough of them. Text is far from uniform use, so under the hypothesis the statistic is
   a noncentral chi-squared variable (its normal approximation), whose noncentrality is what the
   cells' use in text gives for this alphabet, times SAFE; p is the chance to be so near to
   uniform. (b) Runs of character classes (digit, lower, upper case), of which text has fewer: a
   binomial tail. (c) Lag-1 serial correlation: of vowels among neighbouring letters, which
   alternate in text (RHO); in hexadecimal, of alphabet positions, high where digits follow a
   pattern (PATTERN). Small p: not text. The p-values of the tests that apply are joined by
   Fisher's method. Sequences and repeats are neither text nor random: a candidate whose
   positions correlate at LEVEL has p = 1.
3. Benjamini-Hochberg at rate Q over all candidates of the corpus, separately in
   each band of lengths, on a grid of p-values (0.1 in log10, rounded towards 1,
   so the control stays on the safe side). The table of counts has a fixed size,
   bands x grid cells.

What lies inside a base span is not tested: it is reported already.

Offsets are code points, ends exclusive. Defined cases: null text counts as
empty; null and repeated doc_id are ordinary rows; an empty table gives an empty
table; other columns are ignored by scan() and carried by drop_documents().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm._common import fresh, keyed_filter, map_arrow, save
from webloom.llm._text import LOWER, column, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as [0-9a-f]+ finds it, of 32 or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Level of false discoveries among added spans.
Q = 0.01
#: Cells of letters and the share of a text's letters in each: rounded averages of English, French, German and Spanish.
#: Shares of capitals among letters, of digits and of marks in identifiers and paths. All of this, and the constants below, was set on words of these four languages joined
#: as identifiers, compounds and paths; tests hold it against words of six other languages.
CELLS_OF = ("aeiou", "nrstld", "bcfghmp", "jkqvwxyz")
SHARES = (0.40, 0.36, 0.18, 0.06)
CAPITALS, DIGITS, MARKS = 0.2, 0.04, 0.08
#: Under the hypothesis: share of the noncentrality that counts where both cases, or one case, are in use (names and other languages are nearer to uniform); noncentrality per hexadecimal digit; chance that the next character is of another class, for
#: identifiers of capitalised words and for a single case with digits; correlation of vowels (text has about -0.35, the
#: nearer to 0 the safer); correlation of patterned digits. Level of the test for sequences and repeats.
SAFE, SAFE_ONE_CASE, UNEVEN, TURNS, TURNS_ONE_CASE, RHO, PATTERN, LEVEL = 1.0, 0.8, 0.6, 0.35, 0.2, -0.2, 0.5, 0.005
#: From LONG characters on, where the hypothesis is told apart easily, only LONG_SHARE of the noncentrality counts: what a language misses of it grows with the length.
LONG, LONG_SHARE = 56, 0.8
#: Letters, or pairs of them, that a test needs.
ENOUGH = 8
#: Length bands (upper ends) and grid cells of -log10 p.
BANDS = (23, 27, 31, 39, 47, 63, 95, 127, 255, 511, 1 << 62)
CELLS, CELL = 3000, 0.1

_IN_RUN = np.zeros(256, bool)
_IN_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_LOW, _UP, _DIGITS, _MARKS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-"
_LETTERS = frozenset("".join(CELLS_OF))


def encoding(s: str) -> str | None:
    """Alphabet that a run is written in: its characters in order. None for numbers."""
    low, up, dig, mark = (any(c in kind for c in s) for kind in (_LOW, _UP, _DIGITS, _MARKS))
    if not (low or up):
        return None
    for alphabet in (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _UP + "234567"):
        if dig and set(s) <= set(alphabet):
            return alphabet
    marks = [pair for pair in ("+/", "_-") if any(c in pair for c in s)] if mark else []
    return _UP * up + _LOW * low + _DIGITS * dig + "".join(marks)


@lru_cache(10_000)
def _pools(alphabet: str) -> tuple[dict[str, int], np.ndarray, float]:
    """Cell of each character of an alphabet, the cells' shares under uniform use, and the noncentrality per character under the hypothesis."""
    if len(alphabet) == 16:
        return {c: i for i, c in enumerate(alphabet)}, np.full(16, 1 / 16), UNEVEN
    up, low = _UP[0] in alphabet, _LOW[0] in alphabet
    rest = [(kind, share) for kind, share in ((_DIGITS, DIGITS), (_MARKS, MARKS)) if any(c in kind for c in alphabet)]
    words = 1 - sum(share for _, share in rest)
    cells = [(cell, words * share * (1 - CAPITALS if up else 1)) for cell, share in zip(CELLS_OF, SHARES, strict=True) if low]
    cells += [(cell.upper(), words * share * (CAPITALS if low else 1)) for cell, share in zip(CELLS_OF, SHARES, strict=True) if up]
    cells = [([c for c in kind if c in alphabet], share) for kind, share in cells + rest]
    even = np.array([len(chars) / len(alphabet) for chars, _ in cells])
    text = np.array([share for _, share in cells])
    return {c: i for i, (chars, _) in enumerate(cells) for c in chars}, even, (SAFE if up and low else SAFE_ONE_CASE) * float(((text - even) ** 2 / even).sum())


def _normal(z: float) -> float:
    """Chance of at most z, at least the smallest p-value in use."""
    return max(1e-300, 0.5 * math.erfc(-z / math.sqrt(2)))


@lru_cache(100_000)
def _at_least(turns: int, n: int, chance: float) -> float:
    """Chance of so many turns or more in n places."""
    if turns <= n * chance:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(chance) + (n - i) * math.log1p(-chance) for i in range(turns, min(n, turns + 200) + 1)]
    return min(1.0, max(1e-300, sum(map(math.exp, logs))))


def _correlation(x: list[float], y: list[float]) -> float:
    """Correlation of two lists; 0.999 where one of them doesn't vary."""
    a, b = np.array(x) - np.mean(x), np.array(y) - np.mean(y)
    spread = math.sqrt(float((a * a).sum() * (b * b).sum()))
    return min(0.999, max(-0.999, float((a * b).sum()) / spread)) if spread else 0.999


def uniformity(s: str, alphabet: str) -> tuple[float, int, float]:
    """Chi-squared statistic of uniform use of an alphabet's cells, its degrees of freedom and its noncentrality under the hypothesis."""
    cell, even, apart = _pools(alphabet)
    n = len(s)
    counts = np.bincount([cell[c] for c in s], minlength=len(even))
    return float(((counts - n * even) ** 2 / (n * even)).sum()), len(even) - 1, n * apart * (LONG_SHARE if n >= LONG else 1)


def _so_even(chi: float, f: int, lam: float) -> float:
    """Chance of at most chi for a noncentral chi-squared variable: Sankaran's cube-root normal."""
    h = 1 - 2 * (f + lam) * (f + 3 * lam) / (3 * (f + 2 * lam) ** 2)
    p, m = (f + 2 * lam) / (f + lam) ** 2, (h - 1) * (1 - 3 * h)
    return _normal(((chi / (f + lam)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p)))


def battery(s: str) -> tuple[list[float], float] | None:
    """(p-values of the tests against text-likeness that apply, p-value of a pattern in the positions); None for numbers and what has too few letters."""
    alphabet = encoding(s)
    if alphabet is None:
        return None
    place = {c: i for i, c in enumerate(alphabet)}
    x = [place[c] for c in s]
    r = abs(_correlation(x[:-1], x[1:]))
    depth = math.sqrt(max(1, len(s) - 3))
    pattern = max(1e-300, math.erfc(math.atanh(r) * depth / math.sqrt(2)))
    ps = [_so_even(*uniformity(s, alphabet))]
    if len(alphabet) == 16:
        ps.append(_normal((math.atanh(r) - math.atanh(PATTERN)) * depth))
    else:
        folded = s.lower()
        if sum(c in _LETTERS for c in folded) < ENOUGH:
            return None
        pairs = [(float(a in "aeiou"), float(b in "aeiou")) for a, b in zip(folded, folded[1:], strict=False) if a in _LETTERS and b in _LETTERS]
        if len(pairs) >= ENOUGH:
            v = _correlation(*map(list, zip(*pairs, strict=True)))
            v = 0.0 if v == 0.999 else v
            ps.append(_normal(-(math.atanh(v) - math.atanh(RHO)) * math.sqrt(len(pairs) - 3)))
    classes = ["d" if c in _DIGITS else "l" if c in _LOW else "u" for c in s if c not in _MARKS]
    if len(kinds := set(classes)) > 1:
        turns = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
        ps.append(_at_least(turns, len(classes) - 1, TURNS if {"l", "u"} <= kinds else TURNS_ONE_CASE))
    return ps, pattern


def fisher(ps: list[float]) -> float:
    """-log10 of the joint p-value: the tail of chi-squared with 2 * len(ps) degrees."""
    half = -sum(map(math.log, ps))
    tail = sum(half**i / math.factorial(i) for i in range(len(ps)))
    return max(0.0, half / math.log(10) - math.log10(tail))


def joint(tested: tuple[list[float], float]) -> float:
    """-log10 of a candidate's p-value."""
    return 0.0 if tested[1] <= LEVEL else fisher(tested[0])


def candidates(text: str, base: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, int, int]]:
    """(start, end, length band, grid cell) of each run that was tested: those that lie in no base span (sorted by start)."""
    out, held, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        while held < len(base) and base[held][0] <= m.start():
            reach, held = max(reach, base[held][1]), held + 1
        if m.end() > reach and (tested := battery(m[0])) is not None:
            out.append((m.start(), m.end(), next(i for i, top in enumerate(BANDS) if m.end() - m.start() <= top), min(CELLS, int(joint(tested) / CELL))))
    return out


_SCHEMA = "doc_id long, base array<struct<s:long,e:long,k:int>>, tested array<struct<s:long,e:long,band:int,cell:int>>"
_TYPES = (pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32())])), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("band", pa.int32()), ("cell", pa.int32())])))


def _suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts that hold a credential name or a run of 16 or more characters (AKIA keys, hex, candidates): only these are searched."""
    out = np.zeros(len(offs) - 1, bool)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_RUN[data]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = ends - starts >= 16
    first = np.searchsorted(offs, starts[long], "right") - 1
    last = np.searchsorted(offs, ends[long] - 1, "right") - 1
    out[first] = out[last] = True  # a run may cross from one text into the next
    for a, b in zip(first, last, strict=True):
        out[a : b + 1] = True
    low = LOWER[data].tobytes()
    for name in NAMES:
        at = low.find(name)
        while at >= 0:
            doc = int(np.searchsorted(offs, at, "right")) - 1
            out[doc] = True
            at = low.find(name, max(at + 1, int(offs[doc + 1]) - len(name)))
    return out


def _scan_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc_id")
        for lo, hi, offs, data in slices(column(batch, "text")):
            base, tested = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
            for i in np.flatnonzero(_suspects(data, offs)):
                text = data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")
                spans = base_spans(text)
                base[i] = [(s, e, KINDS.index(k)) for s, e, k in spans]
                tested[i] = candidates(text, spans)
            cols = [pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in rows], t) for rows, t, names in ((base, _TYPES[0], "sek"), (tested, _TYPES[1], ("s", "e", "band", "cell")))]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *cols], ["doc_id", "base", "tested"])


def thresholds(counts: list[tuple[int, int, int]], q: float = Q) -> dict[int, int]:
    """Least grid cell to report in each length band, by Benjamini-Hochberg. counts: (band, cell, candidates)."""
    out = {}
    for band in {b for b, _, _ in counts}:
        cells = sorted(((c, n) for b, c, n in counts if b == band), reverse=True)
        total, so_far = sum(n for _, n in cells), 0
        for cell, n in cells:
            so_far += n
            if 10 ** (-cell * CELL) * total <= q * so_far:
                out[band] = cell
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start, end) by start, then kind."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    seen = save(map_arrow(rows, _scan_task, _SCHEMA), "scanned")
    # At most len(BANDS) * (CELLS + 1) rows, whatever the input.
    counts = seen.select(F.explode("tested").alias("t")).groupBy("t.band", "t.cell").count().collect()
    least = thresholds([tuple(r) for r in counts], q)
    keep = F.lit(False)
    added = F.transform(
        F.filter("tested", lambda t: _any([(t["band"] == b) & (t["cell"] >= c) for b, c in sorted(least.items())], keep)),
        lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.lit(3).alias("k")),
    )
    ordered = F.array_sort(F.transform(F.concat("base", added), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    kind = F.array(*map(F.lit, KINDS))
    return seen.select("doc_id", F.transform(ordered, lambda x: F.struct(F.get(kind, x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end"))).alias("spans"))


def _any(tests: list, none):
    out = none
    for t in tests:
        out = out | t
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s spans."""
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", *map(of, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"))


def drop_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """docs without those that hold a secret. Rows are told by doc_id and text."""
    key = F.xxhash64(f"`{id_col}`", f"`{text_col}`")
    mark = fresh(docs, "key")
    found = scan(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), "key", "text", q).filter(F.size("spans") > 0)
    bad = save(found.select(F.col("doc_id").alias(mark)).distinct(), "secret-keys")
    return keyed_filter(docs.withColumn(mark, key), bad, mark, "left_anti").drop(mark)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", q: float = Q) -> DataFrame:
    """docs with each secret replaced by a mark; touching spans give one mark."""
    key = F.xxhash64(f"`{text_col}`")
    mark_key, held = fresh(docs, "key"), fresh(docs, "spans")
    spans = scan(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), "key", "text", q).filter(F.size("spans") > 0)
    bad = save(spans.groupBy(F.col("doc_id").alias(mark_key)).agg(F.first("spans").alias(held)), "secret-spans")
    rows = keyed_filter(docs.withColumn(mark_key, key), bad, mark_key, "left").select(*(f"`{c}`" for c in docs.columns), held)
    text = F.col(f"`{text_col}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"), x["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at")))
    done = F.aggregate(F.col(held), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, 1 << 30)))
    return rows.withColumn(text_col, F.coalesce(F.when(F.col(held).isNotNull(), done), text)).drop(held)


def base_digest(text: str | None) -> tuple[int, int, int, str]:
    """Counts of the base kinds and their digest for one text: for tests."""
    spans = base_spans(text or "")
    line = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    return *(sum(x[2] == k for x in spans) for k in KINDS[:3]), hashlib.sha256(line.encode()).hexdigest()
