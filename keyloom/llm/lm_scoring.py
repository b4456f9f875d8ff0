"""Language-model scores from a log-frequency Bloom filter.

Training tokens give exact counts of words and of word pairs. The model stores a count c as its level
1 + floor(log2 c): the keys (n-gram, 1) to (n-gram, level) go into a Bloom filter, and a probe for
level 1, 2, ... until one fails gives the level back, so a false positive can only raise a level by
one, seldom. The pair model is smoothed by the word model (Dirichlet): with counts read from levels,
P(w | v) = (c(v, w) + mu P(w)) / (c(v) + mu), P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

Counts are read from levels as the middle of the counts that share one, and N is their sum, so P(w)
sums to one over the vocabulary and one unknown word but for false positives; P(w | v) sums to one up
to that quantisation. No probability exceeds one, whatever the filter answers.

Scale. Words are hashed to 64 bits in Arrow batches. N-grams are counted by slice, a range of the
hash; the number of slices follows the input, so a slice has the same size whatever the corpus, and
within it 32 bits of the hash tell pairs apart (some two in ten thousand share theirs, far fewer than
the filter's false positives). Each slice
builds its own part of the filter, sized by its keys: ``bits_per_key`` of them whatever the corpus. A
filter of ``max_filter_bytes`` at most goes to all tasks. A larger one stays in its slices: each piece
of texts sends its distinct words and pairs to their slices, probes them there, and gets levels and
exact counts back, so that scores are the same on either way. Hashes travel sorted, as gaps, and a
text's words as places by frequency, both byte by byte across values: about three bytes a pair.
Exact counts for the base score, beside a broadcast filter: words with at least 1 in ``heavy`` of all
training tokens, of which there can be ``heavy`` at most, are sent to all tasks; a text's other words
go to their slice, are looked up there, and come back summed by text. No hot word ever moves once per occurrence.

Defined results: a null text counts as empty; an empty text is one end token; without training
tokens every count is 0; repeated rows are scored one by one; a null id counts as not held out; texts
are counted and scored whole at any length, a piece of texts growing to hold a long one; there are no
ties, as each text's score is its own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hashing import joined, mixed, split_words, word_hashes

END = np.uint64(0x454E44)  # the end token's hash; also what stands before a text's first word
PROBES = 4
MAX_LEVEL = 48


@dataclass(frozen=True)
class Settings:
    max_filter_bytes: int = 8 << 20
    bits_per_key: int = 10
    heavy: int = 20_000
    mu: float = 40.0
    slice_bytes: int = 6 << 20


CODE_BYTES = 4


def slice_of(grams: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash; slices are ranges, so sorted hashes have sorted slices."""
    return ((grams >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def codes_of(grams: np.ndarray, slices: int) -> np.ndarray:
    """32 bits that tell a slice's hashes apart, in the order of the hashes."""
    first = ((slice_of(grams, slices) << np.uint64(32)) + np.uint64(slices - 1)) // np.uint64(slices) << np.uint64(32)
    return (grams - first) >> np.uint64(max(0, 66 - slices.bit_length() - 8 * CODE_BYTES))


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, the first byte of all before the second: what values share compresses."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def packed(values: np.ndarray) -> bytes:
    """Values in order, as their gaps in as few bytes as the largest needs."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + planes(gaps, width)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data[1:], data[0]), dtype=np.uint64)


@dataclass
class Filter:
    """Parts of a Bloom filter, one for each slice of hashes, laid end to end (32-bit cells)."""

    cells: np.ndarray
    start: np.ndarray  # first cell of each slice
    size: np.ndarray  # cells of each slice

    def levels(self, grams: np.ndarray) -> np.ndarray:
        part = slice_of(grams, len(self.size)).astype(np.int64)
        return self.levels_of(codes_of(grams, len(self.size)), part)

    def levels_of(self, codes: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The level of each code of a slice ``part``: how many probes, from level 1 up, succeed before one fails."""
        found = np.zeros(len(codes), dtype=np.int64)
        left = np.flatnonzero(self.size[part] > 0)
        for level in range(1, MAX_LEVEL):
            key, own = _key(codes[left], level), part[left]
            bits, out = self.size[own].astype(np.uint64) * np.uint64(32), np.ones(len(left), bool)
            for _ in range(PROBES):
                spot = (key >> np.uint64(32)) % bits
                cell = self.cells[self.start[own] + (spot >> np.uint64(5)).astype(np.int64)]
                out &= (cell >> (spot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
                key = mixed(key)
            left = left[out]
            if not len(left):
                break
            found[left] = level
        return found


def _key(codes: np.ndarray, level: int) -> np.ndarray:
    return mixed(codes ^ mixed(np.uint64(level) + np.zeros(1, np.uint64)))


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(count)).astype(np.int64)


#: What a level stands for: the middle of the counts that share it; level 0 stands for none.
MEANING = np.array([0.0] + [(2.0 ** (k - 1) + 2.0**k - 1) / 2 for k in range(1, MAX_LEVEL + 1)])


def filter_part(codes: np.ndarray, counts: np.ndarray, bits_per_key: int) -> np.ndarray:
    """The cells of one slice's filter."""
    if not len(codes):
        return np.zeros(0, np.uint32)
    levels = level_of(counts)
    bits = np.zeros(max(1, -(-int(levels.sum()) * bits_per_key // 32)) * 32, bool)
    for level in range(1, int(levels.max()) + 1):
        key = _key(codes[levels >= level], level)
        for _ in range(PROBES):
            bits[((key >> np.uint64(32)) % np.uint64(len(bits))).astype(np.int64)] = True
            key = mixed(key)
    return np.packbits(bits, bitorder="little").view("<u4")


def first_tokens(sizes: np.ndarray) -> np.ndarray:
    """Where each text begins among the tokens of all, the ends included."""
    return np.r_[0, np.cumsum(sizes + 1)[:-1]].astype(np.int64)


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of some texts, and the number of words of each."""
    found = [split_words(t) for t in texts]
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    return word_hashes([w for f in found for w in f]), sizes


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    return np.unique(keys, return_counts=True)


def _by_slice(keys: np.ndarray, slices: int) -> Iterator[tuple[int, slice]]:
    """Each slice of sorted hashes, and where it lies."""
    part = slice_of(keys, slices)
    ends = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else np.zeros(1, np.int64)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield int(part[a]), slice(a, b)


def _coded(keys: np.ndarray, kind: int, slices: int) -> bytes:
    """Sorted hashes of one slice: words whole, as their counts are exact, pairs by their code."""
    return packed(codes_of(keys, slices) if kind else keys)


PACKED = "slice int, kind int, keys binary, counts binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else ([], [], [], [])
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["slice", "kind", "keys", "counts"])


def _pieces(batch: pa.RecordBatch, text: int, rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many rows, and not many more bytes of its column ``text`` than ``size``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths):
        if i - start == rows or held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _grams(slices: int):
    """Counted words (kind 0) and pairs (kind 1) of the training texts, packed by slice."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, 0):
                words, sizes = _tokens(piece.column(0).to_pylist())
                after = np.insert(words, np.cumsum(sizes), END)
                pairs = joined(np.r_[END, after[:-1]], after)
                out = []
                for kind, grams in ((0, words), (1, pairs)):
                    keys, counts = _sums(grams)
                    for s, own in _by_slice(keys, slices):
                        out.append((s, kind, _coded(keys[own], kind, slices), planes(counts[own], 4)))
                yield _packed(out)

    return of


def _count(own: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([np.zeros(0, np.uint64), *[unpacked(x) for x in own["keys"]]])
    c = np.concatenate([np.zeros(0, np.int64), *[unplanes(x, 4).astype(np.int64) for x in own["counts"]]])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(k) else c)


BUILT = "slice int, words binary, counts binary, v long, n long, mass double, cells binary"


def _build(settings: Settings, slices: int):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        """One slice: exact word counts, and its part of the filter (words and pairs)."""
        (words, n), (pairs, more) = (_count(group[group["kind"] == kind], kind) for kind in (0, 1))
        cells = filter_part(np.r_[codes_of(words, slices), pairs], np.r_[n, more], settings.bits_per_key)
        mass = float(MEANING[level_of(n)].sum()) if len(n) else 0.0
        row = (int(group["slice"].iloc[0]), words.tobytes(), n.tobytes(), len(words), int(n.sum()), mass, cells.tobytes())
        return pd.DataFrame([row], columns=[c.split()[0] for c in BUILT.split(", ")])

    return of


@dataclass
class Model:
    filter: Filter | None  # none where it is larger than one broadcast may be and stays in its slices
    heavy: np.ndarray  # sorted hashes
    heavy_counts: np.ndarray
    tokens: int  # N, ends included
    types: int  # V, the end included
    ends: int
    mass: float  # the sum of what the levels of all words stand for, ends included
    mu: float
    slices: int

    @property
    def below(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def score(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text, all of whose words lie end to end in ``words``."""
        stops = np.cumsum(sizes)
        after = np.insert(words, stops, END)
        before = np.r_[END, after[:-1]]
        distinct, which = np.unique(after, return_inverse=True)
        pairs, where = np.unique(joined(before, after), return_inverse=True)
        return self.smoothed(sizes, distinct, which, self.filter.levels(distinct), where, self.filter.levels(pairs))

    def smoothed(self, sizes: np.ndarray, distinct: np.ndarray, which: np.ndarray, levels: np.ndarray, where: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
        """The same, with the levels of the distinct words and pairs, and each token's place among both."""
        count = MEANING[levels]
        count[distinct == END] = self.ends
        unigram = np.minimum((count + 0.5) / (self.mass + 0.5 * (self.types + 1)), 1.0)[which]
        context = np.r_[float(self.ends), count[which][:-1]]
        joint = np.minimum(MEANING[pair_levels][where], np.maximum(context, 0.0))
        chance = np.log10((joint + self.mu * unigram) / (context + self.mu))
        return np.add.reduceat(chance, first_tokens(sizes)) if len(sizes) else np.zeros(0)


def train(docs: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the exact word counts and the filter by slice (slice, words, counts, cells)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tally = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    ends, slices = int(tally["n"]), max(4, -(-int(tally["b"] or 0) // settings.slice_bytes))
    grams = texts.mapInArrow(_grams(slices), PACKED)
    built = cut(grams.groupBy("slice").applyInPandas(_build(settings, slices), BUILT))
    size, start = np.zeros(slices, dtype=np.int64), np.zeros(slices, dtype=np.int64)
    sums = built.agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.sum(F.octet_length("cells")).alias("b")).first()
    sent = int(sums["b"] or 0) <= settings.max_filter_bytes
    tokens, types = int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (ends > 0)
    cells, at = [], 0
    for row in built.select("slice", "cells").toLocalIterator() if sent else ():  # max_filter_bytes in all
        part = np.frombuffer(bytes(row["cells"]), dtype=np.uint32)
        start[row["slice"]], size[row["slice"]] = at, len(part)
        cells.append(part)
        at += len(part)
    least = max(1, math.ceil(tokens / settings.heavy))

    def heavy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for words, counts in zip(b["words"], b["counts"], strict=True):
                k, c = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.int64)
                yield pd.DataFrame({"word": k[c >= least].view(np.int64), "count": c[c >= least]})

    found = built.select("words", "counts").mapInPandas(heavy, "word long, count long").collect()  # at most settings.heavy rows
    words = np.array([r["word"] for r in found], dtype=np.int64).view(np.uint64)
    counts = np.array([r["count"] for r in found], dtype=np.int64)
    order = np.argsort(words)
    whole = np.concatenate(cells) if at else np.zeros(1, np.uint32)
    model = Model(Filter(whole, start, size) if sent else None, words[order], counts[order], tokens, types, ends, float(sums["mass"] or 0.0) + ends, settings.mu, slices)
    return model, built.select("slice", "words", "counts", "cells")


SCORED = "batch binary, nth int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, slice int, keys binary, texts binary, counts binary"


def _scores(held, columns: list[str]):
    """A row for each text (slice null), and packed rows of the words to look up in their slice."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        model = held.value
        for batch in batches:
            for piece in _pieces(batch, 2):
                ids, held_out = piece.column(0), piece.column(1)
                name = uuid.uuid4().bytes
                words, sizes = _tokens(piece.column(2).to_pylist())
                k = len(sizes)
                owner = np.repeat(np.arange(k), sizes)
                score = model.score(words, sizes)
                base = np.full(k, np.log10(model.ends + 0.5))
                known = np.full(k, int(model.ends > 0))
                spot = np.minimum(np.searchsorted(model.heavy, words), max(len(model.heavy) - 1, 0))
                is_heavy = model.heavy[spot] == words if len(model.heavy) else np.zeros(len(words), bool)
                logs = np.log10(model.heavy_counts + 0.5)
                base += np.bincount(owner[is_heavy], logs[spot[is_heavy]] if len(logs) else None, minlength=k)
                known += np.bincount(owner[is_heavy], minlength=k)
                base -= (sizes + 1) * np.log10(model.below)
                rest, of_text = words[~is_heavy], owner[~is_heavy]
                order = np.lexsort((of_text, rest))
                rest, of_text = rest[order], of_text[order]
                first = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (of_text[1:] != of_text[:-1])]) if len(rest) else np.zeros(0, np.int64)
                times = np.diff(np.r_[first, len(rest)])
                rest, of_text = rest[first], of_text[first]
                packs = [(s, rest[own].tobytes(), of_text[own].astype(np.uint16).tobytes(), times[own].astype(np.uint32).tobytes()) for s, own in _by_slice(rest, model.slices)]
                p = len(packs)
                none = lambda t, n: pa.nulls(n, t)
                cols = list(zip(*packs, strict=True)) if packs else ([], [], [], [])
                full = lambda a, t: pa.concat_arrays([a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t), none(t, p)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (k + p), pa.binary()), full(np.arange(k), pa.int32()),
                        full(ids, pa.int64()), full(held_out, pa.bool_()), full(sizes + 1, pa.int64()), full(known, pa.int64()),
                        full(base, pa.float64()), full(score, pa.float64()),
                        pa.concat_arrays([none(pa.int32(), k), pa.array(cols[0], pa.int32())]),
                        *[pa.concat_arrays([none(pa.binary(), k), pa.array(c, pa.binary())]) for c in cols[1:]],
                    ],
                    names=columns,
                )

    return of


def _look_up(group: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """For the words of one slice, sums of log10(c + 0.5) and of known words by text, packed by batch."""
    words = np.frombuffer(counts["words"].iloc[0], np.uint64) if len(counts) else np.zeros(0, np.uint64)
    found = np.frombuffer(counts["counts"].iloc[0], np.int64) if len(counts) else np.zeros(0, np.int64)
    out = []
    for batch, keys, texts, times in zip(group["batch"], group["keys"], group["texts"], group["counts"], strict=True):
        keys, texts, times = np.frombuffer(keys, np.uint64), np.frombuffer(texts, np.uint16), np.frombuffer(times, np.uint32).astype(np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
            c = np.where(words[at] == keys, found[at], 0)
        else:
            c = np.zeros(len(keys), np.int64)
        own, which = np.unique(texts, return_inverse=True)
        sums, hits = np.bincount(which, times * np.log10(c + 0.5)), np.bincount(which, times * (c > 0)).astype(np.int64)
        out.append((batch, own.tobytes(), sums.tobytes(), hits.tobytes()))
    return pd.DataFrame(out, columns=["batch", "texts", "sums", "hits"])


def _total(texts: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    """The texts of one batch, with what their words brought from the slices."""
    texts = texts.sort_values("nth")
    base, known = texts["base"].to_numpy(np.float64).copy(), texts["n_known"].to_numpy(np.int64).copy()
    # Slices add up in one order, so that reruns agree to the last bit.
    for own, sums, hits in sorted(zip(more["texts"], more["sums"], more["hits"], strict=True)):
        at = np.frombuffer(own, np.uint16)
        base[at] += np.frombuffer(sums, np.float64)
        known[at] += np.frombuffer(hits, np.int64)
    return texts[["doc_id", "held_out", "n_tokens", "score"]].assign(n_known=known, base_score=base)


HELD = "batch binary, ids array<long>, held array<boolean>, sizes binary, words binary, times binary, places binary"
ASKED = "batch binary, slice int, kind int, keys binary"
ANSWERS = "batch binary, slice int, kind int, levels binary, counts binary"
TOTALS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _held_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of texts: its ids, its distinct words and how often each comes, and its tokens as places
    among them, the most frequent first, so that most places are small."""
    import uuid

    for batch in batches:
        for piece in _pieces(batch, 2):
            words, sizes = _tokens(piece.column(2).to_pylist())
            distinct, which, times = np.unique(np.insert(words, np.cumsum(sizes), END), return_inverse=True, return_counts=True)
            place = np.empty(len(distinct), np.int64)
            place[np.argsort(-times, kind="stable")] = np.arange(len(distinct))
            spans = pa.array([0, piece.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(spans, piece.column(i).cast(t)) for i, t in ((0, pa.int64()), (1, pa.bool_()))]
            packs = [sizes.tobytes(), packed(distinct), planes(times, 4), planes(place[which], 4)]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes], pa.binary()), *lists, *[pa.array([x], pa.binary()) for x in packs]], names=[c.split()[0] for c in HELD.split(", ")])


def _opened(words: bytes, times: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each token's place among them, and each token's pair with the one before."""
    distinct = unpacked(words)
    which = np.argsort(-unplanes(times, 4).astype(np.int64), kind="stable")[unplanes(places, 4).astype(np.int64)]
    after = distinct[which]
    return distinct, which, joined(np.r_[END, after[:-1]], after)


def _asks(slices: int):
    """The distinct words (kind 0) and pairs (kind 1) of each piece, for their slice."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *packs in zip(*batch.columns, strict=True):
                distinct, _, pairs = _opened(*[x.as_py() for x in packs])
                asked = [(name.as_py(), s, kind, _coded(keys[own], kind, slices)) for kind, keys in ((0, distinct), (1, np.unique(pairs))) for s, own in _by_slice(keys, slices)]
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*asked, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ASKED.split(", ")])

    return of


def _answer(slices: int):
    def of(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """Levels of what was asked of one slice, by its part of the filter, and the words' exact counts."""
        if not len(asked):
            return pd.DataFrame([], columns=[c.split()[0] for c in ANSWERS.split(", ")])
        cells = np.frombuffer(held["cells"].iloc[0], np.uint32) if len(held) else np.zeros(0, np.uint32)
        words, found = (np.frombuffer(held[c].iloc[0], t) if len(held) else np.zeros(0, t) for c, t in (("words", np.uint64), ("counts", np.int64)))
        part = Filter(cells, np.zeros(1, np.int64), np.array([len(cells)]))
        levels, counts = [], []
        for keys, kind in zip(asked["keys"], asked["kind"], strict=True):
            keys = unpacked(keys)
            codes = keys if kind else codes_of(keys, slices)
            levels.append(part.levels_of(codes, np.zeros(len(codes), np.int64)).astype(np.uint8).tobytes())
            exact = None
            if not kind:
                at = np.minimum(np.searchsorted(words, keys), max(len(words) - 1, 0))
                exact = planes(np.where(words[at] == keys, found[at], 0) if len(words) else np.zeros(len(keys), np.int64), 8)
            counts.append(exact)
        return asked[["batch", "slice", "kind"]].assign(levels=levels, counts=counts)

    return of


def _scored(held):
    """The texts of one piece, with what its words and pairs brought from the slices."""

    def of(piece: pa.Table, answers: pa.Table) -> pa.Table:
        model = held.value
        ids, held_out = (piece.column(c).combine_chunks().flatten() for c in ("ids", "held"))
        sizes = np.frombuffer(piece["sizes"][0].as_py(), np.int64)
        distinct, which, pairs = _opened(*[piece[c][0].as_py() for c in ("words", "times", "places")])
        pairs, where = np.unique(pairs, return_inverse=True)
        # Slices are ranges of the sorted hashes, so answers in the order of slices are in the order of what was asked.
        got = answers.select(["kind", "slice", "levels", "counts"]).sort_by([("kind", "ascending"), ("slice", "ascending")]).to_pylist()
        levels = [np.frombuffer(b"".join(r["levels"] for r in got if r["kind"] == kind), np.uint8) for kind in (0, 1)]
        exact = np.concatenate([unplanes(r["counts"], 8).astype(np.int64) for r in got if r["kind"] == 0])
        exact[distinct == END] = model.ends
        first = first_tokens(sizes)
        base = np.add.reduceat(np.log10(exact + 0.5)[which], first) - (sizes + 1) * np.log10(model.below)
        known = np.add.reduceat((exact > 0).astype(np.int64)[which], first)
        score = model.smoothed(sizes, distinct, which, levels[0], where, levels[1])
        return pa.table([ids, held_out, pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(score)], names=[c.split()[0] for c in TOTALS.split(", ")])

    return of


def _score_by_slice(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Scores with a filter that no broadcast holds."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    # Written once: the names that tie a piece to what it asks are drawn in this pass.
    pieces = cut(rows.mapInArrow(_held_pieces, HELD))
    asked = pieces.select("batch", "words", "times", "places").mapInArrow(_asks(model.slices), ASKED)
    answers = asked.groupBy("slice").cogroup(counts.groupBy("slice")).applyInPandas(_answer(model.slices), ANSWERS)
    return pieces.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scored(held), TOTALS)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, held_out, text)."""
    columns = [c.split()[0] for c in SCORED.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long"), "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")))
    if model.filter is None:
        return _score_by_slice(rows, model, counts).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_filter_bytes and heavy
    # Written once: the names that tie a text to its packed words are drawn in this pass.
    rows = cut(rows.mapInArrow(_scores(held, columns), SCORED))
    packed = rows.where(F.col("slice").isNotNull()).select("slice", "batch", "keys", "texts", "counts")
    more = packed.groupBy("slice").cogroup(counts.select("slice", "words", "counts").groupBy("slice")).applyInPandas(_look_up, "batch binary, texts binary, sums binary, hits binary")
    own = rows.where(F.col("slice").isNull()).select("batch", "nth", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    summed = own.groupBy("batch").cogroup(more.groupBy("batch")).applyInPandas(
        _total, "doc_id long, held_out boolean, n_tokens long, score double, n_known long, base_score double"
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
