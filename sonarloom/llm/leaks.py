"""Held-out passages in a corpus, found by latent semantic retrieval.

1. Every text part becomes a sequence of word numbers, written once; later passes read only that.
   Words of the passages have numbers of their own, all others share OTHERS buckets of a hash.
2. TF-IDF of passages of text, SPAN words each: those of all the corpus' parts and those of the searched
   passages, each half with the same weight. Document frequencies, too, are counted over all
   parts. The leading right singular vectors come from a distributed randomised SVD: each pass
   sums, per partition, A'(A G) for a thin matrix G; what moves is columns x rank, never the matrix.
3. Candidates are chosen by cosine in that space, over every part, at two scales. Windows of WINDOW words,
   side by side: a run of 2*WINDOW-1 equal words covers one whole, whose cosine with the passage's
   is 1, so no such run can be missed. Windows of SPAN words, a quarter apart: those that come within
   min_cosine of a passage may reword it.
4. What the cosines propose is verified on the words: the longest common run; for reworded passages
   the longest common subsequence within the candidate's surroundings, and how many of the passage's numbers
   (its checkable answers) the part gives.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarloom.llm.mail import text_parts, words
from sonarloom.session import cut

#: Words of a window at either scale, and of the blocks that long windows are made of.
WINDOW, SPAN, BLOCK = 7, 64, 16
#: Columns of the latent space: words of the passages, and buckets of all other words.
OWN, OTHERS = 2048, 2048
#: Words of the passages that fit a broadcast; more is an error, as the query set is a stated one: give it in several calls.
MAX_VOCABULARY = 2_000_000
_CHUNK = 1 << 15


def item_words(items: DataFrame) -> dict[int, list[str]]:
    """item_id -> words, of the stated query set. Null or empty passages have none and leak nowhere."""
    return {r["item_id"]: words(r["passage"]) for r in items.filter("item_id is not null and passage is not null").select("item_id", "passage").toLocalIterator()}


class _Numbers(dict):
    """Word -> number: 0 and up for the passages' words, below 0 for the buckets of all others."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__(vocabulary)
        self.own = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.own) + 500_000:  # bounded: seen words are forgotten
            self.clear()
            self.update(self.own)
        self[word] = number = -1 - zlib.crc32(word.encode("utf-8", "surrogatepass")) % OTHERS
        return number


def word_numbers(docs: DataFrame, vocabulary: dict[str, int], text_column: str = "text") -> DataFrame:
    """One row per text part: doc_id, part, ids. Null texts have no part, and documents without id are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers(shared.value).__getitem__
        for batch in batches:
            docs, parts, ids = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, part in enumerate(text_parts(text)):
                    docs.append(doc)
                    parts.append(k)
                    ids.append(np.fromiter(map(number, words(part)), np.int32))
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names=["doc_id", "part", "ids"])

    chosen = docs.filter(F.col(text_column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, part int, ids array<int>")


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same parts in batches of a bounded number of words, one part at least, however long parts are."""
    for batch in batches:
        offsets = batch.column(batch.schema.get_field_index("ids")).offsets.to_numpy()
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all parts one after another, offsets of the parts)."""
    ids = batch.column(batch.schema.get_field_index("ids"))
    offsets = ids.offsets.to_numpy()
    return ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _columns(ids: np.ndarray) -> np.ndarray:
    """The column of each word number."""
    return np.where(ids >= 0, ids % OWN, OWN - 1 - ids).astype(np.int16)


def _blocks(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, part) of each stretch of `size` words of every part; the last of a part may be shorter."""
    count = -(-np.diff(offsets) // size)
    part = np.repeat(np.arange(len(count)), count)
    return offsets[:-1][part] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * size, part


def _sums(space: np.ndarray, columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the words' rows over each stretch from one start to the next, a bounded number of words at a time."""
    out, ends, i = np.zeros((len(starts), space.shape[1]), np.float32), np.append(starts[1:], len(columns)), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        out[i:j] = np.add.reduceat(space[columns[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0)
        i = j
    return out


def _product(columns: np.ndarray, starts: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A'(A right), A's rows being the stretches' word counts times weight."""
    total, ends, i = np.zeros(right.shape), np.append(starts[1:], len(columns)), 0
    scaled = (right * weight[:, None]).astype(np.float32)
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        some = columns[starts[i] : ends[j - 1]]
        rows = np.add.reduceat(scaled[some], starts[i:j] - starts[i], axis=0)
        which = np.repeat(np.arange(j - i), ends[i:j] - starts[i:j])
        order = np.argsort(some, kind="stable")
        first = np.flatnonzero(np.diff(some[order], prepend=-1))
        total[some[order][first]] += np.add.reduceat(rows[which[order]], first, axis=0)
        i = j
    return weight[:, None] * total


def _summed(parts: DataFrame, per_task, columns: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Arrays that per_task (batches -> name -> array) gives for each task, added up in a tree: 4 sums at most reach the driver."""
    names = list(columns)
    kinds = {n: np.float32 if len(shape) > 1 else np.float64 for n, shape in columns.items()}  # matrices travel short, counts exact
    schema = "slot int, " + ", ".join(f"{n} binary" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = per_task(batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 1024], pa.int32()), *[pa.array([found[n].astype(kinds[n]).tobytes()]) for n in names]], names=["slot", *names])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": [int(group["slot"].iloc[0])]} | {n: [np.sum([np.frombuffer(x, kinds[n]) for x in group[n]], axis=0).tobytes()] for n in names})

    sums = parts.mapInArrow(run, schema).groupBy("slot").applyInPandas(add, schema)
    rows = sums.withColumn("slot", F.col("slot") % 4).groupBy("slot").applyInPandas(add, schema).collect()
    return {n: sum((np.frombuffer(r[n], kinds[n]).reshape(shape) for r in rows), np.zeros(shape)) for n, shape in columns.items()}


def document_frequency(numbers: DataFrame) -> tuple[np.ndarray, int]:
    """(parts that hold each column, parts), over the whole corpus."""
    width = OWN + OTHERS

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        frequency, parts = np.zeros(width), 0
        for batch in _pieces(batches):
            flat, offsets = _flat(batch)
            parts += len(offsets) - 1
            columns = _columns(flat)
            for i in range(0, len(offsets) - 1, 1024):
                own = offsets[i : i + 1025]
                owner = np.repeat(np.arange(len(own) - 1, dtype=np.int32), np.diff(own))
                frequency += np.bincount(np.unique(owner * np.int32(width) + columns[own[0] : own[-1]]) % width, minlength=width)
        return {"frequency": frequency, "parts": np.array([parts])}

    found = _summed(numbers.select("ids"), count, {"frequency": (width,), "parts": (1,)})
    return found["frequency"], int(found["parts"][0])


def latent_space(numbers: DataFrame, passages: list[np.ndarray], rank: int = 96, oversample: int = 8, seed: int = 7) -> np.ndarray:
    """(columns, rank): inverse document frequency times the leading right singular vectors of the TF-IDF of
    corpus and passages, by randomised subspace iteration in two passes over all parts."""
    frequency, parts = document_frequency(numbers)
    idf = np.log((1 + parts) / (1 + frequency)) + 1
    own = _columns(np.concatenate(passages))
    starts, _ = _blocks(np.cumsum([0, *[len(p) for p in passages]]), SPAN)
    norm = {}

    def product(right: np.ndarray) -> np.ndarray:
        def per_task(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
            total = np.zeros(right.shape)
            for batch in _pieces(batches):
                flat, offsets = _flat(batch)
                if len(flat):
                    total += _product(_columns(flat), _blocks(offsets, SPAN)[0], right, idf)
            return {"total": total}

        corpus, asked = _summed(numbers.select("ids"), per_task, {"total": right.shape})["total"], _product(own, starts, right, idf)
        norm.setdefault("asked", np.linalg.norm(corpus) / max(np.linalg.norm(asked), 1e-12))
        return corpus + norm["asked"] * asked if np.any(corpus) else asked

    basis, _ = np.linalg.qr(product(np.random.default_rng(seed).standard_normal((len(idf), rank + oversample))))
    image = product(basis)
    values, vectors = np.linalg.eigh((lambda c: (c + c.T) / 2)(basis.T @ image))
    return (idf[:, None] * (basis @ vectors[:, ::-1][:, :rank])).astype(np.float32)


def _unit(z: np.ndarray) -> np.ndarray:
    return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _places(sequence: list[int]) -> dict[int, int]:
    """Each word's places in the sequence, one bit each."""
    places: dict[int, int] = {}
    for k, w in enumerate(sequence):
        places[w] = places.get(w, 0) | 1 << k
    return places


def _subsequence(places: dict[int, int], n: int, other: list[int]) -> int:
    """Longest common subsequence of a sequence of n words, given by its places, and another. Bit-parallel: an integer holds one bit for each word."""
    full = (1 << n) - 1
    rest = full
    for w in other:
        if used := rest & places.get(w, 0):
            rest = ((rest + used) | (rest - used)) & full
    return n - rest.bit_count()


def _common(part: list[int], passage: list[int]) -> tuple[int, int]:
    """(longest common run, longest common subsequence) of a part and a passage."""
    places = _places(passage)
    run, ends = 0, [places.get(w, 0) for w in part]
    same = ends
    while any(ends):
        run += 1
        ends = [0] + [(before << 1) & m for before, m in zip(ends, same[1:])]
    return run, _subsequence(places, len(passage), part)


def _reworded(text: list[int], passage: list[int], places: dict[int, int], firsts: list[int], least: float) -> tuple[int, int]:
    """(longest run, longest common subsequence) of the passage within the best surroundings of the windows that start there; (0, 0) if all are under least."""
    n, best = len(passage), (0, 0)
    at = [k for k, w in enumerate(text) if w in places]
    known = [text[k] for k in at]
    # No surroundings hold more in order than the whole.
    if len(known) < least or _subsequence(places, n, known) < least:
        return best
    for a, b in sorted({(max(0, f - n), min(len(text), f + SPAN + n)) for f in firsts}):
        i, j = bisect_left(at, a), bisect_left(at, b)
        if j - i < max(least, best[1] + 1):
            continue
        subsequence = _subsequence(places, n, known[i:j])
        if subsequence >= least and subsequence > best[1]:
            best = (_common(text[a:b], passage)[0], subsequence)
    return best


class _Postings:
    """For each word the passages that hold it, and how often, all in flat arrays."""

    def __init__(self, held: list[np.ndarray]):
        counts = [np.unique(p, return_counts=True) for p in held]
        words_, owner = np.concatenate([w for w, _ in counts]), np.repeat(np.arange(len(held)), [len(w) for w, _ in counts])
        order = np.argsort(words_, kind="stable")
        self.words, self.first, self.count = np.unique(words_[order], return_index=True, return_counts=True)
        self.owner, self.times = owner[order], np.concatenate([n for _, n in counts])[order]

    def shared(self, part: np.ndarray, word: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(part * n + passage, words in common counted as often as both hold them), from the distinct words of parts."""
        if not len(self.words) or not len(word):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        some = np.flatnonzero(self.words[at] == word)
        count = self.count[at[some]]
        flat = np.repeat(self.first[at[some]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        which = np.repeat(some, count)
        keys, inverse = np.unique(part[which] * n + self.owner[flat], return_inverse=True)
        return keys, np.bincount(inverse, np.minimum(self.times[flat], times[which]))


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


class _Asked:
    """The passages, as every task searches them."""

    def __init__(self, space: np.ndarray, passages: dict[int, np.ndarray]):
        self.space, self.items, self.words = space, list(passages), list(passages.values())
        # Pieces of SPAN words, half a piece apart: a passage is proposed by any of its pieces.
        starts = [(j, k) for j, p in enumerate(self.words) for k in range(0, max(1, len(p) - SPAN // 2), SPAN // 2)]
        self.piece_of = np.array([j for j, _ in starts])
        self.pieces = _unit(np.stack([space[_columns(self.words[j][k : k + SPAN])].sum(0) for j, k in starts]))
        # Windows of WINDOW words, in order of the coordinate that tells them best apart.
        of = [np.lib.stride_tricks.sliding_window_view(p, WINDOW) for p in self.words if len(p) >= WINDOW]
        owner = np.repeat([j for j, p in enumerate(self.words) if len(p) >= WINDOW], [len(w) for w in of]) if of else np.zeros(0, int)
        short = _unit(space[_columns(np.concatenate(of))].sum(1)) if of else np.zeros((0, space.shape[1]), np.float32)
        # Coordinates by how well they tell windows apart: the first is searched, the next ones sift.
        self.axes = np.argsort(-short.var(0))[:6] if len(short) else np.arange(1)
        order = np.argsort(short[:, self.axes[0]], kind="stable")
        self.short, self.short_of = short[order], owner[order]

    def equal_windows(self, flat: np.ndarray, offsets: np.ndarray, least: float = 1 - 1e-6) -> set[tuple[int, int]]:
        """(part, passage) that share a window of cosine 1, but for rounding. Windows lie side by side."""
        count = np.diff(offsets) // WINDOW
        part = np.repeat(np.arange(len(count)), count)
        first = offsets[:-1][part] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        # A window with a word that no passage has equals none.
        other = np.concatenate([[0], np.cumsum(flat < 0)])
        possible = other[first + WINDOW] == other[first]
        first, part = first[possible], part[possible]
        found: set[tuple[int, int]] = set()
        reach = float(np.sqrt(2 - 2 * least)) + 1e-5
        for i in range(0, len(first), 4096):
            windows = _unit(self.space[_columns(flat[first[i : i + 4096, None] + np.arange(WINDOW)])].sum(1))
            along, line = windows[:, self.axes[0]], self.short[:, self.axes[0]]
            low, high = np.searchsorted(line, along - reach), np.searchsorted(line, along + reach, side="right")
            n = high - low
            ends = np.cumsum(n)
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 17), side="right")))
                w, t = np.repeat(np.arange(a, b), n[a:b]), np.arange(n[a:b].sum()) - np.repeat(ends[a:b] - ends[a] + n[a] - n[a:b], n[a:b]) + np.repeat(low[a:b], n[a:b])
                for axis in self.axes[1:]:
                    close = np.flatnonzero(np.abs(windows[w, axis] - self.short[t, axis]) <= reach)
                    w, t = w[close], t[close]
                near = (windows[w].astype(np.float64) * self.short[t]).sum(1) >= least
                found.update(zip(part[i + w[near]].tolist(), self.short_of[t[near]].tolist()))
                a = b
        return found

    def long_windows(self, flat: np.ndarray, offsets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, passage, first word, cosine) of the windows of SPAN words that lie within `least` of a passage's piece."""
        starts, part = _blocks(offsets, BLOCK)
        upto = np.vstack([np.zeros((1, self.space.shape[1])), np.cumsum(_sums(self.space, _columns(flat), starts), axis=0, dtype=np.float64)])
        at = np.arange(len(starts))
        last = np.searchsorted(part, np.arange(len(offsets) - 1), side="right")[part]
        whole = np.flatnonzero((at + SPAN // BLOCK <= last) | (np.diff(part, prepend=-1) > 0))
        out: list[tuple] = []
        for i in range(0, len(whole), 4096):
            some = whole[i : i + 4096]
            windows = _unit(upto[np.minimum(some + SPAN // BLOCK, last[some])] - upto[some])
            for j in range(0, len(self.pieces), 4096):
                cosine = windows @ self.pieces[j : j + 4096].T
                w, k = np.nonzero(cosine >= least)
                out.append((part[some[w]], self.piece_of[j + k], starts[some[w]], cosine[w, k]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3 + (np.zeros(0),)


def leaks(docs: DataFrame, items: DataFrame, min_cosine: float = 0.3, min_run: int = 13, min_subsequence: float = 0.5, rank: int = 96) -> DataFrame:
    """Every document with every passage it holds: doc_id, item_id, cosine, run, subsequence, answers, kind.

    kind is verbatim where at least min_run consecutive words are equal (min_run is at least
    2*WINDOW-1, or runs could be missed): no such pair is lost. It is paraphrase where a candidate window and its
    surroundings, as far as the passage is long, hold a share of at least min_subsequence of the passage's
    words in order, and the part at least half of its numbers. Paraphrases further than min_cosine from every
    window are not looked at; the README has the recall. The best part of a document counts. subsequence is that of the
    part for verbatim, of the window for paraphrase; cosine is the best of a window of SPAN words, and 1 for verbatim, by a window of WINDOW words. Null and
    empty texts and passages give no rows; passages of under min_run words can be paraphrased only. Extra columns are ignored.
    """
    if min_run < 2 * WINDOW - 1:
        raise ValueError(f"min_run must be at least {2 * WINDOW - 1}")
    spark = docs.sparkSession
    by_item = {i: w for i, w in item_words(items).items() if w}
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws in by_item.values() for w in ws}))}
    schema = "doc_id long, item_id long, cosine double, run int, subsequence int, answers double, kind string"
    if not vocabulary:
        return spark.createDataFrame([], schema)
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError("the passages' vocabulary is too large to broadcast; give them in several calls")
    numbers = cut(word_numbers(docs, vocabulary), "word-numbers")
    passages = {i: np.array([vocabulary[w] for w in ws], np.int32) for i, ws in by_item.items()}
    facts = [np.array([vocabulary[w] for w in dict.fromkeys(ws) if w.isdigit()], np.int32) for ws in by_item.values()]
    shared = spark.sparkContext.broadcast((latent_space(numbers, list(passages.values()), rank), passages, facts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, passages, facts = shared.value
        asked, n_items, n_words = _Asked(space, passages), len(passages), len(vocabulary)
        by_word, by_fact = _Postings(asked.words), _Postings(facts)
        lists = [p.tolist() for p in asked.words]
        places = [_places(p) for p in lists]
        n_facts, least = np.array([len(f) for f in facts]), min_subsequence * np.array([len(p) for p in asked.words])
        for batch in _pieces(batches):
            names = batch.column(0).to_numpy()
            flat, offsets = _flat(batch)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            distinct, times = np.unique((owner * n_words + flat)[flat >= 0], return_counts=True)
            part, word = distinct // n_words, distinct % n_words
            facts_given = by_fact.shared(part, word, np.ones_like(times), n_items)
            windows: dict[tuple[int, int], list[tuple[int, float]]] = {}
            p_, j_, first, cosine = asked.long_windows(flat, offsets, min_cosine)
            # What the cosines propose is verified, the cheapest test first: numbers, words in common, then their order.
            key = p_ * n_items + j_
            good = np.flatnonzero((2 * _looked_up(*facts_given, key) >= n_facts[j_]) & (_looked_up(*by_word.shared(part, word, times, n_items), key) >= least[j_]))
            for p, j, f, c in zip(*(x[good].tolist() for x in (p_, j_, first, cosine))):
                windows.setdefault((p, j), []).append((f, c))
            equal = asked.equal_windows(flat, offsets)
            rows = []
            for p, j in sorted(windows.keys() | equal):
                text = flat[offsets[p] : offsets[p + 1]].tolist()
                given = float(_looked_up(*facts_given, np.array([p * n_items + j]))[0])
                longest, subsequence = _common(text, lists[j]) if (p, j) in equal else (0, 0)
                if longest >= min_run:
                    kind, cosine_ = "verbatim", 1.0
                else:
                    own = windows.get((p, j), [])
                    longest, subsequence = _reworded(text, lists[j], places[j], [f - offsets[p] for f, _ in own], least[j])
                    if not subsequence:
                        continue
                    kind, cosine_ = "paraphrase", min(1.0, max(c for _, c in own))
                rows.append((int(names[p]), asked.items[j], cosine_, longest, subsequence, given / n_facts[j] if n_facts[j] else None, kind))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "cosine", "run", "subsequence", "answers", "kind"])

    parts = numbers.select("doc_id", "ids").mapInArrow(run, schema)
    return parts.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("run").alias("run"), F.max("subsequence").alias("subsequence"), F.max("answers").alias("answers"), F.max("kind").alias("kind"))
