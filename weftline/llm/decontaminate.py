"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts and items become sequences of word hashes (lower-cased, cut at every ASCII character but
letters and digits). The CGK embedding of a window walks along it: each step writes the
word under the pointer, then moves on or not, as that word's random bit of the step says. Two
sequences with a small edit distance fall into step soon after an edit, so their embeddings
have a small Hamming distance. Each repetition draws its own walk and samples ``sampled`` steps;
windows that agree on all of them become candidates. Repetitions find most edited copies.

The rest is found by pieces: an item of n words with at most k = ``max_edits`` * n edits, cut into
k + 1 pieces, has a piece without an edit, so the pieces are looked up at every word of the
texts, too. With them every copy within ``max_edits`` is a candidate, of any length and anywhere.

Windows come in sizes of powers of two. An item uses the largest size w with w + stride - 1
words in it at most, and its windows at every place are indexed; a text's windows start at
every ``stride``-th word. So each full copy of an item, wherever it lies, contains at least one
window that is indexed. Items too short for that use windows of their own length at every word.

Candidates are verified: the item's edit distance, in words, to the best matching part of the
text near the window must not exceed ``max_edits`` of the item's length.

Items are the queries: they are shipped in blocks of at most ``block_words`` words, and each
block scans all texts. Defined cases: null or wordless texts and items match nothing; repeated
rows give repeated matches; a null id stays null; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import arrow_map, slices
from weftline.llm.words import NOT_ALNUM, mix, utf8, word_hashes

_U = np.uint64
_FILTER_BITS = 20


def _rounds(size: int) -> int:
    """Steps of the walk over a window: it moves on at every second step, so it seldom gets to the end."""
    return size + size // 2


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(distance, end): the smallest edit distance of ``item`` to any part of ``text``, and where the first such part ends."""
    n = len(item)
    column = np.arange(n + 1)
    ramp = np.arange(n + 1)
    best, end = n, 0
    for j, symbol in enumerate(text):
        step = np.empty(n + 1, np.int64)
        step[0] = 0
        step[1:] = np.minimum(column[:-1] + (item != symbol), column[1:] + 1)
        column = np.minimum.accumulate(step - ramp) + ramp
        if column[n] < best:
            best, end = int(column[n]), j + 1
    return best, end


class ItemIndex:
    """The windows of a block of items, by repetition and size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], *, stride: int = 8, repetitions: int = 8, sampled: int = 6, max_edits: float = 0.2, seed: int = 1):
        self.items = [(i, w) for i, w in items if len(w)]
        self.stride, self.repetitions, self.sampled, self.max_edits, self.seed = stride, repetitions, sampled, max_edits, seed
        self.plans: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (stride, size): (item, place)
        for k, (_, words) in enumerate(self.items):
            n = len(words)
            size = 1 << max(n - stride + 1, 0).bit_length() >> 1
            plan = (stride, size) if size >= stride else (1, n)
            self.plans.setdefault(plan, []).extend((k, p) for p in range(n - plan[1] + 1))
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        words = np.concatenate([w for _, w in self.items]) if self.items else np.empty(0, _U)
        starts = np.concatenate(([0], np.cumsum([len(w) for _, w in self.items]))).astype(np.int64)
        for (step, size), windows in self.plans.items():
            at = np.array([starts[k] + p for k, p in windows])
            for rep in range(repetitions):
                keys = self._keys(words, at, rep, [size])[size]
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << _FILTER_BITS, bool)
                seen[keys & _U((1 << _FILTER_BITS) - 1)] = True
                self.tables[step, size, rep] = keys[order], order, seen
        cut: dict[int, list[tuple[int, int]]] = {}  # size: (item, place)
        for k, (_, own) in enumerate(self.items):
            parts = min(int(max_edits * len(own)) + 1, len(own))
            bounds = [p * len(own) // parts for p in range(parts + 1)]
            for a, b in zip(bounds, bounds[1:]):
                cut.setdefault(b - a, []).append((k, a))
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # size: (keys, (item, place), filter)
        for size, keys in self._runs(words, set(cut)):
            keys = keys[[starts[k] + p for k, p in cut[size]]]
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[keys & _U((1 << _FILTER_BITS) - 1)] = True
            self.pieces[size] = keys[order], np.array(cut[size])[order], seen

    @staticmethod
    def _runs(words: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(size, hashes of the runs of so many words from each place) for each size that fits."""
        keys = np.zeros(len(words), _U)
        for size in range(1, min(max(sizes, default=0), len(words)) + 1):
            keys = mix(keys[: len(words) - size + 1] * _U(0xD6E8FEB86659FD93) + words[size - 1 :] + _U(size))
            if size in sizes:
                yield size, keys

    def _bits(self, words: np.ndarray, rep: int, steps: int) -> list[np.ndarray]:
        """64 steps' bits for each word at a time."""
        with np.errstate(over="ignore"):
            return [mix(words ^ _U((self.seed * 1_000_003 + rep * 8191 + 64 * k + 17) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(-(-steps // 64))]

    def _keys(self, words: np.ndarray, at: np.ndarray, rep: int, sizes: list[int]) -> dict[int, np.ndarray]:
        """The sampled steps of one walk from each place, hashed, for each window size.

        A smaller window's embedding begins like a larger one's, so one walk serves all sizes.
        """
        rng = np.random.default_rng([self.seed, rep])
        samples = {s: set(np.sort(rng.choice(_rounds(s), min(self.sampled, _rounds(s)), replace=False)).tolist()) for s in sorted(self.all_sizes(), reverse=True)}
        steps = max(max(samples[s]) for s in sizes) + 1
        bits = self._bits(words, rep, steps)
        # a walk passes the last word by no more than its steps
        words, bits = np.append(words, np.zeros(steps, _U)), [np.append(b, np.zeros(steps, _U)) for b in bits]
        place = at.copy()
        keys = {s: np.zeros(len(at), _U) for s in sizes}
        for step in range(steps):
            for s in sizes:
                if step in samples[s]:
                    keys[s] = mix(keys[s] * _U(0xD6E8FEB86659FD93) + words[place] + _U(step + 1))
            if step + 1 < steps:
                if step % 8 == 0:  # the bits of eight steps in a byte
                    octet = (bits[step >> 6] >> _U(step & 56)).astype(np.uint8)
                move = octet[place]
                move >>= np.uint8(step & 7)
                move &= np.uint8(1)
                place += move
        return keys

    def all_sizes(self) -> list[int]:
        return sorted({size for _, size in self.plans})

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, place of the item's first word in ``words``) for windows that collide and pieces that occur."""
        n = np.diff(ends)
        by_step: dict[int, list[int]] = {}
        for step, size in self.plans:
            by_step.setdefault(step, []).append(size)
        found = set()
        for step, sizes in by_step.items():
            least = min(sizes)
            count = np.where(n >= least, (n - least) // step + 1, 0)
            to = np.concatenate(([0], np.cumsum(count)))
            if not to[-1]:
                continue
            text = np.repeat(np.arange(len(n)), count)
            at = (np.arange(to[-1]) - to[text]) * step + ends[text]
            for rep in range(self.repetitions):
                for size, keys in self._keys(words, at, rep, sizes).items():
                    known, order, seen = self.tables[step, size, rep]
                    maybe = np.flatnonzero(seen[keys & _U((1 << _FILTER_BITS) - 1)])
                    maybe = maybe[at[maybe] + size <= ends[text[maybe] + 1]]
                    lo, hi = np.searchsorted(known, keys[maybe]), np.searchsorted(known, keys[maybe], side="right")
                    for x in np.flatnonzero(hi > lo):
                        w = maybe[x]
                        for o in order[lo[x] : hi[x]]:
                            item, place = self.plans[step, size][o]
                            found.add((int(text[w]), item, int(at[w]) - place))
        for size, keys in self._runs(words, set(self.pieces)):
            known, owner, seen = self.pieces[size]
            maybe = np.flatnonzero(seen[keys & _U((1 << _FILTER_BITS) - 1)])
            text = np.searchsorted(ends, maybe, side="right") - 1
            inside = maybe + size <= ends[text + 1]
            maybe, text = maybe[inside], text[inside]
            lo, hi = np.searchsorted(known, keys[maybe]), np.searchsorted(known, keys[maybe], side="right")
            for x in np.flatnonzero(hi > lo):
                found.update((int(text[x]), int(item), int(maybe[x]) - int(place)) for item, place in owner[lo[x] : hi[x]])
        yield from sorted(found)

    def matches(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, edits, words of the item, first word after the match), the best for each text and item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried = set()
        for text, item, place in self.candidates(words, ends):
            own = self.items[item][1]
            n, slack = len(own), int(self.max_edits * len(self.items[item][1]))
            if best.get((text, item), (1,))[0] == 0 or (text, item, place // (slack + 1)) in tried:
                continue
            tried.add((text, item, place // (slack + 1)))
            low, high = max(int(ends[text]), place - 2 * slack - 1), min(int(ends[text + 1]), place + n + 2 * slack + 1)
            part = words[low:high]
            exact = place >= low and place + n <= high and np.array_equal(words[place : place + n], own)
            # within slack edits, all but slack words of the item occur in the part
            if not exact and np.isin(own, part).sum() < n - slack:
                continue
            edits, end = (0, place + n - low) if exact else edit_distance_within(own, part)
            if edits <= slack and (edits, low + end) < best.get((text, item), (n, 0)):
                best[text, item] = edits, low + end
        return [(t, self.items[i][0], e, len(self.items[i][1]), int(end - ends[t])) for (t, i), (e, end) in sorted(best.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' word hashes in blocks; the driver holds one block and a partition of items at a time."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("long"), F.lower(text_col)).toLocalIterator():
        hashes, _ = word_hashes(*utf8(pa.array([row[1]], pa.string())), NOT_ALNUM)
        block.append((row[0], hashes))
        size += len(hashes)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _text_words(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*utf8(part.column(column)), NOT_ALNUM)


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = 200_000, **options) -> DataFrame:
    """A row per text and item found in it: ``id_col``, ``item_id_col``, edits, item_words, match_end (in words)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, `{item_id_col}` long, edits int, item_words int, match_end long"
    found = None
    for block in item_blocks(items, item_id_col, item_text_col, block_words):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, **options))

        def scan(batches, index=index):
            for batch in batches:
                for part in slices(batch, 1, 1 << 19):
                    hits = index.value.matches(*_text_words(part, 1))
                    cols = list(zip(*hits, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())],
                        names=[id_col, item_id_col, "edits", "item_words", "match_end"],
                    )

        part = arrow_map(rows, scan, ddl)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], ddl) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = 200_000, **options) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, with all columns."""
    at, schema = len(docs.columns), docs.schema
    for block in item_blocks(items, item_id_col, item_text_col, block_words):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, **options))

        def keep(batches, index=index):
            for batch in batches:
                for part in slices(batch, at, 1 << 19):
                    clean = np.ones(part.num_rows, bool)
                    clean[[hit[0] for hit in index.value.matches(*_text_words(part, at))]] = False
                    yield part.select(range(at)).filter(pa.array(clean))

        docs = arrow_map(docs.select("*", F.lower(text_col).alias("_words")), keep, schema)
    return docs
