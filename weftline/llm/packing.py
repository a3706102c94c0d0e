"""Hierarchical multi-length packing of token ids into training sequences.

Each document is cut into whole long windows; what is left is routed to the smallest context
tier that holds it. Long tiers are packed first: the gap beside a routed piece is filled with
the largest pieces of shorter tiers that fit, then with a piece cut to size. Shorter tiers
pack what the longer ones did not take. Every window ends up exactly full, at a power of two;
what remains when a task ends is cut into power-of-two sequences, so nothing is padded.
Windows of a tier are dealt to step groups of ``group_tokens`` ids each, those with the highest
attention cost (the sum of squared piece lengths) spread evenly.

Packing is local to a task: no shuffle, no group beyond a buffer of pieces, and sequence ids
carry the task's number. Defined cases: a null text is empty and gets the end id alone; null
and repeated ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import arrow_map, slices
from weftline.llm.tokens import tokenizer

#: doc_id, place in the document, ids, length of the document
Piece = tuple[int | None, int, np.ndarray, int]
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in DDL.split(", ")])


class Packer:
    """Packs the documents of one task; holds at most ``buffered`` routed pieces between flushes."""

    def __init__(self, tiers=(1024, 512, 256, 128), group_tokens: int = 8192, buffered: int = 4096, first_id: int = 0):
        self.tiers = tuple(sorted(tiers, reverse=True))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("context tiers are powers of two")
        self.longest, self.group_tokens, self.buffered = self.tiers[0], group_tokens, buffered
        self.sequence = self.group = first_id
        self.routed: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        self.full: dict[int, list[list[Piece]]] = {t: [] for t in self.tiers}
        self.waiting = 0
        self.rows: list[tuple] = []

    def _route(self, piece: Piece) -> None:
        n = len(piece[2])
        tier = min(t for t in self.tiers if t >= n)
        bisect.insort(self.routed[tier], piece, key=lambda p: len(p[2]))
        self.waiting += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        for at in range(0, n - self.longest + 1, self.longest):
            self.full[self.longest].append([(doc_id, at, ids[at : at + self.longest], n)])
        if rest := n % self.longest:
            self._route((doc_id, n - rest, ids[n - rest :].copy(), n))
        if self.waiting >= self.buffered:
            self._pack()

    def _take(self, tier: int, gap: int) -> Piece | None:
        """The largest waiting piece of at most ``gap`` ids from this tier or shorter ones; else one cut to the gap."""
        shorter = [t for t in self.tiers if t <= tier]
        for t in shorter:
            pieces = self.routed[t]
            if k := bisect.bisect_right(pieces, gap, key=lambda p: len(p[2])):
                self.waiting -= 1
                return pieces.pop(k - 1)
        for t in reversed(shorter):
            if self.routed[t]:
                doc_id, at, ids, n = self.routed[t].pop()
                self.waiting -= 1
                self._route((doc_id, at + gap, ids[gap:], n))
                return doc_id, at, ids[:gap], n
        return None

    def _pack(self) -> None:
        for tier in self.tiers:
            while self.routed[tier]:
                window, gap = [], tier
                while gap and (piece := self._take(tier, gap)):
                    window.append(piece)
                    gap -= len(piece[2])
                if gap:  # too little is left to fill it
                    for piece in window:
                        self._route(piece)
                    break
                self.full[tier].append(window)
        self._emit(False)

    def _emit(self, last: bool) -> None:
        for tier in self.tiers:
            windows, each = self.full[tier], max(1, self.group_tokens // tier)
            n = len(windows) if last else len(windows) // each * each
            chosen, self.full[tier] = windows[:n], windows[n:]
            groups = -(-n // each)
            chosen.sort(key=lambda w: -sum(len(p[2]) ** 2 for p in w))
            for i, window in enumerate(chosen):
                turn, place = divmod(i, groups)
                self._write(window, tier, self.group + (place if turn % 2 == 0 else groups - 1 - place))
            self.group += groups

    def _write(self, window: list[Piece], tier: int, group: int) -> None:
        offset = 0
        for doc_id, at, ids, n in window:
            self.rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), n, self.sequence, offset, tier, group))
            offset += len(ids)
        self.sequence += 1

    def close(self) -> None:
        self._pack()
        self._emit(True)
        rest = [p for t in self.tiers for p in reversed(self.routed[t])]
        size = sum(len(p[2]) for p in rest)
        while size:
            want = room = min(1 << size.bit_length() - 1, self.longest)
            window = []
            while room:
                doc_id, at, ids, n = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc_id, at + room, ids[room:], n))
                    ids = ids[:room]
                window.append((doc_id, at, ids, n))
                room -= len(ids)
            self._write(window, want, self.group)
            size -= want
        self.routed = {t: [] for t in self.tiers}


def pack_documents(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers=(1024, 512, 256, 128), group_tokens: int = 8192) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``tier`` is the sequence's context size, to which it is exactly full.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tail = int(end_id).to_bytes(4, "little")

    def pack(batches):
        packer = Packer(tiers, group_tokens, first_id=TaskContext.get().partitionId() << 40)
        tok = tokenizer(vocabulary)

        def drain():
            out, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=SCHEMA)

        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                for doc_id, ids in zip(part.column(0).to_pylist(), tok.encode(part.column(1)), strict=True):
                    packer.add(doc_id, np.frombuffer(ids + tail, "<u4"))
                if packer.rows:
                    yield drain()
        packer.close()
        if packer.rows:
            yield drain()

    return arrow_map(rows, pack, DDL)
