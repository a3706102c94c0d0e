"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the texts' n-grams, summed per text.

Every text is scored against all others: its own counts are taken off the corpus counts, so
that a text which nothing resembles scores low and backing off has a meaning. With c' those
counts, a word after its context scores c'(context, word) / c'(context) if that is above 0,
else ``alpha`` times its score after the context without its first word; a word alone scores
c'(word) / (words of the other texts), or 1 / (those + 1) if no other text has it.

The relation of n-grams is kept packed: a row holds a run's distinct n-gram hashes of one order
and hash range, sorted, with their counts. A run is about ``RUN`` words of a part of the texts.
The rows are shuffled to their hash range, where the counts of equal hashes are added up and
joined back to every run's own hashes: counting and joining meet the same rows at the same place,
so the exploded n-grams move once. Each run's totals go back to it in its order, in a file of its
own in the shared folder, and the second pass over the texts sums per text. So a few bytes per
distinct n-gram of a run move; a frequent n-gram is one entry a run; all counts are of all texts.
There are as many hash ranges as keep one's entries at about ``RANGE_BYTES``, so a task does not
grow with the corpus.

The result is stored, so that the side files can be deleted before it is read. ``df`` must give
the same partitions when it is read again, as files do; a run whose n-grams differ at the second
reading raises an error. Defined cases: null, empty and wordless texts score 0 over 0 words;
null and repeated ids are texts of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import arrow_map, drop_folder, drop_written, fresh_uri, partitions_for, settle, slices, written
from weftline.llm.words import mix, utf8, word_hashes

_U = np.uint64
#: Words of a part that are counted together; a part has one run of n-grams for each so many words.
RUN = 1_500_000
#: Packed n-grams of one order that meet in one range, about; an n-gram of each order takes ``ENTRY_BYTES`` or less of six bytes of text.
RANGE_BYTES, ENTRY_BYTES, WORD_BYTES = 64 << 20, 8, 6


def _packed(x: np.ndarray, width: int) -> bytes:
    """Integers as byte planes under zstandard."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def _unpacked(b: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(f"<u{width}")


def ngram_hashes(words: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order``: the hash of the n-gram that ends at each word, 0 where the text has fewer words before."""
    place = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
    out = [words]
    for n in range(2, order + 1):
        h = np.zeros(len(words), _U)
        h[1:] = mix(out[-1][:-1] * _U(0xD6E8FEB86659FD93) + words[1:] + _U(n))
        h[h == 0] = 1
        h[place < n - 1] = 0
        out.append(h)
    return out


def _runs(batches, order: int):
    """(ids, word ends, n-gram hashes) of runs of whole texts with about ``RUN`` words."""
    ids, words, ends, held = [], [], [0], 0
    for batch in batches:
        for part in slices(batch, 1, 1 << 19):
            w, e = word_hashes(*utf8(part.column(1)))
            ids += part.column(0).to_pylist()
            words.append(w)
            ends += (e[1:] + held).tolist()
            held += len(w)
            if held >= RUN:
                ends_ = np.array(ends, np.int64)
                yield ids, ends_, ngram_hashes(np.concatenate(words), ends_, order)
                ids, words, ends, held = [], [], [0], 0
    if ids:
        ends_ = np.array(ends, np.int64)
        yield ids, ends_, ngram_hashes(np.concatenate(words), ends_, order)


def _bounds(ranges: int) -> np.ndarray:
    return np.array([k * (1 << 64) // ranges for k in range(1, ranges)], _U)


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, order: int = 3, alpha: float = 0.4, ranges: int | None = None) -> DataFrame:
    """A row per row of ``df``: ``id_col``, n_words, mean_log10, log10_score (the sum over words)."""
    spark = df.sparkSession
    ranges = ranges or partitions_for(df.select(text_col), RANGE_BYTES * WORD_BYTES // ENTRY_BYTES)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def count(batches):
        part = TaskContext.get().partitionId()
        for run, (_, _, grams) in enumerate(_runs(batches, order)):
            for n, h in enumerate(grams, 1):
                known, counts = np.unique(h[h != 0], return_counts=True)
                cuts = np.concatenate(([0], np.searchsorted(known, _bounds(ranges)), [len(known)]))
                out = []
                for k in range(ranges):
                    x, c = known[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]
                    if len(x):
                        out.append((n, k, part, run, _packed(np.diff(x, prepend=_U(0)), 8), _packed(c, 4)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["n", "range", "part", "run", "hashes", "counts"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def add_up(table: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_unpacked(b, 8), dtype=_U) for b in table.column("hashes").to_pylist()]
        sizes = [len(x) for x in hashes]
        all_hashes = np.concatenate(hashes)
        del hashes
        counts = np.concatenate([_unpacked(b, 4) for b in table.column("counts").to_pylist()]).astype(np.int64)
        by = np.argsort(all_hashes, kind="stable")  # sorted runs are merged
        ordered = all_hashes[by]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        sums = np.add.reduceat(counts[by], np.flatnonzero(first))
        totals = np.empty(len(by), np.int64)
        totals[by] = sums[np.cumsum(first) - 1]
        cuts = np.cumsum(sizes)[:-1]
        answers = [_packed(t, 8) for t in np.split(totals, cuts)]
        words = int(counts.sum()) if table.column("n")[0].as_py() == 1 else 0
        return pa.table({"n": table.column("n"), "range": table.column("range"), "part": table.column("part"), "run": table.column("run"), "totals": pa.array(answers, pa.binary()), "words": pa.array([words] + [0] * (len(sizes) - 1), pa.int64())})

    ddl = "n int, range int, part int, run int, hashes binary, counts binary"
    counted = arrow_map(rows, count, ddl).groupBy("n", "range").applyInArrow(add_up, "n int, range int, part int, run int, totals binary, words long")
    counted = written(counted, "counts")
    all_words = counted.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()["w"]
    folder = fresh_uri(spark, "part-counts")

    def store(table: pa.Table) -> pa.Table:
        part, run = (table.column(c)[0].as_py() for c in ("part", "run"))
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out = io.BytesIO()
        ordered = table.sort_by([("n", "ascending"), ("range", "ascending")]).select(["n", "totals"])
        with pa.ipc.new_file(out, ordered.schema) as writer:
            writer.write_table(ordered)
        name = f"{path}/.{part}.{run}.{uuid.uuid4().hex}"
        with fs.open_output_stream(name) as f:
            f.write(out.getvalue())
        settle(fs, name, f"{path}/{part}.{run}.arrow")
        return pa.table({"part": pa.array([part], pa.int32())})

    counted.groupBy("part", "run").applyInArrow(store, "part int").count()
    drop_written(counted)
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches):
        part, (fs, path) = TaskContext.get().partitionId(), pyarrow.fs.FileSystem.from_uri(folder)
        for run, (ids, ends, grams) in enumerate(_runs(batches, order)):
            text = np.repeat(np.arange(len(ids)), np.diff(ends))
            source = None
            if len(text):
                with fs.open_input_file(f"{path}/{part}.{run}.arrow") as f:
                    source = pa.ipc.open_file(f).read_all()
            others = []  # by n: counts of each word's n-gram in other texts, 0 where there is none
            for n, h in enumerate(grams, 1):
                at = np.flatnonzero(h != 0)
                known, where = np.unique(h[at], return_inverse=True)
                total = np.empty(0, np.int64)
                if len(at):
                    mine = source.filter(pa.compute.field("n") == n)
                    total = np.concatenate([_unpacked(b, 8) for b in mine.column("totals").to_pylist()]).astype(np.int64)
                if len(total) != len(known):
                    raise RuntimeError("the texts were dealt out differently at the second reading; write them to files first")
                pair = np.lexsort((where, text[at]))
                new = np.ones(len(pair), bool)
                new[1:] = (where[pair][1:] != where[pair][:-1]) | (text[at][pair][1:] != text[at][pair][:-1])
                own = np.empty(len(pair), np.int64)
                own[pair] = np.diff(np.append(np.flatnonzero(new), len(pair)))[np.cumsum(new) - 1]
                c = np.zeros(len(h), np.int64)
                c[at] = total[where] - own
                others.append((c, own, at))
            n_words = np.diff(ends)
            rest = (all_words - n_words)[text]
            value = np.where(others[0][0] > 0, others[0][0] / np.maximum(rest, 1), 1 / (rest + 1))
            for n in range(2, order + 1):
                c = others[n - 1][0]
                context = np.zeros(len(c), np.int64)
                context[1:] = others[n - 2][0][:-1]
                has = grams[n - 1] != 0
                value = np.where(has, np.where(c > 0, c / np.maximum(context, 1), alpha * value), value)
            sums = np.bincount(text, np.log10(value), len(ids)) if len(text) else np.zeros(len(ids))
            mean = np.divide(sums, n_words, out=np.zeros(len(ids)), where=n_words > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(n_words, pa.int64()), pa.array(mean), pa.array(sums)], names=[id_col, "n_words", "mean_log10", "log10_score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(df.schema[id_col].dataType)
    out = written(arrow_map(rows, score, f"`{id_col}` {kind}, n_words long, mean_log10 double, log10_score double"), "scores")
    drop_folder(spark, folder)
    return out
