"""Counterfactual-regularised toxicity classifier over word and word-part features.

Features are the distinct words of a text, lower-cased, with their beginnings and ends of three
to six letters, so that inflected forms of a learned stem count as well, and those that two or
three distinct words of the text have once more. Features that labelled
toxic texts hold significantly more often are chosen by counts over the training sample, then a
logistic regression is fitted to them. Every training text has counterfactual copies: where it
names an identity group, with the term swapped for each other of its kind; and in any case with
terms put in, two of a kind for each of ``insertions`` kinds that the text's hash picks. The loss
penalises the squared difference of the copies' logits, and of text and copy, so which group is
named, or that one is, does not move the score. What a copy changes are few features, so pairs
are kept as those.

The training sample is bounded: at most ``max_train`` labelled texts, half of them toxic at
most, in the order of a hash of their ids. The counts, the fit's rows and the model are bounded
by it and by ``max_features``. Every text is scored whole. The kinds are sampled at different
rates, so the intercept is moved back by the logarithm of the rates' ratio: scores mean the share
of toxic labels among all that may train, however many there are.

Defined cases: a null or empty text scores the model's base rate; a null id is the empty string
in the hold-out rule; of several labels for an id the highest counts, null labels none; without
any label of one kind all scores are the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import arrow_map, slices

#: Terms of identity groups by kind, in English, French, German and Spanish; a term may be swapped for any other of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual"),
    ("woman", "man", "transgender", "nonbinary"),
    ("women", "men"),
    ("female", "male"),
    ("immigrant", "native", "refugee"),
    ("disabled", "blind", "deaf"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("noir", "blanc", "asiatique", "arabe", "africain"),
    ("lesbienne", "homosexuel", "bisexuel", "hétérosexuel"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("immigré", "réfugié", "étranger"),
    ("handicapé", "aveugle", "sourd"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("behindert", "taub"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("negro", "blanco", "asiático", "africano", "europeo"),
    ("lesbiana", "gais", "heterosexuales"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("inmigrante", "refugiado", "extranjero"),
    ("discapacitado", "ciego", "sordo"),
)
_WORD = re.compile(r"[^\W\d_]+")
#: ASCII other than letters becomes a space.
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def word_features(word: str) -> Iterable[str]:
    yield "=" + word
    for k in range(3, min(6, len(word) - 1) + 1):
        yield "^" + word[:k]
        yield "$" + word[-k:]


def rough_words(text: str) -> set[bytes]:
    """Distinct runs of UTF-8 between ASCII non-letters; ``_WORD`` cuts them further at other signs."""
    return set(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def plain_words(raw: Iterable[bytes]) -> set[str]:
    return {w for x in raw for w in _WORD.findall(x.decode("utf-8", "replace"))}


def with_counts(counts: Counter[str]) -> set[str]:
    """The features, and ``2`` or ``3`` before those of at least two or three distinct words."""
    return {*counts, *("2" + f for f, n in counts.items() if n >= 2), *("3" + f for f, n in counts.items() if n >= 3)}


def counts_of(words: Iterable[bytes]) -> Counter[str]:
    return Counter(f for w in plain_words(words) for f in word_features(w))


def text_features(words: set[bytes]) -> set[str]:
    return with_counts(counts_of(words))


def changed(counts: Counter[str], gone: Iterable[bytes], new: Iterable[bytes]) -> dict[str, int]:
    """What taking words from a text and putting others in does to its features: 1 for each it gets, -1 for each it loses."""
    moves = counts_of(new)
    moves.subtract(counts_of(gone))
    out = {}
    for f, move in moves.items():
        n = counts[f]
        for k in range(min(n, n + move) + 1, max(n, n + move) + 1):
            if k <= 3:
                out[("", "2", "3")[k - 1] + f] = 1 if move > 0 else -1
    return out


def minus(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    return {f: x for f in {**a, **b} if (x := a.get(f, 0) - b.get(f, 0))}


def counterfactuals(words: set[bytes], counts: Counter[str], terms: tuple[tuple[str, ...], ...], insertions: int) -> list[dict[str, int]]:
    """How features differ between the text and each of its copies, and between copies with different terms."""
    out, kinds = [], [[t.encode() for t in kind] for kind in terms]
    for kind in kinds:
        if present := words.intersection(kind):
            out += [changed(counts, present, [t]) if t not in present else changed(counts, present - {t}, []) for t in kind if present != {t}]
    seed = crc32(b" ".join(sorted(words)))
    for k in range(min(insertions, len(kinds))):
        kind = kinds[(seed + k * 7) % len(kinds)]
        a, b = (seed // 31) % len(kind), (seed // 31 + 1) % len(kind)
        with_a, with_b = (changed(counts, [], {kind[x]} - words) for x in (a, b))
        out += [with_a, minus(with_a, with_b)]
    return out


class Model:
    """Scores texts; ``weights`` maps features to weights, ``pairs`` is the number of counterfactual pairs it was fitted with."""

    def __init__(self, base: float, weights: dict[str, float], pairs: int = 0, remember: int = 200_000):
        self.base, self.weights, self.pairs, self.remember = base, weights, pairs, remember
        self.known = {f.lstrip("23") for f in weights}
        self._forget()

    def _forget(self) -> None:
        self.seen: set[bytes] = set()
        self.marked: set[bytes] = set()

    def __getstate__(self):
        return self.__dict__ | {"seen": set(), "marked": set()}

    def logit(self, text: str | None) -> float:
        words = rough_words(text or "")
        for raw in words.difference(self.seen):
            self.seen.add(raw)
            if any(f in self.known for w in plain_words([raw]) for f in word_features(w)):
                self.marked.add(raw)
        marked = words.intersection(self.marked)
        if len(self.seen) > self.remember:
            self._forget()
        return self.base + sum(self.weights[f] for f in sorted(text_features(marked)) if f in self.weights)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


def gap(model: Model, text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, insertions: int = 4) -> float:
    """The largest difference of logits between a text's counterfactual copies, or it and a copy."""
    words = rough_words(text)
    return max((abs(sum(model.weights.get(f, 0.0) * x for f, x in c.items())) for c in counterfactuals(words, counts_of(words), terms, insertions)), default=0.0)


def fit_logistic(rows: list[list[int]], y: np.ndarray, pairs: list[list[tuple[int, int]]], n_features: int, *, l2: float = 1e-4, counterfactual: float = 1.0, steps: int = 600, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """Weights of a logistic regression on presence features, by Adam.

    ``pairs`` are the (feature, 1 or -1) in which the two texts of a counterfactual pair differ.
    The loss is the mean log loss + l2 * |w|^2 / 2 + counterfactual * the sum over pairs of their
    squared difference of logits, over the number of pairs that differ.
    """
    n = len(rows)
    at = np.repeat(np.arange(n), [len(x) for x in rows])
    col = np.fromiter((j for x in rows for j in x), np.int64, len(at))
    p_at = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
    p_col = np.fromiter((j for x in pairs for j, _ in x), np.int64, len(p_at))
    p_sign = np.fromiter((s for x in pairs for _, s in x), float, len(p_at))
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        logit = b + np.bincount(at, w[col], n)
        g_logit = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / n
        g_w = l2 * w + np.bincount(col, g_logit[at], n_features)
        if len(p_at):
            between = np.bincount(p_at, p_sign * w[p_col], len(pairs))
            g_w += np.bincount(p_col, 2 * counterfactual / len(pairs) * between[p_at] * p_sign, n_features)
        g = np.append(g_w, g_logit.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return b, w


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_train: Callable[[Column], Column] = lambda i: ~held_out(i),
    max_train: int = 10_000, max_features: int = 4_000, min_z: float = 4.5, min_lift: float = 2.5, terms=IDENTITY_TERMS, insertions: int = 4, counterfactual: float = 1.0, l2: float = 1e-4,
) -> Model:
    """Fit on labelled texts for which ``may_train(id)`` holds."""
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isNotNull() & F.col("_id").isNotNull() & may_train(F.col("_id")))
    given = given.groupBy("_id").agg(F.max("_y").alias("_y"))
    by_hash = [F.xxhash64(F.col("_id")), F.col("_id")]
    half = max_train // 2
    n_pos, n_neg = given.agg(F.count(F.when(F.col("_y") >= 1, 1)), F.count(F.when(F.col("_y") < 1, 1))).first()
    rates = [min(most, n) / n if n else 1.0 for most, n in ((half, n_pos), (max_train - half, n_neg))]
    chosen = given.filter("_y >= 1").orderBy(*by_hash).limit(half).unionByName(given.filter("_y < 1").orderBy(*by_hash).limit(max_train - half))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # at most max_train ids are broadcast
    sample = texts.join(F.broadcast(chosen), "_id").repartition(8, "_id").select("_y", "_text").persist()
    try:
        model = _fit(sample, max_features, min_z, min_lift, terms, insertions, counterfactual, l2)
        model.base += float(np.log(rates[1] / rates[0])) if all(rates) else 0.0
        return model
    finally:
        sample.unpersist()


def _fit(sample, max_features, min_z, min_lift, terms, insertions, counterfactual, l2) -> Model:
    totals = {r["_y"] >= 1: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = totals.get(True, 0), totals.get(False, 0)
    if not n_pos or not n_neg:
        share = min(max(n_pos / max(n_pos + n_neg, 1), 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))), {})

    def features(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ys, xs = part.column(0).to_pylist(), part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([list(text_features(rough_words(t or ""))) for t in xs], pa.list_(pa.string()))], names=["y", "f"])

    pos, neg = F.sum(F.when(F.col("y") >= 1, 1).otherwise(0)), F.sum(F.when(F.col("y") < 1, 1).otherwise(0))
    p, q = F.col("pos") / n_pos, F.col("neg") / n_neg
    both = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    z = (p - q) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / n_pos + 1 / n_neg))
    counted = arrow_map(sample, features, "y int, f array<string>").select("y", F.explode("f").alias("f")).groupBy("f").agg(pos.alias("pos"), neg.alias("neg"))
    found = counted.filter((F.col("pos") >= 2) & (z >= min_z) & (p >= min_lift * q)).orderBy(z.desc(), "f").limit(max_features)
    names = [r["f"] for r in found.select("f").collect()]
    index = {f: k for k, f in enumerate(names)}

    def vectors(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                own, pairs = [], []
                for text in part.column(1).to_pylist():
                    words = rough_words(text or "")
                    counts = counts_of(words)
                    own.append(sorted(index[f] for f in with_counts(counts) if f in index))
                    pairs.append([[{"f": index[f], "s": x} for f, x in sorted(c.items()) if f in index] for c in counterfactuals(words, counts, terms, insertions)])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.list_(pa.struct([("f", pa.int32()), ("s", pa.int32())]))))], names=["y", "x", "c"])

    got = sorted((r["y"], r["x"], [[(d["f"], d["s"]) for d in c] for c in r["c"]]) for r in arrow_map(sample, vectors, "y int, x array<int>, c array<array<struct<f: int, s: int>>>").collect())
    y = np.array([r[0] >= 1 for r in got], float)
    # pairs whose texts differ in no feature of the model have no gap
    pairs = [c for r in got for c in r[2]]
    differ = [c for c in pairs if c]
    base, w = fit_logistic([r[1] for r in got], y, differ, len(names), l2=l2, counterfactual=counterfactual)
    return Model(float(base), {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}, len(pairs))


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """A row per row of ``docs``: ``id_col``, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("_held"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            s = [model.score(t) for part in slices(batch, 2, 1 << 22) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    return arrow_map(rows, score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns."""
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for part in slices(batch, at, 1 << 22):
                yield part.filter(pa.array([model.score(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return arrow_map(docs, keep, docs.schema)
