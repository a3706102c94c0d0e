"""From bands of signatures to verified groups: hubs, links, and blocks for what hubs leave apart.

Members of a band are compared with the band's smallest node, their hub, as whole texts. Of a
node's links one is kept, to its smallest hub, and its other hubs are linked to that one: the same
components from about two links a node. Members that are still apart from most of their band are
compared with a member of that majority, and at last, in bands that hold several components even
then, members of different components are compared block by block, through their signatures
first. So every pair that shares a band, and whose signatures agree in enough slots, is linked
directly or already connected, and no task holds a band.

A caller may know cheaply that texts are not similar (``Possible``, ``Alike``): such pairs are
not brought together with their texts. With it, hubs leave their bands once they are compared.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.graph import connected_components
from weftline.llm.shared import arrow_map, by_runs, drop_written, release, slices, written

#: Texts of a column as what ``Similar`` compares, and the comparison.
Prepare = Callable[[pa.Array], list[Any]]
Similar = Callable[[Any, Any], bool]
#: The comparison of several pairs at once, where that is faster.
Together = Callable[[list[tuple[Any, Any]]], list[bool]]
#: node, sig and, if a pair is to be compared in the first band it shares only, bands (its keys, in order) of the nodes of a table (node).
Sign = Callable[[DataFrame], DataFrame]
#: Pairs (node, hub) without those that are known not to be similar.
Possible = Callable[[DataFrame], DataFrame]
#: Which columns of an array of signatures (slots, texts) may be of texts similar to that of one signature, or to those of the columns of another array.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Members of a band that are compared in one block, and the shingles that their sets may hold together.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Pairs of a block that are compared together, if several are at once: so many first, twice as many after each round with hardly a link, up to the second number. Bytes of texts of blocks that then are, about.
AT_ONCE, MOST_AT_ONCE, TEXT_BYTES = 256, 4096, 4 << 20
#: Members of blocks whose signatures are compared together, and pairs of signatures that then are.
SMALL, SIG_PAIRS = 48, 1 << 15


def _verified(pairs: DataFrame, texts: DataFrame, prepare: Prepare, together: Together, text_bytes: int) -> DataFrame:
    """The pairs (node, hub) of similar texts, of which about ``text_bytes`` are compared together."""
    left = texts.select("node", F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("hub"), F.col("text").alias("tb"))
    # the hub is in many pairs: rows that share it come together after the second join
    rows = pairs.join(left, "node").join(right, "hub").select("node", "ta", "hub", "tb")

    def verify(batches):
        known: OrderedDict[int, Any] = OrderedDict()
        for batch in batches:
            for part in slices(batch, 1, text_bytes):
                nodes, hubs = part.column(0).to_pylist(), part.column(2).to_pylist()
                fresh: dict[int, int] = {}
                for k, i in enumerate(hubs):
                    if i not in known:
                        fresh.setdefault(i, k)
                known.update(zip(fresh, prepare(part.column(3).take(pa.array(fresh.values(), pa.int64()))), strict=True))
                yes = together([(a, known[b]) for a, b in zip(prepare(part.column(1)), hubs, strict=True)])
                while len(known) > 64:
                    known.popitem(last=False)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hubs, pa.int64())], names=["node", "hub"]).filter(pa.array(yes, pa.bool_()))

    return arrow_map(rows, verify, "node long, hub long")


def stars(links: DataFrame) -> DataFrame:
    """(node, hub), stored: links with the same components, one a node, to its smallest hub, and one from each of its other hubs to that.

    A node has as many hubs as bands at most.
    """
    least = written(links.groupBy("node").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs")), "least")
    between = least.select(F.explode("hubs").alias("node"), F.col("least").alias("hub")).filter("node <> hub").distinct()
    out = written(least.select("node", F.col("least").alias("hub")).unionByName(between), "links")
    drop_written(least)
    release(out.sparkSession)
    return out


def _mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their labels, and the bands that hold several labels.

    Such a band comes with its most frequent label, a member of it, the numbers of members with
    that label and with others, and the shingles of both kinds.
    """
    now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    some = F.min_by("node", F.xxhash64("node", "key")).alias("some")
    shares = now.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), some)
    bands = shares.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "label", "some", "shingles")).alias("m"))
    several = bands.filter("labels > 1").select(
        "key", F.col("m.label").alias("major"), F.col("m.some").alias("some"), F.col("m.n").alias("n_major"), F.col("m.shingles").alias("s_major"),
        (F.col("n") - F.col("m.n")).alias("n_minor"), (F.col("shingles") - F.col("m.shingles")).alias("s_minor"),
    )
    return now, written(several, "mixed")


def _links_of_blocks(mixed: DataFrame, sign: Sign, texts: DataFrame, alike: Alike, prepare: Prepare, together: Together, at_once: int) -> DataFrame:
    """(node, hub): links between members of a band that have different labels, as far as they connect labels.

    ``mixed`` has the members of the bands of ``_mixed``. Those with the most frequent label are
    connected already, so only the others need comparing, with each other and with these. Both
    kinds are cut into chunks of about ``BLOCK`` members, fewer if their sets are large; a chunk
    of others and any chunk form a block. So a band in which most are connected costs little more
    than its members. Given bands, a pair belongs to the first it shares; else one that several
    blocks list is left to one of them. Where the signatures are ``alike``, the pair is listed by
    its nodes, and the texts are compared when the block's members are brought together with
    their texts: no task holds a band, and a text comes once for all its pairs in a block.
    """
    chunks_of = lambda n, shingles: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("long")
    few, many, is_major = chunks_of("n_minor", "s_minor"), chunks_of("n_major", "s_major"), F.col("label") == F.col("major")
    place = F.xxhash64("node", "key")
    rows = mixed.withColumn("chunk", F.when(is_major, few + F.pmod(place, many)).otherwise(F.pmod(place, few)))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_major, few).otherwise(few + many) - 1)))
    rows = rows.select("key", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "chunk", "node", "label")
    signs = sign(rows.select("node").distinct())
    once = "bands" in signs.columns
    rows = rows.join(signs.select("node", "sig", *["bands"] * once), "node")

    def pairs_of(node: np.ndarray, label: np.ndarray, x: np.ndarray, y: np.ndarray, blocks: list[str]) -> pa.Table:
        """Pairs of members ``x`` and ``y``, each with its smaller node first."""
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        return pa.table({"block": pa.array(blocks, pa.string()), "node": node[x], "label": label[x], "other": node[y], "other_label": label[y]})

    def list_partners(table: pa.Table) -> pa.Table | None:
        n = table.num_rows
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(n, -1)
        node, label, chunk = (table.column(c).to_numpy() for c in ("node", "label", "chunk"))
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        if once:
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
            bands = bands[:, : int(np.flatnonzero(bands[0] == key)[0])]
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        xs, ys = [], []
        facing = np.ascontiguousarray(sig[right].T)
        for x in left.tolist():
            hit = right[(label[right] != label[x]) & alike(facing, sig[x])]
            if i == j:
                hit = hit[node[hit] > node[x]]
            if once:
                hit = hit[~(bands[hit] == bands[x]).any(axis=1)]
            if len(hit):
                xs.append(np.full(len(hit), x))
                ys.append(hit)
        if not xs:
            return None
        x, y = np.concatenate(xs), np.concatenate(ys)
        return pairs_of(node, label, x, y, [f"{key}.{i}.{j}"] * len(x))

    def list_small(table: pa.Table, runs: list[tuple[int, int]]) -> pa.Table | None:
        """As ``list_partners``, for some blocks of few members each."""
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        key, i, j, node, label, chunk = (table.column(c).to_numpy() for c in ("key", "i", "j", "node", "label", "chunk"))
        begins, sizes = np.array(runs, np.int64)[:, 0], np.diff(np.array(runs, np.int64), axis=1)[:, 0]
        left, right = [], []
        for n in np.unique(sizes).tolist():
            of_n, (p, q) = begins[sizes == n], np.triu_indices(n, 1)
            step = max(1, SIG_PAIRS // max(1, len(p)))
            for at in range(0, len(of_n), step):
                x, y = ((of_n[at : at + step, None] + k).ravel() for k in (p, q))
                # members of a block are of its chunks, those of one chunk meet in a block of its own
                open_ = (label[x] != label[y]) & ((i[x] == j[x]) | (chunk[x] != chunk[y]))
                x, y = x[open_], y[open_]
                hit = alike(sig[y].T, sig[x].T)
                left.append(x[hit])
                right.append(y[hit])
        x, y = np.concatenate(left), np.concatenate(right)
        if not len(x):
            return None
        blocks = [f"{a}.{b}.{c}" for a, b, c in zip(key[x].tolist(), i[x].tolist(), j[x].tolist(), strict=True)]
        return pairs_of(node, label, x, y, blocks)

    def list_runs(table: pa.Table, runs: list[tuple[int, int]]) -> list[pa.Table | None]:
        small = [] if once else [(x, y) for x, y in runs if y - x <= SMALL]
        large = runs if once else [(x, y) for x, y in runs if y - x > SMALL]
        return [list_partners(table.slice(x, y - x)) for x, y in large] + ([list_small(table, small)] if small else [])

    def links_of(table: pa.Table):
        """A block's links; on the way it gives lists of pairs and is sent which of them are similar."""
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        of, top = dict(zip(node, label, strict=True)), {x: x for x in label}

        def root(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        links, waiting, most = [], [], at_once

        def link(answers):
            for (x, y), yes in zip(waiting, answers, strict=True):
                if yes:
                    top[root(of[x])] = root(of[y])
                    links.append((x, y))
            waiting.clear()

        for x, others in zip(node, table.column("partners").to_pylist(), strict=True):
            for y in others:
                if root(of[x]) != root(of[y]):
                    waiting.append((x, y))
                    if len(waiting) == most:
                        before = len(links)
                        link((yield waiting))
                        # with few links, few of the next pairs are spared by them
                        if 1 < most < MOST_AT_ONCE and 8 * (len(links) - before) < most:
                            most *= 2
        if waiting:
            link((yield waiting))
        return links

    def compare(table: pa.Table, runs: list[tuple[int, int]]) -> list[pa.Table]:
        """Links of some blocks, whose pairs are compared together."""
        held = {}
        for batch in table.select(["node", "text"]).combine_chunks().to_batches():
            for part in slices(batch, 1, 1 << 19):
                held.update(zip(part.column(0).to_pylist(), prepare(part.column(1)), strict=True))
        links, asked = [], [(links_of(table.slice(x, y - x)), None) for x, y in runs]
        while asked:
            still = []
            for block, answers in asked:
                try:
                    still.append((block, block.send(answers)))
                except StopIteration as end:
                    links += end.value
            yes = together([(held[x], held[y]) for _, pairs in still for x, y in pairs]) if still else []
            ends = np.cumsum([0, *(len(pairs) for _, pairs in still)]).tolist()
            asked = [(block, yes[x:y]) for (block, _), x, y in zip(still, ends, ends[1:], strict=False)]
        return [pa.table({"node": pa.array([x for x, _ in links], pa.int64()), "hub": pa.array([y for _, y in links], pa.int64())})]

    def compare_runs(table: pa.Table, runs: list[tuple[int, int]]) -> list[pa.Table]:
        if at_once == 1:  # what is prepared of a block may be large
            return [t for x, y in runs for t in compare(table.slice(x, y - x), [(0, y - x)])]
        ends = np.cumsum(pc.binary_length(table.column("text")).to_numpy())
        out, at = [], 0
        while at < len(runs):
            to, base = at + 1, ends[runs[at][0]]
            while to < len(runs) and ends[runs[to][1] - 1] - base <= TEXT_BYTES:
                to += 1
            x, y = runs[at][0], runs[to - 1][1]
            out += compare(table.slice(x, y - x), [(p - x, q - x) for p, q in runs[at:to]])
            at = to
        return out

    pairs = by_runs(rows, ["key", "i", "j"], list_runs, "block string, node long, label long, other long, other_label long")
    if not once:
        pairs = pairs.groupBy("node", "other").agg(*[F.min(c).alias(c) for c in ("block", "label", "other_label")])
    ends = F.array(F.struct("node", "label", F.array("other").alias("partners")), F.struct(F.col("other").alias("node"), F.col("other_label").alias("label"), F.array().cast("array<bigint>").alias("partners")))
    listed = pairs.select("block", F.inline(ends)).groupBy("block", "node", "label").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    return by_runs(listed.join(texts, "node"), ["block"], compare_runs, "node long, hub long", spread=True)


def agree(least: int) -> Alike:
    """Signatures of at most 255 slots that agree in ``least`` of them."""
    return lambda columns, one: (columns == (one[:, None] if one.ndim == 1 else one)).sum(axis=0, dtype=np.uint8) >= least


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label), which are dropped, as further links (node, hub) join components. Only the components that these touch are walked."""
    of = lambda c, d: labels.select(F.col("node").alias(c), F.col("label").alias(d))
    between = links.join(of("node", "a"), "node", "left").join(of("hub", "b"), "hub", "left")
    over = connected_components(between.select(F.coalesce("a", "node").alias("a"), F.coalesce("b", "hub").alias("b")))
    old = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = over.join(labels.select("node"), "node", "left_anti")
    out = written(old.unionByName(new), "labels")
    drop_written(over, labels)
    return out


def components_of_bands(members: DataFrame, sign: Sign, texts: DataFrame, alike: Alike, prepare: Prepare, similar: Similar | None, majority_from: int = 0, possible: Possible | None = None, together: Together | None = None) -> DataFrame:
    """(node, label) of the nodes with a link; the label is the smallest node of the component. A stored table.

    ``members`` has key, node and size (what the text weighs in a block), without repeats and
    only keys with several nodes; ``texts`` node and text. Signatures decide in blocks only. Bands
    with fewer members than ``majority_from`` go to blocks at once. Given ``possible``, hubs are
    taken out of their bands when they have been compared, and bands of two are done with that.
    """
    at_once, text_bytes = (AT_ONCE, TEXT_BYTES) if together else (1, TEXT_BYTES // 4)
    together = together or (lambda pairs: [similar(a, b) for a, b in pairs])
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), *[F.count("*").alias("n")] * (possible is not None))
    others = members.join(hubs, "key").filter("node <> hub")
    used = []
    if possible is None:
        possible = lambda pairs: pairs
    else:
        others = written(others, "others")
        members = others.filter("n > 2").select("key", "node", "size")
        used.append(others)
    compared = lambda pairs: stars(_verified(possible(pairs.select("node", "hub").distinct()), texts, prepare, together, text_bytes))
    links = compared(others)
    labels = connected_components(links, "node", "hub")
    now, several = _mixed(members, labels)
    wide = several.filter(F.col("n_major") + F.col("n_minor") >= majority_from)
    more = compared(now.join(wide, "key").filter("label <> major").select("node", F.col("some").alias("hub")))
    used += [links, more]
    release(members.sparkSession)
    if more.limit(1).count():
        drop_written(several)
        labels = _joined(labels, more)
        now, several = _mixed(members, labels)
    release(members.sparkSession)
    last = written(_links_of_blocks(now.join(several, "key"), sign, texts, alike, prepare, together, at_once), "links")
    release(members.sparkSession)
    if last.limit(1).count():
        labels = _joined(labels, last)
    drop_written(*used, last, several)
    return labels
