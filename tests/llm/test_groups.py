import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from weftline.llm import banding, exact_dedup, graph, line_dedup, near_dedup
from weftline.llm.minhash import superminhash
from weftline.llm.words import mix

WORDS = [f"w{i}" for i in range(3000)]


def components(nodes, links):
    top = {n: n for n in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 202), (202, 200), (None, 5)]
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_equal_sql(spark, sf_dir, duck):
    assert_same(exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest"), duck.sql(exact_dedup.ORACLE_SQL))


def test_colliding_hashes_are_told_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])], "doc_id long, text string")
    weak = lambda t: F.lit(0)
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, hash128=weak).collect()}
    assert got == {(0, 0, 3), (2, 0, 3), (5, 0, 3), (1, 1, 2), (4, 1, 2), (3, 3, 1)}
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(docs, hash128=weak).collect()) == [0, 1, 3]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (2, 20, 400):
        errors = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, n - n // 2).astype(np.uint64)])
            sig = superminhash(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            errors.append((sig[0] == sig[1]).mean() - (n // 2) / (2 * n - n // 2))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    empty = superminhash(np.empty(0, np.uint64), np.array([0, 0]))
    assert empty.shape == (1, 128)


def test_near_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(banding, "BLOCK", 8)
    rng = random.Random(5)
    texts = ["", None, "a", "a b c", "A b  C", " "]
    for size in (5, 40, 90, 120):
        base = [rng.choice(WORDS) for _ in range(size)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    rows = list(enumerate(texts))

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows}
    links = [(i, j) for i, j in combinations(sets, 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(sets, links)
    got = {r.doc_id: r for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(2)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(12)]
    pool = list(base)
    for line in base:
        words = line.split()
        for _ in range(3):
            w = list(words)
            w[rng.randrange(len(w))] += rng.choice("xyz")
            pool.append(" ".join(w))
        pool += ["  " + line.upper() + " ", line]
    return [(i, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(60, None), (61, "")]


def test_line_groups_equal_brute_force(spark, lined):
    norm = lambda line: " ".join(line.lower().split())
    lines = {norm(x) for _, t in lined if t for x in t.split("\n")} - {""}
    links = [(a, b) for a, b in combinations(sorted(lines), 2) if edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)]
    assert links
    label = components(lines, links)
    first = {}
    for i, t in lined:
        for x in (t or "").split("\n"):
            if norm(x):
                first[norm(x)] = min(first.get(norm(x), i), i)
    keeper = {}
    for line in lines:
        k = (first[line], line)
        keeper[label[line]] = min(keeper.get(label[line], k), k)
    docs = spark.createDataFrame(lined, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_kept, list(r.dropped)) for r in line_dedup.dropped_lines(docs).collect()}
    for i, t in lined:
        dropped, seen = [], set()
        for k, x in enumerate([] if t is None else t.split("\n")):
            if norm(x):
                if (i, norm(x)) != keeper[label[norm(x)]] or norm(x) in seen:
                    dropped.append(k)
                seen.add(norm(x))
        n = 0 if t is None else len(t.split("\n"))
        assert got[i] == (n, n - len(dropped), dropped)
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    for i, t in lined:
        assert kept[i] == (t if not got[i][2] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[i][2]))


def test_lines_are_linked_by_edit_similarity_alone(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    pairs = []
    for size in (5, 12, 40, 100):
        while sum(p[0] == size for p in pairs) < 25:
            words = [rng.choice(vocabulary) for _ in range(size)]
            other = list(words)
            other[rng.randrange(size)] = rng.choice(vocabulary)
            a, b = " ".join(words), " ".join(other)
            if a != b and edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                pairs.append((size, a, b))
    rows = [(2 * k + side, p[1 + side]) for k, p in enumerate(pairs) for side in (0, 1)]
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    rows += [(1000, long), (1001, long[:1500] + "0" + long[1501:]), (1002, "abcdefgh"), (1003, "abcdefgx"), (1004, "abcdxxxx"), (1005, "A"), (1006, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_kept for r in line_dedup.dropped_lines(docs).collect()}
    assert all(got[2 * k] == 1 for k in range(len(pairs)))
    for size in (5, 12, 40, 100):
        found = [got[2 * k + 1] == 0 for k, p in enumerate(pairs) if p[0] == size]
        assert sum(found) >= 0.9 * len(found), size
    assert (got[1001], got[1003], got[1004], got[1005], got[1006]) == (0, 0, 1, 1, 1)


def test_edit_distance_of_lines_equals_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        d, k = edits(a, b), rng.randint(0, 8)
        assert line_dedup._distance(a, b, k) == (d if d <= k else None)
    for _ in range(6):  # long enough for anchors
        a = "".join(rng.choice("abcdefgh") for _ in range(1500))
        b = "".join(rng.choice(["", "x", c, c, c, c, c, c, c, c, c, c, c + "y"]) for c in a)
        d = edits(a, b)
        assert d <= line_dedup._distance(a, b, d + 60) <= d + 60 and line_dedup._distance(a, b, d - 1) is None


def test_simhashes_equal_brute_force():
    features = np.random.default_rng(4).integers(0, 2**63, (50, 64)).astype(np.uint64)
    hashes = mix(features + np.uint64(0x9E3779B97F4A7C15)).tolist()
    for row, got in zip(hashes, line_dedup._simhashes(features).tolist(), strict=True):
        assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in row) > 64)


def test_keys_that_runs_repeat_are_found_across_runs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RUN_LINES", 3)
    rng = random.Random(5)
    lines = [" ".join(rng.choice(WORDS[:40]) for _ in range(3)) for _ in range(60)]
    nodes = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "node long, norm string").repartition(3)
    keys, has, _ = line_dedup.described(pa.array(lines))
    by_key = {}
    for i in range(len(lines)):
        for k in range(keys.shape[1]):
            if has[i, k]:
                by_key.setdefault(int(keys[i, k]), set()).add(i)
    want = {(k, i) for k, members in by_key.items() if len(members) > 1 for i in members}
    got = [(r.key, r.node) for r in line_dedup.shared_keys(nodes, 4).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_lines_that_may_not_link_are_sifted_out(spark, monkeypatch):
    rng = random.Random(6)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcdeé日 ") for _ in range(rng.choice([1, 4, 9, 30])))
        b = "".join(rng.choice(["", "x", c, c, c, c, c, c + "ö"]) for c in a) if rng.random() < 0.7 else "".join(rng.choice("vwxyz") for _ in a)
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    pairs += [("e" * 900, "e" * 899 + "x"), ("e" * 300, "e" * 900)]  # counts beyond a byte
    a, b = (line_dedup.sketches(pa.array([p[k] for p in pairs], pa.string())) for k in (0, 1))
    yes = line_dedup.may_link(a, b, 0.8)
    links = [edits(*p) <= int(max(map(len, p)) * 0.2 + 1e-9) for p in pairs]
    assert line_dedup.similar_lines(0.8)(pairs) == links
    assert 0 < sum(links) <= yes.sum() < len(pairs) and all(y for y, link in zip(yes, links, strict=True) if link)
    # bands of two are done with their hub: none of them goes to blocks; before, each did
    sent = []
    blocks = banding._links_of_blocks
    monkeypatch.setattr(banding, "_links_of_blocks", lambda mixed, *rest: (sent.append(mixed.count()), blocks(mixed, *rest))[1])
    words = [" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(30)]
    rows = [line for w in words for line in (w + " " + " ".join(rng.choice(WORDS) for _ in range(20)), w)]
    line_dedup.line_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).count()
    assert sent == [0]


def test_lengths_cut_bands_where_no_link_crosses(spark):
    line = " ".join(WORDS[:40])
    rows = [(0, line), (1, line + " " + line), (2, line + " " + WORDS[60])]
    nodes = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "node long, norm string")  # a run each
    whole = {(r.key, r.node) for r in line_dedup.shared_keys(nodes, 2).collect()}
    cut = [(r.key, r.node) for r in line_dedup.shared_keys(nodes, 2, 0.8).collect()]
    assert len(cut) == len(set(cut)) and {n for _, n in whole} == {0, 1, 2}
    assert 0 < len(cut) < len(whole)


def test_no_lines_are_shuffled_to_mark_what_is_repeated(spark, monkeypatch):
    plans = {}
    write = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    docs = spark.createDataFrame([(1, "a line that is here"), (2, "a line that is here"), (3, "a line that is her")], "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in line_dedup.dropped_lines(docs).collect()} == {1: 1, 2: 0, 3: 0}
    joined = plans["repeated"].split("Join", 1)[1]
    # the only mention of the text above the scan is the projection to its print
    assert all("md5" in x or "Relation" in x or "isnotnull" in x for x in joined.splitlines() if "norm#" in x)


def test_distances_of_many_pairs_equal_brute_force():
    rng = random.Random(9)
    for letters, size in (("ab", 70), ("abcdefgh ", 140), ("aé日😀bc", 60)):
        pairs, limits = [], []
        while len(pairs) < 150:
            a = "".join(rng.choice(letters) for _ in range(rng.randint(size // 2, size)))
            edit = rng.choice([0.02, 0.1, 0.2, 0.6])
            b = "".join(rng.choice(["", "x", c + "y"]) if rng.random() < edit else c for c in a)
            x, y = sorted((a, b), key=len)
            limit = rng.choice([len(y) // 5, len(y) // 8])
            if x and len(y) - len(x) <= limit:
                pairs.append((x, y))
                limits.append(limit)
        want = [edits(x, y) <= limit for (x, y), limit in zip(pairs, limits, strict=True)]
        assert 0 < sum(want) < len(want) and line_dedup._within(pairs, limits) == want
        assert line_dedup._rows_within(pairs, np.array(limits)).tolist() == want


def test_components_are_not_walked_again_for_further_links(spark, monkeypatch):
    walked = []
    walk = banding.connected_components
    monkeypatch.setattr(banding, "connected_components", lambda edges, *ends: (walked.append(edges.count()), walk(edges, *ends))[1])
    chain = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (40, 41)]
    labels = banding.connected_components(spark.createDataFrame(chain, "node long, hub long"), "node", "hub")
    more = [(31, 15), (50, 51), (51, 41), (2, 3)]
    got = {r.node: r.label for r in banding._joined(labels, spark.createDataFrame(more, "node long, hub long")).collect()}
    assert got == components({x for e in chain + more for x in e}, chain + more) and walked == [len(chain), len(more)]


def test_neither_lines_nor_keys_are_stored_when_links_are_sought(spark, monkeypatch):
    stored, held = [], []
    write, seek = line_dedup.written, line_dedup.components_of_bands
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (stored.append(name), write(df, name))[1])
    monkeypatch.setattr(line_dedup, "components_of_bands", lambda *rest: (held.extend(p.name for p in folder.iterdir() if p.name not in before), seek(*rest))[1])
    from pathlib import Path

    from weftline.llm.shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:").replace("//", "/"))
    before = {p.name for p in folder.iterdir()}
    docs = spark.createDataFrame([(1, "a line that is here"), (2, "a line that is here"), (3, "a line that is her")], "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in line_dedup.dropped_lines(docs).collect()} == {1: 1, 2: 0, 3: 0}
    assert "keys" not in stored and held and not any("-lines-" in n for n in held)


def test_lines_of_a_text_are_normalised_as_each_line_is():
    rng = random.Random(11)
    signs = ["a", "B", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "　", "Σ", "İ", "ß", "日"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice([signs, signs[:3] + ["\n", "Σ"]])) for _ in range(rng.randint(0, 12)))
        assert line_dedup.normalised_lines(text) == [line_dedup.normalised(line) for line in text.split("\n")]
    lines = ["", "a", "日 b", "", "c"]
    assert line_dedup._split("\n".join(lines).encode()).to_pylist() == lines


def test_shuffles_of_the_last_query_are_released(spark):
    import gc
    import time

    from weftline.llm.shared import release, written

    made = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    held = lambda: tracker.shuffleStatuses().size()
    gc.collect()
    for _ in range(3):  # those of other tests
        spark.range(1).count()
        release(spark)
    time.sleep(1)
    before = held()
    made = written(spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count(), "counts")
    assert held() > before
    release(spark)
    for _ in range(20):  # the cleaner is a thread of its own
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and made.count() == 5


def test_lines_are_not_shuffled_to_choose_those_that_share_a_key(spark, monkeypatch):
    plans = {}
    write = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    docs = spark.createDataFrame([(1, "a line that is here"), (2, "another of its kind"), (3, "a line that is her"), (4, "what no other line is like")], "doc_id long, text string")
    assert {r.doc_id: r.n_kept for r in line_dedup.dropped_lines(docs).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}
    assert "Join" not in plans["texts"]


def test_repeated_rows_of_a_text_keep_their_number(spark):
    rows = [(1, "one two three\n\nfour five six"), (1, "one two three\n\nfour five six"), (1, None), (None, "four five six"), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_lines, r.n_kept, list(r.dropped)) for r in line_dedup.dropped_lines(docs).collect()))
    assert got == [(0, 1, 0, [0]), (1, 0, 0, []), (1, 3, 3, []), (1, 3, 3, []), (2, 1, 1, []), (2, 1, 1, [])]


def test_blocks_with_hardly_a_link_are_compared_in_larger_steps(spark, monkeypatch):
    monkeypatch.setattr(banding, "AT_ONCE", 2)
    n = 40
    members = spark.createDataFrame([(7, i, 1) for i in range(n)], "key long, node long, size long")
    texts = spark.createDataFrame([(i, str(i // 2)) for i in range(n)], "node long, text string")
    sign = lambda some: some.select("node", F.lit(b"x").alias("sig"))
    calls = spark.sparkContext.accumulator(0)
    most = spark.sparkContext.accumulator(0)

    def together(pairs):
        calls.add(1)
        most.add(len(pairs))
        return [a == b for a, b in pairs]

    alike = lambda columns, one: (columns == (one[:, None] if one.ndim == 1 else one)).all(axis=0)
    got = {r.node: r.label for r in banding.components_of_bands(members, sign, texts, alike, lambda c: c.to_pylist(), None, 1 << 30, None, together).collect()}
    assert got == {i: i - i % 2 for i in range(n)}
    assert calls.value < most.value / 4


def test_a_pair_that_several_blocks_list_is_compared_once(spark, tmp_path):
    nodes, bands = range(10), range(3)
    members = spark.createDataFrame([(b, n, 1) for b in bands for n in nodes], "key long, node long, size long")
    texts = spark.createDataFrame([(n, f"text {n}") for n in nodes], "node long, text string")
    seen = str(tmp_path / "pairs")

    def together(pairs):
        with open(seen, "a") as f:
            f.writelines(f"{min(p)},{max(p)}\n" for p in pairs)
        return [False] * len(pairs)

    def sign(some):
        return some.withColumn("sig", F.lit(b"x"))

    def possible(pairs):
        return pairs.filter("hub < 0")

    labels = banding.components_of_bands(members, sign, texts, banding.agree(1), lambda c: c.to_pylist(), None, 100, possible, together)
    assert labels.count() == 0
    found = open(seen).read().splitlines()
    # the smallest is every band's hub, and leaves them
    assert sorted(found) == sorted(f"text {a},text {b}" for a in nodes for b in nodes if 0 < a < b)
