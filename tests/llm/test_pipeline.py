"""The whole pipeline on a small corpus against a plain version of each stage."""

import random

import numpy as np
from test_groups import components

import corpus_pipeline
from weftline.llm import tokens, toxicity
from weftline.llm.decontaminate import edit_distance_within

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2500)]


def corpus():
    rng = random.Random(9)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    docs, labels, items = [], [], [" ".join(text(n)) for n in (12, 20, 30)]
    for i in range(240):
        toxic = i % 4 == 0
        docs.append(" ".join(text(30) + (["vilest", "scumbag"] if toxic else [])))
        labels.append((i, int(toxic)))
    for k in range(12):
        docs.append(docs[4 * k + 1])  # exact copies of clean documents
        words = docs[4 * k + 2].split()
        words[5] = "changed"
        docs.append(" ".join(words * 1))
    base = text(80)
    for k in range(6):
        words = list(base)
        words[10 * k] = f"near{k}"
        docs.append(" ".join(words))
    for item in items:
        words = item.split()
        words[3] = "edited"
        docs += [" ".join([*text(20), item, *text(20)]), " ".join([*text(20), *words, *text(20)])]
    docs += [None, "", "short one"]
    return list(enumerate(docs)), labels, list(enumerate(items))


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs, labels, items = corpus()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    given.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.train(frame, given)
    kept = [(i, t) for i, t in docs if model.score(t) < 0.7]
    assert 20 <= len(docs) - len(kept) <= 60 and all("vilest" in (t or "") for i, t in set(docs) - set(kept))
    first = {}
    for i, t in kept:
        first.setdefault(t or "", i)
    kept = [(i, t) for i, t in kept if first[t or ""] == i]
    sets = {i: shingles(t) for i, t in kept}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = components(ids, links)
    kept = [(i, t) for i, t in kept if top[i] == i]
    code: dict[str, int] = {}
    number = lambda text: np.array([code.setdefault(w, len(code)) for w in (text or "").split()], np.uint64)
    leaked = lambda t: any(edit_distance_within(number(x), number(t))[0] <= int(0.2 * len(x.split())) for _, x in items)
    clean = [(i, t) for i, t in kept if not leaked(t)]
    assert links and len(clean) == len(kept) - 6
    tok = tokens.tokenizer(tokens.default_vocabulary())
    want = {i: len(tok.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
