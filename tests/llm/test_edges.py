"""Every operator over nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

import pytest

import corpus_pipeline
from weftline.llm import backoff, chat, decontaminate, exact_dedup, line_dedup, near_dedup, packing, registry, surrogates, token_store, tokens, toxicity
from weftline.llm.shared import fresh_uri

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "x", "y"),
    (2, "alpha beta gamma delta epsilon zeta", None, "y"),
    (2, "alpha beta gamma delta epsilon zeta", None, "y"),
    (3, None, "x", None),
    (4, "", "x", "y"),
    (None, "someone wrote to bob@site.org\n\nsomeone wrote", "x", "y"),
    (5, "word " * 20_000, "x", "y"),
    (6, " \n\t\n ", None, None),
    (7, "ünïcödé 漢字 😀 ​ end", "x", "y"),
]
DDL = "doc_id long, text string, _text string, label string"
CLASH = "doc_id long, text string, _gone string, _dropped string, _i string, _id string, node long, key long, label string"


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, DDL), spark.createDataFrame([], DDL)


def labels(spark, rows=((1, 1), (5, 0), (None, 1), (7, None))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


def items(spark, rows=((1, "beta gamma delta epsilon"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def tokenised(df):
    path = fresh_uri(df.sparkSession, "t")
    token_store.write_tokens(df, path, tokens.default_vocabulary(), shards=3)
    return token_store.read_tokens(df.sparkSession, path)


OPERATORS = {
    "tokens": lambda s, df: tokenised(df),
    "decontaminate": lambda s, df: decontaminate.find_contamination(df, items(s)),
    "decontaminate-drop": lambda s, df: decontaminate.drop_contaminated(df, items(s)),
    "exact": lambda s, df: exact_dedup.exact_groups(df),
    "exact-drop": lambda s, df: exact_dedup.drop_exact(df),
    "lines": lambda s, df: line_dedup.dropped_lines(df),
    "surrogates": lambda s, df: surrogates.replace_entities(df, b"k"),
    "near": lambda s, df: near_dedup.near_groups(df),
    "backoff": lambda s, df: backoff.score_texts(df.coalesce(1)),
    "packing": lambda s, df: packing.pack_documents(df, tokens.default_vocabulary()),
    "toxicity": lambda s, df: toxicity.score_documents(df, toxicity.train(df, labels(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(name, spark, frames):
    full, empty = frames
    out = OPERATORS[name](spark, full)
    assert len(set(out.columns)) == len(out.columns)
    n = out.count()
    if name in ("exact", "lines", "surrogates", "near", "backoff", "toxicity", "tokens"):
        assert n == len(ROWS)
    assert OPERATORS[name](spark, empty).count() == 0


def test_defined_results(spark, frames):
    full, _ = frames
    exact = exact_dedup.exact_groups(full, keep="largest").filter("doc_id in (1, 2, 3, 4)").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact} == {(1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True)}
    kept = exact_dedup.drop_exact(full)
    assert kept.columns == full.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 6, 7]
    near = {r.doc_id: r for r in near_dedup.near_groups(full).collect()}
    assert near[2].component_id == 1 and not near[2].kept and near[3].n_shingles == 0 and near[3].kept and near[None].component_id is None
    assert [r.doc_id for r in decontaminate.drop_contaminated(full, items(spark)).orderBy("doc_id").collect()] == [None, 3, 4, 5, 6, 7]
    lines = {r.doc_id: r for r in line_dedup.dropped_lines(full).collect()}
    assert lines[3].n_lines == 0 and lines[4].n_kept == 1 and lines[1].dropped == [] and lines[2].dropped == [0]
    texts = {r.doc_id: r.text for r in surrogates.replace_entities(full, b"k").collect()}
    assert texts[3] is None and texts[4] == "" and "bob@site.org" not in texts[None] and texts[None].startswith("someone wrote to ")


def test_chats_without_rows_and_with_nulls(spark):
    ddl = "conv_id long, turn long, role string, text string, json string"
    schemas = chat.tool_schemas(spark, registry.TOOLS)
    assert chat.format_chats(spark.createDataFrame([], ddl), schemas).count() == 0
    rows = [(None, 0, "assistant", '{"tool_calls": [{"id": "a"}]}', "z"), (1, None, "tool", '{"tool_call_id": "a"}', None), (1, 1, None, None, None), (1, 1, "user", "x" * 100_000, None), (1, 1, "user", "x", None), (1, 1, "user", "x", None)]
    got = chat.format_chats(spark.createDataFrame(rows, ddl), schemas).collect()
    assert len(got) == 6 and sum(r.calls for r in got) == 1 and sum(r.linked for r in got) == 0 and sum(r.errors for r in got) >= 1


def test_pipeline_stages_on_edges(spark, frames, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in frames:
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{df is frames[0]}-{name}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == df.columns
    assert docs.count() == 0


@pytest.mark.parametrize("drop", [near_dedup.drop_near, line_dedup.drop_lines, exact_dedup.drop_exact])
def test_clashing_names(drop, spark):
    rows = [(k, t, "g", "d", "i", "x", 1, 2, None) for k, t in enumerate(["one two three four five six", "one two three four five six", None, "other words"])]
    df = spark.createDataFrame(rows, CLASH)
    out = drop(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect() if r.text) == ([0, 3] if drop is not line_dedup.drop_lines else [0, 3])
    assert out.filter("_gone = 'g' and _dropped = 'd'").count() == out.count()


def test_rows_that_repeat_an_id_with_other_texts_keep_their_own_groups(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (9, b), (5, "third text of that number")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (9, 5, False), (9, 5, False)]
    assert sorted((r.doc_id, r.text) for r in near_dedup.drop_near(df).collect()) == sorted([(3, a), (5, b), (5, "third text of that number")])
