"""The queries of this subpackage, by the names the entry module registers."""

from __future__ import annotations

from weftline.llm import backoff, chat, decontaminate, exact_dedup, line_dedup, near_dedup, packing, shared, surrogates, token_store, tokens, toxicity


def op1_plane_shuffled_tokens(spark, sf_dir):
    path = shared.fresh_uri(spark, "tokens")
    token_store.write_tokens(shared.documents(spark, sf_dir), path, tokens.default_vocabulary(), end_id=2)
    return token_store.read_tokens(spark, path)


def op2_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_contamination(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(shared.documents(spark, sf_dir), keep="largest")


def op4_fuzzy_line_dedup(spark, sf_dir):
    return line_dedup.dropped_lines(shared.documents(spark, sf_dir))


#: Tools that chats may call, with their arguments' schemas.
TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "fetch": {"properties": {"url": {"type": "string"}, "timeout": {"type": "number"}}, "required": ["url"]},
    "run": {"properties": {"code": {"type": "string"}, "env": {"type": "object"}, "args": {"type": "array"}}, "required": ["code"]},
}


def op5_tool_call_linking(spark, sf_dir):
    """The table holds no tool calls, so its turns are put as calls and results first."""
    return chat.format_chats(chat.as_tool_use(spark.read.parquet(f"{sf_dir}/conversations.parquet")), chat.tool_schemas(spark, TOOLS))


def op6_surrogate_generation(spark, sf_dir):
    return surrogates.replace_entities(shared.documents(spark, sf_dir), b"op6 surrogates")


def op7_superminhash_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(shared.documents(spark, sf_dir), width=4, percent=80)


def op8_stupid_backoff(spark, sf_dir):
    return backoff.score_texts(shared.documents(spark, sf_dir), order=3)


def op9_hierarchical_packing(spark, sf_dir):
    return packing.pack_documents(shared.documents(spark, sf_dir), tokens.default_vocabulary(), end_id=0)


def op10_counterfactual_toxicity(spark, sf_dir):
    docs, labels = shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_documents(docs, toxicity.train(docs, labels))


QUERIES = (
    op1_plane_shuffled_tokens,
    op2_benchmark_decontamination,
    op3_exact_dedup,
    op4_fuzzy_line_dedup,
    op5_tool_call_linking,
    op6_surrogate_generation,
    op7_superminhash_near_dedup,
    op8_stupid_backoff,
    op9_hierarchical_packing,
    op10_counterfactual_toxicity,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op5_tool_call_linking": chat.ORACLE_SQL}
