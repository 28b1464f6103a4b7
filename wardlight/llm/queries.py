"""Registered queries of this subpackage: name -> (spark, folder) -> DataFrame, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.llm import (
    bpe_fragments, decontamination, exact_dedup, maxscore, nra, packing, pivot_clusters, rans, secrets_ledger,
    signature_join, token_transducer, tool_chat, toxicity,
)
from wardlight.llm.common import table

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"
REGISTRY = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_nearest_toxic_examples(spark, folder):
    scored = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumn("nearest", F.col("nearest.key"))


@query
def op2_rans_token_shards(spark, folder):
    read = rans.round_trip(table(spark, folder, "documents"), tokenizer(WORD_TOKENIZER), end_id=2, n_ids=49408)
    return read.select(
        "doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op3_fragment_bpe(spark, folder):
    both = bpe_fragments.encode_decode(table(spark, folder, "documents"), tokenizer(WORD_TOKENIZER))
    return both.select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_transducer_counts(spark, folder):
    counted = token_transducer.token_counts(table(spark, folder, "documents"), tokenizer(BYTE_TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op5_secret_ledger(spark, folder):
    found = secrets_ledger.scan(table(spark, folder, "documents").select("doc_id", "text"))

    def n(kind: int):
        return F.size(F.filter("_spans", lambda s: s["kind_no"] == kind)).cast("bigint")

    spans = secrets_ledger.spans_text(F.col("_spans"))
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
    )


@query
def op6_complement_packing(spark, folder):
    return packing.packed_documents(table(spark, folder, "documents"), tokenizer(WORD_TOKENIZER), end_id=1).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


# Tools of the derived calls: the conversations hold no calls, so each user turn asks three tools one after another.
TOOLS = {
    "lookup": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 200}},
    },
    "draft": {
        "type": "object", "required": ["words"],
        "properties": {"words": {"type": "integer", "minimum": 1, "maximum": 30}},
    },
    "answer": {
        "type": "object", "required": ["after", "tone"],
        "properties": {"after": {"type": "integer", "minimum": 0}, "tone": {"enum": ["plain", "formal"]}},
    },
}


def derived_calls(turns):
    """Three calls for each user turn; draft needs lookup, and answer needs draft and the answer two turns before."""
    def name(tool: str, turn):
        return F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"), F.lit(tool))

    t = F.col("turn")
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    tone = F.element_at(F.array(F.lit("plain"), F.lit("formal"), F.lit("loud")), (t % 3 + 1).cast("int"))
    arguments = {
        "lookup": F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query"))),
        "draft": F.to_json(F.struct(words.alias("words"))),
        "answer": F.to_json(F.struct(tone.alias("tone"), t.alias("after"))),
    }
    needs = {
        "lookup": F.array().cast("array<string>"), "draft": F.array(name("lookup", t)),
        "answer": F.when(t >= 2, F.array(name("draft", t), name("answer", t - 2))).otherwise(F.array(name("draft", t))),
    }
    asked = turns.where("role = 'user'")
    each = F.explode(F.array(*[
        F.struct(name(k, t).alias("call_id"), F.lit(k).alias("tool"), arguments[k].alias("arguments"), needs[k].alias("needs"))
        for k in TOOLS
    ]))
    return asked.select("conv_id", "turn", each.alias("call")).select("conv_id", "turn", "call.*")


def derived_results(turns):
    """Every assistant turn is the result of the answer call of the turn before it."""
    call = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"), F.lit("answer"))
    return turns.where("role = 'assistant'").select("conv_id", "turn", call.alias("call_id"), F.col("text").alias("content"))


@query
def op7_tool_call_chats(spark, folder):
    turns = table(spark, folder, "conversations")
    return tool_chat.format_chats(turns, derived_calls(turns), derived_results(turns), TOOLS)


@query
def op8_heavy_hitter_dedup(spark, folder):
    return exact_dedup.exact_dedup(table(spark, folder, "documents")).select(
        "doc_id", F.col("keep").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256")
    )


@query
def op9_maxscore_top5(spark, folder):
    return maxscore.top_k(table(spark, folder, "embeddings"), every=50, k=5)


@query
def op10_signature_tree_join(spark, folder):
    return signature_join.near_duplicates(table(spark, folder, "documents"))


@query
def op11_nra_ranked_search(spark, folder):
    return nra.top_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


@query
def op12_pivot_clusters(spark, folder):
    found = pivot_clusters.clusters(table(spark, folder, "embeddings"), scale=64, width=64, k=16, rounds=3)
    return found.withColumn("centroid_sha256", F.sha2(F.concat_ws(",", "centroid").cast("binary"), 256)).drop("centroid")


@query
def op13_benchmark_automaton(spark, folder):
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
