"""Log builders: one row per model run, per decision, per chat, and the older log form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as V
from wardlight.functions import voting
from wardlight.functions.text import digest

HASH_BUCKETS = V.HASH_BUCKETS


def stamp(ts: Column) -> Column:
    return F.date_format(ts, V.TIME_FORMAT)


def run_name(model: Column, ts: Column) -> Column:
    """``<model>_<date>_<time>`` with the separators that file names allow."""
    return F.concat(model, F.lit("_"), F.translate(stamp(ts), " :", "_-"))


def outcome(flag: Column) -> Column:
    return F.when(flag, "adversarial").otherwise("safe")


def _input_columns(text: Column, prompt_chars: int | None) -> list[Column]:
    return [
        F.length(text).cast("bigint").alias("input_length"),
        digest(text, HASH_BUCKETS).alias("input_hash"),
        (text if prompt_chars is None else F.substring(text, 1, prompt_chars)).alias("prompt"),
    ]


def with_input_columns(df: DataFrame, prompt_chars: int | None = V.LOG_PROMPT_CHARS) -> DataFrame:
    """``df`` with ``_input``, the logged length, hash and start of the prompt, in place of the prompt itself.

    Put before an explode, it is computed once per prompt and keeps whole texts out of the exploded rows.
    """
    return df.withColumn("_input", F.struct(*_input_columns(F.col("prompt"), prompt_chars))).drop("prompt")


def model_run_log(scored: DataFrame, times_ms: dict[str, Column], mode: str = V.DEFAULT_MODE,
                  pattern_count: int | None = None, prompt_chars: int | None = V.LOG_PROMPT_CHARS) -> DataFrame:
    """Wide to long: up to four rows per prompt.  Early exits and failed prompts log the keyword model only."""
    limits = [V.EARLY_EXIT_THRESHOLD] + [V.MODEL_THRESHOLD] * 3
    runs = [
        F.struct(
            F.lit(model).alias("model_name"),
            F.col(f"{short}_score").alias("score"),
            times_ms[short].alias("inference_time_ms"),
            (F.col(f"{short}_score") > limit).alias("adversarial"),
        )
        for model, short, limit in zip(V.MODELS, V.SCORE_NAMES, limits)
    ]
    keyword_only = F.col("early_exit") | F.col("error")
    rules = F.col("r.model_name") == V.MODELS[0]
    long = with_input_columns(scored, prompt_chars).select(
        "prompt_id", "ts", "_input",
        F.explode(F.when(keyword_only, F.array(runs[0])).otherwise(F.array(*runs))).alias("r"),
    )
    return long.select(
        "prompt_id",
        "ts",
        run_name(F.col("r.model_name"), F.col("ts")).alias("run_name"),
        F.col("r.model_name").alias("model_name"),
        stamp(F.col("ts")).alias("timestamp"),
        F.col("r.adversarial").alias("adversarial"),
        "_input.*",
        F.lit(mode).alias("sensitivity_mode"),
        F.when(rules, "rule_based").otherwise("ml_model").alias("detection_type"),
        F.when(rules, F.lit(pattern_count or len(V.LITERALS))).cast("bigint").alias("pattern_count"),
        F.when(~rules, "cpu").alias("device"),
        F.col("r.score").alias("score"),
        F.col("r.inference_time_ms").alias("inference_time_ms"),
        F.lit(V.MODEL_THRESHOLD).alias("threshold"),
        (F.col("r.score") > V.MODEL_THRESHOLD).cast("int").alias("above_threshold"),
        F.lit("individual").alias("model_type"),
        outcome(F.col("r.adversarial")).alias("detection_outcome"),
        F.split_part(F.col("r.model_name"), F.lit("_"), F.lit(1)).alias("model_category"),
    )


def decision_log(scored: DataFrame, total_ms: Column, mode: str | Column = V.DEFAULT_MODE,
                 details: bool = True, prompt_chars: int | None = V.LOG_PROMPT_CHARS) -> DataFrame:
    """One row per prompt with scores, flags, winning mechanism and the thresholds in force.

    Rows that went through ``with_input_columns`` before, say before the modes were exploded, are taken as they are.
    """
    scores = [F.col(f"{m}_score") for m in V.SCORE_NAMES]
    flags = ["high_confidence_trigger", "weak_signals_trigger", "majority_consensus", "weighted_ensemble",
             "early_exit", "error", "fallback"]
    settings = ["high_confidence_threshold", "weak_signals_threshold", "majority_threshold", "weighted_threshold"]
    slim = scored if "_input" in scored.columns else with_input_columns(scored, prompt_chars)
    log = slim.withColumn("_s", voting.mode_settings(mode)).select(
        "prompt_id",
        "ts",
        run_name(F.lit("ensemble_decision"), F.col("ts")).alias("run_name"),
        F.lit(V.ENSEMBLE_MODEL).alias("model_name"),
        stamp(F.col("ts")).alias("timestamp"),
        F.col("is_adversarial").alias("adversarial"),
        "_input.*",
        (F.lit(mode) if isinstance(mode, str) else mode).alias("sensitivity_mode"),
        total_ms.alias("total_inference_time_ms"),
        F.greatest(*scores).alias("max_individual_score"),
        F.col("reason").alias("decision_reason"),
        F.col("early_exit").cast("int").alias("early_exit"),
        *[c.alias(f"{m}_score") for m, c in zip(V.SCORE_NAMES, scores)],
        *[(c > V.MODEL_THRESHOLD).cast("int").alias(f"{m}_above_threshold") for m, c in zip(V.SCORE_NAMES, scores)],
        *[F.col(f"voting_details.{f}").cast("int").alias(f"voting_{f}") for f in flags],
        "winning_mechanism",
        *[F.col(f"_s.{s}").alias(s) for s in settings],
        F.lit("ensemble").alias("model_type"),
        outcome(F.col("is_adversarial")).alias("detection_outcome"),
        F.when(F.col("early_exit"), "early_exit").otherwise("full_ensemble").alias("decision_type"),
        details_json().alias("details_json"),
    )
    return log if details else log.drop("details_json")


def details_json() -> Column:
    """Scores, model names, time and vote flags of one decision as a JSON document."""
    return F.to_json(F.struct(
        F.array(*[F.col(f"{m}_score") for m in V.SCORE_NAMES]).alias("scores"),
        F.array(*[F.lit(m) for m in V.SCORE_NAMES]).alias("model_names"),
        stamp(F.col("ts")).alias("timestamp"),
        F.col("voting_details").alias("voting_details"),
    ))


def score_long(scored: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Positional zip of model names and scores, one row per pair."""
    pairs = F.arrays_zip(
        F.array(*[F.lit(n) for n in names or V.COUNTER_MODELS]).alias("model_name"),
        F.array(*[F.col(f"{m}_score") for m in V.SCORE_NAMES]).alias("score"),
    )
    return scored.select("prompt_id", F.posexplode(pairs).alias("model_index", "p")).select(
        "prompt_id", "model_index", F.col("p.model_name").alias("model_name"), F.col("p.score").alias("score")
    )


def chat_log(moderated: DataFrame, latency: Column, session: Column) -> DataFrame:
    """Nested chat document per prompt."""
    scores = F.array(*[F.col(f"{m}_score") for m in V.SCORE_NAMES])
    return moderated.select(
        "prompt_id",
        F.col("ts").alias("timestamp"),
        session.alias("session_id"),
        "prompt",
        "bot_response",
        F.struct(
            F.coalesce("is_adversarial", F.lit(False)).alias("is_adversarial"),
            scores.alias("scores"),
            F.coalesce("reason", F.lit("")).alias("reason"),
            F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
        ).alias("detection_results"),
        latency.alias("latency_seconds"),
        F.struct(
            F.size(scores).alias("model_count"),
            F.lit(V.USER_AGENT).alias("user_agent"),
            F.lit(V.LOG_ZONE).alias("timezone"),
        ).alias("metadata"),
    )


def found(doc: str, kind: str, *paths: str) -> Column:
    """The value at the first of ``paths`` that a VARIANT column has as ``kind``; null where none has."""
    return F.coalesce(*[F.try_variant_get(doc, f"$.{path}", kind) for path in paths])


def flatten_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """``flatten_chat`` of VARIANT documents, newer and older ones mixed.

    Older ones have the prompt under ``user_message`` and the detection fields at the top.  Keys that are missing or of
    another type give null; other keys do no harm.
    """
    detection = {"is_adversarial": "boolean", "reason": "string", "threshold": "double"}
    at = {n: found(doc, kind, f"detection_results.{n}", n) for n, kind in detection.items()}
    scores = found(doc, "array<double>", "detection_results.scores", "scores")
    return docs.select(
        found(doc, "bigint", "prompt_id").alias("prompt_id"), found(doc, "timestamp", "timestamp").alias("timestamp"),
        found(doc, "string", "session_id").alias("session_id"), found(doc, "string", "prompt", "user_message").alias("prompt"),
        found(doc, "string", "bot_response").alias("bot_response"), at["is_adversarial"].alias("is_adversarial"),
        F.posexplode_outer(scores).alias("score_index", "score"), at["reason"].alias("reason"), at["threshold"].alias("threshold"),
        found(doc, "double", "latency_seconds").alias("latency_seconds"), found(doc, "int", "metadata.model_count").alias("model_count"),
        found(doc, "string", "metadata.user_agent").alias("user_agent"), found(doc, "string", "metadata.timezone").alias("timezone"))


FLAGS = ["high_confidence_trigger", "weak_signals_trigger", "majority_consensus", "weighted_ensemble", "early_exit", "error", "fallback"]


def details_rows(df: DataFrame, doc: str = "doc") -> DataFrame:
    """prompt_id and one row per model name and score of a VARIANT details document, with its flags."""
    kept = df.select(
        "prompt_id", F.posexplode(F.arrays_zip(
            found(doc, "array<string>", "model_names").alias("model_name"), found(doc, "array<double>", "scores").alias("score"))).alias("model_index", "p"),
        found(doc, "string", "timestamp").alias("timestamp"),
        *[found(doc, "boolean", f"voting_details.{f}", f).alias(f) for f in FLAGS],
        found(doc, "string", "voting_details.final_decision", "final_decision").alias("final_decision"))
    return kept.select("prompt_id", "model_index", "p.model_name", "p.score", "timestamp", *FLAGS, "final_decision")


def flatten_chat(log: DataFrame) -> DataFrame:
    """Flat view of chat documents; accepts the older ``user_message`` key for the prompt."""
    text = [F.col(c) for c in ("prompt", "user_message") if c in log.columns]
    return log.select(
        "prompt_id",
        "timestamp",
        "session_id",
        F.coalesce(*text).alias("prompt"),
        "bot_response",
        "detection_results.is_adversarial",
        F.posexplode_outer("detection_results.scores").alias("score_index", "score"),
        "detection_results.reason",
        "detection_results.threshold",
        "latency_seconds",
        "metadata.model_count",
        "metadata.user_agent",
        "metadata.timezone",
    )


def model_performance_log(scored: DataFrame, seconds: Column) -> DataFrame:
    """One row per prompt and model: time, score and input length, with a hash in place of the text."""
    text = F.col("prompt")
    base = scored.select(
        "prompt_id", "ts", F.length(text).cast("bigint").alias("input_length"),
        digest(text, HASH_BUCKETS).alias("input_hash"), seconds.alias("inference_time_seconds"),
        *[f"{m}_score" for m in V.SCORE_NAMES],
    )
    pairs = F.explode(F.arrays_zip(
        F.array(*[F.lit(n) for n in V.COUNTER_MODELS]).alias("model_name"),
        F.array(*[F.col(f"{m}_score") for m in V.SCORE_NAMES]).alias("score"),
    ))
    return base.withColumn("p", pairs).select(
        "prompt_id",
        F.col("ts").alias("timestamp"),
        F.col("p.model_name").alias("model_name"),
        "inference_time_seconds",
        F.col("p.score").alias("adversarial_score"),
        "input_length",
        "input_hash",
        F.lit(V.LOG_ZONE).alias("timezone"),
    )


def legacy_run_log(voted: DataFrame, prompt_chars: int | None = V.LEGACY_LOG_PROMPT_CHARS) -> DataFrame:
    """Older log form: one row per model plus one ensemble row, with the start of the prompt.

    ``voted`` has prompt_id, prompt, ts, latency_s, the four ``<model>`` scores and the vote columns.
    """
    rows = [
        F.struct(
            F.lit(m).alias("model_name"),
            F.lit(V.LEGACY_VERSIONS[m]).alias("model_version"),
            F.col(m).alias("detection_score"),
            (F.col(m) > V.MODEL_THRESHOLD).alias("is_adversarial"),
            F.col("latency_s").alias("latency"),
            F.lit(None).cast("string").alias("reasoning"),
            F.lit(None).cast("bigint").alias("model_agreement"),
            F.lit(V.LEGACY_TASKS[m][0]).alias("model_type"),
            F.lit(V.LEGACY_TASKS[m][1]).alias("task"),
        )
        for m in V.LEGACY_MODELS
    ]
    ensemble = F.struct(
        F.lit("ensemble_decision").alias("model_name"),
        F.lit("voting_classifier").alias("model_version"),
        F.col("confidence_score").alias("detection_score"),
        F.col("is_adversarial").alias("is_adversarial"),
        F.lit(None).cast("double").alias("latency"),
        F.col("reason").alias("reasoning"),
        F.col("model_agreement").alias("model_agreement"),
        F.lit("ensemble").alias("model_type"),
        F.lit("final_classification").alias("task"),
    )
    name = F.concat(F.col("r.model_name"), F.lit("_"), F.unix_timestamp("ts").cast("string"))
    prompt = F.col("prompt") if prompt_chars is None else F.substring("prompt", 1, prompt_chars)
    cut = voted.withColumn("prompt", prompt)
    return cut.select("prompt_id", "prompt", "ts", F.explode(F.array(*rows, ensemble)).alias("r")).select(
        "prompt_id",
        name.alias("run_name"),
        "prompt",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "r.*",
    )
