"""Registered queries: name -> (spark, folder) -> DataFrame, all over the whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed_values as V
from wardlight.functions import classifiers, legacy, rules, text, voting
from wardlight.operators import (
    baseline, counters, dataprep, detect, edits, evaluation, fuzzy, logs, monitoring, ngrams, ordered, reports,
    rollups,
)
from wardlight.plans import inputs
from wardlight.session import scratch_path, stored
from wardlight.sources import tabular
from wardlight.sources.committed import CommittedLog
from wardlight.streaming import jobs, late

REGISTRY = {}
AS_OF = "2024-01-31 00:00:00"
OWN_PATTERNS = [r"e.*\d", r"colou?r|licen[cs]ed?", r"\bth(at|is)\b", "of.*the.*in", r"[.,]$", r"t{2}", "ion"]
TIME_SHARES = {"keyword": 0.05, "toxic": 0.4, "hate": 0.35, "safety": 0.2}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


# --- shared steps -------------------------------------------------------------------------------------------

def scored(spark: SparkSession, folder: str, **options) -> DataFrame:
    return detect.score_prompts(inputs.prompts(spark, folder), **options)


def lowered(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.prompts(spark, folder).withColumn("l", F.lower("prompt"))


def times_ms() -> dict[str, Column]:
    return {name: F.col("latency_s") * 1000.0 * share for name, share in TIME_SHARES.items()}


def total_ms() -> Column:
    return F.col("latency_s") * 1000.0


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    return logs.model_run_log(scored(spark, folder), times_ms())


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return logs.decision_log(scored(spark, folder), total_ms(), details=False)


def split_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the deduplicated, relabelled set, stored once for all their readers."""
    split = stored(dataprep.stratified_split(stored(clean(spark, folder), "clean")), "split")
    parts = inputs.scan_parts(spark)
    sides = [split.where(F.col("split") == side).drop("split") for side in ("train", "test")]
    return tuple(side.repartition(parts, "row_id") if parts else side for side in sides)


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return dataprep.dedup_prompts(dataprep.standardize_labels(inputs.labelled(spark, folder)))


def spread_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean set stored once, for queries that read it several times, and spread where the user asks for it."""
    rows, parts = stored(clean(spark, folder), "clean"), inputs.scan_parts(spark)
    return rows.repartition(parts, "row_id") if parts else rows


def raw_overlap_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents without a mark as train, documents with one as test; copies may lie on both sides."""
    docs = inputs.table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("prompt"))
    marks = inputs.table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"))
    return docs.join(marks, "row_id", "left_anti"), docs.join(marks, "row_id", "left_semi")


def stored_overlap_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``raw_overlap_sides`` from one join, stored, for queries that read the texts several times: a join beyond the
    size of a broadcast moves all texts, and would do so for either side and every reading."""
    docs = inputs.table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("prompt"))
    marks = inputs.table(spark, folder, "labels").select(F.col("doc_id").alias("row_id")).distinct()
    rows = stored(docs.join(marks.withColumn("marked", F.lit(True)), "row_id", "left"), "sides", "zstd")
    return rows.where("marked is null").drop("marked"), rows.where("marked").drop("marked")


# --- rule scoring -------------------------------------------------------------------------------------------

@query
def keyword_hits(spark, folder):
    hits = rules.with_keyword_score(inputs.prompts(spark, folder))
    return hits.select(
        "prompt_id", "n_high", "n_plain", "n_down", (F.col("n_high") + F.col("n_plain") + F.col("n_down")).alias("n_literals")
    )


@query
def pattern_hits(spark, folder):
    return rules.with_keyword_score(inputs.prompts(spark, folder)).select("prompt_id", "n_pattern")


@query
def context_flags(spark, folder):
    words = {
        "is_medical": V.MEDICAL_CONTEXT, "is_disposal": V.DISPOSAL_CONTEXT, "is_range": V.RANGE_CONTEXT,
        "is_safe": V.SAFE_CONTEXT,
    }
    return lowered(spark, folder).select(
        "prompt_id", *[text.any_of(F.col("l"), w).alias(name) for name, w in words.items()]
    )


@query
def context_tier(spark, folder):
    return lowered(spark, folder).select("prompt_id", rules.context_tier(F.col("l")).alias("tier10"))


@query
def rule_points(spark, folder):
    return rules.with_keyword_score(inputs.prompts(spark, folder)).select("prompt_id", "points10")


@query
def keyword_score(spark, folder):
    return rules.with_keyword_score(inputs.prompts(spark, folder)).select("prompt_id", "points10", "keyword_score")


@query
def early_exit_split(spark, folder):
    split = detect.with_early_exit(rules.with_keyword_score(inputs.prompts(spark, folder)))
    return split.groupBy("early_exit").agg(
        F.count(F.lit(1)).alias("n"), F.min("keyword_score").alias("lowest"), F.max("keyword_score").alias("highest")
    )


@query
def toxic_score(spark, folder):
    score = classifiers.toxic_score(F.col("l"), F.col("toxic"))
    return lowered(spark, folder).select("prompt_id", score.alias("toxic_score"))


@query
def hate_score(spark, folder):
    score = classifiers.hate_score(F.col("l"), F.col("hate"))
    return lowered(spark, folder).select("prompt_id", score.alias("hate_score"))


@query
def safety_score(spark, folder):
    score = classifiers.safety_score(F.col("l"), F.col("safety"))
    return lowered(spark, folder).select("prompt_id", score.alias("safety_score"))


# --- vote and decision --------------------------------------------------------------------------------------

def _mode_of_event() -> Column:
    return F.element_at(F.array(F.lit("high"), F.lit("conservative"), F.lit("balanced"), F.lit("other")),
                        (F.col("prompt_id") % 4 + 1).cast("int"))


def _voted_grid(spark, folder):
    grid = inputs.score_grid(spark, folder).withColumn("mode", _mode_of_event())
    return voting.with_vote(grid.withColumn("_settings", voting.mode_settings(F.col("mode"))))


@query
def sensitivity_modes(spark, folder):
    asked = inputs.score_grid(spark, folder).select("prompt_id", _mode_of_event().alias("mode"))
    return asked.withColumn("_s", voting.mode_settings(F.col("mode"))).select("prompt_id", "mode", "_s.*")


@query
def hybrid_vote(spark, folder):
    return _voted_grid(spark, folder).select("prompt_id", "mode", "mechanism", "is_adversarial")


@query
def vote_reason(spark, folder):
    return _voted_grid(spark, folder).select("prompt_id", "reason")


@query
def winning_mechanism(spark, folder):
    return scored(spark, folder, mode="conservative").select("prompt_id", "winning_mechanism", "early_exit")


DECISION_COLUMNS = ["prompt_id", "keyword_score", "toxic_score", "hate_score", "safety_score", "early_exit",
                    "is_adversarial", "reason", "threshold", "winning_mechanism"]


@query
def detect_prompts(spark, folder):
    return scored(spark, folder).select(*DECISION_COLUMNS)


REGISTRY["detect"] = REGISTRY.pop("detect_prompts")


@query
def detect_parallel(spark, folder):
    result = detect.breakdown(scored(spark, folder, mode="high", parallel=True), times_ms())
    return result.select(
        *DECISION_COLUMNS,
        F.col("model_breakdown.toxic").alias("breakdown_toxic"),
        F.col("timing_breakdown.hate").alias("time_hate_ms"),
    )


@query
def fallback_decision(spark, folder):
    broken = F.col("prompt_id") % 3 == 0
    result = scored(spark, folder, failed=broken)
    return result.select("prompt_id", "error", "is_adversarial", "reason", "winning_mechanism",
                         F.col("voting_details.fallback").alias("fallback"))


@query
def basic_keyword_fallback(spark, folder):
    turns = inputs.table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    both = turns.unionByName(inputs.prompts(spark, folder).select(
        F.col("prompt_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), "prompt"
    ))
    return detect.basic_fallback(both, F.lit("model failure")).select(
        "conv_id", "turn", "is_adversarial", "keyword_score", "reason"
    )


@query
def moderation_gate(spark, folder):
    return detect.moderate(scored(spark, folder)).select("prompt_id", "is_adversarial", "bot_response")


@query
def mode_compare(spark, folder):
    return detect.compare_modes(inputs.prompts(spark, folder)).select(
        "prompt_id", "mode", "is_adversarial", "reason", "winning_mechanism"
    )


@query
def own_rules(spark, folder):
    """A caller's vocabulary over all documents: regex syntax of every kind, wildcards, literals of two weights."""
    own = rules.RuleSet(
        literals=["stupid", "the th", "zz"], high_risk=["stupid"], down_weighted=["zz"], patterns=OWN_PATTERNS,
        safe_context=["from"], medical_context=["license"], disposal_context=["re"], disposal_words=["ing"],
        range_context=["und"], range_words=["der"])
    docs = inputs.table(spark, folder, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return rules.with_keyword_score(docs, rules=own).select(
        "prompt_id", "n_high", "n_plain", "n_down", "n_pattern", "points10", "keyword_score")


def _modes_of_scorers(spark, folder, **options):
    plain = inputs.prompts(spark, folder).select("prompt_id", "prompt")
    scorer = detect.batch_scorer(_length_model)
    compared = detect.compare_modes(
        plain, scorers={name: scorer for name in detect.RAW_COLUMNS}, failed=F.col("prompt_id") % 5 == 0, **options)
    return compared.select("prompt_id", "mode", "error", "is_adversarial", "reason", "winning_mechanism")


@query
def mode_compare_scorers(spark, folder):
    """Modes under a caller's models and with failed rows; models read the first 512 characters."""
    return _modes_of_scorers(spark, folder, input_chars=detect.MODEL_INPUT_CHARS)


@query
def mode_compare_scorers_whole(spark, folder):
    """As ``mode_compare_scorers``, with models that read whole prompts."""
    return _modes_of_scorers(spark, folder)


def _failing_model():
    """As ``_length_model``, but breaks down on texts of a length divisible by 7."""
    def predict(texts):
        if any(len(t) % 7 == 0 for t in texts):
            raise RuntimeError("broken")
        return _length_model()(texts)
    return predict


def _failed_scorers(spark, folder, **options):
    plain = inputs.prompts(spark, folder).select("prompt_id", "prompt")
    scorer = detect.batch_scorer(_failing_model)
    return detect.score_prompts(
        plain, scorers={name: scorer for name in detect.RAW_COLUMNS}, on_failure="fallback", **options
    ).select(*DECISION_COLUMNS, "error")


@query
def scorer_failure(spark, folder):
    """Prompts whose models fail go to the fallback, all others are decided as ever; models read 512 characters."""
    return _failed_scorers(spark, folder, input_chars=detect.MODEL_INPUT_CHARS)


@query
def scorer_failure_whole(spark, folder):
    """As ``scorer_failure``, with models that read whole prompts."""
    return _failed_scorers(spark, folder)


@query
def score_long(spark, folder):
    return logs.score_long(scored(spark, folder))


# --- older ensemble -----------------------------------------------------------------------------------------

def legacy_outputs(spark, folder):
    """All-label outputs per model from document lengths; some models give none for some prompts."""
    n = F.col("n_chars")

    def share(base: int) -> Column:
        return (n % base).cast("double") / F.lit(float(base))

    def outputs(*pairs: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("label"), v.alias("score")) for k, v in pairs])

    return inputs.table(spark, folder, "documents").select(
        F.col("doc_id").alias("prompt_id"),
        F.col("text").alias("prompt"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"),
        (n.cast("double") / 2000.0).alias("latency_s"),
        outputs(("LABEL_0", 1.0 - share(83)), ("LABEL_1", share(83))).alias("electra_small_out"),
        F.when(n % 7 != 0, outputs(("toxic", share(41) * 0.4), ("insult", share(13)), ("threat", share(29) * 0.3),
                                   ("identity_hate", share(31) * 0.1))).alias("tox_bert_out"),
        outputs(("non-offensive", 1.0 - share(59) * 0.6), ("offensive", share(59) * 0.6)).alias("offensive_roberta_out"),
        F.when(n % 5 != 0, outputs(("safe", 1.0 - share(71) * 0.5), ("toxic", share(71) * 0.5))).alias("bart_mnli_out"),
    )


def legacy_scored(spark, folder):
    return legacy_outputs(spark, folder).withColumns({m: legacy.legacy_score(m, F.col(f"{m}_out")) for m in V.LEGACY_MODELS})


def legacy_voted(spark, folder):
    return legacy_scored(spark, folder).withColumns(legacy.legacy_vote([F.col(m) for m in V.LEGACY_MODELS]))


@query
def legacy_scores(spark, folder):
    return legacy_scored(spark, folder).select("prompt_id", *V.LEGACY_MODELS)


@query
def legacy_vote(spark, folder):
    votes = legacy.legacy_vote([F.col(f"{m}_score") for m in V.SCORE_NAMES])
    return inputs.score_grid(spark, folder).withColumns(votes).select("prompt_id", *votes)


@query
def legacy_detect(spark, folder):
    return legacy_voted(spark, folder).select(
        "prompt_id", "is_adversarial", "reason", "electra_vote", "model_agreement", "confidence_score"
    )


@query
def legacy_run_log(spark, folder):
    return logs.legacy_run_log(legacy_voted(spark, folder))


# --- logs ---------------------------------------------------------------------------------------------------

@query
def model_run_log(spark, folder):
    return run_log(spark, folder).drop("ts")


@query
def decision_log(spark, folder):
    return decisions(spark, folder).drop("ts")


@query
def details_json(spark, folder):
    return scored(spark, folder).select("prompt_id", logs.details_json().alias("details_json"))


DETAILS = """scores array<double>, model_names array<string>, timestamp string, voting_details struct<
high_confidence_trigger: boolean, weak_signals_trigger: boolean, majority_consensus: boolean, weighted_ensemble: boolean,
early_exit: boolean, error: boolean, fallback: boolean, final_decision: string>"""


@query
def details_json_fields(spark, folder):
    """The details document of every decision read back, one row per model name and score."""
    made = scored(spark, folder).select("prompt_id", F.from_json(logs.details_json(), DETAILS).alias("d"))
    pairs = F.posexplode(F.arrays_zip("d.model_names", "d.scores")).alias("model_index", "p")
    return made.select("prompt_id", "d", pairs).select(
        "prompt_id", "model_index", F.col("p.model_names").alias("model_name"), F.col("p.scores").alias("score"),
        F.col("d.timestamp").alias("timestamp"), "d.voting_details.*")


def _chat_log(spark, folder):
    i = F.col("prompt_id")
    session = F.when(i % 50 != 0, F.concat(F.lit("s"), (i % 200).cast("string")))
    return logs.chat_log(detect.moderate(scored(spark, folder)), F.col("latency_s"), session)


@query
def chat_log_build(spark, folder):
    return _chat_log(spark, folder)


@query
def chat_log_flat(spark, folder):
    flat = logs.flatten_chat(_chat_log(spark, folder))
    return flat.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


CHAT_SCHEMA = """prompt_id bigint, timestamp timestamp, session_id string, prompt string, user_message string,
bot_response string, detection_results struct<is_adversarial: boolean, scores: array<double>, reason: string,
threshold: double>, latency_seconds double,
metadata struct<model_count: int, user_agent: string, timezone: string>"""


@query
def chat_log_stored(spark, folder):
    """Chat documents appended as JSON, half of them under the older prompt key, and read back."""
    log, path = _chat_log(spark, folder), scratch_path(spark, "chats")
    older = F.col("prompt_id") % 2 == 0
    mixed = log.withColumn("user_message", F.when(older, F.col("prompt"))).withColumn("prompt", F.when(~older, F.col("prompt")))
    tabular.append_log(mixed, path, "json", day_of="timestamp")
    flat = logs.flatten_chat(tabular.read_chat_log(spark, path, CHAT_SCHEMA))
    return flat.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query
def chat_log_variant(spark, folder):
    """Chat documents of two shapes in one folder, read as VARIANT."""
    log, path = _chat_log(spark, folder), scratch_path(spark, "chat-documents")
    older = F.col("prompt_id") % 2 == 0
    log.where(~older).withColumn("model_version", F.lit("2")).write.json(f"{path}/newer")
    flat = log.where(older).select(
        "prompt_id", "timestamp", "session_id", F.col("prompt").alias("user_message"), "bot_response", "detection_results.*",
        "latency_seconds", "metadata")
    flat.write.json(f"{path}/older")
    found = logs.flatten_documents(tabular.read_documents(spark, f"{path}/*"))
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query
def details_variant(spark, folder):
    """The details document of every decision as VARIANT, every other one with its flags at the top."""
    made = scored(spark, folder)
    flat = F.to_json(F.struct(
        F.array(*[F.col(f"{m}_score") for m in V.SCORE_NAMES]).alias("scores"),
        F.array(*[F.lit(m) for m in V.SCORE_NAMES]).alias("model_names"), logs.stamp(F.col("ts")).alias("timestamp"), "voting_details.*"))
    text_ = F.when(F.col("prompt_id") % 2 == 0, flat).otherwise(logs.details_json())
    return logs.details_rows(made.select("prompt_id", F.parse_json(text_).alias("doc")))


@query
def runlog_stored(spark, folder):
    """Run log appended as files per day; the day filter prunes folders."""
    path = tabular.append_log(run_log(spark, folder), scratch_path(spark, "runs"))
    stored = tabular.read_log(spark, path).where(F.col("day") >= "2024-01-01")
    return stored.groupBy("day", "model_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("adversarial").alias("adversarial")
    )


@query
def runlog_committed(spark, folder):
    """Run logs of three inputs, each appended twice, merged and read back."""
    runs = stored(run_log(spark, folder), "runs")
    log = CommittedLog(spark, scratch_path(spark, "committed"), runs.schema)
    for part in (0, 1, 2, 0, 1, 2):
        log.append(runs.where(F.col("prompt_id") % 3 == part), f"documents-{part}/run-1")
    log.merge()
    log.append(runs.where("prompt_id % 3 = 1"), "documents-1/run-1")
    return log.read().groupBy(F.to_date("ts").alias("day"), "model_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("adversarial").alias("adversarial"))


@query
def metrics_stored(spark, folder):
    """Evaluation metrics of one run appended as (run, metric, value) rows and read back."""
    path = tabular.append_metrics(macro_metrics(spark, folder), "baseline", scratch_path(spark, "metrics"))
    return tabular.read_log(spark, path)


@query
def model_perf_build(spark, folder):
    log = logs.model_performance_log(scored(spark, folder), F.col("latency_s"))
    return log.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query
def run_names(spark, folder):
    events = inputs.model_events(spark, folder)
    return events.select(
        "event_id",
        logs.run_name(F.col("model_name"), F.col("ts")).alias("run_name"),
        logs.stamp(F.col("ts")).alias("timestamp"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.unix_timestamp("ts").alias("epoch"),
        F.date_format(F.col("ts") - F.expr("INTERVAL 7 DAYS"), "yyyy-MM-dd").alias("week_before"),
    )


@query
def prompt_hash(spark, folder):
    return inputs.prompts(spark, folder).select(
        "prompt_id", text.digest(F.col("prompt"), logs.HASH_BUCKETS).alias("input_hash"), F.md5("prompt").alias("digest")
    )


@query
def text_features(spark, folder):
    t = F.col("text")
    return inputs.table(spark, folder, "documents").select(
        "doc_id",
        F.length(t).cast("bigint").alias("input_length"),
        F.length(F.lower(t)).cast("bigint").alias("lower_length"),
        F.md5(F.upper("source")).alias("upper_digest"),
        F.substring(t, 1, 500).alias("cut_500"),
        F.substring(t, 1, 80).alias("cut_80"),
        text.preview(t, 50).alias("preview"),
        F.split_part("source", F.lit("c"), F.lit(2)).alias("part"),
        F.initcap(F.replace(F.lit("weak_signals_trigger"), F.lit("_"), F.lit(" "))).alias("title"),
        F.contains(F.lower(t), F.lit("the")).alias("has_the"),
    )


@query
def props_extract(spark, folder):
    props = F.from_json("props", "k int")
    return inputs.table(spark, folder, "events").select("event_id", props["k"].cast("bigint").alias("k"))


# --- reports ------------------------------------------------------------------------------------------------

@query
def runlog_search(spark, folder):
    found = reports.search_runs(
        run_log(spark, folder), (F.col("model_name") != V.ENSEMBLE_MODEL) & (F.col("inference_time_ms") > 0), 100
    )
    return found.select("prompt_id", "model_name", "score", "inference_time_ms", "adversarial")


@query
def runlog_filter_text(spark, folder):
    """The newest runs by the filter and order that users write."""
    found = reports.search_runs_text(
        run_log(spark, folder),
        f"""params.model_name != '{V.ENSEMBLE_MODEL}' AND metrics.inference_time_ms > 0 AND tags.detection_outcome = "adversarial" """,
        ["start_time DESC", "prompt_id", "model_name"], 100)
    return found.select("prompt_id", "model_name", "score", "inference_time_ms", "adversarial")


@query
def runlog_filter(spark, folder):
    found = reports.filter_runs(run_log(spark, folder), detection_outcome="adversarial", model_type="individual")
    return found.select("prompt_id", "model_name", "score", "detection_outcome")


@query
def model_run_summary(spark, folder):
    return reports.model_run_summary(run_log(spark, folder))


@query
def model_run_summary_latest(spark, folder):
    """The summary of the newest 100 runs, as the report shows it."""
    return reports.model_run_summary(run_log(spark, folder), latest=100)


@query
def detection_rate(spark, folder):
    return reports.detection_rate(run_log(spark, folder), None)


@query
def mechanism_stats(spark, folder):
    return reports.mechanism_stats(decisions(spark, folder), None)


@query
def early_exit_stats(spark, folder):
    return reports.early_exit_stats(decisions(spark, folder), None)


@query
def mode_stats(spark, folder):
    decided = detect.compare_modes(inputs.prompts(spark, folder), before=logs.with_input_columns)
    return reports.mode_stats(logs.decision_log(decided, total_ms(), F.col("mode"), details=False), None)


@query
def outcome_counts(spark, folder):
    return reports.value_counts(run_log(spark, folder), "detection_outcome")


@query
def label_counts(spark, folder):
    return reports.value_counts(inputs.labelled(spark, folder), "label")


@query
def label_share(spark, folder):
    return reports.value_shares(dataprep.standardize_labels(inputs.labelled(spark, folder)), "label")


@query
def recent_runs(spark, folder):
    return reports.recent_runs(run_log(spark, folder))


@query
def recent_decisions(spark, folder):
    return reports.recent_decisions(decisions(spark, folder))


@query
def class_overview(spark, folder):
    return reports.class_overview(decisions(spark, folder), None)


@query
def class_samples(spark, folder):
    return reports.class_samples(decisions(spark, folder), None)


@query
def length_buckets(spark, folder):
    return reports.length_buckets(decisions(spark, folder), None)


# --- monitoring ---------------------------------------------------------------------------------------------

def performance_events(spark, folder):
    e = inputs.model_events(spark, folder)
    return e.select(
        F.col("ts").alias("timestamp"), "model_name", F.col("latency_s").alias("inference_time_seconds"),
        ((F.col("event_id") % 101).cast("double") / F.lit(101.0)).alias("adversarial_score"),
    )


@query
def statistics_summary(spark, folder):
    """Both parts of the statistics page as one table of (part, name, metric, value)."""
    parts = monitoring.statistics(inputs.chat_events(spark, folder), performance_events(spark, folder), AS_OF)
    return monitoring.statistics_rows(*parts)


@query
def chat_statistics(spark, folder):
    return monitoring.chat_statistics(inputs.chat_events(spark, folder), AS_OF)


def chat_rollup() -> rollups.Rollup:
    return rollups.Rollup(
        counts={"flagged": F.col("detection_results.is_adversarial")}, measures={"latency": F.col("latency_seconds")},
        distinct={"sessions": F.col("session_id")}, quantiles={"latency": F.col("latency_seconds")})


def stored_states(spark, log: DataFrame, rollup: rollups.Rollup) -> DataFrame:
    return spark.read.parquet(rollups.update(rollup.states(log), scratch_path(spark, "states")))


@query
def chat_statistics_rollup(spark, folder):
    """``chat_statistics`` without its distinct count, from stored daily states."""
    log, rollup = inputs.chat_events(spark, folder), chat_rollup()
    found = rollup.trailing(stored_states(spark, log, rollup), log, AS_OF, 7)
    return found.where("n > 0").select(
        F.col("n").alias("total_chats"), F.col("flagged_count").alias("adversarial_detected"),
        (F.col("flagged_count") / F.col("n")).alias("adversarial_rate"), F.round(rollups.mean("latency"), 6).alias("avg_latency"))


@query
def model_performance_rollup(spark, folder):
    """``model_performance`` from stored daily states, over a window that begins within a day."""
    log = performance_events(spark, folder)
    rollup = rollups.Rollup(
        by=["model_name"], measures={"time": F.col("inference_time_seconds"), "score": F.col("adversarial_score")})
    found = rollup.trailing(stored_states(spark, log, rollup), log, AS_OF.replace("00:00:00", "07:30:00"), 7)
    return found.select(
        "model_name", F.col("n").alias("total_inferences"), F.round(rollups.mean("time"), 6).alias("avg_inference_time"),
        F.round(rollups.mean("score"), 6).alias("avg_score"), F.col("score_max").alias("max_score"), F.col("score_min").alias("min_score"))


@query
def model_performance(spark, folder):
    return monitoring.model_performance(performance_events(spark, folder), AS_OF)


@query
def model_stats_one(spark, folder):
    return monitoring.model_performance(performance_events(spark, folder), AS_OF, 14, "electra")


@query
def event_counters(spark, folder):
    return monitoring.event_counters(scored(spark, folder, failed=F.col("prompt_id") % 7 == 0))


@query
def prediction_counters(spark, folder):
    return monitoring.prediction_counters(inputs.model_events(spark, folder))


@query
def failure_counters(spark, folder):
    """Chats that failed: events of the error type, their error named by the user group."""
    events = inputs.table(spark, folder, "events").withColumn("error_type", F.when(
        F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, "general_error").otherwise("timeout")
    ))
    return monitoring.failure_counters(events)


@query
def latency_histogram(spark, folder):
    return monitoring.latency_histogram(inputs.model_events(spark, folder))


@query
def latency_p95(spark, folder):
    return monitoring.latency_quantile(inputs.model_events(spark, folder))


@query
def latency_p95_exact(spark, folder):
    exact = ordered.exact_percentile(inputs.model_events(spark, folder), "latency_s", 0.95, ["model_name"], "p95")
    return exact.select("model_name", F.round("p95", 9).alias("p95"))


@query
def latency_quantiles_5m(spark, folder):
    return monitoring.latency_quantiles_sliding(inputs.model_events(spark, folder)).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query
def avg_latency_5m(spark, folder):
    return monitoring.average_latency_sliding(inputs.model_events(spark, folder)).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query
def request_rate_1m(spark, folder):
    return monitoring.request_rate(inputs.model_events(spark, folder)).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query
def running_totals(spark, folder):
    return monitoring.running_totals(inputs.model_events(spark, folder)).select("event_id", "model_name", "total")


@query
def concurrency(spark, folder):
    return monitoring.concurrency(inputs.model_events(spark, folder))


@query
def chat_context(spark, folder):
    return monitoring.chat_context(inputs.table(spark, folder, "conversations"))


# --- data preparation ---------------------------------------------------------------------------------------

LABELLED_SCHEMA = "row_id bigint, prompt string, label string"


@query
def csv_roundtrip(spark, folder):
    path = tabular.write_csv(inputs.labelled(spark, folder), scratch_path(spark, "csv"))
    return tabular.read_csv(spark, path, LABELLED_SCHEMA)


@query
def tsv_roundtrip(spark, folder):
    path = tabular.write_csv(inputs.labelled(spark, folder), scratch_path(spark, "tsv"), sep="\t")
    return tabular.read_tsv(spark, path, LABELLED_SCHEMA)


@query
def multi_file_union(spark, folder):
    target = scratch_path(spark, "parts")
    tabular.write_csv(inputs.labelled(spark, folder), target, mode="append")
    conversations = inputs.table(spark, folder, "conversations")
    tabular.write_csv(conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("prompt"), F.lit("safe").alias("label")
    ), target, mode="append")
    return dataprep.standardize_labels(tabular.read_csv_folder(spark, target, LABELLED_SCHEMA))


@query
def export_split(spark, folder):
    docs = inputs.table(spark, folder, "documents")
    marks = inputs.table(spark, folder, "labels")
    exported = docs.join(marks, "doc_id").select(
        F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"), "text",
        F.when(F.col("toxic") == 1, "jailbreak").otherwise("benign").alias("label"),
    )
    path = scratch_path(spark, "export")
    exported.write.json(path)
    return dataprep.export_split(spark.read.schema("split string, text string, label string").json(path))


@query
def load_labeled(spark, folder):
    docs = inputs.table(spark, folder, "documents")
    marks = inputs.table(spark, folder, "labels")
    raw_eval = docs.join(marks, "doc_id").select(F.col("text").alias("adversarial"), F.col("toxic").alias("label"))
    raw_train = inputs.table(spark, folder, "conversations").select(
        F.when(F.col("role") == "user", F.col("text")).alias("adversarial")
    )
    return dataprep.load_labelled(raw_eval, raw_train)


@query
def label_map(spark, folder):
    mapped = dataprep.map_values(F.col("label"), {"adversarial": 0, "benign": 1}).cast("bigint")
    return inputs.labelled(spark, folder).select("row_id", "label", mapped.alias("label_id"))


@query
def standardize_labels(spark, folder):
    return dataprep.standardize_labels(inputs.labelled(spark, folder)).select("row_id", "label")


@query
def label_encode(spark, folder):
    return dataprep.label_encode(inputs.labelled(spark, folder)).select("row_id", "label", "label_id")


@query
def dedup_prompts(spark, folder):
    return dataprep.dedup_prompts(inputs.labelled(spark, folder))


@query
def exact_overlap(spark, folder):
    return dataprep.exact_overlap(*raw_overlap_sides(spark, folder))


@query
def seeded_shuffle(spark, folder):
    return dataprep.shuffle_positions(inputs.labelled(spark, folder))


@query
def seeded_sample(spark, folder):
    docs = inputs.table(spark, folder, "documents")
    return dataprep.seeded_sample(docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("prompt")))


@query
def stratified_split(spark, folder):
    return dataprep.stratified_split(stored(clean(spark, folder), "clean")).select("row_id", "label", "split")


@query
def split_shares(spark, folder):
    return dataprep.split_shares(dataprep.stratified_split(stored(clean(spark, folder), "clean")))


@query
def step_profile(spark, folder):
    loaded = inputs.labelled(spark, folder)
    return dataprep.step_profile({"combined": loaded, "deduplicated": dataprep.dedup_prompts(loaded)})


@query
def near_overlap(spark, folder):
    train, test = stored_overlap_sides(spark, folder)
    return fuzzy.near_overlap(test, train)


@query
def near_overlap_best(spark, folder):
    """The most similar train prompt of every test prompt."""
    train, test = stored_overlap_sides(spark, folder)
    return fuzzy.best_matches(test, train)


@query
def edit_overlap(spark, folder):
    """Test prompts within six edits, and a tenth of the text, of a train prompt; bytes, as the SQL form counts them."""
    train, test = stored_overlap_sides(spark, folder)
    return edits.edit_overlap(test, train, unit="byte")


@query
def edit_matches(spark, folder):
    """The nearest train prompt of every test prompt."""
    train, test = stored_overlap_sides(spark, folder)
    return edits.edit_matches(test, train, unit="byte")


@query
def ngram_counts(spark, folder):
    return ngrams.ngram_counts(spread_clean(spark, folder), ngrams.BASELINE_NGRAMS)


@query
def top_ngrams(spark, folder):
    return ngrams.most_frequent(spread_clean(spark, folder), ngrams.LEAK_VOCABULARY)


@query
def ngram_bias(spark, folder):
    return ngrams.ngram_bias(spread_clean(spark, folder), stop_words=inputs.STOP_WORDS).select(
        "gram", F.round("mean_first", 9).alias("mean_first"), F.round("mean_second", 9).alias("mean_second"),
        F.round("difference", 9).alias("difference"),
    )


@query
def tfidf_weights(spark, folder):
    return ngrams.tfidf_long(spread_clean(spark, folder)).withColumn("weight", F.round("weight", 6))


# --- modelling ----------------------------------------------------------------------------------------------

@query
def class_weights(spark, folder):
    return evaluation.class_weights(inputs.labelled(spark, folder))


@query
def baseline_train_eval(spark, folder):
    train, test = split_sets(spark, folder)
    return baseline.Baseline().fit(train).evaluate(test, train)


@query
def batch_scoring(spark, folder):
    train, _ = split_sets(spark, folder)
    docs = inputs.table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("prompt"))
    return baseline.Baseline().fit(train).transform(docs).select("row_id", "prediction", F.round("p", 6).alias("p"))


def _length_model():
    """Stand-in for a text classifier: label and score follow from the length of the text it is given."""
    return lambda texts: [("toxic" if len(t) % 2 else "other", 0.5 + (len(t) % 97) / 200.0) for t in texts]


def _decided_by_scorers(spark, folder, **options):
    plain = inputs.prompts(spark, folder).select("prompt_id", "prompt")
    scorer = detect.batch_scorer(_length_model)
    return detect.score_prompts(
        plain, scorers={name: scorer for name in detect.RAW_COLUMNS}, **options).select(*DECISION_COLUMNS)


@query
def detect_with_scorers(spark, folder):
    """Decisions under a caller's models, which read the first 512 characters."""
    return _decided_by_scorers(spark, folder, input_chars=detect.MODEL_INPUT_CHARS)


@query
def detect_with_scorers_whole(spark, folder):
    """As ``detect_with_scorers``, with models that read whole prompts."""
    return _decided_by_scorers(spark, folder)


@query
def softmax_argmax(spark, folder):
    a, b = F.col("logit0"), F.col("logit1")
    return inputs.evaluation(spark, folder).select(
        "row_id", F.round(evaluation.softmax_positive(a, b), 9).alias("p1"),
        evaluation.argmax_class(a, b).cast("bigint").alias("cls"),
    )


def _predicted(spark, folder):
    cls = evaluation.argmax_class(F.col("logit0"), F.col("logit1"))
    return inputs.evaluation(spark, folder).withColumn("predicted", cls)


@query
def binary_metrics(spark, folder):
    return evaluation.binary_metrics(_predicted(spark, folder))


@query
def macro_metrics(spark, folder):
    return evaluation.macro_metrics(_predicted(spark, folder))


@query
def pr_curve(spark, folder):
    return evaluation.pr_curve(inputs.evaluation(spark, folder))


@query
def best_threshold(spark, folder):
    return evaluation.best_threshold(evaluation.pr_curve(inputs.evaluation(spark, folder)))


@query
def calibrated_threshold(spark, folder):
    best = evaluation.best_threshold(evaluation.pr_curve(inputs.evaluation(spark, folder)))
    path = tabular.write_threshold(best, scratch_path(spark, "threshold"))
    return spark.read.text(path).select(F.col("value").cast("double").alias("threshold"))


@query
def metrics_at_threshold(spark, folder):
    rows = inputs.evaluation(spark, folder)
    best = evaluation.best_threshold(evaluation.pr_curve(rows)).select("threshold").scalar()
    return evaluation.metrics_at_threshold(rows, best)


def _checkpoint_log(spark, folder):
    """Evaluation log: one run per source, one step per hundred documents, F1 of the argmax class."""
    rows = _predicted(spark, folder).withColumns({"run": F.col("source"), "step": F.floor(F.col("row_id") / 100)})
    return evaluation.binary_metrics(rows, by=["run", "step"]).select("run", "step", "f1")


@query
def best_checkpoint(spark, folder):
    return evaluation.best_checkpoints(_checkpoint_log(spark, folder))


@query
def leaderboard(spark, folder):
    """One run per source; some runs name no model, some have no F1."""
    cls = evaluation.binary_metrics(_predicted(spark, folder), by=["source"])
    n = F.length("source")
    runs = cls.select(
        F.col("source").alias("name"),
        F.when(n > 4, F.create_map(F.lit("model"), F.concat(F.lit("m-"), F.col("source"))))
        .otherwise(F.create_map(F.lit("seed"), F.lit("42"))).alias("config"),
        F.map_filter(
            F.create_map(*[x for m in ("accuracy", "precision", "recall", "f1") for x in (F.lit(m), F.col(m))]),
            lambda k, v: (k != "f1") | (v > 0),
        ).alias("summary"),
        F.concat(F.lit("runs/"), F.col("source")).alias("url"),
    )
    return evaluation.leaderboard(runs)


# --- scraped counters ---------------------------------------------------------------------------------------

def bucket_samples(spark, folder) -> tuple[DataFrame, list[str]]:
    names = [f"le_{i}" for i in range(len(monitoring.BOUNDS))]
    return inputs.scraped(spark, folder, dict(zip(names, monitoring._bucket_counts(F.col("latency_s"))))), names


def at_quantiles(windows: DataFrame, buckets: list[Column]) -> DataFrame:
    found = counters.bucket_quantiles(windows, buckets, monitoring.QUANTILES, ["model_name"])
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query
def counter_rate_5m(spark, folder):
    """Requests per second and mean latency of the last five minutes, every minute, from scraped counters."""
    log = {"requests": F.count(F.lit(1)), "latency_sum": F.sum("latency_s"), "latency_count": F.count("latency_s")}
    found = counters.windows(inputs.scraped(spark, folder, log), ["model_name"], list(log)).where("n > 1")
    mean = F.try_divide(counters.rate("latency_sum"), counters.rate("latency_count")) * 1000.0
    return found.select(
        F.col("at").cast("timestamp_ntz").alias("at"), "model_name", F.round(counters.rate("requests"), 9).alias("rate"),
        F.round(mean, 6).alias("avg_latency_ms"))


@query
def histogram_rate_quantile(spark, folder):
    """Latency quantiles of the last five minutes, every minute, from the rates of scraped histogram buckets."""
    samples, names = bucket_samples(spark, folder)
    found = counters.windows(samples, ["model_name"], names).where("n > 1")
    return at_quantiles(found, [counters.rate(name) for name in names])


@query
def histogram_latest_quantile(spark, folder):
    """Latency quantiles since the last restart, every minute, from the latest sample of the last five minutes."""
    samples, names = bucket_samples(spark, folder)
    found = counters.windows(samples, ["model_name"], names, totals=False)
    return at_quantiles(found, [F.col("last")[name] for name in names])


# --- streaming ----------------------------------------------------------------------------------------------

@query
def stream_detect(spark, folder):
    stream = inputs.prompts_from(jobs.table_stream(spark, folder, "documents", inputs.scan_parts(spark)))
    path = scratch_path(spark, "stream-detect")
    decided = detect.score_prompts(stream).select(*DECISION_COLUMNS)
    jobs.write_batches(decided, path, scratch_path(spark, "state"))
    return spark.read.parquet(path).select(*DECISION_COLUMNS)


@query
def stream_logs(spark, folder):
    stream = detect.score_prompts(inputs.prompts_from(jobs.table_stream(spark, folder, "documents", inputs.scan_parts(spark))))
    path = scratch_path(spark, "stream-logs")
    jobs.log_batches(stream, {
        "decisions": lambda df: logs.decision_log(df, total_ms(), details=False),
        "runs": lambda df: logs.model_run_log(df, times_ms()),
    }, path, scratch_path(spark, "state"))
    made = spark.read.parquet(f"{path}/runs").select("model_name", "detection_outcome").unionByName(
        spark.read.parquet(f"{path}/decisions").select("model_name", "detection_outcome")
    )
    return made.groupBy("model_name", "detection_outcome").agg(F.count(F.lit(1)).alias("n"))


def _event_stream(spark, folder):
    return inputs.model_events_from(jobs.table_stream(spark, folder, "events"))


@query
def stream_rates(spark, folder):
    path = scratch_path(spark, "stream-rates")
    jobs.write_batches(jobs.rates(_event_stream(spark, folder)), path, scratch_path(spark, "state"), "update")
    found = jobs.latest_per_window(spark, path, ["window_start", "model_name"])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_histogram(spark, folder):
    path = scratch_path(spark, "stream-histogram")
    jobs.write_batches(jobs.histogram(_event_stream(spark, folder)), path, scratch_path(spark, "state"), "update")
    found = jobs.latest_per_window(spark, path, ["window_start", "model_name"])
    cumulative = F.array(*[F.col(f"le_{i}") for i in range(len(monitoring.BOUNDS))])
    return found.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "model_name",
        *[F.round(monitoring.histogram_quantile(cumulative, q) * 1000.0, 6).alias(f"p{round(q * 100)}_ms")
          for q in monitoring.QUANTILES],
    )


@query
def stream_context(spark, folder):
    path = scratch_path(spark, "stream-context")
    turns = jobs.table_stream(spark, folder, "conversations")
    jobs.write_batches(jobs.context(turns), path, scratch_path(spark, "state"), "update")
    return jobs.latest_per_window(spark, path, ["conv_id", "slot"])


@query
def stream_dedup(spark, folder):
    path = scratch_path(spark, "stream-dedup")
    stream = jobs.table_stream(spark, folder, "documents").select(
        F.col("text").alias("prompt"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts")
    )
    jobs.write_batches(jobs.dedup(stream).select("prompt"), path, scratch_path(spark, "state"))
    return spark.read.parquet(path).select("prompt")


LATE = "6 days"


@query
def stream_rates_late(spark, folder):
    """Rates of a stream with late rows: what comes after the watermark has passed a window is left out of it."""
    path = scratch_path(spark, "rates-late")
    late.replay([inputs.late_events(spark, folder)], inputs.SLICES + 1, lambda s: jobs.rates(s, watermark=LATE), path, "update")
    found = jobs.latest_per_window(spark, path, ["window_start", "model_name"])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_histogram_late(spark, folder):
    path = scratch_path(spark, "histogram-late")
    late.replay([inputs.late_events(spark, folder)], inputs.SLICES + 1, lambda s: jobs.histogram(s, watermark=LATE), path, "update")
    found = jobs.latest_per_window(spark, path, ["window_start", "model_name"])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_dedup_late(spark, folder):
    """Prompts that were not seen within two hours before, from a stream in slices."""
    path = scratch_path(spark, "dedup-late")

    def first(stream):
        return stream.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["digest"]).select("digest", "prompt_id")

    late.replay([inputs.late_prompts(spark, folder)], inputs.SLICES, first, path)
    return spark.read.parquet(path).select("digest", "prompt_id")


@query
def stream_context_expiring(spark, folder):
    """Contexts of conversations that go on, and those that ended an hour after their last turn."""
    path = scratch_path(spark, "context-expiring")
    with late.rocksdb(spark):
        late.replay([inputs.paused_turns(spark, folder)], inputs.SLICES, late.expiring_context, path, "update")
    return late.open_contexts(spark.read.parquet(path))


@query
def stream_join_outputs(spark, folder):
    """Prompts with the model output that came within ten minutes, as two streams."""
    path = scratch_path(spark, "join-outputs")
    late.replay(list(inputs.prompts_and_outputs(spark, folder)), inputs.SLICES + 1, late.joined_outputs, path)
    found = spark.read.parquet(path).where("prompt_id >= 0")
    return found.select("prompt_id", F.col("output_ts").cast("timestamp_ntz").alias("output_ts"), "label", "score")
