"""DuckDB SQL for the registered queries, over views named like the given tables.

The statements are put together from the same fixed word lists, but spell every rule out one by one instead of using
the engine's grouped evaluation, so that they check it.
"""

from __future__ import annotations

from wardlight import fixed_values as V
from wardlight.plans.inputs import EVENT_MODELS, OTHER_MODEL, PHRASES, STOP_WORDS
from wardlight.plans.queries import AS_OF, OWN_PATTERNS, TIME_SHARES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def any_of(words) -> str:
    return "(" + " OR ".join(f"contains(l, {text(w)})" for w in words) + ")"


def any_match(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(l, {text(p)})" for p in patterns) + ")"


def count_of(words) -> str:
    return "(" + " + ".join(f"contains(l, {text(w)})::BIGINT" for w in words) + ")" if words else "0::BIGINT"


def count_match(patterns) -> str:
    return "(" + " + ".join(f"regexp_matches(l, {text(p)})::BIGINT" for p in patterns) + ")"


HIGH = [w for w in V.LITERALS if w in V.HIGH_RISK and w not in V.DOWN_WEIGHTED]
PLAIN = [w for w in V.LITERALS if w not in V.HIGH_RISK]
TIER = f"""CASE WHEN {any_of(V.MEDICAL_CONTEXT)} THEN 3
  WHEN {any_of(V.DISPOSAL_CONTEXT)} AND {any_of(V.DISPOSAL_WORDS)} THEN 8
  WHEN {any_of(V.RANGE_CONTEXT)} AND {any_of(V.RANGE_WORDS)} THEN 6
  WHEN {any_of(V.SAFE_CONTEXT)} THEN 15 ELSE 30 END"""

PROMPTS = f"""docs AS (SELECT doc_id AS prompt_id,
    text || ' ' || ({texts(PHRASES)})[doc_id % {len(PHRASES)} + 1] AS prompt,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts, n_chars::DOUBLE / 2000e0 AS latency_s,
    CASE WHEN doc_id % 11 = 0 THEN 'toxic' ELSE 'non-toxic' END AS t_label,
    6e-1 + 4e-1 * (((doc_id * 37) % 101)::DOUBLE / 101e0) AS t_score,
    CASE WHEN doc_id % 13 = 0 THEN 'toxic' ELSE 'non-toxic' END AS h_label,
    6e-1 + 4e-1 * (((doc_id * 53) % 97)::DOUBLE / 97e0) AS h_score,
    CASE WHEN doc_id % 2 = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS s_label,
    5e-1 + 5e-1 * (((doc_id * 29) % 89)::DOUBLE / 89e0) AS s_score
  FROM documents),
low AS (SELECT *, lower(prompt) AS l FROM docs)"""

COUNTS = PROMPTS + f""",
hits AS (SELECT *, {count_of(HIGH)} AS n_high, {count_of(PLAIN)} AS n_plain, {count_of(V.DOWN_WEIGHTED)} AS n_down,
    {count_match(V.PATTERNS)} AS n_pattern, {TIER} AS tier10, {any_of(V.SAFE_CONTEXT)} AS is_safe FROM low),
points AS (SELECT *, (n_pattern * tier10 + 20 * n_high + 10 * n_plain
    + n_down * CASE WHEN is_safe THEN 5 ELSE 20 END)::BIGINT AS points10 FROM hits),
keyed AS (SELECT *, (CASE WHEN points10 = 0 THEN 0 WHEN points10 <= 10 THEN 40 * points10
    WHEN points10 <= 20 THEN 25 * points10 WHEN points10 <= 30 THEN 500 + 15 * (points10 - 20)
    ELSE least(650 + 10 * (points10 - 30), 1000) END)::DOUBLE / 1000e0 AS keyword_score FROM points)"""

TOXIC = f"""CASE WHEN upper(t_label) = 'TOXIC' THEN
    CASE WHEN {any_of(V.TOXIC_WORDS)} AND t_score > 1e-2 THEN least(t_score * 8e0, 9e-1) ELSE t_score END
  WHEN {any_match(V.TOXIC_PATTERNS)} THEN greatest(1e0 - t_score, 6e-1) ELSE 1e0 - t_score END"""
HATE = f"""CASE WHEN upper(h_label) = 'TOXIC' THEN
    CASE WHEN {any_of(V.HATE_WORDS)} AND h_score > 1e-1 THEN least(h_score * 3e0, 9e-1) ELSE h_score END
  WHEN {any_match(V.HATE_PATTERNS)} THEN greatest(1e0 - h_score, 5e-1) ELSE 1e0 - h_score END"""
SAFETY = f"""CASE WHEN {any_match(V.SAFETY_PATTERNS)} THEN 8e-1
  WHEN upper(s_label) = 'NEGATIVE' THEN
    CASE WHEN {any_of(V.SAFETY_ATTACK_WORDS)} AND s_score > 8e-1 THEN least(s_score * 7e-1, 8e-1)
      WHEN {any_of(V.SAFETY_NEGATIVE_WORDS)} AND s_score > 5e-1 THEN least(s_score * 5e-1, 6e-1)
      WHEN s_score > 9e-1 THEN least(s_score * 3e-1, 4e-1) ELSE least(s_score * 1e-1, 2e-1) END
  ELSE CASE WHEN {any_of(V.SAFETY_POSITIVE_WORDS)} THEN least((1e0 - s_score) * 3e-1, 3e-1)
      ELSE least((1e0 - s_score) * 5e-2, 1e-1) END END"""


def modes_values() -> str:
    rows = []
    for name, (high, weak, count, majority, weighted, weights) in V.MODES.items():
        numbers = ", ".join(f"{x!r}::DOUBLE" for x in (high, weak, majority, weighted, *weights))
        rows.append(f"({text(name)}, {count}, {numbers})")
    return ("modes(m, c, high_confidence_threshold, weak_signals_threshold, majority_threshold, weighted_threshold,"
            " w0, w1, w2, w3) AS (VALUES " + ", ".join(rows) + ")")


VOTE = """CASE WHEN keyword_score > high_confidence_threshold OR toxic_score > 6e-1 OR hate_score > 5e-1
    OR safety_score > high_confidence_threshold THEN 'high_confidence_trigger'
  WHEN (keyword_score > weak_signals_threshold)::INT + (toxic_score > weak_signals_threshold)::INT
    + (hate_score > weak_signals_threshold)::INT + (safety_score > weak_signals_threshold)::INT >= c
    THEN 'weak_signals_trigger'
  WHEN (keyword_score > 5e-1)::INT + (toxic_score > 5e-1)::INT + (hate_score > 5e-1)::INT
    + (safety_score > 5e-1)::INT >= 2 THEN 'majority_consensus'
  WHEN weighted > weighted_threshold THEN 'weighted_ensemble' ELSE 'none' END"""
REASON = f"""CASE mechanism WHEN 'high_confidence_trigger' THEN {text(V.REASON_HIGH_CONFIDENCE)}
  WHEN 'weak_signals_trigger' THEN {text(V.REASON_WEAK_SIGNALS)} WHEN 'majority_consensus' THEN {text(V.REASON_MAJORITY)}
  WHEN 'weighted_ensemble' THEN printf({text(V.REASON_WEIGHTED)}, weighted) ELSE {text(V.REASON_SAFE)} END"""
WEIGHTED = "((keyword_score * w0 + toxic_score * w1) + hate_score * w2) + safety_score * w3"


def decided(mode: str | None = "balanced", failed: str = "FALSE", exit_text: str = V.REASON_EARLY_EXIT,
            early: str = "'high_confidence_trigger'") -> str:
    """CTEs up to ``final``: one row per prompt (and per mode when ``mode`` is None)."""
    join = "" if mode is None else f" AND m = {text(mode)}"
    return COUNTS + f""",
{modes_values()},
flags AS (SELECT *, keyword_score > 45e-2 AS early_exit, ({failed}) AND NOT keyword_score > 45e-2 AS error FROM keyed),
adjusted AS (SELECT *, CASE WHEN early_exit OR error THEN 0e0 ELSE {TOXIC} END AS toxic_score,
    CASE WHEN early_exit OR error THEN 0e0 ELSE {HATE} END AS hate_score,
    CASE WHEN early_exit OR error THEN 0e0 ELSE {SAFETY} END AS safety_score FROM flags),
weighed AS (SELECT *, {WEIGHTED} AS weighted FROM adjusted JOIN modes ON TRUE{join}),
voted AS (SELECT *, {VOTE} AS mechanism FROM weighed),
final AS (SELECT * EXCLUDE (mechanism), mechanism AS layer,
    CASE WHEN early_exit THEN TRUE WHEN error THEN keyword_score > 3e-1 ELSE mechanism <> 'none' END AS is_adversarial,
    CASE WHEN early_exit THEN {text(exit_text)} WHEN error THEN {text(V.REASON_ERROR + "model failure")}
      ELSE {REASON} END AS reason,
    5e-1 AS threshold,
    CASE WHEN early_exit THEN {early} WHEN error THEN 'error' ELSE mechanism END AS winning_mechanism FROM voted)"""


DECISION = ("prompt_id, keyword_score, toxic_score, hate_score, safety_score, early_exit, is_adversarial, reason, "
            "threshold, winning_mechanism")
HASH = "('0x' || substr(md5(prompt), 1, 8))::BIGINT % 10000"
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
NAME_STAMP = "strftime(ts, '%Y-%m-%d_%H-%M-%S')"


def run_log(base: str | None = None) -> str:
    """CTEs up to ``runs``: long model-run log."""
    branches = []
    for i, (model, short) in enumerate(zip(V.MODELS, V.SCORE_NAMES)):
        limit = "45e-2" if i == 0 else "5e-1"
        where = "" if i == 0 else "WHERE NOT early_exit AND NOT error"
        branches.append(
            f"SELECT prompt_id, ts, prompt, {text(model)} AS model_name, {short}_score AS score, "
            f"latency_s * 1000e0 * {TIME_SHARES[short]!r}::DOUBLE AS inference_time_ms, "
            f"{short}_score > {limit} AS adversarial FROM final {where}"
        )
    return (base or decided()) + ",\nlong AS (" + " UNION ALL ".join(branches) + f"""),
runs AS (SELECT prompt_id, ts, model_name || '_' || {NAME_STAMP} AS run_name, model_name, {STAMP} AS "timestamp",
    adversarial, length(prompt) AS input_length, {HASH} AS input_hash, substr(prompt, 1, 500) AS prompt,
    'balanced' AS sensitivity_mode,
    CASE WHEN model_name = 'keyword_detector' THEN 'rule_based' ELSE 'ml_model' END AS detection_type,
    CASE WHEN model_name = 'keyword_detector' THEN {len(V.LITERALS)}::BIGINT END AS pattern_count,
    CASE WHEN model_name <> 'keyword_detector' THEN 'cpu' END AS device, score, inference_time_ms,
    5e-1 AS threshold, (score > 5e-1)::INT AS above_threshold, 'individual' AS model_type,
    CASE WHEN adversarial THEN 'adversarial' ELSE 'safe' END AS detection_outcome,
    split_part(model_name, '_', 1) AS model_category FROM long)"""


def decision_log(base: str | None = None) -> str:
    """CTEs up to ``decisions``."""
    layers = ["high_confidence_trigger", "weak_signals_trigger", "majority_consensus", "weighted_ensemble"]
    voting = []
    for name in layers:
        first = "WHEN early_exit THEN 1 " if name == layers[0] else ""
        voting.append(f"CASE {first}WHEN early_exit OR error THEN NULL ELSE (layer = '{name}')::INT END AS voting_{name}")
    scores = ", ".join(f"{m}_score" for m in V.SCORE_NAMES)
    above = ", ".join(f"({m}_score > 5e-1)::INT AS {m}_above_threshold" for m in V.SCORE_NAMES)
    return (base or decided()) + f""",
decisions AS (SELECT prompt_id, ts, 'ensemble_decision_' || {NAME_STAMP} AS run_name,
    '{V.ENSEMBLE_MODEL}' AS model_name, {STAMP} AS "timestamp", is_adversarial AS adversarial,
    length(prompt) AS input_length, {HASH} AS input_hash, substr(prompt, 1, 500) AS prompt, m AS sensitivity_mode,
    latency_s * 1000e0 AS total_inference_time_ms, greatest({scores}) AS max_individual_score,
    reason AS decision_reason, early_exit::INT AS early_exit, {scores}, {above}, {", ".join(voting)},
    CASE WHEN early_exit THEN 1 END AS voting_early_exit, CASE WHEN error THEN 1 END AS voting_error,
    CASE WHEN error THEN 1 END AS voting_fallback, winning_mechanism, high_confidence_threshold,
    weak_signals_threshold, majority_threshold, weighted_threshold, 'ensemble' AS model_type,
    CASE WHEN is_adversarial THEN 'adversarial' ELSE 'safe' END AS detection_outcome,
    CASE WHEN early_exit THEN 'early_exit' ELSE 'full_ensemble' END AS decision_type FROM final)"""


GRID = """grid AS (SELECT event_id AS prompt_id, ((event_id * 7 + event_id) % 41)::DOUBLE / CASE WHEN event_id % 2 = 0 THEN 40e0 ELSE 80e0 END AS keyword_score,
    (((event_id // 5) * 7 + event_id) % 41)::DOUBLE / CASE WHEN event_id % 2 = 0 THEN 40e0 ELSE 80e0 END AS toxic_score,
    (((event_id // 11) * 7 + event_id) % 41)::DOUBLE / CASE WHEN event_id % 2 = 0 THEN 40e0 ELSE 80e0 END AS hate_score,
    (((event_id // 23) * 7 + event_id) % 41)::DOUBLE / CASE WHEN event_id % 2 = 0 THEN 40e0 ELSE 80e0 END AS safety_score,
    (['high', 'conservative', 'balanced', 'other'])[event_id % 4 + 1] AS mode FROM events)"""
GRID_VOTE = GRID + f""",
{modes_values()},
weighed AS (SELECT *, {WEIGHTED} AS weighted FROM grid
    JOIN modes ON m = CASE WHEN mode IN ('high', 'conservative') THEN mode ELSE 'balanced' END),
voted AS (SELECT *, {VOTE} AS mechanism FROM weighed)"""

LABELLED = """labelled AS (SELECT d.doc_id AS row_id, d.text AS prompt, CASE WHEN toxic = 1 THEN 'adversarial'
    WHEN d.doc_id % 2 = 1 THEN 'safe' ELSE 'benign' END AS label FROM documents d JOIN labels USING (doc_id))"""
RELABELLED = LABELLED + """,
relabelled AS (SELECT row_id, prompt, CASE label WHEN 'safe' THEN 'benign' ELSE label END AS label FROM labelled)"""
CLEAN = RELABELLED + """,
clean AS (SELECT row_id, prompt, label FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY row_id) AS rn
    FROM relabelled) WHERE rn = 1)"""
SPLIT = CLEAN + """,
keyed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(prompt || '|' || row_id::VARCHAR || '|42'), row_id)
    AS rn, count(*) OVER (PARTITION BY label) AS n FROM clean),
split AS (SELECT row_id, label, CASE WHEN rn <= round(2e-1 * n) THEN 'test' ELSE 'train' END AS split FROM keyed)"""

MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_MODELS.items()) + f" ELSE '{OTHER_MODEL}' END"
EVENTS = f"ev AS (SELECT event_id, ts, {MODEL} AS model_name, value / 20e0 AS latency_s, event_type FROM events)"
BOUNDS = ", ".join(
    f"({i}, {lo!r}::DOUBLE, {'CAST(' + chr(39) + 'Infinity' + chr(39) + ' AS DOUBLE)' if hi == float('inf') else repr(hi) + '::DOUBLE'},"
    f" '{'+Inf' if hi == float('inf') else format(hi, 'g')}')"
    for i, (lo, hi) in enumerate(zip([0.0] + V.LATENCY_BUCKETS[:-1], V.LATENCY_BUCKETS))
)
BUCKETS = f"buckets(i, lo, hi, le) AS (VALUES {BOUNDS})"


def quantile(groups: str, source: str, q: float) -> str:
    """Quantile subquery of a bucketed source with columns (groups, i, lo, hi, cum, total)."""
    g = groups
    return f"""(SELECT {g}, CASE WHEN hi = CAST('Infinity' AS DOUBLE) THEN lo
      ELSE lo + (hi - lo) * ({q!r}::DOUBLE * total - prev) / (cum - prev) END * 1000e0 AS v
    FROM (SELECT *, coalesce(lag(cum) OVER (PARTITION BY {g} ORDER BY i), 0) AS prev FROM {source})
    WHERE cum >= {q!r}::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY i) = 1)"""


SLIDING = EVENTS + """,
wide AS (SELECT unnest(generate_series(date_trunc('minute', ts) - INTERVAL 4 MINUTE, date_trunc('minute', ts),
    INTERVAL 1 MINUTE)) AS window_start, model_name, latency_s FROM ev)"""

TOKENS = "regexp_extract_all(lower(prompt), '[\\p{L}\\p{N}_]{2,}')"


def grams(source: str, longest: int, stop: list[str] | None = None) -> str:
    kept = f"list_filter({TOKENS}, lambda x: NOT list_contains({texts(stop)}, x))" if stop else TOKENS
    parts = [
        f"SELECT row_id, label, array_to_string(t[i:i + {k - 1}], ' ') AS gram FROM (SELECT row_id, label, t, "
        f"unnest(generate_series(1, len(t) - {k - 1})) AS i FROM tokens)"
        for k in range(1, longest + 1)
    ]
    return f"tokens AS (SELECT row_id, label, {kept} AS t FROM {source}), grams AS (" + " UNION ALL ".join(parts) + ")"


EVALUATION = """rows AS (SELECT d.doc_id AS row_id, lang, source, toxic::INT AS y, (n_chars % 53)::DOUBLE / 10e0 AS logit0,
    (n_chars % 61)::DOUBLE / 10e0 AS logit1, (n_chars % 97)::DOUBLE / 97e0 AS p FROM documents d JOIN labels USING (doc_id)),
guessed AS (SELECT *, CASE WHEN logit1 > logit0 THEN 1 ELSE 0 END AS predicted FROM rows)"""
CURVE = EVALUATION + """,
cum AS (SELECT p AS threshold, sum(sum(y)) OVER (ORDER BY p DESC) AS tp, sum(count(*)) OVER (ORDER BY p DESC) AS n
    FROM rows GROUP BY p),
curve AS (SELECT threshold, tp::DOUBLE / n::DOUBLE AS "precision", tp::DOUBLE / (SELECT sum(y) FROM rows)::DOUBLE AS recall
    FROM cum),
rated AS (SELECT *, 2e0 * "precision" * recall / (("precision" + recall) + 1e-12) AS f1 FROM curve),
best AS (SELECT * FROM rated ORDER BY f1 DESC, threshold LIMIT 1)"""


def metrics(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}accuracy, "precision", recall, CASE WHEN "precision" + recall > 0
      THEN 2e0 * "precision" * recall / ("precision" + recall) ELSE 0e0 END AS f1 FROM (
    SELECT {keys}CASE WHEN n > 0 THEN (tp + tn)::DOUBLE / n ELSE 0e0 END AS accuracy,
      CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0e0 END AS "precision",
      CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0e0 END AS recall FROM (
    SELECT {keys}count(*) AS n, count(*) FILTER (y = 1 AND predicted = 1) AS tp,
      count(*) FILTER (y <> 1 AND predicted = 1) AS fp, count(*) FILTER (y = 1 AND predicted <> 1) AS fn,
      count(*) FILTER (y <> 1 AND predicted <> 1) AS tn FROM {source} {group}))"""


OUTPUTS = """lens AS (SELECT doc_id AS prompt_id, text AS prompt, n_chars AS n,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts, n_chars::DOUBLE / 2000e0 AS latency_s FROM documents),
outs AS (SELECT *, (n % 83)::DOUBLE / 83e0 AS electra_small,
    CASE WHEN n % 7 <> 0 THEN ((n % 41)::DOUBLE / 41e0 * 4e-1 + (n % 29)::DOUBLE / 29e0 * 3e-1)
      + (n % 31)::DOUBLE / 31e0 * 1e-1 ELSE 0e0 END AS tox_bert,
    (n % 59)::DOUBLE / 59e0 * 6e-1 AS offensive_roberta,
    CASE WHEN n % 5 <> 0 THEN (n % 71)::DOUBLE / 71e0 * 5e-1 ELSE 0e0 END AS bart_mnli FROM lens)"""


def legacy_vote(a: str, b: str, c: str, d: str) -> str:
    votes = f"(({a} > 5e-1)::INT + ({b} > 4e-1)::INT + ({c} > 4e-1)::INT + ({d} > 4e-1)::INT)"
    sure = f"CASE WHEN {b} > 5e-1 THEN 1 WHEN {c} > 5e-1 THEN 2 WHEN {d} > 5e-1 THEN 3 ELSE 0 END"
    return f"""{sure} > 0 OR {votes} > 1 AS is_adversarial,
    CASE WHEN {sure} > 0 THEN 'Model ' || ({sure})::VARCHAR || ' exceeded threshold confidently.'
      WHEN {votes} > 1 THEN {text(V.LEGACY_REASON_MAJORITY)} ELSE {text(V.LEGACY_REASON_NONE)} END AS reason,
    {a} > 5e-1 AS electra_vote, (CASE WHEN {sure} > 0 THEN 0 ELSE {votes} END)::BIGINT AS model_agreement,
    greatest({a}, {b}, {c}, {d}) AS confidence_score"""


LEGACY = OUTPUTS + f", legacy AS (SELECT *, {legacy_vote(*V.LEGACY_MODELS)} FROM outs)"


def legacy_log() -> str:
    parts = [
        f"SELECT prompt_id, ts, prompt, '{m}' AS model_name, '{V.LEGACY_VERSIONS[m]}' AS model_version, "
        f"{m} AS detection_score, {m} > 5e-1 AS is_adversarial, latency_s AS latency, NULL::VARCHAR AS reasoning, "
        f"NULL::BIGINT AS model_agreement, '{V.LEGACY_TASKS[m][0]}' AS model_type, '{V.LEGACY_TASKS[m][1]}' AS task FROM legacy"
        for m in V.LEGACY_MODELS
    ]
    parts.append(
        "SELECT prompt_id, ts, prompt, 'ensemble_decision', 'voting_classifier', confidence_score, is_adversarial, "
        "NULL::DOUBLE, reason, model_agreement, 'ensemble', 'final_classification' FROM legacy"
    )
    return "WITH " + LEGACY + ", long AS (" + " UNION ALL ".join(parts) + """)
SELECT prompt_id, model_name || '_' || epoch(ts)::BIGINT::VARCHAR AS run_name, substr(prompt, 1, 100) AS prompt,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", model_name, model_version, detection_score, is_adversarial, latency,
  reasoning, model_agreement, model_type, task FROM long"""


def counters() -> str:
    parts = [
        "SELECT 'chat_requests_total' AS metric, NULL::VARCHAR AS model_name, NULL::VARCHAR AS kind FROM final",
        "SELECT 'adversarial_detections_total', CASE WHEN error THEN 'fallback_detector' ELSE 'fast_ensemble' END, NULL "
        "FROM final WHERE is_adversarial",
        "SELECT 'safe_prompts_total', NULL, NULL FROM final WHERE NOT is_adversarial",
        "SELECT 'model_inference_errors_total', 'fast_detector', 'detection_failure' FROM final WHERE error",
    ]
    for model, short in zip(V.COUNTER_MODELS, V.SCORE_NAMES):
        parts.append(f"SELECT 'model_inference_total', '{model}', 'fast_detector' FROM final")
        parts.append(f"SELECT 'adversarial_detections_total', '{model}', NULL FROM final WHERE {short}_score > 5e-1")
    return "WITH " + decided(failed="prompt_id % 7 = 0") + ", ticks AS (" + " UNION ALL ".join(parts) + (
        ") SELECT metric, model_name, kind, count(*) AS n FROM ticks GROUP BY ALL")


def chat_flat() -> str:
    head, tail = (text(x) for x in V.PASSED_REPLY.split("%s"))
    parts = [f"SELECT *, {i}::INT AS score_index, {m}_score AS score FROM final" for i, m in enumerate(V.SCORE_NAMES)]
    return "WITH " + decided() + ", long AS (" + " UNION ALL ".join(parts) + f""")
SELECT prompt_id, ts AS "timestamp", CASE WHEN prompt_id % 50 <> 0 THEN 's' || (prompt_id % 200)::VARCHAR END AS session_id,
  prompt, CASE WHEN is_adversarial THEN {text(V.BLOCKED_REPLY)} ELSE {head} || prompt || {tail} END AS bot_response,
  is_adversarial, score_index, score, reason, threshold, latency_s AS latency_seconds, 4::INT AS model_count,
  'web_interface' AS user_agent, 'US/Pacific' AS timezone FROM long"""


def perf_log() -> str:
    parts = [f"SELECT *, '{n}' AS model_name, {m}_score AS adversarial_score FROM final"
             for n, m in zip(V.COUNTER_MODELS, V.SCORE_NAMES)]
    return "WITH " + decided() + ", long AS (" + " UNION ALL ".join(parts) + f""")
SELECT prompt_id, ts AS "timestamp", model_name, latency_s AS inference_time_seconds, adversarial_score,
  length(prompt) AS input_length, {HASH} AS input_hash, 'US/Pacific' AS timezone FROM long"""


def sliding_quantiles() -> str:
    qs = [(0.5, "p50_ms"), (0.75, "p75_ms"), (0.9, "p90_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")]
    joins = " ".join(
        f"JOIN {quantile('window_start, model_name', 'hist', q)} AS {n} USING (window_start, model_name)" for q, n in qs
    )
    shown = ", ".join(f"round({n}.v, 6) AS {n}" for _, n in qs)
    return f"""WITH {SLIDING}, {BUCKETS},
hist AS (SELECT window_start, model_name, i, lo, hi, count(*) FILTER (latency_s <= hi) AS cum, count(*) AS total
    FROM wide, buckets GROUP BY ALL),
keys AS (SELECT DISTINCT window_start, model_name FROM hist)
SELECT window_start, model_name, {shown} FROM keys {joins}"""


def own_rules() -> str:
    """The caller's vocabulary of the query, rule by rule."""
    return f"""WITH low AS (SELECT doc_id AS prompt_id, lower(text) AS l FROM documents),
hits AS (SELECT prompt_id, {count_of(["stupid"])} AS n_high, {count_of(["the th"])} AS n_plain, {count_of(["zz"])} AS n_down,
  {count_match(OWN_PATTERNS)} AS n_pattern, contains(l, 'from') AS is_safe,
  CASE WHEN contains(l, 'license') THEN 3 WHEN contains(l, 're') AND contains(l, 'ing') THEN 8
    WHEN contains(l, 'und') AND contains(l, 'der') THEN 6 WHEN contains(l, 'from') THEN 15 ELSE 30 END AS tier10 FROM low),
points AS (SELECT prompt_id, n_high, n_plain, n_down, n_pattern, (n_pattern * tier10 + 20 * n_high + 10 * n_plain
    + n_down * CASE WHEN is_safe THEN 5 ELSE 20 END)::BIGINT AS points10 FROM hits)
SELECT *, (CASE WHEN points10 = 0 THEN 0 WHEN points10 <= 10 THEN 40 * points10
    WHEN points10 <= 20 THEN 25 * points10 WHEN points10 <= 30 THEN 500 + 15 * (points10 - 20)
    ELSE least(650 + 10 * (points10 - 30), 1000) END)::DOUBLE / 1000e0 AS keyword_score FROM points"""


NEAR_OVERLAP = r"""WITH w AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS is_test,
         regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\x0b\f\r]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, is_test, array_to_string(words[i:i + 4], ' ') AS h
  FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, is_test, count(*) AS n FROM s GROUP BY ALL),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.is_test AND NOT b.is_test
  GROUP BY ALL),
f AS (
  SELECT DISTINCT a FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common))
SELECT w.doc_id AS row_id, coalesce(n.n, 0)::BIGINT AS n_shingles, w.doc_id IN (SELECT a FROM f) AS leaked
FROM w LEFT JOIN n ON n.doc_id = w.doc_id WHERE w.is_test"""

NEAR_OVERLAP_BEST = NEAR_OVERLAP.split("f AS (")[0] + """f AS (
  SELECT a, b, common::DOUBLE / (x.n + y.n - common) AS similarity FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common) QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) = 1)
SELECT w.doc_id AS row_id, coalesce(n.n, 0)::BIGINT AS n_shingles, f.b AS "match", f.similarity
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN f ON f.a = w.doc_id WHERE w.is_test"""


def stream_rates() -> str:
    return f"""WITH {SLIDING} SELECT window_start, model_name, count(*) AS n, count(*)::DOUBLE / 300e0 AS rate,
  round(sum(latency_s) / count(*) * 1000e0, 6) AS avg_latency_ms FROM wide GROUP BY ALL"""


def scraped(counters: dict[str, str]) -> str:
    """Samples ``smp`` of running totals that restart every day, read every minute with some readings missing."""
    sums = ", ".join(f"{c}::DOUBLE AS {n}" for n, c in counters.items())
    idle = ", ".join(f"0e0 AS {n}" for n in counters)
    added = ", ".join(f"sum({n}) AS {n}" for n in counters)
    upto = ", ".join(f"round(sum({n}) OVER (PARTITION BY model_name, day ORDER BY ts), 6) AS {n}" for n in counters)
    return f"""{EVENTS},
each AS (SELECT model_name, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS ts, {sums}
  FROM ev GROUP BY 1, 2, 3),
idle AS (SELECT model_name, day, unnest(generate_series(day + INTERVAL 1 MINUTE, day + INTERVAL 1 DAY, INTERVAL 1 MINUTE)) AS ts, {idle}
  FROM (SELECT DISTINCT model_name, day FROM each)),
reading AS (SELECT model_name, day, ts, {added} FROM (SELECT * FROM each UNION ALL SELECT * FROM idle) GROUP BY ALL),
smp AS (SELECT * FROM (SELECT model_name, ts, {upto}, epoch(ts)::BIGINT // 60 AS number FROM reading)
  WHERE number % 31 <> 7 AND NOT number % 97 BETWEEN 11 AND 16)"""


def scraped_windows(counters: dict[str, str]) -> str:
    """Windows ``win`` of the last five minutes at every minute: n, first and last sample, increases; ``gap`` has what to extend by."""
    before = ", ".join(f"lag({n}) OVER s AS b_{n}" for n in counters)
    total = ", ".join(f"{n} + coalesce(sum(CASE WHEN {n} < b_{n} THEN b_{n} ELSE 0e0 END) OVER s, 0e0) AS t_{n}" for n in counters)
    ends = ", ".join(f"arg_min({n}, ts) AS f_{n}, arg_max({n}, ts) AS l_{n}, arg_max(t_{n}, ts) - arg_min(t_{n}, ts) AS i_{n}" for n in counters)
    rates = ", ".join(
        f"""CASE WHEN n > 1 THEN i_{n} * ((span + CASE WHEN i_{n} > 0 AND f_{n} >= 0 AND span * (f_{n} / i_{n}) < to_start
          THEN span * (f_{n} / i_{n}) ELSE to_start END + to_end) / span) / 300e0 END AS r_{n}""" for n in counters)
    return f"""{scraped(counters)},
prev AS (SELECT *, {before} FROM smp WINDOW s AS (PARTITION BY model_name ORDER BY ts)),
tot AS (SELECT *, {total} FROM prev WINDOW s AS (PARTITION BY model_name ORDER BY ts)),
wide_smp AS (SELECT *, ts + to_minutes(i) AS "at" FROM tot, range(5) AS r(i)),
win AS (SELECT model_name, "at", count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, {ends} FROM wide_smp GROUP BY 1, 2),
span AS (SELECT *, epoch(last_ts - first_ts)::DOUBLE AS span, 300e0 - epoch("at" - first_ts)::DOUBLE AS s0, epoch("at" - last_ts)::DOUBLE AS e0
  FROM win),
gap AS (SELECT *, CASE WHEN s0 >= span / (n - 1) * 1.1::DOUBLE THEN span / (n - 1) / 2 ELSE s0 END AS to_start,
  CASE WHEN e0 >= span / (n - 1) * 1.1::DOUBLE THEN span / (n - 1) / 2 ELSE e0 END AS to_end FROM span WHERE n > 1),
rated AS (SELECT model_name, "at", {rates} FROM gap)"""


LE = {f"le_{i}": f"count(*) FILTER (latency_s <= {'CAST(' + chr(39) + 'Infinity' + chr(39) + ' AS DOUBLE)' if b == float('inf') else repr(b) + '::DOUBLE'})"
      for i, b in enumerate(V.LATENCY_BUCKETS)}


def scraped_quantiles(source: str, prefix: str) -> str:
    """Quantiles of the cumulative buckets ``prefix`` + name of ``source``."""
    n = len(LE)
    level = ", ".join(f"greatest({', '.join(f'{prefix}le_{j}' for j in range(i + 1))}) AS c_{i}" for i in range(n))
    lows, highs = [0.0, *V.LATENCY_BUCKETS[:-1]], V.LATENCY_BUCKETS

    def quantile(q: float) -> str:
        rank = f"c_{n - 1} * {q!r}::DOUBLE"
        cases = " ".join(
            f"WHEN c_{i} >= {rank} THEN " + (f"{lows[i]!r}::DOUBLE" if i == n - 1 else
            f"{lows[i]!r}::DOUBLE + ({highs[i]!r}::DOUBLE - {lows[i]!r}::DOUBLE) * ({rank} - {f'c_{i - 1}' if i else '0'}) / (c_{i} - {f'c_{i - 1}' if i else '0'})")
            for i in range(n))
        return f"CASE WHEN c_{n - 1} > 0 THEN round((CASE {cases} END) * 1000e0, 6) END AS p{round(q * 100)}_ms"

    shown = ", ".join(quantile(q) for q in (0.5, 0.75, 0.9, 0.95, 0.99))
    return f"""lev AS (SELECT model_name, "at", {level} FROM {source}) SELECT "at", model_name, {shown} FROM lev"""


def counter_rate() -> str:
    log = {"requests": "count(*)", "latency_sum": "sum(latency_s)", "latency_count": "count(latency_s)"}
    return f"""WITH {scraped_windows(log)} SELECT "at", model_name, round(r_requests, 9) AS rate,
      round(r_latency_sum / nullif(r_latency_count, 0e0) * 1000e0, 6) AS avg_latency_ms FROM rated"""


LATE = f"""{EVENTS},
arr AS (SELECT *, least(date_diff('day', TIMESTAMP '2024-01-01', ts) // 8 + CASE WHEN event_id % 10 = 3 THEN 1
  WHEN event_id % 50 = 7 THEN 2 ELSE 0 END, 4) AS slice FROM ev),
newest AS (SELECT slice, max(date_trunc('milliseconds', ts)) AS newest FROM arr GROUP BY 1),
mark AS (SELECT a.slice, max(n.newest) - INTERVAL 6 DAY AS w FROM newest a LEFT JOIN newest n ON n.slice < a.slice GROUP BY 1),
wide AS (SELECT arr.*, date_trunc('minute', ts) - to_minutes(i) AS window_start FROM arr, range(5) AS r(i)),
kept AS (SELECT wide.* FROM wide JOIN mark USING (slice) WHERE w IS NULL OR window_start + INTERVAL 5 MINUTE > w)"""


def dedup_late(slices: int = 4) -> str:
    """A slice's rows against the texts seen before it whose two hours are not over by the watermark."""
    parts = [f"""d AS (SELECT sha256(coalesce(text, '')) AS digest, doc_id AS prompt_id,
  (doc_id * {slices} // ((SELECT max(doc_id) FROM documents) + 1))::INT AS slice FROM documents),
f AS (SELECT digest, slice, min(prompt_id) AS prompt_id, to_timestamp(1704067200 + min(prompt_id) * 60) AS ts FROM d GROUP BY 1, 2),
s0 AS (SELECT ''::VARCHAR AS digest, TIMESTAMPTZ '1970-01-01' AS until WHERE false)"""]
    for i in range(slices):
        mark = f"coalesce((SELECT max(ts) - INTERVAL 2 HOUR FROM f WHERE slice < {i}), TIMESTAMPTZ '1970-01-01')"
        parts.append(f"""
e{i} AS (SELECT digest, prompt_id, ts FROM f WHERE slice = {i} AND ts > {mark}
  AND digest NOT IN (SELECT digest FROM s{i} WHERE until > {mark})),
s{i + 1} AS (SELECT digest, max(until) AS until FROM (SELECT * FROM s{i} UNION ALL SELECT digest, ts + INTERVAL 2 HOUR FROM e{i}) GROUP BY 1)""")
    every = " UNION ALL ".join(f"SELECT digest, prompt_id FROM e{i}" for i in range(slices))
    return f"WITH {','.join(parts)} {every}"


CONTEXT_EXPIRING = """WITH m AS (SELECT *, turn * 10 + conv_id % 7 + CASE WHEN conv_id % 3 = 0 AND turn >= 3 THEN 180 ELSE 0 END AS minute
  FROM conversations),
t AS (SELECT *, least(minute // 80, 3) AS slice FROM m),
k AS (SELECT slice, max(minute) AS newest FROM t GROUP BY 1),
n AS (SELECT s.slice, max(k.newest) - 10 AS mark FROM range(5) AS s(slice) LEFT JOIN k ON k.slice < s.slice GROUP BY 1),
live AS (SELECT t.* FROM t JOIN n USING (slice) WHERE mark IS NULL OR minute > mark),
g AS (SELECT conv_id, slice, max(minute) AS last FROM live GROUP BY 1, 2),
b AS (SELECT *, lag(last) OVER (PARTITION BY conv_id ORDER BY slice) AS before FROM g),
c AS (SELECT b.*, sum((before IS NOT NULL AND before + 60 <= mark)::INT) OVER (PARTITION BY conv_id ORDER BY b.slice) AS session
  FROM b JOIN n USING (slice)),
z AS (SELECT conv_id, session, max(last) AS last FROM c GROUP BY 1, 2),
x AS (SELECT live.*, session FROM live JOIN c USING (conv_id, slice)),
s AS (SELECT conv_id, session, count(*) AS n_turns, any_value(z.last) + 60 <= (SELECT mark FROM n WHERE slice = 4) AS gone
  FROM x JOIN z USING (conv_id, session) GROUP BY 1, 2),
r AS (SELECT x.*, row_number() OVER (PARTITION BY conv_id, session ORDER BY turn DESC) AS rn FROM x)
SELECT conv_id, 0::BIGINT AS slot, 'expired' AS role, NULL::VARCHAR AS content, n_turns FROM s WHERE gone
UNION ALL SELECT conv_id, (7 - rn)::BIGINT, CASE WHEN lower(role) = 'user' THEN 'user' ELSE 'assistant' END, text, n_turns
FROM r JOIN s USING (conv_id, session) WHERE NOT gone AND rn <= 6"""


RECENT = "ORDER BY ts DESC, prompt_id, model_name"
FLAG = "round(avg(adversarial::INT) * 100e0, 6)"
DETECT = f"WITH {decided()} SELECT {DECISION} FROM final"
CHAT_CONTEXT = f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
    FROM conversations),
recent AS (SELECT conv_id, (7 - rn)::BIGINT AS slot, CASE WHEN lower(role) = 'user' THEN 'user' ELSE 'assistant' END AS role,
    text AS content FROM ranked WHERE rn <= 6)"""


EDIT_MATCHES = """WITH t AS (SELECT doc_id AS a, coalesce(strlen(text), 0) AS n, text FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels)),
r AS (SELECT doc_id AS b, strlen(text) AS m, text AS other FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND strlen(text) > 0),
c AS (SELECT a, b, levenshtein(text, other) AS d, least(6, greatest(n, m) // 10) AS most FROM t JOIN r
  ON m BETWEEN n - 6 AND n + 6 WHERE n > 0 AND abs(n - m) <= least(6, greatest(n, m) // 10)),
f AS (SELECT a, min((d, b)) AS v FROM c WHERE d <= most GROUP BY a)
SELECT t.a AS row_id, n AS n_chars, v[2] AS match, v[1]::INTEGER AS distance FROM t LEFT JOIN f USING (a)"""


LENGTH = "length(substr(prompt, 1, 512))"
SCORED_PROMPTS = f"""plain AS (SELECT doc_id AS prompt_id,
    text || ' ' || ({texts(PHRASES)})[doc_id % {len(PHRASES)} + 1] AS prompt FROM documents),
docs AS (SELECT *, CASE WHEN {LENGTH} % 2 = 1 THEN 'toxic' ELSE 'other' END AS t_label,
    5e-1 + ({LENGTH} % 97)::DOUBLE / 200e0 AS t_score, t_label AS h_label, t_score AS h_score, t_label AS s_label,
    t_score AS s_score FROM plain),
low AS (SELECT *, lower(prompt) AS l FROM docs)"""


def statistics_rows() -> str:
    chat = ["total_chats", "adversarial_detected", "adversarial_rate", "avg_latency", "unique_sessions_count"]
    model = ["total_inferences", "avg_inference_time", "avg_score", "max_score", "min_score"]
    parts = [f"SELECT 'chat' AS part, 'all' AS name, '{m}' AS metric, {m}::DOUBLE AS value FROM chat" for m in chat]
    parts += [f"SELECT 'model', model_name, '{m}', {m}::DOUBLE FROM model" for m in model]
    return " UNION ALL ".join(parts)


def oracle() -> dict[str, str]:
    sql = {
        # rule scoring
        "keyword_hits": f"WITH {COUNTS} SELECT prompt_id, n_high, n_plain, n_down, n_high + n_plain + n_down AS n_literals FROM hits",
        "pattern_hits": f"WITH {COUNTS} SELECT prompt_id, n_pattern FROM hits",
        "context_flags": f"""WITH {PROMPTS} SELECT prompt_id, {any_of(V.MEDICAL_CONTEXT)} AS is_medical,
            {any_of(V.DISPOSAL_CONTEXT)} AS is_disposal, {any_of(V.RANGE_CONTEXT)} AS is_range,
            {any_of(V.SAFE_CONTEXT)} AS is_safe FROM low""",
        "context_tier": f"WITH {PROMPTS} SELECT prompt_id, {TIER} AS tier10 FROM low",
        "rule_points": f"WITH {COUNTS} SELECT prompt_id, points10 FROM points",
        "keyword_score": f"WITH {COUNTS} SELECT prompt_id, points10, keyword_score FROM keyed",
        "early_exit_split": f"""WITH {COUNTS} SELECT keyword_score > 45e-2 AS early_exit, count(*) AS n,
            min(keyword_score) AS lowest, max(keyword_score) AS highest FROM keyed GROUP BY 1""",
        "toxic_score": f"WITH {PROMPTS} SELECT prompt_id, {TOXIC} AS toxic_score FROM low",
        "hate_score": f"WITH {PROMPTS} SELECT prompt_id, {HATE} AS hate_score FROM low",
        "safety_score": f"WITH {PROMPTS} SELECT prompt_id, {SAFETY} AS safety_score FROM low",
        # vote and decision
        "sensitivity_modes": f"""WITH {GRID_VOTE} SELECT prompt_id, mode, high_confidence_threshold, weak_signals_threshold,
            c::INT AS weak_signals_count, majority_threshold, weighted_threshold, w0 AS keyword_weight, w1 AS toxic_weight,
            w2 AS hate_weight, w3 AS safety_weight FROM weighed""",
        "hybrid_vote": f"WITH {GRID_VOTE} SELECT prompt_id, mode, mechanism, mechanism <> 'none' AS is_adversarial FROM voted",
        "vote_reason": f"WITH {GRID_VOTE} SELECT prompt_id, {REASON} AS reason FROM voted",
        "winning_mechanism": f"WITH {decided('conservative')} SELECT prompt_id, winning_mechanism, early_exit FROM final",
        "detect": DETECT,
        "detect_parallel": f"""WITH {decided('high', exit_text=V.REASON_EARLY_EXIT_PARALLEL, early='NULL')} SELECT {DECISION},
            CASE WHEN NOT early_exit THEN toxic_score END AS breakdown_toxic,
            CASE WHEN NOT early_exit THEN latency_s * 1000e0 * 35e-2 END AS time_hate_ms FROM final""",
        "fallback_decision": f"""WITH {decided(failed='prompt_id % 3 = 0')} SELECT prompt_id, error, is_adversarial, reason,
            winning_mechanism, CASE WHEN error THEN TRUE END AS fallback FROM final""",
        "basic_keyword_fallback": f"""WITH {PROMPTS}, both_sets AS (SELECT prompt_id AS conv_id, -1::BIGINT AS turn, l FROM low
              UNION ALL SELECT conv_id, turn, lower(text) FROM conversations),
            hit AS (SELECT conv_id, turn, {any_of(V.FALLBACK_WORDS)} AS is_adversarial FROM both_sets)
            SELECT *, CASE WHEN is_adversarial THEN 8e-1 ELSE 1e-1 END AS keyword_score,
              CASE WHEN is_adversarial THEN {text(V.REASON_FALLBACK_HIT)} ELSE {text(V.REASON_FALLBACK_NONE)} END
              || 'model failure' AS reason FROM hit""",
        "moderation_gate": f"""WITH {decided()} SELECT prompt_id, is_adversarial, CASE WHEN is_adversarial
            THEN {text(V.BLOCKED_REPLY)} ELSE {text(V.PASSED_REPLY.split('%s')[0])} || prompt
            || {text(V.PASSED_REPLY.split('%s')[1])} END AS bot_response FROM final""",
        "mode_compare": f"WITH {decided(None)} SELECT prompt_id, m AS mode, is_adversarial, reason, winning_mechanism FROM final",
        "score_long": f"WITH {decided()} " + " UNION ALL ".join(
            f"SELECT prompt_id, {i}::INT AS model_index, '{n}' AS model_name, {m}_score AS score FROM final"
            for i, (n, m) in enumerate(zip(V.COUNTER_MODELS, V.SCORE_NAMES))),
        # older ensemble
        "legacy_scores": f"WITH {OUTPUTS} SELECT prompt_id, {', '.join(V.LEGACY_MODELS)} FROM outs",
        "legacy_vote": f"WITH {GRID} SELECT prompt_id, "
            + legacy_vote("keyword_score", "toxic_score", "hate_score", "safety_score") + " FROM grid",
        "legacy_detect": f"""WITH {LEGACY} SELECT prompt_id, is_adversarial, reason, electra_vote, model_agreement,
            confidence_score FROM legacy""",
        "legacy_run_log": legacy_log(),
        # logs
        "model_run_log": f"WITH {run_log()} SELECT * EXCLUDE (ts) FROM runs",
        "decision_log": f"WITH {decision_log()} SELECT * EXCLUDE (ts) FROM decisions",
        "chat_log_flat": chat_flat(),
        "model_perf_build": perf_log(),
        "run_names": f"""WITH {EVENTS} SELECT event_id, model_name || '_' || {NAME_STAMP} AS run_name, {STAMP} AS "timestamp",
            strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, floor(epoch(ts))::BIGINT AS epoch,
            strftime(ts - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before FROM ev""",
        "prompt_hash": f"WITH {PROMPTS} SELECT prompt_id, {HASH} AS input_hash, md5(prompt) AS digest FROM docs",
        "text_features": """SELECT doc_id, length(text) AS input_length, length(lower(text)) AS lower_length,
            md5(upper(source)) AS upper_digest, substr(text, 1, 500) AS cut_500, substr(text, 1, 80) AS cut_80,
            CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview,
            split_part(source, 'c', 2) AS part, 'Weak Signals Trigger' AS title, contains(lower(text), 'the') AS has_the
            FROM documents""",
        "props_extract": "SELECT event_id, CAST(regexp_extract(props, '\"k\"\\s*:\\s*(-?[0-9]+)', 1) AS BIGINT) AS k FROM events",
        # reports
        "runlog_search": f"""WITH {run_log()} SELECT prompt_id, model_name, score, inference_time_ms, adversarial FROM runs
            WHERE model_name <> '{V.ENSEMBLE_MODEL}' AND inference_time_ms > 0 {RECENT} LIMIT 100""",
        "runlog_filter": f"""WITH {run_log()} SELECT prompt_id, model_name, score, detection_outcome FROM runs
            WHERE detection_outcome = 'adversarial' AND model_type = 'individual'""",
        "model_run_summary_latest": f"""WITH {run_log()}, latest AS (SELECT * FROM runs WHERE inference_time_ms > 0 {RECENT} LIMIT 100)
            SELECT model_name, round(avg(score), 3) AS score_mean, round(stddev_samp(score), 3) AS score_std,
              count(score) AS score_count, round(avg(inference_time_ms), 3) AS time_mean,
              round(max(inference_time_ms), 3) AS time_max, round(min(inference_time_ms), 3) AS time_min,
              sum(adversarial::INT)::BIGINT AS adversarial_count FROM latest GROUP BY model_name""",
        "detection_rate": f"""WITH {run_log()} SELECT model_name, count(*) AS total, sum(adversarial::INT)::BIGINT AS adversarial,
            {FLAG} AS rate FROM runs WHERE inference_time_ms > 0 GROUP BY model_name""",
        "mechanism_stats": f"WITH {decision_log()} " + " UNION ALL ".join(
            f"""SELECT '{name}' AS mechanism, count(*) FILTER (voting_{key} = 1) AS triggers,
            round(coalesce(count(*) FILTER (voting_{key} = 1 AND adversarial)::DOUBLE
              / nullif(count(*) FILTER (voting_{key} = 1), 0) * 100e0, 0e0), 6) AS accuracy
            FROM decisions WHERE total_inference_time_ms > 0""" for key, name in [
                ("high_confidence_trigger", "High Confidence Trigger"), ("weak_signals_trigger", "Weak Signals Trigger"),
                ("majority_consensus", "Majority Consensus"), ("weighted_ensemble", "Weighted Ensemble")]),
        "early_exit_stats": f"""WITH {decision_log()} SELECT count(*) AS total, count(*) FILTER (early_exit = 1) AS early_exits,
            round(avg(early_exit) * 100e0, 6) AS early_exit_rate,
            round(avg(total_inference_time_ms) FILTER (early_exit = 1), 6) AS avg_early_time_ms
            FROM decisions WHERE total_inference_time_ms > 0""",
        "mode_stats": f"""WITH {decision_log(decided(None))} SELECT sensitivity_mode, count(*) AS runs,
            round(avg(total_inference_time_ms), 6) AS avg_time_ms, {FLAG} AS flagged_percent
            FROM decisions WHERE total_inference_time_ms > 0 GROUP BY sensitivity_mode""",
        "outcome_counts": f"WITH {run_log()} SELECT detection_outcome, count(*) AS n FROM runs GROUP BY 1",
        "label_counts": f"WITH {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY 1",
        "label_share": f"""WITH {RELABELLED} SELECT label, count(*) AS n,
            count(*)::DOUBLE / (SELECT count(*) FROM relabelled) AS share FROM relabelled GROUP BY 1""",
        "recent_runs": f"""WITH {run_log()} SELECT prompt_id, run_name, model_name, CASE WHEN adversarial THEN 'ADVERSARIAL'
            ELSE 'SAFE' END AS decision, score, inference_time_ms, "timestamp" AS started FROM runs {RECENT} LIMIT 10""",
        "recent_decisions": f"""WITH {decision_log()} SELECT prompt_id, "timestamp", CASE WHEN adversarial THEN 'ADVERSARIAL'
            ELSE 'SAFE' END AS result, substr(decision_reason, 1, 23) AS reason, total_inference_time_ms AS time_ms,
            substr(prompt, 1, 28) || '...' AS prompt_preview FROM decisions ORDER BY ts DESC, prompt_id LIMIT 10""",
        "class_overview": f"""WITH {decision_log()} SELECT detection_outcome, count(*) AS n,
            round(count(*)::DOUBLE / (SELECT count(*) FROM decisions) * 100e0, 6) AS percent,
            round(avg(input_length), 6) AS avg_length FROM decisions GROUP BY 1""",
        "class_samples": f"""WITH {decision_log()} SELECT detection_outcome, row_number() OVER (PARTITION BY detection_outcome
            ORDER BY ts DESC, prompt_id) AS sample, prompt_id, substr(prompt, 1, 80) || '...' AS prompt FROM decisions
            QUALIFY sample <= 3""",
        "length_buckets": f"""WITH {decision_log()} SELECT CASE WHEN input_length < 50 THEN 'Short (<50 chars)'
            WHEN input_length < 200 THEN 'Medium (50-200 chars)' ELSE 'Long (>200 chars)' END AS bucket, count(*) AS n,
            {FLAG} AS flagged_percent FROM decisions WHERE (SELECT count(*) FROM decisions) > 5 GROUP BY 1""",
        # monitoring
        "chat_statistics": f"""SELECT count(*) AS total_chats, sum((event_type = 'error')::INT)::BIGINT AS adversarial_detected,
            sum((event_type = 'error')::INT)::DOUBLE / count(*) AS adversarial_rate,
            round(avg(value / 20e0), 6) AS avg_latency, count(DISTINCT CASE WHEN event_id % 50 <> 0 THEN user_id END)
              + max((event_id % 50 = 0)::INT) AS unique_sessions_count
            FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY HAVING count(*) > 0""",
        "model_performance": f"""WITH {EVENTS} SELECT model_name, count(*) AS total_inferences,
            round(avg(latency_s), 6) AS avg_inference_time, round(avg((event_id % 101)::DOUBLE / 101e0), 6) AS avg_score,
            max((event_id % 101)::DOUBLE / 101e0) AS max_score, min((event_id % 101)::DOUBLE / 101e0) AS min_score
            FROM ev WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1""",
        "model_stats_one": f"""WITH {EVENTS} SELECT model_name, count(*) AS total_inferences,
            round(avg(latency_s), 6) AS avg_inference_time, round(avg((event_id % 101)::DOUBLE / 101e0), 6) AS avg_score,
            max((event_id % 101)::DOUBLE / 101e0) AS max_score, min((event_id % 101)::DOUBLE / 101e0) AS min_score
            FROM ev WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND model_name = 'electra_small' GROUP BY 1""",
        "event_counters": counters(),
        "prediction_counters": f"WITH {EVENTS} SELECT model_name, count(*) AS n FROM ev GROUP BY 1",
        "failure_counters": """SELECT CASE WHEN user_id % 2 = 0 THEN 'general_error' ELSE 'timeout' END AS error_type,
            count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1""",
        "latency_histogram": f"""WITH {EVENTS}, {BUCKETS}, sums AS (SELECT model_name, round(sum(latency_s), 6) AS latency_sum,
            count(*) AS latency_count FROM ev GROUP BY 1),
            hist AS (SELECT model_name, le, count(*) FILTER (latency_s <= hi) AS cumulative_count FROM ev, buckets GROUP BY 1, 2)
            SELECT * FROM hist JOIN sums USING (model_name)""",
        "latency_p95": f"""WITH {EVENTS}, {BUCKETS}, hist AS (SELECT model_name, i, lo, hi,
            count(*) FILTER (latency_s <= hi) AS cum, count(*) AS total FROM ev, buckets GROUP BY ALL)
            SELECT model_name, round(v, 6) AS latency_ms FROM {quantile('model_name', 'hist', 0.95)}""",
        "latency_p95_exact": f"WITH {EVENTS} SELECT model_name, round(quantile_cont(latency_s, 0.95), 9) AS p95 FROM ev GROUP BY 1",
        "latency_quantiles_5m": sliding_quantiles(),
        "avg_latency_5m": f"""WITH {SLIDING} SELECT window_start, model_name,
            round(sum(latency_s) / count(*) * 1000e0, 6) AS avg_latency_ms FROM wide GROUP BY ALL""",
        "request_rate_1m": f"""WITH {EVENTS} SELECT date_trunc('minute', ts) AS window_start, model_name,
            count(*)::DOUBLE / 60e0 AS rate FROM ev GROUP BY ALL""",
        "running_totals": f"""WITH {EVENTS} SELECT event_id, model_name,
            count(*) OVER (PARTITION BY model_name ORDER BY ts, event_id) AS total FROM ev""",
        "concurrency": f"""WITH {EVENTS}, changes AS (SELECT epoch_us(ts) AS t_us, 1 AS delta FROM ev UNION ALL
            SELECT epoch_us(ts) + round(latency_s * 1000000e0)::BIGINT, -1 FROM ev),
            grouped AS (SELECT t_us, delta, sum(delta)::BIGINT AS change FROM changes GROUP BY 1, 2)
            SELECT *, sum(change) OVER (ORDER BY t_us, delta)::BIGINT AS in_flight FROM grouped""",
        "chat_context": CHAT_CONTEXT + f""" SELECT * FROM recent UNION ALL
            SELECT DISTINCT conv_id, 0::BIGINT, 'system', {text(V.SYSTEM_LINE)} FROM conversations UNION ALL
            SELECT conv_id, 7::BIGINT, 'user', arg_max(text, turn) FROM conversations WHERE lower(role) = 'user' GROUP BY 1""",
        # data preparation
        "csv_roundtrip": f"WITH {LABELLED} SELECT * FROM labelled",
        "tsv_roundtrip": f"WITH {LABELLED} SELECT * FROM labelled",
        "multi_file_union": f"""WITH {RELABELLED} SELECT * FROM relabelled UNION ALL
            SELECT conv_id * 1000 + turn, text, 'benign' FROM conversations""",
        "export_split": """SELECT text AS prompt, CASE WHEN toxic = 1 THEN 'jailbreak' ELSE 'benign' END AS label
            FROM documents JOIN labels USING (doc_id) WHERE quality <> 1""",
        "load_labeled": """SELECT text AS prompt, CASE toxic WHEN 0 THEN 'safe' WHEN 1 THEN 'adversarial' END AS label
            FROM documents JOIN labels USING (doc_id) UNION ALL
            SELECT text, 'adversarial' FROM conversations WHERE role = 'user' AND text IS NOT NULL""",
        "label_map": f"""WITH {LABELLED} SELECT row_id, label, (CASE label WHEN 'adversarial' THEN 0 WHEN 'benign' THEN 1 END)
            ::BIGINT AS label_id FROM labelled""",
        "standardize_labels": f"WITH {RELABELLED} SELECT row_id, label FROM relabelled",
        "label_encode": f"""WITH {LABELLED}, first AS (SELECT label, min(row_id) AS f FROM labelled GROUP BY 1),
            ids AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS label_id FROM first)
            SELECT row_id, label, label_id FROM labelled JOIN ids USING (label)""",
        "dedup_prompts": f"""WITH {LABELLED} SELECT row_id, prompt, label FROM (SELECT *, row_number() OVER
            (PARTITION BY prompt ORDER BY row_id) AS rn FROM labelled) WHERE rn = 1""",
        "exact_overlap": """SELECT text AS prompt FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) INTERSECT
            SELECT text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "seeded_shuffle": f"""WITH {LABELLED} SELECT row_id, row_number() OVER
            (ORDER BY md5(prompt || '|' || row_id::VARCHAR || '|42'), row_id) - 1 AS position FROM labelled""",
        "seeded_sample": """SELECT doc_id AS row_id, text AS prompt FROM documents
            ORDER BY md5(text || '|' || doc_id::VARCHAR || '|42'), doc_id LIMIT 500""",
        "stratified_split": f"WITH {SPLIT} SELECT * FROM split",
        "split_shares": f"""WITH {SPLIT} SELECT split, label, count(*) AS n,
            count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split) AS share FROM split GROUP BY 1, 2""",
        "step_profile": f"""WITH {LABELLED} SELECT 'combined' AS step, count(*) AS rows, 3::BIGINT AS columns FROM labelled
            UNION ALL SELECT 'deduplicated', count(DISTINCT prompt), 3 FROM labelled""",
        "ngram_counts": f"WITH {CLEAN}, {grams('clean', 2)} SELECT gram, count(*) AS n FROM grams GROUP BY 1",
        "top_ngrams": f"""WITH {CLEAN}, {grams('clean', 3)} SELECT gram, count(*) AS n FROM grams GROUP BY 1
            ORDER BY n DESC, gram LIMIT 5000""",
        "ngram_bias": f"""WITH {CLEAN}, {grams('clean', 3, STOP_WORDS)}, counted AS (SELECT gram, count(*) AS n,
              count(*) FILTER (label = 'adversarial') AS a, count(*) FILTER (label = 'benign') AS b FROM grams GROUP BY 1),
            known AS (SELECT * FROM counted ORDER BY n DESC, gram LIMIT 5000),
            means AS (SELECT gram, a::DOUBLE / (SELECT count(*) FROM clean WHERE label = 'adversarial') AS x,
              b::DOUBLE / (SELECT count(*) FROM clean WHERE label = 'benign') AS y FROM known)
            SELECT gram, round(x, 9) AS mean_first, round(y, 9) AS mean_second, round(abs(x - y), 9) AS difference
            FROM means ORDER BY abs(x - y) DESC, gram LIMIT 20""",
        "tfidf_weights": f"""WITH {CLEAN}, {grams('clean', 2)}, counted AS (SELECT gram, count(*) AS n,
              count(DISTINCT row_id) AS df FROM grams GROUP BY 1),
            known AS (SELECT * FROM counted ORDER BY n DESC, gram LIMIT 1000),
            tf AS (SELECT row_id, gram, count(*)::DOUBLE * (ln((1e0 + (SELECT count(*) FROM clean)) / (1e0 + any_value(df))) + 1e0)
              AS w FROM grams JOIN known USING (gram) GROUP BY 1, 2)
            SELECT row_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM tf""",
        # modelling
        "class_weights": f"""WITH {LABELLED} SELECT label, count(*) AS n, (SELECT count(*) FROM labelled)::DOUBLE
            / ((SELECT count(DISTINCT label) FROM labelled) * count(*)) AS weight FROM labelled GROUP BY 1""",
        "detect_with_scorers": f"WITH {decided().replace(PROMPTS, SCORED_PROMPTS)} SELECT {DECISION} FROM final",
        "softmax_argmax": f"""WITH {EVALUATION} SELECT row_id, round(exp(logit1) / (exp(logit0) + exp(logit1)), 9) AS p1,
            predicted::BIGINT AS cls FROM guessed""",
        "binary_metrics": f"WITH {EVALUATION} {metrics('guessed')}",
        "macro_metrics": f"""WITH {EVALUATION}, cls AS (SELECT y AS k FROM guessed UNION SELECT predicted FROM guessed),
            per AS (SELECT k, count(*) FILTER (y = k AND predicted = k) AS tp, count(*) FILTER (predicted = k) AS g,
              count(*) FILTER (y = k) AS a FROM guessed, cls GROUP BY k),
            pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(g, 0), 0e0) AS p, coalesce(tp::DOUBLE / nullif(a, 0), 0e0) AS r FROM per)
            SELECT round(sum(tp)::DOUBLE / sum(a), 9) AS accuracy, round(avg(p), 9) AS "precision", round(avg(r), 9) AS recall,
              round(avg(CASE WHEN p + r > 0 THEN 2e0 * p * r / (p + r) ELSE 0e0 END), 9) AS f1 FROM pr""",
        "pr_curve": f"WITH {CURVE} SELECT * FROM rated",
        "best_threshold": f"WITH {CURVE} SELECT * FROM best",
        "calibrated_threshold": f"WITH {CURVE} SELECT threshold FROM best",
        "metrics_at_threshold": f"""WITH {CURVE}, cut AS (SELECT y, CASE WHEN p >= (SELECT threshold FROM best) THEN 1 ELSE 0 END
            AS predicted FROM rows) {metrics('cut')}""",
        "best_checkpoint": f"""WITH {EVALUATION}, steps AS (SELECT *, source AS run, row_id // 100 AS step FROM guessed),
            log AS ({metrics('steps', 'run, step')})
            SELECT run, step, f1, f1 > coalesce(max(f1) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING
              AND 1 PRECEDING), 0e0) AS should_save FROM log""",
        "leaderboard": f"""WITH {EVALUATION}, log AS ({metrics('guessed', 'source')}) SELECT source AS name,
            CASE WHEN length(source) > 4 THEN 'm-' || source ELSE 'unknown' END AS model, accuracy,
            CASE WHEN f1 > 0 THEN f1 END AS f1, "precision", recall, 'runs/' || source AS url FROM log""",
        # streaming
        "stream_detect": DETECT,
        "stream_logs": f"""WITH {decision_log(run_log())} SELECT model_name, detection_outcome, count(*) AS n FROM
            (SELECT model_name, detection_outcome FROM runs UNION ALL SELECT model_name, detection_outcome FROM decisions)
            GROUP BY 1, 2""",
        "stream_rates": stream_rates(),
        "stream_histogram": sliding_quantiles(),
        "stream_context": CHAT_CONTEXT + " SELECT * FROM recent",
        "own_rules": own_rules(),
        "mode_compare_scorers": f"""WITH {decided(None, failed='prompt_id % 5 = 0').replace(PROMPTS, SCORED_PROMPTS)}
            SELECT prompt_id, m AS mode, error, is_adversarial, reason, winning_mechanism FROM final""",
        "scorer_failure": f"""WITH {decided(failed='length(substr(prompt, 1, 512)) % 7 = 0').replace(PROMPTS, SCORED_PROMPTS)}
            SELECT {DECISION}, error FROM final""",
        "edit_matches": EDIT_MATCHES,
        "edit_overlap": f"SELECT row_id, n_chars, match IS NOT NULL AS leaked FROM ({EDIT_MATCHES})",
        "near_overlap": NEAR_OVERLAP,
        "near_overlap_best": NEAR_OVERLAP_BEST,
        "counter_rate_5m": counter_rate(),
        "histogram_rate_quantile": f"WITH {scraped_windows(LE)}, {scraped_quantiles('rated', 'r_')}",
        "histogram_latest_quantile": f"WITH {scraped_windows(LE)}, {scraped_quantiles('win', 'l_')}",
        "stream_rates_late": f"""WITH {LATE} SELECT window_start, model_name, count(*) AS n, count(*)::DOUBLE / 300e0 AS rate,
            round(sum(latency_s) / count(*) * 1000e0, 6) AS avg_latency_ms FROM kept GROUP BY ALL""",
        "stream_histogram_late": f"""WITH {LATE} SELECT window_start, model_name, {', '.join(f'{c} AS {n}' for n, c in LE.items())}
            FROM kept GROUP BY ALL""",
        "stream_dedup_late": dedup_late(),
        "stream_context_expiring": CONTEXT_EXPIRING,
        "stream_join_outputs": """WITH p AS (SELECT doc_id AS i, CASE WHEN doc_id % 11 = 0 THEN 'toxic' ELSE 'non-toxic' END AS label,
            0.6e0 + 0.4e0 * (((doc_id * 37) % 101)::DOUBLE / 101e0) AS score,
            make_timestamp((1704067200 + doc_id * 60 + doc_id % 20 * 60) * 1000000) AS output_ts, doc_id % 11 <> 0 AND doc_id % 20 <= 10 AS hit
            FROM documents)
            SELECT i AS prompt_id, CASE WHEN hit THEN output_ts END AS output_ts, CASE WHEN hit THEN label END AS label,
            CASE WHEN hit THEN score END AS score FROM p""",
        "stream_dedup": "SELECT DISTINCT text AS prompt FROM documents",
    }
    flags = ["high_confidence_trigger", "weak_signals_trigger", "majority_consensus", "weighted_ensemble", "early_exit",
             "error", "fallback"]
    shown = ", ".join(f"d.voting_{f} = 1 AS {f}" for f in flags)
    sql["details_json_fields"] = f"WITH {decision_log()} " + " UNION ALL ".join(
        f"""SELECT d.prompt_id, {i}::INT AS model_index, '{m}' AS model_name, d.{m}_score AS score, d."timestamp", {shown},
            CASE WHEN NOT f.early_exit AND NOT f.error THEN CASE WHEN f.layer = 'none' THEN 'safe' ELSE 'adversarial' END END
              AS final_decision FROM decisions d JOIN final f USING (prompt_id)"""
        for i, m in enumerate(V.SCORE_NAMES))
    for name in ("mode_compare_scorers", "scorer_failure", "detect_with_scorers"):
        sql[f"{name}_whole"] = sql[name].replace("substr(prompt, 1, 512)", "prompt")
    sql["model_run_summary"] = sql["model_run_summary_latest"].replace(f"{RECENT} LIMIT 100", "")
    sql["chat_log_stored"] = sql["chat_log_variant"] = sql["chat_log_flat"]
    sql["details_variant"] = sql["details_json_fields"]
    sql["runlog_stored"] = f"""WITH {run_log()} SELECT ts::DATE AS day, model_name, count(*) AS n,
        count(*) FILTER (adversarial) AS adversarial FROM runs GROUP BY 1, 2"""
    sql["chat_statistics_rollup"] = f"""SELECT total_chats, adversarial_detected, adversarial_rate, avg_latency FROM ({sql["chat_statistics"]})"""
    sql["model_performance_rollup"] = sql["model_performance"].replace(AS_OF, AS_OF.replace("00:00:00", "07:30:00"))
    sql["runlog_committed"] = sql["runlog_stored"]
    sql["runlog_filter_text"] = sql["runlog_search"].replace("inference_time_ms > 0", "inference_time_ms > 0 AND detection_outcome = 'adversarial'")
    sql["metrics_stored"] = f"""WITH macro AS ({sql["macro_metrics"]}) """ + " UNION ALL ".join(
        f"SELECT 'baseline' AS run, '{m}' AS metric, \"{m}\" AS value FROM macro" for m in ("accuracy", "precision", "recall", "f1")
    )
    performance = sql["model_performance"].replace(f"WITH {EVENTS} ", "")
    sql["statistics_summary"] = (
        f"WITH {EVENTS}, chat AS ({sql['chat_statistics']}), model AS ({performance}) " + statistics_rows()
    )
    return sql
