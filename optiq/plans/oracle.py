"""DuckDB oracle SQL for every registered query.

Each query starts from the driver tables through the same binding views as
``optiq.plans.bindings`` (written here as CTEs), then states the operator the
plain SQL way. Double outputs of both engines go through ``CAST(CAST(x AS
FLOAT) AS DOUBLE)`` so summation order does not change the value hash.
"""

from __future__ import annotations

# ---------------------------------------------------------------- bindings
_K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"
_OK = "((event_id * 31 + user_id * 17) % 100 < 50 + (user_id % 3) * 15 + (length(event_type) % 4) * 5)"
_CIDX = "(event_id % 200 % 4)"
_WIDX = "((event_id % 200 % 4 + 1 + event_id % 3) % 4)"

RESPONSES = f"""responses AS (
  SELECT event_id AS response_id, ts,
         'model_' || CAST(user_id % 3 AS VARCHAR) AS model,
         'q' || CAST(event_id % 200 AS VARCHAR) AS question,
         'subj_' || CAST(event_id % 200 % 10 AS VARCHAR) AS subject,
         'opt' || CAST({_CIDX} AS VARCHAR) AS correct_answer,
         'opt' || CAST(CASE WHEN {_OK} THEN {_CIDX} ELSE {_WIDX} END AS VARCHAR) AS llm_answer,
         {_OK} AS is_correct,
         CASE WHEN {_K} % 10 = 0 THEN NULL ELSE {_K} + 1 END AS confidence,
         value / 100.0 AS response_time,
         event_type AS distractor_set,
         event_type AS distractor_type
  FROM events)"""

_Q = "('q' || CAST(event_id % 200 AS VARCHAR))"
_OPTS = f"['Alpha ' || {_Q}, 'Beta ' || {_Q}, 'Gamma ' || {_Q}, 'Delta ' || {_Q}]"
_PICK = f"({_OPTS})[CASE WHEN {_OK} THEN {_CIDX} ELSE {_WIDX} END + 1]"
_KS = f"CAST({_K} AS VARCHAR)"

RAW_RESPONSES = f"""raw_responses AS (
  SELECT event_id AS response_id,
         'model_' || CAST(user_id % 3 AS VARCHAR) AS model,
         {_Q} AS question,
         {_OPTS} AS options,
         ({_OPTS})[{_CIDX} + 1] AS correct_answer,
         CASE event_id % 6
           WHEN 0 THEN 'Reasoning: First, the question asks about ' || {_Q} || '.' || chr(10)
                || 'Second, ' || {_PICK} || ' might fit best.' || chr(10)
                || 'Third, the others are unlikely.' || chr(10) || 'Answer: ' || {_PICK}
                || chr(10) || 'Confidence: ' || {_KS}
           WHEN 1 THEN 'answer: ' || lower({_PICK}) || ' confidence: ' || {_KS}
           WHEN 2 THEN 'Let me think.' || chr(10) || 'The answer is:' || chr(10) || {_PICK}
                || chr(10) || 'Confidence: 250'
           WHEN 3 THEN 'Step 1: perhaps ' || {_PICK} || ' could be right, not sure.' || chr(10)
                || chr(10) || 'Finally, I pick ' || {_PICK} || '.' || chr(10)
                || 'confidence: 0' || {_KS}
           WHEN 4 THEN 'Thinking: maybe ' || {_PICK} || chr(10) || 'confidence: ' || {_KS}
                || '000000000000000000000000000000000000000000'
           ELSE 'Error: the service timed out' END AS raw_response,
         value / 100.0 AS response_time,
         event_type AS distractor_set
  FROM events)"""

VECTOR_SLOTS = """vector_slots AS (
  SELECT vec_id // 10 AS item_id, CAST(vec_id % 10 AS INTEGER) AS slot,
         ['click', 'error', 'purchase', 'signup', 'view'][vec_id // 10 % 5 + 1] AS distractor_set, label,
         CAST(embedding AS DOUBLE[]) AS vector
  FROM embeddings)"""

_WS = "'^[ \\t\\r\\n]+|[ \\t\\r\\n]+$'"
TEXT_PIECES = f"""text_pieces AS (
  SELECT doc_id, source, lang, CAST(pos // 10 AS INTEGER) AS block,
         CAST(pos % 10 AS INTEGER) AS slot, text,
         ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS distractor_set
  FROM (
    SELECT doc_id, source, lang, unnest(p) AS text, unnest(range(len(p))) AS pos
    FROM (SELECT doc_id, source, lang,
                 list_filter(list_transform(regexp_split_to_array(text, '\\. |\\n'),
                                            lambda x: regexp_replace(x, {_WS}, '', 'g')),
                             lambda x: x <> '') AS p
          FROM documents)))"""

TEXT_ITEMS = f"""text_items AS (
  SELECT doc_id, source, lang, CAST(b AS INTEGER) AS block,
         'doc' || CAST(doc_id AS VARCHAR) || '/' || CAST(b AS VARCHAR) AS question,
         p[b * 10 + 1] AS correct_answer,
         list_slice(p, b * 10 + 2, b * 10 + 10) AS distractors,
         CAST(NULL AS VARCHAR[]) AS options,
         source AS subject,
         ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS distractor_set
  FROM (SELECT *, unnest(range(CAST((len(p) + 9) // 10 AS BIGINT))) AS b
        FROM (SELECT doc_id, source, lang,
                     list_filter(list_transform(regexp_split_to_array(text, '\\. |\\n'),
                                                lambda x: regexp_replace(x, {_WS}, '', 'g')),
                                 lambda x: x <> '') AS p
              FROM documents)
        WHERE len(p) > 0))"""

CONV_PAIRS = """conversation_pairs AS (
  SELECT a.conv_id, a.turn, a.text AS reference, b.text AS hypothesis
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def f4(expr: str) -> str:
    """The comparison precision both engines agree on (IEEE single rounding)."""
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)"


# ---------------------------------------------------------------- queries
ORACLE: dict[str, str] = {}

_METRICS = f"""{f4('avg(CAST(is_correct AS DOUBLE)) * 100.0')} AS accuracy,
       {f4('avg(confidence)')} AS avg_confidence,
       {f4('avg(response_time)')} AS avg_response_time,
       count(*) AS count"""
_CAL = "1.0 - abs(avg(CAST(is_correct AS DOUBLE)) - avg(confidence) / 100.0)"
_LEVEL = """CASE GROUPING(model, distractor_set) WHEN 0 THEN 'model_distractor_set'
       WHEN 1 THEN 'model' WHEN 2 THEN 'distractor_set' ELSE 'total' END"""

ORACLE["model_distractor_summary"] = with_(RESPONSES) + f"""
SELECT {_LEVEL} AS level, model, distractor_set,
       {_METRICS},
       CASE WHEN GROUPING(model, distractor_set) = 1 THEN {f4(_CAL)} END AS confidence_calibration
FROM responses
WHERE model IS NOT NULL AND distractor_set IS NOT NULL
GROUP BY GROUPING SETS ((model), (distractor_set), (model, distractor_set))"""

ORACLE["summary_cube"] = with_(RESPONSES) + f"""
SELECT {_LEVEL} AS level, model, distractor_set,
       {_METRICS}, {f4(_CAL)} AS confidence_calibration
FROM responses
WHERE model IS NOT NULL AND distractor_set IS NOT NULL
GROUP BY CUBE (model, distractor_set)"""

ORACLE["model_summary"] = with_(RESPONSES) + f"""
SELECT model, {_METRICS}, {f4(_CAL)} AS confidence_calibration
FROM responses WHERE model IS NOT NULL GROUP BY model"""

ORACLE["distractor_summary"] = with_(RESPONSES) + f"""
SELECT distractor_set, {_METRICS}
FROM responses WHERE distractor_set IS NOT NULL GROUP BY distractor_set"""

ORACLE["set_summary"] = with_(RESPONSES) + f"""
SELECT distractor_set, {f4('avg(CAST(is_correct AS DOUBLE)) * 100.0')} AS accuracy,
       {f4('avg(response_time)')} AS response_time, count(*) AS n_responses
FROM responses WHERE distractor_set IS NOT NULL GROUP BY distractor_set"""

ORACLE["filter_in"] = with_(RESPONSES) + f"""
SELECT distractor_set, {f4('avg(CAST(is_correct AS DOUBLE)) * 100.0')} AS accuracy,
       {f4('avg(response_time)')} AS response_time, count(*) AS n_responses
FROM responses WHERE distractor_set IN ('click', 'view') GROUP BY distractor_set"""

ORACLE["round_n"] = f"""
SELECT level, model, distractor_set, {f4('round(accuracy, 2)')} AS accuracy,
       {f4('round(avg_confidence, 2)')} AS avg_confidence,
       {f4('round(avg_response_time, 3)')} AS avg_response_time,
       {f4('round(confidence_calibration, 3)')} AS confidence_calibration, count
FROM ({ORACLE["model_distractor_summary"]})"""

ORACLE["distractor_stats"] = with_(RESPONSES) + f"""
SELECT model, distractor_set,
       {f4('avg(CAST(is_correct AS DOUBLE))')} AS is_correct_mean,
       count(is_correct) AS is_correct_count,
       {f4('avg(confidence)')} AS confidence_mean,
       {f4('stddev_samp(confidence)')} AS confidence_std,
       {f4('avg(response_time)')} AS response_time_mean,
       {f4('stddev_samp(response_time)')} AS response_time_std,
       {f4('abs(avg(CAST(is_correct AS DOUBLE)) - avg(confidence) / 100.0)')} AS calibration_error
FROM responses WHERE model IS NOT NULL AND distractor_set IS NOT NULL
GROUP BY model, distractor_set"""

ORACLE["item_analysis"] = with_(RESPONSES) + f""",
scored AS (
  SELECT *, avg(CAST(is_correct AS DOUBLE)) OVER (PARTITION BY model) AS overall_score
  FROM responses WHERE question IS NOT NULL),
q AS (
  SELECT question,
         arg_min(subject, response_id) AS subject,
         avg(CAST(is_correct AS DOUBLE)) AS p_value,
         CASE WHEN count(*) > 1 AND count(DISTINCT is_correct) > 1
                   AND stddev_samp(overall_score) > 0
              THEN covar_samp(CAST(is_correct AS DOUBLE), overall_score)
                   / (stddev_samp(CAST(is_correct AS DOUBLE)) * stddev_samp(overall_score)) END
           AS discrimination,
         avg(confidence) AS avg_confidence,
         avg(CASE WHEN is_correct THEN confidence END) AS correct_confidence,
         avg(CASE WHEN NOT is_correct THEN confidence END) AS incorrect_confidence,
         avg(response_time) AS avg_response_time,
         avg(CASE WHEN is_correct THEN response_time END) AS correct_time,
         avg(CASE WHEN NOT is_correct THEN response_time END) AS incorrect_time
  FROM scored GROUP BY question),
wc AS (
  SELECT question, llm_answer, count(*) AS n FROM responses
  WHERE NOT is_correct AND llm_answer IS NOT NULL AND question IS NOT NULL
  GROUP BY question, llm_answer),
w AS (
  SELECT question, llm_answer, n FROM (
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, llm_answer) AS rn FROM wc)
  WHERE rn = 1)
SELECT q.question, subject,
       {f4('p_value')} AS p_value, {f4('1.0 - p_value')} AS difficulty,
       {f4('discrimination')} AS discrimination,
       {f4('avg_confidence')} AS avg_confidence,
       {f4('correct_confidence')} AS correct_confidence,
       {f4('incorrect_confidence')} AS incorrect_confidence,
       {f4('correct_confidence - incorrect_confidence')} AS confidence_discrimination,
       {f4('avg_response_time')} AS avg_response_time,
       {f4('correct_time')} AS correct_time, {f4('incorrect_time')} AS incorrect_time,
       coalesce(w.llm_answer, 'N/A') AS most_chosen_wrong,
       coalesce(w.n, 0) AS wrong_count
FROM q LEFT JOIN w ON q.question = w.question"""

# pandas.cut on confidence/100 with edges linspace(0, 1, 11), right-closed, lowest included
_BIN = """CASE WHEN confidence / 100.0 <= 0.1 THEN 0 WHEN confidence / 100.0 <= 0.2 THEN 1
            WHEN confidence / 100.0 <= 0.3 THEN 2 WHEN confidence / 100.0 <= 0.4 THEN 3
            WHEN confidence / 100.0 <= 0.5 THEN 4 WHEN confidence / 100.0 <= 0.6 THEN 5
            WHEN confidence / 100.0 <= 0.7 THEN 6 WHEN confidence / 100.0 <= 0.8 THEN 7
            WHEN confidence / 100.0 <= 0.9 THEN 8 ELSE 9 END"""

ORACLE["reliability_bins"] = with_(RESPONSES) + f"""
SELECT model, bin, count(*) AS n,
       {f4('avg(CAST(is_correct AS DOUBLE))')} AS accuracy,
       {f4('avg(confidence / 100.0)')} AS confidence,
       {f4('(bin * 2 + 1) / 20.0')} AS bin_center
FROM (SELECT *, CAST({_BIN} AS INTEGER) AS bin FROM responses
      WHERE confidence IS NOT NULL AND is_correct IS NOT NULL AND model IS NOT NULL)
GROUP BY model, bin"""

ORACLE["calibration_metrics"] = with_(RESPONSES) + f""",
cal AS (SELECT model, CAST({_BIN} AS INTEGER) AS bin, confidence / 100.0 AS c,
               CAST(is_correct AS DOUBLE) AS y
        FROM responses
        WHERE confidence IS NOT NULL AND is_correct IS NOT NULL AND model IS NOT NULL),
b AS (SELECT model, bin, count(*) AS n, avg(c) AS conf, avg(y) AS acc FROM cal GROUP BY model, bin),
e AS (SELECT model, sum(n * abs(conf - acc)) / sum(n) AS ece FROM b GROUP BY model)
SELECT cal.model, {f4('any_value(e.ece)')} AS ece,
       {f4('avg((c - y) * (c - y))')} AS brier_score,
       {f4('avg(c)')} AS avg_confidence, {f4('avg(y)')} AS avg_accuracy,
       {f4('avg(c) - avg(y)')} AS overconfidence
FROM cal JOIN e ON cal.model = e.model GROUP BY cal.model"""

# ---------------------------------------------------------------- reply parsing
_ANS_RE = "'(?i)answer:?\\s*([^\\n]+?)(?:\\n|$|confidence)'"
_STRIP = "'^\\s+|\\s+$'"
_MARKERS = " OR ".join(f"contains(lower(line), '{m}')" for m in
                       ["reasoning:", "step ", "thinking:", "first,", "second,", "third,"])
_UNC = " + ".join(f"(length(lower(t)) - length(replace(lower(t), '{w}', ''))) // {len(w)}"
                  for w in ["maybe", "perhaps", "possibly", "likely", "unlikely", "might",
                            "could", "not sure", "unclear"])
_STEPS = "'step \\d|first[,:]|second[,:]|third[,:]|finally[,:]'"

PARSED = f"""ex AS (
  SELECT *, CASE WHEN regexp_extract(raw_response, {_ANS_RE}, 1) <> ''
                 THEN regexp_replace(regexp_extract(raw_response, {_ANS_RE}, 1), {_STRIP}, '', 'g')
            END AS extracted,
         regexp_extract(lower(raw_response), 'confidence:?\\s*(\\d+)', 1) AS c
  FROM raw_responses),
lines AS (
  SELECT response_id, regexp_replace(raw_line, {_STRIP}, '', 'g') AS line, pos
  FROM (SELECT response_id, unnest(string_split(raw_response, chr(10))) AS raw_line,
               unnest(range(len(string_split(raw_response, chr(10))))) AS pos
        FROM raw_responses)),
flags AS (
  SELECT *, ({_MARKERS}) AS marker,
         (starts_with(line, 'confidence:') OR starts_with(line, 'answer:')) AS stop
  FROM lines),
st AS (
  SELECT *, coalesce(last_value(CASE WHEN marker THEN 1 WHEN stop THEN 0 END IGNORE NULLS)
           OVER (PARTITION BY response_id ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state
  FROM flags),
kept AS (
  SELECT response_id, string_agg(line, chr(10) ORDER BY pos) AS reasoning_text
  FROM st WHERE marker OR (state = 1 AND line <> '' AND NOT stop) GROUP BY response_id),
parsed AS (
  SELECT ex.*,
         CASE WHEN extracted IS NOT NULL
              THEN coalesce(list_filter(options, lambda o: contains(lower(extracted), lower(o)))[1],
                            extracted)
              ELSE coalesce(list_filter(options, lambda o: contains(raw_response, o))[1],
                            'Error: No clear answer') END AS llm_answer,
         CASE WHEN c = '' THEN NULL WHEN length(ltrim(c, '0')) = 0 THEN 0
              WHEN length(ltrim(c, '0')) > 3 THEN 100
              ELSE least(100, CAST(ltrim(c, '0') AS INTEGER)) END AS confidence,
         coalesce(kept.reasoning_text, '') AS reasoning_text
  FROM ex LEFT JOIN kept ON ex.response_id = kept.response_id),
graded AS (
  SELECT *, coalesce(llm_answer = correct_answer, false) AS is_correct,
         CASE WHEN t = '' THEN 0 ELSE length(t) END AS reasoning_length,
         CASE WHEN t = '' THEN 0
              ELSE greatest(1, len(regexp_extract_all(lower(t), {_STEPS}))) END AS steps_count,
         CASE WHEN t = '' THEN 0 ELSE {_UNC} END AS uncertainty_markers
  FROM (SELECT *, reasoning_text AS t FROM parsed))"""

ORACLE["extract_answer"] = with_(RAW_RESPONSES, PARSED) + "SELECT response_id, extracted FROM ex"
ORACLE["snap_to_option"] = with_(RAW_RESPONSES, PARSED) + """
SELECT response_id, CASE WHEN extracted IS NOT NULL THEN llm_answer END AS snapped FROM parsed"""
ORACLE["fallback_answer"] = with_(RAW_RESPONSES, PARSED) + "SELECT response_id, llm_answer FROM parsed"
ORACLE["extract_confidence"] = with_(RAW_RESPONSES, PARSED) + "SELECT response_id, confidence FROM parsed"
ORACLE["extract_reasoning"] = with_(RAW_RESPONSES, PARSED) + \
    "SELECT response_id, reasoning_text FROM parsed"
ORACLE["reasoning_metrics"] = with_(RAW_RESPONSES, PARSED) + """
SELECT response_id, CAST(reasoning_length AS INTEGER) AS reasoning_length,
       CAST(steps_count AS INTEGER) AS steps_count,
       CAST(uncertainty_markers AS INTEGER) AS uncertainty_markers FROM graded"""
ORACLE["grade_exact"] = with_(RAW_RESPONSES, PARSED) + f"""
SELECT response_id, model, question, distractor_set, correct_answer, llm_answer, is_correct,
       confidence, {f4('response_time')} AS response_time FROM graded"""
ORACLE["error_rows"] = with_(RAW_RESPONSES, PARSED) + f"""
SELECT response_id, model, distractor_set, err AS error,
       CASE WHEN err THEN 'Error' ELSE llm_answer END AS llm_answer,
       NOT err AND is_correct AS is_correct,
       CASE WHEN err THEN NULL ELSE confidence END AS confidence,
       CASE WHEN err THEN NULL ELSE {f4('response_time')} END AS response_time,
       CAST(CASE WHEN err THEN 0 ELSE reasoning_length END AS INTEGER) AS reasoning_length,
       CAST(CASE WHEN err THEN 0 ELSE steps_count END AS INTEGER) AS steps_count,
       CAST(CASE WHEN err THEN 0 ELSE uncertainty_markers END AS INTEGER) AS uncertainty_markers
FROM (SELECT *, starts_with(raw_response, 'Error:') AS err FROM graded)"""
ORACLE["parse_metrics_column"] = with_(RAW_RESPONSES, PARSED) + """
SELECT response_id,
       CAST(CASE WHEN response_id % 2 = 0 THEN reasoning_length ELSE 0 END AS INTEGER) AS reasoning_length,
       CAST(CASE WHEN response_id % 2 = 0 THEN steps_count ELSE 0 END AS INTEGER) AS steps_count,
       CAST(CASE WHEN response_id % 2 = 0 THEN uncertainty_markers ELSE 0 END AS INTEGER)
         AS uncertainty_markers
FROM graded"""
_RT = f"""rt AS (
  SELECT response_id, model, distractor_set, is_correct, {f4('response_time')} AS response_time,
         CAST(reasoning_length AS INTEGER) AS reasoning_length,
         CAST(steps_count AS INTEGER) AS steps_count,
         CAST(uncertainty_markers AS INTEGER) AS uncertainty_markers,
         response_time / greatest(steps_count, 1) AS time_per_step
  FROM graded WHERE length(reasoning_text) > 0)"""
ORACLE["reasoning_table"] = with_(RAW_RESPONSES, PARSED, _RT) + f"""
SELECT * REPLACE ({f4('time_per_step')} AS time_per_step) FROM rt"""
ORACLE["reasoning_by_outcome"] = with_(RAW_RESPONSES, PARSED, _RT) + f"""
SELECT model, steps_count, uncertainty_markers, count(*) AS n,
       {f4('avg(CAST(is_correct AS DOUBLE))')} AS accuracy,
       {f4('avg(time_per_step)')} AS avg_time_per_step
FROM rt GROUP BY model, steps_count, uncertainty_markers"""

# ---------------------------------------------------------------- inference
_LONG = """long AS (
  SELECT model, dependent_var, distractor_set AS level, v FROM (
    SELECT model, distractor_set, 'accuracy' AS dependent_var, CAST(is_correct AS DOUBLE) AS v
    FROM responses
    UNION ALL SELECT model, distractor_set, 'confidence', CAST(confidence AS DOUBLE) FROM responses
    UNION ALL SELECT model, distractor_set, 'response_time', response_time FROM responses)
  WHERE v IS NOT NULL AND model IS NOT NULL AND distractor_set IS NOT NULL),
g AS (
  SELECT *, avg(v) OVER (PARTITION BY model, dependent_var, level) AS gm,
         avg(v) OVER (PARTITION BY model, dependent_var) AS grand,
         count(*) OVER (PARTITION BY model, dependent_var) AS nn
  FROM long),
parts AS (
  SELECT model, dependent_var, any_value(nn) AS N, count(DISTINCT level) AS k,
         sum((gm - grand) * (gm - grand)) AS ssb, sum((v - gm) * (v - gm)) AS ssw
  FROM g GROUP BY model, dependent_var)"""

ORACLE["anova_oneway"] = with_(RESPONSES, _LONG) + f"""
SELECT model, dependent_var, source, {f4('ss')} AS ss, df, {f4('ms')} AS ms, {f4('f')} AS f,
       {f4('np2')} AS np2, status
FROM (
  SELECT model, dependent_var, 'distractor_set' AS source, ssb AS ss, CAST(k - 1 AS BIGINT) AS df,
         CASE WHEN k > 1 THEN ssb / (k - 1) END AS ms,
         CASE WHEN k >= 2 AND N - k > 0 AND ssw <> 0 THEN (ssb / (k - 1)) / (ssw / (N - k)) END AS f,
         CASE WHEN ssb + ssw <> 0 THEN ssb / (ssb + ssw) END AS np2,
         CASE WHEN k < 2 THEN 'single_level' WHEN N - k <= 0 THEN 'no_within_df'
              WHEN ssw = 0 THEN 'no_within_variance' ELSE 'ok' END AS status
  FROM parts
  UNION ALL
  SELECT model, dependent_var, 'Within', ssw, CAST(N - k AS BIGINT),
         CASE WHEN N - k > 0 THEN ssw / (N - k) END, NULL, NULL,
         CASE WHEN k < 2 THEN 'single_level' WHEN N - k <= 0 THEN 'no_within_df'
              WHEN ssw = 0 THEN 'no_within_variance' ELSE 'ok' END
  FROM parts)"""

ORACLE["anova_error_isolated"] = with_(RESPONSES) + f""",
long AS (
  SELECT model, distractor_set AS level, 'accuracy' AS dependent_var, CAST(is_correct AS DOUBLE) AS v
  FROM responses
  UNION ALL SELECT model, distractor_set, 'n_options', 4.0 FROM responses),
g AS (
  SELECT *, avg(v) OVER (PARTITION BY model, dependent_var, level) AS gm,
         avg(v) OVER (PARTITION BY model, dependent_var) AS grand,
         count(*) OVER (PARTITION BY model, dependent_var) AS nn
  FROM long WHERE v IS NOT NULL),
parts AS (
  SELECT model, dependent_var, any_value(nn) AS N, count(DISTINCT level) AS k,
         sum((gm - grand) * (gm - grand)) AS ssb, sum((v - gm) * (v - gm)) AS ssw
  FROM g GROUP BY model, dependent_var)
SELECT model, dependent_var,
       CASE WHEN k < 2 THEN 'single_level' WHEN N - k <= 0 THEN 'no_within_df'
            WHEN ssw = 0 THEN 'no_within_variance' ELSE 'ok' END AS status,
       {f4('CASE WHEN k >= 2 AND N - k > 0 AND ssw <> 0 THEN (ssb / (k - 1)) / (ssw / (N - k)) END')} AS f
FROM parts"""

ORACLE["tukey_hsd"] = with_(RESPONSES, _LONG) + f""",
gs AS (SELECT model, dependent_var, level, count(*) AS n, avg(v) AS m, var_samp(v) AS var
       FROM long GROUP BY ALL),
pp AS (SELECT a.model, a.dependent_var, a.level AS A, b.level AS B, a.n AS nA, b.n AS nB,
              a.m AS mA, b.m AS mB, a.var AS vA, b.var AS vB, parts.ssw / (parts.N - parts.k) AS msw
       FROM gs a JOIN gs b ON a.model = b.model AND a.dependent_var = b.dependent_var AND a.level < b.level
       JOIN parts ON parts.model = a.model AND parts.dependent_var = a.dependent_var)
SELECT model, dependent_var, A, B, {f4('mA')} AS mean_a, {f4('mB')} AS mean_b, {f4('mA - mB')} AS diff,
       {f4('sqrt(msw * (1.0 / nA + 1.0 / nB))')} AS se,
       {f4('(mA - mB) / sqrt(msw * (1.0 / nA + 1.0 / nB))')} AS t,
       {f4('(mA - mB) / sqrt(((nA - 1) * coalesce(vA, 0) + (nB - 1) * coalesce(vB, 0)) / (nA + nB - 2)) * (1 - 3.0 / (4.0 * (nA + nB) - 9))')} AS hedges
FROM pp"""

# F tail with an even number d1 = 4 of numerator degrees (five sets), in closed form:
# with x = d2 / (d2 + 4 f), p = x^(d2/2) * (1 + d2/2 * (1 - x))
_F = "((ssb / (k - 1)) / (ssw / (N - k)))"
_X = f"((N - k) / ((N - k) + 4.0 * {_F}))"
_P = f"CASE WHEN k = 5 AND N > k AND ssw <> 0 THEN pow({_X}, (N - k) / 2.0) * (1 + (N - k) / 2.0 * (1 - {_X})) END"

ORACLE["anova_pvalues"] = (
    "SELECT t.*, " + f4("CASE WHEN t.source <> 'Within' THEN p.p END") + " AS p_unc FROM ("
    + ORACLE["anova_oneway"] + ") t JOIN (" + with_(RESPONSES, _LONG)
    + f" SELECT model, dependent_var, {_P} AS p FROM parts) p USING (model, dependent_var)")

ORACLE["tukey_gated"] = (
    "SELECT t.* FROM (" + ORACLE["tukey_hsd"] + ") t JOIN (" + with_(RESPONSES, _LONG)
    + f" SELECT model, dependent_var, {_P} AS p FROM parts) p USING (model, dependent_var) WHERE p.p < 0.05")

# ---------------------------------------------------------------- text quality
from optiq.operators.textsim import PUNCTUATION as _PUNCT  # noqa: E402

_TOK = "list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')"
_TOKRAW = "list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"
_LEXICON = "['the', 'of', 'and', 'de', 'la', 'der', 'to', 'in']"


def _on(a: str, b: str, keys) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def treebank_sql(x: str) -> str:
    """Treebank tokens by the same ordered rewrites."""
    from optiq.operators.textsim import TREEBANK, TREEBANK_ENDS

    def rewritten(t, rules):
        for pattern, by in rules:
            t = "regexp_replace({}, '{}', '{}', 'g')".format(t, pattern.replace("'", "''"), by.replace("'", "''"))
        return t

    spaced = f"(' ' || {rewritten(x, TREEBANK)} || ' ')"
    return _TOK.format(x=rewritten(spaced, TREEBANK_ENDS))


def meteor_sql(src: str, keys, name: str, tokens=None, more: str = "") -> str:
    """METEOR of ``src``; ``more`` adds matches to those of equal tokens."""
    k = ", ".join(keys)
    tok_h = tokens("hypothesis") if tokens else _TOK.format(x="hypothesis")
    tok_r = tokens("reference") if tokens else _TOK.format(x="reference")
    return f"""{name}_h AS (
  SELECT {k}, unnest(tl) AS tok, unnest(range(len(tl))) AS tpos FROM (SELECT {k}, {tok_h} AS tl FROM {src})),
{name}_r AS (
  SELECT {k}, unnest(tl) AS tok, unnest(range(len(tl))) AS tpos FROM (SELECT {k}, {tok_r} AS tl FROM {src})),
{name}_ho AS (SELECT *, row_number() OVER (PARTITION BY {k}, tok ORDER BY tpos DESC) AS occ FROM {name}_h),
{name}_ro AS (SELECT *, row_number() OVER (PARTITION BY {k}, tok ORDER BY tpos DESC) AS occ FROM {name}_r),
{name}_e AS (
  SELECT {", ".join("h." + x for x in keys)}, h.tpos AS h_pos, r.tpos AS r_pos
  FROM {name}_ho h JOIN {name}_ro r ON {_on("h", "r", keys)} AND h.tok = r.tok AND h.occ = r.occ),
{more}{name}_m AS (SELECT * FROM {name}_e{f" UNION ALL SELECT * FROM {name}_more" if more else ""}),
{name}_c AS (
  SELECT {k}, count(*) AS m,
         sum(CASE WHEN lh IS NULL OR h_pos <> lh + 1 OR r_pos <> lr + 1 THEN 1 ELSE 0 END) AS chunks
  FROM (SELECT *, lag(h_pos) OVER (PARTITION BY {k} ORDER BY h_pos) AS lh,
               lag(r_pos) OVER (PARTITION BY {k} ORDER BY h_pos) AS lr FROM {name}_m)
  GROUP BY {k}),
{name}_len AS (SELECT {k}, len({tok_h}) AS h_len, len({tok_r}) AS r_len FROM {src}),
{name} AS (
  SELECT {", ".join("l." + x for x in keys)},
         CASE WHEN coalesce(c.m, 0) > 0 AND h_len > 0 AND r_len > 0 THEN
           (1 - 0.5 * pow(CAST(c.chunks AS DOUBLE) / c.m, 3.0))
           * ((CAST(c.m AS DOUBLE) / h_len) * (CAST(c.m AS DOUBLE) / r_len)
              / (0.9 * (CAST(c.m AS DOUBLE) / h_len) + 0.1 * (CAST(c.m AS DOUBLE) / r_len)))
         ELSE 0.0 END AS meteor
  FROM {name}_len l LEFT JOIN {name}_c c ON {_on("l", "c", keys)})"""


def lexicon_sql(x: str, lexicon: str = _LEXICON) -> str:
    punct = _PUNCT.replace("'", "''")
    toks = f"list_distinct(list_filter(string_split_regex(translate(lower({x}), '{punct}', ''), '\\s+'), lambda t: t <> ''))"
    return (f"CASE WHEN len({toks}) > 0 THEN CAST(len(list_intersect({toks}, {lexicon})) AS DOUBLE)"
            f" / len({toks}) ELSE 0.0 END")


def grammar_hits_sql(x: str) -> str:
    toks = _TOK.format(x=x)
    rules = ["'  '", "' [,.;:!?]'", "'^[a-z]'", "'[^.!?]$'"]
    counts = " + ".join(f"len(regexp_extract_all({x}, {r}))" for r in rules)
    rep = (f"CASE WHEN len({toks}) >= 2 THEN len(list_filter(range(2, len({toks}) + 1), "
           f"lambda i: ({toks})[i] = ({toks})[i - 1])) ELSE 0 END")
    return f"CAST({counts} + {rep} AS INTEGER)"


TEXT_DISTRACTORS = """text_distractors AS (
  SELECT doc_id, block, question, correct_answer, subject, distractor_set,
         unnest(distractors) AS distractor, unnest(range(len(distractors))) AS pos
  FROM text_items)"""

ORACLE["tokenize"] = with_(TEXT_PIECES) + f"""
SELECT doc_id, block, slot, CAST(len({_TOK.format(x='text')}) AS INTEGER) AS n_lower,
       CAST(len({_TOKRAW.format(x='text')}) AS INTEGER) AS n_raw,
       array_to_string(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s])', 1), ' ') AS punct_tokens
FROM text_pieces"""

ORACLE["lexicon_relevance"] = with_(TEXT_ITEMS, TEXT_DISTRACTORS) + f"""
SELECT question, pos, {f4(lexicon_sql('distractor'))} AS relevance FROM text_distractors"""

ORACLE["grammar_inverse"] = with_(TEXT_PIECES) + f"""
SELECT doc_id, block, slot, {grammar_hits_sql('text')} AS hits,
       {f4('1.0 / (1.0 + ' + grammar_hits_sql('text') + ')')} AS grammar_score
FROM text_pieces"""

_NTOK = f"len({_TOK.format(x='text')})"
ORACLE["grammar_ratio"] = with_(TEXT_PIECES) + f"""
SELECT doc_id, block, slot,
       {f4(f'CASE WHEN {_NTOK} > 0 THEN 1.0 - CAST(least({grammar_hits_sql("text")}, {_NTOK}) AS DOUBLE) / {_NTOK} ELSE 1.0 END')} AS grammar_score
FROM text_pieces"""

_COS = ("CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) <> 0 THEN "
        "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END")

ORACLE["cosine_to_answer"] = with_(VECTOR_SLOTS) + f"""
SELECT d.item_id, d.slot, d.distractor_set,
       {f4(_COS.format(a='a.vector', b='d.vector'))} AS similarity
FROM vector_slots d JOIN vector_slots a ON a.item_id = d.item_id AND a.slot = 0
WHERE d.slot > 0"""

ORACLE["mine_distractors"] = f"""
WITH v AS (SELECT vec_id, label, embedding, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS len FROM v),
best AS (SELECT q.vec_id AS item, c.vec_id AS candidate,
                round(max(list_dot_product(q.e, c.e) / (q.len * c.len)), 9) AS similarity
         FROM n q JOIN n c ON c.vec_id <> q.vec_id AND c.label IS DISTINCT FROM q.label AND c.embedding <> q.embedding
         GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY similarity DESC, candidate) AS INTEGER) AS rank
           FROM best)
SELECT item, rank, candidate, {f4("similarity")} AS similarity FROM ranked WHERE rank <= 9"""

ORACLE["diversity_pairwise"] = with_(VECTOR_SLOTS) + f""",
dv AS (SELECT * FROM vector_slots WHERE slot > 0 AND list_dot_product(vector, vector) > 0),
pr AS (SELECT a.item_id, avg({_COS.format(a='a.vector', b='b.vector')}) AS mc
       FROM dv a JOIN dv b ON a.item_id = b.item_id AND a.slot < b.slot GROUP BY a.item_id),
g AS (SELECT item_id, any_value(distractor_set) AS distractor_set, count(*) AS n FROM dv GROUP BY item_id)
SELECT g.item_id, g.distractor_set, g.n AS n_distractors,
       {f4('CASE WHEN g.n >= 2 THEN 1.0 - pr.mc ELSE 0.0 END')} AS diversity
FROM g LEFT JOIN pr ON g.item_id = pr.item_id"""

VECTOR_QUALITY = f"""vq_o AS (SELECT item_id AS question_id, slot, vector, distractor_set
              FROM vector_slots WHERE slot > 0),
vq_n AS (SELECT item_id - 1 AS question_id, slot, vector FROM vector_slots WHERE slot > 0),
vq_sem AS (SELECT o.question_id, avg({_COS.format(a='o.vector', b='n.vector')}) AS s
           FROM vq_o o JOIN vq_n n ON o.question_id = n.question_id AND o.slot = n.slot
           GROUP BY o.question_id),
vq_nz AS (SELECT * FROM vq_n WHERE list_dot_product(vector, vector) > 0),
vq_pr AS (SELECT a.question_id, avg({_COS.format(a='a.vector', b='b.vector')}) AS mc
          FROM vq_nz a JOIN vq_nz b ON a.question_id = b.question_id AND a.slot < b.slot
          GROUP BY a.question_id),
vq_cnt AS (SELECT question_id, count(*) AS n FROM vq_nz GROUP BY question_id),
vq_types AS (SELECT question_id, any_value(distractor_set) AS distractor_type FROM vq_o
             WHERE question_id IN (SELECT question_id FROM vq_n) GROUP BY question_id),
vector_quality AS (
  SELECT t.question_id, 'vec' || CAST(t.question_id AS VARCHAR) AS question, t.distractor_type,
         coalesce(vq_sem.s, 0.0) AS semantic_similarity,
         coalesce(CASE WHEN vq_cnt.n >= 2 THEN 1.0 - vq_pr.mc ELSE 0.0 END, 0.0) AS diversity_score
  FROM vq_types t LEFT JOIN vq_sem ON t.question_id = vq_sem.question_id
  LEFT JOIN vq_pr ON t.question_id = vq_pr.question_id
  LEFT JOIN vq_cnt ON t.question_id = vq_cnt.question_id)"""

ORACLE["cosine_paired"] = with_(VECTOR_SLOTS, VECTOR_QUALITY) + f"""
SELECT question, {f4('semantic_similarity')} AS semantic_similarity FROM vector_quality"""

ORACLE["meteor"] = with_(CONV_PAIRS, meteor_sql("conversation_pairs", ["conv_id", "turn"], "met")) + f"""
SELECT conv_id, turn, {f4('meteor')} AS meteor FROM met"""

_SHARE = " OR ".join(f"(length({{a}}) >= 5 AND length({{b}}) >= 5 AND {f}({{a}}, 3) = {f}({{b}}, 3))" for f in ("left", "right"))
_SYN = f"""syn_l AS (
  SELECT conv_id, turn, list({{{{'p': tpos, 't': tok}}}} ORDER BY tpos) FILTER (side = 'h') AS h,
         list({{{{'p': tpos, 't': tok}}}} ORDER BY tpos) FILTER (side = 'r') AS r
  FROM (SELECT 'h' AS side, x.* FROM syn_h x ANTI JOIN syn_e e ON x.conv_id = e.conv_id AND x.turn = e.turn AND x.tpos = e.h_pos
        UNION ALL
        SELECT 'r', x.* FROM syn_r x ANTI JOIN syn_e e ON x.conv_id = e.conv_id AND x.turn = e.turn AND x.tpos = e.r_pos)
  GROUP BY conv_id, turn HAVING h IS NOT NULL AND r IS NOT NULL),
syn_f AS (
  SELECT conv_id, turn, h, r, len(h) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS h_pos, CAST(NULL AS BIGINT) AS r_pos
  FROM syn_l
  UNION ALL
  SELECT conv_id, turn, h, r, i - 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END,
         CASE WHEN j IS NOT NULL THEN h[i].p END, j
  FROM (SELECT *, list_max(list_transform(list_filter(r, lambda x: NOT list_contains(used, x.p)
                     AND ({_SHARE.format(a='h[i].t', b='x.t')})), lambda x: x.p)) AS j
        FROM syn_f WHERE i > 0)),
syn_more AS (SELECT conv_id, turn, h_pos, r_pos FROM syn_f WHERE h_pos IS NOT NULL),
""".replace("{{", "{").replace("}}", "}")
ORACLE["meteor_synonym"] = with_(CONV_PAIRS, meteor_sql("conversation_pairs", ["conv_id", "turn"], "syn", more=_SYN)).replace(
    "WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT conv_id, turn, {f4('meteor')} AS meteor FROM syn"""
ORACLE["tokenize_treebank"] = with_(TEXT_PIECES) + f"""
SELECT doc_id, block, slot, array_to_string({treebank_sql('text')}, ' ') AS tokens FROM text_pieces"""

def _ngram_sql(n: int) -> str:
    """Clipped matches and number of the hypothesis' n-grams of each pair."""
    def grams(side):
        return f"""SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_transform(
            range(1, len({side}) - {n} + 2), lambda i: array_to_string({side}[i:i + {n} - 1], ' '))) AS g FROM pt) GROUP BY ALL"""
    return f"""h{n} AS ({grams('h')}), r{n} AS ({grams('r')}),
g{n} AS (SELECT pt.conv_id, pt.turn, greatest(0, coalesce(len(h), 0) - {n - 1}) AS total,
           coalesce((SELECT sum(least(a.c, b.c)) FROM h{n} a JOIN r{n} b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.g = b.g
                     WHERE a.conv_id = pt.conv_id AND a.turn = pt.turn), 0) AS matched FROM pt)"""


_PT = f"pt AS (SELECT conv_id, turn, {_TOK.format(x='hypothesis')} AS h, {_TOK.format(x='reference')} AS r FROM conversation_pairs)"
_NG = with_(CONV_PAIRS, _PT, *[_ngram_sql(n) for n in (1, 2, 3, 4)]) + """,
ng AS (SELECT pt.conv_id, pt.turn, coalesce(len(h), 0) AS hl, coalesce(len(r), 0) AS rl, """ + ", ".join(
    f"CAST(g{n}.matched AS DOUBLE) AS m{n}, CAST(g{n}.total AS DOUBLE) AS t{n}" for n in (1, 2, 3, 4)) + """
  FROM pt """ + " ".join(f"JOIN g{n} ON g{n}.conv_id = pt.conv_id AND g{n}.turn = pt.turn" for n in (1, 2, 3, 4)) + ")"
ORACLE["ngram_precision"] = _NG + "\nSELECT conv_id, turn, " + ", ".join(
    f4(f"CASE WHEN t{n} > 0 THEN m{n} / t{n} END") + f" AS precision_{n}" for n in (1, 2, 3, 4)) + ", " + f4(
    "CASE WHEN m1 > 0 THEN exp(least(0, 1 - CAST(rl AS DOUBLE) / hl) + (ln(m1 / t1) + "
    + " + ".join(f"ln((m{n} + 1) / (t{n} + 1))" for n in (2, 3, 4)) + ") / 4) ELSE 0.0 END") + " AS bleu FROM ng"
ORACLE["corpus_bleu"] = _NG + """,
w AS (SELECT turn % 2 AS after, count(*) AS n_pairs, sum(hl) AS hl, sum(rl) AS rl, """ + ", ".join(
    f"sum(m{n}) AS m{n}, sum(t{n}) AS t{n}" for n in (1, 2, 3, 4)) + " FROM ng GROUP BY 1)\nSELECT after, n_pairs, " + f4(
    "CASE WHEN m1 > 0 AND m2 > 0 AND m3 > 0 AND m4 > 0 THEN exp(least(0, 1 - CAST(rl AS DOUBLE) / hl) + ("
    + " + ".join(f"ln(m{n} / t{n})" for n in (1, 2, 3, 4)) + ") / 4) ELSE 0.0 END") + " AS bleu FROM w"
#: A row of the usual table at each step, for all pairs at once.
ORACLE["lcs_overlap"] = with_(CONV_PAIRS, _PT, """lcs AS (
  SELECT conv_id, turn, h, r, 1 AS i, list_transform(r, lambda x: 0) AS best FROM pt
  UNION ALL
  SELECT conv_id, turn, h, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: greatest(best[j], coalesce(list_max(
    list_transform(list_filter(hit, lambda k: k <= j), lambda k: 1 + CASE WHEN k > 1 THEN best[k - 1] ELSE 0 END)), 0)))
  FROM (SELECT *, list_filter(range(1, len(r) + 1), lambda k: r[k] = h[i]) AS hit FROM lcs WHERE i <= len(h)))""").replace(
    "WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT conv_id, turn, CAST(l AS BIGINT) AS lcs, {f4('coalesce(l / hl, 0.0)')} AS precision, {f4('coalesce(l / rl, 0.0)')} AS recall,
       {f4('CASE WHEN l > 0 THEN 2 * (l / hl) * (l / rl) / (l / hl + l / rl) ELSE 0.0 END')} AS f
FROM (SELECT conv_id, turn, CAST(coalesce(max(list_max(best)), 0) AS DOUBLE) AS l, nullif(len(any_value(h)), 0) AS hl,
             nullif(len(any_value(r)), 0) AS rl FROM lcs GROUP BY conv_id, turn)"""

ORACLE["meteor_max_ref"] = with_(TEXT_ITEMS, TEXT_DISTRACTORS, """mp AS (
  SELECT question, pos, correct_answer AS hypothesis, distractor AS reference FROM text_distractors)""",
    meteor_sql("mp", ["question", "pos"], "met")) + f"""
SELECT question, {f4('max(meteor)')} AS meteor FROM met GROUP BY question"""

TEXT_QUALITY = with_(TEXT_ITEMS, TEXT_DISTRACTORS, """tq_pairs AS (
  SELECT o.doc_id, o.block, o.pos, o.distractor AS reference, n.distractor AS hypothesis
  FROM text_distractors o JOIN text_distractors n
    ON o.doc_id = n.doc_id AND n.block = o.block + 1 AND o.pos = n.pos)""",
    meteor_sql("tq_pairs", ["doc_id", "block", "pos"], "tqm")) + f""",
tq_q AS (SELECT DISTINCT o.doc_id, o.block, o.question, o.subject, o.distractor_set
         FROM text_distractors o JOIN text_distractors n ON o.doc_id = n.doc_id AND n.block = o.block + 1),
tq_m AS (SELECT doc_id, block, avg(meteor) AS meteor_score FROM tqm GROUP BY doc_id, block),
tq_g AS (SELECT doc_id, block - 1 AS block, avg(1.0 / (1.0 + {grammar_hits_sql('distractor')})) AS grammar_score
         FROM text_distractors GROUP BY doc_id, block),
text_quality AS (
  SELECT q.question, q.doc_id, q.subject, q.distractor_set AS distractor_type,
         coalesce(tq_m.meteor_score, 0.0) AS meteor_score, coalesce(tq_g.grammar_score, 0.0) AS grammar_score
  FROM tq_q q LEFT JOIN tq_m ON q.doc_id = tq_m.doc_id AND q.block = tq_m.block
  LEFT JOIN tq_g ON q.doc_id = tq_g.doc_id AND q.block = tq_g.block)"""

_QPQ = TEXT_QUALITY + ",\n" + VECTOR_SLOTS + ",\n" + VECTOR_QUALITY + """,
qpq AS (
  SELECT t.question, t.subject, t.distractor_type, t.meteor_score, v.semantic_similarity,
         t.grammar_score, v.diversity_score
  FROM text_quality t LEFT JOIN vector_quality v
    ON v.question_id = t.doc_id % (SELECT max(item_id) FROM vector_slots))
"""

ORACLE["quality_per_question"] = _QPQ + f"""
SELECT question, subject, distractor_type, {f4('meteor_score')} AS meteor_score,
       {f4('semantic_similarity')} AS semantic_similarity, {f4('grammar_score')} AS grammar_score,
       {f4('diversity_score')} AS diversity_score FROM qpq"""

ORACLE["quality_agg"] = _QPQ + "SELECT distractor_type, " + ", ".join(
    f"{f4(f'avg({m})')} AS {m}_mean, {f4(f'stddev_samp({m})')} AS {m}_std"
    for m in ["meteor_score", "semantic_similarity", "grammar_score", "diversity_score"]) + \
    " FROM qpq GROUP BY distractor_type"

_NT = f"len({_TOK.format(x='distractor')})"
ITEM_VECTORS = VECTOR_SLOTS + f""",
lv_nz AS (SELECT * FROM vector_slots WHERE slot > 0 AND list_dot_product(vector, vector) > 0),
lv_p AS (SELECT a.item_id, avg({_COS.format(a='a.vector', b='b.vector')}) AS mc
         FROM lv_nz a JOIN lv_nz b ON a.item_id = b.item_id AND a.slot < b.slot GROUP BY a.item_id),
lv_d AS (SELECT item_id, CASE WHEN count(*) >= 2 THEN 1.0 - any_value(mc) ELSE 0.0 END AS diversity
         FROM lv_nz LEFT JOIN lv_p USING (item_id) GROUP BY item_id),
lv_c AS (SELECT a.item_id, d.slot, {_COS.format(a='a.vector', b='d.vector')} AS c
         FROM vector_slots a JOIN vector_slots d ON a.item_id = d.item_id AND a.slot = 0 AND d.slot > 0)"""
_LV_ITEM = "(SELECT max(item_id) + 1 FROM vector_slots)"
LEGACY = with_(RESPONSES, TEXT_ITEMS, TEXT_DISTRACTORS, ITEM_VECTORS, """lq_pairs AS (
  SELECT question, pos, correct_answer AS reference, distractor AS hypothesis FROM text_distractors)""",
    meteor_sql("lq_pairs", ["question", "pos"], "lqm", treebank_sql)) + f""",
legacy AS (
  SELECT o.question, o.distractor_set, o.legal_relevance_scores, o.grammar_scores, m.meteor_scores,
         s.semantic_scores, lv_d.diversity
  FROM (SELECT question, distractor_set, doc_id, avg({lexicon_sql('distractor')}) AS legal_relevance_scores,
               avg(CASE WHEN {_NT} > 0 THEN 1.0 - CAST(least({grammar_hits_sql('distractor')}, {_NT}) AS DOUBLE) / {_NT} ELSE 1.0 END) AS grammar_scores
        FROM text_distractors GROUP BY question, distractor_set, doc_id) o
  LEFT JOIN (SELECT item_id, avg(c) AS semantic_scores FROM lv_c GROUP BY item_id) s
    ON s.item_id = o.doc_id % {_LV_ITEM}
  LEFT JOIN lv_d ON lv_d.item_id = o.doc_id % {_LV_ITEM}
  LEFT JOIN (SELECT question, avg(meteor) AS meteor_scores FROM lqm GROUP BY question) m
    ON o.question = m.question),
ss AS (SELECT distractor_set, avg(CAST(is_correct AS DOUBLE)) * 100.0 AS accuracy,
              avg(response_time) AS response_time, count(*) AS n_responses
       FROM responses WHERE distractor_set IS NOT NULL GROUP BY distractor_set),
fan AS (SELECT ss.*, legacy.question, legacy.legal_relevance_scores, legacy.grammar_scores,
               legacy.meteor_scores, legacy.semantic_scores, legacy.diversity
        FROM ss LEFT JOIN legacy ON ss.distractor_set = legacy.distractor_set)
"""

ORACLE["quality_summary_row"] = LEGACY + f"""
SELECT question, distractor_set, {f4('legal_relevance_scores')} AS legal_relevance_scores,
       {f4('grammar_scores')} AS grammar_scores, {f4('meteor_scores')} AS meteor_scores,
       {f4('semantic_scores')} AS semantic_scores, {f4('diversity')} AS diversity FROM legacy"""

ORACLE["join_quality_fanout"] = LEGACY + f"""
SELECT distractor_set, question, {f4('accuracy')} AS accuracy, {f4('response_time')} AS response_time,
       {f4('meteor_scores')} AS meteor_scores, {f4('legal_relevance_scores')} AS legal_relevance_scores,
       {f4('grammar_scores')} AS grammar_scores, {f4('semantic_scores')} AS semantic_scores,
       {f4('diversity')} AS diversity FROM fan"""

ORACLE["fanout_means"] = LEGACY + f"""
SELECT {f4('avg(accuracy)')} AS average_accuracy, {f4('avg(response_time)')} AS average_response_time,
       'fanout' AS weighting FROM fan
UNION ALL
SELECT {f4('avg(accuracy)')}, {f4('avg(response_time)')}, 'per_set' FROM ss"""


def corr_sql(src: str, metrics) -> str:
    parts = []
    for a in metrics:
        for b in metrics:
            x = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            y = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            r = (f"CASE WHEN stddev_samp({x}) * stddev_samp({y}) <> 0 THEN covar_samp({x}, {y}) / "
                 f"(stddev_samp({x}) * stddev_samp({y})) END")
            parts.append(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {f4(r)} AS r FROM {src}")
    return "\nUNION ALL\n".join(parts)


_LEG_METRICS = ["accuracy", "response_time", "meteor_scores", "legal_relevance_scores", "grammar_scores",
                "semantic_scores", "diversity"]
ORACLE["corr_matrix_quality"] = LEGACY + corr_sql("fan", _LEG_METRICS)
ORACLE["argmax_abs"] = LEGACY + f""", c AS ({corr_sql("fan", _LEG_METRICS)}),
cc AS (SELECT * FROM c WHERE metric_a = 'accuracy' AND metric_b <> 'accuracy' AND r IS NOT NULL)
SELECT (SELECT metric_b FROM cc ORDER BY abs(r) DESC, metric_b DESC LIMIT 1) AS top_metric,
       (SELECT r FROM cc ORDER BY abs(r) DESC, metric_b DESC LIMIT 1) AS top_r,
       (SELECT metric_b FROM cc ORDER BY abs(r), metric_b LIMIT 1) AS lowest_metric,
       (SELECT r FROM cc ORDER BY abs(r), metric_b LIMIT 1) AS lowest_r"""
ORACLE["corr_matrix_metrics"] = _QPQ + corr_sql(
    "qpq", ["meteor_score", "semantic_similarity", "grammar_score", "diversity_score"])

# ---------------------------------------------------------------- reshape / charts
_DSTATS = """ds AS (
  SELECT model, distractor_set, avg(CAST(is_correct AS DOUBLE)) AS is_correct_mean,
         avg(confidence) AS confidence_mean, avg(response_time) AS response_time_mean,
         abs(avg(CAST(is_correct AS DOUBLE)) - avg(confidence) / 100.0) AS calibration_error
  FROM responses WHERE model IS NOT NULL AND distractor_set IS NOT NULL GROUP BY ALL)"""
_RLONG = """rl AS (
  SELECT question, distractor_set, model, 'confidence' AS metric, CAST(confidence AS DOUBLE) AS value
  FROM responses
  UNION ALL SELECT question, distractor_set, model, 'response_time', response_time FROM responses)"""

ORACLE["melt"] = with_(RESPONSES, _DSTATS) + f"""
SELECT model, distractor_set, metric, {f4('value')} AS value FROM ds
UNPIVOT INCLUDE NULLS (value FOR metric IN (is_correct_mean, confidence_mean, response_time_mean,
                                            calibration_error))"""

ORACLE["describe_by_group"] = with_(RESPONSES, _RLONG) + f"""
SELECT distractor_set, metric, count(value) AS count, {f4('avg(value)')} AS mean,
       {f4('stddev_samp(value)')} AS std, {f4('min(value)')} AS min, {f4('max(value)')} AS max,
       {f4('quantile_cont(value, 0.25)')} AS q25, {f4('quantile_cont(value, 0.5)')} AS q50,
       {f4('quantile_cont(value, 0.75)')} AS q75
FROM rl WHERE value IS NOT NULL GROUP BY distractor_set, metric"""

ORACLE["boxplot_stats"] = with_(RESPONSES) + f""",
q AS (SELECT model, distractor_set, count(response_time) AS count,
             quantile_cont(response_time, 0.25) AS q1, quantile_cont(response_time, 0.5) AS median,
             quantile_cont(response_time, 0.75) AS q3
      FROM responses WHERE response_time IS NOT NULL GROUP BY model, distractor_set),
j AS (SELECT r.model, r.distractor_set, r.response_time AS v, q.*,
             r.response_time >= q.q1 - 1.5 * (q.q3 - q.q1) AND r.response_time <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM responses r JOIN q ON r.model = q.model AND r.distractor_set = q.distractor_set
      WHERE r.response_time IS NOT NULL)
SELECT model, distractor_set, any_value(count) AS count, {f4('any_value(q1)')} AS q1,
       {f4('any_value(median)')} AS median, {f4('any_value(q3)')} AS q3,
       {f4('min(CASE WHEN inside THEN v END)')} AS whisker_low,
       {f4('max(CASE WHEN inside THEN v END)')} AS whisker_high,
       CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM j GROUP BY model, distractor_set"""

ORACLE["pivot_heatmap"] = with_(RESPONSES, _DSTATS) + f"""
SELECT distractor_set,
       {f4("max(CASE WHEN model = 'model_0' THEN is_correct_mean END)")} AS model_0,
       {f4("max(CASE WHEN model = 'model_1' THEN is_correct_mean END)")} AS model_1,
       {f4("max(CASE WHEN model = 'model_2' THEN is_correct_mean END)")} AS model_2
FROM ds GROUP BY distractor_set"""

ORACLE["pivot_mean"] = with_(RESPONSES, _RLONG) + f"""
SELECT * FROM (
  SELECT question, distractor_set,
         {f4("avg(CASE WHEN metric = 'confidence' THEN value END)")} AS confidence,
         {f4("avg(CASE WHEN metric = 'response_time' THEN value END)")} AS response_time
  FROM rl GROUP BY question, distractor_set)
WHERE confidence IS NOT NULL AND response_time IS NOT NULL"""

ORACLE["explode_list_metric"] = with_(TEXT_ITEMS) + """
SELECT question, CASE WHEN len(distractors) = 0 THEN NULL ELSE d END AS distractor
FROM (SELECT question, distractors,
             unnest(CASE WHEN len(distractors) = 0 THEN [NULL] ELSE distractors END) AS d
      FROM text_items)"""

ORACLE["explode_distractors"] = with_(TEXT_ITEMS) + """
SELECT question, CAST(i + 1 AS VARCHAR) AS key, d AS distractor
FROM (SELECT question, unnest(distractors) AS d, unnest(range(len(distractors))) AS i FROM text_items)"""

_ITEMS_CTE = ORACLE["item_analysis"]
ORACLE["item_scatter"] = "WITH ia AS (" + _ITEMS_CTE.replace("WITH ", "WITH ", 1) + ")\n" + """
SELECT question, subject, difficulty, discrimination, avg_response_time, avg_confidence,
       confidence_discrimination, difficulty > 0.5 AS hard, discrimination > 0.3 AS discriminating
FROM ia"""

ORACLE["calibration_compare"] = "WITH cm AS (" + ORACLE["calibration_metrics"] + ")\n" + \
    "SELECT model, ece, overconfidence FROM cm"

ORACLE["metric_bars"] = _QPQ + """,
qa AS (SELECT distractor_type, avg(meteor_score) AS meteor_score_mean,
              avg(semantic_similarity) AS semantic_similarity_mean,
              avg(grammar_score) AS grammar_score_mean, avg(diversity_score) AS diversity_score_mean
       FROM qpq GROUP BY distractor_type)
SELECT distractor_type, metric, """ + f4("value") + """ AS value FROM (
  SELECT distractor_type, 'Meteor Score' AS metric, meteor_score_mean AS value FROM qa
  UNION ALL SELECT distractor_type, 'Semantic Similarity', semantic_similarity_mean FROM qa
  UNION ALL SELECT distractor_type, 'Grammar Score', grammar_score_mean FROM qa
  UNION ALL SELECT distractor_type, 'Diversity Score', diversity_score_mean FROM qa)"""

ORACLE["quality_vs_accuracy"] = LEGACY + f"""
SELECT distractor_set, {f4('any_value(accuracy)')} AS accuracy,
       {f4('any_value(response_time)')} AS response_time,
       {f4('avg(meteor_scores)')} AS meteor_scores,
       {f4('avg(legal_relevance_scores)')} AS legal_relevance_scores,
       {f4('avg(grammar_scores)')} AS grammar_scores,
       {f4('avg(semantic_scores)')} AS semantic_scores, {f4('avg(diversity)')} AS diversity
FROM fan GROUP BY distractor_set"""

# ---------------------------------------------------------------- bank preparation
ORACLE["sample_exact_n"] = with_(TEXT_ITEMS) + """
SELECT question, subject FROM text_items ORDER BY md5('0|' || question), question LIMIT 150"""

ORACLE["sample_balanced"] = with_(TEXT_ITEMS) + """
SELECT question, subject FROM (
  SELECT question, subject,
         row_number() OVER (PARTITION BY subject ORDER BY md5('0|' || question), question) AS rk
  FROM text_items) WHERE rk <= 5"""

ORACLE["cycle_fill"] = with_(TEXT_ITEMS) + """
SELECT question, round FROM text_items
CROSS JOIN (SELECT unnest(range(greatest(1, 150 // (SELECT count(*) FROM text_items) + 1))) AS round)
ORDER BY round, md5('0|' || CAST(round AS VARCHAR) || '|' || question), question LIMIT 150"""

ORACLE["replicate_bank"] = with_(TEXT_ITEMS) + """
SELECT question, CAST(copy AS INTEGER) AS copy FROM text_items CROSS JOIN range(1, 4) AS t(copy)"""

ORACLE["union_subjects"] = with_(TEXT_ITEMS) + """
SELECT question, subject, lang FROM text_items WHERE lang = 'en'
UNION ALL SELECT question, subject, lang FROM text_items WHERE lang IS DISTINCT FROM 'en'"""

ASSEMBLED = """assembled AS (
  SELECT *, list_transform(
           list_sort(list_transform(
             CASE WHEN list_contains(coalesce(options, distractors), correct_answer)
                  THEN coalesce(options, distractors)
                  ELSE list_append(coalesce(options, distractors), correct_answer) END,
             lambda o: {'h': md5('0|' || question || '|' || o), 'o': o})),
           lambda s: s.o) AS presented_options
  FROM text_items)"""

ORACLE["assemble_options"] = with_(TEXT_ITEMS, ASSEMBLED) + """
SELECT question, array_to_string(presented_options, ' | ') AS presented_options FROM assembled"""

PLAN = """plan0 AS (
  SELECT *, 'original' AS plan_set FROM assembled
  UNION ALL SELECT *, distractor_set AS plan_set FROM assembled),
plan AS (
  SELECT p.*, m.model,
         row_number() OVER (PARTITION BY plan_set, model ORDER BY doc_id, block) <= 5 AS request_reasoning
  FROM plan0 p CROSS JOIN (SELECT unnest(['model_0', 'model_1', 'model_2']) AS model) m)"""

ORACLE["build_eval_plan"] = with_(TEXT_ITEMS, ASSEMBLED, PLAN) + """
SELECT question, plan_set, model, request_reasoning FROM plan"""

_PR = ("Please think through this step-by-step before answering. "
       "First provide your reasoning, then clearly state your final answer.' || chr(10) || chr(10) || '"
       "Please end your response with:' || chr(10) || '"
       "Answer: [exact text of your chosen option]' || chr(10) || '"
       "Confidence: [0-100] (your confidence in this answer)' || chr(10) || '")
_PS = ("Respond with your answer choice exactly as it appears in the options.' || chr(10) || '"
       "Also rate your confidence from 0-100, where 100 means absolutely certain.' || chr(10) || chr(10) || '"
       "Format: Answer: [your answer]' || chr(10) || 'Confidence: [0-100]' || chr(10) || '")
ORACLE["score_with"] = with_(TEXT_ITEMS, ASSEMBLED, PLAN) + """
SELECT question || '|' || plan_set || '|' || model AS response_id,
       CASE WHEN length(question) % 11 <> 0 THEN 'Answer: ' || presented_options[1 + length(question) % len(presented_options)]
         || chr(10) || 'Confidence: ' || CAST(50 + length(question) % 50 AS VARCHAR) END AS raw_response,
       CASE WHEN length(question) % 11 = 0 THEN 'RuntimeError: no answer' END AS error FROM plan"""
ORACLE["format_prompt"] = with_(TEXT_ITEMS, ASSEMBLED, PLAN) + f"""
SELECT question, plan_set, model,
       'Question: ' || question || chr(10) || 'Options: ' || array_to_string(presented_options, ', ')
       || chr(10) || chr(10)
       || CASE WHEN request_reasoning THEN '{_PR}' ELSE '{_PS}' END AS prompt
FROM plan"""



def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


from optiq.operators.bank import PROMPT_GENERATE as _PG, PROMPT_LEGACY as _PL  # noqa: E402

ORACLE["prompt_styles"] = with_(TEXT_ITEMS, ASSEMBLED) + f"""
SELECT question, {_quoted(_PL[0] + _PL[1])} || question || {_quoted(_PL[2])}
         || array_to_string(presented_options, ', ') || {_quoted(_PL[3])} AS legacy,
       {_quoted(_PG[0])} || CAST(len(distractors) AS VARCHAR) || {_quoted(_PG[1])} || question
         || {_quoted(_PG[2])} || correct_answer || {_quoted(_PG[3])} AS generate
FROM assembled"""

_GL = ("list_filter(list_transform(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)), "
       "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:9]")
ORACLE["parse_generated_lines"] = f"""
SELECT conv_id, turn, CAST(len({_GL}) AS INTEGER) AS n_lines, array_to_string({_GL}, ' | ') AS lines
FROM conversations"""

ORACLE["strip_enumeration"] = """
SELECT conv_id, turn, CAST(line_no AS INTEGER) AS line_no,
       regexp_replace(line, '^\\d+[.)]\\s*', '') AS line
FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS line_no FROM conversations)"""

_PICK_IDX = "(CAST(('0x' || substr(md5('{seed}|' || question), 1, 8)) AS BIGINT) % len({pool})) + 1"
ORACLE["pool_pick"] = with_(TEXT_ITEMS) + f"""
SELECT question,
       CASE WHEN len(distractors[1:4]) > 0
            THEN (distractors[1:4])[{_PICK_IDX.format(seed='weak', pool='distractors[1:4]')}] END AS weak,
       CASE WHEN len(distractors[5:9]) > 0
            THEN (distractors[5:9])[{_PICK_IDX.format(seed='moderate', pool='distractors[5:9]')}] END AS moderate
FROM text_items"""

# ---------------------------------------------------------------- joins and dedupe
BENCH_PIECES = f"""bench_pieces AS (
  SELECT item_id, pos, correct_answer FROM (
    SELECT item_id, regexp_replace(t, {_WS}, '', 'g') AS correct_answer, pos
    FROM (SELECT item_id, unnest(regexp_split_to_array(text, '\\. |\\n')) AS t,
                 unnest(range(len(regexp_split_to_array(text, '\\. |\\n')))) AS pos FROM benchmark))
  WHERE correct_answer <> '')"""

ORACLE["dedupe_first"] = with_(TEXT_ITEMS) + """
SELECT correct_answer, arg_min(question, (doc_id, block)) AS question FROM text_items GROUP BY correct_answer"""
ORACLE["dedupe_last"] = with_(TEXT_ITEMS) + """
SELECT correct_answer, arg_max(question, (doc_id, block)) AS question FROM text_items GROUP BY correct_answer"""
ORACLE["join_reference_answers"] = with_(TEXT_ITEMS, BENCH_PIECES) + """
SELECT t.question, t.correct_answer, r.item_id AS ref_item_id FROM text_items t
JOIN (SELECT correct_answer, arg_max(item_id, (item_id, pos)) AS item_id FROM bench_pieces GROUP BY ALL) r
  ON t.correct_answer = r.correct_answer"""
ORACLE["join_original_first"] = with_(TEXT_ITEMS, BENCH_PIECES) + """
SELECT t.question, t.correct_answer, r.item_id AS orig_item_id FROM text_items t
JOIN (SELECT correct_answer, arg_min(item_id, (item_id, pos)) AS item_id FROM bench_pieces GROUP BY ALL) r
  ON t.correct_answer = r.correct_answer"""
ORACLE["unmatched_questions"] = with_(TEXT_ITEMS, BENCH_PIECES) + """
SELECT question FROM text_items t
WHERE NOT EXISTS (SELECT 1 FROM bench_pieces b WHERE b.correct_answer = t.correct_answer)"""
ORACLE["join_index"] = with_(RESPONSES) + f"""
SELECT a.distractor_set, {f4('a.accuracy')} AS accuracy, {f4('b.response_time')} AS response_time
FROM (SELECT distractor_set, avg(CAST(is_correct AS DOUBLE)) * 100.0 AS accuracy FROM responses GROUP BY ALL) a
LEFT JOIN (SELECT distractor_set, avg(response_time) AS response_time FROM responses GROUP BY ALL) b
  ON a.distractor_set = b.distractor_set"""
ORACLE["value_counts_top1"] = with_(RESPONSES) + """
SELECT question, llm_answer AS top_llm_answer, n AS top_count FROM (
  SELECT question, llm_answer, n,
         row_number() OVER (PARTITION BY question ORDER BY n DESC, llm_answer) AS rk
  FROM (SELECT question, llm_answer, count(*) AS n FROM responses
        WHERE NOT is_correct AND llm_answer IS NOT NULL GROUP BY ALL)) WHERE rk = 1"""
ORACLE["conditional_mean"] = with_(RESPONSES) + f"""
SELECT question, {f4('avg(CASE WHEN is_correct THEN confidence END)')} AS confidence_when_true,
       {f4('avg(CASE WHEN NOT is_correct THEN confidence END)')} AS confidence_when_false
FROM responses GROUP BY question"""
ORACLE["nunique"] = with_(RESPONSES) + """
SELECT question, count(DISTINCT is_correct) AS n_distinct_outcomes FROM responses GROUP BY question"""
ORACLE["first_value"] = with_(RESPONSES) + """
SELECT question, arg_min(subject, response_id) AS subject FROM responses GROUP BY question"""

# ---------------------------------------------------------------- sources / sinks
ORACLE["scan_items"] = with_(TEXT_ITEMS) + """
SELECT question, correct_answer, array_to_string(distractors, ' | ') AS options, subject
FROM text_items"""
ORACLE["scan_distractor_sets"] = with_(TEXT_ITEMS) + """
SELECT question, distractor_set, CAST(len(distractors) AS INTEGER) AS n_distractors FROM text_items"""
ORACLE["load_results"] = with_(RAW_RESPONSES, PARSED) + f"""
SELECT model, distractor_set, question, correct_answer, llm_answer || ' "so",' || chr(10) || 'then' AS llm_answer,
       is_correct, confidence, {f4('response_time')} AS response_time
FROM graded"""
ORACLE["load_results_envelope"] = with_(RAW_RESPONSES, PARSED) + f"""
SELECT model, distractor_set, question, correct_answer, llm_answer || ' }}{{"so",' || chr(10) || '[then]' AS llm_answer,
       is_correct, confidence, {f4('response_time')} AS response_time, CAST(steps_count AS INTEGER) AS steps_count
FROM graded"""
ORACLE["scan_split_csv_pair"] = with_(TEXT_ITEMS, ASSEMBLED) + """,
placed AS (SELECT *, coalesce(subject, 'none') AS s,
                  row_number() OVER (PARTITION BY coalesce(subject, 'none') ORDER BY question) - 1 AS pos,
                  max(question) OVER (PARTITION BY coalesce(subject, 'none')) AS last FROM assembled)
SELECT s AS subject, pos, question, array_to_string(presented_options, ' | ') AS options, correct_answer
FROM placed WHERE question <> last AND len(presented_options) >= 4"""
ORACLE["scan_reading_sets"] = with_(TEXT_ITEMS) + """
SELECT question || ' / ' || correct_answer AS passage, question, correct_answer,
       CAST(len(distractors) AS INTEGER) AS n_distractors FROM text_items"""
ORACLE["scan_tolerant"] = with_(TEXT_ITEMS) + """
SELECT CASE WHEN block % 2 = 0 THEN question ELSE '{"question": "' || question END AS question,
       block % 2 = 0 AS good FROM text_items"""
ORACLE["gate_dataset"] = with_(TEXT_ITEMS) + """
SELECT CAST(sum(CASE WHEN question IS NOT NULL AND correct_answer IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS valid_rows,
       CAST(sum(CASE WHEN question IS NOT NULL AND correct_answer IS NOT NULL THEN 0 ELSE 1 END) AS BIGINT) AS invalid_rows,
       sum(CASE WHEN question IS NOT NULL AND correct_answer IS NOT NULL THEN 1 ELSE 0 END) >= 5 AS usable
FROM text_items"""

# ---------------------------------------------------------------- helpers as queries
ORACLE["item_discrimination"] = with_(RESPONSES) + f""",
scored AS (SELECT *, avg(CAST(is_correct AS DOUBLE)) OVER (PARTITION BY model) AS overall_score
           FROM responses WHERE question IS NOT NULL AND model IS NOT NULL)
SELECT question,
       {f4('''CASE WHEN count(*) > 1 AND count(DISTINCT is_correct) > 1 AND stddev_samp(overall_score) > 0
              THEN covar_samp(CAST(is_correct AS DOUBLE), overall_score)
                   / (stddev_samp(CAST(is_correct AS DOUBLE)) * stddev_samp(overall_score)) END''')} AS discrimination
FROM scored GROUP BY question"""

ORACLE["list_mean"] = with_(TEXT_ITEMS) + f"""
SELECT question, {f4('list_avg(list_transform(distractors, lambda d: CAST(length(d) AS DOUBLE)))')} AS mean_distractor_length
FROM text_items"""

ORACLE["array_except"] = with_(TEXT_ITEMS, ASSEMBLED) + """
SELECT question, CAST(len(list_filter(presented_options, lambda o: o <> correct_answer)) AS INTEGER) AS n_wrong,
       array_to_string(list_filter(presented_options, lambda o: o <> correct_answer), ' | ') AS wrong_options
FROM assembled"""

ORACLE["zip_positional"] = with_(TEXT_ITEMS) + """
SELECT o.question, CAST(least(len(o.distractors), len(n.distractors)) AS INTEGER) AS n_pairs,
       array_to_string(list_transform(range(1, least(len(o.distractors), len(n.distractors)) + 1),
                       lambda i: o.distractors[i] || ' -> ' || n.distractors[i]), ' | ') AS pairs
FROM text_items o JOIN text_items n ON o.doc_id = n.doc_id AND n.block = o.block + 1"""

ORACLE["set_trend"] = with_(RESPONSES) + f"""
SELECT distractor_set, {f4('accuracy')} AS accuracy, {f4('response_time')} AS response_time, n_responses,
       CAST(rank() OVER (ORDER BY accuracy DESC) AS INTEGER) AS accuracy_rank
FROM (SELECT distractor_set, avg(CAST(is_correct AS DOUBLE)) * 100.0 AS accuracy,
             avg(response_time) AS response_time, count(*) AS n_responses
      FROM responses WHERE distractor_set IS NOT NULL GROUP BY distractor_set)"""

ORACLE["scan_summary_maps"] = with_(RESPONSES) + f"""
SELECT distractor_set, {f4('avg(CAST(is_correct AS DOUBLE)) * 100.0')} AS accuracy,
       {f4('avg(response_time)')} AS response_time
FROM responses WHERE distractor_set IS NOT NULL GROUP BY distractor_set"""

ORACLE["normalize_json"] = with_(RAW_RESPONSES, PARSED) + """
SELECT response_id, CAST(reasoning_length AS INTEGER) AS "reasoning_metrics.reasoning_length",
       CAST(steps_count AS INTEGER) AS "reasoning_metrics.steps_count",
       CAST(uncertainty_markers AS INTEGER) AS "reasoning_metrics.uncertainty_markers"
FROM graded"""

ORACLE["distinct_values"] = with_(RESPONSES) + """
SELECT DISTINCT 'model' AS "column", model AS value FROM responses
UNION ALL SELECT DISTINCT 'distractor_set', distractor_set FROM responses"""

ORACLE["json_extract"] = """
SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1') AS k,
       coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events"""

ORACLE["cross_models"] = with_(TEXT_ITEMS) + """
SELECT m.model, distractor_set, count(*) AS n_calls
FROM text_items CROSS JOIN (SELECT unnest(['model_0', 'model_1', 'model_2']) AS model) m
GROUP BY m.model, distractor_set"""

ORACLE["parse_csv_line"] = with_(TEXT_ITEMS, ASSEMBLED) + """
SELECT question AS item, question, array_to_string(presented_options, ' | ') AS options,
       correct_answer
FROM assembled WHERE len(presented_options) >= 4"""

ORACLE["sink_parquet"] = with_(RAW_RESPONSES, PARSED) + f"""
SELECT model, distractor_set, count(*) AS n, CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) AS n_correct,
       {f4('avg(confidence)')} AS avg_confidence
FROM graded GROUP BY model, distractor_set"""

_F4L = ("array_to_string(list_transform({x}, lambda v: CAST(CAST(round("
        "CAST(CAST(v AS FLOAT) AS DOUBLE) * 1e7) AS BIGINT) AS VARCHAR)), ',')")
ORACLE["quality_legacy"] = with_(TEXT_ITEMS, TEXT_DISTRACTORS, ITEM_VECTORS, """lq_pairs AS (
  SELECT question, pos, correct_answer AS reference, distractor AS hypothesis FROM text_distractors)""",
    meteor_sql("lq_pairs", ["question", "pos"], "lqm", treebank_sql)) + f""",
per AS (
  SELECT t.question, t.distractor_set, t.doc_id, t.pos, m.meteor,
         {lexicon_sql('t.distractor')} AS lex,
         CASE WHEN len({_TOK.format(x='t.distractor')}) > 0
              THEN 1.0 - CAST(least({grammar_hits_sql('t.distractor')}, len({_TOK.format(x='t.distractor')})) AS DOUBLE)
                   / len({_TOK.format(x='t.distractor')}) ELSE 1.0 END AS gram
  FROM text_distractors t JOIN lqm m ON t.question = m.question AND t.pos = m.pos)
SELECT question, distractor_set,
       {_F4L.format(x='list(meteor ORDER BY pos)')} AS meteor_scores,
       {_F4L.format(x='list(lex ORDER BY pos)')} AS legal_relevance_scores,
       {_F4L.format(x='list(gram ORDER BY pos)')} AS grammar_scores,
       any_value(s.semantic_scores) AS semantic_scores, {f4('any_value(lv_d.diversity)')} AS diversity
FROM per LEFT JOIN (SELECT item_id, {_F4L.format(x='list(c ORDER BY slot)')} AS semantic_scores
                    FROM lv_c GROUP BY item_id) s ON s.item_id = per.doc_id % {_LV_ITEM}
LEFT JOIN lv_d ON lv_d.item_id = per.doc_id % {_LV_ITEM}
GROUP BY question, distractor_set"""
