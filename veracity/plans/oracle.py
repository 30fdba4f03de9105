"""DuckDB oracle SQL for every query of ``plans/catalog.py``.

Written against the same driver tables (pre-registered views) and importing
nothing from the Spark code; the rules of the operators and of the derived
views are stated again here.  Python string helpers below only spell out
repeated SQL fragments (Python ``strip`` / ``find`` / slicing rules).
"""

from __future__ import annotations

# Whitespace as Python's str.strip() knows it, as a regex class.
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)

ORACLE: dict[str, str] = {}


def rnd(e: str) -> str:
    """6-place rounding in plain IEEE steps (same bits as the Spark side)."""
    scale = f"power(10.0, floor(log10(abs({e}))) - 11)"
    return (f"(CASE WHEN abs({e}) < 4e9 THEN floor(({e}) * 1e6 + 0.5) / 1e6 "
            f"ELSE floor(({e}) / {scale} + 0.5) * {scale} END)")


def strip(e: str) -> str:
    return f"regexp_replace({e}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def find(e: str, m: str) -> str:
    return f"(instr({e}, '{m}') - 1)"


def norm(e: str, v: str | None, default: str) -> str:
    if v is None:
        return default
    return f"(CASE WHEN ({v}) < 0 THEN greatest(length({e}) + ({v}), 0) ELSE least(({v}), length({e})) END)"


def pyslice(e: str, a: str | None, b: str | None) -> str:
    aa, bb = norm(e, a, "0"), norm(e, b, f"length({e})")
    return f"(CASE WHEN {bb} > {aa} THEN substring({e}, {aa} + 1, {bb} - {aa}) ELSE '' END)"


def single_number(e: str) -> str:
    runs = f"regexp_extract_all({e}, '([0-9]+)', 1)"
    return f"(CASE WHEN len({runs}) = 1 THEN try_cast({runs}[1] AS DOUBLE) ELSE 0.0 END)"


def rfind(e: str, m: str) -> str:
    return (f"(CASE WHEN instr(reverse({e}), '{m[::-1]}') > 0 "
            f"THEN length({e}) - instr(reverse({e}), '{m[::-1]}') - {len(m)} + 1 ELSE -1 END)")


# --- derived views (same rules as plans/derived.py) ---------------------------------

RESPONSES = """
responses AS (
  SELECT doc_id AS qid, lang AS dataset, CASE
    WHEN doc_id % 10 < 6 THEN a || ' Self-reflection: about ' || lang || ' Confidence: ' || c
    WHEN doc_id % 10 = 6 THEN a || ' Self-reflection: about ' || lang
    WHEN doc_id % 10 = 7 THEN a || ' Confidence: ' || c
    WHEN doc_id % 10 = 8 THEN a || ' Self-reflection: about ' || lang || ' Confidence: ' || c || '/10'
    ELSE 'Confidence: ' || c || ' Self-reflection: late' END AS response
  FROM (SELECT doc_id, lang, 'Answer: ' || text AS a,
               CAST((doc_id * 7 + 3) % 13 AS VARCHAR) AS c FROM documents) z
)"""

GOLD = """
gold AS (
  SELECT l.doc_id AS qid,
         CAST(CASE WHEN quality = 1 AND toxic = 0 THEN 10.0 WHEN quality = 1 THEN 5.0 ELSE 2.0 END AS DOUBLE) AS correctness,
         CASE WHEN l.doc_id % 3 = 0 THEN d.text
              WHEN l.doc_id % 3 = 1 THEN ' ' || d.text || chr(9)
              ELSE d.text || ' and more' END AS gold_text
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""

_R = "response"
_A = find(_R, "Self-reflection: ")
_B = find(_R, "Confidence: ")
REFL = pyslice(_R, f"{_A} + 17", _B)
TAIL = pyslice(_R, f"{_B} + 12", None)
CONF = f"(CASE WHEN {REFL} = '' OR {TAIL} = '' THEN 0.0 ELSE {single_number(TAIL)} END)"
_RUNS = f"len(regexp_extract_all({TAIL}, '([0-9]+)', 1))"
STATUS = f"""(CASE WHEN response IS NULL THEN 'null' WHEN response = '' THEN 'empty'
  WHEN NOT contains(response, 'Confidence:') THEN 'no_confidence_marker'
  WHEN {REFL} = '' OR {TAIL} = '' THEN 'empty_part'
  WHEN {_RUNS} = 0 THEN 'no_number' WHEN {_RUNS} > 1 THEN 'several_numbers'
  WHEN {single_number(TAIL)} > 10 THEN 'out_of_range' ELSE 'ok' END)"""

PARSED = f"""
parsed AS (
  SELECT qid, dataset, response, response AS answer, {REFL} AS reflection, {CONF} AS confidence,
         {STATUS} AS parse_status
  FROM responses
)"""


def clamp(x: str) -> str:
    return f"(CASE WHEN {x} BETWEEN 0 AND 10 THEN {x} ELSE greatest(0.0, least(1.0, {x})) END)"


REWARD = f"2.0 * (0.5 - power({clamp('g.correctness')} / 10.0 - {clamp('p.confidence')} / 10.0, 2))"

GOLD_SCORES = """
gold_scores AS (
  SELECT doc_id AS qid,
         CAST(CASE WHEN quality = 1 AND toxic = 0 THEN 10.0 WHEN quality = 1 THEN 5.0 ELSE 2.0 END AS DOUBLE) AS correctness
  FROM labels
)"""

SCORED = f"""
scored AS (
  SELECT p.*, g.correctness, {REWARD} AS reward
  FROM parsed p JOIN gold_scores g ON p.qid = g.qid
)"""


def with_(*ctes: str) -> str:
    rec = "RECURSIVE " if any("walk AS" in c for c in ctes) else ""
    return f"WITH {rec}" + ",\n".join(c.strip() for c in ctes) + "\n"


def auroc_sql(src: str, keys: list[str]) -> str:
    """Histogram form of the ROC area, grouped by ``keys``."""
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    return f"""
    SELECT {kk}CASE WHEN sum(cp) * sum(cn) > 0 THEN sum(cp * (below + cn / 2.0)) / (sum(cp) * sum(cn))
                    ELSE 0.0 END AS auroc
    FROM (SELECT *, coalesce(sum(cn) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    AS below
          FROM (SELECT {kk}confidence / 10.0 AS p, count(*) FILTER (WHERE correctness >= 7) AS cp,
                       count(*) FILTER (WHERE correctness < 7) AS cn
                FROM {src} GROUP BY {kk}confidence / 10.0) h) x
    {"GROUP BY " + k if keys else ""}"""


ORACLE["parse_main"] = with_(RESPONSES, PARSED) + \
    "SELECT qid, reflection, confidence, parse_status FROM parsed"

ORACLE["calibration_by_lang"] = with_(RESPONSES, GOLD, GOLD_SCORES, PARSED, SCORED) + f"""
SELECT b.dataset, n, {rnd('ece')} AS ece, {rnd('accuracy')} AS accuracy, {rnd('conf_pos')} AS conf_pos,
       {rnd('conf_neg')} AS conf_neg, n_out_of_range, {rnd('mean_reward')} AS mean_reward,
       {rnd('a.auroc')} AS auroc
FROM (SELECT dataset, count(*) AS n, sum(abs(confidence - correctness)) / (count(*) * 10.0) AS ece,
             sum(correctness) / (count(*) * 10.0) AS accuracy,
             CASE WHEN count(*) FILTER (WHERE correctness >= 7) > 0 THEN sum(confidence) FILTER (WHERE correctness >= 7)
                  / (count(*) FILTER (WHERE correctness >= 7) * 10.0) ELSE 0.0 END AS conf_pos,
             CASE WHEN count(*) FILTER (WHERE correctness <= 3) > 0 THEN sum(confidence) FILTER (WHERE correctness <= 3)
                  / (count(*) FILTER (WHERE correctness <= 3) * 10.0) ELSE 0.0 END AS conf_neg,
             count(*) FILTER (WHERE NOT confidence BETWEEN 0 AND 10) AS n_out_of_range,
             avg(reward) AS mean_reward
      FROM scored GROUP BY dataset) b
LEFT JOIN ({auroc_sql('scored', ['dataset'])}) a ON a.dataset = b.dataset
"""


def r6(e: str, name: str) -> str:
    return f"{rnd(e)} AS {name}"


ORACLE["parse_rtuning"] = """
SELECT doc_id AS qid, CAST(CASE WHEN contains(r, 'unsure') THEN 0.0 ELSE 10.0 END AS DOUBLE) AS confidence,
       CASE WHEN contains(r, 'unsure') THEN 'unsure' ELSE 'sure' END AS parse_status
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' I am unsure.'
                                   WHEN 1 THEN text || ' I am sure.'
                                   WHEN 2 THEN 'unsure: ' || text
                                   ELSE text END AS r FROM documents) z
"""

_LIDX = rfind("response", "I am")
ORACLE["parse_legacy"] = f"""
WITH lr AS (
  SELECT doc_id AS qid, CASE doc_id % 5
      WHEN 0 THEN text || '. I am ' || CAST(doc_id % 101 AS VARCHAR) || '% sure'
      WHEN 1 THEN text || ' I am I am ' || CAST(doc_id % 101 AS VARCHAR) || ' of 4'
      WHEN 2 THEN text || ' ' || CAST(doc_id % 101 AS VARCHAR)
      WHEN 3 THEN '' ELSE text END AS response
  FROM documents)
SELECT qid, {pyslice('response', None, _LIDX)} AS answer,
       {single_number(pyslice('response', _LIDX, None))} AS confidence,
       CASE WHEN {_LIDX} < 0 THEN 'no_hedge' ELSE 'ok' END AS parse_status
FROM lr
"""

SAMPLES = """
samples AS (
  SELECT CAST(label AS BIGINT) * 1000000 + vec_id // 500 AS question_id,
         CAST(row_number() OVER (PARTITION BY label, vec_id // 500 ORDER BY vec_id) - 1 AS INTEGER) AS sample_idx,
         vec_id, embedding,
         CASE vec_id % 5
           WHEN 0 THEN 'think ' || CAST(vec_id AS VARCHAR) || '. Self-reflection: unsure of '
                       || CAST(vec_id % 7 AS VARCHAR) || ' Confidence: 4'
           WHEN 1 THEN 'think only ' || CAST(vec_id AS VARCHAR)
           WHEN 2 THEN 'a' || CAST(vec_id AS VARCHAR) || ' Self-reflection: b Self-reflection: c'
           WHEN 3 THEN 'a Self-reflection: Confidence: ' || CAST(vec_id % 9 AS VARCHAR)
           ELSE ' chain ' || CAST(vec_id AS VARCHAR) || ' Self-reflection: x' || CAST(vec_id % 3 AS VARCHAR)
                || ' Are you sure you accurately answered the question based on your internal knowledge? yes Confidence: 2'
         END AS text
  FROM embeddings
)"""

_SEC = "split_part(text, 'Self-reflection:', 2)"
_REF1 = strip(f"split_part({_SEC}, 'Confidence:', 1)")
_REF2 = strip(f"split_part({_REF1}, 'Are you sure you accurately answered the question based on your internal knowledge', 1)")
SPLIT_SAMPLES = f"""
split_samples AS (
  SELECT *, {strip("split_part(text, 'Self-reflection:', 1)")} AS chain,
         CASE WHEN contains(text, 'Self-reflection:') THEN {_REF2} ELSE 'N/A' END AS reflection
  FROM samples
)"""

ORACLE["sample_split"] = with_(SAMPLES, SPLIT_SAMPLES) + \
    "SELECT question_id, sample_idx, chain, reflection FROM split_samples"

_Z = "replace(response, '<pad>', '')"
ORACLE["clean_response"] = f"""
WITH dr AS (
  SELECT doc_id AS qid, CASE doc_id % 4
      WHEN 0 THEN '<pad><pad>[INST] q [/INST] ' || text || ' Confidence: '
                  || CAST(doc_id % 11 AS VARCHAR) || ' and more text'
      WHEN 1 THEN '[INST] q [/INST] ' || text || ' I am sure. tail'
      WHEN 2 THEN text || '<pad>'
      ELSE '[INST] q [/INST]' || text END AS response
  FROM documents),
t AS (
  SELECT qid, response, {pyslice(_Z, find(_Z, '[/INST]'), None)} AS cleaned,
         regexp_extract(response, '(?s)^(.*?\\[/INST\\].*?(?:Confidence: [0-9]+|I am sure|I am unsure))', 1) AS head
  FROM dr)
SELECT qid, cleaned, CASE WHEN head <> '' THEN head ELSE response END AS truncated,
       (CASE WHEN head <> '' THEN head ELSE response END) <> response AS was_truncated
FROM t
"""

ORACLE["parse_report"] = with_(RESPONSES, PARSED) + \
    "SELECT parse_status, count(*) AS n_rows FROM parsed GROUP BY parse_status"

ORACLE["reward"] = with_(RESPONSES, GOLD, GOLD_SCORES, PARSED, SCORED) + f"""
SELECT qid, correctness, confidence, {r6('reward', 'reward')},
       NOT (correctness BETWEEN 0 AND 10 AND confidence BETWEEN 0 AND 10) AS reward_out_of_range
FROM scored
"""

ORACLE["reward_sign"] = with_(RESPONSES, GOLD, PARSED) + f"""
SELECT p.qid, (floor((CASE WHEN g.correctness >= 5 THEN {clamp('p.confidence')} / 10.0
                         ELSE -{clamp('p.confidence')} / 10.0 END) * 1e6 + 0.5) / 1e6) AS reward
FROM parsed p JOIN gold g ON p.qid = g.qid
"""

ORACLE["substring_correctness"] = with_(RESPONSES, GOLD, PARSED) + f"""
SELECT p.qid, CAST(CASE WHEN contains(lower({strip('p.answer')}), lower({strip('g.gold_text')}))
                   THEN 10.0 ELSE 0.0 END AS DOUBLE) AS correctness
FROM parsed p JOIN gold g ON p.qid = g.qid
"""

_NTAIL = pyslice("response", f"{find('response', 'Confidence:')} + 11", None)
_AFTER = f"regexp_replace({_NTAIL}, '^{NOT_WS}*', '')"  # what follows the token that completes the marker
ORACLE["nonsense_penalty"] = with_(RESPONSES, GOLD, GOLD_SCORES, PARSED, SCORED) + f"""
SELECT qid, coalesce(NOT contains(response, 'Confidence:') OR {strip(_AFTER)} = '', true) AS nonsense,
       (floor(CASE WHEN coalesce(NOT contains(response, 'Confidence:') OR {strip(_AFTER)} = '', true)
                  THEN -1.0 ELSE reward END * 1e6 + 0.5) / 1e6) AS reward
FROM scored
"""

ORACLE["calibration_overall"] = with_(RESPONSES, GOLD, GOLD_SCORES, PARSED, SCORED) + f"""
SELECT n, {rnd('ece')} AS ece, {rnd('accuracy')} AS accuracy, {rnd('conf_pos')} AS conf_pos,
       {rnd('conf_neg')} AS conf_neg, n_out_of_range, {rnd('mean_reward')} AS mean_reward,
       {rnd('a.auroc')} AS auroc
FROM (SELECT count(*) AS n, sum(abs(confidence - correctness)) / (count(*) * 10.0) AS ece,
             sum(correctness) / (count(*) * 10.0) AS accuracy,
             CASE WHEN count(*) FILTER (WHERE correctness >= 7) > 0 THEN sum(confidence) FILTER (WHERE correctness >= 7)
                  / (count(*) FILTER (WHERE correctness >= 7) * 10.0) ELSE 0.0 END AS conf_pos,
             CASE WHEN count(*) FILTER (WHERE correctness <= 3) > 0 THEN sum(confidence) FILTER (WHERE correctness <= 3)
                  / (count(*) FILTER (WHERE correctness <= 3) * 10.0) ELSE 0.0 END AS conf_neg,
             count(*) FILTER (WHERE NOT confidence BETWEEN 0 AND 10) AS n_out_of_range,
             avg(reward) AS mean_reward
      FROM scored) b, ({auroc_sql('scored', [])}) a
"""


_GAP = ("(coalesce(sum(confidence) FILTER (WHERE confidence >= 1), 0.0) "
        "- coalesce(sum(reward) FILTER (WHERE confidence >= 1), 0.0) "
        "+ coalesce(sum(abs(confidence - reward)) FILTER (WHERE confidence < 1), 0.0)) / count(*)")
ORACLE["conf_reward_gap"] = with_(RESPONSES, GOLD, GOLD_SCORES, PARSED, SCORED) + f"""
SELECT dataset, {rnd(_GAP)} AS conf_reward_gap, count(*) AS n
FROM scored GROUP BY dataset
"""

ORDER_BATCHES = """
ob AS (
  SELECT o_orderkey, CAST((o_orderkey * 7 + 3) % 13 AS DOUBLE) AS confidence,
         CAST(o_custkey % 11 AS DOUBLE) AS correctness,
         CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 8 AS BIGINT) AS batch_id,
         CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 8 AS INTEGER) AS pos_in_batch
  FROM orders
),
bp AS (
  SELECT batch_id, count(*) AS n, sum(abs(confidence - correctness)) AS gap_sum,
         sum(correctness) AS acc_sum,
         coalesce(sum(confidence) FILTER (WHERE correctness >= 7), 0.0) AS pos_sum,
         count(*) FILTER (WHERE correctness >= 7) AS pos_n,
         coalesce(sum(confidence) FILTER (WHERE correctness <= 3), 0.0) AS neg_sum,
         count(*) FILTER (WHERE correctness <= 3) AS neg_n
  FROM ob GROUP BY batch_id
)"""

BATCH_METRICS = """
SELECT batch_id, n, (floor((gap_sum / (n * 10.0)) * 1e6 + 0.5) / 1e6) AS ece, (floor((acc_sum / (n * 10.0)) * 1e6 + 0.5) / 1e6) AS accuracy,
       (floor((CASE WHEN pos_n > 0 THEN pos_sum / (pos_n * 10.0) ELSE 0.0 END) * 1e6 + 0.5) / 1e6) AS conf_pos,
       (floor((CASE WHEN neg_n > 0 THEN neg_sum / (neg_n * 10.0) ELSE 0.0 END) * 1e6 + 0.5) / 1e6) AS conf_neg
FROM bp"""

ORACLE["calibration_batches"] = with_(ORDER_BATCHES) + BATCH_METRICS

_W = "OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORACLE["calibration_cumulative"] = with_(ORDER_BATCHES) + f"""
SELECT batch_id, CAST(sum(n) {_W} AS BIGINT) AS n_seen,
       {rnd(f"sum(gap_sum) {_W} / (sum(n) {_W} * 10.0)")} AS cumulative_ece,
       {rnd(f"sum(acc_sum) {_W} / (sum(n) {_W} * 10.0)")} AS cumulative_accuracy,
       {rnd(f"sum(pos_sum) {_W} / (sum(greatest(pos_n, 1)) {_W} * 10.0)")} AS cumulative_conf_pos,
       {rnd(f"sum(neg_sum) {_W} / (sum(greatest(neg_n, 1)) {_W} * 10.0)")} AS cumulative_conf_neg
FROM bp
"""

ORACLE["auroc_cumulative"] = with_(ORDER_BATCHES) + """
, h AS (SELECT batch_id, confidence / 10.0 AS p, count(*) FILTER (WHERE correctness >= 7) AS cp,
               count(*) FILTER (WHERE correctness < 7) AS cn FROM ob GROUP BY batch_id, confidence / 10.0),
grid AS (SELECT b.batch_id, c.p FROM (SELECT DISTINCT batch_id FROM ob) b, (SELECT DISTINCT p FROM h) c),
g AS (SELECT grid.batch_id, grid.p, coalesce(h.cp, 0) AS cp, coalesce(h.cn, 0) AS cn
      FROM grid LEFT JOIN h ON grid.batch_id = h.batch_id AND grid.p = h.p),
r AS (SELECT batch_id, p,
             sum(cp) OVER (PARTITION BY p ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ccp,
             sum(cn) OVER (PARTITION BY p ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ccn
      FROM g),
b AS (SELECT *, coalesce(sum(ccn) OVER (PARTITION BY batch_id ORDER BY p
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r)
SELECT batch_id, (floor(CASE WHEN sum(ccp) * sum(ccn) > 0
                            THEN sum(ccp * (below + ccn / 2.0)) / (sum(ccp) * sum(ccn)) ELSE 0.0 END * 1e6 + 0.5) / 1e6)
                 AS cumulative_auroc
FROM b GROUP BY batch_id
"""

ORACLE["preview"] = with_(ORDER_BATCHES) + """
SELECT o_orderkey, batch_id, pos_in_batch FROM ob WHERE batch_id % 10 = 0 AND pos_in_batch < 5
"""

ATTEMPTS = """
attempts AS (
  SELECT CAST(floor(event_id / 4) AS BIGINT) AS qid, CAST(event_id % 4 AS INTEGER) AS attempt,
         'draft ' || CAST(event_id AS VARCHAR) ||
         CASE WHEN event_id % 5 = 0 OR (event_id % 4 = 3 AND event_id % 7 <> 0)
              THEN ' Confidence: ' || CAST(event_id % 11 AS VARCHAR)
              WHEN event_id % 13 = 1 THEN ' I am sure' ELSE '' END AS response
  FROM events
)"""

ORACLE["resolve_attempts"] = with_(ATTEMPTS) + """
, a AS (SELECT *, coalesce(length(response) > 0 AND contains(response, 'Confidence:'), false) AS v,
               coalesce(length(response) > 0 AND (contains(response, 'Confidence:') OR contains(response, 'I am sure')
                        OR contains(response, 'I am unsure')), false) AS anyv
        FROM attempts),
g AS (SELECT qid,
             min(attempt) FILTER (WHERE v AND attempt <= 2) AS fv,
             min(attempt) FILTER (WHERE attempt = 2 AND anyv) AS lr,
             max(attempt) AS last,
             arg_min(response, attempt) FILTER (WHERE v AND attempt <= 2) AS rfv,
             arg_min(response, attempt) FILTER (WHERE attempt = 2 AND anyv) AS rlr,
             arg_max(response, attempt) AS rlast,
             count(*) AS n_attempts
      FROM a GROUP BY qid)
SELECT qid, coalesce(fv, lr, last) AS attempt,
       CASE WHEN fv IS NOT NULL THEN rfv WHEN lr IS NOT NULL THEN rlr ELSE rlast END AS response,
       n_attempts, fv IS NOT NULL AS resolved
FROM g
"""

_FIRST = "split_part(reply, chr(10), 1)"
_JV = f"try_cast({strip(f'split_part({_FIRST}, chr(58), 2)')} AS DOUBLE)"
JUDGE = f"""
judge AS (
  SELECT CAST(floor(event_id / 3) AS BIGINT) AS qid, CAST(event_id % 3 AS INTEGER) AS attempt,
         CASE event_id % 7
           WHEN 0 THEN 'Score: ' || CAST(CAST(floor(value) AS BIGINT) % 15 AS VARCHAR)
           WHEN 1 THEN 'Score: ' || CAST(CAST(floor(value) AS BIGINT) % 100 / 10.0 AS VARCHAR)
           WHEN 2 THEN 'Rating: 7/10'
           WHEN 3 THEN 'a: ' || CAST(event_id % 11 AS VARCHAR) || ': 9'
           WHEN 4 THEN 'Explanation: fine' || chr(10) || 'Score: 9'
           WHEN 5 THEN 'Score: -0.5'
           ELSE 'no colon here' END AS reply
  FROM events
),
jv AS (
  SELECT qid, attempt, CASE WHEN x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e15 AND contains(f, ':')
                            THEN CAST(trunc(x) AS BIGINT) END AS v
  FROM (SELECT *, {_JV} AS x, {_FIRST} AS f FROM judge) z
)"""

ORACLE["judge_scores"] = with_(JUDGE) + """
SELECT qid, CAST(coalesce(arg_min(v, attempt) FILTER (WHERE v BETWEEN 0 AND 10 AND attempt < 3), 0) AS BIGINT) AS score,
       arg_min(v, attempt) FILTER (WHERE v BETWEEN 0 AND 10 AND attempt < 3) IS NOT NULL AS accepted,
       count(*) FILTER (WHERE v IS NULL AND attempt < 3) AS n_failed,
       count(*) FILTER (WHERE NOT (v BETWEEN 0 AND 10) AND attempt < 3) AS n_out_of_range
FROM jv GROUP BY qid
"""

ORACLE["output_records"] = with_(RESPONSES, GOLD, GOLD_SCORES, PARSED, SCORED) + """
SELECT s.qid, g.gold_text AS best_answer, s.response, s.correctness
FROM scored s JOIN gold g ON s.qid = g.qid
"""

ORACLE["metric_log"] = with_(ORDER_BATCHES) + """
, m AS (""" + BATCH_METRICS + """)
SELECT 'orders' AS run_id, batch_id AS step, metric, (floor((value) * 1e6 + 0.5) / 1e6) AS value
FROM (UNPIVOT m ON ece, accuracy, conf_pos, conf_neg INTO NAME metric VALUE value) u
"""


def lit(s: str) -> str:
    """SQL string literal (newlines kept as characters)."""
    return "'" + s.replace("'", "''") + "'"


QA_RAW = """
qa_raw AS (
  SELECT item_id AS qid, ' ' || text || chr(10) AS question, text || ' ' AS answer,
         CASE item_id % 3 WHEN 0 THEN NULL
              WHEN 1 THEN substring(text, 1, length(text) // 2) || '/' || substring(text, length(text) // 2 + 1) || '/'
              ELSE 'solo' END AS negative_answer
  FROM benchmark
)"""

QA = f"""
qa AS (
  SELECT qid, {strip('question')} AS question, {strip('answer')} AS best_answer,
         [{strip('answer')}] AS correct_answers, string_split(negative_answer, '/') AS negative_answers
  FROM qa_raw
)"""

ORACLE["qa_normalise"] = with_(QA_RAW, QA) + """
SELECT qid, question, best_answer, array_to_string(correct_answers, '|') AS correct_answers,
       array_to_string(negative_answers, '|') AS negative_answers
FROM qa
"""

ORACLE["yesno_normalise"] = """
SELECT item_id AS qid, CASE WHEN coalesce(a, false) THEN 'True' ELSE 'False' END AS best_answer,
       CASE WHEN coalesce(a, false) THEN 'True' ELSE 'False' END AS correct_answers
FROM (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE item_id % 2 = 0 END AS a FROM benchmark) z
"""

_NL = "\n"
_TAG = f"'[INST]' || {strip('question')} || '[/INST]' || chr(10)"
_UNTUNED = ("After answering, give the reason for your confidence, then write "
            "'Confidence: ' and an integer from 1 to 10.")
ORACLE["qa_prompts"] = with_(QA_RAW, QA) + f"""
SELECT qid, {_TAG} AS prompt_tag,
       {lit('[INST]' + _NL + 'Say how sure you are. ' + _NL)} || {strip("'<s>' || " + _TAG)}
         || {lit(_NL + '[/INST]' + _NL)} AS prompt_tag_conf,
       {lit('[INST]' + _NL)} || question || {lit(_NL + '[/INST]' + _NL)} AS prompt_newline,
       {lit('[INST]' + _NL + 'Say how sure you are. ' + _NL)} || question || {lit(_NL + '[/INST]' + _NL)}
         AS prompt_newline_conf,
       {lit('[INST]' + _NL)} || question || {lit(_NL + _UNTUNED + '[/INST]' + _NL)} AS prompt_untuned,
       {lit('[INST]' + _NL)} || question || {lit(_NL + '[/INST]' + _NL)} || best_answer || chr(10) AS prompt_pair
FROM qa
"""

TURNS = """
turns AS (
  SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text AS content,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
)"""


def _tagged(c: str) -> str:
    return f"{lit('[INST]' + _NL)} || {strip(c)} || {lit('[/INST]' + _NL)}"


ORACLE["chat_train_text"] = with_(TURNS) + f"""
SELECT conv_id, {strip(f"string_agg(CASE WHEN role IN ('system', 'user') THEN {_tagged('content')} "
                       f"WHEN role = 'assistant' THEN {strip('content')} || '</s>' || chr(10) END, '' ORDER BY turn)")}
       AS text
FROM turns GROUP BY conv_id
"""


def _chat_pa(style: str, bos: str = "", content: str = "content") -> str:
    last_tail = "chr(10)" if style == "ppo" else "''"
    piece = (f"CASE WHEN role IN ('system', 'user') THEN {_tagged(content)} "
             f"WHEN role = 'assistant' AND i <> n - 1 THEN chr(10) || {strip(content)} || '</s>' || chr(10) "
             f"WHEN role = 'assistant' THEN {last_tail} END")
    ans = f"max(CASE WHEN i = n - 1 AND role = 'assistant' THEN {strip(content)} END)"
    return f"""
SELECT conv_id, {lit(bos)} || string_agg({piece}, '' ORDER BY turn) AS prompt,
       coalesce({ans}, '') AS answer0,
       max(CASE WHEN i = n - 2 THEN {strip(content)} END) AS question
FROM turns GROUP BY conv_id"""


_HEDGE_CUT = f"CASE WHEN contains(answer0, 'I am') THEN {pyslice('answer0', None, rfind('answer0', 'I am'))} ELSE answer0 END"
ORACLE["chat_prompt_answer"] = with_(TURNS) + f"""
SELECT conv_id, prompt, {_HEDGE_CUT} AS answer, question FROM ({_chat_pa('eval')}) z
"""

ORACLE["chat_prompt_answer_ppo"] = with_(TURNS) + f"""
SELECT conv_id, prompt, answer0 AS answer, question FROM ({_chat_pa('ppo', '<s>')}) z
"""

ORACLE["chat_explicit_confidence"] = with_(TURNS) + f"""
, t2 AS (SELECT conv_id, turn, role, i, n,
                CASE WHEN i = 0 THEN 'State your confidence. ' || content ELSE content END AS content FROM turns),
turns2 AS (SELECT * FROM t2)
SELECT conv_id, prompt, question FROM ({_chat_pa('eval').replace('FROM turns', 'FROM turns2')}) z
"""

_WC = f"len(list_filter(regexp_split_to_array(content, '{WS}+'), lambda w: w <> ''))"
ORACLE["word_budget"] = with_(TURNS) + f"""
SELECT conv_id, CAST(sum({_WC}) AS INTEGER) AS n_words FROM turns GROUP BY conv_id HAVING sum({_WC}) < 200
"""

ORACLE["word_budget_long"] = with_(TURNS) + f"""
SELECT conv_id, CAST(sum({_WC}) AS BIGINT) AS n_words, count(*) AS n_messages
FROM turns GROUP BY conv_id HAVING sum({_WC}) < 100
"""

ORACLE["chat_validate"] = with_(TURNS) + """
SELECT conv_id, CASE WHEN bool_or(NOT (r IN ('system', 'user', 'assistant'))) THEN 'unknown_role' ELSE 'ok' END AS status
FROM (SELECT conv_id, CASE WHEN conv_id % 17 = 0 AND turn = 1 THEN 'tool' ELSE role END AS r FROM turns) z
GROUP BY conv_id
"""

_P = "substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER))"
_C = "substring(text, CAST(floor(length(text) / 2) AS INTEGER) + 1, length(text))"
ORACLE["prompt_completion"] = f"""
SELECT doc_id AS qid,
       CASE WHEN NOT (length({_P}) > 0 AND right({_P}, 1) IN (' ', chr(10), chr(9)))
                 AND NOT (left({_C}, 1) IN (' ', chr(10), chr(9)))
            THEN {_P} || ' ' || {_C} ELSE {_P} || {_C} END || '</s>' AS text
FROM documents
"""

ORACLE["sft_text_from_pairs"] = with_(QA_RAW) + f"""
SELECT qid, {strip(f"{_tagged('question')} || {strip('answer')} || '</s>' || chr(10)")} AS text FROM qa_raw
"""

_JT = "Question: <QUESTION>\nResponse: <RESPONSE>\nReference: <CORRECT_ANSWER>\nReply with 'Score: N' (0-10)."
ORACLE["judge_prompt"] = with_(QA_RAW, QA) + f"""
, r AS (SELECT *, 'resp <QUESTION> ' || CAST(qid AS VARCHAR) AS response FROM qa)
SELECT qid,
  replace(replace(replace({lit(_JT)}, '<QUESTION>', question), '<RESPONSE>', response), '<CORRECT_ANSWER>', best_answer)
    AS judge_prompt,
  replace(replace(replace(replace('Q=<QUESTION>|R=<RESPONSE>|B=<BEST_ANSWER>|O=<OTHER_CORRECT_ANSWERS>',
    '<QUESTION>', question), '<RESPONSE>', response), '<BEST_ANSWER>', best_answer),
    '<OTHER_CORRECT_ANSWERS>', array_to_string(correct_answers, chr(10))) AS judge_prompt_other
FROM r
"""


ORACLE["row_index"] = """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx FROM orders
"""

ORACLE["row_slice"] = with_(TURNS) + f"""
, kept AS (SELECT conv_id FROM turns GROUP BY conv_id HAVING sum({_WC}) < 400),
idx AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS row_idx FROM kept)
SELECT conv_id, row_idx FROM idx WHERE row_idx >= 5 AND row_idx < 25
"""

ORACLE["double_slice"] = """
SELECT doc_id, row_idx FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents) z
WHERE row_idx < 700 AND row_idx >= 100 AND row_idx < 150
"""

_RANK = "row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1"
ORACLE["split_rows"] = f"""
SELECT doc_id, CASE WHEN r < (SELECT ceil(0.01 * count(*)) FROM documents) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, {_RANK} AS r FROM documents) z
"""

ORACLE["seeded_order"] = f"SELECT doc_id, {_RANK} AS shuffle_idx FROM documents"

ORACLE["sample_rows"] = """
SELECT doc_id, lang FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 3
"""

ORACLE["split_sizes"] = f"""
SELECT CASE WHEN r < (SELECT ceil(0.01 * count(*)) FROM documents) THEN 'test' ELSE 'train' END AS split,
       count(*) AS n_rows
FROM (SELECT doc_id, {_RANK} AS r FROM documents) z GROUP BY 1
"""


CLUSTER_T = 0.25
PAIRS = f"""
nv AS (SELECT question_id, sample_idx, CAST(embedding AS DOUBLE[]) AS e,
              sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS nrm FROM samples),
pairs AS (
  SELECT a.question_id, a.sample_idx AS i, b.sample_idx AS j,
         list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.nrm * b.nrm) AS cosine
  FROM nv a JOIN nv b ON a.question_id = b.question_id AND a.sample_idx < b.sample_idx
  WHERE a.nrm > 0 AND b.nrm > 0
),
edges AS (SELECT * FROM pairs WHERE cosine > {CLUSTER_T})"""

ORACLE["similar_pairs"] = with_(SAMPLES, PAIRS) + \
    f"SELECT question_id, i, j, {rnd('cosine')} AS cosine FROM edges"

LEADERS = """
adj AS (SELECT question_id, i, list_sort(list(j)) AS js FROM edges GROUP BY question_id, i),
ordered AS (SELECT question_id, i, js, row_number() OVER (PARTITION BY question_id ORDER BY i) AS k FROM adj),
walk AS (
  SELECT question_id, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS taken,
         CAST([] AS STRUCT(leader INTEGER, size INTEGER)[]) AS out
  FROM (SELECT DISTINCT question_id FROM adj) q
  UNION ALL
  SELECT w.question_id, w.k + 1,
         CASE WHEN list_contains(w.taken, o.i) OR len(list_filter(o.js, lambda x: NOT list_contains(w.taken, x))) = 0
              THEN w.taken ELSE list_distinct(list_concat(w.taken, o.js)) END,
         CASE WHEN list_contains(w.taken, o.i) OR len(list_filter(o.js, lambda x: NOT list_contains(w.taken, x))) = 0
              THEN w.out
              ELSE list_append(w.out, {'leader': o.i,
                   'size': CAST(len(list_filter(o.js, lambda x: NOT list_contains(w.taken, x))) + 1 AS INTEGER)}) END
  FROM walk w JOIN ordered o ON o.question_id = w.question_id AND o.k = w.k + 1
),
final AS (SELECT question_id, arg_max(out, k) AS out FROM walk GROUP BY question_id),
clusters AS (
  SELECT question_id, CAST(pos - 1 AS INTEGER) AS cluster_pos, out[pos].leader AS leader_idx, out[pos].size AS size
  FROM final, range(1, len(out) + 1) t(pos)
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY size DESC, leader_idx) - 1 AS INTEGER)
                  AS size_rank FROM clusters)"""

ORACLE["leader_clusters"] = with_(SAMPLES, PAIRS, LEADERS) + \
    "SELECT question_id, cluster_pos, leader_idx, size, size_rank FROM ranked"

GROWING = """
samples AS (
  SELECT CASE WHEN vec_id % 3 = 0 THEN 0 ELSE vec_id // 15 + 1 END AS question_id, CAST(vec_id AS INTEGER) AS sample_idx,
         CASE WHEN vec_id % 41 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT))
              WHEN vec_id % 97 = 5 THEN NULL ELSE embedding END AS embedding
  FROM embeddings)"""

ORACLE["leader_clusters_growing"] = with_(GROWING, PAIRS, LEADERS) + """
SELECT question_id, 'cluster' AS kind, leader_idx AS sample_idx, size, size_rank FROM ranked
UNION ALL SELECT question_id, 'no vector', sample_idx, 0, -1 FROM nv WHERE nrm IS NULL OR NOT nrm > 0
"""

ORACLE["similar_pairs_growing"] = with_(GROWING.replace("samples AS", "whole AS", 1), """
samples AS (SELECT question_id, sample_idx, CASE WHEN embedding IS NOT NULL THEN list_transform([0, 1, 2, 3], lambda k:
              coalesce(list_sum(list_transform(list_filter(list_zip(embedding, range(len(embedding))), lambda p: p[2] % 4 = k),
                                               lambda p: CAST(p[1] AS DOUBLE))), 0.0)) END AS embedding FROM whole)""", PAIRS) + \
    f"SELECT question_id, i, j, {rnd('cosine')} AS cosine FROM pairs WHERE cosine > 0.95"

ORACLE["group_samples"] = with_(SAMPLES, SPLIT_SAMPLES) + """
SELECT question_id, count(*) AS n_samples, string_agg(chain, '|' ORDER BY sample_idx) AS chains,
       string_agg(reflection, '|' ORDER BY sample_idx) AS reflections
FROM split_samples GROUP BY question_id
"""

_RT = "Question: <QUESTION>\n\nSampled Responses:\n<RESPONSES>\nReason: <REASON>\nReply as 'reason: ... score: N' (0-10)."
_ST = "Summarise these reasons in one to three sentences.\n<REASONS>\nReply as 'Reason: ...'."
ORACLE["cluster_listing"] = with_(SAMPLES, SPLIT_SAMPLES, PAIRS, LEADERS) + f"""
, reasons AS (SELECT question_id, list(reflection ORDER BY sample_idx) AS refl FROM split_samples GROUP BY question_id),
cl AS (SELECT c.question_id, list({{'pos': c.cluster_pos, 'size': c.size, 'response': s.chain}} ORDER BY c.cluster_pos) AS cls
       FROM ranked c JOIN split_samples s ON s.question_id = c.question_id AND s.sample_idx = c.leader_idx
       GROUP BY c.question_id),
z AS (SELECT cl.question_id, len(cls) AS n_clusters,
             list_filter(list_transform(range(1, least(len(refl), len(cls)) + 1),
                                        lambda k: {{'reason': refl[k], 'c': cls[k]}}),
                         lambda p: NOT contains(p.reason, 'N/A')) AS pairs
      FROM cl JOIN reasons r ON r.question_id = cl.question_id),
k AS (SELECT question_id, n_clusters, pairs,
             array_to_string(list_transform(range(1, len(pairs) + 1),
                 lambda q: CAST(q AS VARCHAR) || '. (' || CAST(pairs[q].c.size AS VARCHAR) || '%) ' || pairs[q].c.response || chr(10)), '') AS listing
      FROM z WHERE len(pairs) > 0)
SELECT question_id, n_clusters, len(pairs) AS n_kept, listing,
       replace({lit(_ST)}, '<REASONS>', array_to_string(list_transform(pairs, lambda p: p.reason), chr(10))) AS summary_prompt,
       replace(replace(replace({lit(_RT)}, '<QUESTION>',
               {strip("replace(replace('[INST] question ' || CAST(question_id AS VARCHAR) || ' [/INST]', '[INST]', ''), '[/INST]', '')")}),
               '<RESPONSES>', listing), '<REASON>', pairs[1].reason) AS rating_prompt
FROM k
"""

RATINGS = """
ratings_raw AS (
  SELECT CAST(floor(event_id / 4) AS BIGINT) AS question_id, CAST(event_id % 4 AS INTEGER) AS attempt,
         CASE event_id % 8
           WHEN 0 THEN 'reason: ok. score: ' || CAST(CAST(floor(value) AS BIGINT) % 11 AS VARCHAR)
           WHEN 1 THEN 'Score: ' || CAST(CAST(floor(value) AS BIGINT) % 11 AS VARCHAR) || '/10'
           WHEN 2 THEN 'no marker ' || CAST(CAST(floor(value) AS BIGINT) % 11 AS VARCHAR)
           WHEN 3 THEN '8 out'
           WHEN 4 THEN 'score: 1.2.3'
           WHEN 5 THEN 'SCORE: ' || CAST(CAST(floor(value) AS BIGINT) % 11 AS VARCHAR) || '.5'
           WHEN 6 THEN NULL
           ELSE 'score: none' END AS reply
  FROM events
)"""


def _ratings(tries: int) -> str:
    t = "substring(reply, instr(lower(reply), 'score:') - 1 + 6 + 1, length(reply) + 1)"
    v = f"try_cast(nullif(regexp_extract({t}, '([0-9]+(\\.[0-9]+)*)', 1), '') AS DOUBLE)"
    return f"""
ratings AS (
  SELECT question_id, reply, coalesce({v}, 0.0) AS numerical_score, {v} IS NOT NULL AS parsed
  FROM (SELECT question_id, arg_min(reply, attempt) FILTER (WHERE reply IS NOT NULL AND attempt < {tries}) AS reply
        FROM ratings_raw GROUP BY question_id) z
)"""


ORACLE["rating_extract"] = with_(RATINGS, _ratings(4)) + "SELECT * FROM ratings"

ORACLE["rating_mean"] = with_(RATINGS, _ratings(4)) + f"""
SELECT {rnd('avg(numerical_score) FILTER (WHERE parsed)')} AS mean_score,
       count(*) FILTER (WHERE parsed) AS n_parsed, count(*) AS n_questions
FROM ratings
"""

ORACLE["rated_questions_capped"] = with_(RATINGS, _ratings(4)) + """
SELECT question_id, numerical_score, parsed FROM ratings ORDER BY question_id LIMIT 100
"""

ORACLE["summary_extract"] = f"""
WITH s AS (
  SELECT CAST(floor(event_id / 3) AS BIGINT) AS question_id, CAST(event_id % 3 AS INTEGER) AS attempt,
         CASE event_id % 5
           WHEN 0 THEN 'Reason:  I lack event ' || CAST(event_id AS VARCHAR) || '. '
           WHEN 1 THEN NULL
           WHEN 2 THEN 'no marker'
           WHEN 3 THEN 'Reason: a' || CAST(event_id AS VARCHAR) || ' Reason: b'
           ELSE 'x' || chr(10) || 'Reason:' || chr(10) || CAST(event_id % 17 AS VARCHAR) END AS reply
  FROM events),
f AS (SELECT question_id, arg_min(reply, attempt) FILTER (WHERE reply IS NOT NULL AND attempt < 3) AS reply
      FROM s GROUP BY question_id)
SELECT question_id, coalesce(CASE WHEN contains(reply, 'Reason:') THEN {strip("split_part(reply, 'Reason:', 2)")}
                                  ELSE '' END, '') AS summary
FROM f
"""


def tok(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> '')"


_PIECE = (f"CASE WHEN role IN ('system', 'user') THEN {_tagged('content')} "
          f"WHEN role = 'assistant' THEN {strip('content')} || '</s>' || chr(10) END")
SFT = f"""
sft_text AS (
  SELECT conv_id, {strip(f"string_agg({_PIECE}, '' ORDER BY turn)")} AS text,
         coalesce({strip(f"string_agg({_PIECE}, '' ORDER BY turn) FILTER (WHERE i < n - 1)")}, '') AS prompt
  FROM turns GROUP BY conv_id
),
sft AS (
  SELECT conv_id, list_slice({tok('text')}, 1, 400) AS tokens, least(len({tok('prompt')}), 400) AS np
  FROM sft_text
),
sft_rows AS (
  SELECT conv_id, tokens, len(tokens) AS n_tokens, least(np, len(tokens)) AS n_masked FROM sft
  WHERE len(tokens) > least(np, len(tokens))
)"""

ORACLE["sft_rows"] = with_(TURNS, SFT) + \
    "SELECT conv_id, n_tokens, n_masked, array_to_string(tokens, ' ') AS tokens FROM sft_rows"

_PAIR_T = f"{lit('[INST]' + _NL)} || {strip('question')} || {lit(_NL + '[/INST]' + _NL)} || {strip('answer')} || chr(10)"
_PAIR_P = f"{lit('[INST]' + _NL)} || {strip('question')} || {lit(_NL + '[/INST]' + _NL)}"
ORACLE["sft_rows_pairs"] = with_(QA_RAW) + f"""
SELECT qid, len(list_slice({tok(_PAIR_T)}, 1, 400)) AS n_tokens,
       least(least(len({tok(_PAIR_P)}), 400), len(list_slice({tok(_PAIR_T)}, 1, 400))) AS n_masked
FROM qa_raw
"""

_PC = (f"CASE WHEN NOT (length({_P}) > 0 AND right({_P}, 1) IN (' ', chr(10), chr(9))) "
       f"AND NOT (left({_C}, 1) IN (' ', chr(10), chr(9))) THEN {_P} || ' ' || {_C} ELSE {_P} || {_C} END || '</s>'")
ORACLE["sft_rows_completion"] = f"""
SELECT doc_id AS qid, len(list_slice({tok(_PC)}, 1, 400)) AS n_tokens,
       least(least(len({tok(_P)}), 400), len(list_slice({tok(_PC)}, 1, 400))) AS n_masked
FROM documents
"""

PADDED = """
padded AS (
  SELECT conv_id, batch_id, n_tokens, n_masked, max(n_tokens) OVER (PARTITION BY batch_id) AS padded_len
  FROM (SELECT *, CAST((row_number() OVER (ORDER BY conv_id) - 1) // 8 AS BIGINT) AS batch_id FROM sft_rows) z
)"""

ORACLE["pad_batches"] = with_(TURNS, SFT, PADDED) + """
SELECT conv_id, batch_id, padded_len, padded_len - n_tokens AS n_pad, n_masked + padded_len - n_tokens AS n_ignored
FROM padded
"""

ORACLE["unpad"] = with_(TURNS, SFT) + "SELECT conv_id, n_tokens AS n_ids, true AS same_ids FROM sft_rows"

MASKS = f"""
mr AS (
  SELECT conv_id, turn, {tok("CASE turn % 3 WHEN 0 THEN content || ' Confidence: ' || CAST(turn AS VARCHAR) "
                            "WHEN 1 THEN content || ' Confidence:' ELSE content END")}
         AS tokens
  FROM turns WHERE role = 'assistant'
),
m AS (
  SELECT conv_id, turn, len(tokens) AS n_tokens,
         list_position(list_transform(tokens, lambda t: contains(t, 'Confidence:')), true) AS pos
  FROM mr
)"""

ORACLE["response_mask"] = with_(TURNS, MASKS) + """
SELECT conv_id, turn, n_tokens,
       CASE WHEN pos IS NOT NULL AND pos > 0 AND pos < n_tokens THEN pos END AS first_idx,
       NOT coalesce(pos IS NOT NULL AND pos > 0 AND pos < n_tokens, false) AS nonsense,
       CASE WHEN pos IS NOT NULL AND pos > 0 AND pos < n_tokens THEN n_tokens - pos ELSE n_tokens END AS n_ones
FROM m
"""

ORACLE["check_lengths"] = with_(TURNS, MASKS) + "SELECT 'equal' AS status, count(*) AS n_rows FROM m"


RUN_LOG = """
run_log AS (SELECT user_id AS run_id, event_id + 1 AS step, CAST(event_id % 2 AS INTEGER) AS rank,
                   value / 500.0 AS value FROM events)"""

ORACLE["best_checkpoints"] = with_(RUN_LOG) + f"""
SELECT run_id, step, {rnd('value')} AS value
FROM (SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
      FROM run_log) z
WHERE value < least(1.0, coalesce(pm, 1.0))
"""

# A window is logged when its last step has been completed, by all ranks (each sums its own steps).
ORACLE["loss_rollup"] = f"""
WITH numbered AS (SELECT event_id % 20 AS run_id, value / 500.0 AS value,
                         row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) - 1 AS i FROM events),
dense AS (SELECT run_id, i // 2 + 1 AS step, i % 2 AS rank, value FROM numbered),
ranks AS (SELECT run_id, count(DISTINCT rank) AS n_ranks FROM dense GROUP BY run_id),
done AS (SELECT run_id, min(last) AS last FROM (SELECT run_id, rank, max(step) AS last FROM dense GROUP BY ALL) z GROUP BY run_id)
SELECT d.run_id, CAST(((step + 9) // 10) * 10 AS BIGINT) AS log_step, {rnd('sum(value) / any_value(n_ranks) / 3 / 10')} AS avg_loss,
       any_value(n_ranks) AS n_ranks, count(*) AS n_rows
FROM dense d JOIN ranks r ON d.run_id = r.run_id JOIN done e ON d.run_id = e.run_id
WHERE ((step + 9) // 10) * 10 <= e.last
GROUP BY d.run_id, (step + 9) // 10
"""

ORACLE["response_mask_subwords"] = with_(TURNS) + """
, t AS (SELECT conv_id, turn, content || CASE WHEN turn % 3 = 2 THEN '' ELSE ' Confidence:' END
               || CASE WHEN turn % 3 = 0 THEN ' 7 of 10' ELSE '' END AS text FROM turns WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, CAST((length(text) + 2) // 3 AS BIGINT) AS n_tokens,
             CASE WHEN strpos(text, 'Confidence:') > 0 THEN (strpos(text, 'Confidence:') + 10 + 2) // 3 END AS pos FROM t)
SELECT conv_id, turn, n_tokens, CAST(CASE WHEN pos < n_tokens THEN pos END AS INTEGER) AS first_idx,
       NOT coalesce(pos < n_tokens, false) AS nonsense,
       CAST(CASE WHEN pos < n_tokens THEN n_tokens - pos ELSE n_tokens END AS BIGINT) AS n_ones
FROM m
"""

ORACLE["read_any_rejects"] = with_(TURNS) + """
SELECT 'good' AS status, conv_id, count(*) AS n FROM turns GROUP BY conv_id
UNION ALL SELECT 'bad', -1, count(DISTINCT conv_id) FROM turns WHERE conv_id % 10 = 0
"""

WIDE = """
wide AS (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 29 <> 0 THEN CAST(floor(o_totalprice) % 6007 AS DOUBLE) END AS confidence,
         CAST(o_custkey % 11 AS DOUBLE) AS correctness, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS BIGINT) AS batch_id
  FROM orders
)"""

# Every pair of a right and a wrong row counts from the batch on that holds the later of the two.
ORACLE["auroc_cumulative_wide"] = with_(WIDE) + f"""
, pairs AS (SELECT p.o_orderstatus, greatest(p.batch_id, n.batch_id) AS batch_id,
                   sum(CASE WHEN p.confidence > n.confidence THEN 1.0 WHEN p.confidence = n.confidence THEN 0.5 ELSE 0.0 END) AS u
            FROM wide p JOIN wide n ON p.o_orderstatus = n.o_orderstatus AND p.correctness >= 7 AND n.correctness < 7
            WHERE p.confidence IS NOT NULL AND n.confidence IS NOT NULL GROUP BY ALL),
sizes AS (SELECT o_orderstatus, batch_id, count(*) FILTER (WHERE correctness >= 7 AND confidence IS NOT NULL) AS np,
                 count(*) FILTER (WHERE correctness < 7 AND confidence IS NOT NULL) AS nn, count(*) FILTER (WHERE confidence IS NULL) AS nu
          FROM wide GROUP BY ALL),
run AS (SELECT s.o_orderstatus, s.batch_id, sum(coalesce(u, 0)) OVER w AS u, sum(np) OVER w AS np, sum(nn) OVER w AS nn, sum(nu) OVER w AS nu
        FROM sizes s LEFT JOIN pairs p ON s.o_orderstatus = p.o_orderstatus AND s.batch_id = p.batch_id
        WINDOW w AS (PARTITION BY s.o_orderstatus ORDER BY s.batch_id))
SELECT o_orderstatus, batch_id, {rnd('CASE WHEN np * nn > 0 THEN u / (np * nn) ELSE 0.0 END')} AS cumulative_auroc,
       CAST(nu AS BIGINT) AS n_null
FROM run
"""

ORACLE["batches_with_nulls"] = with_(WIDE) + f"""
SELECT o_orderstatus, batch_id, count(*) AS n,
       {rnd('coalesce(avg(abs(confidence - correctness)), 0.0) / 10.0')} AS ece, {rnd('avg(correctness) / 10.0')} AS accuracy,
       {rnd('coalesce(avg(confidence) FILTER (WHERE correctness >= 7), 0.0) / 10.0')} AS conf_pos,
       {rnd('coalesce(avg(confidence) FILTER (WHERE correctness <= 3), 0.0) / 10.0')} AS conf_neg
FROM wide GROUP BY o_orderstatus, batch_id
"""

FIVE = """
five AS (
  SELECT CAST(floor(event_id / 5) AS BIGINT) AS qid, CAST(event_id % 5 AS INTEGER) AS attempt,
         'draft ' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 6 = 0 THEN ' Confidence: ' || CAST(event_id % 11 AS VARCHAR)
              WHEN event_id % 13 < 5 THEN ' I am sure' ELSE '' END AS response
  FROM events
)"""


def _resolved_five(kept_retry: str) -> str:
    """First answer or retry with a confidence; else the third retry if ``kept_retry``; else the last attempt."""
    return with_(FIVE) + f"""
, chosen AS (SELECT qid, count(*) AS n_attempts, max(attempt) AS last,
                    min(attempt) FILTER (WHERE attempt <= 3 AND contains(response, 'Confidence:')) AS good,
                    min(attempt) FILTER (WHERE attempt = 3 AND ({kept_retry})) AS retry FROM five GROUP BY qid)
SELECT c.qid, f.attempt, f.response, n_attempts, good IS NOT NULL AS resolved
FROM chosen c JOIN five f ON c.qid = f.qid AND f.attempt = coalesce(good, retry, last)
"""


ORACLE["resolve_attempts_five"] = _resolved_five(
    "contains(response, 'Confidence:') OR contains(response, 'I am sure') OR contains(response, 'I am unsure')")
ORACLE["resolve_attempts_ppo"] = _resolved_five("contains(response, 'Confidence:')")

ORACLE["truncate_literal"] = """
WITH dr AS (
  SELECT doc_id AS qid, CASE doc_id % 4
      WHEN 0 THEN '<pad><pad>[INST] q [/INST] ' || text || ' Confidence: ' || CAST(doc_id % 11 AS VARCHAR) || ' and more text'
      WHEN 1 THEN '[INST] q [/INST] ' || text || ' I am sure. tail'
      WHEN 2 THEN text || '<pad>'
      ELSE '[INST] q [/INST]' || text END AS response
  FROM documents),
t AS (SELECT qid, response, strpos(response, '[/INST]') AS tag,
             strpos(substring(response, strpos(response, '[/INST]') + 7), 'I am') AS hit FROM dr)
SELECT qid, CASE WHEN tag > 0 AND hit > 0 THEN substring(response, 1, tag + 6 + hit + 3) ELSE response END AS truncated,
       (tag > 0 AND hit > 0 AND length(response) > tag + 6 + hit + 3) AS was_truncated
FROM t
"""


ORACLE["json_roundtrip"] = with_(RESPONSES, PARSED) + "SELECT qid, dataset, confidence FROM parsed"

ORACLE["snapshot_roundtrip"] = with_(RATINGS, _ratings(4)) + """
SELECT CAST(question_id // 100 AS BIGINT) AS snapshot, count(*) AS n_rows, count(*) FILTER (WHERE parsed) AS n_parsed
FROM ratings GROUP BY 1
"""

ORACLE["stream_calibration"] = with_(RESPONSES, GOLD, GOLD_SCORES, PARSED, SCORED) + f"""
SELECT b.dataset, n, {rnd('ece')} AS ece, {rnd('accuracy')} AS accuracy, {rnd('conf_pos')} AS conf_pos,
       {rnd('conf_neg')} AS conf_neg, {rnd('a.auroc')} AS auroc
FROM (SELECT dataset, count(*) AS n, sum(abs(confidence - correctness)) / (count(*) * 10.0) AS ece,
             sum(correctness) / (count(*) * 10.0) AS accuracy,
             CASE WHEN count(*) FILTER (WHERE correctness >= 7) > 0 THEN sum(confidence) FILTER (WHERE correctness >= 7)
                  / (count(*) FILTER (WHERE correctness >= 7) * 10.0) ELSE 0.0 END AS conf_pos,
             CASE WHEN count(*) FILTER (WHERE correctness <= 3) > 0 THEN sum(confidence) FILTER (WHERE correctness <= 3)
                  / (count(*) FILTER (WHERE correctness <= 3) * 10.0) ELSE 0.0 END AS conf_neg
      FROM scored GROUP BY dataset) b
JOIN ({auroc_sql('scored', ['dataset'])}) a ON a.dataset = b.dataset
"""


ORACLE["ppo_slices"] = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN r < (SELECT ceil(0.1 * count(*)) FROM documents) THEN 'test' ELSE 'train' END AS split FROM r),
tr AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM s WHERE split = 'train'),
te AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM s WHERE split = 'test'),
capped AS MATERIALIZED (SELECT doc_id, i FROM tr WHERE i < 800)
SELECT doc_id, 'train' AS split FROM capped WHERE i >= 100 AND i < 600
UNION ALL
SELECT doc_id, 'test' AS split FROM te WHERE i < (SELECT count(*) FROM capped) // 100
"""

ORACLE["stage_counts"] = with_(TURNS) + f"""
, w AS (SELECT conv_id, sum({_WC}) AS nw FROM turns GROUP BY conv_id)
SELECT 'chats' AS stage, count(*) AS n_rows FROM w
UNION ALL SELECT 'under_200_words', count(*) FROM w WHERE nw < 200
UNION ALL SELECT 'under_100_words', count(*) FROM w WHERE nw < 100
"""

ORACLE["judge_two_line"] = with_(JUDGE) + f"""
SELECT qid, attempt, {strip("regexp_extract(reply, 'Explanation:([^' || chr(10) || ']*)', 1)")} AS explanation,
       try_cast(nullif(regexp_extract(reply, 'Score:\\s*([0-9]+)', 1), '') AS BIGINT) AS score
FROM judge
"""


EVAL = f"""
ea AS (
  SELECT CAST(floor(event_id / 4) AS BIGINT) AS qid, CAST(event_id % 4 AS INTEGER) AS attempt,
         'answer ' || CAST(event_id AS VARCHAR) ||
         CASE event_id % 3 WHEN 0 THEN ' Self-reflection: ok Confidence: ' || CAST(event_id % 11 AS VARCHAR)
                           WHEN 1 THEN ' Self-reflection: hmm' ELSE '' END AS response
  FROM events
),
eav AS (SELECT *, coalesce(length(response) > 0 AND contains(response, 'Confidence:'), false) AS v,
               coalesce(length(response) > 0 AND (contains(response, 'Confidence:') OR contains(response, 'I am sure')
                        OR contains(response, 'I am unsure')), false) AS anyv
        FROM ea),
eg AS (SELECT qid, min(attempt) FILTER (WHERE v AND attempt <= 2) AS fv,
              min(attempt) FILTER (WHERE attempt = 2 AND anyv) AS lr,
              arg_min(response, attempt) FILTER (WHERE v AND attempt <= 2) AS rfv,
              arg_min(response, attempt) FILTER (WHERE attempt = 2 AND anyv) AS rlr,
              arg_max(response, attempt) AS rlast
       FROM eav GROUP BY qid),
resolved AS (SELECT qid, CASE WHEN fv IS NOT NULL THEN rfv WHEN lr IS NOT NULL THEN rlr ELSE rlast END AS response
             FROM eg),
eparsed AS (SELECT qid, response, {CONF} AS confidence FROM resolved),
ejudge AS (SELECT qid, CAST(coalesce(arg_min(v, attempt) FILTER (WHERE v BETWEEN 0 AND 10 AND attempt < 3), 0) AS DOUBLE)
                  AS correctness FROM jv GROUP BY qid),
escored AS (SELECT p.qid, p.confidence, g.correctness, {REWARD} AS reward
            FROM eparsed p JOIN ejudge g ON p.qid = g.qid),
eb AS (SELECT *, CAST((row_number() OVER (ORDER BY qid) - 1) // 8 AS BIGINT) AS batch_id FROM escored),
bp AS (
  SELECT batch_id, count(*) AS n, sum(abs(confidence - correctness)) AS gap_sum, sum(correctness) AS acc_sum,
         coalesce(sum(confidence) FILTER (WHERE correctness >= 7), 0.0) AS pos_sum,
         count(*) FILTER (WHERE correctness >= 7) AS pos_n,
         coalesce(sum(confidence) FILTER (WHERE correctness <= 3), 0.0) AS neg_sum,
         count(*) FILTER (WHERE correctness <= 3) AS neg_n
  FROM eb GROUP BY batch_id
),
h AS (SELECT batch_id, confidence / 10.0 AS p, count(*) FILTER (WHERE correctness >= 7) AS cp,
             count(*) FILTER (WHERE correctness < 7) AS cn FROM eb GROUP BY batch_id, confidence / 10.0),
grid AS (SELECT b.batch_id, c.p FROM (SELECT DISTINCT batch_id FROM eb) b, (SELECT DISTINCT p FROM h) c),
g2 AS (SELECT grid.batch_id, grid.p, coalesce(h.cp, 0) AS cp, coalesce(h.cn, 0) AS cn
       FROM grid LEFT JOIN h ON grid.batch_id = h.batch_id AND grid.p = h.p),
r2 AS (SELECT batch_id, p,
              sum(cp) OVER (PARTITION BY p ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ccp,
              sum(cn) OVER (PARTITION BY p ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ccn
       FROM g2),
b2 AS (SELECT *, coalesce(sum(ccn) OVER (PARTITION BY batch_id ORDER BY p
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r2),
ca AS (SELECT batch_id, CASE WHEN sum(ccp) * sum(ccn) > 0
                             THEN sum(ccp * (below + ccn / 2.0)) / (sum(ccp) * sum(ccn)) ELSE 0.0 END AS cauroc
       FROM b2 GROUP BY batch_id)"""

EVAL_CUMULATIVE = f"""
SELECT c.batch_id, c.n_seen, c.cumulative_ece, c.cumulative_accuracy, c.cumulative_conf_pos, c.cumulative_conf_neg,
       {rnd('ca.cauroc')} AS cumulative_auroc
FROM (SELECT batch_id, CAST(sum(n) {_W} AS BIGINT) AS n_seen,
             {rnd(f"sum(gap_sum) {_W} / (sum(n) {_W} * 10.0)")} AS cumulative_ece,
             {rnd(f"sum(acc_sum) {_W} / (sum(n) {_W} * 10.0)")} AS cumulative_accuracy,
             {rnd(f"sum(pos_sum) {_W} / (sum(greatest(pos_n, 1)) {_W} * 10.0)")} AS cumulative_conf_pos,
             {rnd(f"sum(neg_sum) {_W} / (sum(greatest(neg_n, 1)) {_W} * 10.0)")} AS cumulative_conf_neg
      FROM bp) c JOIN ca ON c.batch_id = ca.batch_id
"""
ORACLE["evaluation_cumulative"] = with_(JUDGE, EVAL) + EVAL_CUMULATIVE


def _dataset_log(k: int) -> str:
    """Batch and cumulative metrics of the questions with ``qid % 3 = k`` as a run of their own."""
    own = EVAL.replace("eb AS (", f"eown AS (SELECT * FROM escored WHERE qid % 3 = {k}),\neb AS (").replace(
        "AS batch_id FROM escored)", "AS batch_id FROM eown)")
    return with_(JUDGE, own) + f"""SELECT 'evaluation' AS run_id, 'set {k}' AS dataset, batch_id AS step, metric, value FROM
(UNPIVOT (SELECT b.batch_id, ece, accuracy, conf_pos, conf_neg, cumulative_ece, cumulative_accuracy, cumulative_conf_pos,
                 cumulative_conf_neg, cumulative_auroc FROM ({BATCH_METRICS}) b JOIN ({EVAL_CUMULATIVE}) c ON b.batch_id = c.batch_id)
 ON ece, accuracy, conf_pos, conf_neg, cumulative_ece, cumulative_accuracy, cumulative_conf_pos, cumulative_conf_neg, cumulative_auroc
 INTO NAME metric VALUE value) u"""


ORACLE["evaluation_metric_log"] = " UNION ALL ".join(f"SELECT * FROM ({_dataset_log(k)}) t{k}" for k in range(3))

REPORT_AGG = """count(*) AS n, sum(abs(confidence - correctness)) / (count(*) * 10.0) AS ece,
             sum(correctness) / (count(*) * 10.0) AS accuracy,
             CASE WHEN count(*) FILTER (WHERE correctness >= 7) > 0 THEN sum(confidence) FILTER (WHERE correctness >= 7)
                  / (count(*) FILTER (WHERE correctness >= 7) * 10.0) ELSE 0.0 END AS conf_pos,
             CASE WHEN count(*) FILTER (WHERE correctness <= 3) > 0 THEN sum(confidence) FILTER (WHERE correctness <= 3)
                  / (count(*) FILTER (WHERE correctness <= 3) * 10.0) ELSE 0.0 END AS conf_neg,
             count(*) FILTER (WHERE NOT confidence BETWEEN 0 AND 10) AS n_out_of_range,
             avg(reward) AS mean_reward"""
SEL = f"""n, {rnd('ece')} AS ece, {rnd('accuracy')} AS accuracy, {rnd('conf_pos')} AS conf_pos,
       {rnd('conf_neg')} AS conf_neg, n_out_of_range, {rnd('mean_reward')} AS mean_reward,
       {rnd('a.auroc')} AS auroc"""

ORACLE["evaluation_records"] = with_(JUDGE, EVAL) + f"""
, ez AS (SELECT p.qid, response, confidence, coalesce(g.correctness, 0.0) AS correctness, g.qid IS NOT NULL AS judged
         FROM eparsed p LEFT JOIN (SELECT * FROM ejudge WHERE qid % 7 <> 0) g ON p.qid = g.qid)
SELECT p.qid, p.response, p.confidence, p.correctness, p.judged, {rnd(REWARD)} AS reward
FROM ez p JOIN ez g ON p.qid = g.qid
"""

ORACLE["evaluation_overall"] = with_(JUDGE, EVAL) + f"""
SELECT {SEL}
FROM (SELECT {REPORT_AGG}
      FROM escored) b, ({auroc_sql('escored', [])}) a
"""


def _pairs_sql(mode: str) -> str:
    if mode == "position":
        zipped = ("list_transform(range(1, least(len(refl), len(cls)) + 1), "
                  "lambda k: {'reason': refl[k], 'c': cls[k]})")
    else:
        zipped = "list_transform(cls, lambda c: {'reason': refl[c.leader + 1], 'c': c})"
    return with_(SAMPLES, SPLIT_SAMPLES, PAIRS, LEADERS) + f"""
, reasons AS (SELECT question_id, list(reflection ORDER BY sample_idx) AS refl FROM split_samples GROUP BY question_id),
cl AS (SELECT question_id, list({{'pos': cluster_pos, 'leader': leader_idx, 'size': size}} ORDER BY cluster_pos) AS cls
       FROM ranked GROUP BY question_id),
z AS (SELECT cl.question_id,
             list_filter({zipped}, lambda p: NOT contains(p.reason, 'N/A')) AS pairs
      FROM cl JOIN reasons r ON r.question_id = cl.question_id)
SELECT question_id, CAST(k - 1 AS INTEGER) AS k, pairs[k].reason AS reason, pairs[k].c.leader AS leader_idx,
       pairs[k].c.size AS size
FROM z, range(1, len(pairs) + 1) t(k)
"""


ORACLE["reason_pairs"] = _pairs_sql("position")
ORACLE["reason_pairs_leader"] = _pairs_sql("leader")


# --- readers, hedges, cluster counts, prompts ------------------------------------------------

ORACLE["read_any_lists"] = with_(TURNS) + f"""
SELECT conv_id, turn, len({tok('content')}) AS n_tokens,
       CAST(coalesce(list_sum(list_transform({tok('content')}, lambda x: length(x))), 0) AS BIGINT) AS n_chars
FROM turns
"""

ORACLE["split_choice"] = "SELECT doc_id, lang, 'test' AS split FROM documents WHERE doc_id % 10 = 0"

ORACLE["hedge_cut"] = with_(TURNS) + f"""
, turns2 AS (SELECT conv_id, turn, role, i, n,
                    CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN content || ' I am 80% sure' ELSE content END AS content FROM turns)
SELECT conv_id, prompt, {_HEDGE_CUT} AS answer FROM ({_chat_pa('eval').replace('FROM turns', 'FROM turns2')}) z
"""

ORACLE["min_clusters"] = with_(SAMPLES, PAIRS, LEADERS) + \
    "SELECT question_id, count(*) AS n_clusters FROM ranked GROUP BY question_id HAVING count(*) >= 3"

ORACLE["encode_prompts"] = with_(TURNS) + f"""
SELECT conv_id, least(len({tok('prompt')}), 64) AS n_ids, greatest(len({tok('prompt')}) - 64, 0) AS n_cut
FROM ({_chat_pa('eval')}) z
"""

ORACLE["scoring_view"] = f"SELECT qid, question, best_answer, correct_answers FROM ({ORACLE['qa_normalise']}) z"

ORACLE["stream_resume"] = with_(ORDER_BATCHES) + f"""
SELECT n, {rnd('ece')} AS ece, {rnd('accuracy')} AS accuracy, {rnd('conf_pos')} AS conf_pos, {rnd('conf_neg')} AS conf_neg,
       {rnd('a.auroc')} AS auroc
FROM (SELECT {REPORT_AGG.replace('avg(reward) AS mean_reward', 'NULL AS mean_reward')} FROM ob) b, ({auroc_sql('ob', [])}) a
"""

ORACLE["stream_records_resume"] = ORACLE["judge_two_line"]
