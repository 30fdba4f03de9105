"""Query catalogue: one callable per operator group, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the derived views) and runs
over them whole.  Doubles are rounded to 6 places so results can be
compared with the DuckDB oracle text in ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity import session as SESSION
from veracity.functions import text as TEXT
from veracity.operators import cluster as CL
from veracity.operators import metrics as MET
from veracity.operators import prompts as PR
from veracity.operators import responses as RESP
from veracity.operators import rows as ROWS
from veracity.operators import runlog as RUNLOG
from veracity.operators import schema as SCHEMA
from veracity.operators import training as TRAIN
from veracity.plans import derived as D
from veracity.plans import evaluation as EVAL
from veracity.sources import io as IO
from veracity.streaming import calibration as STREAM

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    """Round to 6 places as ``floor(x * 1e6 + 0.5) / 1e6``: plain IEEE steps, so the
    oracle gets the same bits (``round`` differs between engines on ties)."""
    x = F.col(c) if isinstance(c, str) else c
    # Beyond |x| = 4e9 a double has no 6th decimal left (and floor() would
    # overflow a long), so large values keep 12 significant digits instead:
    # sums of huge parsed confidences differ in the last bits between engines.
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 11)
    return (F.when(F.abs(x) < 4e9, F.floor(x * 1e6 + 0.5) / 1e6)
            .otherwise(F.floor(x / scale + 0.5) * scale))


def _rounded(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


# --- J3 parse ------------------------------------------------------------------

@query("parse_main")
def parse_main(spark, sf):
    p = RESP.parse_responses(D.responses(spark, sf), "main")
    return p.select("qid", "reflection", "confidence", "parse_status")


@query("calibration_by_lang")
def calibration_by_lang(spark, sf):
    parsed = RESP.parse_responses(D.responses(spark, sf), "main")
    scored = RESP.score_responses(parsed, D.gold_scores(spark, sf))
    rep = MET.calibration_report(scored, ["dataset"])
    return _rounded(rep, ["ece", "accuracy", "conf_pos", "conf_neg", "auroc", "mean_reward"])


@query("parse_rtuning")
def parse_rtuning(spark, sf):
    p = RESP.parse_responses(D.rtuning_responses(spark, sf), "rtuning")
    return p.select("qid", "confidence", "parse_status")


@query("parse_legacy")
def parse_legacy(spark, sf):
    p = RESP.parse_responses(D.legacy_responses(spark, sf), "legacy")
    return p.select("qid", "answer", "confidence", "parse_status")


@query("sample_split")
def sample_split(spark, sf):
    s = RESP.split_samples(D.samples(spark, sf).drop("embedding"), "text")
    return s.select("question_id", "sample_idx", "chain", "reflection")


@query("clean_response")
def clean_response(spark, sf):
    c = RESP.clean_responses(D.decoded_responses(spark, sf), rtuning=True)
    return c.select("qid", "cleaned", "truncated", "was_truncated")


@query("parse_report")
def parse_report(spark, sf):
    p = RESP.parse_responses(D.responses(spark, sf), "main")
    return RESP.parse_report(p)


def _scored(spark, sf):
    parsed = RESP.parse_responses(D.responses(spark, sf), "main")
    return RESP.score_responses(parsed, D.gold_scores(spark, sf))


@query("reward")
def reward(spark, sf):
    s = _scored(spark, sf)
    return s.select("qid", "correctness", "confidence", r6("reward").alias("reward"), "reward_out_of_range")


@query("reward_sign")
def reward_sign(spark, sf):
    parsed = RESP.parse_responses(D.responses(spark, sf), "main")
    s = RESP.score_responses(parsed, D.gold_scores(spark, sf), variant="sign")
    return s.select("qid", r6("reward").alias("reward"))


@query("substring_correctness")
def substring_correctness(spark, sf):
    parsed = RESP.parse_responses(D.responses(spark, sf), "main")
    s = RESP.substring_scores(parsed, D.gold(spark, sf))
    return s.select("qid", "correctness")


@query("nonsense_penalty")
def nonsense_penalty(spark, sf):
    s = RESP.penalise_nonsense(_scored(spark, sf))
    return s.select("qid", "nonsense", r6("reward").alias("reward"))


@query("calibration_overall")
def calibration_overall(spark, sf):
    rep = MET.calibration_report(_scored(spark, sf))
    return _rounded(rep, ["ece", "accuracy", "conf_pos", "conf_neg", "auroc", "mean_reward"])


@query("conf_reward_gap")
def conf_reward_gap(spark, sf):
    g = MET.conf_reward_gap(_scored(spark, sf), ["dataset"])
    return _rounded(g, ["conf_reward_gap"])


def _order_batches(spark, sf, size=8):
    return ROWS.with_batches(D.scored_orders(spark, sf), "o_orderkey", size=size)


@query("calibration_batches")
def calibration_batches(spark, sf):
    b = MET.batch_metrics(_order_batches(spark, sf))
    return _rounded(b, ["ece", "accuracy", "conf_pos", "conf_neg"])


@query("calibration_cumulative")
def calibration_cumulative(spark, sf):
    c = MET.cumulative_metrics(_order_batches(spark, sf))
    return _rounded(c, ["cumulative_ece", "cumulative_accuracy", "cumulative_conf_pos",
                        "cumulative_conf_neg"])


@query("auroc_cumulative")
def auroc_cumulative(spark, sf):
    return _rounded(MET.cumulative_auroc(_order_batches(spark, sf)), ["cumulative_auroc"])


@query("auroc_cumulative_wide")
def auroc_cumulative_wide(spark, sf):
    b = ROWS.with_batches(D.wide_confidences(spark, sf), "o_orderkey", size=64)
    return _rounded(MET.cumulative_auroc(b, ["o_orderstatus"], count_null=True), ["cumulative_auroc"])


@query("batches_with_nulls")
def batches_with_nulls(spark, sf):
    b = MET.batch_metrics(ROWS.with_batches(D.wide_confidences(spark, sf), "o_orderkey", size=64), ["o_orderstatus"])
    return _rounded(b, ["ece", "accuracy", "conf_pos", "conf_neg"])


@query("preview")
def preview(spark, sf):
    return ROWS.preview(_order_batches(spark, sf)).select("o_orderkey", "batch_id", "pos_in_batch")


@query("resolve_attempts")
def resolve_attempts(spark, sf):
    return RESP.resolve_attempts(D.attempts(spark, sf), max_tries=2, mode="main")


@query("resolve_attempts_five")
def resolve_attempts_five(spark, sf):
    return RESP.resolve_attempts(D.five_attempts(spark, sf), max_tries=3, mode="main")


@query("resolve_attempts_ppo")
def resolve_attempts_ppo(spark, sf):
    return RESP.resolve_attempts(D.five_attempts(spark, sf), max_tries=3, style="ppo")


@query("truncate_literal")
def truncate_literal(spark, sf):
    c = RESP.clean_responses(D.decoded_responses(spark, sf), literal="I am")
    return c.select("qid", "truncated", "was_truncated")


@query("judge_scores")
def judge_scores(spark, sf):
    return RESP.judge_scores(D.judge_replies(spark, sf), max_tries=3)


@query("output_records")
def output_records(spark, sf):
    parsed = RESP.parse_responses(D.responses(spark, sf), "main")
    s = RESP.score_responses(parsed, D.gold_scores(spark, sf))
    g = D.gold(spark, sf).select("qid", F.col("gold_text").alias("best_answer"))
    return RESP.output_records(s, g).select("qid", "best_answer", "response", "correctness")


@query("metric_log")
def metric_log(spark, sf):
    b = MET.batch_metrics(_order_batches(spark, sf))
    long = IO.to_metric_log(b, run_id="orders", step="batch_id",
                         metrics=["ece", "accuracy", "conf_pos", "conf_neg"])
    return _rounded(long, ["value"])


# --- J1 / J2 ingest and prompts ----------------------------------------------------

def _chats(spark, sf):
    return SCHEMA.build_chats(D.turns(spark, sf))


@query("qa_normalise")
def qa_normalise(spark, sf):
    raw = D.qa_records(spark, sf)
    q = SCHEMA.normalise(raw, SCHEMA.detect_format(raw))
    return q.select("qid", "question", "best_answer",
                    F.array_join("correct_answers", "|").alias("correct_answers"),
                    F.array_join("negative_answers", "|").alias("negative_answers"))


@query("scoring_view")
def scoring_view(spark, sf):
    # What scoring needs, without the negatives.
    v = SCHEMA.scoring_view(SCHEMA.normalise(D.qa_records(spark, sf), "qa"))
    return v.withColumn("correct_answers", F.array_join("correct_answers", "|"))


@query("yesno_normalise")
def yesno_normalise(spark, sf):
    raw = D.yesno_records(spark, sf)
    q = SCHEMA.normalise(raw, SCHEMA.detect_format(raw))
    return q.select("qid", "best_answer", F.array_join("correct_answers", "|").alias("correct_answers"))


@query("qa_prompts")
def qa_prompts(spark, sf):
    q = SCHEMA.normalise(D.qa_records(spark, sf), "qa")
    q = PR.render_prompt(q, "tag", out="prompt_tag")
    q = PR.render_prompt(q, "tag", instruction="Say how sure you are.", bos="<s>", out="prompt_tag_conf")
    q = PR.render_prompt(q, "newline", out="prompt_newline")
    q = PR.render_prompt(q, "newline", instruction="Say how sure you are.", out="prompt_newline_conf")
    q = PR.render_prompt(q, "untuned", out="prompt_untuned")
    q = PR.render_prompt(q, "pair", response="best_answer", out="prompt_pair")
    return q.select("qid", "prompt_tag", "prompt_tag_conf", "prompt_newline", "prompt_newline_conf",
                    "prompt_untuned", "prompt_pair")


@query("chat_train_text")
def chat_train_text(spark, sf):
    return PR.chat_text(_chats(spark, sf)).select("conv_id", "text")


@query("chat_prompt_answer")
def chat_prompt_answer(spark, sf):
    return PR.chat_prompt_answer(_chats(spark, sf), "eval").select("conv_id", "prompt", "answer", "question")


@query("chat_prompt_answer_ppo")
def chat_prompt_answer_ppo(spark, sf):
    return PR.chat_prompt_answer(_chats(spark, sf), "ppo", bos="<s>").select("conv_id", "prompt", "answer", "question")


@query("chat_explicit_confidence")
def chat_explicit_confidence(spark, sf):
    c = PR.chat_prompt_answer(_chats(spark, sf), "eval", instruction="State your confidence. ")
    return c.select("conv_id", "prompt", "question")


@query("word_budget")
def word_budget(spark, sf):
    return ROWS.word_budget(_chats(spark, sf), 200).select("conv_id", "n_words")


@query("word_budget_long")
def word_budget_long(spark, sf):
    t = ROWS.word_budget_long(D.turns(spark, sf), 100, text="content")
    return t.groupBy("conv_id").agg(F.sum(TEXT.word_count("content")).alias("n_words"),
                                    F.count(F.lit(1)).alias("n_messages"))


@query("chat_validate")
def chat_validate(spark, sf):
    t = D.turns(spark, sf)
    t = t.withColumn("role", F.when((F.col("conv_id") % 17 == 0) & (F.col("turn") == 1), F.lit("tool"))
                     .otherwise(F.col("role")))
    good, bad = SCHEMA.validate_chat(SCHEMA.build_chats(t))
    return good.select("conv_id", F.lit("ok").alias("status")).unionByName(
        bad.select("conv_id", F.col("problem").alias("status")))


@query("prompt_completion")
def prompt_completion(spark, sf):
    return PR.join_completion(D.pair_records(spark, sf)).select("qid", "text")


@query("sft_text_from_pairs")
def sft_text_from_pairs(spark, sf):
    q = D.qa_records(spark, sf).withColumnRenamed("answer", "response")
    return PR.chat_text(SCHEMA.qa_to_chat(q)).select(F.col("conv_id").alias("qid"), "text")


@query("judge_prompt")
def judge_prompt(spark, sf):
    q = SCHEMA.normalise(D.qa_records(spark, sf), "qa")
    q = q.withColumn("response", F.concat(F.lit("resp <QUESTION> "), F.col("qid").cast("string")))
    q = PR.judge_prompt(q, out="judge_prompt")
    q = PR.judge_prompt(q, template="Q=<QUESTION>|R=<RESPONSE>|B=<BEST_ANSWER>|O=<OTHER_CORRECT_ANSWERS>",
           others="correct_answers", out="judge_prompt_other")
    return q.select("qid", "judge_prompt", "judge_prompt_other")


# --- F2-F7 order, slices, splits --------------------------------------------------------

@query("row_index")
def row_index(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ROWS.with_row_index(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_idx")


@query("row_slice")
def row_slice(spark, sf):
    # F1 then F2: the slice counts rows that passed the word budget, in chat order.
    c = ROWS.word_budget(SCHEMA.build_chats(D.turns(spark, sf)), 400).select("conv_id")
    return ROWS.slice_in_order(c, "conv_id", 5, 20).select("conv_id", "row_idx")


@query("double_slice")
def double_slice(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id")
    return ROWS.slice_in_order(d, "doc_id", 100, min(50, 700 - 100)).select("doc_id", "row_idx")


@query("split_rows")
def split_rows(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id")
    return ROWS.split_rows(d, "doc_id", 0.01, seed=42).select("doc_id", "split")


@query("seeded_order")
def seeded_order(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id")
    return ROWS.seeded_order(d, "doc_id", seed=42).select("doc_id", "shuffle_idx")


@query("sample_rows")
def sample_rows(spark, sf):
    return ROWS.sample_rows(D.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", k=3, seed=42)


@query("split_sizes")
def split_sizes(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id")
    return ROWS.split_sizes(ROWS.split_rows(d, "doc_id", 0.01, seed=42))


# --- J8 consistency: clustering, pairing, ratings ------------------------------------------

CLUSTER_T = 0.25  # the driver embeddings have no pair above 0.9 (max about 0.51)


@query("similar_pairs")
def similar_pairs(spark, sf):
    p = CL.similar_pairs(D.samples(spark, sf), CLUSTER_T)
    return p.select("question_id", "i", "j", r6("cosine").alias("cosine"))


@query("leader_clusters")
def leader_clusters(spark, sf):
    clusters = CL.leader_clusters(D.samples(spark, sf), CLUSTER_T)
    return clusters.select("question_id", "cluster_pos", "leader_idx", "size", "size_rank")


@query("leader_clusters_growing")
def leader_clusters_growing(spark, sf):
    # A question that grows with the table, in rounds (limit of 200 pairs for the fold, so both ways run here).
    good, zero = CL.checked_clusters(D.growing_samples(spark, sf), CLUSTER_T, fold_pairs=200)
    return good.select("question_id", F.lit("cluster").alias("kind"), F.col("leader_idx").alias("sample_idx"), "size", "size_rank").unionByName(
        zero.select("question_id", F.lit("no vector").alias("kind"), "sample_idx", F.lit(0).alias("size"), F.lit(-1).alias("size_rank")))


@query("similar_pairs_growing")
def similar_pairs_growing(spark, sf):
    # A third of all vectors in one question: its blocks, without the pairs of blocks that the pivots exclude.
    p = CL.similar_pairs(D.folded_samples(spark, sf), 0.95)
    return p.select("question_id", "i", "j", r6("cosine").alias("cosine"))


@query("group_samples")
def group_samples(spark, sf):
    s = RESP.split_samples(D.samples(spark, sf).drop("embedding"), "text")
    g = CL.group_samples(s)
    return g.select("question_id", F.col("n_samples").cast("bigint").alias("n_samples"),
                    F.array_join("chains", "|").alias("chains"),
                    F.array_join("reflections", "|").alias("reflections"))


@query("cluster_listing")
def cluster_listing(spark, sf):
    s = RESP.split_samples(D.samples(spark, sf), "text")
    clusters = CL.leader_clusters(s, CLUSTER_T, text="chain")
    paired = CL.pair_reasons(CL.group_samples(s), clusters)
    question = F.concat(F.lit("[INST] question "), F.col("question_id").cast("string"), F.lit(" [/INST]"))
    lst = PR.cluster_listing("kept_clusters")
    return paired.select(
        "question_id", F.col("n_clusters").cast("bigint").alias("n_clusters"),
        F.size("reasons").cast("bigint").alias("n_kept"), lst.alias("listing"),
        PR.summary_prompt("reasons").alias("summary_prompt"),
        PR.rating_prompt(question, lst, F.get("reasons", 0)).alias("rating_prompt"))


@query("rating_extract")
def rating_extract(spark, sf):
    return CL.extract_ratings(D.rating_replies(spark, sf), max_tries=4)


@query("rating_mean")
def rating_mean(spark, sf):
    m = CL.rating_mean(CL.extract_ratings(D.rating_replies(spark, sf), max_tries=4))
    return _rounded(m, ["mean_score"])


@query("rated_questions_capped")
def rated_questions_capped(spark, sf):
    r = CL.extract_ratings(D.rating_replies(spark, sf), max_tries=4)
    return CL.cap_questions(r.select("question_id", "numerical_score", "parsed"), 100)


@query("summary_extract")
def summary_extract(spark, sf):
    return CL.extract_summaries(D.summary_replies(spark, sf), max_tries=3)


# --- J9 training tables -----------------------------------------------------------

def _sft(spark, sf, max_len=400):
    return TRAIN.trainable_only(TRAIN.sft_rows(_chats(spark, sf), "chat", max_len=max_len, keep=("conv_id",)))


@query("sft_rows")
def sft_rows(spark, sf):
    r = _sft(spark, sf)
    return r.select("conv_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_masked"),
                    F.array_join("tokens", " ").alias("tokens"))


@query("sft_rows_pairs")
def sft_rows_pairs(spark, sf):
    q = D.qa_records(spark, sf).withColumnRenamed("answer", "response")
    r = TRAIN.sft_rows(q, "pair", max_len=400, keep=("qid",))
    return r.select("qid", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_masked"))


@query("sft_rows_completion")
def sft_rows_completion(spark, sf):
    r = TRAIN.sft_rows(D.pair_records(spark, sf), "prompt_completion", max_len=400, keep=("qid",))
    return r.select("qid", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_masked"))


@query("pad_batches")
def pad_batches(spark, sf):
    b = TRAIN.padded_batches(_sft(spark, sf), "conv_id", size=8)
    return b.select("conv_id", "batch_id", F.size("input_ids").cast("bigint").alias("padded_len"),
                    F.size(F.filter("attention_mask", lambda x: x == 0)).cast("bigint").alias("n_pad"),
                    F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_ignored"))


@query("unpad")
def unpad(spark, sf):
    b = TRAIN.unpad(TRAIN.padded_batches(_sft(spark, sf), "conv_id", size=8))
    return b.select("conv_id", F.size("input_ids").cast("bigint").alias("n_ids"),
                    (F.col("input_ids") == F.transform("tokens", lambda w: F.xxhash64(w))).alias("same_ids"))


def _mask_rows(spark, sf):
    t = D.turns(spark, sf).filter(F.col("role") == "assistant")
    k = F.col("turn") % 3
    head = F.col("content")
    resp = (F.when(k == 0, F.concat(head, F.lit(" Confidence: "), F.col("turn").cast("string")))
            .when(k == 1, F.concat(head, F.lit(" Confidence:")))
            .otherwise(head))
    t = ROWS.computed_once(t.select("conv_id", "turn", resp.alias("response")), {"tokens": TRAIN.tokens("response")}).drop("response")
    return TRAIN.response_mask(t.withColumn("input_ids", F.transform("tokens", lambda w: F.xxhash64(w))))


@query("response_mask_subwords")
def response_mask_subwords(spark, sf):
    # Pieces of three characters, so the marker is spread over several tokens.
    t = D.turns(spark, sf).filter(F.col("role") == "assistant")
    text = F.concat("content", F.when(F.col("turn") % 3 == 2, F.lit("")).otherwise(F.lit(" Confidence:")),
                    F.when(F.col("turn") % 3 == 0, F.lit(" 7 of 10")).otherwise(F.lit("")))

    def pieces(c):
        return F.filter(F.split(F.regexp_replace(c, "(?s)(.{3})", "$1\x01"), "\x01"), lambda x: x != "")

    t = ROWS.computed_once(t.select("conv_id", "turn", text.alias("text")), {"tokens": pieces(F.col("text"))}).drop("text")
    m = TRAIN.response_mask(t, joiner="")
    return m.select("conv_id", "turn", F.size("tokens").cast("bigint").alias("n_tokens"), "first_idx", "nonsense",
                    F.aggregate("response_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_ones"))


@query("response_mask")
def response_mask(spark, sf):
    m = _mask_rows(spark, sf)
    return m.select("conv_id", "turn", F.size("tokens").cast("bigint").alias("n_tokens"), "first_idx", "nonsense",
                    F.aggregate("response_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_ones"))


@query("check_lengths")
def check_lengths(spark, sf):
    return TRAIN.length_report(_mask_rows(spark, sf))


# --- J11 run logs -----------------------------------------------------------------

@query("best_checkpoints")
def best_checkpoints(spark, sf):
    return _rounded(RUNLOG.best_checkpoints(D.run_log(spark, sf)), ["value"])


@query("loss_rollup")
def loss_rollup(spark, sf):
    return _rounded(RUNLOG.loss_rollup(D.dense_log(spark, sf), k=10, grad_acc=3), ["avg_loss"])


# --- S*, J10 sources, sinks, streaming -------------------------------------------------

def _scratch(spark, name: str) -> str:
    return SESSION.scratch_path(spark, name)


@query("json_roundtrip")
def json_roundtrip(spark, sf):
    path = _scratch(spark, "responses-json")
    IO.write_records(D.responses(spark, sf), path)
    back = IO.read_jsonl(spark, path, "qid bigint, dataset string, response string")
    return RESP.parse_responses(back, "main").select("qid", "dataset", "confidence")


@query("snapshot_roundtrip")
def snapshot_roundtrip(spark, sf):
    path = _scratch(spark, "ratings-snapshots")
    r = CL.extract_ratings(D.rating_replies(spark, sf), max_tries=4).withColumn("row_idx", F.col("question_id"))
    IO.write_snapshots(r, path, every=100)
    back = spark.read.schema("question_id bigint, reply string, numerical_score double, parsed boolean, "
                             "row_idx bigint, snapshot bigint").json(path)
    return back.groupBy(F.col("snapshot").cast("bigint").alias("snapshot")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("parsed"), 1)).alias("n_parsed"))


@query("stream_calibration")
def stream_calibration(spark, sf):
    docs = D.table(spark, sf, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf.rstrip('/')}/documents*.parquet")
    # Same derivation as the batch view, on the stream, joined with the static gold table.
    a = F.concat(F.lit("Answer: "), F.col("text"))
    c = ((F.col("doc_id") * 7 + 3) % 13).cast("string")
    k = F.col("doc_id") % 10
    lang = F.col("lang")
    resp = (F.when(k < 6, F.concat(a, F.lit(" Self-reflection: about "), lang, F.lit(" Confidence: "), c))
            .when(k == 6, F.concat(a, F.lit(" Self-reflection: about "), lang))
            .when(k == 7, F.concat(a, F.lit(" Confidence: "), c))
            .when(k == 8, F.concat(a, F.lit(" Self-reflection: about "), lang, F.lit(" Confidence: "), c,
                                   F.lit("/10")))
            .otherwise(F.concat(F.lit("Confidence: "), c, F.lit(" Self-reflection: late"))))
    s = stream.select(F.col("doc_id").alias("qid"), lang.alias("dataset"), resp.alias("response"))
    parsed = RESP.parse_responses(s, "main")
    scored = parsed.join(D.gold_scores(spark, sf), "qid")
    rep = STREAM.run_to_report(spark, scored, _scratch(spark, "stream-calibration"), ["dataset"])
    return _rounded(rep, ["ece", "accuracy", "conf_pos", "conf_neg", "auroc"])


def _in_two_parts(spark, rows, key, path, drain):
    """Write half of the rows to ``path``, drain the stream, add the rest and drain it again from its checkpoint."""
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    for part in (0, 1):
        rows.filter(F.pmod(F.xxhash64(key), F.lit(2)) == part).repartition(2).write.parquet(f"{path}/part={part}")
        drain(stream).awaitTermination()


@query("stream_resume")
def stream_resume(spark, sf):
    # ST1, ST3: several micro-batches, stopped, the source extended, resumed from the checkpoint.
    work = _scratch(spark, "stream-resume")
    _in_two_parts(spark, D.scored_orders(spark, sf), "o_orderkey", f"{work}/in",
                  lambda s: STREAM.stream_calibration(s, f"{work}/histogram", f"{work}/checkpoint"))
    rep = STREAM.report_from_histogram(STREAM.latest_histogram(spark, f"{work}/histogram"))
    return _rounded(rep, ["ece", "accuracy", "conf_pos", "conf_neg", "auroc"])


@query("stream_records_resume")
def stream_records_resume(spark, sf):
    # ST2, ST3: judge replies appended by a stream that is stopped and resumed; every row is there once.
    work = _scratch(spark, "stream-records")
    replies = D.judge_replies(spark, sf).select("qid", "attempt", "reply")
    _in_two_parts(spark, replies, "qid", f"{work}/in", lambda s: STREAM.stream_records(s, f"{work}/out", f"{work}/checkpoint"))
    back = spark.read.schema(replies.schema).json(f"{work}/out")
    return RESP.judge_two_line(back).select("qid", "attempt", "explanation", "score")


@query("ppo_slices")
def ppo_slices(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id")
    return ROWS.capped_train_and_test(d, "doc_id", 0.1, seed=7, cap=800, start=100, n=500)


@query("stage_counts")
def stage_counts(spark, sf):
    chats = _chats(spark, sf)
    n = chats.select(ROWS.chat_word_count("messages").alias("n"))
    return ROWS.condition_counts(n, {"chats": F.lit(True), "under_200_words": F.col("n") < 200, "under_100_words": F.col("n") < 100})


@query("judge_two_line")
def judge_two_line(spark, sf):
    r = D.judge_replies(spark, sf)
    return RESP.judge_two_line(r).select("qid", "attempt", "explanation", "score")


@query("read_any_rejects")
def read_any_rejects(spark, sf):
    path = _scratch(spark, "chats-jsonl")
    whole = F.to_json(F.struct("conv_id", "messages"))
    lines = _chats(spark, sf).select(F.explode(F.when(F.col("conv_id") % 10 == 0, F.array(whole, F.concat(F.lit("{bad "), "conv_id")))
                                               .otherwise(F.array(whole))).alias("value"))
    lines.write.text(path)
    good, bad = IO.read_checked(spark, path)
    return good.select(F.lit("good").alias("status"), "conv_id", F.size("messages").cast("bigint").alias("n")).unionByName(
        bad.groupBy().agg(F.lit("bad").alias("status"), F.lit(-1).cast("bigint").alias("conv_id"), F.count(F.lit(1)).alias("n"))
        .select("status", "conv_id", "n"))


@query("read_any_lists")
def read_any_lists(spark, sf):
    # Lines whose first field is a list of plain values: still one row for each line.
    path = _scratch(spark, "lists-jsonl")
    t = D.turns(spark, sf).withColumn("tokens", TRAIN.tokens("content"))
    t.select("tokens", F.transform("tokens", lambda x: F.length(x)).alias("labels"), "conv_id", "turn").write.json(path)
    back = IO.read_any(spark, path)
    return back.select("conv_id", F.col("turn").cast("int").alias("turn"), F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_chars"))


@query("split_choice")
def split_choice(spark, sf):
    # The whole folder is read, and the first split there is in order of preference.
    path = _scratch(spark, "splits")
    d = D.table(spark, sf, "documents").select("doc_id", "lang")
    named = F.when(F.col("doc_id") % 10 == 0, F.lit("test")).otherwise(F.lit("train"))
    d.withColumn("split", named).write.partitionBy("split").parquet(path)
    return IO.read_split(spark.read.parquet(path)).select("doc_id", "lang", "split")


@query("hedge_cut")
def hedge_cut(spark, sf):
    # Answers that end in a stated confidence lose it.
    t = D.turns(spark, sf)
    hedged = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.concat("content", F.lit(" I am 80% sure")))
    chats = SCHEMA.build_chats(t.withColumn("content", F.coalesce(hedged, F.col("content"))))
    return PR.chat_prompt_answer(chats, "eval", cut_hedge=True).select("conv_id", "prompt", "answer")


@query("min_clusters")
def min_clusters(spark, sf):
    clusters = CL.leader_clusters(D.samples(spark, sf), CLUSTER_T)
    n = clusters.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_clusters"))
    return CL.min_clusters(n, 3)


@query("encode_prompts")
def encode_prompts(spark, sf):
    # T1 for evaluation prompts: at most 64 ids, and how many were cut.
    p = PR.chat_prompt_answer(_chats(spark, sf), "eval")
    e = TRAIN.encode_prompts(p, max_len=64)
    return e.select("conv_id", F.size("input_ids").cast("bigint").alias("n_ids"), F.col("n_cut").cast("bigint").alias("n_cut"))


# --- end-to-end evaluation ----------------------------------------------------

def _evaluation(spark, sf):
    return EVAL.EvaluationRun(D.eval_attempts(spark, sf), D.judge_replies(spark, sf), batch_size=8, max_tries=2)


@query("evaluation_cumulative")
def evaluation_cumulative(spark, sf):
    c = _evaluation(spark, sf).cumulative()
    return _rounded(c, ["cumulative_ece", "cumulative_accuracy", "cumulative_conf_pos", "cumulative_conf_neg",
                        "cumulative_auroc"])


@query("evaluation_metric_log")
def evaluation_metric_log(spark, sf):
    # A run over three datasets, each with its own batches; every metric per batch and up to it as log rows.
    run = EVAL.EvaluationRun(D.eval_attempts(spark, sf), D.judge_replies(spark, sf), batch_size=8, max_tries=2,
                             datasets=D.eval_datasets(spark, sf))
    return _rounded(run.metric_log("evaluation"), ["value"])


@query("evaluation_records")
def evaluation_records(spark, sf):
    # The judge never answered for every seventh question: they stay, with score 0.
    replies = D.judge_replies(spark, sf).where(F.col("qid") % 7 != 0)
    run = EVAL.EvaluationRun(D.eval_attempts(spark, sf), replies, batch_size=8, max_tries=2)
    return run.records().select("qid", "response", "confidence", "correctness", "judged", r6("reward").alias("reward"))


@query("evaluation_overall")
def evaluation_overall(spark, sf):
    o = _evaluation(spark, sf).overall()
    return _rounded(o, ["ece", "accuracy", "conf_pos", "conf_neg", "auroc", "mean_reward"])


def _reason_pairs(spark, sf, pair):
    s = RESP.split_samples(D.samples(spark, sf), "text")
    clusters = CL.leader_clusters(s, CLUSTER_T, text="chain")
    p = CL.pair_reasons(CL.group_samples(s), clusters, pair=pair)
    z = p.select("question_id", F.posexplode(F.arrays_zip("reasons", "kept_clusters")).alias("k", "z"))
    return z.select("question_id", F.col("k").cast("int").alias("k"), F.col("z.reasons").alias("reason"),
                    F.col("z.kept_clusters.leader_idx").alias("leader_idx"), F.col("z.kept_clusters.size").alias("size"))


@query("reason_pairs")
def reason_pairs(spark, sf):
    return _reason_pairs(spark, sf, "position")


@query("reason_pairs_leader")
def reason_pairs_leader(spark, sf):
    return _reason_pairs(spark, sf, "leader")
