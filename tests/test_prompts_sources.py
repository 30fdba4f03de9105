"""Prompt rendering, ingest, sources and sinks, streaming = batch."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from veracity.operators import prompts as PR
from veracity.operators import schema as SC
from veracity.sources import io as IO


def _chat(spark, msgs):
    return spark.createDataFrame(
        [(0, [{"turn": i, "role": r, "content": c} for i, (r, c) in enumerate(msgs)])],
        "conv_id long, messages array<struct<turn:int,role:string,content:string>>")


def test_chat_text_and_prompt_answer(spark):
    df = _chat(spark, [("system", " s "), ("user", "q1"), ("assistant", "a1"), ("user", "q2"),
                       ("assistant", " final I am sure ")])
    assert PR.chat_text(df).first().text == "[INST]\ns[/INST]\n[INST]\nq1[/INST]\na1</s>\n[INST]\nq2[/INST]\nfinal I am sure</s>"
    ev = PR.chat_prompt_answer(df, "eval").first()
    assert ev.prompt == "[INST]\ns[/INST]\n[INST]\nq1[/INST]\n\na1</s>\n[INST]\nq2[/INST]\n"
    assert ev.answer == "final " and ev.question == "q2"
    ppo = PR.chat_prompt_answer(df, "ppo").first()
    assert ppo.prompt.endswith("[/INST]\n\n") and ppo.answer == "final I am sure"


def test_unknown_role_quarantined(spark):
    df = _chat(spark, [("user", "q"), ("tool", "x")])
    good, bad = SC.validate_chat(df)
    assert good.count() == 0 and bad.first().problem == "unknown_role"
    assert PR.chat_text(df).first().text is None


def test_join_completion(spark):
    df = spark.createDataFrame([("a", "b"), ("a ", "b"), ("a", "\nb"), ("", "b")], "prompt string, completion string")
    got = [r.text for r in PR.join_completion(df, eos="<e>").collect()]
    assert got == ["a b<e>", "a b<e>", "a\nb<e>", " b<e>"]


def test_detect_and_normalise(spark):
    yn = spark.createDataFrame([(1, "q", True, "", ""), (2, "q", None, "", "")],
                               "qid long, question string, answer boolean, facts string, term string")
    assert SC.detect_format(yn) == "yesno"
    assert [r.best_answer for r in SC.normalise(yn).orderBy("qid").collect()] == ["True", "False"]
    qa = spark.createDataFrame([(1, " q ", " a ", "x/y/")], "qid long, question string, answer string, negative_answer string")
    r = SC.normalise(qa).first()
    assert (r.question, r.best_answer, r.negative_answers) == ("q", "a", ["x", "y", ""])
    with pytest.raises(ValueError):
        SC.detect_format(spark.range(1), purpose="ppo")


def test_columnar_and_record_json(spark):
    d = tempfile.mkdtemp(prefix="veracity-test-")
    col = os.path.join(d, "columnar.json")
    with open(col, "w") as f:
        json.dump({"question": ["q0", "q1", "q2"], "answer": ["a0", "a1", "a2"]}, f)
    got = IO.read_columnar_json(spark, col).orderBy("row_idx").collect()
    assert [(r.row_idx, r.question, r.answer) for r in got] == [(0, "q0", "a0"), (1, "q1", "a1"), (2, "q2", "a2")]
    assert IO.read_any(spark, col).count() == 3
    rec = os.path.join(d, "records.json")
    with open(rec, "w") as f:
        json.dump([{"question": "q", "answer": "a", "negative_answer": "n"}], f)
    assert IO.read_record_json(spark, rec).columns == ["question", "answer", "negative_answer"]
    assert IO.read_any(spark, rec).count() == 1
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        json.dump([{"question": "q"}], f)
    with pytest.raises(ValueError):
        IO.read_record_json(spark, bad)


def test_read_split_prefers_validation(spark):
    df = spark.createDataFrame([("train", 1), ("test", 2), ("validation", 3)], "split string, v int")
    assert [r.v for r in IO.read_split(df).collect()] == [3]
    assert [r.v for r in IO.read_split(df.filter("split <> 'validation'")).collect()] == [2]


def test_metric_log(spark):
    df = spark.createDataFrame([(0, 0.5, 0.25)], "batch_id long, ece double, accuracy double")
    rows = IO.to_metric_log(df, "r1", "batch_id", ["ece", "accuracy"]).collect()
    assert sorted((r.metric, r.value) for r in rows) == [("accuracy", 0.25), ("ece", 0.5)]


def test_stream_equals_batch(spark):
    from veracity.plans.catalog import QUERIES
    s = sorted(tuple(r) for r in QUERIES["stream_calibration"](spark, SF_SMALL).collect())
    b = QUERIES["calibration_by_lang"](spark, SF_SMALL)
    b = sorted(tuple(r) for r in b.select("dataset", "n", "ece", "accuracy", "conf_pos", "conf_neg", "auroc").collect())
    assert s == b


def test_tokenizer_hook(spark):
    from veracity.operators.training import tokenize_with
    df = spark.createDataFrame([("a bb ccc",), ("",)], "text string")
    out = tokenize_with(df, lambda texts: [[len(w) for w in t.split()] for t in texts], "text").collect()
    assert [r.input_ids for r in out] == [[1, 2, 3], []]


def test_scorer_hook(spark):
    from veracity.operators.responses import score_with

    def scorer(batches):
        for pdf in batches:
            pdf["correctness"] = (pdf["answer"] == pdf["gold"]).astype("float64") * 10
            yield pdf[["qid", "correctness"]]

    df = spark.createDataFrame([(1, "x", "x"), (2, "x", "y")], "qid long, answer string, gold string")
    got = {r.qid: r.correctness for r in score_with(df, scorer, "qid long, correctness double").collect()}
    assert got == {1: 10.0, 2: 0.0}


def test_stream_resumes_from_checkpoint(spark):
    from veracity.streaming.calibration import latest_histogram, report_from_histogram, stream_calibration
    d = tempfile.mkdtemp(prefix="veracity-stream-")
    src, sink, ck = os.path.join(d, "in"), os.path.join(d, "hist"), os.path.join(d, "ck")
    schema = "confidence double, correctness double"
    spark.createDataFrame([(8.0, 10.0), (2.0, 0.0)], schema).coalesce(1).write.parquet(os.path.join(src, "p1"))
    stream = lambda: spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
    stream_calibration(stream(), sink, ck).awaitTermination()
    assert latest_histogram(spark, sink).agg(F.sum("cnt")).first()[0] == 2
    spark.createDataFrame([(9.0, 10.0)], schema).coalesce(1).write.parquet(os.path.join(src, "p2"))
    stream_calibration(stream(), sink, ck).awaitTermination()  # same checkpoint: only the new file is read
    rep = report_from_histogram(latest_histogram(spark, sink)).first()
    assert rep.n == 3 and rep.auroc == 1.0


def test_stream_reads_each_file_once_and_removes_old_epochs(spark):
    from veracity.streaming.calibration import latest_histogram, stream_calibration
    d = tempfile.mkdtemp(prefix="veracity-stream-")
    src, sink, ck = os.path.join(d, "in"), os.path.join(d, "hist"), os.path.join(d, "ck")
    schema = "confidence double, correctness double"
    seen = []
    for run in range(2):
        for k in range(3):
            spark.createDataFrame([(float(k), 10.0)] * (k + 1), schema).coalesce(1).write.parquet(os.path.join(src, f"p{run}{k}"))
        q = stream_calibration(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*")), sink, ck)
        q.awaitTermination()
        seen.append([p["numInputRows"] for p in q.recentProgress if p["numInputRows"]])
    assert [sum(x) for x in seen] == [6, 6] and [len(x) for x in seen] == [3, 3]
    assert sorted(f for f in os.listdir(sink) if f.startswith("epoch=")) == ["epoch=4", "epoch=5"]
    assert {r.confidence: r.cnt for r in latest_histogram(spark, sink).collect()} == {0.0: 2, 1.0: 4, 2.0: 6}


def test_batches_count_in_each_group(spark):
    from veracity.operators.rows import with_batches
    df = spark.createDataFrame([(None if k % 3 == 0 else "a" if k % 3 == 1 else "b", k) for k in range(30)], "g string, k long")
    got = with_batches(df, "k", size=4, group_cols=["g"]).collect()
    assert all((r.row_idx, r.batch_id, r.pos_in_batch) == (r.k // 3, r.k // 12, r.k // 3 % 4) for r in got) and len(got) == 30


def test_cut_hedge_and_flag_valid(spark):
    from veracity.operators.responses import flag_valid
    df = spark.createDataFrame([("Paris I am sure",), ("Paris",), ("I am x I am y",)], "a string")
    assert [r.a for r in PR.cut_hedge(df, "a").collect()] == ["Paris ", "Paris", "I am x "]
    r = spark.createDataFrame([("x Confidence: 3",), ("",), ("I am sure",)], "response string")
    assert [x.valid for x in flag_valid(r).collect()] == [True, False, False]
    assert [x.valid for x in flag_valid(r, "rtuning").collect()] == [False, False, True]


def test_stream_records_append_once(spark):
    from veracity.streaming.calibration import stream_records
    d = tempfile.mkdtemp(prefix="veracity-records-")
    src, out, ck = os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ck")
    schema = "qid long, response string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.parquet(os.path.join(src, "p1"))
    stream = lambda: spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
    stream_records(stream(), out, ck).awaitTermination()
    spark.createDataFrame([(3, "c")], schema).coalesce(1).write.parquet(os.path.join(src, "p2"))
    stream_records(stream(), out, ck).awaitTermination()
    stream_records(stream(), out, ck).awaitTermination()  # nothing new: no duplicates
    assert sorted(r.qid for r in spark.read.schema(schema).json(out).collect()) == [1, 2, 3]


def test_read_any_folder_of_jsonl(spark):
    d = tempfile.mkdtemp(prefix="veracity-any-")
    out = os.path.join(d, "records")
    spark.createDataFrame([(1, "a"), (2, "b")], "qid long, response string").write.json(out)
    assert sorted(r.qid for r in IO.read_any(spark, out).collect()) == [1, 2]


def test_read_split_missing_raises(spark):
    df = spark.createDataFrame([("train", 1)], "split string, v int")
    with pytest.raises(ValueError):
        IO.read_split(df)


def _file(text):
    import os
    path = os.path.join(tempfile.mkdtemp(prefix="veracity-any-"), "data.json")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_any_keeps_good_rows_beside_bad_lines(spark):
    chat = '{"id": %d, "messages": [{"role": "user", "content": "x"}]}'
    lines = [chat % i for i in range(200)]
    lines[50:50] = ['{"id": 9, "messages": [{"role"', "not json at all"]
    good, bad = IO.read_checked(spark, _file("\n".join(lines) + "\n"))
    assert sorted(r.id for r in good.collect()) == list(range(200))
    assert {r.line for r in bad.collect()} == {"not json at all", '{"id": 9, "messages": [{"role"'}


def test_read_any_form_does_not_depend_on_the_number_of_records(spark):
    chat = '{"messages": [{"role": "user", "content": "x"}]}'
    one, two = (IO.read_any(spark, _file("\n".join([chat] * n) + "\n")) for n in (1, 2))
    assert one.schema == two.schema and (one.count(), two.count()) == (1, 2)
    pretty = IO.read_any(spark, _file('{\n "question": ["a", "b"],\n "answer": ["c", "d"]\n}\n'))
    assert [(r.question, r.answer) for r in pretty.orderBy("row_idx").collect()] == [("a", "c"), ("b", "d")]
    nested = IO.read_any(spark, _file('{"messages": [[{"role": "user", "content": "x"}], [{"role": "user", "content": "y"}]]}'))
    assert nested.count() == 2
    assert IO.read_any(spark, _file('{"a": [1, 2]}'), fmt="jsonl").count() == 1


def test_read_any_never_loses_lines_whose_first_field_is_a_list(spark, tmp_path):
    import json
    from veracity.sources import io as IO
    rows = [{"tokens": [i, i + 1], "labels": [0, 1]} for i in range(100)]
    path = tmp_path / "lists.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    assert IO.read_any(spark, str(path)).count() == 100
    path = tmp_path / "scalar.jsonl"
    path.write_text("\n".join(json.dumps({**r, "id": i}) for i, r in enumerate(rows)))
    got = IO.read_any(spark, str(path))
    assert got.count() == 100 and set(got.columns) == {"tokens", "labels", "id"}


def test_read_any_tells_one_object_from_many_lines(spark, tmp_path, monkeypatch):
    import gzip
    import json
    from veracity.sources import io as IO
    cols = {"question": ["a", "b", "c"], "answer": ["x", "y", "z"]}
    one, pretty = tmp_path / "one.json", tmp_path / "pretty.json"
    one.write_text(json.dumps(cols))
    pretty.write_text(json.dumps(cols, indent=1))
    for path in (one, pretty):
        assert [(r.question, r.answer) for r in IO.read_any(spark, str(path)).orderBy("row_idx").collect()] == [("a", "x"), ("b", "y"), ("c", "z")]
    mixed = tmp_path / "mixed.json"  # one record with a list and a scalar is a row
    mixed.write_text(json.dumps({"tokens": [1, 2], "id": 7}))
    assert IO.read_any(spark, str(mixed)).count() == 1
    zipped = tmp_path / "lists.json.gz"
    zipped.write_bytes(gzip.compress("\n".join(json.dumps({"t": [i]}) for i in range(20)).encode()))
    assert IO.read_any(spark, str(zipped)).count() == 20
    folder = tmp_path / "folder"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.json").write_text(json.dumps({"t": [i, i]}) + "\n")
    assert IO.read_any(spark, str(folder)).count() == 3
    monkeypatch.setattr(IO, "HEAD_BYTES", 64)  # the first value is longer than what is looked at
    long = tmp_path / "long.jsonl"
    long.write_text("\n".join(json.dumps({"t": list(range(100))}) for _ in range(5)))
    assert IO.read_any(spark, str(long)).count() == 5
    wide = tmp_path / "wide.json"
    wide.write_text(json.dumps({"q": list(range(100)), "a": list(range(100))}))
    assert IO.read_any(spark, str(wide)).count() == 100
