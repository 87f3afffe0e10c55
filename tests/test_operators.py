"""Operators on small frames, and the properties that sampling and matching must keep."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import gates, joins, ledger, stats
from loomwork.operators import select as sel
from loomwork.sources import records as io


def frame(spark, n=200):
    rnd = random.Random(2)
    return spark.createDataFrame([(i, f"s{rnd.randrange(4)}", rnd.randrange(1, 60)) for i in range(n)], "seq long, source string, tokens long")


def key():
    return X.sha_key(F.lit("t"), F.col("seq").cast("string"))


def test_order_statistics(spark):
    df = frame(spark)
    got = {r.source: r for r in stats.order_statistic(df, "tokens", {"a": 0.5, "b": 0.9, "c": 1.0}, ["source"]).collect()}
    for s, r in got.items():
        v = sorted(x.tokens for x in df.collect() if x.source == s)
        assert [r.a, r.b, r.c] == [v[min(len(v) - 1, int(len(v) * p))] for p in (0.5, 0.9, 1.0)]
    v = sorted(x.tokens for x in df.collect())
    assert stats.order_statistic(df, "tokens", {"a": 0.9}, method="floor_n1").first().a == v[int(0.9 * (len(v) - 1))]


def test_mcnemar(spark):
    df = spark.createDataFrame([(118, 38), (81, 61), (0, 0), (5, 5)], "b long, c long")
    p = [r[0] for r in df.select(stats.mcnemar(F.col("b"), F.col("c"))).collect()]
    assert p == pytest.approx([9.7385e-11, 0.1105, 1.0, 1.0], rel=1e-3)


@pytest.mark.parametrize("target", [0, 1, 500, 10**6])
def test_running_budget(spark, target):
    df = frame(spark)
    rows = sorted(df.withColumn("key", key()).collect(), key=lambda r: r.key)
    want, total = set(), 0
    for r in rows:
        if total >= target:
            break
        want.add(r.seq)
        total += r.tokens
    assert {r.seq for r in sel.running_budget(df, "tokens", key(), target).collect()} == want
    one = {r.seq for r in sel.running_budget(df, "tokens", key(), target, take_one=True).collect()}
    assert one == (want or {rows[0].seq})


def test_splits_and_quotas(spark):
    df = frame(spark)
    out = sel.stratified_holdout(df, ["source"], 50, key()).groupBy("source", "split").count().collect()
    assert sum(r["count"] for r in out if r.split == "validation") == 50 and sum(r["count"] for r in out) == 200
    parts = {r.split: r["count"] for r in sel.ordered_split(df, key()).groupBy("split").count().collect()}
    assert parts == {"train": 190, "validation": 10}
    assert sel.quota_sample(df, "source", {"s0": 3, "s1": 1000}, key()).filter("source = 's0'").count() == 3
    assert sel.mining_pool(df, "source", {"s0": 3, "x": 5}, ["seq"], key()).count() == 8
    with pytest.raises(Exception, match="too few"):
        sel.mining_pool(df, "source", {"x": 500}, ["seq"], key()).collect()
    with pytest.raises(ValueError):
        sel.parse_quotas(["a=b"])
    assert sel.parse_quotas(["a=b=3"]) == {"a=b": 3}


def test_first_claims(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "a", []), (3, "a", []), (4, "a", ["y"]), (5, "b", ["x"])], "seq long, key string, reasons array<string>")
    got = {r.seq: r.reasons for r in sel.first_claims(df, "key", "seq", "reasons").collect()}
    assert got == {1: ["x"], 2: [], 3: ["internal_duplicate"], 4: ["y", "internal_duplicate"], 5: ["x"]}


def test_consuming_join(spark):
    left = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k"), (4, None)], "seq long, key string")
    right = spark.createDataFrame([(1, "k", "plain"), (2, "k", "\\boxed{1}"), (3, "", "e")], "seq long, key string, answer string")
    prefer = F.size(X.balanced_boxes("answer")) > 0
    got = {r.seq: r.matched_answer for r in joins.consuming_join(left, right, ["key"], "answer", prefer=prefer).collect()}
    assert got == {1: "\\boxed{1}", 2: "plain", 3: None, 4: "e"}


def test_matching():
    rnd = random.Random(3)
    pool = [[rnd.randrange(10, 500), f"{i:04}"] for i in range(120)]
    wanted = [rnd.randrange(10, 500) for _ in range(30)]
    got = joins.match(pool, wanted)
    size = {i: t for t, i in pool}
    assert len(set(got)) == 30 and abs(sum(size[i] for i in got) - sum(wanted)) <= 10
    assert joins.match([[5, "a"]], [7, 9]) == ["a"] and joins.match([], [1]) == []


def test_matched_control_on_a_frame(spark):
    df = frame(spark)
    got = {r.seq for r in joins.match_controls(df.filter("seq % 5 = 0"), df.filter("seq % 5 <> 0"), "tokens", "seq").collect()}
    rows = df.collect()
    want = joins.match([[r.tokens, str(r.seq)] for r in rows if r.seq % 5], [r.tokens for r in rows if r.seq % 5 == 0])
    assert got == {int(x) for x in want}


def test_zip_fails_on_other_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "seq long, q string")
    assert joins.zip_rows(a, a, "q").count() == 2
    with pytest.raises(Exception, match="do not match"):
        joins.zip_rows(a, a.withColumn("q", F.lit("x")), "q").collect()


def test_sources(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"instruction": "q", "answer": "1"}\n\n{"instruction": broken\n{"instruction": "é", "source": "s"}\n', encoding="utf-8")
    path = str(p)
    good, bad = io.read_jsonl_quarantined(spark, path, io.SFT)
    assert good.count() == 2 and [r.raw_line for r in bad.collect()] == ['{"instruction": broken']
    assert io.read_jsonl_dropping(spark, path, io.SFT).count() == 2
    assert io.read_jsonl(spark, str(tmp_path / "none.jsonl"), io.SFT).count() == 0
    with pytest.raises(Exception):
        io.read_jsonl(spark, path, io.SFT).collect()
    out = str(tmp_path / "out")
    io.write_jsonl(good, out)
    with pytest.raises(FileExistsError):
        io.write_jsonl(good, out)
    io.append_jsonl(good, out)
    assert io.read_jsonl(spark, out, io.SFT).count() == 4 and not io.write_if_absent(good, out)
    assert io.fingerprints(spark, path).first().bytes == p.stat().st_size
    lines = spark.createDataFrame([(1, '{"instruction": "q"}'), (2, "x{"), (3, " ")], "line_number long, value string")
    assert {r.line_number: r.reject_reason for r in io.parse_lines(lines, io.SFT).collect()} == {1: None, 2: "json_decode_error"}
    assert io.merge_files(spark, [out, str(tmp_path / "no")], io.SFT).count() == 4
    t = spark.createDataFrame([([1, 2], [-100, 2])], "input_ids array<int>, labels array<int>")
    io.write_tokens(t, str(tmp_path / "t"))
    assert io.read_tokens(spark, str(tmp_path / "t")).first() == t.first()
    d = spark.createDataFrame([("r", "q", "t", "so \\boxed{4}"), ("r", "", "t", "x"), ("z", "q", "t", "x")], io.RAW_DISTILL)
    assert [r.answer for r in io.from_distilled(d, ["r"]).collect()] == ["4"]


def test_retries():
    calls, waits = [], []

    def client(prompt, stage):
        calls.append(prompt)
        if len(calls) < 3:
            raise ledger.RetryableError("empty")
        return {"ok": 1}, {"total": 5}

    reply, usage, error = ledger.call_with_retries(client, lambda f: f"p{f}", wait=waits.append)
    assert reply == {"ok": 1} and usage == [{"total": 5}] and error == "" and waits == [1, 2]

    def refused(prompt, stage):
        raise ledger.AuthenticationError

    with pytest.raises(ledger.AuthenticationError):
        ledger.call_with_retries(refused, str)


def test_synthesis_and_scoring(spark):
    def make():
        def client(prompt, stage):
            if "bad" in prompt:
                raise ledger.RetryableError("x")
            if prompt.startswith("verify"):
                return {"valid": True, "supports_answer": True, "missing_key_step": False}, {"total": 1}
            return {"status": "rejected" if "no" in prompt else "accepted", "reasoning": "short"}, {"total": 2}

        return client

    df = spark.createDataFrame([("1", "good"), ("2", "no"), ("3", "bad")], "candidate_id string, instruction string")
    out = ledger.synthesize(df, make, lambda r, f: f"make {r['instruction']}", lambda r, t: f"verify {t}", 1)
    assert {r.candidate_id: r.outcome for r in out.collect()} == {"1": "accepted", "2": "rejected", "3": "transient"}
    steps = spark.createDataFrame([("q", ["a", "b"]), ("q", None)], "instruction string, steps array<string>")
    got = ledger.score_steps(steps, lambda: lambda q, s, i: (0.5 if i else None, "r")).collect()
    assert [[x.step_idx for x in r.scored_steps] for r in got] == [[1], []]
    assert [r.prediction for r in ledger.generate(df.withColumn("prompt", F.col("instruction")), lambda: lambda ps: [p + "!" for p in ps]).collect()] == ["good!", "no!", "bad!"]


def test_teacher_loop(spark):
    waits = []

    def make():
        seen = {}

        def client(prompt, stage):
            kind, _, said = prompt.partition("|")
            n = seen[kind] = seen.get(kind, 0) + 1
            if stage == "verify":
                return {"valid": "wrong" not in kind, "supports_answer": True, "missing_key_step": False, "error": "step 2"}, {"total_tokens": 1}
            if kind == "flaky" and n == 1:
                raise ledger.RetryableError("down")
            if kind == "keyless":
                raise KeyError("choices")
            text = {"short": "one two" if "过短" not in said else "one two three four", "long": "a " * 50 if "以内" not in said else "a b c d", "brief": "one"}.get(kind, r"first\nSecond third fourth")
            return {"status": "accepted", "reasoning": text}, {"total_tokens": 2}

        return client

    kinds = ["good", "short", "long", "brief", "wrong", "flaky", "keyless"]
    df = spark.createDataFrame([(k, k) for k in kinds], "candidate_id string, instruction string").coalesce(1)
    limits = ledger.Limits(least=3, most=20)
    out = {r.candidate_id: r for r in ledger.synthesize(df, make, lambda r, f: f"{r['instruction']}|{f}", lambda r, t: r["instruction"], 3, limits, lambda s: None).collect()}
    assert {k: out[k].outcome for k in kinds} == {"good": "accepted", "short": "accepted", "long": "accepted", "brief": "rejected", "wrong": "rejected", "flaky": "accepted", "keyless": "transient"}
    assert out["good"].reasoning == "first\nSecond third fourth" and out["good"].reasoning_tokens == 4
    assert out["brief"].reject_reason == "reasoning_too_short" and '"reasoning_tokens": 1' in out["brief"].draft
    assert out["wrong"].reject_reason == "verifier_rejected:step 2" and out["keyless"].reject_reason.startswith("api_or_parse_error:KeyError")
    import json

    assert [(u["stage"], u["attempt"]) for u in json.loads(out["short"].usage)] == [("compress", 1), ("compress", 2), ("verify", 2)]

    client = ledger.checked_client(lambda p, s: {"a": (401, ""), "b": (500, "x"), "c": (200, " "), "d": (200, '{"choices": [{"message": {"content": "```json\\n{\\"v\\": 1}\\n```"}}], "usage": {"n": 2}}'), "e": (200, '{"choices": [{"message": {"content": "none"}}]}')}[p], 0.5, waits.append)
    for prompt, error in (("a", ledger.AuthenticationError), ("b", ledger.RetryableError), ("c", ledger.RetryableError), ("e", ledger.RetryableError)):
        with pytest.raises(error):
            client(prompt, "compress")
    assert client("d", "compress") == ({"v": 1}, {"n": 2}) and len(waits) == 4 and all(0 < w <= 0.5 for w in waits)


def test_lines_are_numbered_over_files(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3), ("c", 700)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"instruction": "{name}{i}"}}\n' if i % 100 else "broken\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = io.numbered_lines(spark, str(tmp_path)).orderBy("seq").collect()
        good, bad = io.read_jsonl_quarantined(spark, str(tmp_path), io.SFT)
        good, bad = good.orderBy("seq").collect(), bad.orderBy("file", "line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(f, i) for f, n in (("a", 5000), ("b", 3), ("c", 700)) for i in range(n)]
    assert [r.seq for r in rows] == list(range(5703)) and [(r.file[-7], r.line_number - 1) for r in rows] == want
    assert [r.instruction for r in good] == [f"{f}{i}" for f, i in want if i % 100] and [(r.file[-7], r.line_number - 1) for r in bad] == [x for x in want if x[1] % 100 == 0]


def test_small_gates(spark):
    df = spark.createDataFrame([("a", 3), ("b", 9), (None, 1)], "kind string, n int")
    kinds = lambda x: sorted(r.kind or "" for r in x.collect())
    assert kinds(gates.allowed(df, "kind", ["a"])) == ["a"] and kinds(gates.allowed(df, "kind", None, ["a"])) == ["", "b"] and kinds(gates.allowed(df, "kind")) == ["", "a", "b"]
    assert gates.fail_if_longer(df, F.col("n"), 9).count() == 3
    with pytest.raises(Exception, match="over the limit: 9"):
        gates.fail_if_longer(df, F.col("n"), 8).collect()
    done = ledger.normalized_accepted(spark.createDataFrame([(r"one\nTwo three",)], "reasoning string"), lambda c: F.size(F.split(c, r"\s+"))).first()
    assert (done.reasoning, done.compressed_reasoning_tokens) == ("one\nTwo three", 3)
    from loomwork.functions import text as X

    both = spark.createDataFrame([("q", "r", "a")], "instruction string, reasoning string, answer string")
    assert both.select(X.format_sft(both)).first()[0] == both.select(X.format_math_sft()).first()[0]
    plain = both.select("instruction", F.col("answer").alias("target"))
    assert plain.select(X.format_sft(plain)).first()[0] == plain.select(X.format_generic_sft("instruction", "target")).first()[0]
    steps = F.array(F.lit("s0"), F.lit("s1"), F.lit("s2"))
    assert both.select(X.rollout_prompt("instruction", steps, F.lit(1))).first()[0] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<think>\ns0\n\ns1\n\n"


def test_first_seen(spark, tmp_path):
    import datetime as dt

    from loomwork.streaming import scoring

    t = dt.datetime(2024, 1, 1)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([(1, t), (1, t), (2, t), (1, t + dt.timedelta(minutes=5))], "key long, at timestamp").write.parquet(src)
    scoring.resume(spark, src, "key long, at timestamp", lambda rows: scoring.first_seen(rows, "key", "at"), out, cp).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == [1, 2]


def test_reports(spark):
    df = spark.createDataFrame([(0.2, True), (0.9, False), (1.0, True), (0.9, True)], "s double, ok boolean")
    r = stats.quadrants(df, "s", "ok").first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 0, 1) and r.precision == pytest.approx(2 / 3)
    assert {x.bucket: x.n for x in stats.calibration(df, "s", "ok").collect()} == {"[0.0,0.3)": 1, "[0.85,1.0)": 2}
    assert stats.report_markdown(df.limit(1)).splitlines()[0] == "| s | ok |"
    with pytest.raises(ValueError):
        stats.report_markdown(df, 2)


def test_streams(spark, tmp_path):
    from loomwork.streaming import scoring

    events = spark.createDataFrame([(1, 1, "a", 5.0, '{"k": 3}'), (2, 1, "b", 500.0, "{}")], "event_id long, user_id long, event_type string, value double, props string")
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    events.limit(1).write.parquet(src)
    for n in (1, 1, 3):
        if n == 3:
            events.write.mode("append").parquet(src)
        scoring.resume(spark, src, events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), scoring.scored_events, out, cp).awaitTermination()
        assert spark.read.parquet(out).count() == n
