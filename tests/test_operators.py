"""Golden cases, conservation laws and numpy cross-checks of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein import schemas
from skein.functions import text as T
from skein.operators import corrections, diagnostics, frames, groups, joins, masked, metrics, packing, parsing, scoring, sequences
from skein.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_groups_sum_to_nothing(spark):
    random = np.random.default_rng(0)
    data = [(i, int(random.integers(0, 9)), float(random.integers(-3, 4))) for i in range(200)]
    df = spark.createDataFrame(data, "row_id long, uid long, score double")
    for name in ("grpo", "rloo"):
        sums = groups.estimate(name, df).groupBy("uid").agg(F.sum("advantage").alias("s"), F.count("*").alias("n")).filter("n > 1").collect()
        assert all(abs(r.s) < 1e-6 for r in sums)


def test_singletons(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 3)], "row_id long, uid long, score double, length long")
    value = lambda n: groups.estimate(n, df).first().advantage
    assert value("grpo") == pytest.approx(2 / (1 + 1e-6)) and value("rloo") == 2.0 and value("rloo_vectorized") == 0.0 and value("opo") == 2.0
    with pytest.raises(Exception, match="pass@k"):
        value("grpo_passk")
    with pytest.raises(ValueError, match="no estimator"):
        groups.estimate("other", df)


def test_gae_against_numpy(spark):
    random = np.random.default_rng(1)
    data = [(t, random.random(n).tolist(), random.random(n).tolist(), random.integers(0, 2, n).tolist()) for t, n in ((1, 5), (2, 1), (3, 9))]
    df = spark.createDataFrame(data, "traj long, reward array<double>, value array<double>, mask array<int>")
    got = {(r.traj, r.pos): r.advantage for r in sequences.gae(df, gamma=0.9, lam=0.8, whiten=False).collect()}
    for traj, reward, value, mask in data:
        following = last = 0.0
        for t in reversed(range(len(reward))):
            delta = reward[t] + 0.9 * following - value[t]
            now = delta + 0.72 * last
            following = value[t] if mask[t] else following
            last = now if mask[t] else last
            assert got[traj, t] == pytest.approx(last)


def test_whiten_raises_on_one_token(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0)], "v double, mask int")
    with pytest.raises(Exception, match="masked variance"):
        masked.masked_whiten(df, "v", "mask", "w").collect()


def test_thresholds():
    assert corrections.parse_thresholds("token_k1,seq_max_k3", "2.0") == {"token_k1": (0.5, 2.0), "seq_max_k3": (None, 2.0)}
    assert corrections.parse_thresholds(["seq_sum_k1"], ["0.4_3"]) == {"seq_sum_k1": (0.4, 3.0)}
    for options, values in (("token_k2", "0.1_2"), ("token_k9", "1"), ("token_k1,token_k2", "1,2,3")):
        with pytest.raises(ValueError):
            corrections.parse_thresholds(options, values)
    assert corrections.parse_is_threshold("0.5_2") == (0.5, 2.0) and corrections.parse_is_threshold(3) == (None, 3.0)


def diagnostic(row_id, uid, outcome, **more):
    base = {"row_id": row_id, "uid": uid, "schema_version": 1, "timing_metrics_version": 1, "terminal_outcome": outcome, "is_fake": False, "did_real_eval": False, "events": {}, "timing": {}, "final_stage": "unknown"}
    return {**base, **more}


def test_golden_buckets(spark):
    real = [diagnostic(i, "a", o, did_real_eval=True, reward_score=r) for i, (o, r) in enumerate((("resolved_full", 1.0), ("unresolved_no_progress", 0.0), ("unresolved_regression", -0.2)))]
    preset = [diagnostic(10 + i, "a", o) for i, o in enumerate(("assistant_turn_limit", "response_length_limit", "patch_empty", "action_timeout_limit", "repeated_action_limit"))]
    invalid = [diagnostic(20, "a", "tests_timeout")]
    fake = [diagnostic(30 + i, "a", o, is_fake=True) for i, o in enumerate(("prompt_too_long", "rollout_global_timeout", "rollout_env_init_failed", "eval_env_init_failed", "tests_error"))]
    df = diagnostics.normalise(spark.createDataFrame(real + preset + invalid + fake, schemas.DIAGNOSTIC))
    got = {(r.view, r.bucket): r.n for r in diagnostics.buckets(df).collect()}
    assert got["raw", "total"] == got["tracker", "total"] == 14
    assert got["raw", "real_data"] == 9 and got["tracker", "real_data"] == 8 and got["tracker", "fake_data"] == 6
    assert got["raw", "invalid_eval_nonfake"] == 1 and got["raw", "real_eval"] == 3 and got["raw", "set_eval"] == 5


def test_golden_group(spark):
    records = [diagnostic(i, "g", "tests_error", is_fake=i < 7, events={"action_parse_failed": 4} if i < 7 else {}, failure_detail="x" * 400) for i in range(8)]
    df = diagnostics.normalise(spark.createDataFrame(records, schemas.DIAGNOSTIC))
    health = diagnostics.group_health(df, 8).first()
    assert (health.health, health.fake_rows, health.real_rows) == ("partial_fake", 7, 1)
    assert rows(diagnostics.event_totals(df), "event", "occurrences", "trajectories") == [("action_parse_failed", 28, 7)]
    assert len(diagnostics.first_examples(df, 2).first().failure_detail) == 300
    bad = spark.createDataFrame([diagnostic(1, "g", "resolved_full", schema_version=7)], schemas.DIAGNOSTIC)
    assert diagnostics.normalise(bad).select("terminal_outcome", "missing").first() == ("unknown", True)


def test_latest_per_session(spark):
    keys = ["uidA_0_0", "uidA_0_1", "uidA_1_0", "uidB_0_0", "uidB_0_1"]
    df = spark.createDataFrame([(i, k, i == 4) for i, k in enumerate(keys)], "row_id long, key string, is_padding boolean")
    parsed = df.withColumn("p", packing.parsed_key(F.col("key"))).select("row_id", "is_padding", "p.*")
    last = joins.latest_of_sessions(parsed, "uid", "session_id", padding="is_padding")
    assert sorted(r.row_id for r in last.collect()) == [1, 2, 3]


@pytest.mark.parametrize("equal", [True, False])
def test_partitions(equal):
    random = np.random.default_rng(2)
    weights = random.integers(1, 1000, 48).tolist()
    for method in (packing.differencing, packing.greedy):
        parts = packing.checked(method(weights, 6, equal), 48)
        loads = [sum(weights[i] for i in p) for p in parts]
        if equal:
            assert {len(p) for p in parts} == {8}
        if method is packing.differencing:
            assert max(loads) - min(loads) < (60 if equal else 20)
    assert [sorted(p) for p in packing.differencing([4, 5, 6, 7, 8], 2)] in ([[1, 2, 3], [0, 4]], [[0, 4], [1, 2, 3]], [[0, 2, 3], [1, 4]], [[0, 1, 2], [3, 4]], [[3, 4], [0, 1, 2]], [[0, 1, 3], [2, 4]], [[2, 4], [0, 1, 3]])


def test_micro_batches(spark):
    df = spark.createDataFrame([(i, 100 + i % 7 * 50) for i in range(40)], "row_id long, n long")
    made = packing.micro_batches(df, "n", 1000, divided_by=2)
    loads = made.groupBy("micro_batch").agg(F.sum("n").alias("n")).collect()
    assert made.count() == 40 and len(loads) % 2 == 0 and max(r.n for r in loads) <= 1200


def test_bootstrap_starts_anew():
    values = np.array([0.0, 1.0, 1.0, 0.0, 1.0])
    got = dict(metrics.bootstrap_group(values, np.array(["a", "b", "b", "a", "c"], object)))
    drawn = np.random.RandomState(42).choice(5, size=(1000, 2), replace=True)
    assert got["best@2/mean"] == pytest.approx(values[drawn].max(1).mean()) and got["worst@2/std"] == pytest.approx(values[drawn].min(1).std())
    assert got["std@5"] == pytest.approx(values.std()) and metrics.subset_sizes(5) == [2, 4, 5] and metrics.subset_sizes(1) == []
    first = values[drawn][:, 0]  # with two votes the first prediction wins or ties
    assert got["maj@2/mean"] == pytest.approx(first.mean())


def _each_draw(values, codes, size):
    """The definition: every resample of one group by itself."""
    drawn = np.random.RandomState(42).choice(len(values), size=(1000, size), replace=True)
    maj = [values[d[max(range(size), key=lambda k: (int((codes[d] == codes[d[k]]).sum()), -k))]] for d in drawn]
    return {"best": values[drawn].max(1), "worst": values[drawn].min(1), "maj": np.array(maj)}


@pytest.mark.parametrize("n", [1, 4, 11, 70])
def test_groups_of_one_length_share_their_draws(monkeypatch, n):
    rng, made = np.random.default_rng(n), []
    values, codes = rng.choice([1.0, 0.0, -0.2, 0.7], (300 if n < 70 else 2, n)), rng.integers(0, 4, (300 if n < 70 else 2, n))
    values[1, 0] = np.nan
    real = np.random.RandomState
    monkeypatch.setattr(metrics, "MOST_DRAWS", 9000)  # large groups go on in the same stream
    monkeypatch.setattr(np.random, "RandomState", lambda seed: made.append(seed) or real(seed))
    got = dict(metrics.bootstrap_groups(values, codes))
    assert len(made) <= 2 * len(metrics.subset_sizes(n))  # shared, and one with a NaN by itself; not a group each
    for g in (0, 1, len(values) - 1):
        for size in metrics.subset_sizes(n):
            for name, want in _each_draw(values[g], codes[g], size).items():
                assert got[f"{name}@{size}/mean"][g] == pytest.approx(want.mean(), abs=1e-12, nan_ok=True)
                assert got[f"{name}@{size}/std"][g] == pytest.approx(want.std(), abs=1e-12, nan_ok=True)


def test_validation_is_the_mean_over_prompts(spark):
    rng = np.random.default_rng(5)
    data = [(f"s{u % 2}" if u % 5 else None, None if u == 3 else u, i, float(rng.choice([1.0, 0.0, -0.2])), None if i % 4 == 1 else f"p{u * i % 3}") for u in range(40) for i in rng.permutation(1 + u % 6).tolist()]
    df = spark.createDataFrame(data, "data_source string, uid long, row_id long, score double, pred string")
    want = {}
    for (source, _), group in pd.DataFrame(data).groupby([0, 1], dropna=False):
        group = group.sort_values(2)
        for metric, value in metrics.bootstrap_group(group[3].to_numpy(), group[4].to_numpy()):
            want.setdefault((None if pd.isna(source) else source, metric), []).append(value)
    got = {(r.source, r.metric): r.value for r in metrics.validation_metrics(df).collect()}
    assert got.keys() == want.keys() and all(v == pytest.approx(np.mean(want[k]), abs=1e-12) for k, v in got.items())


def test_frames(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(7)], "row_id long, v long")
    assert rows(frames.slice_rows(df, -3), "row_id", "v") == [(0, 40), (1, 50), (2, 60)]
    padded = frames.pad_to_divisor(df, 4)
    assert padded.count() == 8 and rows(frames.unpad(padded), "row_id", "v") == rows(df, "row_id", "v")
    assert frames.equal_batches(frames.unpad(padded), df) and not frames.equal_batches(df, df.limit(3))
    assert frames.pad_with_row(df, 2, "first").filter("row_id > 6 AND v = 0").count() == 2
    with pytest.raises(ValueError):
        frames.chunk_number(df, 3)
    with pytest.raises(Exception, match="differ"):
        frames.union_columns(df, df.withColumn("v", F.col("v") + 1)).collect()
    numbered = frames.with_row_ids(spark.createDataFrame([(c,) for c in "hgfedcba"], "c string").repartition(3), "c")
    assert rows(numbered, "row_id", "c") == list(enumerate("abcdefgh"))
    order = [r.v for r in frames.shuffled(df, 3).orderBy("row_id").collect()]
    assert sorted(order) == [i * 10 for i in range(7)] and order == [r.v for r in frames.shuffled(df, 3).orderBy("row_id").collect()]
    epochs = frames.mini_batches(df.filter("row_id < 6"), 2, 3, 1)
    assert epochs.groupBy("epoch", "batch").count().filter("count = 2").count() == 9
    wide = spark.createDataFrame([(0, [1, 2, 3, 4])], "row_id long, a array<int>")
    assert [(r.part, r.a) for r in frames.unfold(wide, "a", 2).collect()] == [(0, [1, 2]), (1, [3, 4])]
    assert frames.shape_report(df).count() == 2


def test_scores(spark):
    gold = [{"name": "a", "parameters": {"x": 1, "y": 2}}, {"name": "b", "parameters": {}}]
    assert scoring.tool_call_score(gold, gold) == 3.0 and scoring.tool_call_score(gold, []) == -3.0
    half = scoring.tool_call_score(gold, [{"name": "a", "parameters": {"x": 1, "y": 3}}])
    assert -3 < half < 3
    for raw, plain in ((r"\dfrac12", r"\frac{1}{2}"), ("0.5", r"\frac{1}{2}"), ("x = 3", "3"), (r"\sqrt3", r"\sqrt{3}"), ("7/8", r"\frac{7}{8}"), (r"5\text{ cm}", "5"), (r"30^\circ", "30")):
        assert spark.createDataFrame([(raw,)], "s string").select(scoring.latex_plain(F.col("s")).alias("p")).first().p == plain
    df = spark.createDataFrame([(r"a \boxed{x{y}} b", 1), (r"\boxed 7$ z", 2), ("none", 3), (r"\boxed{open", 4)], "t string, k int")
    assert [r.b for r in df.orderBy("k").select(T.last_boxed("t").alias("b")).collect()] == ["x{y}", "7", None, None]
    logs = spark.createDataFrame([(">>>>> Tests Errored >>>>> Reset Failed",), (">>>>> Start Test Output x >>>>> End Test Output",), ("",)], "log string")
    assert [r.s for r in logs.select(scoring.log_status(F.col("log")).alias("s")).collect()] == ["harness_reset_failed", "ok", "test_markers_missing"]
    lists = spark.createDataFrame([('["a", "b"]',), ("['c']",), ("plain",), (None,), (" ",)], "v string")
    assert [r.x for r in lists.select(T.parsed_list("v").alias("x")).collect()] == [["a", "b"], ["c"], ["plain"], [], []]
    truth = "<think>t</think>\n<tool_call>\n{}\n</tool_call>"
    shaped = spark.createDataFrame([(truth, truth), ("<think>t</think>", truth), ("<think>t</think>", "plain")], "r string, t string")
    assert [r.f for r in shaped.select(scoring.format_score(F.col("r"), F.col("t")).alias("f")).collect()] == [1.0, 0.0, 1.0]
    with pytest.raises(Exception, match="no score"):
        spark.range(1).select(scoring.dispatch(F.lit("odd"), F.lit("a"), F.lit("b"))).collect()


def test_parsers():
    schema = {"f": {"n": "int", "x": "number", "b": "bool", "o": "object", "s": "string"}}
    text = "<tool_call><function=f><parameter=n>\n12\n</parameter><parameter=x>1.0</parameter><parameter=b>yes</parameter><parameter=o>{\"a\": 1}</parameter><parameter=s>null</parameter><parameter=q>__import__('os')</parameter></function></tool_call>"
    call = parsing.xml_calls(text, schema)
    assert call == [{"name": "f", "arguments": '{"n": 12, "x": 1, "b": false, "o": {"a": 1}, "s": null, "q": "__import__(\'os\')"}'}]
    assert parsing.xml_calls("no call", schema) == []
    channel = "<|channel|>analysis<|message|>to=functions.no <|end|><|start|>assistant<|channel|>commentary to=functions.get <|constrain|>json<|message|>{\"a\":1}<|call|>"
    assert parsing.channel_calls(channel, {}) == [{"name": "get", "arguments": '{"a":1}'}]
    braced = '<|tool_call>call:go{to:<|"|>a, b<|"|>,n:3,f:1.5,t:true}<tool_call|>'
    assert parsing.braced_calls(braced, {}) == [{"name": "go", "arguments": '{"to": "a, b", "n": 3, "f": 1.5, "t": true}'}]


def test_media_parts(spark):
    df = spark.createDataFrame([("see <image> and <video>x",)], "c string").select(parsing.split_media(F.col("c")).alias("p"))
    assert [(p.type, p.text) for p in df.first().p] == [("text", "see "), ("image", None), ("text", " and "), ("video", None), ("text", "x")]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"r__{i % 3}", float(i)) for i in range(9)], "row_id long, instance_id string, v double")
    first = writers.write_table(df, f"{tmp_path}/t.parquet").first()
    assert first.rows == 9 and first == writers.fingerprint(df.repartition(4)).first()
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_table(df, f"{tmp_path}/t.parquet")
    assert writers.write_table(df, f"{tmp_path}/t.parquet", overwrite=True).first().rows == 9
    assert readers.read_source(spark, f"{tmp_path}/t.parquet").count() == 9
    df.write.json(f"{tmp_path}/t.jsonl")
    df.write.option("header", True).csv(f"{tmp_path}/t.csv")
    assert readers.read_source(spark, f"{tmp_path}/t.jsonl").count() == readers.read_source(spark, f"{tmp_path}/t.csv").count() == 9
    assert readers.read_training(spark, [f"{tmp_path}/t.parquet", f"{tmp_path}/t.jsonl"]).count() == 18
    for bad in ("org/name", f"{tmp_path}/t.xyz"):
        with pytest.raises(ValueError):
            readers.read_source(spark, bad)
    (tmp_path / "ids.txt").write_text("a\n\n b \na\n")
    (tmp_path / "ids.json").write_text('["a", "c"]')
    (tmp_path / "allow.txt").write_text("# note\n\n")
    assert rows(readers.read_ids(spark, f"{tmp_path}/ids.txt"), "instance_id") == [("a",), ("b",)]
    assert rows(readers.read_ids(spark, f"{tmp_path}/ids.json"), "instance_id") == [("a",), ("c",)]
    assert readers.read_ids(spark, f"{tmp_path}/t.parquet").count() == 3
    with pytest.raises(ValueError, match="empty"):
        readers.read_prefixes(spark, f"{tmp_path}/allow.txt")
    steps = df.select(F.lit("train").alias("phase"), (F.col("row_id") % 2).alias("step"), "v")
    writers.write_step(steps, f"{tmp_path}/steps")
    writers.write_step(steps.filter("step = 1").limit(1), f"{tmp_path}/steps")
    assert spark.read.json(f"{tmp_path}/steps").count() == 6
    wide = spark.createDataFrame([(1, 0.5, 2.0)], "step long, a double, b double")
    assert writers.show_metrics(writers.long_metrics(wide)) == "step:1 - a:0.500000 - b:2.000000"
    assert writers.flattened(spark.range(1).select(F.struct(F.struct(F.lit(1).alias("x")).alias("b")).alias("a"))).columns == ["a/b/x"]
    assert writers.manifest(df, f"{tmp_path}/m", "instance_id", "v").count() == 3


def test_store(spark, tmp_path):
    store = writers.TrajectoryStore(spark, f"{tmp_path}/kv")
    base = spark.createDataFrame([("a", "train", 1), ("b", "train", 2), ("a", "val", 3)], "key string, partition_id string, x int")
    store.put(base, "base")
    store.put(base.select("key", "partition_id", (F.col("x") * 2).alias("y")), "more")
    got = store.get(base.filter("key = 'a'"), "train", {"base": ["x"], "more": ["y"]})
    assert rows(got, "key", "x", "y") == [("a", 1, 2)]
    store.clear("base", "train", base.filter("key = 'a'"))
    assert rows(store.keys("base", "train"), "key") == [("b",)] and rows(store.keys("base", "val"), "key") == [("a",)]


def test_routing(spark):
    df = spark.createDataFrame([(i, "django", f"django__{i}") for i in range(40)], "row_id long, repo string, instance_id string")
    routes = joins.routing_map(df, "repo", 4)
    placed = joins.route(df, routes, "repo", "instance_id")
    assert {r.group_id for r in placed.collect()} == {0, 1, 2, 3}
    pages = joins.shuffle_pages(df, "instance_id", 42, 15)
    assert pages.groupBy("page").count().orderBy("page").collect() == [(1, 15), (2, 15), (3, 10)]
    assert joins.least_common_multiple(4, 6) == 12


def test_rate_limit_against_simulation(spark):
    import random

    from skein.operators import rewards

    draw = random.Random(4)
    rows, now = [], 0.0
    for k in range(300):
        now += draw.choice([0.0, 0.1, 0.5, 3.0])
        rows.append((k, "a", round(now, 3), float(draw.choice([1, 2, 5, 9]))))
    df = spark.createDataFrame(rows, "row_id long, k string, t double, cost double")
    got = {r.row_id: r.starts_at for r in rewards.rate_limited(df, 2.0, 4.0, key="k", time="t", cost="cost").collect()}
    tokens, last = 4.0, 0.0
    for row, _, t, cost in rows:  # a bucket that is looked at when a request begins
        begin = max(t, last)
        tokens = min(4.0, tokens + (begin - last) * 2.0)
        wait = max(0.0, (min(cost, 4.0) - tokens) / 2.0) if cost <= 4.0 else max(0.0, (cost - tokens) / 2.0)
        begin += wait
        tokens, last = tokens + wait * 2.0 - cost, begin
        assert abs(got[row] - begin) < 1e-6


def test_bad_tool_calls_and_deep_json(spark):
    from skein.functions import text as T
    from skein.operators import scoring

    good = '<tool_call>\n{"name": "f", "parameters": {"a": 1}}\n</tool_call>'
    bad = ['{"name": "f", "arguments": null}', '{"name": ["f"], "parameters": {}}', '{"name": "f", "parameters": [1]}', "[1]", "7", '"x"', "{", "[" * 100_000]
    df = spark.createDataFrame([(k, f"<tool_call>\n{b}\n</tool_call>", good) for k, b in enumerate(bad)] + [(99, None, good), (100, good, good)], "k int, r string, t string")
    got = {r.k: r.s for r in df.select("k", scoring.tool_call_reward("r", "t").alias("s")).collect()}
    assert got == dict.fromkeys([*range(len(bad)), 99], -3.0) | {100: 3.0}
    deep = "[" * 100_000
    assert spark.createDataFrame([(deep,)], "j string").select(T.canonical_json("j").alias("j")).first().j == f'"{deep}"'


def test_counted_bound(spark, monkeypatch):
    from skein.operators import losses

    monkeypatch.setattr(losses, "CUTS", 4)
    monkeypatch.setattr(losses, "MOST_TIES", 3)
    values = [5.0, 1.0, 1.0, 1.0, 2.0, 9.5, -3.0, None, 2.0, 1.0, 7.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "i long, v double")
    order = sorted((v, k) for k, v in enumerate(values) if v is not None)
    for few in range(1, 12):
        got = df.filter(losses._first_rows(df, F.col("v"), few, ("i",))).collect()
        assert sorted((r.v, r.i) for r in got) == order[:few]


def test_required_fields_names_all(spark):
    from skein.operators import joins

    df = spark.createDataFrame([(1, None, "x"), (2, "a", None)], "i int, a string, b string")
    with pytest.raises(Exception, match="missing fields: a,b"):
        joins.require_fields(df, "i", "a", "b").collect()
    assert joins.require_fields(df, "i").count() == 2


def test_dedup_forgets_after_its_time(spark):
    from skein.streaming import queues

    assert queues.DedupQueue(60_000).ttl_ms == 60_000 and queues.DedupQueue().ttl_ms is None


def test_quantiles_against_numpy(spark):
    from skein.operators.quantiles import quantiles

    random = np.random.default_rng(6)
    data = [(k, "ab"[int(random.random() < 0.2)], float(x)) for k, x in enumerate(random.integers(0, 30, 400))] + [(999, "c", 4.0), (1000, "c", None), (1001, "d", None)]
    df = spark.createDataFrame(data, "i long, k string, v double").repartition(7)
    shares = {"q0": 0.0, "q1": 0.123, "q2": 0.5, "q3": 0.99, "q4": 1.0}
    values = {k: [v for _, j, v in data if j == k and v is not None] for k in "abc"}
    got = {r.k: [r[q] for q in shares] for r in quantiles(df, "v", shares, "k").collect()}
    assert set(got) == set("abc") and all(np.allclose(got[k], np.quantile(values[k], list(shares.values()))) for k in got)
    one = quantiles(df, "v", shares).first()
    assert np.allclose([one[q] for q in shares], np.quantile(sum(values.values(), []), list(shares.values())))
    assert metrics.percentiles(df, "v").first().p50 == np.quantile(sum(values.values(), []), 0.5)
    assert quantiles(df.limit(0), "v", shares, "k").count() == 0


def test_merged_meta():
    assert frames.merged_meta([{"metrics": [1], "t": 0.7}, {"metrics": {"a": 2}}, {"t": 0.7}]) == {"metrics": [1, {"a": 2}], "t": 0.7}
    with pytest.raises(ValueError, match="'t'"):
        frames.merged_meta([{"t": 1}, {"t": 2}])
