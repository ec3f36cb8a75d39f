"""Every registered query that has SQL gives DuckDB's rows on the small tables."""

import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from skein import views
from skein.operators import estimators, groups, sequences
from skein.plans import extras
from skein.session import checkpointed

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for r in entry._REGISTRIES for n in r.queries)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if pd.isna(value):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if isinstance(value, str):
        return value
    number = float(value)
    return str(int(number)) if number.is_integer() else f"{number:.5g}"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    oracle = next((r.oracles.get(name) for r in entry._REGISTRIES if name in r.queries), None)
    made = next(r.queries[name] for r in entry._REGISTRIES if name in r.queries)(spark, SF)
    got = made.toPandas()
    if oracle is None:
        assert len(got) > 0
        return
    want = duck.execute(oracle).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("n", [0, 6, 11])
def test_chunks_with_a_rest(spark, duck, tmp_path, n):
    duck.execute(f"COPY (FROM documents WHERE doc_id < {n}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    want = own.execute(entry.oracle_sql()["chunk_rows"]).fetchall()
    got = entry.queries()["chunk_rows"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == n


def exchanges(df):
    """What the exchanges of the plan deal by, from the top."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [re.sub(r"#\d+L?", "", x) for line in lines for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", line)]


def test_tokens_of_some_orders_are_dealt_once(spark):
    some = views.tokens(spark, SF, F.col("l_orderkey") % 500 < 100)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Filter")  # the filter is below
    whole = views.tokens(spark, SF).filter("uid < 100")
    assert some.exceptAll(whole).isEmpty() and whole.exceptAll(some).isEmpty() and not some.isEmpty()
    assert exchanges(some.groupBy("traj").count()) == exchanges(some.groupBy("traj", "pos").count()) == ["traj"]


def test_optimal_baseline_deals_tokens_once_more(spark):
    tokens = views.tokens(spark, SF).repartition(4, "traj")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for compact in (False, True):
            made = exchanges(sequences.optimal_token_baseline(tokens, compact=compact).select("traj", "pos", "advantage"))
            assert made[0] == "uid, __p" and "uid, traj" not in made[:2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_optimal_baseline_of_masked_trajectories(spark):
    data = [(u, 10 * u + t, p, float(u + t + p), -0.1 * (p + 1), int(t > 0 and (p + t) % 3 > 0)) for u in range(3) for t in range(u + 1) for p in range(4 + t)]
    df = spark.createDataFrame(data, "uid long, traj long, pos long, reward double, old_lp double, mask int")
    for compact in (False, True):
        got = {(r.traj, r.pos): r.advantage for r in sequences.optimal_token_baseline(df, compact=compact).collect()}
        frame = pd.DataFrame(data, columns=["uid", "traj", "pos", "reward", "lp", "mask"])
        per = frame.groupby("traj", group_keys=False)
        frame["ret"] = per.apply(lambda g: (g.reward * g["mask"])[::-1].cumsum()[::-1], include_groups=False)
        frame["w"] = per.apply(lambda g: ((1 - 2 * np.exp(g.lp)) * g["mask"]).cumsum(), include_groups=False)
        frame["p"] = per["mask"].cumsum() - 1 if compact else frame.pos
        frame["len"] = per["mask"].transform("sum")
        assert len(got) == len(frame)
        for r in frame.itertuples():
            group = frame[frame.uid == r.uid]
            lengths = group.groupby("traj")["len"].first()
            lengths = sorted(lengths[lengths > 0] if compact else lengths, reverse=True)
            at = group[group.p == r.p]
            base = (at.ret * at.w * at["mask"]).sum() / ((at.w * at["mask"]).sum() + 1e-8)
            if len(lengths) <= 1 or compact and not r.len or r.len == lengths[0] > lengths[1] <= r.p:
                base = 0.0
            assert got[(r.traj, r.pos)] == pytest.approx((r.ret - base) * r.mask, abs=1e-9)


def test_estimators_that_disagree_are_counted(spark, monkeypatch):
    whole = estimators.REGISTRY["rloo"]
    bad = {
        "lost": lambda tokens, **_: whole(tokens).filter("pos > 0"), "moved": lambda tokens, **_: whole(tokens).withColumn("pos", F.col("pos") + 1),
        "unmasked": lambda tokens, **_: tokens.withColumn("advantage", F.lit(1.0)), "whole": whole,
    }
    monkeypatch.setattr(estimators, "REGISTRY", bad)
    got = {r.name: (r.tokens, r.masked) for r in entry.queries()["estimators_agree"](spark, SF).collect()}
    tokens = views.tokens(spark, SF).filter("uid < 100")
    n, first = tokens.count(), tokens.filter("pos = 0").count()
    assert got["whole"] == (n, 0) and got["lost"] == (n - first, 0) and got["moved"][0] == n - first
    assert got["unmasked"] == (n, tokens.filter("mask = 0").count()) and got["unmasked"][1] > 0


def test_estimators_agree_on_all_orders(spark, tmp_path, monkeypatch):
    """Prompts above 99, a prompt whose tokens are all masked, and a line without an order, which is no token."""
    rows = [(k, k, 1, n, 10.0 + n, (k + n) % 7 / 100, n / 100, "R" if k % 500 == 499 else "N") for k in (3, 503, 99, 599, 100, 600, 499, 999) for n in range(1, 4)]
    rows.append((None, 1, 1, 1, 1.0, 0.1, 0.1, "N"))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    whole = estimators.REGISTRY["rloo"]
    some = {n: estimators.REGISTRY[n] for n in ("opo", "optimal_token_baseline", "reinforce_plus_plus")} | {"rloo": lambda tokens, **_: whole(tokens.filter("uid < 100"))}
    monkeypatch.setattr(estimators, "REGISTRY", some)
    got = {r.name: (r.tokens, r.masked) for r in entry.queries()["estimators_agree"](spark, str(tmp_path)).collect()}
    want = {n: (t, m) for n, t, m in own.execute(entry.oracle_sql()["estimators_agree"]).fetchall() if n in some}
    assert want["opo"] == (24, 0) and want == got | {"rloo": (24, 0)} and got["rloo"] == (12, 0)


def test_estimators_read_tokens_that_are_dealt_once(spark):
    tokens = checkpointed(views.tokens(spark, SF, parts=4), dealt=True)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = {n: exchanges(extras.agreement(n, tokens, 4)) for n in ("reinforce_plus_plus", "rloo")}
        dealt["tir"] = exchanges(extras.agreement("tir_optimal_token_baseline", tokens, 4, few=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dealt["reinforce_plus_plus"] == ["traj"] and dealt["rloo"] == ["traj", "uid"]  # what Python returned; advantages of trajectories
    assert not {"traj", "traj, pos", "uid, traj"} & set(dealt["tir"])


def test_few_baselines_are_sent(spark):
    tokens = views.tokens(spark, SF).repartition(4, "traj")
    for compact in (False, True):
        sent, joined = (sequences.optimal_token_baseline(tokens, compact=compact, few=few).select("traj", "pos", F.round("advantage", 9).alias("a")) for few in (True, False))
        assert sent.exceptAll(joined).isEmpty() and joined.exceptAll(sent).isEmpty() and sent.count() == tokens.count()


def test_opo_of_a_group_without_length(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (1, 3.0, 0), (2, 1.0, 1), (2, 4.0, 2)], "uid int, score double, length int")
    assert sorted(r.advantage for r in groups.estimate("opo", df).collect()) == [-2.0, 1.0, 1.0, 3.0]


def test_estimators_that_disagree_on_any_order_are_counted(spark, monkeypatch):
    whole = estimators.REGISTRY["rloo"]
    bad = {
        "lost": lambda tokens, **_: whole(tokens).filter("pos > 0"), "moved": lambda tokens, **_: whole(tokens).withColumn("pos", F.col("pos") + 1),
        "unmasked": lambda tokens, **_: tokens.withColumn("advantage", F.lit(1.0)), "whole": whole,
    }
    monkeypatch.setattr(estimators, "REGISTRY", bad)
    got = {r.name: (r.tokens, r.masked) for r in entry.queries()["estimators_agree"](spark, SF).collect()}
    tokens = views.tokens(spark, SF)
    n, first, masked = tokens.count(), tokens.filter("pos = 0").count(), tokens.filter("mask = 0").count()
    assert got["whole"] == (n, 0) and got["lost"] == (n - first, 0) and got["moved"][0] == n - first
    assert got["unmasked"] == (n, masked) and masked > 0
