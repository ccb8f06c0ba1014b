import itertools
import random

import pytest
from pyspark.sql import functions as F

from kairoframe.llm import chat_repair as C

LEGAL_NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def least_cost(roles):
    """Cheapest repair by trying out states turn by turn, without the operator's tables (Dijkstra over (turn, state))."""
    costs = {None: 0}
    for role in roles:
        after = {}
        for state, cost in costs.items():
            for target in C.ROLES:
                relabel = 0 if target == role else C.RELABEL
                if target == state:
                    after[target] = min(after.get(target, 10**9), cost + C.MERGE + relabel)
                reach = {state: 0}
                for n in range(1, 4):
                    for s in list(reach):
                        for t in LEGAL_NEXT[s]:
                            reach.setdefault(t, n)
                for s, n in reach.items():
                    if target in LEGAL_NEXT[s]:
                        after[target] = min(after.get(target, 10**9), cost + relabel + C.INSERT * n)
        costs = after
    return min(c + {None: 0, "assistant": 0, "user": C.INSERT, "system": 2 * C.INSERT}[s] for s, c in costs.items())


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", 0) for r in rows], "conv_id long, turn long, role string, text string, action string, stretch int")
    out = {}
    for r in C.repair(df, **options).orderBy("conv_id", "stretch", "position").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.action, r.cost, r.text))
    return out


def legal(turns):
    roles = [r for r, action, _, _ in turns if action not in ("merge", "relabel_merge")]
    state = None
    for r in roles:
        if r not in LEGAL_NEXT[state]:
            return False
        state = r
    return state in (None, "assistant")


@pytest.mark.parametrize("stretch", [4096, 2])
def test_all_short_conversations_cost_the_least(spark, stretch):
    rows, want = [], {}
    for n, roles in enumerate(c for k in range(1, 5) for c in itertools.product([*C.ROLES, "tool"], repeat=k)):
        want[n] = least_cost(roles)
        rows += [(n, t, role, f"{t}") for t, role in enumerate(roles)]
    got = run(spark, rows, stretch=stretch)
    assert {n: sum(c for _, _, c, _ in turns) for n, turns in got.items()} == want
    assert all(map(legal, got.values()))
    # Every text is kept, in order.
    assert all([t for _, a, _, t in turns if a != "insert"] == [str(i) for i in range(sum(a != "insert" for _, a, _, _ in turns))] for turns in got.values())


def test_long_conversation_in_stretches_costs_what_it_does_whole(spark):
    r = random.Random(2)
    rows = [(1, t, r.choice([*C.ROLES, None]), "x") for t in range(3000)]
    cost = {s: sum(c for _, _, c, _ in run(spark, rows, stretch=s)[1]) for s in (64, 100_000)}
    assert cost[64] == cost[100_000] == least_cost([x[2] for x in rows])


def test_nulls_repeats_and_ties(spark):
    rows = [(None, None, None, None), (2, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", None), (3, 0, "user", "a"), (3, 0, "assistant", "b")]
    got = run(spark, rows)
    assert got[2] == [("user", "keep", 0, "q"), ("assistant", "keep", 0, "")]
    assert [x[3] for x in got[3] if x[1] != "insert"] == ["b", "a"]  # of one number: by role
    assert legal(got[None])
    assert run(spark, []) == {}


def test_rendered_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    pieces = C.rendered(C.repair(df)).orderBy("stretch", "position").collect()
    assert "".join(p.piece for p in pieces) == "<|user|>\nhi\nthere<|assistant|>\nok"


def test_stretches_are_bounded_by_rows_whatever_the_turn_numbers(spark):
    r = random.Random(5)
    rows = [(conv, turn, r.choice([*C.ROLES, None]), f"{i:05}") for i, (conv, turn) in enumerate([(None, 3)] * 700 + [(None, None)] * 500 + [(8, 0)] * 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # Small ranges, so that a conversation goes over many parts.
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = C.repair(df, stretch=64).where("action <> 'insert'").collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    sizes = {}
    for x in out:
        sizes[x.conv_id, x.stretch] = sizes.get((x.conv_id, x.stretch), 0) + 1
    assert max(sizes.values()) == 64 and len(sizes) == -(-1200 // 64) + -(-300 // 64)
    role_key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3])
    for conv in (None, 8):
        got = [x.text for x in sorted((x for x in out if x.conv_id == conv), key=lambda x: (x.stretch, x.position))]
        assert got == [x[3] for x in sorted((x for x in rows if x[0] == conv), key=role_key)]


def test_partitions_without_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert C.repair(df.repartition(3)).where("conv_id = 2").collect() == []
    assert [x.action for x in C.repair(df.repartition(3)).orderBy("position").collect()] == ["keep", "insert"]


@pytest.mark.parametrize("turns", [4095, 4096, 4097, 8192])
def test_turns_at_the_edges_of_batches(spark, turns):
    df = spark.range(turns).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "CAST(id AS STRING) AS text")
    out = C.repair(df)
    assert out.where("action = 'keep'").count() == turns and out.where("action = 'insert'").count() == turns % 2


def test_many_conversations_in_one_partition(spark):
    df = spark.range(4096).selectExpr("id AS conv_id", "0L AS turn", "'assistant' AS role", "'x' AS text")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert C.repair(df).groupBy("conv_id").agg(F.sum("cost").alias("cost")).where("cost = 3").count() == 4096  # a user turn is put before each
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_query_over_the_whole_table_against_plain_search(spark):
    from kairoframe.llm.queries import op6_chat_repair

    folder = "/root/testdata/sf0.001"
    by_conv = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").distinct().orderBy("conv_id", "turn", "role", "text").collect():
        by_conv.setdefault(r.conv_id, []).append(r.role)
    got = {r.conv_id: r for r in op6_chat_repair(spark, folder).collect()}
    assert set(got) == set(by_conv)
    for conv, roles in by_conv.items():
        r = got[conv]
        assert (r.n_turns, r.cost) == (len(roles), least_cost(roles))
        assert r.cost == C.MERGE * r.n_merged + C.RELABEL * r.n_relabelled + C.INSERT * r.n_inserted
        assert r.n_out == r.n_turns - r.n_merged + r.n_inserted
