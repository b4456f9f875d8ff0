"""Merges give one result whatever the order, batching and repetition of records."""

import itertools
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keyloom.operators import merge

LAWS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
ADD = "key string, elem string, value string, hlc long, origin int"
COVER = "key string, elem string, hlc long, origin int"
version = st.tuples(st.integers(1, 49), st.integers(0, 3))
adds = st.lists(st.tuples(st.sampled_from("ab"), version), min_size=1, max_size=12)
covers = st.lists(st.tuples(st.sampled_from("ab"), version), max_size=8)


def live(spark, adds_, covers_):
    a = spark.createDataFrame([("k", e, f"{e}{h}.{o}", h, o) for e, (h, o) in adds_], ADD)
    c = spark.createDataFrame([("k", e, h, o) for e, (h, o) in covers_], COVER)
    return sorted(map(tuple, merge.or_elements(a, c).collect()))


@LAWS
@given(adds, covers, st.randoms())
def test_or_elements(spark, adds_, covers_, rnd):
    again = adds_ + adds_[: len(adds_) // 2]
    rnd.shuffle(again)
    got = live(spark, again, covers_ * 2)
    assert got == live(spark, adds_, covers_)
    want = {}
    for e, v in set(adds_) - set(covers_):
        want.setdefault(e, []).append(v)
    assert got == sorted(("k", e, f"{e}{max(v)[0]}.{max(v)[1]}", *max(v), len(v)) for e, v in want.items())


def test_more_than_four_live_dots_in_any_order(spark):
    dots = [(i, 0) for i in range(1, 6)]
    for order in random.Random(1).sample(list(itertools.permutations(dots)), 5):
        assert live(spark, [("a", d) for d in order], [("a", d) for d in dots[1:]]) == [("k", "a", "a1.0", 1, 0, 1)]


@LAWS
@given(st.lists(st.tuples(st.sampled_from("ab"), version), min_size=1, max_size=10), st.randoms())
def test_lww(spark, rows, rnd):
    def run(x):
        df = spark.createDataFrame([(k, f"{h}.{o}", h, o) for k, (h, o) in x], "key string, value string, hlc long, origin int")
        return sorted(map(tuple, merge.lww(df, ["key"], ["value"]).collect()))

    shuffled = rows * 2
    rnd.shuffle(shuffled)
    best = {}
    for k, v in rows:
        best[k] = max(best.get(k, v), v)
    assert run(rows) == run(shuffled) == sorted((k, f"{h}.{o}", h, o) for k, (h, o) in best.items())


SLOTS = "key string, base_hlc long, base_origin int, base long, node int, pos decimal(20,0), neg decimal(20,0)"


def test_counters_newest_base_wins_and_no_increment_is_lost(spark):
    from decimal import Decimal as D

    rows = [("c", 1, 0, 10, n, D(p), D(0)) for n in range(3) for p in range(1, 21)]
    assert merge.pn_counters(spark.createDataFrame(rows, SLOTS)).collect()[0].value == 70
    rows += [("c", 2, 0, 100, 0, D(1), D(0))]
    assert merge.pn_counters(spark.createDataFrame(rows, SLOTS)).collect()[0].value == 101
    rows = [("c", 1, 0, 2**63 - 1, 0, D(1), D(0))]
    found = merge.pn_counters(spark.createDataFrame(rows, SLOTS)).collect()[0]
    assert found.value is None and found.overflow


def test_hll_registers_and_tokens(spark):
    rows = [("k", 1, 5, 9, 0), ("k", 1, 5, 3, 1), ("k", 1, 4, 1, 0)]
    assert tuple(merge.hll_registers(spark.createDataFrame(rows, "key string, bucket int, rank int, hlc long, origin int")).collect()[0]) == ("k", 1, 5, 3, 1)
    rows = [("k", "t", 2, 1, 0), ("k", "t", 0, 9, 0)]
    assert merge.budget_tokens(spark.createDataFrame(rows, "key string, token string, rank int, hlc long, origin int")).collect()[0].rank == 2


def test_rga(spark):
    schema = "key string, hlc long, origin int, left_hlc long, left_origin int, value string, tomb boolean"
    rows = [("d", 1, 0, 0, 0, "a", False), ("d", 2, 0, 1, 0, "b", False), ("d", 3, 0, 1, 0, "c", True), ("d", 4, 1, 3, 0, "e", False), ("d", 9, 0, 77, 0, "x", False)]
    for order in (rows, rows[::-1], rows + rows):
        got = [r.value for r in merge.rga(spark.createDataFrame(order, schema)).orderBy("nth").collect()]
        assert got == ["x", "a", "e", "b"]


def test_equal_versions_do_not_depend_on_arrival(spark):
    """Different payloads of one version: the same one wins in every order."""
    rows = [("k", "e", v, 5, 1) for v in "hgfedcba"]
    schema = "key string, elem string, value string, hlc long, origin int"
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        frame = spark.createDataFrame(order, schema)
        assert merge.lww(frame, ["key", "elem"]).collect()[0].value == "h"
        assert merge.or_elements(frame, frame.limit(0)).collect()[0].value == "h"
    tokens = [("k", "t", r, 5, 1, a) for r, a in ((1, 3), (2, 8), (2, 9), (0, 99))]
    for order in (tokens, tokens[::-1]):
        assert merge.budget_tokens(spark.createDataFrame(order, "key string, token string, rank int, hlc long, origin int, amount int")).collect()[0].amount == 9
    nodes = [("d", 1, 0, 0, 0, v, False) for v in "abc"]
    for order in (nodes, nodes[::-1]):
        assert [r.value for r in merge.rga(spark.createDataFrame(order, "key string, hlc long, origin int, left_hlc long, left_origin int, value string, tomb boolean")).collect()] == ["c"]
