import hashlib
import math
import random

import pytest

from barloom.llm import mixing


def corpus(r, sizes):
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + k, s, "w " * r.randint(1, 30)) for k in range(n)]
    return rows


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def md5(*x):
    return hashlib.md5("|".join("" if v is None else str(v) for v in x).encode()).hexdigest()


def brute(rows, plan, block_docs, seed=1):
    """The mixture by plain loops over the plan's budgets."""
    out = []
    for p in plan:
        docs = [(k, len((t or "").split()), md5(k, t)) for k, s, t in rows if s == p.source]
        blocks = {}
        for k, n, h in docs:
            blocks.setdefault(int(h[:8], 16) % p.blocks, []).append((k, n, h))
        order = sorted(blocks, key=lambda b: (md5(seed, p.source, p.full, b), b))
        for e in range(p.full + 1):
            spent = 0
            for b in order:
                run = 0
                for place, (k, n, h) in enumerate(sorted(blocks[b], key=lambda d: (md5(seed, e, d[2]), d[0])), 1):
                    run += n
                    if e < p.full or spent + run <= p.rest:
                        out.append((k, p.source, n, e, b, place))
                spent += run
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{"evenness": 0.95}, {"max_repeats": 1.5, "keep_all": True}, {"max_repeats": 3.0}])
def test_mixture_equals_loops(spark, how):
    rows = corpus(random.Random(3), {"a": 120, "b": 20, "c": 7, None: 9}) + [(900, "b", None), (901, "c", ""), (902, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = df.select("source", mixing.words(df.text).alias("n"))
    plan = mixing.plan(sized, "source", "n", block_docs=8, **how).collect()
    got = mixing.mix(df, block_docs=8, **how).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, plan, 8)
    spent = {}
    for r in got:
        spent[r.source] = spent.get(r.source, 0) + r.tokens
    for p in plan:
        assert p.budget - 40 < spent.get(p.source, 0) <= p.budget or p.total == 0
    if how.get("keep_all"):
        assert {r.doc_id for r in got} == {k for k, _, _ in rows}


@pytest.mark.parametrize("how", [{"evenness": 0.95}, {"max_repeats": 1.5, "keep_all": True}, {"max_repeats": 3.0}])
def test_whole_rows_come_as_often_as_short_ones(spark, how):
    rows = corpus(random.Random(4), {"a": 150, "b": 25, "c": 7, None: 9}) + [(900, "b", None), (901, "c", ""), (902, "empty", None)]
    rows += [(7000, "b", "same row " * 3)] * 9 + [(7001, "c", "w " * 12)] * 5 + [(None, "c", "no key " * 4)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "doc_id + 1 as more")
    for block_docs in (8, 4096):
        short = mixing.mix(df, block_docs=block_docs, **how).groupBy("doc_id", "source").count().collect()
        whole = mixing.mix(df, block_docs=block_docs, carry=True, **how)
        assert whole.columns == df.columns
        assert sorted(map(str, short)) == sorted(map(str, whole.groupBy("doc_id", "source").count().collect()))
        assert whole.join(df, ["doc_id", "source", "text", "more"], "left_anti").where("doc_id is not null and source is not null and text is not null").count() == 0


def test_whole_rows_are_not_shuffled(spark):
    df = spark.createDataFrame(corpus(random.Random(4), {"a": 150, "b": 25}), "doc_id long, source string, text string")
    plan = mixing.mix(df, max_repeats=1.5, keep_all=True, carry=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "Python" not in plan


def test_targets_are_met(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("d", 1)], "source string, n long")
    even = mixing.plan(df, "source", "n", evenness=0.9).collect()
    assert math.isclose(entropy([p.weight for p in even]), 0.9 * math.log(4), rel_tol=1e-6)
    few = mixing.plan(df, "source", "n", max_repeats=5.0).collect()
    assert math.isclose(max(p.weight * 1111 / p.total for p in few), 5.0, rel_tol=1e-6)
    kept = mixing.plan(df, "source", "n", max_repeats=5.0, keep_all=True).collect()
    assert math.isclose(max(p.budget / p.total for p in kept), 5.0, rel_tol=1e-6) and min(p.full for p in kept) >= 1
    assert [p.weight for p in mixing.plan(df, "source", "n", evenness=0.1).orderBy("source").collect()] == pytest.approx([x / 1111 for x in (1000, 100, 10, 1)])
    with pytest.raises(ValueError):
        mixing.plan(df, "source", "n")


def test_edges_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, 2, 3), (1, "a b", "s", 1, 2, 3), (None, None, None, 1, 2, 3)], "doc_id long, text string, source string, full int, rest int, mx_block int")
    out = mixing.mix(df, max_repeats=2.0, keep_all=True, carry=True)
    assert out.columns == df.columns and out.count() == 3
    assert mixing.mix(df.limit(0), evenness=0.9).count() == 0
    assert mixing.mix(df.where("text is null"), evenness=0.9).count() == 1


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(df, evenness=0.9)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
