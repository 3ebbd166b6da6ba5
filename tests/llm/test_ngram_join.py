import random
from collections import Counter

import numpy as np

from barloom.llm import common, ngram_join

WORDS = [f"w{i}" for i in range(400)]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(links, component) by comparing all pairs of rows."""
    sets = [grams(t) for _, t in rows]
    links, up = Counter(), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return links, [least.get(find(i)) for i in range(len(rows))]


def corpus():
    r, rows = random.Random(4), []
    for base in range(12):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, 9)):
            copy = list(words)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(words).upper()))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE  two"), (905, "one"), (906, "x " * 30_000)]
    return rows


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(df, **more).collect()
    links, comp = brute(rows)
    want = sorted(((k, c if c is not None or t and t.split() else k, links[i]) for i, ((k, t), c) in enumerate(zip(rows, comp, strict=True))), key=repr)
    assert sorted(((g.doc_id, g.class_id, g.n_links) for g in got), key=repr) == want


def test_equals_brute_force(spark):
    check(spark, corpus())


def test_large_groups_meet_in_blocks(spark):
    check(spark, corpus(), block=4)


def test_repeated_rows_and_null_keys(spark):
    t = " ".join(WORDS[:60])
    check(spark, [(1, t), (1, t), (2, t), (None, t), (None, None), (3, t + " more"), (4, "other words stand in this text here")])
    check(spark, [(None, t), (None, t)])


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6)], "doc_id long, text string, class_id int, kept_key int")
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0
    out = ngram_join.drop_near_duplicates(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f", 5, 6)]


def test_one_of_each_group_stays(spark):
    rows = corpus() + [(None, "a text without a key stands here as it is")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in ngram_join.drop_near_duplicates(df).collect()}
    _, comp = brute(rows)
    assert kept == {k for (k, t), c in zip(rows, comp, strict=True) if k == c or not (t or "").split() or k is None}


def test_recall_at_the_threshold():
    bands = ngram_join.bands_for(0.8, 6, 1e-5)
    assert (1 - 0.8**6) ** bands <= 1e-5
    r, hit = random.Random(1), 0
    for _ in range(200):
        a = [r.getrandbits(64) for _ in range(90)]
        sets = [np.unique(np.array(x, np.uint64)) for x in (a[:80] + a[80:85], a[:80] + a[85:])]  # 80 of 90 shared
        keys = ngram_join.band_keys(ngram_join.min_hashes(sets, bands * 6), bands, 6)
        hit += bool((keys[0] == keys[1]).any())
    assert hit == 200


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(600, 700)] + [(7, 7)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(600, 700)} == {500} and 7 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stored_tables_can_be_dropped(spark):
    import os

    df = common.stored(spark.range(5), "five")
    where = df._barloom_path.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(where)
    common.forget(df)
    assert not os.path.exists(where)
    assert common.own_dir(spark).startswith(common.shared_dir(spark))


def test_a_long_chain_of_candidates_is_parted(spark):
    r = random.Random(12)
    words = [f"v{r.randrange(10**6)}" for _ in range(16_000)]
    rows, at = [], 0
    for k in range(1200):
        rows.append((k, " ".join(words[at : at + 60])))
        at += r.choice((6, 9, 12))  # linked to the one before, or only likely to share a band with it
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {g.doc_id: (g.class_id, g.n_links) for g in ngram_join.near_duplicates(df, block=32).collect()}
    links, comp = brute(rows)
    assert got == {k: (c, links[i]) for i, ((k, _), c) in enumerate(zip(rows, comp, strict=True))}
    assert max(Counter(c for c, _ in got.values()).values()) < 32 < len(rows)


def test_sketches_join_what_is_plausible():
    a = np.zeros((6, 200), np.uint8)
    a[1, :30], a[2, :60], a[3] = 1, 1, np.arange(200)
    a[4], a[5] = a[3], a[3]
    a[5, :150] += 7
    got = ngram_join.sketch_links(list("abcdef"), a, ngram_join.plausible(0.8, 200))
    forest = common.Forest(6)
    for x, y in got:
        forest.join("abcdef".index(x), "abcdef".index(y))
    assert [forest.find(k) for k in range(6)] == [0, 0, 0, 3, 3, 5]


def test_hot_join_equals_a_join(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(2000)] + [(None, -1), (99, -2)], "k int, x int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "k int, y string")
    counts = left.where("k is not null").groupBy("k").count().withColumnRenamed("count", "rows")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).select("k", "x", "y").collect()))
        assert sorted(map(str, common.hot_join(left, right, "k", counts, how).select("k", "x", "y").collect())) == want
    assert common.hot_keys(counts, "k").collect() and common.hot_keys(counts.where("k > 90"), "k") is None
    lost = left.where("k = 0")
    assert common.hot_join(lost, right.where("k > 0"), "k", counts, "left").where("y is null").count() == lost.count()


def test_components_of_a_hub(spark):
    edges = [(0, k) for k in range(1, 1500)] + [(2000 + k, 2001 + k) for k in range(40)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1500)} == {0} and {got[2000 + k] for k in range(41)} == {2000}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: d)

    try:
        common.shared_dir(Session())
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError


def test_links_of_near_copies_become_a_star(spark):
    """Components stay; a link a text stays of those that texts have a band each."""
    from barloom.llm.common import components
    from barloom.llm.ngram_join import starred

    links = [(f"t{i:03d}", f"r{k}") for i in range(200) for k in range(6)] + [("t000", "t000"), ("x", "y"), ("y", "y"), ("z", "y"), ("z", "w"), ("lone", "lone")]
    df = spark.createDataFrame(links, "a string, b string")
    star = starred(df, "a", "b")
    assert star.count() <= 210
    groups = lambda edges: sorted((r.node, r.comp) for r in components(edges).collect())
    assert groups(star) == groups(df)
