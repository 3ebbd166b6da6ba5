"""Temperature mixing of sources, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, long_rows, stored

MOST_SOURCES = 100_000  # that are broadcast; with more, the tables meet by a shuffle


def words(text: Column) -> Column:
    """How many runs of other than white space a text has; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def order_key(*parts: Column) -> Column:
    """A hash that puts rows in a random order, the same in every run."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _total(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))


def exponent(shares: Column, evenness: float | None, max_repeats: float | None, keep_all: bool, steps: int = 50) -> Column:
    """The largest a in [0, 1] for which weights in proportion to share^a have at least `evenness` times the greatest
    possible entropy, and that repeat no source over `max_repeats` times, found by halving; 1 (the shares as they are)
    if they do already, 0 if no exponent does. shares: an array, none of them 0."""
    n = F.size(shares).cast("double")

    def meets(a: Column) -> Column:
        z = F.nullif(_total(shares, lambda p: F.pow(p, a)), F.lit(0.0))  # null where there are no shares
        ok = F.lit(True)
        if evenness is not None:
            entropy = F.log(z) - a * _total(shares, lambda p: F.pow(p, a) * F.log(p)) / z
            ok = ok & (entropy >= evenness * F.log(n) - 1e-12)
        if max_repeats is not None:
            least = F.array_min(F.transform(shares, lambda p: F.pow(p, a - 1)))
            most = F.array_max(F.transform(shares, lambda p: F.pow(p, a - 1)))
            # keep_all gives the least repeated source one pass; otherwise the passes add up to the corpus
            ok = ok & ((most / least if keep_all else most / z) <= max_repeats + 1e-12)
        return ok

    low, high = (0.0, 1.0)
    # the entropy falls with a, repetition falls with a: each bound is halved on its own side
    if evenness is not None:
        start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
        halved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.struct(F.when(meets((s["lo"] + s["hi"]) / 2), (s["lo"] + s["hi"]) / 2).otherwise(s["lo"]).alias("lo"), F.when(meets((s["lo"] + s["hi"]) / 2), s["hi"]).otherwise((s["lo"] + s["hi"]) / 2).alias("hi")))
        return F.round(F.when(meets(F.lit(1.0)), F.lit(1.0)).otherwise(halved["lo"]), 9)
    if max_repeats is not None:
        start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
        halved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.struct(F.when(meets((s["lo"] + s["hi"]) / 2), s["lo"]).otherwise((s["lo"] + s["hi"]) / 2).alias("lo"), F.when(meets((s["lo"] + s["hi"]) / 2), (s["lo"] + s["hi"]) / 2).otherwise(s["hi"]).alias("hi")))
        return F.round(F.when(meets(F.lit(0.0)), F.lit(0.0)).otherwise(halved["hi"]), 9)
    return F.lit(1.0)


def plan(sized: DataFrame, source: str, tokens: str, evenness: float | None = None, max_repeats: float | None = None, keep_all: bool = False, block_docs: int = 4096) -> DataFrame:
    """(source, docs, total, weight, budget, full, rest, blocks), a row a source.

    Give one target: `evenness` (the entropy of the weights over that of equal ones) picks the largest exponent that
    meets it, `max_repeats` the smallest, so that small sources gain as much as the limit allows. Budgets share out the
    corpus's tokens; with keep_all they are scaled up until every source has one full pass. `full` passes over a source
    and `rest` tokens of one more make its budget. The array of shares has an entry a source, never more."""
    if (evenness is None) == (max_repeats is None):
        raise ValueError("give one of evenness and max_repeats")
    per = sized.groupBy(source).agg(F.count(F.lit(1)).alias("docs"), F.sum(tokens).alias("total"))
    real = per.where("total > 0").agg(F.sum("total").cast("double").alias("t"), F.sort_array(F.collect_list(F.col("total").cast("double"))).alias("all"))
    a = real.select("t", F.transform("all", lambda x: x / F.col("t")).alias("shares"))
    a = a.select("t", "shares", exponent(F.col("shares"), evenness, max_repeats, keep_all).alias("a"))
    a = a.select("t", "a", _total(F.col("shares"), lambda p: F.pow(p, F.col("a"))).alias("z"), F.array_max(F.transform("shares", lambda p: F.pow(p, 1 - F.col("a")))).alias("up"))
    one = a.select(F.struct("t", "a", "z", "up")).scalar()
    out = per.withColumn("all", one).select("*", "all.*")
    raised = F.pow(F.col("total") / F.col("t"), F.col("a"))
    out = out.withColumn("weight", F.when(F.col("total") > 0, F.round(raised / F.col("z"), 12)).otherwise(0.0))
    scale = F.col("t") * F.col("z") * F.col("up") if keep_all else F.col("t")
    budget = F.floor(F.when(F.col("total") > 0, F.round(raised / F.col("z") * scale, 3)).otherwise(0.0))
    out = out.withColumn("budget", F.greatest(budget, F.col("total")) if keep_all else budget)
    full = F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(0)
    return out.withColumn("full", full.cast("int")).select(source, "docs", "total", "weight", "budget", "full", (F.col("budget") - F.col("full") * F.col("total")).alias("rest"), F.ceil(F.col("docs") / block_docs).cast("int").alias("blocks"))


def mix(docs: DataFrame, evenness: float | None = None, max_repeats: float | None = None, keep_all: bool = False, block_docs: int = 4096, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """The mixture, a row a chosen copy of a document: key, source, tokens, epoch, block, place; with carry, all of the
    columns of docs instead of these.

    A source's documents are dealt into blocks of about `block_docs` by a hash of key and text. In each pass (epoch)
    blocks come in an order of their own and so do documents within a block: a block permutation, realised by two short
    windows (over a source's blocks, over a block's documents), so no source is sorted as a whole. `full` passes are
    taken whole; of one more pass those documents whose running sum of tokens stays within `rest`. So a budget is met
    but for less than a document. The first pass is epoch 0; place is the rank in the block, from 1.

    A null source is a source like others, a null text has no tokens, a document without tokens comes in every pass
    including the last. Repeated rows are documents of their own; rows equal in key and text may take either's
    place. An empty table gives an empty mixture. With carry, whole rows aren't shuffled: a document's passes are told
    by its block and by a cut in the order of the one block in which its source's budget ends."""
    tokens, block, doc, epoch, place, run, full, rest, blocks, total, before, same, here, inside, cut = fresh(docs, *(f"mx_{n}" for n in ("tokens", "block", "doc", "epoch", "place", "run", "full", "rest", "blocks", "total", "before", "same", "here", "inside", "cut")))
    sized = long_rows(docs).withColumn(tokens, words(F.col(text))).withColumn(doc, order_key(F.col(key), F.col(text)))
    sized = sized.select(key, source, tokens, doc)
    base = stored(sized.select(source, tokens, doc), "sizes")
    shares = stored(plan(base, source, tokens, evenness, max_repeats, keep_all, block_docs), "plan")
    # a row a source: sent to all only if counted few
    small = F.broadcast if shares.count() <= MOST_SOURCES else lambda x: x

    def with_plan(df: DataFrame) -> DataFrame:
        p = shares.select(F.col(source).alias(same), F.col("full").alias(full), F.col("rest").alias(rest), F.col("blocks").alias(blocks))
        df = df.join(small(p), F.col(source).eqNullSafe(F.col(same))).drop(same)
        return df.withColumn(block, F.pmod(F.conv(F.substring(doc, 1, 8), 16, 10).cast("long"), F.col(blocks)).cast("int"))

    totals = with_plan(base).groupBy(source, block, full).agg(F.sum(tokens).alias(total))
    by = W.partitionBy(source).orderBy(order_key(F.lit(seed), F.col(source), F.col(full), F.col(block)), block)
    sums = F.sum(total).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col(total)
    starts = stored(totals.select(F.col(source).alias(same), F.col(block).alias(here), sums.alias(before), F.col(total).alias(inside)), "blocks")
    starts = F.broadcast(starts) if starts.count() <= MOST_SOURCES else starts
    with_block = lambda df: with_plan(df).join(starts, F.col(source).eqNullSafe(F.col(same)) & (F.col(block) == F.col(here))).drop(same, here)
    if carry:
        # which documents come is told by their block and, in the one block of a source where its budget ends, by a cut in
        # the order of documents; so that order is made of that block's short rows, and whole rows stay where they are
        edge = (F.col(before) <= F.col(rest)) & (F.col(rest) < F.col(before) + F.col(inside))
        order = order_key(F.lit(seed), F.col(full), F.col(doc))
        ends = with_block(base).where(edge).withColumn(place, order)
        spent = F.sum(tokens).over(W.partitionBy(source, block).orderBy(place, doc).rowsBetween(W.unboundedPreceding, 0))
        ends = ends.withColumn(run, (F.col(before) + spent <= F.col(rest)).cast("int")).groupBy(source, place).agg(F.sum(run).alias("taken"), F.count(F.lit(1)).alias("there"))
        cuts = ends.where("taken > 0").groupBy(source).agg(F.max(F.struct(F.col(place).alias("at"), "taken", "there")).alias(cut))
        cuts = stored(cuts.select(F.col(source).alias(same), cut), "cuts", MOST_SOURCES)
        rows = with_block(docs.withColumn(doc, order_key(F.col(key), F.col(text))))
        rows = rows.join(small(cuts), F.col(source).eqNullSafe(F.col(same)), "left").drop(same).withColumn(place, order)
        tie = F.coalesce(edge & (F.col(place) == F.col(cut)["at"]), F.lit(False))
        under = F.coalesce(edge & (F.col(place) < F.col(cut)["at"]), F.lit(False))
        last = F.when((F.col(before) + F.col(inside) <= F.col(rest)) | under | tie, 1).otherwise(0)
        times = lambda df, n: df.where(n > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)
        if not cuts.where(F.col(cut)["taken"] < F.col(cut)["there"]).limit(1).count():
            return times(rows, F.col(full) + last)
        # of equal rows at a cut only some come
        split = tie & (F.col(cut)["taken"] < F.col(cut)["there"])
        some = rows.where(split).withColumn(run, F.row_number().over(W.partitionBy(source).orderBy(key)))
        return times(rows.where(~split), F.col(full) + last).unionByName(times(some, F.col(full) + (F.col(run) <= F.col(cut)["taken"]).cast("int")))
    rows = with_block(sized)
    # a block that begins beyond the last pass's budget needs no copy for it
    last = F.col(full) - F.when(F.col(before) <= F.col(rest), 0).otherwise(1)
    rows = rows.where(last >= 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), last)))
    w = W.partitionBy(source, block, epoch).orderBy(order_key(F.lit(seed), F.col(epoch), F.col(doc)), key)
    rows = rows.withColumn(place, F.row_number().over(w)).withColumn(run, F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.where((F.col(epoch) < F.col(full)) | (F.col(before) + F.col(run) <= F.col(rest)))
    return rows.select(key, source, F.col(tokens).alias("tokens"), F.col(epoch).alias("epoch"), F.col(block).alias("block"), F.col(place).alias("place"))
