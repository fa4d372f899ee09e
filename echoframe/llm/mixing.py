"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target divided by its size is the fractional number of copies of each of
its documents.  The whole part is taken for certain; the fractional parts are rounded
pairwise: of two documents one gives up words and the other gains as many, in a
random direction whose odds keep both expectations, until one of them is integral.
So the words taken from a source stay at its target up to half of one last document,
which is rounded to the nearer side.
Chunks of about 64 documents are rounded side by side; what each leaves (one
fractional document) meets the leftovers of 63 other chunks on the next level of a
reduction tree, up to one leftover a source.

Random numbers are hashes of doc_id, text and a number of equal rows, so reruns agree
whatever the partitions.
Defined results: null text has size 0; documents of size 0 are kept once and take 0
words; a null source is a source of its own, last in order; equal rows are rounded one by
one; an empty table gives an empty result; further columns are not read
(mixed_documents returns them as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

CHUNK = 64
#: Equal rows that are numbered in one go, and parts in which they are joined to their copies.
RUN, PARTS = 10_000, 1024
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: A probability this near to 0 or 1 is integral.
NEAR = 1e-9

WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each document, and a hash of its text."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))


def numbered(docs: DataFrame) -> DataFrame:
    """sizes() of docs with n, which numbers equal rows: they are counted before they are shuffled, and dealt out again in runs of RUN, so that no task holds all of them."""
    key = ["doc_id", "source", "size", "h"]
    counted = written(sizes(docs).withColumn("doc_id", F.col("doc_id").cast("long")).groupBy(*key).agg(F.count("*").alias("rows")), "sizes")
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / RUN))))
    if counted.filter(F.col("rows") > RUN).limit(1).count():
        runs = runs.repartition(*key, "run")
    last = F.least(F.col("rows"), (F.col("run") + 1) * RUN) - 1
    return runs.select(*key, F.explode(F.sequence(F.col("run") * RUN, last)).alias("n"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, documents, target): targets by weight, none above cap times its source's size.

    Sharing out the excess again and again ends where every target is
    min(weight * level, cap * size): the level follows from running sums over the
    sources in the order in which they reach their caps.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("documents"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.lit(cap) * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("weight"))
    order = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    by = by.withColumn("level", level)
    # the first source, in this order, that the remaining level doesn't fill sets the level of all later ones
    open_level = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", F.coalesce("source", F.lit("\U0010ffff")).alias("s"), "level"))).over(everything)["level"]
    return by.withColumn("open", open_level).select(
        "source", "source_size", "documents", F.least(F.col("cap"), F.coalesce(F.col("open"), F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(*keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


_ITEM = "struct<order:bigint,u:double,doc_id:bigint,size:bigint,p:double>"


def _round_chunk(items: Column) -> Column:
    """From the items of a chunk: struct(done: array of decided items with p 0 or 1, rest: the fractional item left, or null)."""

    def item(x, p):
        return F.struct(x["order"].alias("order"), x["u"].alias("u"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p")).cast(_ITEM)

    def settle(done, a, pa, b, pb):
        """Puts a and b with their new probabilities where they belong; one of them is integral."""
        a_in = (pa > NEAR) & (pa < 1 - NEAR)
        b_in = (pb > NEAR) & (pb < 1 - NEAR)
        return F.struct(
            F.concat(done, F.when(a_in, F.array(item(b, F.round(pb)))).when(b_in, F.array(item(a, F.round(pa)))).otherwise(F.array(item(a, F.round(pa)), item(b, F.round(pb))))).alias("done"),
            F.when(a_in, item(a, pa)).when(b_in, item(b, pb)).alias("rest"),
        )

    def pair(done, a, b):
        wa, wb = a["size"].cast("double"), b["size"].cast("double")
        up = F.least(wa * (1 - a["p"]), wb * b["p"])
        down = F.least(wa * a["p"], wb * (1 - b["p"]))
        moves = F.struct(F.when(b["u"] * (up + down) < down, up).otherwise(-down).alias("x"))
        return _let(moves, lambda m: settle(done, a, a["p"] + m["x"] / wa, b, b["p"] - m["x"] / wb))

    def step(acc, b):
        return F.when(acc["rest"].isNull(), F.struct(acc["done"].alias("done"), b.cast(_ITEM).alias("rest"))).otherwise(pair(acc["done"], acc["rest"], b))

    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("rest"))
    return F.aggregate(items, start, step)


def _level(rows: DataFrame) -> DataFrame:
    """One level of the tree over (source, chunk, u, doc_id, size, p).

    Large documents come first, so that what a chunk leaves tends to be small.
    """
    items = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "u", "doc_id", "size", "p").cast(_ITEM)))
    return rows.groupBy("source", "chunk").agg(items.alias("items")).select("source", "chunk", _round_chunk(F.col("items")).alias("r"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of docs; doc_id is an integer column."""
    sized = numbered(docs)
    goal = written(targets(sized, weights, cap), "targets")
    most = goal.agg(F.max("documents")).first()[0] or 0
    # goal has one row a source; Spark broadcasts it only below its own size limit and else splits skewed sources
    s, g = sized.alias("s"), goal.alias("g")
    share = F.least(F.lit(cap), F.when(F.col("g.source_size") > 0, F.col("target") / F.col("g.source_size")).otherwise(F.lit(0.0)))
    rows = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.doc_id", "s.source", "s.size", "s.h", "s.n", "g.source_size", "target", "documents", share.alias("share"))
    whole = F.when(F.col("share") - F.floor("share") > 1 - NEAR, F.floor("share") + 1).otherwise(F.floor("share"))
    rows = rows.withColumn("whole", whole.cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("share") - F.col("whole")))
    fractional = (F.col("size") > 0) & (F.col("p") > NEAR)
    settled = rows.filter(~fractional).select("doc_id", "source", "size", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(1)).cast("long").alias("copies"))
    chunks = F.ceil(F.col("documents") / CHUNK)
    leaf = rows.filter(fractional).select(
        "source", F.pmod(F.xxhash64("doc_id", "size", "h", "n"), chunks).alias("chunk"), _uniform("doc_id", "size", "h", "n", F.lit(0)).alias("u"), "doc_id", "size", "p"
    )
    done = []
    level, width = 0, -(-most // CHUNK)
    while True:
        result = written(_level(leaf), f"level{level}")
        done.append(result.select("source", F.explode("r.done").alias("d")).select("source", "d.doc_id", "d.size", F.col("d.p").cast("long").alias("bit")))
        rest = result.filter("r.rest is not null").select("source", "chunk", "r.rest.*")
        level += 1
        if width <= 1:
            break
        width = -(-width // CHUNK)
        leaf = rest.select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), _uniform("doc_id", "size", F.lit(level)).alias("u"), "doc_id", "size", "p")
    done.append(rest.select("source", "doc_id", "size", (F.col("p") >= 0.5).cast("long").alias("bit")))
    bits = done[0]
    for more in done[1:]:
        bits = bits.unionByName(more)
    b = bits.alias("b")
    rounded = b.join(g, F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        "b.doc_id", "b.source", "b.size", (F.floor(F.least(F.lit(cap), F.col("target") / F.col("g.source_size"))).cast("long") + F.col("bit")).alias("copies"), "g.source_size", "target"
    )
    c = settled.alias("c")
    return rounded.unionByName(c.join(g, F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.doc_id", "c.source", "c.size", "c.copies", "g.source_size", "target"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """docs with all their columns, each row as often as the mix takes it.

    Rows that agree in doc_id, source and size share their copies evenly; which of them
    have the odd ones follows from their places in the table.
    """
    key = ["_id", "_source", "_size"]
    plan = mix(docs, weights, cap).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies").groupBy(key).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    plan = written(plan, "plan")
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    repeated = bool(plan.filter("_rows > 1").limit(1).count())
    if repeated:
        inside = inside.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)))
    # the plan has a row a document, so it is never a table to broadcast
    a, b = inside.alias("a"), plan.alias("b").hint("merge")
    joined = a.join(b, [F.col("a._id").eqNullSafe(F.col("b._id")), F.col("a._source").eqNullSafe(F.col("b._source")), F.col("a._size") == F.col("b._size")]).select("a.*", "_copies", "_rows")
    take = F.col("_copies")
    if repeated:
        # numbered within PARTS of a key's rows, so that no task sorts all of them
        parts = inside.groupBy(*key, "_part").agg(F.count("*").alias("_k"))
        before = F.sum("_k").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        j, p = joined.alias("j"), parts.withColumn("_before", F.coalesce(before, F.lit(0))).alias("p").hint("merge")
        same = [F.col(f"j.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*key, "_part")]
        joined = j.join(p, same).select("j.*", "_before").withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.xxhash64("_row.text"))) + F.col("_before"))
        take = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_n") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    out = joined.withColumn("_take", take.cast("int")).filter("_take > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_take"))).alias("_"))
    return out.select("_row.*")
