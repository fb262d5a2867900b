"""Mixing sources to target weights by Pareto order sampling.

Sources in order of code point, null last, weigh 5, 2, 1, repeating, and share
the corpus' words; a target stops at ``most`` times its source's size, and the
excess is shared again by weight until no target is above.

Within a source every document is due r = rate * weight copies, ``most`` at most.
The weight is that of a column, or else of the document's length: its number of
words to the power ``LENGTH_POWER``, as longer documents hold more connected text.
Weights are rounded to ``STEPS`` steps a doubling, so a source has a bounded number
of levels; from their sums comes the rate at which what is due adds up to the
target, documents at the bound included.  The whole copies of r are certain.  For the rest, with inclusion odds from p = r - whole,
documents are ranked by their random odds divided by their inclusion odds, and
taken in that order until the source's words come nearest its target (a sample
of fixed size in words, with unequal inclusion).  The cut is found by sums over ranges of ranks, so no
source is ever gathered in one task; what decides afterwards is a small table
with one row for each source.

Defined results: a null text has size 0 and is never copied more than its
source; null sources form one source; a document without words takes 0 words;
a null weight counts as 1, one of 0 or less as the least; very long texts count whole;
rows with equal key and text tie and are taken or left together; an empty table
gives an empty result; other columns are carried by ``mix`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tables import stored

#: The cycle of weights of the sources, in their order.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Ranges that each level of the search for a source's cut divides ranks into.
RANGES = 4096
#: Weight of a document by its number of words; steps of weights a doubling, and the doublings they span either way.
LENGTH_POWER = 0.125
STEPS, SPAN = 8, 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _random(key: Column, text: Column, seed: int) -> Column:
    """A number above 0 and below 1 from the key and text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, text), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def _level(size: Column, given: Column | None) -> Column:
    """The weight's level: STEPS times its binary logarithm, rounded."""
    log = F.log2(F.greatest(size, F.lit(1)).cast("double")) * LENGTH_POWER if given is None else F.log2(F.greatest(F.coalesce(given.cast("double"), F.lit(1.0)), F.lit(2.0**-SPAN)))
    return F.greatest(F.least(F.round(log * STEPS), F.lit(STEPS * SPAN)), F.lit(-STEPS * SPAN)).cast("int")


def _weight(level: Column) -> Column:
    return F.pow(F.lit(2.0), level / STEPS)


def _sources(levels: DataFrame) -> DataFrame:
    """One row for each source with its size and its place in code point order, null last."""
    each = levels.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = stored(each.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND(2**33 - 1)).alias("at")))
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # one row for each partition of the sort
        offsets += [F.lit(part), F.lit(before)]
        before += n
    offset = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    cycle = F.array(*map(F.lit, WEIGHTS))
    share = F.element_at(cycle, ((F.col("at") + offset) % len(WEIGHTS) + 1).cast("int"))
    return placed.select("source", "source_size", share.alias("share"))


def _targets(sources: DataFrame, most: float) -> DataFrame:
    """Adds target: the shares of all words, filled up to ``most`` times each source's size."""
    sources = stored(sources)
    cap = F.col("source_size") * most
    level = 0.0
    while True:
        full = cap <= F.col("share") * level
        row = sources.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, cap).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("open")).first()
        new = (row["total"] - row["full"]) / row["open"] if row["open"] else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("share") * level))


def _rates(levels: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Adds rate: what a weight of 1 is due, so that min(rate * weight, most) copies of all words are the source's target.

    Levels in falling order: if those before one are at the bound, the rest share what is left by weight.
    The first level at which that keeps within the bound gives the rate.
    """
    w = Window.partitionBy("source").orderBy(F.col("level").desc())  # a bounded number of levels
    up, down = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    rows = levels.where("size > 0").select("source", "level", "size", F.coalesce(F.sum("size").over(up), F.lit(0)).alias("full"), F.sum(F.col("size") * _weight(F.col("level"))).over(down).alias("rest"))
    rows = rows.withColumnRenamed("source", "_s").join(sources, F.col("_s").eqNullSafe(F.col("source")))
    rate = (F.col("target") - most * F.col("full")) / F.col("rest")
    fits = F.when(rate * _weight(F.col("level")) <= most * (1 + 1e-12), rate)
    found = rows.groupBy(F.col("_s").alias("_s")).agg(F.max_by(fits, F.when(fits.isNotNull(), F.col("level"))).alias("rate"), F.min("level").alias("least"))
    return sources.join(found, F.col("_s").eqNullSafe(F.col("source")), "left").select(*sources.columns, F.coalesce("rate", most / _weight(F.col("least")), F.lit(0.0)).alias("rate"))


def _due(most: float) -> tuple[Column, Column]:
    """Certain copies of a document, and the odds rank of its further copy between 0 and 1 (2: none)."""
    r = F.least(F.col("rate") * _weight(F.col("level")), F.lit(most))
    whole = F.floor(r + 1e-9)
    p = F.greatest(r - whole, F.lit(0.0))
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return whole.cast("long"), F.when(p > 1e-9, odds / (1 + odds)).otherwise(2.0)


def plan(docs: DataFrame, seed: int = 1, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """One row for each source: source_size, target, rate, and its cut: ranks below ``low`` and up to ``last`` are taken."""
    size = word_count(F.col(text_col))
    base = stored(docs.select(F.col(source_col).cast("string").alias("source"), size.alias("size"), _level(size, F.col(weight_col) if weight_col else None).alias("level"), _random(F.col(id_col), F.col(text_col), seed).alias("u")))
    levels = stored(base.groupBy("source", "level").agg(F.sum("size").alias("size")))
    sources = stored(_rates(levels, _targets(_sources(levels), most), most))
    whole, rank = _due(most)
    by_source = base.withColumnRenamed("source", "_s").join(sources, F.col("_s").eqNullSafe(F.col("source")))
    each = stored(by_source.where("size > 0").select("source", "target", "size", whole.alias("whole"), rank.alias("rank")))

    # What a source still wants after its certain copies, then twice: the range of ranks in which that runs out.
    left = each.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure"))
    state = stored(left.select("source", (F.col("target") - F.col("sure")).alias("want"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width")))
    rows = each.where("rank <= 1").select(F.col("source").alias("_s"), "size", "rank")
    for _ in range(2):
        own = rows.join(state, F.col("_s").eqNullSafe(F.col("source"))).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("width")))
        ranges = own.groupBy("source", "want", "low", "width", F.least(F.floor((F.col("rank") - F.col("low")) / F.col("width") * RANGES), F.lit(RANGES - 1)).alias("k")).agg(F.sum("size").alias("size"))
        w = Window.partitionBy("source").orderBy("k")  # RANGES rows for each source at most
        run = ranges.withColumn("upto", F.sum("size").over(w))
        found = run.where("upto > want").groupBy("source").agg(F.min_by(F.struct((F.col("want") - F.col("upto") + F.col("size")).alias("want"), (F.col("low") + F.col("width") * F.col("k") / RANGES).alias("low"), (F.col("width") / RANGES).alias("width")), "k").alias("x"))
        state = stored(found.select("source", "x.*"))
    # Within the last range, one in RANGES**2 of a source: take while that brings the sum nearer.
    own = rows.join(state, F.col("_s").eqNullSafe(F.col("source"))).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("width")))
    w = Window.partitionBy("source").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, 0)
    cuts = own.withColumn("upto", F.sum("size").over(w)).groupBy("source", "low").agg(F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("want"), F.col("rank"))).alias("last")).withColumnRenamed("source", "_s")
    # A source that has no such range takes all that is due: ranks are 1 at most.
    return stored(sources.join(cuts, F.col("_s").eqNullSafe(F.col("source")), "left").select(*sources.columns, F.coalesce("low", F.lit(1.5)).alias("low"), F.coalesce("last", F.lit(-1.0)).alias("last")))


def _with_copies(docs: DataFrame, seed: int, most: float, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    """(document: struct of all columns, size, copies, source_size, target) of every row."""
    made = plan(docs, seed, most, id_col, text_col, source_col, weight_col)
    whole, rank = _due(most)
    at = lambda c: F.col(f"document.`{c}`")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
    size = word_count(at(text_col))
    rows = rows.select("document", size.alias("size"), _level(size, at(weight_col) if weight_col else None).alias("level"), _random(at(id_col), at(text_col), seed).alias("u"), at(source_col).cast("string").alias("_s"))
    taken = ((rank < F.col("low")) | (rank <= F.col("last"))).cast("long")
    return rows.join(made, F.col("_s").eqNullSafe(F.col("source"))).select("document", "size", F.when(F.col("size") > 0, whole + taken).otherwise(0).alias("copies"), "source_size", "target")


def mix(docs: DataFrame, seed: int = 1, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """The mix: the table's rows and columns, each row as often as it is taken."""
    rows = _with_copies(docs, seed, most, id_col, text_col, source_col, weight_col)
    return rows.where("copies > 0").select(F.explode(F.array_repeat("document", F.col("copies").cast("int"))).alias("document")).select("document.*")


def mixture(docs: DataFrame, seed: int = 1, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = _with_copies(docs.select("doc_id", "text", "source"), seed, most, "doc_id", "text", "source", None)
    return rows.select("document.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
