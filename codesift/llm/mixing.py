"""Mixing sources to target weights by pivotal rounding, in DataFrame operations.

How often a document is taken is its source's target over the source's size, a number
from 0 to ``MAX_COPIES``. Its whole part is certain; the fraction is a probability that
pivotal rounding turns into 0 or 1: two documents meet and one hands words to the other,
which one being drawn with the odds that keep every document's expectation, until one of
the two is decided; the other goes on to the next meeting. A meeting changes no
sum of expected words, so a source ends near its target.

The meetings form a tree. Documents of a source are parted by the magnitude of
their size, and then into blocks of about ``BLOCK`` documents by a hash; the number of
blocks follows from counts. A block is folded in one row and leaves at most one undecided
document. Those residuals go to the next level, with ``BLOCK`` times fewer blocks. The
first block of each magnitude is kept for the last level, one fold for each source
over the residuals and the kept blocks from large documents to small ones, so that the
one document left undecided is small; it is rounded to the nearer side.
Only ids, sizes and fractions are shuffled, a source of any size is spread over its
blocks, the last fold has a few hundred documents for each magnitude, and the number of
levels grows with the logarithm of the input. Draws are hashes of ids, so reruns agree
whatever the partitioning.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of
its own and stands last; repeated rows and rows without an id are documents of their own, told apart by a count
of equal rows; an empty table gives no rows; sources without words have target 0. Only
the columns named are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions.text import let
from codesift.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2.0
BLOCK = 256
SPLIT = 100_000
# Fractions this near to 0 or 1 are taken as decided; sums of doubles end there.
SETTLED = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source, source_size, target``, one row for each source.

    Sharing the excess of full sources again and again ends where every source gets its
    weight times one common level, or its limit if that is lower. Sources by the ratio of
    limit to weight are full up to some place in this order; the level follows
    from what is left for the others. These windows see one row for each source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place)
    limit = MAX_COPIES * F.col("source_size")
    by_ratio = Window.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = per_source.withColumns({"weight": weight, "limit": limit}).withColumn("ratio", F.col("limit") / F.col("weight"))
    rows = rows.withColumns({
        "full": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "mass": share * F.sum("source_size").over(everything),
    })
    # The level if this source and all after it in the order were open.
    rows = rows.withColumn("level", (F.col("mass") - F.col("full")) / F.col("open"))
    # The first place where the level is no higher than the source's own limit allows.
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct(F.row_number().over(by_ratio).alias("at"), "level"))
    rows = rows.withColumn("fits", fits).withColumn("common", F.min("fits").over(everything)["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("common"), F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _draw(salt: int, *ids: Column) -> Column:
    """A number from 0 to 1 that the documents of ``ids`` share."""
    return (F.xxhash64(*ids, F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


UNIT = "struct<size:bigint,uid:bigint,copy:bigint,p:double>"


def _fold(units: Column, level: int) -> Column:
    """All meetings of one block, large documents first: the undecided one, if any, and the decided ones."""
    none = F.lit(None).cast(UNIT)
    decided = "array<struct<uid:bigint,copy:bigint,extra:int>>"
    start = F.struct(none.alias("open"), F.array().cast(decided).alias("done"))

    def settled(unit: Column, extra: int) -> Column:
        return F.struct(unit["uid"].alias("uid"), unit["copy"].alias("copy"), F.lit(extra).alias("extra"))

    def with_p(unit: Column, p: Column) -> Column:
        return F.struct(unit["size"].alias("size"), unit["uid"].alias("uid"), unit["copy"].alias("copy"), p.alias("p"))

    def hand_over(winner: Column, loser: Column, words: Column) -> Column:
        """The winner gains ``words``; it is full, or the loser is empty."""
        full = (1.0 - winner["p"]) * winner["size"] <= loser["p"] * loser["size"]
        return F.struct(
            F.when(full, with_p(loser, loser["p"] - words / loser["size"]))
            .otherwise(with_p(winner, winner["p"] + words / winner["size"])).alias("left"),
            F.when(full, settled(winner, 1)).otherwise(settled(loser, 0)).alias("gone"),
        )

    def room(winner: Column, loser: Column) -> Column:
        return F.least((1.0 - winner["p"]) * winner["size"], loser["p"] * loser["size"])

    def meet(state: Column, unit: Column) -> Column:
        held = state["open"]
        up, down = room(held, unit), room(unit, held)
        draw = _draw(level, held["uid"], held["copy"], unit["uid"], unit["copy"])
        result = F.when(draw * (up + down) < down, hand_over(held, unit, up)).otherwise(hand_over(unit, held, down))

        def after(met: Column) -> Column:
            left = met["left"]
            # What is left may be decided too, up to the rounding of doubles.
            high, low = left["p"] > 1.0 - SETTLED, left["p"] < SETTLED
            also = F.when(high, F.array(settled(left, 1))).when(low, F.array(settled(left, 0)))
            return F.struct(
                F.when(high | low, none).otherwise(left).alias("open"),
                F.concat(state["done"], F.array(met["gone"]), F.coalesce(also, F.array().cast(decided))).alias("done"),
            )

        return F.when(
            held.isNull(), F.struct(unit.alias("open"), state["done"].alias("done"))
        ).otherwise(let(result, after))

    return F.aggregate(F.sort_array(units, asc=False), start, meet)


def _fold_last(units: Column) -> Column:
    """The last level of a source: every document decided, large ones first.

    A document meets the rest as one. The rest has ``have`` expected words and room for
    as many more as it has words without; what it gives or takes changes all its
    probabilities in proportion, kept as ``p -> scale * p + shift`` and applied
    when their turn comes.
    """
    zero = F.lit(0.0)
    sums = F.aggregate(
        units, F.struct(zero.alias("have"), zero.alias("words")),
        lambda t, u: F.struct((t["have"] + u["p"] * u["size"]).alias("have"), (t["words"] + u["size"]).alias("words")),
    )
    decided = F.array().cast("array<struct<uid:bigint,copy:bigint,extra:int>>")
    start = let(sums, lambda t: F.struct(
        F.lit(1.0).alias("scale"), zero.alias("shift"), t["have"].alias("have"), t["words"].alias("words"), decided.alias("done")))

    def step(state: Column, unit: Column) -> Column:
        p = F.least(F.lit(1.0), F.greatest(zero, state["scale"] * unit["p"] + state["shift"]))
        rest = F.struct((state["have"] - unit["p"] * unit["size"]).alias("have"), (state["words"] - unit["size"]).alias("words"), p.alias("p"))

        def meet(r: Column) -> Column:
            have = F.greatest(zero, F.least(r["words"], state["scale"] * r["have"] + state["shift"] * r["words"]))
            need, give = (1.0 - r["p"]) * unit["size"], r["p"] * unit["size"]
            up, down = F.least(need, have), F.least(give, r["words"] - have)
            goes_up = _draw(-3, unit["uid"], unit["copy"]) * (up + down) < down
            # The rest keeps this part of its expected words, or of its room.
            keeps = F.when(goes_up, 1.0 - up / have).otherwise(1.0 - down / (r["words"] - have))
            fixed = (r["p"] < SETTLED) | (r["p"] > 1.0 - SETTLED) | (up + down <= 0)
            ends = F.when(fixed, r["p"]).when(goes_up, r["p"] + up / unit["size"]).otherwise(r["p"] - down / unit["size"])
            kept = F.when(fixed, F.lit(1.0)).otherwise(keeps)
            filled = F.when(fixed | goes_up, zero).otherwise(1.0 - keeps)
            done = F.struct(unit["uid"].alias("uid"), unit["copy"].alias("copy"), (ends >= 0.5).cast("int").alias("extra"))
            return F.struct(
                (state["scale"] * kept).alias("scale"), (state["shift"] * kept + filled).alias("shift"),
                r["have"].alias("have"), r["words"].alias("words"), F.concat(state["done"], F.array(done)).alias("done"),
            )

        return let(rest, meet)

    return F.aggregate(F.sort_array(units, asc=False), start, step, lambda s: s["done"])


def _level(units: DataFrame, keys: list[str], level: int) -> DataFrame:
    """One level of the tree: the outcome of each block, written once as two results are read from it."""
    unit = F.struct("size", "uid", "copy", "p").cast(UNIT)
    blocks = units.groupBy(*keys).agg(F.collect_list(unit).alias("units"))
    return stored(blocks.select(*keys, _fold(F.col("units"), level).alias("outcome")), "mix-level")


def _decided(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(F.explode("outcome.done").alias("d")).select("d.*")


def _undecided(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return outcomes.where(F.col("outcome.open").isNotNull()).select(*keys, "outcome.open.*")


def pivotal_rounding(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """``uid, copy, extra`` for each row of ``source, size, uid, copy, p`` with 0 < p < 1.

    ``extra`` is 1 with probability ``p``, else 0; within a source the words of those
    with 1 add up to the sum of ``size * p``, give or take half of a small document.
    """
    empty = units.where(F.col("size") == 0).select(
        "uid", "copy", (_draw(-2, F.col("uid"), F.col("copy")) < F.col("p")).cast("int").alias("extra"))
    units = units.where(F.col("size") > 0).withColumn("magnitude", F.floor(F.log2("size")).cast("int"))
    groups = units.groupBy("source", "magnitude").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    widest = groups.agg(F.max("blocks")).first()[0] or 1
    groups = groups.withColumnsRenamed({"source": "s", "magnitude": "m"})
    placed = units.join(
        groups, units["source"].eqNullSafe(groups["s"]) & (units["magnitude"] == groups["m"])
    ).drop("s", "m").withColumn("block", F.pmod(F.xxhash64("uid", "copy", F.lit(-1)), F.col("blocks")))
    columns = ["source", "size", "uid", "copy", "p"]
    keys = ["source", "magnitude", "block"]
    last = placed.where(F.col("block") == 0).select(*columns)
    placed, chosen, level = placed.where(F.col("block") > 0), empty, 0
    while widest > 1:
        outcomes = _level(placed, keys, level)
        chosen = chosen.unionByName(_decided(outcomes))
        placed = _undecided(outcomes, keys).withColumn("block", F.floor(F.col("block") / block).cast("long"))
        widest, level = -(-widest // block), level + 1
    final = last.unionByName(placed.select(*columns)).groupBy("source").agg(
        F.collect_list(F.struct("size", "uid", "copy", "p").cast(UNIT)).alias("units"))
    return chosen.unionByName(final.select(F.explode(_fold_last(F.col("units"))).alias("d")).select("d.*"))


def _numbered(sizes: DataFrame, split: int = SPLIT) -> DataFrame:
    """``doc_id, source, size`` with ``uid, copy``, which no two rows share.

    Equal rows are counted before they are numbered, so an id that many rows have, or none, is numbered by its different sources
    and sizes; what was counted together is made rows again, more than ``split`` of them in several tasks. Copies of
    rows without an id count downwards, so that they differ from those of any id.
    """
    counted = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)) + 1)
    end = F.col("first") + F.col("rows") - 1
    # Narrow rows, which are read twice.
    counted = stored(counted, "mix-counts")
    part = F.explode(F.sequence(F.col("first"), end, F.lit(split)))
    many = counted.where(F.col("rows") > split).select("*", part.alias("at")).repartition("doc_id", "at").select(
        "doc_id", "source", "size", F.explode(F.sequence("at", F.least(end, F.col("at") + split - 1))).alias("copy"))
    few = counted.where(F.col("rows") <= split).select("doc_id", "source", "size", F.explode(F.sequence("first", end)).alias("copy"))
    return few.unionByName(many).select(
        "doc_id", "source", "size", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("uid"),
        F.when(F.col("doc_id").isNull(), -F.col("copy")).otherwise(F.col("copy")).alias("copy"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``."""
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
    )
    sizes = stored(_numbered(sizes), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share), "mix-targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    renamed = targets.withColumnRenamed("source", "target_source")
    rows = sizes.join(renamed, sizes["source"].eqNullSafe(renamed["target_source"])).drop("target_source")
    near = F.round(wanted)
    rows = rows.withColumn("wanted", F.when(F.abs(wanted - near) < SETTLED, near).otherwise(wanted))
    rows = rows.withColumn("sure", F.floor("wanted").cast("long")).withColumn("p", F.col("wanted") - F.col("sure"))
    chosen = pivotal_rounding(rows.where(F.col("p") > 0).select("source", "size", "uid", "copy", "p"), block)
    copies = F.col("sure") + F.coalesce(F.col("extra"), F.lit(0))
    return rows.join(chosen, ["uid", "copy"], "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"), F.col("copy").alias("same_id"),
    )


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they are."""
    rows = stored(docs.select(
        F.struct("*").alias("row"), "text", "source", F.monotonically_increasing_id().alias("uid")), "mix-rows")
    copies = mix(rows, doc_id="uid").where(F.col("copies") > 0).select(F.col("doc_id").alias("uid"), "copies")
    taken = rows.select("row", "uid").join(copies, "uid")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
