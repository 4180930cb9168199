"""Mixing sources to target weights along a curriculum that changes over training time.

Every source has a target number of words and a schedule of weights over training time 0..1. The integral of the
schedule up to ``t`` is the source's demand up to ``t``. Documents of a source stand in a shuffled order that reruns
agree on; the words before a document's middle are a demand, and the time at which the schedule reaches that demand is
the document's training position. Demands of second and third copies follow those of all first copies. Copies whose
demand lies beyond the target are not taken. Sorting by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import own_name, word_count
from ledgerlens.operators.ordered import row_index
from ledgerlens.scratch import save
from ledgerlens.skew import broadcast_if_small

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
# weights at the start and the end of training, dealt to the sources in turn like the weights
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SEED = 42
BUCKET_ROWS = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> tuple[DataFrame, int]:
    """(source, source_size, n, place, target) of every source, and how many there are.

    Sources stand in code-point order, null last, and ``weights`` repeat along them. A target is the source's share
    of all words by weight, and at most ``most`` times the source's own; what that leaves over is shared
    again by weight until no target is above its limit: one water level for all.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per_source = save(per_source.withColumn("_last", F.col("source").isNull()), "sources")
    count = per_source.count()
    placed = row_index(per_source, ["_last", "source"], "place", rows=count)
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = save(placed.drop("_last").withColumn("weight", dealt).withColumn("cap", F.col("source_size") * most), "sources")
    total, weight = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    level, full = total / weight, -1
    while True:  # the level only rises; each round fills at least one more source
        now, used, taken = placed.where(F.col("cap") < F.lit(level) * F.col("weight")).agg(
            F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if now == full or taken == weight:
            break
        full, level = now, (total - used) / (weight - taken)
    target = F.least(F.lit(float(level)) * F.col("weight"), F.col("cap").cast("double"))
    return placed.select("source", "source_size", "n", "place", target.alias("target")), count


def position(demand: Column, start: Column, end: Column) -> Column:
    """The time at which a weight that goes straight from ``start`` to ``end`` has met a share ``demand`` of its integral.

    The share met at ``t`` is ``t + a (t - t^2)`` with ``a = (start - end) / (start + end)``.
    """
    a = (start - end) / (start + end)
    return 2 * demand / (1 + a + F.sqrt((1 + a) * (1 + a) - 4 * a * demand))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES,
    schedules: tuple[tuple[float, float], ...] = SCHEDULES, seed: int = SEED, keep: list[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` with ``mix``: a struct of size, source_size, target, copies, taken and positions.

    ``docs`` needs doc_id, text and source. Its columns stay, or only those in ``keep``, which spares the shuffle the texts; if
    one of them is called ``mix`` the struct gets underscores in front. A null text has size 0. A null source is a source of its own. Rows with a
    null or repeated doc_id are documents of their own; equal rows may change places. Documents without words are
    never taken. An empty table gives an empty one. Every source's taken words differ from its target by no more
    than half of one document.
    """
    own = own_name(docs, "mix")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    # a document travels as one struct, so none of its columns can clash
    rows = docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("doc"), "doc_id", "source", word_count("text").alias("size"), key.alias("key"))
    place = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
    sizes = save(docs.select("source", word_count("text").alias("size"), place(key).alias("place")), "sizes")
    sources, count = targets(sizes, weights, most)
    start = F.array(*[F.lit(float(s)) for s, _ in schedules])
    end = F.array(*[F.lit(float(e)) for _, e in schedules])
    turn = (F.col("place") % len(schedules) + 1).cast("int")
    sources = sources.select(
        F.col("source").alias("_source"),
        F.struct(
            "source_size", "target", F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).alias("buckets"),
            F.element_at(start, turn).alias("start"), F.element_at(end, turn).alias("end")).alias("_about"))
    # a large source is cut into many buckets of the shuffled order
    rows = rows.join(broadcast_if_small(sources, count), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = rows.withColumn("_bucket", F.floor(place(F.col("key")) * F.col("_about.buckets") / F.lit(2**32)))
    per_bucket = sizes.join(broadcast_if_small(sources, count), F.col("source").eqNullSafe(F.col("_source")), "left").groupBy(
        "source", F.floor(F.col("place") * F.col("_about.buckets") / F.lit(2**32)).alias("bucket")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = save(per_bucket.select(
        F.col("source").alias("_source"), F.col("bucket").alias("_b"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_offset")), "buckets")
    rows = rows.join(
        broadcast_if_small(per_bucket, per_bucket.count()),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")), "left").drop("_source", "_b")
    inside = Window.partitionBy("source", "_bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    size, about = F.col("size"), F.col("_about")
    rows = rows.withColumn("_before", F.col("_offset") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    demands = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda c: (2 * (c * about["source_size"] + F.col("_before")) + size) / (F.lit(2.0) * about["target"]))
    demands = F.when((size > 0) & (about["target"] > 0), F.filter(demands, lambda y: y <= 1)).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("_demands", demands)
    copies = F.size("_demands").cast("long")
    return rows.select("doc.*", F.struct(
        size.alias("size"), about["source_size"].alias("source_size"), about["target"].alias("target"),
        copies.alias("copies"), (copies * size).alias("taken"),
        F.transform("_demands", lambda y: position(y, about["start"], about["end"])).alias("positions"),
    ).alias(own))


def training_order(mixed: DataFrame, own: str = "mix") -> DataFrame:
    """Rows of :func:`mix` with ``orders``: the numbers, from 0, of a row's copies in training order.

    All copies are sorted by position, then doc_id (null last), in ranges; a row that is not taken has none. Call it on
    narrow rows: they are written once.
    """
    rows = save(mixed.withColumn("_row", F.monotonically_increasing_id()), "mixed")
    copies = rows.select("_row", "doc_id", F.explode(f"{own}.positions").alias("_at"))
    numbered = row_index(copies, ["_at", "doc_id", "_row"], "_order")
    orders = numbered.groupBy("_row").agg(F.sort_array(F.collect_list("_order")).alias("orders"))
    none = F.array().cast("array<bigint>")
    return rows.join(orders, "_row", "left").select(*mixed.columns, F.coalesce("orders", none).alias("orders"))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as training takes them, copies repeated, sorted by ``position``, the training time (0 to 1).

    A column of ``docs`` with that name keeps it; the new one then gets underscores in front.
    """
    own, at = own_name(docs, "mix"), own_name(docs, "position")
    mixed = mix(docs, **options)
    return mixed.select(*docs.columns, F.explode(f"{own}.positions").alias(at)).orderBy(at, "doc_id")
