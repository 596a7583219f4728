"""Mix sources to target weights, to the word.

Every document gets a hash-random key; sorted by it, the documents of a source form a line
of words. The mix takes the line whole as often as the source's target allows (epochs),
and then up to the exact word. Prefix sums are distributed: the key range of a source is
cut into cells, cells are summed (with partial sums before the shuffle), and only inside a
cell rows are sorted, so a source with a third of all rows is many tasks. Rows that agree in
id, source and size (as rows without an id often do) are one row with a count there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Keys are 60-bit numbers; this many leading bits name a cell.
KEY_BITS = 60


def random_key(seed: int, id_column: str) -> Column:
    """60 random bits from the id: the first 15 hex digits of an MD5 (null ids share one key)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Words to take from each source, from ``(source, source_size)``.

    The budget is the sum of all sizes, shared by weight. A source that would get more than
    ``most`` times its size gets exactly that, and the rest share the excess by weight. In
    order of size over weight, the sources at their bound are a prefix, so one pass over one
    row per source finds the level at which the others stand.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    ranked = sizes.select("source", "source_size", weight.cast("long").alias("weight"), rank.alias("rank"))
    fullness = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    below = fullness.rowsBetween(Window.unboundedPreceding, -1)
    onward = fullness.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = fullness.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(most * F.sum("source_size").over(below), F.lit(0))) / F.sum(
        "weight"
    ).over(onward)
    bound = (most * F.col("source_size")).cast("double")
    levels = ranked.select("source", "source_size", "weight", "rank", level.alias("level"), bound.alias("bound"))
    # the first source in this order that the level does not lift above its bound sets the level of all after it
    free = F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level"))
    set_level = F.first(free, ignorenulls=True).over(fullness.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return levels.select(
        "source", "source_size", F.least(set_level * F.col("weight"), F.col("bound")).alias("target")
    )


def counted_cells(sized: DataFrame, cell_rows: int) -> DataFrame:
    """Different rows of ``(source, key, id, size)`` with their number ``n`` and their ``cell``.

    Cells are a fixed share of the key range: about ``cell_rows`` rows in a source that had
    all rows.
    """
    bits = max(1, (sized.count() // cell_rows).bit_length())
    counted = sized.groupBy("source", "key", "id", "size").agg(F.count("*").alias("n"))
    return counted.withColumn("cell", F.shiftright("key", KEY_BITS - bits))


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 11,
    cell_rows: int = 1_000, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS,
) -> DataFrame:
    """``id, source, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` is the number of words the mix takes from the row, repeats counted: the whole
    text once per full epoch, and in the last epoch what lies before the source's budget
    (its target rounded to a word). Rows of equal id are ordered by size; rows that agree in
    both are interchangeable. Null texts and texts without words have size 0 and give
    nothing, a null source is a source of its own, and an empty table gives an empty mix.
    """
    sized = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            word_count(text_column).alias("size"),
            random_key(seed, id_column).alias("key"),
        ),
        "sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    cells = counted_cells(sized, cell_rows)
    line = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cells.groupBy("source", "cell")
        .agg(F.sum(F.col("size") * F.col("n")).alias("cell_size"))
        .select("source", "cell", F.coalesce(F.sum("cell_size").over(line), F.lit(0)).alias("cell_start"))
    )
    inside = Window.partitionBy("source", "cell").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("place", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    budget = F.round("target").cast("long")
    epochs = F.expr("budget div greatest(source_size, 1)")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    left = rest - F.col("cell_start") - F.col("place") - F.col("copy") * F.col("size")
    return (
        placed.alias("p")
        .join(starts.alias("s"), F.expr("p.source <=> s.source and p.cell = s.cell"))
        .select("p.*", "s.cell_start")
        .alias("p")
        .join(targets.alias("t"), F.expr("p.source <=> t.source"))
        .select("p.*", "t.source_size", "t.target")
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.least(F.greatest(left, F.lit(0)), F.col("size")))
        .select("id", "source", "size", "source_size", "target", "taken")
    )


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options
) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with the columns of ``docs``.

    Documents are not cut: the last one of a source's line comes if at least half of its
    words lie within the budget, so a source is within half a document of its target.
    Documents without words are not part of a mix. Rows that agree in id, source and size are
    told apart by their order.
    """
    key = lambda *columns: F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    taken = mix(docs, id_column, text_column, source_column, **options).filter("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    wanted = taken.select(key("id", "source", "size").alias("mix key"), copies.alias("copies")).withColumn(
        "mix number", F.row_number().over(Window.partitionBy("mix key").orderBy(F.desc("copies")))
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        key(
            F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(text_column).alias("size")
        ).alias("mix key"),
        F.xxhash64(text_column).alias("text hash"),
    )
    order = Window.partitionBy("mix key").orderBy("text hash")
    return (
        rows.withColumn("mix number", F.row_number().over(order))
        .join(wanted.filter("copies > 0"), ["mix key", "mix number"])
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row.*")
    )
