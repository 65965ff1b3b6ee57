"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets.  Sources in code point order (null last) have weights; together they share a budget of
   words in proportion, no source above ``most`` times its own size, the excess reshared by weight.
2. Cells.  A hash deals all documents into shards of about ``shard_words`` words.  A source's documents
   in a shard are a cell, so a shard has cells of all sources that are large enough.  In a cell,
   documents lie end to end in hash order and are cut into blocks of nearly equal words, about
   ``block_words`` each.
3. Quotas.  In each shard, blocks go to the cells by highest quotients v / (2k - 1), where v is the
   number of blocks that a cell's target amounts to: integer quotas per shard.
4. Selection.  A quota of q over B blocks takes each block q div B times, and q mod B of them once
   more, those with the least seeded hashes.  A document takes the words it has in taken blocks.

A cell is bounded whatever a source's share of the rows is, so no task holds a source.  Blocks are drawn
where the documents of their cells are, so nothing that grows with the input is broadcast.  Everything
is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stored, text_or_empty, unit_hash

#: Weights of the sources, in order and repeating.
WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 128
SHARD_WORDS = 1 << 20
#: The share of a source's small table that meets each row is dealt over so many salts.
_SALTS = 32


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: source, source_size, target.

    The sources are few, so they are ordered in one window; its input is one sum per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.select("source", "source_size", weight.alias("w")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # Sources reach their caps in order of cap / weight; level: words per weight once those before are full.
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    done = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = weighed.withColumn("level", (budget - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("w").over(rest))
    free = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return level.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * free, F.col("cap"))).alias("target"))


def _cells(sized: DataFrame, goal: DataFrame, block_words: int, seed: int) -> DataFrame:
    """One row per cell: of (its source's name), at, cell_words, blocks and times, which says how often each block is taken."""
    cells = sized.groupBy("name", "cell").agg(F.sum("size").alias("cell_words")).filter("cell_words > 0")
    joined = cells.join(goal.select("name", "source_size", "target"), "name")
    blocks = F.ceil(F.col("cell_words") / block_words).cast("long")
    # v in millionths of a block: sums of integers don't depend on their order.
    v = F.round(F.col("target") / F.col("source_size") * blocks * 1_000_000).cast("long")
    sized_cells = joined.select("name", "cell", "cell_words", blocks.alias("blocks"), v.alias("v"))
    shard = Window.partitionBy("cell")
    seats = sized_cells.withColumn("n", F.count(F.lit(1)).over(shard)).withColumn("total", F.round(F.sum("v").over(shard) / 1_000_000).cast("long"))
    # The k-th quotient of a cell is among the highest for sure, or not at all, if k is further from v than
    # the number of cells: only those between compete by rank.
    v_blocks = F.col("v") / 1_000_000
    sure = F.greatest(F.lit(0), F.least(2 * F.col("blocks"), F.floor(v_blocks) - F.col("n") - 1)).cast("long")
    last = F.least(2 * F.col("blocks"), F.ceil(v_blocks) + F.col("n") + 1).cast("long")
    seats = seats.withColumn("sure", sure).withColumn("last", last)
    rivals = (
        seats.withColumn("fixed", F.sum("sure").over(shard))
        .filter("last > sure")
        .withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.col("last"))))
        .withColumn("rank", F.row_number().over(shard.orderBy((F.col("v") / (2 * F.col("k") - 1)).desc(), _last_first("name"), "k")))
        .withColumn("won", F.when((F.col("rank") <= F.col("total") - F.col("fixed")) & (F.col("v") > 0), 1).otherwise(0))
    )
    quotas = rivals.groupBy("name", "cell").agg(F.first("cell_words").alias("cell_words"), F.first("blocks").alias("blocks"), (F.first("sure") + F.sum("won")).alias("quota"))
    # The quotas are a few bytes, their blocks' draws are most of the work: a stated number of partitions keeps them apart.
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: unit_hash(seed, F.col("name"), F.col("cell"), j))
    more = (F.col("quota") % F.col("blocks")).cast("int")
    limit = lambda d: F.when(more > 0, F.element_at(F.sort_array(d), F.greatest(more, F.lit(1)))).otherwise(F.lit(-1))
    taken = lambda d, most: F.transform(d, lambda h: (F.floor(F.col("quota") / F.col("blocks")) + F.when(h <= most, 1).otherwise(0)).cast("int"))
    times = _let(draws, lambda d: _let(limit(d), lambda most: taken(d, most)))
    return quotas.repartition(parts, "name", "cell").withColumn("times", times).select(F.col("name").alias("of"), F.col("cell").alias("at"), "cell_words", "blocks", "times")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often and in whatever lambda body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _name(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _last_first(name: str) -> Column:
    """Names in the order of their sources, the null one last."""
    return F.when(F.col(name) != "n", F.col(name)).asc_nulls_last()


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 11,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, spans, and the carried columns.

    spans are (first, last, times) of the document's words by block, words counted from 0, last
    excluded.  A null text has size 0 and takes nothing, as has a source without words.  Rows that
    are repeated are documents of their own.  An empty table gives an empty result; columns other
    than doc_id, text and source are ignored unless they are carried.
    """
    held = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    base = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(text_or_empty()).alias("digest"), *held)
    sized = stored(base.select("doc_id", "source", "size", "digest"))
    shards = F.greatest(F.lit(1), F.floor(F.sum("source_size").over(Window.partitionBy()) / shard_words)).cast("long")
    goal = stored(targets(sized, weights, share, most).select(_name(F.col("source")).alias("name"), "source_size", "target", shards.alias("shards")))
    salted = goal.withColumnRenamed("name", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("h", unit_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).withColumn("name", _name(F.col("source")))
        rows = rows.withColumn("salt", (F.col("h") % _SALTS).cast("int"))
        both = (rows["name"] == salted["of"]) & (rows["salt"] == salted["salt"])
        return rows.join(salted, both).drop("of", "salt").withColumn("cell", F.floor(F.col("h") / _SALTS).cast("long") % F.col("shards"))

    cells = _cells(dealt(sized), goal, block_words, seed)
    lying = Window.partitionBy("name", "cell").orderBy("h", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt(base if carry else sized).withColumn("start", F.coalesce(F.sum("size").over(lying), F.lit(0)))
    found = placed.join(cells.hint("shuffle_merge"), (placed["name"] == cells["of"]) & (placed["cell"] == cells["at"]), "left")
    # Block j covers the words from ceil(j * cell_words / blocks) on.
    begins = lambda j: F.ceil(j * F.col("cell_words") / F.col("blocks")).cast("long")
    end = F.col("start") + F.col("size")
    block_of = lambda word: F.floor(word * F.col("blocks") / F.col("cell_words")).cast("long")
    spans = F.transform(
        F.sequence(block_of(F.col("start")), block_of(end - 1)),
        lambda j: F.struct(
            (F.greatest(F.col("start"), begins(j)) - F.col("start")).alias("first"),
            (F.least(end, begins(j + 1)) - F.col("start")).alias("last"),
            F.get("times", j.cast("int")).alias("times"),
        ),
    )
    spans = F.filter(F.when(F.col("size") > 0, spans), lambda s: s["last"] > s["first"])
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"]) * s["times"])
    return (
        found.withColumn("spans", spans)
        .select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0).cast("long")).alias("taken"), "spans", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: for each pass, the words of a document that the pass takes.

    A document whose blocks are taken once or twice gives one or two rows with its own doc_id.  A
    pass over the whole document keeps its text as it is; otherwise the text has the taken words
    with the white space that follows each.  An integer column n_chars gets the new length.
    """
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = mix(packed, carry=("row",), **settings).filter("taken > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("spans", lambda s: s["times"])))))
    inside = F.filter("spans", lambda s: s["times"] >= F.col("pass"))
    rows = rows.withColumn("inside", inside).withColumn("n", F.aggregate("inside", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"]))
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = _let(pieces, lambda p: F.array_join(F.flatten(F.transform("inside", lambda s: F.slice(p, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), ""))
    rows = rows.withColumn("new", F.when(F.col("n") < F.col("size"), cut).otherwise(F.col("row.text")))
    out = []
    for f in docs.schema.fields:
        if f.name == "text":
            out.append(F.col("new").alias("text"))
        elif f.name == "n_chars":
            out.append(F.length("new").cast(f.dataType).alias("n_chars"))
        else:
            out.append(F.col(f"row.`{f.name}`").alias(f.name))
    return rows.select(*out)
