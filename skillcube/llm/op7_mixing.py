"""Mixing sources to target weights, in DataFrame functions only.

The documents of a source form one stream of words, cut into blocks of BLOCK_WORDS. A source's target
says how many of its words the mix takes: whole epochs of all blocks, then as many blocks of a further
epoch as are missing, the last one cut to fit. `draws` throws these blocks onto the output shards, each
shard as likely as another: a source's counts over the shards are multinomial with the total that
its target wants, so for a shard's size its counts of the sources are too, by target weights. A shard's slots
are (source, number within the source's draws), in an order that a permutation of the shard gives.
A slot finds its block by a pseudorandom permutation of the source's block numbers, one for each
source and epoch (swap-or-not rounds, which permute any number of blocks as it is), and blocks are
joined by number. All draws are hashes of a seed and of fixed numbers, and a stream's order is fixed by
ids and texts: reruns agree, however the rows are dealt out.

Sources count by code point, null last, and an empty table gives no rows. Null, empty and blank texts
have size 0 and are never taken. Rows with equal ids are documents of their own, in order of a hash of the text; rows
equal in both are alike, so it doesn't matter which of them comes first. Very long texts lie in many blocks. Extra
columns, whatever their names, are carried (`mixed_documents`) or left aside. A source's stream is put in
order by hash buckets, so no window holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_WORD, shuffle_partitions, table, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS, SHARD_WORDS, SEED = 256, 1_000_000, 20240229
ROUNDS = 24
SLOTS_PER_ROW, ROWS_PER_BUCKET, BROADCAST_ROWS = 2_000, 5_000, 100_000


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast while it has few rows (counted); else the engine's own join, with its skew handling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_rank, source_size, target (double) from rows (source, size).

    Weights share SHARE of all words; a source stops at MOST times its size and what is left goes to
    the others by weight, until none is above: with sources in order of MOST * size / weight those that
    stop come first, and one level per weight holds for the rest.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("source_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_rank") % len(WEIGHTS)) + 1))
    by = by.withColumn("cap", F.col("source_size") * F.lit(MOST))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    by = by.withColumn("level", (total * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    rest = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "source_rank", "level"))).over(Window.partitionBy())
    return by.select("source", "source_rank", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(rest["level"] * F.col("weight")).alias("target"))


def permuted(x: Column, n: Column, key: list[Column]) -> Column:
    """x's place in a pseudorandom permutation of 0 to n - 1, by ROUNDS swap-or-not rounds."""

    def swap(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - acc, n)
        return F.when(F.xxhash64(*key, r, F.greatest(acc, other)) % 2 == 0, other).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x, swap)


def draws(by_source: DataFrame, shards: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source_rank, shard, n (blocks of the source that the shard takes), base (those that earlier shards take)."""
    size, n = F.col("source_size"), F.lit(block_words)
    want = F.least(F.round("target").cast("long"), (size * F.lit(MOST)).cast("long"))
    s = by_source.where("source_size > 0").select("source_rank", size.alias("size"), want.alias("want"))
    s = s.withColumn("epochs", F.expr("want div size")).withColumn("left", F.expr("want % size"))
    s = s.withColumn("full", F.floor(F.col("size") / n)).withColumn("blocks", F.ceil(F.col("size") / n))
    s = s.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("left") / n)).where("slots > 0")
    lot = s.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOTS_PER_ROW).cast("long"))))
    lot = lot.select("source_rank", "slots", "lo").repartition(shuffle_partitions(by_source.sparkSession), "source_rank", "lo")  # few bytes now, many rows next
    lot = lot.select("source_rank", F.explode(F.sequence("lo", F.least(F.col("lo") + SLOTS_PER_ROW, F.col("slots")) - 1)).alias("x"))
    shard = F.pmod(F.xxhash64(F.lit(SEED + 1), "source_rank", "x"), F.lit(shards)).cast("int")
    counts = lot.groupBy("source_rank", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return counts.join(_small(s.drop("slots")), "source_rank")


def slots(drawn: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per slot: shard, position, source_rank, epoch, block, take (words, from the block's start)."""
    n, tasks = F.lit(block_words), shuffle_partitions(drawn.sparkSession)
    inside = Window.partitionBy("shard").orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    s = drawn.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("shard_slots", F.sum("n").over(Window.partitionBy("shard")))
    s = s.repartition(tasks, "source_rank", "shard")  # few bytes now, many rows next
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    s = s.withColumn("position", permuted(F.col("first") + F.col("i"), F.col("shard_slots"), [F.lit(SEED + 2), F.col("shard")]))
    s = s.withColumn("slot", F.col("base") + F.col("i"))
    s = s.withColumn("epoch", F.least(F.expr("slot div blocks"), F.col("epochs"))).withColumn("j", F.col("slot") - F.col("epoch") * F.col("blocks"))
    block = F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.col("full"), [F.lit(SEED), F.col("source_rank"), F.col("epoch")])).otherwise(F.col("j"))
    has = F.when(F.col("j") < F.col("full"), n.cast("long")).otherwise(F.col("size") - F.col("full") * n)
    take = F.when(F.col("epoch") < F.col("epochs"), has).otherwise(F.least(has, F.col("left") - F.col("j") * n))
    return s.select("shard", "position", "source_rank", "epoch", block.alias("block"), take.alias("take"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(ASCII_WORD)), F.lit(0)).cast("long"))


def placed(sizes: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds source_rank and start: the words of the source before the row, in order of (hash bucket, doc_id, hash of the text)."""
    sizes = sizes.where("size > 0")
    buckets = max(1, sizes.count() // ROWS_PER_BUCKET)
    ranks = _small(by_source.select(F.col("source").alias("s"), "source_rank"))
    rows = sizes.join(ranks, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    sums = rows.groupBy("source_rank", "bucket").agg(F.sum("size").alias("words"))
    base = F.coalesce(F.sum("words").over(Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source_rank").alias("r"), F.col("bucket").alias("b"), base.alias("base"))
    before = F.sum("size").over(Window.partitionBy("source_rank", "bucket").orderBy("doc_id", "h", "rid").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(before, F.lit(0)))
    return rows.join(_small(sums), (F.col("source_rank") == F.col("r")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("base") + F.col("within")).drop("r", "b", "base", "within", "bucket")


def takes(rows: DataFrame, slot_rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rid, shard, position, epoch, first (word of the document, from 0), words: what each slot takes of each document."""
    n = block_words
    parts = rows.select("rid", "source_rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n))).alias("block"))
    lo, hi = F.greatest(F.col("start"), F.col("block") * n), F.least(F.col("start") + F.col("size"), F.col("block") * n + F.col("take"))
    joined = parts.join(slot_rows.hint("merge"), ["source_rank", "block"])  # both sides grow with the words
    return joined.where(hi > lo).select("rid", "shard", "position", "epoch", (lo - F.col("start")).alias("first"), (hi - lo).alias("words"))


def plan(docs: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with rid and size, and with `whole` all columns as the struct doc; sources with targets; takes)."""
    doc = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    base = sized(docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string"), *doc)).withColumn("h", F.xxhash64("text")).drop("text")
    numbered = written(base.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    by_source = written(targets(numbered), "mix-targets")
    shards = max(1, int((by_source.agg(F.sum("target")).first()[0] or 0) // SHARD_WORDS))
    rows = placed(numbered.select("doc_id", "source", "size", "h", "rid"), by_source)
    return numbered, by_source, takes(rows, slots(draws(by_source, shards)))


def mixed_documents(docs: DataFrame, by_shard: bool = False) -> DataFrame:
    """The mix as documents, all columns kept: a row per document and epoch with the words taken.

    With `by_shard` a row per (_shard, document, epoch), with _shard and _position (the row's first slot) before the columns
    of docs. A document that is taken whole keeps its text as it is; else the taken words are joined by spaces.
    """
    numbered, _, taken = plan(docs, whole=True)
    keys = ["rid", "epoch", *(["shard"] if by_shard else [])]
    runs = taken.groupBy(*keys).agg(F.sum("words").alias("taken"), F.min("position").alias("position"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("runs"))
    words = F.regexp_extract_all("doc.text", F.lit(f"({ASCII_WORD})"))
    some = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, (r.first + 1).cast("int"), r.words.cast("int")))), " ")
    out = numbered.join(runs, "rid").withColumn("text", F.when(F.col("taken") == F.col("size"), F.col("doc.text")).otherwise(some))
    doc = F.col("doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.char_length("text").cast("long"))
    if by_shard:
        return out.select(F.col("shard").alias("_shard"), F.col("position").alias("_position"), doc.alias("doc")).select("_shard", "_position", "doc.*")
    return out.select(doc.alias("doc")).select("doc.*")


def write_mix(docs: DataFrame, folder: str) -> None:
    """Writes the output shards: folder/_shard=<number>, each in order of its slots."""
    rows = mixed_documents(docs, by_shard=True)
    rows.repartition(shuffle_partitions(docs.sparkSession), "_shard").sortWithinPartitions("_shard", "_position", "doc_id").write.partitionBy("_shard").parquet(folder)


def mixed_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (the words that each output shard takes, in order) for each row of docs."""
    numbered, by_source, taken = plan(docs)
    per = taken.groupBy("rid", "shard").agg(F.sum("words").alias("words")).groupBy("rid").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    src = by_source.select(F.col("source").alias("s"), "source_size", "target")
    out = numbered.join(per, "rid", "left").join(_small(src), F.col("source").eqNullSafe(F.col("s")))
    none = F.array().cast("array<struct<shard:int,words:bigint>>")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def query(spark, sf_dir):
    return mixed_counts(table(spark, sf_dir, "documents"))
