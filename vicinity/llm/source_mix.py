"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Slot ``n`` of the schedule has the golden-ratio point frac(n * phi), in whole numbers of 2**-32.
The unit interval is cut by the sources' shares of the blocks, so a point names a source, and a
source's k-th slot takes the k-th block of ``block_words`` words of its stream: its documents in
a hash-shuffled order, twice over. Points leave a source a few blocks short or over at most; the
over ones are dropped and the missing ones stand at the schedule's end, so each source gives
exactly the blocks that its target needs, the last one in part.

Ranks and running sums are taken within bounded chunks, with a prefix sum over the chunks'
totals, so a source that holds most rows doesn't end up in one task.

Null texts have size 0; a null source is a source of its own, last in order. Documents of size 0
are returned with nothing taken. Repeated rows count one by one; equal hashes (ties) go by doc_id, then row. Texts are
counted whole, however long. Of an empty table nothing comes out. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.llm.shared import cut, small

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 1024
DOCS_A_CHUNK = 20_000
SLOTS_A_CHUNK = 1 << 16
GOLDEN = 2654435769  # 2**32 / phi
CELL_BITS = 22
SOURCES_TO_BROADCAST = 100_000


def word_count(text):
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(uid, doc_id, source, size, key): a row of its own for each document, with its place in the shuffled order."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()))


def targets(rows: DataFrame, *, weights=WEIGHTS, total: float = TOTAL, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a source: its size, weight, target, words to take and blocks to take.

    Shares of ``total`` times all words by weight; a target stops at ``max_epochs`` times its source's
    size, and the excess goes to the others by weight until none is above.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("sid", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    whole, filling = Window.partitionBy(), Window.orderBy("level", "sid")
    by = by.withColumn("fair", (F.sum("source_size").over(whole) * F.lit(float(total)) - (F.sum("cap").over(filling) - F.col("cap"))) / (F.sum("weight").over(whole) - (F.sum("weight").over(filling) - F.col("weight"))))
    first_open = F.first(F.when(F.col("level") > F.col("fair"), F.col("fair")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("fill", first_open)
    by = by.withColumn("target", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fill") * F.col("weight"))))
    by = by.withColumn("limit", F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs))
    return by.withColumn("need", F.ceil(F.col("limit") / block_words).cast("long")).select("sid", "source", "source_size", "weight", "target", "limit", "need")


def schedule(sources: DataFrame, slots: int, *, slots_a_chunk: int = SLOTS_A_CHUNK) -> DataFrame:
    """(slot, sid, block): which block of which source stands at which place; ``slots`` is the sum of ``need``."""
    spark = sources.sparkSession
    before = F.sum("need").over(Window.orderBy("sid")) - F.col("need")
    edge = lambda x: F.floor(x.cast("double") / F.lit(float(max(slots, 1))) * F.lit(float(1 << 32))).cast("long")
    spans = sources.where("need > 0").withColumn("before", before).withColumn("low", edge(F.col("before"))).withColumn("high", edge(F.col("before") + F.col("need")))
    cells = spans.where("high > low").withColumn("cell", F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS)))).select("sid", "low", "high", "cell")
    n = F.col("slot").bitwiseAND(F.lit((1 << 32) - 1))
    point = F.pmod(n.bitwiseAND(F.lit(65535)) * GOLDEN + F.pmod(F.shiftright(n, 16) * GOLDEN, F.lit(65536)) * 65536, F.lit(1 << 32))
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.shiftright("point", CELL_BITS))
    placed = points.join(cells, "cell").where("point >= low and point < high").select("slot", "sid", F.floor(F.col("slot") / slots_a_chunk).alias("chunk"))
    counts = placed.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = placed.join(offsets, ["sid", "chunk"]).withColumn("block", F.col("offset") + rank)
    kept = ranked.join(small(sources.select("sid", "need"), SOURCES_TO_BROADCAST), "sid").where("block < need").select("slot", "sid", "block")
    short = sources.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    tail = short.withColumn("block", F.explode(F.sequence(F.col("got"), F.col("need") - 1))).withColumn("slot", F.lit(slots) + F.row_number().over(Window.orderBy("block", "sid")) - 1)
    return kept.unionByName(tail.select("slot", "sid", "block"))


def mix(rows: DataFrame, sources: DataFrame, *, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, docs_a_chunk: int = DOCS_A_CHUNK, slots_a_chunk: int = SLOTS_A_CHUNK) -> DataFrame:
    """(uid, doc_id, sid, slot, epoch, from_word, n_words): the mix, piece by piece; order it by slot and from_word."""
    total = sources.agg(F.sum("need").alias("slots")).first()
    chunks = max(1, -(-rows.count() // docs_a_chunk))
    known = small(sources, SOURCES_TO_BROADCAST)
    docs = rows.where("size > 0").join(known.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("chunk", F.pmod("key", F.lit(chunks)))
    sums = docs.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    offsets = sums.withColumn("offset", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).drop("n")
    run = F.sum("size").over(Window.partitionBy("sid", "chunk").orderBy("key", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    docs = docs.join(offsets, ["sid", "chunk"]).withColumn("start", F.col("offset") + run - F.col("size"))
    docs = docs.withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(max_epochs)]))).withColumn("start", F.col("start") + F.col("epoch") * F.col("source_size"))
    docs = docs.where("start < limit").withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("limit")))
    cut_at = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("stop") - 1) / block_words))
    pieces = docs.withColumn("block", F.explode(cut_at))
    low, high = F.greatest("start", F.col("block") * block_words), F.least("stop", (F.col("block") + 1) * block_words)
    pieces = pieces.select("uid", "doc_id", "sid", "epoch", "block", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"))
    return pieces.join(schedule(sources, int(total.slots or 0), slots_a_chunk=slots_a_chunk), ["sid", "block"]).select("uid", "doc_id", "sid", "slot", "epoch", "from_word", "n_words")


def mix_by_document(docs: DataFrame, **options) -> DataFrame:
    """Every row's doc_id, source, size, its source's size and target, and the words the mix takes of it.

    Of the schedule: the first and last slot that holds words of the row (null if none does), and how many do.
    """
    rows = sized(docs)
    sources = cut(targets(rows, **{k: v for k, v in options.items() if k in ("max_epochs", "block_words")}))
    nothing = rows.select("uid", "doc_id", "source", "size", F.lit(0).cast("long").alias("n_words"))
    taken = mix(rows, sources, **options).select("uid", "n_words", "slot")
    taken = nothing.unionByName(taken, allowMissingColumns=True).groupBy("uid").agg(*[F.max(c).alias(c) for c in ("doc_id", "source", "size")], F.sum("n_words").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"))
    known = small(sources.select(F.col("source").alias("of"), "source_size", "target"), SOURCES_TO_BROADCAST)
    return taken.join(known, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "last_slot", "n_slots")
