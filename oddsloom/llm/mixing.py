"""Mixing sources to target weights by Pfair scheduling. DataFrame operations only.

Each source's documents are put in an order by a hash and cut into blocks of ``block_chars`` characters. With integer
shares a_i and H = sum of the shares, block j of source i is released at slot floor(j H / a_i) and due by slot
ceil((j + 1) H / a_i); in each slot the earliest deadline among the released blocks goes first. So after any t slots a
source has had within one block of t a_i / H. Windows repeat every H slots, so one round of H slots is scheduled (a
fold over H slots, whatever the size of the data) and block j takes its place in round j div a_i.

No document is dropped or repeated. A source whose blocks end leaves the mix: from the round after its last block on,
the rest is scheduled by its shares among themselves (a phase with its own round). In the last round of a source its
missing slots stay idle. A document larger than a block takes the slots of the blocks that it fills.

Large sources are ranked in parts: rows are dealt to bins by the leading bits of the hash, ranked within a bin, and
moved on by the sums of the bins before; the number of bins follows the number of rows, so one source with most rows
is many small windows. Broadcast are tables of sources and of one round for each phase: (number of sources) x
(``slots`` + number of sources) rows at most.

Null source: a source of its own. Null text: one character long. Null doc_id: first in its bin. Repeated rows: each
has its place. Empty table: no rows. ``shares`` names a source that has no rows: it takes no slot.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled

BIN_ROWS = 1 << 13


EARLIEST = """
    aggregate(
        sequence(0L, slots - 1),
        named_struct('done', transform(active, x -> 0L), 'order', cast(array() as array<struct<i:int,j:bigint>>)),
        (s, t) -> transform(
            array(array_min(transform(active, (x, i) -> named_struct(
                'due', if(s.done[i] < x.share and s.done[i] * slots div x.share <= t,
                          ((s.done[i] + 1) * slots + x.share - 1) div x.share, 9223372036854775807L),
                'i', i)))),
            best -> named_struct(
                'done', transform(s.done, (d, i) -> if(i = best.i, d + 1, d)),
                'order', concat(s.order, array(named_struct('i', best.i, 'j', s.done[best.i])))))[0],
        s -> s.order)
"""


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def placed(docs: DataFrame, block_chars: int) -> DataFrame:
    """doc (the row), src, block, before (characters of the source before the row's)."""
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", _key(F.col("doc.source")).alias("src"), F.col("doc.doc_id").alias("id"),
        (F.length(F.coalesce(F.col("doc.text").cast("string"), F.lit(""))) + 1).cast("long").alias("size"),
        F.xxhash64(F.lit("mix"), "doc.doc_id").alias("chance"))
    bits = max(0, (docs.count() // BIN_ROWS).bit_length())
    rows = rows.withColumn("bin", F.shiftrightunsigned("chance", 64 - bits) if bits else F.lit(0).cast("long"))
    bins = rows.groupBy("src", "bin").agg(F.sum("size").alias("chars"))
    earlier = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("src", "bin", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("start"))
    own = Window.partitionBy("src", "bin").orderBy("chance", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    ranked = ranked.join(bins, ["src", "bin"]).withColumn("before", F.col("start") + F.col("own"))
    return ranked.select("doc", "src", "before", F.expr(f"before div {block_chars}").alias("block"), F.expr(f"(before + size - 1) div {block_chars}").alias("to_block"))


def sources_of(docs: DataFrame, block_chars: int, shares: Mapping[str | None, int] | None, power: float, slots: int) -> DataFrame:
    """One row a source: src, share, blocks, rounds."""
    size = (F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("long")
    found = docs.select(_key(F.col("source")).alias("src"), size.alias("size")).groupBy("src").agg(F.sum("size").alias("chars"))
    found = found.withColumn("blocks", F.expr(f"(chars + {block_chars} - 1) div {block_chars}"))
    if shares is None:
        every = Window.partitionBy(F.lit(0))  # one row a source
        weight = F.pow(F.col("chars").cast("double"), F.lit(power))
        found = found.withColumn("share", F.greatest(F.lit(1), F.round(slots * weight / F.sum(weight).over(every))).cast("long"))
    else:
        pairs = [("-" if s is None else "+" + s, int(n)) for s, n in shares.items()]
        given = docs.sparkSession.createDataFrame(pairs, "src string, share long")
        found = found.join(F.broadcast(given), "src", "left")
        found = found.withColumn("share", F.coalesce("share", F.lit(1).cast("long")))
    found = found.withColumn("rounds", F.expr("(blocks + share - 1) div share"))
    return settled(found.select("src", "share", "blocks", "rounds"), "sources")


def rounds(sources: DataFrame) -> DataFrame:
    """The schedule of one round of each phase: phase_start, src, j, slot, slots, base; a row for each slot."""
    every = sources.agg(F.sort_array(F.collect_list(F.struct("rounds", "src", "share"))).alias("all"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("all", lambda x: x["rounds"]))
    phase = every.select("all", F.explode(F.array_distinct(starts)).alias("phase_start"))
    phase = phase.select("phase_start", F.expr("filter(all, x -> x.rounds > phase_start)").alias("active")).filter("size(active) > 0")
    phase = phase.withColumns({
        "phase_end": F.expr("active[0].rounds"),
        "slots": F.expr("aggregate(active, 0L, (s, x) -> s + x.share)"),
    })
    before = Window.partitionBy(F.lit(0)).orderBy("phase_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each phase
    phase = phase.withColumn("base", F.coalesce(F.sum((F.col("phase_end") - F.col("phase_start")) * F.col("slots")).over(before), F.lit(0)).cast("long"))
    # done[i]: blocks of source i placed so far; the next is open when released, and the earliest deadline goes first
    phase = phase.withColumn("order", F.expr(EARLIEST))
    slot = phase.select("phase_start", "active", "slots", "base", F.posexplode("order").alias("slot", "pick"))
    return slot.select(
        "phase_start", F.expr("active[pick.i].src").alias("src"), F.col("pick.j").alias("j"), F.col("slot").cast("long").alias("slot"), "slots", "base",
        F.expr("pick.j * slots div active[pick.i].share").alias("release"),
        F.expr("((pick.j + 1) * slots + active[pick.i].share - 1) div active[pick.i].share").alias("deadline"))


def mix(docs: DataFrame, shares: Mapping[str | None, int] | None = None, block_chars: int = 1 << 15, power: float = 0.5, slots: int = 1000) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) as ``doc`` with its place: src, share, block, slot, release, deadline (slots of
    the whole schedule) and before (characters of its source before it). Rows by (slot, before) are the mix.

    ``shares`` gives each source's integer share (1 where it is missing); without it a source's share is in proportion
    to its characters to the ``power``, rounded to at least 1 of about ``slots``.
    """
    sources = sources_of(docs, block_chars, shares, power, slots)
    plan = settled(rounds(sources), "rounds")
    every = Window.partitionBy(F.lit(0))  # one row a source
    starts = F.concat(F.array(F.lit(0).cast("long")), F.collect_set("rounds").over(every))
    known = sources.select("src", "share", starts.alias("starts"))
    rows = placed(docs, block_chars).join(F.broadcast(known), "src")
    rows = rows.withColumns({"round": F.expr("block div share"), "j": F.expr("block % share")})
    rows = rows.withColumn("phase_start", F.expr("array_max(filter(starts, x -> x <= round))"))
    rows = rows.join(F.broadcast(plan), ["phase_start", "src", "j"])
    shift = F.col("base") + (F.col("round") - F.col("phase_start")) * F.col("slots")
    return rows.select(
        "doc", F.expr("if(src = '-', null, substring(src, 2))").alias("src"), "share", "block", (shift + F.col("slot")).alias("slot"),
        (shift + F.col("release")).alias("release"), (shift + F.col("deadline")).alias("deadline"), "before")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all of them, in the order of the mix."""
    rows = mix(docs, **options)
    return rows.repartitionByRange("slot", "before").sortWithinPartitions("slot", "before").select("doc.*")


def numbered(written: DataFrame) -> DataFrame:
    """The rows of a Parquet table that ``mixed`` was written to, with ``place``: the row's number in the mix, from 0.

    A reader may take files in any order; their names hold the number of the range partition, and rows keep their
    order within a file. Rows of a file are counted from its footer, and the counts of the files before are broadcast.
    """
    rows = written.select(F.struct("*").alias("doc"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    earlier = Window.partitionBy(F.lit(0)).orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = rows.groupBy("file").agg(F.count("*").alias("rows"))
    files = files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(files), "file").select("doc.*", (F.col("start") + F.col("row")).alias("place"))
