"""Interleaving of sources at target weights by Pfair scheduling, in DataFrame and SQL functions only.

A source's documents, in the order of md5(doc_id), form blocks of ``block_chars`` characters. A source s
with a_s of the H parts of all sources has weight w = a_s / H. Its block i may not run before slot floor(i / w)
(release) and must have run by slot ceil((i + 1) / w) (deadline). Earliest deadline first among the released
blocks meets all deadlines, so after any number of slots each source has run its weighted share of
blocks to within less than one block. Releases and deadlines repeat every H slots (a round), so one round
is scheduled, and every block's slot follows from its number: round i div a_s, place i mod a_s. All parts add up to H, so no
slot is idle, and between one release and the next the blocks that are ready run in the order of their deadlines: a fold
over the round's different releases, of which there are no more than the different parts have in all, whatever the number of sources.
When a source's blocks end, the following rounds are of the sources that are
left, with their parts: at most one schedule for each number of rounds at which some source ends. No
document is dropped or repeated. The schedules of all phases have no more entries than the sources' rounds have slots; one
round's slots, at least one for each source, are an array of one task.

Block numbers are running sums of characters within a source. A source may hold most rows, so they are
taken within (source, first hex digits of the md5), of bounded size, plus the sums of the buckets before. Rows without a doc_id, whose
md5 is one, are divided by the digits of their text's hash.
A document longer than a block uses up the blocks it spans; it stands where its first one does.

Nulls, empties, repeats: a null source is a source of its own, with the default part, as is the empty
one. A null text counts as empty and is kept; an empty one takes up one
character. Rows with equal doc_id come in the order of their text's hash; a null doc_id has the md5 of the
empty string. An empty table gives no row. Columns named like the result's are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpanel.llm import shared

#: The md5 of the empty string.
NO_ID = "d41d8cd98f00b204e9800998ecf8427e"
#: Rows of a bucket of a source, about.
BUCKET_ROWS = 2_000

#: Rows that meet one place of a source's schedule in one task, about.
PLACE_ROWS = 100_000
#: A schedule of up to so many entries is broadcast; larger ones are joined by a shuffle.
BROADCAST_ENTRIES = 65_536

#: One round: a fold over its releases. ready: released blocks, by deadline, then source; run: those run between one release and the next.
_ROUND = """
aggregate(
  sequence(0, size(events) - 1),
  named_struct('ready', filter(events[0].blocks, b -> false), 'run', filter(array(events[0].blocks), b -> false)),
  (acc, k) -> transform(array(sort_array(concat(acc.ready, events[k].blocks))),
    ready -> transform(array(cast(coalesce(get(events, k + 1).release, H) - events[k].release as int)),
      gap -> named_struct('ready', slice(ready, gap + 1, size(ready)), 'run', concat(acc.run, array(slice(ready, 1, gap))))))[0][0],
  acc -> flatten(acc.run))
"""
#: The phase that holds a round: binary search in an array sorted by begin.
_PHASE = """
phases[aggregate(
  sequence(0, cast(log2(size(phases)) as int)),
  named_struct('lo', 0, 'hi', size(phases)),
  (acc, k) -> transform(array(cast((acc.lo + acc.hi) div 2 as int)),
    mid -> if(phases[mid].begin <= round, named_struct('lo', mid, 'hi', acc.hi), named_struct('lo', acc.lo, 'hi', mid)))[0],
  acc -> acc.lo)]
"""


def interleave(docs: DataFrame, parts: dict[str, int] | None = None, default_part: int = 1, block_chars: int = 65536, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with block, round and slot (of the document's first block: 0, 1, 2, ...) and rank (the
    document's place within its block, in characters).

    ``keep`` names the columns of ``docs`` to carry along (else all): texts that are not wanted need not move.
    ``parts`` are the target weights of sources as whole numbers; other sources have ``default_part``.
    """
    if block_chars < 1 or default_part < 1 or any(a < 1 for a in (parts or {}).values()):
        raise ValueError("block sizes and parts are at least 1")
    spark = docs.sparkSession
    names = ("block", "round", "slot", "rank")
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    chars = F.greatest(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)), F.lit(1)).cast("long")
    source = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    # all columns as one, whose names meet no inner ones
    rows = docs.select(F.struct(*own).alias("_row"), F.col("doc_id").alias("_id"), source.alias("_source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_md5"), chars.alias("_chars"), F.xxhash64(F.col("text").cast("string")).alias("_tie"))
    total = docs.count()
    digits = min(7, max(1, math.ceil(math.log(max(total / BUCKET_ROWS, 1), 16))))
    # buckets in the order (md5, hash): rows without an id have one md5, and buckets of their own between those of smaller and larger ones
    tie = F.lpad(F.hex(F.col("_tie").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    side = F.when(F.col("_id").isNull(), F.concat(F.lit("1"), F.substring(F.coalesce(tie, F.lit("")), 1, digits))).when(F.col("_md5") < NO_ID, "0").otherwise("2")
    rows = rows.withColumn("_bucket", F.concat(F.substring("_md5", 1, digits), side))

    # characters before each bucket of a source, and tasks that a place of its schedule is dealt to
    given = F.create_map(*[x for s, a in (parts or {}).items() for x in (F.lit("+" + s), F.lit(a))]) if parts else None
    part = (F.coalesce(given[F.col("_source")], F.lit(default_part)) if parts else F.lit(default_part)).cast("int")
    salts = F.greatest(F.ceil(F.col("copies") / (part.cast("long") * PLACE_ROWS)), F.lit(1)).cast("int")
    sums = shared.written(rows.groupBy("_source", "_bucket").agg(F.sum("_chars").alias("chars"), F.count(F.lit(1)).alias("n")), "mixing-buckets", rows=total // 50)
    of_source = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_source", "_bucket", F.coalesce(F.sum("chars").over(of_source), F.lit(0)).alias("_before"), F.sum("n").over(Window.partitionBy("_source")).alias("copies"))
    offsets = offsets.select("_source", "_bucket", "_before", salts.alias("_salts"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_md5", "_id", "_tie")
    placed = rows.join(offsets, ["_source", "_bucket"])
    placed = placed.withColumn("_at", F.col("_before") + F.sum("_chars").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_chars"))
    placed = placed.withColumn("block", F.expr(f"_at div {block_chars}L"))

    # sources, their parts and rounds
    sources = sums.groupBy("_source").agg(F.sum("chars").alias("chars"), F.sum("n").alias("copies")).withColumn("part", part)
    sources = sources.withColumn("rounds", F.expr(f"greatest(1L, ((chars - 1L) div {block_chars}L + part) div part)"))
    sources = shared.written(sources.select("_source", "part", "rounds", salts.alias("salts")), "mixing-sources", rows=total // 50)

    # a phase: the rounds between two numbers of rounds at which some source ends. Of B blocks in all there are at most sqrt(2 B) phases
    ends = sources.select(F.col("rounds").alias("end")).distinct()
    by_end = Window.orderBy("end")
    phases = ends.select("end", F.coalesce(F.lag("end").over(by_end), F.lit(0)).alias("begin"))
    active = sources.join(F.broadcast(phases), F.col("rounds") >= F.col("end"))
    before = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    heads = active.groupBy("begin", "end").agg(F.sum("part").alias("H"))
    heads = heads.select("begin", "H", F.coalesce(F.sum(F.expr("H * (end - begin)")).over(before), F.lit(0)).alias("base"))
    blocks = active.join(F.broadcast(heads), "begin").select("begin", "base", "H", "_source", "part", "salts", F.explode(F.expr("sequence(0, part - 1)")).alias("place"))
    block = F.struct(F.expr("((place + 1) * H + part - 1) div part").alias("deadline"), "_source", "place", "salts")
    events = blocks.groupBy("begin", "base", "H", F.expr("place * H div part").alias("release")).agg(F.collect_list(block).alias("blocks"))
    events = events.groupBy("begin", "base", "H").agg(F.sort_array(F.collect_list(F.struct("release", "blocks"))).alias("events"))
    slots = events.select("begin", "base", "H", F.posexplode(F.expr(_ROUND)).alias("in_round", "b"))
    # a source's schedules by (source, place): at most one for each phase, and in all no more than there are blocks
    schedule = slots.groupBy("b._source", "b.place", "b.salts").agg(F.sort_array(F.collect_list(F.struct("begin", "base", "H", "in_round"))).alias("phases"))
    schedule = shared.written(schedule, "mixing-schedule", rows=total // 50)
    entries = schedule.agg(F.sum(F.size("phases") * F.col("salts").cast("long"))).first()[0] or 0

    out = placed.withColumn("_part", part).withColumns({"round": F.expr("block div _part"), "_place": F.expr("block % _part"), "_salt": F.expr("pmod(xxhash64(_md5, _tie), _salts)")})
    dealt = schedule.select(F.col("_source").alias("_s"), F.col("place").alias("_p"), F.explode(F.expr("sequence(0L, salts - 1L)")).alias("_n"), "phases")
    dealt = F.broadcast(dealt) if entries <= BROADCAST_ENTRIES else dealt
    out = out.join(dealt, (F.col("_source") == F.col("_s")) & (F.col("_place") == F.col("_p")) & (F.col("_salt") == F.col("_n")))
    out = out.withColumn("_phase", F.expr(_PHASE))
    out = out.withColumn("slot", F.expr("_phase.base + (round - _phase.begin) * _phase.H + _phase.in_round"))
    return out.withColumn("rank", F.expr(f"_at - block * {block_chars}L")).select("_row.*", "block", "round", "slot", "rank")


def in_order(mixed: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows sorted by their place in the mixture, partition by partition."""
    key = ("slot", "rank")
    return (mixed.repartitionByRange(tasks, *key) if tasks else mixed.repartitionByRange(*key)).sortWithinPartitions(*key)
