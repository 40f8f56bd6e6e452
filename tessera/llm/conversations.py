"""Problem 1: rebuilding conversations from message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import checkpoint, shuffle_partitions


def is_blank(c: Column) -> Column:
    """Null, without a letter or digit, or just a word that writers put for nothing."""
    nothing = r"(?iU)^[\s\p{Cf}]*(null|none|nan|n/a|undefined)[\s\p{Cf}]*$"
    return c.isNull() | ~c.rlike(r"[\p{L}\p{N}]") | c.rlike(nothing)


def conversations(turns: DataFrame) -> DataFrame:
    """Messages of whole sessions: ``session_id, msg_no, role, turn_id``.

    ``turns`` needs ``id, session_id, question, answer, created_at``. Within a session the rows are sorted by
    ``created_at, id`` and run through an automaton with two states, *user next* and *assistant next*: a row with
    a question only leads from the first to the second, one with an answer only back, one with both needs the
    first and stays there; anything else breaks the session. It is kept if it ends in *user next* with at least one
    message, and no row that isn't blank lacks its time. Blank rows are ignored, null and blank session ids belong
    to no session, and rows equal in session, question, answer and time count once, with the smallest id (ids
    that are null sort first; they have no turn to name, but still count).

    A session can be of any size: the rows are range-partitioned by session, time and id, so a large one spreads
    over several partitions. Each partition checks its own segment of a session; the segments, at most as many as
    there are partitions, are then checked against their neighbours and give the offsets of ``msg_no``. No text is
    shuffled, only a hash of it."""
    sid = F.lower(F.regexp_replace(F.col("session_id"), r"(?U)^\s+|\s+$", ""))
    q, a = ~is_blank(F.col("question")), ~is_blank(F.col("answer"))
    content = F.unhex(F.md5(F.concat(*[F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("t"), F.length(c).cast("string"), F.lit(":"), F.col(c))) for c in ("question", "answer")])))
    rows = turns.select(F.col("id").cast("long").alias("id"), sid.alias("sid"), F.col("created_at").alias("at"), q.alias("q"), a.alias("a"), content.alias("content"))
    rows = rows.where((F.col("sid") != "") & (F.col("q") | F.col("a")))
    once = rows.groupBy("sid", "at", "content", "q", "a").agg(F.min("id").alias("id")).drop("content")

    parts = shuffle_partitions(turns.sparkSession)
    spread = once.repartitionByRange(parts, "sid", "at", "id").withColumn("part", F.spark_partition_id())
    order = W.partitionBy("sid", "part").orderBy("at", "id")
    starts, ends = F.when(F.col("q"), "u").otherwise("a"), F.when(F.col("a"), "a").otherwise("u")
    before = F.coalesce(F.sum(F.col("q").cast("int") + F.col("a").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = F.lag(ends).over(order)
    linked = checkpoint(spread.select("sid", "part", "at", "id", "q", "a", before.alias("before"), (last.isNull() | (last != starts)).alias("linked")))

    place = F.struct("at", "id")
    segments = linked.groupBy("sid", "part").agg(
        F.bool_and("linked").alias("linked"), F.bool_or(F.col("at").isNull()).alias("timeless"), F.sum(F.col("q").cast("int") + F.col("a").cast("int")).alias("n"),
        F.min_by(starts, place).alias("first"), F.max_by(ends, place).alias("last"),
    )
    along = W.partitionBy("sid").orderBy("part")
    joined = segments.select("*", F.lag("last").over(along).alias("left"), F.lead("part").over(along).isNull().alias("final"), (F.sum("n").over(along) - F.col("n")).alias("offset"))
    fits = F.col("linked") & ~F.col("timeless") & (F.col("first") != F.coalesce(F.col("left"), F.lit("a"))) & (~F.col("final") | (F.col("last") == "a"))
    whole = joined.select("sid", "part", "offset", F.bool_and(fits).over(W.partitionBy("sid")).alias("whole")).where("whole").drop("whole")
    kept = linked.join(whole, ["sid", "part"])
    number = F.col("offset") + F.col("before")
    user, answer = F.struct(F.lit("user").alias("role"), number.alias("n")), F.struct(F.lit("assistant").alias("role"), (number + F.col("q").cast("int")).alias("n"))
    messages = kept.select("sid", "id", F.explode(F.filter(F.array(F.when(F.col("q"), user), F.when(F.col("a"), answer)), lambda x: x.isNotNull())).alias("m"))
    return messages.select(F.col("sid").alias("session_id"), (F.col("m.n") + 1).cast("long").alias("msg_no"), F.col("m.role").alias("role"), F.col("id").alias("turn_id"))
