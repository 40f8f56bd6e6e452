"""Bounded session memory and rate limits over append-only tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.operators.running import running_before
from tessera.session import shuffle_partitions


def session_key(c: Column) -> Column:
    return F.lower(T.strip(c))


def turns_once(turns: DataFrame) -> DataFrame:
    """Turns that name a session, whole-row repeats merged."""
    named = turns.withColumn("session_id", session_key(F.col("session_id"))).where("session_id is not null and session_id != ''")
    return named.dropDuplicates(["id", "session_id"])


def keep_last(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` rows of each key with the highest ``order``. The limit applies in each partition before the shuffle,
    so a hot key moves ``n`` rows a partition."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def keep_newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: one row a key, as an aggregate with partial sums instead of a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


#: Ids of one segment: a session's rows of so many neighbouring ids are sorted in one task, however large it is.
SEGMENT = 250_000


def with_previous(rows: DataFrame, key: str, order: str, value: Column, n: int, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with ``prev_1`` to ``prev_n``: ``value`` (never null) of the rows before, by the whole number ``order``,
    of the same key.

    A key is cut into segments by its order, so a hot one spreads over tasks; the last ``n`` values of each segment
    are handed on to the next ones."""
    cut = rows.withColumn("_v", value).withColumn("_s", F.floor(F.col(order) / F.lit(segment)))
    inside = W.partitionBy(key, "_s").orderBy(order)
    placed = cut.select("*", F.row_number().over(inside).alias("_i"), *[F.lag("_v", k).over(inside).alias(f"_l{k}") for k in range(1, n + 1)])
    back = F.row_number().over(W.partitionBy(key, "_s").orderBy(F.desc(order)))
    tails = cut.select(key, "_s", F.col(order).alias("_o"), "_v", back.alias("_b")).where(F.col("_b") <= n).groupBy(key, "_s")
    tails = tails.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias("_t"))
    along = W.partitionBy(key).orderBy("_s")
    none = F.array().cast(tails.schema["_t"].dataType)
    handed = tails.select(key, "_s", F.concat(*[F.coalesce(F.lag("_t", k).over(along), none) for k in range(n, 0, -1)]).alias("_p"))
    joined = placed.join(handed, [key, "_s"])
    at = lambda k: F.try_element_at("_p", (F.col("_i") - k - 1).cast("int"))
    values = [F.when(F.col("_i") > k, F.col(f"_l{k}")).otherwise(at(k)).alias(f"prev_{k}") for k in range(1, n + 1)]
    return joined.select(*[F.col(c) for c in rows.columns], *values)


def is_followup(q: Column) -> Column:
    """Whether a stripped question begins or ends like a follow-up or points at something said before."""
    low = F.lower(q)
    marked = F.lit(False)
    for x in L.FOLLOWUP_STARTS:
        marked = marked | low.startswith(x)
    for x in L.FOLLOWUP_ENDS:
        marked = marked | low.endswith(x)
    for x in L.FOLLOWUP_INSIDE:
        marked = marked | low.contains(x)
    return marked


def followups(turns: DataFrame, hours: int = 24, most: int = 80, kept: int = 240) -> DataFrame:
    """Questions that need their context, with it: ``id, session_id, query, used``.

    ``turns``: ``id, session_id, question, created_at``. A question of at most ``most`` characters that begins or ends
    like a follow-up, or points at something, gets the session's one or two questions before it (by id) of the last
    ``hours``. Asking to write turns reads in them into writes, asking to read the other way. A question without any
    such gives itself."""
    q = T.strip(F.coalesce("question", F.lit("")))
    marked = is_followup(q)
    kept_rows = turns.select("id", "session_id", q.alias("q"), (marked & (F.length(q) <= most)).alias("marked"), "created_at", F.substring(F.coalesce("question", F.lit("")), 1, kept).alias("question"))
    rows = with_previous(kept_rows, "session_id", "id", F.struct("question", "created_at"), 2)
    recent = lambda b: F.col(b).isNotNull() & (F.col(f"{b}.created_at") >= F.col("created_at") - F.expr(f"interval {hours} hours"))

    def turned(c: Column) -> Column:
        c = F.substring(c, 1, kept)
        write = F.replace(F.replace(c, F.lit("RD_MB_DATA_LEN"), F.lit("WR_MB_DATA_LEN")), F.lit("读取"), F.lit("写入"))
        read = F.replace(F.replace(c, F.lit("WR_MB_DATA_LEN"), F.lit("RD_MB_DATA_LEN")), F.lit("写入"), F.lit("读取"))
        return F.when(F.col("q").contains("写"), write).when(F.col("q").contains("读"), read).otherwise(c)

    lines = F.filter(F.array(*[F.when(F.col("marked") & recent(b), F.concat(F.lit("此前问题："), turned(F.col(f"{b}.question")))) for b in ("prev_2", "prev_1")]), lambda x: x.isNotNull())
    query = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n当前追问："), F.col("q"))).otherwise(F.col("q"))
    return rows.select("id", "session_id", query.alias("query"), F.size(lines).alias("used"))


def cleared(turns: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns without those of the named sessions (``session_id``), and how many each of these had: ``session_id, removed``."""
    gone = sessions.select("session_id").where("session_id is not null").distinct()
    removed = turns.join(gone, "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("removed"))
    return turns.join(gone, "session_id", "left_anti"), gone.join(removed, "session_id", "left").select("session_id", F.coalesce("removed", F.lit(0)).alias("removed"))


def with_next_ids(existing: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """``new`` with ids that go on from the highest of ``existing``, in the order of the distinct values of ``order``. The
    numbers come from counts by range, so no task gets all rows."""
    highest = existing.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    place = running_before(new.select(order, F.lit(0).alias("_all"), F.lit(1).alias("_one")), "_all", order, "_one")
    return new.join(place.select(order, (F.col("before") + 1 + highest).alias(key)), order)


class Limiter:
    """Sliding log of one key: at most ``limit`` accepted calls in any ``seconds``; refused ones are not logged."""

    def __init__(self, limit: int, seconds: float, times: list[float] | None = None) -> None:
        self.limit, self.seconds, self.log = max(1, limit), seconds, deque(times or ())

    def check(self, now: float) -> tuple[bool, int]:
        while self.log and self.log[0] <= now - self.seconds:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return False, max(1, int(self.seconds - (now - self.log[0]) + 0.999))
        self.log.append(now)
        return True, 0


def rate_limited(events: DataFrame, key: str, at: str, order: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """Each call of a key in the order of ``at, order``, with ``allowed`` and ``retry_after`` seconds.

    Whether a call is refused depends on those accepted in the ``seconds`` before it, so calls that follow one another
    closer than that are taken in turn; but a silence of that length makes the log empty, so a key is cut there
    into runs, which spread over tasks. Calls are sorted by the shuffle and streamed with a log of ``limit`` times in
    memory, never gathered. What stays in one task is a run without any silence: a key that never rests has only one,
    which is what a log that depends on order means. Rows with a null key or time are left out."""
    micros = F.unix_micros(F.col(at).cast("timestamp")) if dict(events.dtypes)[at].startswith("timestamp") else (F.col(at) * 1_000_000).cast("long")
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, order, at, micros.alias("_us"))
    rows = rows.withColumn("_cell", F.floor(F.col("_us") / F.lit(int(seconds * 1e6))).cast("long"))
    # an empty cell between two is a silence of its length at least; cells are counted before they are sorted
    cells = rows.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    along = W.partitionBy(key).orderBy("_cell")
    starts = cells.select(key, "_cell", F.coalesce((F.col("_cell") - F.lag("_cell").over(along) > 1).cast("int"), F.lit(1)).alias("_new"))
    runs = starts.select(key, "_cell", F.sum("_new").over(along).alias("_run"))
    placed = rows.join(runs, [key, "_cell"]).select(key, order, at, "_us", "_run")
    sorted_rows = placed.repartition(shuffle_partitions(events.sparkSession), key, "_run").sortWithinPartitions(key, "_run", at, order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, limiter = None, Limiter(limit, seconds)
        for b in batches:
            times = b.column("_us").to_numpy() / 1e6
            allowed, retry = [], []
            for k, run, t in zip(b.column(key).to_pylist(), b.column("_run").to_pylist(), times.tolist()):
                if (k, run) != last:
                    last, limiter = (k, run), Limiter(limit, seconds)
                ok, wait = limiter.check(t)
                allowed.append(ok)
                retry.append(wait)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, order, at)), pa.array(allowed), pa.array(retry, pa.int32())], [key, order, at, "allowed", "retry_after"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in (key, order, at))
    return sorted_rows.mapInArrow(work, f"{kinds}, allowed boolean, retry_after int")
