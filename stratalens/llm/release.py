"""Quarantine and cascading release: turns wait for the turns they answer, fail, are tried again, die or block.

A vertex program with message passing on co-partitioned RDDs. A vertex is a turn; its key is the
conversation and the turn's place there. In each superstep the vertices that a message has reached run their
attempts: delivered ones send their time to their children, dead and blocked ones send a block message. It ends
when no message is under way. Waiting vertices and messages lie in the same partitions, so a superstep shuffles messages
only, and vertices that are done leave the loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, shuffle_partitions
from .running import numbered

#: Seconds between arrivals, the first wait before a retry (doubled each time), attempts, places a parent can be back.
EVERY, WAIT, ATTEMPTS, REACH = 7, 20, 4, 7
#: Remainders of 101 that mean faulty; the greatest repair time is 100 seconds.
FAULTY, SPREAD = 20, 101
#: Supersteps between two cuts of the lineage.
CUT = 6
#: The message of a vertex that does not deliver.
BLOCK = -1
DELIVERED, DEAD, BLOCKED = "delivered", "dead", "blocked"


def draw(k: int) -> Column:
    """h(k): crc32 of k, conv_id and turn as decimal text, parted by colons."""
    return F.crc32(F.concat_ws(":", F.lit(str(k)), F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))


def vertices(turns: DataFrame) -> DataFrame:
    """turns: conv_id, p, turn, crc. With back (how many places the parent is earlier, 0: none), repaired (the second; null: not
    faulty) and fails (bit a: attempt a + 1 fails whenever it is made, if the turn is faulty)."""
    back = (draw(0) % REACH).cast("int")
    fails = reduce(lambda x, y: x + y, (F.when(draw(a + 3) % 3 == 0, 1 << a).otherwise(0) for a in range(ATTEMPTS)))
    return turns.select("conv_id", "p", "turn", "crc", F.when(F.col("p") >= back, back).otherwise(0).alias("back"), F.when(draw(1) % SPREAD < FAULTY, EVERY * F.col("p") + draw(2) % SPREAD).alias("repaired"), fails.alias("fails"))


def attempt(p: int, repaired: int | None, fails: int, message: int) -> tuple[str, int, int | None, int | None]:
    """(status, attempts, first_at, last_at) of a turn that `message` lets run: a second not before which it can, or BLOCK."""
    if message == BLOCK:
        return BLOCKED, 0, None, None
    first = at = max(EVERY * p, message)
    for a in range(ATTEMPTS):
        if repaired is None or at >= repaired and not fails >> a & 1:
            return DELIVERED, a + 1, first, at
        last, at = at, at + (WAIT << a)
    return DEAD, ATTEMPTS, first, last


def _graph(known: DataFrame, partitions: int) -> RDD:
    """(key, (vertex, children, waits)): a vertex is (p, turn, crc, repaired, fails), its children are their places, and it
    waits if it has a parent. Keys are (conv_id, p), whatever the length of a conversation."""
    own = known.select("conv_id", "p", "turn", "crc", "repaired", "fails", "back").rdd.map(lambda r: ((r[0], r[1]), tuple(r[1:])))
    edges = known.where("back > 0").select("conv_id", F.col("p") - F.col("back"), "p").rdd.map(lambda r: ((r[0], r[1]), r[2]))

    def gather(part: Iterator) -> Iterator:
        for key, told in part:
            vertex, children = None, []
            for x in told:
                if isinstance(x, tuple):
                    vertex = x
                else:
                    children.append(x)
            yield key, (vertex[:-1], tuple(children), vertex[-1] > 0)

    return own.union(edges).groupByKey(partitions).mapPartitions(gather, preservesPartitioning=True)


def supersteps(graph: RDD, partitions: int, cut: int = CUT) -> RDD:
    """Runs the vertex program over what _graph gives; (key, (vertex, outcome)) for all vertices, with attempt's outcome.

    A vertex gets one message and sends fewer than REACH. Every `cut` supersteps the vertices and the outcomes since
    the last cut are written to the checkpoint folder, and what was kept in memory before is given up.
    """

    def begin(part: Iterator) -> Iterator:
        for key, (vertex, children, waits) in part:
            yield key, (vertex, children, None if waits else _outcome(vertex, 0))

    def reach(part: Iterator) -> Iterator:
        for key, told in part:
            state, message = None, None
            for x in told:
                if isinstance(x, tuple):
                    state = x
                else:
                    message = x
            yield key, state if message is None else (*state[:2], _outcome(state[0], message))

    def send(x: tuple) -> list[tuple]:
        (conv, _), (_, children, outcome) = x
        if outcome is None:
            return []
        message = outcome[3] if outcome[0] == DELIVERED else BLOCK
        return [((conv, child), message) for child in children]

    spark_context = graph.context
    stepped = graph.mapPartitions(begin, preservesPartitioning=True)
    held, ran, done, n = [], [], [], 0
    while True:
        n += 1
        stepped = stepped.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(stepped)
        if n % cut == 0:
            stepped.checkpoint()
        sent = stepped.flatMap(send).partitionBy(partitions)
        under_way = sent.count()
        ran.append(stepped.filter(lambda x: x[1][2] is not None).mapValues(lambda x: (x[0], x[2])))
        if n % cut == 0 or not under_way:
            piece = spark_context.union(ran)
            piece.checkpoint()
            piece.count()
            done.append(piece)
            ran = []
            for old in held if not under_way else held[:-1]:
                old.unpersist()
            held = held[-1:]
        if not under_way:
            return spark_context.union(done)
        waiting = stepped.filter(lambda x: x[1][2] is None)
        stepped = waiting.union(sent).groupByKey(partitions).mapPartitions(reach, preservesPartitioning=True)


def _outcome(vertex: tuple, message: int) -> tuple:
    p, _, _, repaired, fails = vertex
    return attempt(p, repaired, fails, message)


def replay(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each turn: conv_id, turn, p (its place, from 0), status, attempts, first_at, last_at (seconds), release_no
    and state (a decimal).

    turns: conv_id, turn and text; other columns are not read. Turns are placed by turn, then by the text's crc32;
    equal rows are turns of their own. A turn whose parent is dead or blocked is blocked, with no attempts and null times.
    Delivered turns are numbered from 1 by (last_at, turn); state is the sum of number times crc32 of the text
    through that release; others have neither. A null text is empty. Rows with a null conv_id or turn cannot
    be replayed: all else in them is null. An empty table gives no rows.
    """
    spark = turns.sparkSession
    partitions = shuffle_partitions(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    crc = F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    narrow = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), crc.alias("crc"))
    placed = numbered(narrow.where("conv_id is not null and turn is not null"), "conv_id", ["turn", "crc"])
    known = vertices(placed.withColumn("p", F.col("nth") - 1))
    ended = supersteps(_graph(known, partitions), partitions)
    rows = ended.map(lambda x: (x[0][0], *x[1][0][1:3], x[0][1], *x[1][1]))
    schema = "conv_id long, turn long, crc long, p long, status string, attempts int, first_at long, last_at long"
    told = materialise(spark.createDataFrame(rows, schema, verifySchema=False), "outcomes")
    released = numbered(told.where(F.col("status") == DELIVERED), "conv_id", ["last_at", "turn", "p"], "crc")
    out = released.withColumnRenamed("nth", "release_no").withColumnRenamed("total", "state").drop("crc")
    rest = told.where(F.col("status") != DELIVERED).drop("crc")
    lost = narrow.where("conv_id is null or turn is null").select("conv_id", "turn")
    return out.unionByName(rest, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
