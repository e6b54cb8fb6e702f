"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quoted, as deep as they have marks; what is left is the message's
own text.  Own texts are indexed by the hashes of their paragraphs and lines, normalised to lower case
and single spaces.  A message's quoted passages of every level are hashed alike and joined, within
their conversation, to earlier messages; it replies to the latest that it quotes at the shallowest
level with a match, whole passages first.  What deeper levels match are further links.  Conversations
are then written in the order of replies: a message, then the replies to it by turn, each with its own;
messages that quote nothing known begin threads of their own.

A message's place in its thread is its rank on the tour that enters and leaves every message of the
reply tree; pointers along the tour are doubled until they reach its end, so a thread of any shape takes
rows in proportion to its messages and rounds in proportion to their logarithm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, frugal, store

MARKS = re.compile(r"^((?:[ \t]*>)+)[ \t]?")
#: Threads by first turn, messages of a thread, and copies of a message that one row of the result has at most.
THREADS, PLACES, COPIES = 64, 256, 256
#: Windows over the turns of a conversation are worked out in runs of so many turns.
RUN = 4096
PARSED = pa.schema([("own", pa.string()), ("own_hashes", pa.list_(pa.int64())), ("quoted", pa.list_(pa.struct([("depth", pa.int32()), ("whole", pa.int32()), ("h", pa.int64())])))])
PARSED_DDL = "own string, own_hashes array<long>, quoted array<struct<depth:int,whole:int,h:long>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def key(text: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))


def levels(text: str) -> list[tuple[int, str]]:
    """(depth, line without its marks) of each line; depth 0 is the message's own."""
    out = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def parse(text: str | None) -> tuple[str, list[int], list[dict[str, int]]]:
    """Own text without quotes; hashes of its parts; of quoted passages (whole 1) and their lines (0) with their depths."""
    lines = levels(text or "")
    own = re.sub(r"\n{3,}", "\n\n", "\n".join(x for d, x in lines if d == 0)).strip("\n")
    parts = {normal(own), *(normal(p) for p in re.split(r"\n[ \t]*\n", own)), *(normal(x) for x in own.split("\n"))} - {""}
    quoted = set()
    for depth, run in groupby(lines, lambda x: x[0]):
        if depth:
            passage = [x for _, x in run]
            whole = {normal("\n".join(passage)), *(normal(q) for q in re.split(r"\n[ \t]*\n", "\n".join(passage)))}
            quoted |= {(depth, 1, key(x)) for x in whole - {""}} | {(depth, 0, key(x)) for x in set(map(normal, passage)) - {""}}
    return own, sorted(map(key, parts)), [{"depth": d, "whole": w, "h": h} for d, w, h in sorted(quoted)]


def parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(t) for t in batch.column(3).to_pylist()]
            columns = [pa.array([g[i] for g in got], PARSED.field(i).type) for i in range(len(PARSED))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["conv_id", "turn", "role", *PARSED.names])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    bounded_batches(messages.sparkSession)
    return rows.mapInArrow(frugal(run), f"conv_id long, turn long, role string, {PARSED_DDL}")


def links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, deeper): the latest earlier message of which a passage, else a line, is quoted.

    reply_to is that of the shallowest depth with a match; ``deeper`` has (depth, turn) of all others."""
    asks = rows.select("conv_id", "turn", F.inline("quoted")).distinct()
    said = rows.select("conv_id", "turn", F.explode("own_hashes").alias("h")).distinct().join(asks.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    both = asks.select("conv_id", "h", "turn", "depth", "whole", F.lit(1).alias("asks")).unionByName(said.select("conv_id", "h", "turn", F.lit(0).alias("depth"), F.lit(0).alias("whole"), F.lit(0).alias("asks")))
    # many messages may say the same ("thanks"): the latest before each asker is what counts, so turns
    # are searched and not paired, in runs, and what runs said last is carried on
    both = both.withColumn("run", F.floor(F.col("turn") / RUN))
    origin = F.when(F.col("asks") == 0, F.col("turn"))
    within = Window.partitionBy("conv_id", "h", "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    runs = both.groupBy("conv_id", "h", "run").agg(F.max(origin).alias("last"))
    earlier = Window.partitionBy("conv_id", "h").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "h", "run", F.max("last").over(earlier).alias("before"))
    met = both.withColumn("own", F.max(origin).over(within)).filter("asks = 1").join(runs, ["conv_id", "h", "run"])
    met = met.withColumn("origin", F.coalesce("own", "before")).filter("origin IS NOT NULL")
    of_depth = met.groupBy("conv_id", "turn", "depth").agg(F.max(F.struct("whole", "origin"))["origin"].alias("origin"))
    found = of_depth.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("origin").alias("turn")))).alias("found"))
    return found.select("conv_id", "turn", F.col("found")[0]["turn"].alias("reply_to"), F.slice("found", F.lit(2), F.size("found")).alias("deeper"))


def places(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, deeper, thread, place): the first turn of each message's thread, and how
    many messages of the thread stand before it.

    The tour enters a message (2 * turn), goes through its replies by turn, and leaves it (2 * turn + 1)."""
    every = rows.select("conv_id", "turn").distinct().join(replies, ["conv_id", "turn"], "left")
    every = store(every)
    links = every.filter("reply_to IS NOT NULL").select("conv_id", "turn", "reply_to")
    # the next reply to the same message, in runs of turns
    key = ["conv_id", "reply_to"]
    inner = links.withColumn("run", F.floor(F.col("turn") / RUN))
    firsts = inner.groupBy(*key, "run").agg(F.min("turn").alias("first"))
    firsts = firsts.select(*key, "run", F.lead("first").over(Window.partitionBy(*key).orderBy("run")).alias("following"))
    inner = inner.withColumn("next", F.lead("turn").over(Window.partitionBy(*key, "run").orderBy("turn")))
    inner = inner.join(firsts, [*key, "run"]).select("conv_id", "turn", "reply_to", F.coalesce("next", "following").alias("next"))
    children = links.groupBy(*key).agg(F.min("turn").alias("child")).withColumnRenamed("reply_to", "turn")
    linked = inner.join(children, ["conv_id", "turn"], "full")
    enter = F.struct((F.col("turn") * 2).alias("at"), F.coalesce(F.col("child") * 2, F.col("turn") * 2 + 1).alias("to"), F.lit(1).cast("long").alias("w"))
    leave = F.struct((F.col("turn") * 2 + 1).alias("at"), F.coalesce(F.col("next") * 2, F.col("reply_to") * 2 + 1, F.col("turn") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("w"))
    now = store(linked.select("conv_id", F.explode(F.array(enter, leave)).alias("e")).select("conv_id", "e.*"))
    while True:
        ahead = now.select(F.col("conv_id").alias("c2"), F.col("at").alias("a2"), F.col("to").alias("t2"), F.col("w").alias("w2"))
        after = store(now.join(ahead, (F.col("conv_id") == F.col("c2")) & (F.col("to") == F.col("a2"))).select("conv_id", "at", F.col("t2").alias("to"), (F.col("w") + F.col("w2")).alias("w"), (F.col("to") != F.col("t2")).alias("moved")))
        discard(now)
        now = after.drop("moved")
        if not after.filter("moved").limit(1).count():
            break
    # from each message on, itself included, to the end of the tour, which leaves the thread's first message
    left = now.filter("pmod(at, 2) = 0").select("conv_id", F.shiftright("at", 1).alias("turn"), F.shiftright("to", 1).alias("thread"), "w")
    whole = left.filter("turn = thread").select("conv_id", "thread", F.col("w").alias("n"))
    placed = left.join(whole, ["conv_id", "thread"]).select("conv_id", "turn", "thread", (F.col("n") - F.col("w")).alias("place"))
    out = store(every.join(placed, ["conv_id", "turn"], "left").select("conv_id", "turn", "reply_to", "deeper", F.coalesce("thread", "turn").alias("thread"), F.coalesce("place", F.lit(0).cast("long")).alias("place")))
    discard(now)
    discard(every)
    return out


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, deeper, thread, place, own: each message without quotes, its links,
    its thread's first turn and its place there.

    One row for each row of ``messages`` (conv_id, turn, role, text; other columns are ignored, whatever
    their names).  A null text is empty; rows with a null conv_id or turn are left without a place (null
    thread) and link with nothing; repeated (conv_id, turn) are one message of several texts, whose
    passages and quotes count together, and share links and place; texts of any length are parsed whole;
    an empty table stays empty.
    """
    rows = store(parsed(messages))
    known = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    return rows.join(places(known, links(known)), ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "reply_to", "deeper", "thread", "place", "own")


def conversations(messages: DataFrame, threads: int = THREADS, placeless: bool = False) -> DataFrame:
    """conv_id, part, n_messages, n_replies, chat, piece, copy: conversations in the order of replies.

    A part has the threads whose first turns fall into a range of ``threads`` turns, a piece PLACES
    places of these threads, a copy COPIES equal rows of each message, so that a row is bounded however
    long a conversation is and however often a row is repeated.  Each message is ``<|role|>`` and its own
    text on lines of their own.  Messages with a null conv_id or turn are left out, or with ``placeless``
    each is a row with a null part.
    """
    every = reply_ordered(messages)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own"))
    rows = every.filter("thread IS NOT NULL").groupBy("conv_id", "thread", "place", F.col("reply_to").isNotNull().alias("reply"), line.alias("line")).agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    rows = rows.withColumn("here", F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("copy") * COPIES))
    rows = rows.withColumn("part", F.floor(F.col("thread") / threads)).withColumn("piece", F.floor(F.col("place") / PLACES))
    ordered = F.array_sort(F.collect_list(F.struct("thread", "place", "line", "here")))
    grouped = rows.groupBy("conv_id", "part", "piece", "copy").agg(F.sum("here").alias("n_messages"), F.sum(F.when(F.col("reply"), F.col("here")).otherwise(0)).alias("n_replies"), ordered.alias("m"))
    text = F.array_join(F.flatten(F.transform("m", lambda x: F.array_repeat(x["line"], x["here"].cast("int")))), "\n")
    chats = grouped.select("conv_id", "part", "n_messages", "n_replies", text.alias("chat"), "piece", "copy")
    if not placeless:
        return chats
    n = lambda x: F.lit(x).cast("long")
    return chats.unionByName(every.filter("thread IS NULL").select("conv_id", n(None).alias("part"), n(1).alias("n_messages"), n(0).alias("n_replies"), line.alias("chat"), n(None).alias("piece"), n(None).alias("copy")))
