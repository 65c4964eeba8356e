"""Conversations rebuilt from rows of messages.

The rows are a log of events: creations, edits, deletions and answers given
anew.  They are folded by id into steps: the latest event counts, and one without
content, a deletion, blanks the message.  Every step is then led to its root by pointer
doubling, each round halving the way, so deep chains need few rounds and no task
holds a whole thread.  Threads with a broken chain, without a question or with
a question nobody answered are dropped as a whole; the messages of the others
are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.runtime import materialize

_ROUNDS = 40


def instant(text: Column, digits: int = 6) -> Column:
    """The instant of a time text in any of the notations of the log, in microseconds or, with 9 digits, in nanoseconds; null if it is none.

    Dates and times are joined by T or a space, fractions have up to nine
    digits, zones are Z or an offset with or without colon; without a zone the
    time counts as UTC.
    """
    t = F.trim(text)
    clock = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?)", 0)
    fraction = F.rpad(F.regexp_extract(t, rf"^[^.,]*[.,](\d{{1,{digits}}})", 1), digits, "0")
    zone = F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 0)
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    hours = F.regexp_replace(zone, r"[^0-9]", "")
    offset = F.when(F.length(hours) == 4, sign * (F.substring(hours, 1, 2).cast("int") * 3600 + F.substring(hours, 3, 2).cast("int") * 60)).otherwise(0)
    clean = F.regexp_replace(clock, "T", " ")
    base = F.unix_seconds(F.coalesce(F.try_to_timestamp(F.concat(clean, F.lit("+0000")), F.lit("yyyy-MM-dd HH:mm:ssxx")), F.try_to_timestamp(F.concat(clean, F.lit("+0000")), F.lit("yyyy-MM-dd HH:mmxx"))))
    return (base - offset) * 10**digits + F.when(fraction.rlike(rf"^\d{{{digits}}}$"), fraction.try_cast("bigint")).otherwise(0)


def fold(steps: DataFrame, texts: bool = True) -> DataFrame:
    """(id, threadId, type, parentId, wordy, at) and, with ``texts``, output: one row per step, its last version.

    The rows are events: the first of an id creates the step, a later one edits
    it, answers it anew or, without content, deletes it.  An event is as late as
    the latest of its times, for some have no end; ties go by content, so that
    the choice doesn't depend on the order of rows.  ``wordy`` tells whether the
    output has a letter or digit, ``at`` is the instant of creation in
    nanoseconds.  A blank parentId counts as none.  Rows without id or thread
    are left out.
    """
    rows = steps.where("id is not null and threadId is not null").select(
        "id", "threadId", "type", F.when(F.trim("parentId") != "", F.col("parentId")).alias("parentId"), "output", F.coalesce(F.col("output").rlike(r"[\p{L}\p{N}]"), F.lit(False)).alias("wordy"),
        instant(F.col("createdAt"), 9).alias("at"), *(instant(F.col(c), 9).alias(c) if c in steps.columns else F.lit(None).cast("bigint").alias(c) for c in ("start_at", "end_at")),
    )
    version = F.struct(F.greatest("end_at", "start_at", "at").alias("time"), "at", "threadId", "type", "parentId", "wordy", F.xxhash64("output").alias("h"), *(["output"] if texts else []))
    return rows.groupBy("id").agg(F.max(version).alias("v")).select("id", "v.threadId", "v.type", "v.parentId", "v.wordy", "v.at", *(["v.output"] if texts else []))


def _messages(steps: DataFrame, threads: DataFrame, texts: bool) -> tuple[DataFrame, DataFrame]:
    """The ordered messages of all sound threads, and the folded steps that are in a thread."""
    step = fold(steps, texts).join(threads.where("id is not null").select(F.col("id").alias("threadId")).distinct(), "threadId", "left_semi")
    step = step.select(
        "threadId", "id", "parentId", "at", *(["output"] if texts else []),
        F.when((F.col("type") == "user_message") & F.col("wordy"), "user").when((F.col("type") == "assistant_message") & F.col("wordy"), "assistant").alias("role"),
    )
    step = materialize(step, "chat-steps")
    led, unsound = _lead(step)
    users = step.where("role = 'user'").select("threadId", F.col("id").alias("root"), F.col("at").alias("root_at"))
    below = step.where("role = 'assistant' and parentId is not null").select("threadId", "id", "role", "at").join(led, ["threadId", "id"]).join(users, ["threadId", "root"])
    below = materialize(below.select("threadId", "id", "role", "at", "root", "root_at"), "chat-answers")
    unanswered = users.join(below.select("threadId", "root").distinct(), ["threadId", "root"], "left_anti").select("threadId")
    sound = users.select("threadId").distinct().join(unsound.unionByName(unanswered).distinct(), "threadId", "left_anti")
    heads = step.where("role = 'user' or role = 'assistant' and parentId is null").select("threadId", "id", "role", "at", F.col("id").alias("root"), F.col("at").alias("root_at"))
    messages = heads.unionByName(below).join(sound, "threadId", "left_semi").withColumn("reply", (F.col("id") != F.col("root")).cast("int"))
    return ordered(messages), step


def conversations(steps: DataFrame, threads: DataFrame) -> DataFrame:
    """(threadId, position, id, role, text, at): the messages of all sound threads.

    A message is a step of type user_message or assistant_message whose output
    has a letter or digit.  A thread is sound if it is in ``threads``, has a user
    message, every step with a parent leads, through parents in the same thread,
    to a user message, and every user message has an assistant message below it.
    Messages without parent stand in the order of their instants, each user
    message followed by the assistant messages below it in the order of theirs;
    ties go by id, messages without an instant come first.  Empty tables give no
    rows; other columns are ignored.  ``at`` is in microseconds.  The texts are
    put to the messages last.
    """
    placed, step = _messages(steps, threads, True)
    return placed.join(step.select("threadId", "id", F.col("output").alias("text")), ["threadId", "id"]).select("threadId", "position", "id", "role", "text", F.floor(F.col("at") / 1000).cast("bigint").alias("at"))


def _lead(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threadId, id, root) of every step with its nearest user message, and the threads where a step has none.

    Each round lets every open step take over its parent's pointer, which
    doubles the way it has gone.  A round in which no step arrives is the last:
    what is open then runs in circles, for every step on a way to the end is
    preceded by steps nearer to it.
    """
    user = F.col("role") == "user"
    ends = F.col("parentId").isNull() | F.coalesce(user, F.lit(False))
    way = step.select("threadId", "id", F.when(ends, F.col("id")).otherwise(F.col("parentId")).alias("up"), ends.alias("ended"))
    count, k = way.where(~F.col("ended")).count(), 0
    while count and k < _ROUNDS:
        reach = way.select("threadId", F.col("id").alias("up"), F.col("up").alias("next"), F.col("ended").alias("last"), F.lit(True).alias("there"))
        on = way.where(~F.col("ended")).join(reach, ["threadId", "up"], "left")
        on = on.select("threadId", "id", F.col("next").alias("up"), F.coalesce("last", F.lit(True)).alias("ended"))
        way = materialize(way.where("ended").unionByName(on), f"chat-way-{k}")
        left = way.where(~F.col("ended")).count()
        if left == count:
            break
        count, k = left, k + 1
    users = step.where("role = 'user'").select("threadId", F.col("id").alias("up"))
    good = way.where("ended").join(users, ["threadId", "up"], "left_semi")
    led = materialize(good.select("threadId", "id", F.col("up").alias("root")), "chat-roots")
    child = step.where("parentId is not null").select("threadId", "id", "parentId", user.alias("user"))
    # a step with a parent arrives by itself; of a user message with a parent, the parent has to arrive
    bad = child.where(~F.coalesce("user", F.lit(False))).join(led, ["threadId", "id"], "left_anti").select("threadId")
    bad = bad.unionByName(child.where("user").select("threadId", F.col("parentId").alias("id")).join(led, ["threadId", "id"], "left_anti").select("threadId"))
    return led, bad.distinct()


def ordered(messages: DataFrame) -> DataFrame:
    """Messages with their position in the thread.

    The rows are sorted once across the cluster; a position is a row's place in
    its partition's share of the thread plus the shares of earlier partitions.
    """
    keys = ["threadId", "root_at", "root", "reply", "at", "id"]
    spread = materialize(messages.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()), "chat-sorted")
    share = spread.groupBy("threadId", "_p").agg(F.count("*").alias("_n"))
    before = share.select("threadId", "_p", (F.sum("_n").over(Window.partitionBy("threadId").orderBy("_p")) - F.col("_n")).alias("_before"))
    placed = spread.withColumn("_at", F.row_number().over(Window.partitionBy("threadId", "_p").orderBy(*keys[1:])) - 1)
    return placed.join(before, ["threadId", "_p"]).withColumn("position", (F.col("_at") + F.col("_before")).cast("int")).drop("_at", "_before", "_p")


def found(steps: DataFrame, threads: DataFrame) -> DataFrame:
    """(threadId, position, id, role) of the messages of all kept threads; the same without the texts, which then never leave the scan."""
    return _messages(steps, threads, False)[0].select("threadId", "position", "id", "role")
