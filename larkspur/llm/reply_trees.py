"""Reply trees: root-to-leaf paths, the best branches of each tree, and chat formatting.

Messages point to the one that they answer. Pointers are doubled in self-joins: after r
rounds a message knows the ancestor 2 ** r above it, how many messages lie between and what
their scores add up to, so that a tree of depth d takes about log2(d) rounds. Leaves of
a tree are ranked by the score of their whole branch; from each chosen leaf the kept
pointers of all rounds are followed, again in self-joins, to every message of its path.
Only then do texts come in, and each path is formatted as one conversation. Where many
messages answer one, the adaptive skew join splits them.

A conversation is written in parts of up to PART_CHARS characters, with the stretches
that count for the loss; writer and reader go through a path's messages in order and
hold one message and one part at a time, so a conversation may have any length.

Messages are rows of: row (a number of its own), conv_id, tree (a key without nulls), id, parent
(an id of the same tree, or null), role, text and score; `linear` makes them of conversations.

Defined cases: a null text or role is empty; a parent that is not there makes a
root; of messages with the same id in a tree the one with the smallest row number stays;
messages in or below a circle belong to no path; null scores count 0; an empty table gives
no path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, parts_of, shared_dir, tree_key, written
from .words import rows

START, END = "<|im_start|>", "<|im_end|>"
#: Whose texts count for the loss.
SPEAKER = "assistant"
#: Characters of a part of a conversation.
PART_CHARS = 1 << 20
_PARTS = "conv_id long, branch int, part int, last boolean, text string, loss array<struct<start: long, end: long>>"
_READ = "conv_id long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one branch each: a row answers the one before it.

    Rows go by turn, null first, and within a turn by role and text; a null conv_id is a conversation too. The
    score of a row is the length of its text where the assistant speaks.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    messages = conversations.select("conv_id", tree_key(F.col("conv_id")).alias("tree"), "turn", text("role").alias("role"), text("text").alias("text"))
    placed = numbered(messages, ["turn", "role", "text"])
    score = F.when(F.col("role") == SPEAKER, F.length("text")).otherwise(0).cast("double")
    return placed.select("row", "conv_id", "tree", F.col("idx").alias("id"), F.when(F.col("idx") > 0, F.col("idx") - 1).alias("parent"), "role", "text", score.alias("score"))


def pointers(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(row, tree, depth, score, leaf) of the messages that hang on a root, and for each round (row, up): 2 ** round above.

    depth counts the messages of the path from the root on, score adds theirs up.
    """
    named = messages.select("row", "tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    first = written(named.groupBy("tree", "id").agg(F.min_by(F.struct("row", "parent", "score"), "row").alias("m")).select("tree", "id", "m.*"), "chat-messages")
    parents = first.select("tree", F.col("id").alias("parent"), F.col("row").alias("up"))
    climbing = written(first.join(parents, ["tree", "parent"], "left").select("row", "tree", "up", F.lit(1).alias("depth"), "score"), "chat-up")
    done, rounds, before = climbing.where("up IS NULL"), [], None
    climbing = climbing.where("up IS NOT NULL")
    while (left := climbing.count()) and left != before:  # when nothing gets done, what is left goes in circles
        rounds.append(climbing.select("row", "up"))
        above = done.unionByName(climbing).select(F.col("row").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("score").alias("gain"))
        met = climbing.join(above, "up").select("row", "tree", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("gain")).alias("score"))
        after = written(met, "chat-up")
        done, climbing, before = done.unionByName(after.where("up IS NULL")), after.where("up IS NOT NULL"), left
    answered = rounds[0].select(F.col("up").alias("row"), F.lit(True).alias("answered")).distinct() if rounds else done.select("row", F.lit(True).alias("answered")).limit(0)
    return done.drop("up").join(answered, "row", "left").withColumn("leaf", F.col("answered").isNull()).drop("answered"), rounds


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """tree, branch, at, row: the messages of the `best` branches of each tree (None: all), `at` counting from the root.

    Branches are ranked from 1 by their score, the largest first; ties go to the smaller row number of the leaf.
    """
    reached, rounds = pointers(messages)
    leaves = reached.where("leaf").withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "row")))
    if best is not None:
        leaves = leaves.where(F.col("branch") <= best)
    path = written(leaves.select("tree", "branch", "depth", F.lit(0).alias("off"), "row"), "chat-paths")
    for r, up in enumerate(rounds):
        far = path.where(F.col("depth") - F.col("off") > 1 << r)
        more = far.join(up, "row").select("tree", "branch", "depth", (F.col("off") + (1 << r)).alias("off"), F.col("up").alias("row"))
        path = path.unionByName(written(more, "chat-paths"))
    return path.select("tree", "branch", (F.col("depth") - 1 - F.col("off")).alias("at"), "row")


def escaped(text: str) -> str:
    """One backslash more in what looks like `<`, backslashes, `|`; so no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def role_line(role: str) -> str:
    """A role on a line of its own."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(line))


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template has it, and where its text starts and ends in it."""
    head, body = f"{START}{role_line(role)}\n", escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def write_chats(messages: DataFrame, folder: str, best: int | None = 1, part_chars: int = PART_CHARS) -> None:
    """The best branches of each tree as files of parts: (conv_id, branch, part, last, text, loss).

    loss lists where texts of the assistant start and end, in characters of the whole conversation, with the
    part in which they start.
    """
    chosen = branches(messages, best)
    placed = chosen.join(messages.select("row", "conv_id", "role", "text"), "row").drop("row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema([("conv_id", pa.int64()), ("branch", pa.int32()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("loss", loss_type)])
        ready: list[tuple] = []
        key, open_text, size, spans, part, done = None, [], 0, [], 0, 0

        def close(last: bool) -> None:
            nonlocal open_text, size, spans, part, done
            ready.append((key[1], key[2], part, last, "".join(open_text), spans))
            done, part, open_text, size, spans = done + size, part + 1, [], 0, []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in ready], schema)
            ready.clear()
            return out

        held = 0
        for r in rows(batches):
            now = (r["tree"], r["conv_id"], r["branch"])
            if now != key:
                if key is not None:
                    close(True)
                key, part, done = now, 0, 0
            turn, start, end = formatted_turn(r["role"], r["text"])
            if r["role"] == SPEAKER:
                spans.append({"start": done + size + start, "end": done + size + end})
            while size + len(turn) > part_chars:
                cut = part_chars - size
                open_text.append(turn[:cut])
                size, turn = part_chars, turn[cut:]
                close(False)
            open_text.append(turn)
            size, held = size + len(turn), held + len(turn)
            if held >= 4 * part_chars or len(ready) >= 4096:
                held = 0
                if ready:
                    yield batch()
        if key is not None:
            close(True)
        if ready:
            yield batch()

    lined = placed.repartition(parts_of(messages.sparkSession), "tree", "branch").sortWithinPartitions("tree", "branch", "at")
    lined.select("tree", "conv_id", "branch", "role", "text").mapInArrow(work, _PARTS).write.parquet(folder)


def _parsed(buffer: str) -> tuple[str, str, str] | None:
    """(role, text, rest) of the first turn of the buffer, or None where it is not whole yet."""
    end = buffer.find(f"{END}\n")
    if end < 0:
        return None
    head = buffer.index("\n")
    return role_of(buffer[len(START) : head]), unescaped(buffer[head + 1 : end]), buffer[end + len(END) + 1 :]


def read_chats(parts: DataFrame) -> DataFrame:
    """conv_id, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the written parts.

    The loss is what the written stretches cover, whoever the turns say has spoken. Conversations of one part are
    read where they are; the parts of others come together, in order.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for r in rows(batches):
            if r["part"] == 0:
                turns, loss, n, counted, at, buffer, spans = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, [], []
            spans += [(x["start"], x["end"]) for x in r["loss"]]
            buffer.append(r["text"])
            if not r["last"] and END not in "".join(buffer[-2:])[-len(r["text"]) - len(END) - 1 :]:
                continue  # a turn of several parts
            whole = "".join(buffer)
            place = 0
            while (end := whole.find(f"{END}\n", place)) >= 0:
                until = end + len(END) + 1
                role, text, _ = _parsed(whole[place:until])
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
                while spans and spans[0][1] <= at + until:
                    start, stop = spans.pop(0)
                    said = unescaped(whole[start - at : stop - at])
                    loss.update(said.encode())
                    counted += len(said)
                place = until
            buffer, at = [whole[place:]], at + place
            if r["last"]:
                out.append((r["conv_id"], r["branch"], n, turns.hexdigest(), counted, loss.hexdigest(), at))
            if len(out) >= 10_000:
                yield _digests(out)
                out = []
        yield _digests(out)

    whole = F.col("last") & (F.col("part") == 0)
    several = parts.where(~whole).repartition("conv_id", "branch").sortWithinPartitions("conv_id", "branch", "part")
    return parts.where(whole).mapInArrow(work, _READ).unionByName(several.mapInArrow(work, _READ))


def _digests(found: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _READ.split(", ")])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema)


def new_folder(spark: SparkSession) -> str:
    """A folder for one set of chats that driver and executors see."""
    return shared_dir(spark, "chats")
