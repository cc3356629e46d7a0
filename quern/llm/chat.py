"""Chat formatting as a prefix tree.

A conversation is formatted turn by turn; conversations that share initial
turns share the nodes of a tree. The tree is emitted depth-first, each node's
text once, into packs of bounded length. A node carries the position of its
first character (what its ancestors hold), the ranges of its ancestors in the
pack, which with its own range are what it may attend to, and the range under
the loss mask if an assistant speaks. A pack stands alone: where a tree goes on
in another pack, the ancestors are emitted there again, once.

Conversations are sorted by the hashes of their turns, which lists the tree
depth-first; the sort is a range partitioning that ends with the conversation's
id, so that a prefix shared by a third of all conversations still spreads over
many tasks. A task holds one pack and the path to the last conversation.

Template: ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n``. In texts and roles
every ``<``, backslashes, ``|`` gets one more backslash, so no control string
survives and taking one away restores the text; in roles backslash and newline
are escaped first.

Defined results
  null text, null role  empty
  null or tied turns    nulls first, then by role and text
  long text             a node holds a whole turn; its pack is closed after it
  null conv_id          the rows without id are one conversation
  repeated rows         repeated turns
  empty table           no packs
  extra columns         not carried
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a pack is closed.
PACK = 1 << 16
RANGE = "struct<start: int, end: int>"
PACKS = f"text string, nodes array<struct<start: int, end: int, parent: int, position: int, attends: array<{RANGE}>, loss: {RANGE}>>, leaves array<struct<conv_id: long, node: int>>"

_START, _END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head = _START + escaped(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escaped(text)
    return head + body + _END, len(head), len(head) + len(body)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = formatted.removeprefix(_START).partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))
    return role, unescaped(rest.removesuffix(_END))


class _Pack:
    def __init__(self) -> None:
        self.parts, self.size, self.nodes, self.leaves = [], 0, [], []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            formatted, a, b = turn(role, text)
            start, end = self.size, self.size + len(formatted)
            parent = self.path[-1][1] if self.path else -1
            position, attends = 0, []
            if parent >= 0:
                above = self.nodes[parent]
                position = above["position"] + above["end"] - above["start"]
                attends = [dict(r) for r in above["attends"]]
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1]["end"] = above["end"]
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            loss = {"start": start + a, "end": start + b} if role == "assistant" else None
            self.nodes.append({"start": start, "end": end, "parent": parent, "position": position, "attends": attends, "loss": loss})
            self.path.append(((role, text), len(self.nodes) - 1))
            self.parts.append(formatted)
            self.size = end
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def row(self) -> dict:
        return {"text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


def packs(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = PACK) -> DataFrame:
    """Packs: ``text``, ``nodes`` in depth-first order, ``leaves`` (conversation to last node)."""
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = conversations.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    convs = convs.withColumn("keys", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range keys are bounded: the first turns and a hash of all; within a partition all turns count
    firsts = [F.get("keys", i) for i in range(3)]
    convs = convs.repartitionByRange(n, *firsts, F.xxhash64("keys"), "conv_id").sortWithinPartitions("keys", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text", pa.string()), ("nodes", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("loss", pa.struct([("start", pa.int32()), ("end", pa.int32())]))]))), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])
        open_ = _Pack()
        for batch in batches:
            for key, turns in zip(batch.column(0), batch.column(1), strict=True):
                open_.add(key.as_py(), [(t["role"], t["text"]) for t in turns.as_py()])
                if open_.size >= size:
                    yield pa.RecordBatch.from_pylist([open_.row()], schema)
                    open_ = _Pack()
        if open_.leaves:
            yield pa.RecordBatch.from_pylist([open_.row()], schema)

    return convs.select("conv_id", "turns").mapInArrow(pack, PACKS)


def digest(packed: DataFrame) -> DataFrame:
    """What the contract asks of each conversation, read back from the packs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        for batch in batches:
            rows = []
            for text, nodes, leaves in zip(*batch.columns, strict=True):
                text, nodes = text.as_py(), nodes.as_py()
                turns = [read_turn(text[n["start"] : n["end"]]) for n in nodes]
                for leaf in leaves.as_py():
                    path, at = [], leaf["node"]
                    while at >= 0:
                        path.append(at)
                        at = nodes[at]["parent"]
                    path.reverse()
                    last = nodes[path[-1]] if path else None
                    whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                    for i in path:
                        whole.update("{}\n{}\n".format(*turns[i]).encode("utf-8", "surrogatepass"))
                        if mask := nodes[i]["loss"]:
                            spoken = unescaped(text[mask["start"] : mask["end"]])
                            loss.update(spoken.encode("utf-8", "surrogatepass"))
                            chars += len(spoken)
                    rows.append((leaf["conv_id"], len(path), whole.hexdigest(), chars, loss.hexdigest(), last["position"] + last["end"] - last["start"] if last else 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], [*types])

    return packed.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
