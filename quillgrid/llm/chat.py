"""Chat formatting into prefix-tree packs.

Template. A turn is ``### Role: text</turn>\\n``. ``user``, ``assistant`` and
``system`` stand capitalised; any other role stands as ``=role`` and a missing
one as ``~``. Inside texts and other roles a backslash becomes two, and each
``#`` that begins three, each ``</turn>`` and (in roles) each ``:`` gets a
backslash before it; undoing is dropping each such backslash.

Packs. Conversations are sorted by their turns, so that those with a common
beginning stand together; a pack is a run of them. A turn that several share is
one node, emitted once; nodes come depth-first. Each node has

    start, stop             its characters in the pack's text
    position                position id of its first character: the length of
                            the turns before it in its conversation
    attends                 intervals of the pack's text it may attend to: its
                            ancestors, touching ones merged, and itself
    loss_start, loss_stop   the characters under the loss mask (the text of an
                            assistant turn; otherwise empty)

Defined results: turns are ordered by (turn, role, text), null first; a null text
is empty; repeated rows are repeated turns; rows with a null conversation id are
one conversation. A conversation is one sequence and is put together in one task;
dealing by range of the whole path of turns and the id splits any common
beginning, and conversations that are all the same, over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the template.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
SPECIAL = regex.compile(r"\\|#(?=##)|</turn>")
ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)
TURN = regex.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", regex.DOTALL)


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def head(role: str | None) -> str:
    name = ROLES.get(role) if role is not None else "~"
    return HEAD + (name or "=" + escape(role).replace(":", "\\:")) + COLON


def role_of(name: str) -> str | None:
    if name == "~":
        return None
    return unescape(name[1:]) if name.startswith("=") else name.lower()


NODE = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("position", T.IntegerType()), T.StructField("loss_start", T.IntegerType()), T.StructField("loss_stop", T.IntegerType()),
    T.StructField("attends", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


class Pack:
    """One pack while it is filled."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.ids: list = []
        self.leaves: list[int] = []
        self.path: list[tuple[tuple, int]] = []

    def shared(self, turns: list[tuple]) -> int:
        n = 0
        for (turn, _), other in zip(self.path, turns, strict=False):
            if turn != other:
                break
            n += 1
        return n

    def add(self, name, turns: list[tuple]) -> None:
        del self.path[self.shared(turns) :]
        for role, text in turns[len(self.path) :]:
            parent = self.path[-1][1] if self.path else -1
            before, body = head(role), escape(text)
            start, stop = self.size, self.size + len(before) + len(body) + len(END)
            up = self.nodes[parent] if parent >= 0 else None
            sees = [list(x) for x in up["attends"]] if up else []
            if sees and sees[-1][1] == start:
                sees[-1][1] = stop
            else:
                sees.append([start, stop])
            loss = start + len(before)
            self.nodes.append({
                "start": start, "stop": stop, "parent": parent,
                "position": up["position"] + up["stop"] - up["start"] if up else 0,
                "loss_start": loss, "loss_stop": loss + len(body) if role == "assistant" else loss, "attends": sees,
            })
            self.parts += [before, body, END]
            self.size = stop
            self.path.append(((role, text), len(self.nodes) - 1))
        self.ids.append(name)
        self.leaves.append(self.path[-1][1])


def packs(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    pack_chars: int = 1_000_000, partitions: int | None = None,
) -> DataFrame:
    """Rows of (ids, leaves, text, nodes): a pack's conversations, the node at
    which each ends, the text and its nodes. A pack has at most ``pack_chars``
    characters unless a single conversation has more."""
    spark = conversations.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("_turn"),
    )
    whole = rows.groupBy("_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns")).withColumn(
        "_path", F.transform("_turns", lambda x: F.xxhash64(x["role"], x["text"]))
    )
    order = ("_path", F.col("_id").asc_nulls_first())
    dealt = whole.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select(
        "_id", F.col("_turns.role").alias("roles"), F.col("_turns.text").alias("texts")
    )
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(rows.schema["_id"].dataType)), T.StructField("leaves", T.ArrayType(T.IntegerType())),
        T.StructField("text", T.StringType()), T.StructField("nodes", T.ArrayType(NODE)),
    ])
    names = schema.names
    node_kind = pa.struct([(f, pa.int32()) for f in ("start", "stop", "parent", "position", "loss_start", "loss_stop")] + [("attends", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack()

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([pack.ids], pa.list_(kind)), pa.array([pack.leaves], pa.list_(pa.int32())), pa.array(["".join(pack.parts)], pa.string()), pa.array([pack.nodes], pa.list_(node_kind))],
                names,
            )

        for b in batches:
            kind = b.schema.field(0).type
            for name, roles, texts in zip(*(b.column(k) for k in range(3)), strict=True):
                turns = list(zip(roles.as_py(), texts.as_py(), strict=True))
                new = sum(len(t) + 24 for _, t in turns[pack.shared(turns) :])
                if pack.ids and pack.size + new > pack_chars:
                    yield full()
                    pack = Pack()
                pack.add(name.as_py(), turns)
        if pack.ids:
            yield full()

    return dealt.mapInArrow(run, schema)


def read_back(packed: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the packs alone: the id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. A conversation's text is what its
    last node attends to; the turns come from parsing it."""
    schema = T.StructType([
        T.StructField(id_col, packed.schema["ids"].dataType.elementType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, leaves, text, nodes in zip(*(b.column(c) for c in ("ids", "leaves", "text", "nodes")), strict=True):
                text, nodes = text.as_py(), nodes.as_py()
                out: tuple[list, ...] = ([], [], [], [], [])
                for leaf in leaves.as_py():
                    formatted = "".join(text[x:y] for x, y in nodes[leaf]["attends"])
                    turns, at = [], 0
                    while at < len(formatted):
                        m = TURN.match(formatted, at)
                        turns.append((role_of(m[1]) or "", unescape(m[2])))
                        at = m.end()
                    masked, k = [], leaf
                    while k >= 0:
                        masked.append(unescape(text[nodes[k]["loss_start"] : nodes[k]["loss_stop"]]))
                        k = nodes[k]["parent"]
                    loss = "".join(reversed(masked))
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    for x, v in zip(out, (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)), strict=True):
                        x.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, *map(pa.array, out, kinds)], names)

    return packed.select("ids", "leaves", "text", "nodes").mapInArrow(run, schema)
