"""Operator 4: conversations formatted as packs of a prefix tree.

Conversations become paths of turns. Sorted by path over range partitions, conversations that share first turns lie side
by side, also those of a first turn that a third of all rows have, and equal ones are dealt out by id. Each task walks
its part of the tree depth-first: a turn's tokens are emitted once a pack, with their positions in the path, a loss mask
and, for each turn, the intervals of its ancestors' tokens that it attends to. A pack has a bounded number of tokens; the
next one starts with the ancestors again. unpacked() reads conversations back from the packs alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import prepared, table, text_bytes

#: Tokens and conversations of a pack, at most; one longer conversation is a pack of its own.
PACK_TOKENS, PACK_CONVERSATIONS = 1 << 15, 1000
#: Bytes of text that one task packs, about.
PART_BYTES = 32 << 20

#: The template's control strings; their ids follow the vocabulary's.
CONTROLS = ["[INST] ", " [/INST]", "</s>", "[ROLE] ", " [SAYS] ", " [/ROLE]"]

_ESCAPED = re.compile(r"[\\<\[]")
_BACK = re.compile(r"([\\<\[])\\")
_OPEN = re.compile(r"(?:[^\\<\[]|[\\<\[]\\)*")


def escape(text: str) -> str:
    r"""Puts a backslash after each \, < and [, so that no control string is left."""
    return _ESCAPED.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def turn_parts(role: str, text: str) -> list[tuple[str, bool]]:
    """A turn's control strings and escaped texts in order, with whether a part is under the loss mask."""
    if role == "user":
        return [(CONTROLS[0], False), (escape(text), False), (CONTROLS[1], False)]
    if role == "assistant":
        return [(escape(text), True), (CONTROLS[2], False)]
    return [(CONTROLS[3], False), (escape(role), False), (CONTROLS[4], False), (escape(text), False), (CONTROLS[5], False)]


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0

    def until(control: str) -> str:
        """The escaped text up to a control string, which is passed."""
        nonlocal at
        end = _OPEN.match(formatted, at).end()
        lead = len(control) - len(control.lstrip(" "))
        start, at = at, end - lead + len(control)
        if formatted[end - lead : at] != control:
            raise ValueError(f"no {control!r} in a formatted conversation")
        return unescape(formatted[start : end - lead])

    while at < len(formatted):
        if formatted.startswith(CONTROLS[0], at):
            at += len(CONTROLS[0])
            out.append(("user", until(CONTROLS[1])))
        elif formatted.startswith(CONTROLS[3], at):
            at += len(CONTROLS[3])
            role = until(CONTROLS[4])
            out.append((role, until(CONTROLS[5])))
        else:
            out.append(("assistant", until(CONTROLS[2])))
    return out


class _Vocabulary:
    def __init__(self, data: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.controls = {c: self.size + k for k, c in enumerate(CONTROLS)}
        self.pieces = [b""] * (self.size + len(CONTROLS))
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for c, i in self.controls.items():
            self.pieces[i] = c.encode()

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a turn."""
        ids, loss = [], []
        for k, (part, learnt) in enumerate(turn_parts(role, text)):
            own = [self.controls[part]] if self._is_control(role, k) else self.encoding.encode_ordinary(part)
            ids += own
            loss += [learnt] * len(own)
        return np.array(ids, "<u4"), np.array(loss, np.uint8)

    @staticmethod
    def _is_control(role: str, k: int) -> bool:
        return k == 1 if role == "assistant" else k % 2 == 0

    def text(self, ids: np.ndarray) -> str:
        return b"".join([self.pieces[i] for i in ids.tolist()]).decode()


_PACK = pa.schema([
    ("pack_id", pa.string()), ("ids", pa.binary()), ("positions", pa.binary()), ("loss", pa.binary()),
    ("node_start", pa.list_(pa.int32())), ("node_end", pa.list_(pa.int32())), ("node_parent", pa.list_(pa.int32())),
    ("attends", pa.list_(pa.list_(pa.int32()))), ("conversations", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int32())),
])
PACK_SCHEMA = "pack_id string, ids binary, positions binary, loss binary, node_start array<int>, node_end array<int>, node_parent array<int>, attends array<array<int>>, conversations array<bigint>, leaves array<int>"


class _Pack:
    """The part of the prefix tree that is being emitted."""

    def __init__(self) -> None:
        self.ids, self.loss, self.positions = [], [], []
        self.start, self.end, self.parent, self.attends = [], [], [], []
        self.conversations, self.leaves = [], []
        self.tokens = 0

    def node(self, ids: np.ndarray, loss: np.ndarray, parent: int) -> int:
        """Adds a turn below a node (-1: a first turn); its position goes on from the path above."""
        above = [] if parent < 0 else [*self.attends[parent]]
        if parent >= 0:
            if above and above[-1] == self.start[parent]:
                above[-1] = self.end[parent]
            else:
                above += [self.start[parent], self.end[parent]]
        first = sum(above[1::2]) - sum(above[::2])
        self.ids.append(ids)
        self.loss.append(loss)
        self.positions.append(np.arange(first, first + len(ids), dtype="<u4"))
        self.start.append(self.tokens)
        self.tokens += len(ids)
        self.end.append(self.tokens)
        self.parent.append(parent)
        self.attends.append(above)
        return len(self.start) - 1

    def batch(self, pack_id: str) -> pa.RecordBatch:
        row = [pack_id, *(np.concatenate(x).tobytes() if x else b"" for x in (self.ids, self.positions, self.loss)), self.start, self.end, self.parent, self.attends, self.conversations, self.leaves]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACK, strict=True)], schema=_PACK)


def _packer(vocabulary: Callable[[], tuple[bytes, str]], most_tokens: int, most_conversations: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _vocabulary(*vocabulary())
        pack, path, no = _Pack(), [], 0  # path: (role, text, ids, loss, node) from the root
        for batch in batches:
            for conversation, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                turns = [(t["role"], t["text"]) for t in turns]
                common = 0
                while common < min(len(turns), len(path)) and path[common][:2] == turns[common]:
                    common += 1
                made = [words.turn(*t) for t in turns[common:]]
                del path[common:]
                if pack.conversations and (pack.tokens + sum(len(i) for i, _ in made) > most_tokens or len(pack.conversations) >= most_conversations):
                    yield pack.batch(f"{TaskContext.get().partitionId()}-{no}")
                    pack, no, above = _Pack(), no + 1, -1
                    for k, (role, text, ids, loss, _) in enumerate(path):
                        above = pack.node(ids, loss, above)
                        path[k] = (role, text, ids, loss, above)
                for (role, text), (ids, loss) in zip(turns[common:], made, strict=True):
                    path.append((role, text, ids, loss, pack.node(ids, loss, path[-1][4] if path else -1)))
                pack.conversations.append(conversation)
                pack.leaves.append(path[-1][4] if path else -1)
        if pack.conversations:
            yield pack.batch(f"{TaskContext.get().partitionId()}-{no}")

    return run


@cache
def _vocabulary(data: bytes, pattern: str) -> _Vocabulary:
    return _Vocabulary(data, pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _shared(spark: SparkSession, ranks_path: str | None, pattern: str | None) -> Callable[[], tuple[bytes, str]]:
    path, own = (ranks_path, pattern) if ranks_path else default_ranks()
    with open(path, "rb") as f:
        kept = spark.sparkContext.broadcast((f.read(), own))
    return lambda: kept.value


def packed_conversations(rows: DataFrame, ranks_path: str | None = None, pattern: str | None = None, most_tokens: int = PACK_TOKENS, most_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """Packs of all conversations of the rows (conv_id, turn, role, text).

    ids, positions (unsigned 32 bit) and loss (a byte a token) are packed binaries, by token in depth-first order. A node is
    a turn: tokens node_start to node_end, its parent, and the flat starts and ends of the token intervals it attends to
    besides itself. conversations names the pack's conversations, leaves their last nodes. Turns are ordered by turn, role
    and text; repeated rows are turns of their own. A null role or text is empty. Nothing says that rows with a null conv_id belong
    together, so each is a conversation of one turn with a null id, and they are no group. An empty table gives no packs; a very long text is
    a turn as any other. Other columns are not read.
    """
    spark = prepared(rows.sparkSession)
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said"))
    paths = said.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    paths = paths.union(said.where("conv_id is null").select("conv_id", F.array("said")))
    key = F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0")), "")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(rows) // PART_BYTES))
    ordered = paths.withColumn("key", key).repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return ordered.select("conv_id", "turns").mapInArrow(_packer(_shared(spark, ranks_path, pattern), most_tokens, most_conversations), PACK_SCHEMA)


def unpacked(packs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(conv_id, turns, formatted, learnt) read back from packs: turns of role and text, the formatted text, and the unescaped
    text under the loss mask."""
    vocabulary = _shared(packs.sparkSession, ranks_path, pattern)
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(*vocabulary())
        for batch in batches:
            for row in batch.to_pylist():
                ids, loss = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["loss"], np.uint8) > 0
                columns = [[], [], [], []]
                for conversation, leaf in zip(row["conversations"], row["leaves"], strict=True):
                    spans = [*row["attends"][leaf], row["node_start"][leaf], row["node_end"][leaf]] if leaf >= 0 else []
                    at = np.concatenate([np.arange(a, b) for a, b in zip(spans[::2], spans[1::2], strict=True)]) if spans else np.zeros(0, np.int64)
                    formatted = words.text(ids[at])
                    turns = [{"role": r, "text": t} for r, t in parse_turns(formatted)]
                    for column, value in zip(columns, (conversation, turns, formatted, unescape(words.text(ids[at][loss[at]]))), strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.list_(turn), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turns", "formatted", "learnt"])

    return packs.mapInArrow(run, "conv_id long, turns array<struct<role string, text string>>, formatted string, learnt string")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all conversations, and one of control strings, read as when they are packed and unpacked."""
    odd = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read = unpacked(packed_conversations(rows.union(spark.createDataFrame(odd, rows.schema))))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op4_chat_format": op4_chat_format}
