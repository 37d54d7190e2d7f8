"""Chat formatting as prefix trees: conversations that begin alike share their first turns' tokens.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts a backslash is doubled and `<|`
becomes `<\\|`, a newline in a role becomes `\\n`: control strings never occur in them, and read_back() undoes it. The
two control strings are single ids after the vocabulary; the loss mask covers exactly the tokens of assistant texts.

Conversations are dealt out by ranges of their path (a chain of turn hashes, then the id), so that those that begin
alike are neighbours and a first turn, or a whole conversation, that a third of all rows share still spreads over many
tasks. A task walks its range depth-first and emits packs: token ids with each node's tokens once, position ids that
count along the path, the loss mask, nodes as intervals with the intervals of all their ancestors (what a token may
attend to besides the earlier tokens of its own node), and the conversations with their last nodes. A pack ends after
`most_tokens` tokens or `most_conversations`, and the next one begins with its path anew.

Turns are ordered by (turn, role, text); repeated rows are turns of their own. Null roles and texts are empty, rows with
a null conv_id make up one conversation with a null id, empty tables give no rows, other columns are ignored. One
conversation's turns are held in one task, since its digest is one sequence.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import common
from folioscope.llm.tokens import Encoder, byte_table

START, END = "<|im_start|>", "<|im_end|>"
PACK = (
    "pack_id long, tokens binary, positions binary, loss binary, node_start array<int>, node_end array<int>, node_parent array<int>, "
    "attends array<array<int>>, conv_ids array<long>, conv_nodes array<int>"
)
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, roles, texts, path): one row per conversation; path holds 8 bytes for each turn."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    grouped = grouped.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            paths = []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                chain, parts = hashlib.sha256(), []
                for role, text in zip(roles, texts, strict=True):
                    chain.update(f"{len(role)}:{role}{len(text)}:".encode("utf-8", "surrogatepass") + text.encode("utf-8", "surrogatepass"))
                    parts.append(chain.digest()[:8])
                paths.append(b"".join(parts))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.binary())], names=["conv_id", "roles", "texts", "path"])

        return work

    return common.map_batches(grouped, ["conv_id", "roles", "texts"], make, "conv_id long, roles array<string>, texts array<string>, path binary")


class _Pack:
    def __init__(self):
        self.tokens: list[bytes] = []
        self.loss: list[bytes] = []
        self.size = 0
        self.start: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []  # tokens before the node on its path
        self.conv_ids: list[int | None] = []
        self.conv_nodes: list[int] = []

    def add(self, parent: int, ids: bytes, loss: bytes) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + self.end[parent] - self.start[parent] if parent >= 0 else 0)
        self.start.append(self.size)
        self.size += len(ids) >> 2
        self.end.append(self.size)
        self.tokens.append(ids)
        self.loss.append(loss)
        return len(self.start) - 1

    def row(self, pack_id: int) -> list:
        positions = np.concatenate([np.arange(e - s, dtype="<u4") + d for s, e, d in zip(self.start, self.end, self.depth, strict=True)]) if self.start else np.zeros(0, "<u4")
        attends: list[list[int]] = []
        for s, e, p in zip(self.start, self.end, self.parent, strict=True):
            attends.append([*(attends[p] if p >= 0 else []), s, e])
        return [pack_id, b"".join(self.tokens), positions.astype("<u4").tobytes(), b"".join(self.loss), self.start, self.end, self.parent, attends, self.conv_ids, self.conv_nodes]


def _node(encoder: Encoder, role: str, text: str, control: int) -> tuple[bytes, bytes]:
    """Ids and loss mask of one formatted turn."""
    mark = np.asarray([control, control + 1], "<u4").tobytes()
    head, body = encoder.encode(escape(role, True) + "\n"), encoder.encode(escape(text))
    ids = mark[:4] + head + body + mark[4:] + encoder.newline
    n = len(body) >> 2
    return ids, b"\0" * (1 + (len(head) >> 2)) + (b"\1" if role == "assistant" else b"\0") * n + b"\0" * (1 + (len(encoder.newline) >> 2))


def pack(turns: DataFrame, tokenizer: str, most_tokens: int = 16384, most_conversations: int = 2048) -> DataFrame:
    """Packs of prefix trees, with the columns named in PACK."""
    dealt = ordered(turns).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches):
        encoder = common.worker_cache(("encoder", tokenizer), lambda: Encoder(tokenizer))
        control = encoder.tokenizer.get_vocab_size()
        names = [x.split()[0] for x in PACK.replace("array<array<int>>", "x").split(", ")]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64()), pa.list_(pa.int32())]
        now, number = _Pack(), TaskContext.get().partitionId() << 32
        path: list[tuple[str, str]] = []  # of the conversation before
        nodes: list[int] = []

        def batch_of(done: _Pack, number: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done.row(number), types, strict=True)], names=names)

        for batch in batches:
            for conv_id, roles, texts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = list(zip(roles.as_py(), texts.as_py(), strict=True))
                if now.conv_ids and (now.size >= most_tokens or len(now.conv_ids) >= most_conversations):
                    yield batch_of(now, number)
                    now, number, path, nodes = _Pack(), number + 1, [], []
                same = 0
                while same < min(len(path), len(own)) and path[same] == own[same]:
                    same += 1
                nodes = nodes[:same]
                for role, text in own[same:]:
                    nodes.append(now.add(nodes[-1] if nodes else -1, *_node(encoder, role, text, control)))
                path = own
                now.conv_ids.append(conv_id)
                now.conv_nodes.append(nodes[-1] if nodes else -1)
        if now.conv_ids:
            yield batch_of(now, number)

    return dealt.select("conv_id", "roles", "texts").mapInArrow(run, PACK)


def read_back(packs: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation of packs: conv_id, turns as (role, text), the loss text, and the formatted string's length."""
    schema = "conv_id long, roles array<string>, texts array<string>, loss_text string, formatted_chars long"

    def run(batches):
        table = common.worker_cache(("bytes", tokenizer), lambda: [*byte_table(tokenizer), START.encode(), END.encode()])
        for batch in batches:
            for row in batch.to_pylist():
                ids, loss, seen = np.frombuffer(row["tokens"], "<u4").tolist(), row["loss"], {}
                out: list[list] = [[] for _ in range(5)]
                for conv_id, node in zip(row["conv_ids"], row["conv_nodes"], strict=True):
                    if node not in seen:
                        spans = row["attends"][node]
                        path = [i for s, e in zip(spans[::2], spans[1::2], strict=True) for i in range(s, e)]
                        text = b"".join([table[ids[i]] for i in path]).decode("utf-8", "surrogatepass")
                        learnt = b"".join([table[ids[i]] for i in path if loss[i]]).decode("utf-8", "surrogatepass")
                        turns = [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(text)]
                        seen[node] = ([r for r, _ in turns], [t for _, t in turns], unescape(learnt), len(text))
                    for column, x in zip(out, (conv_id, *seen[node]), strict=True):
                        column.append(x)
                    if sum(map(len, out[3][-1:])) > 1 << 22 or len(out[0]) >= 256:
                        yield _read_batch(out)
                        out = [[] for _ in range(5)]
                if out[0]:
                    yield _read_batch(out)

    return packs.select("tokens", "loss", "attends", "conv_ids", "conv_nodes").mapInArrow(run, schema)


def _read_batch(out: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["conv_id", "roles", "texts", "loss_text", "formatted_chars"])


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
