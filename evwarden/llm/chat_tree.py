"""Conversations as a prefix tree: shared first turns are stored once, depth first, with positions and what each turn attends to.

A node is a turn after certain earlier turns. The nodes of a tree (a root is a first turn) follow each other depth
first as one sequence of tokens: ``start`` is a node's place in it, ``position`` the place in the
conversation, and ``attends`` the intervals of the sequence that hold its ancestors. A token attends to
these and to the earlier tokens of its own node.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evwarden.llm.common import map_blocks, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The word pattern published with the vocabulary, and the template's control strings.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[:]")
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
LEARNED = "assistant"
# End of the fixed values.

_MARK = "|".join(re.escape(m[1:]) for m in MARKS)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_MARK})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_MARK})")


def escaped(text: str) -> str:
    """A backslash after the first character of each control string, one more where some stand there already."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """What the template puts before the text, the escaped text, and what it puts after it."""
    if role in ROLES:
        before, after = ROLES[role]
    else:
        before, after = f"[ROLE]{escaped(role)}[:]", "[/ROLE]"
    return before, escaped(text), after


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, (before, after) in ROLES.items():
        if turn.startswith(before):
            return role, unescaped(turn[len(before) : len(turn) - len(after)])
    role, _, text = turn[len("[ROLE]") : len(turn) - len("[/ROLE]")].partition("[:]")
    return unescaped(role), unescaped(text)


class Tokens:
    """Tokens of a byte-level vocabulary, each control string one further id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.first = max(ranks.values()) + 2
        self.encoding = tiktoken.Encoding("text", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = {m: self.first + i for i, m in enumerate(MARKS)}

    def mark(self, before: str) -> list[int]:
        """Tokens of a stretch of template: control strings, and a role between two of them."""
        if before in self.marks:
            return [self.marks[before]]
        inner = before[len("[ROLE]") : -len("[:]")]
        return [self.marks["[ROLE]"], *self.encoding.encode_ordinary(inner), self.marks["[:]"]]

    def text(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def read(self, tokens: list[int]) -> str:
        out, plain = [], []
        for t in tokens:
            if t >= self.first:
                out.append(self.encoding.decode_bytes(plain))
                out.append(MARKS[t - self.first].encode())
                plain = []
            else:
                plain.append(t)
        return (b"".join(out) + self.encoding.decode_bytes(plain)).decode()


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_PATH_BYTES = 8


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order with the hash of all turns so far; the last turn of a conversation also has its path through the tree."""
    from pyspark import TaskContext

    begun, number = False, TaskContext.get().partitionId() << 33
    conv, node, depth, path = None, b"", 0, bytearray()
    held: tuple | None = None
    for batch in batches:
        columns = [[] for _ in range(8)]
        for this, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not begun or this != conv:
                if held is not None:
                    _put(columns, held, bytes(path))
                    number += 1
                begun, conv, node, depth, path = True, this, b"", 0, bytearray()
            elif held is not None:
                _put(columns, held, None)
            parent = node
            node = hashlib.blake2b(parent + role.encode() + b"\0" + text.encode(), digest_size=16).digest()
            path += node[:_PATH_BYTES]
            held = (number, conv, depth, node, parent, role, text)
            depth += 1
        yield _batch(columns, batch.schema.field(0).type)
    if held is not None:
        columns = [[] for _ in range(8)]
        _put(columns, held, bytes(path))
        yield _batch(columns, batch.schema.field(0).type)


def _put(columns: list[list], turn: tuple, path: bytes | None) -> None:
    for column, value in zip(columns, (*turn, path)):
        column.append(value)


def _batch(columns: list[list], conv: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), conv, pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.binary()]
    names = ["c", "conv", "depth", "node", "parent", "role", "text", "path"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=names)


def _attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and ancestors' intervals of the nodes that a path owns, path by path in order of depth."""
    begun, last, position, spans = False, None, 0, []
    for batch in batches:
        nodes, positions, attends = [], [], []
        for path, node, owned, start, size in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if not begun or path != last:
                begun, last, position, spans = True, path, 0, []
            if owned:
                nodes.append(node)
                positions.append(position)
                attends.append([{"from": a, "to": b} for a, b in spans])
            position += size
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + size)
            else:
                spans.append((start, start + size))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(nodes, pa.binary()), pa.array(positions, pa.int64()),
                pa.array(attends, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
            ],
            names=["node", "position", "attends"],
        )


def prefix_tree(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trees, and which node each turn of each conversation is.

    Nodes: tree, node, parent (empty for roots), depth, start, position, tokens, learn_from, learn_to, attends.
    ``tokens[learn_from:learn_to]`` is what the loss counts: the text of assistants' turns. Turns: c, conv, depth, node.

    Rows are ordered by turn, then role and text, nulls first; equal rows are separate turns. Null roles and texts are empty;
    a null id is a conversation of its own. An empty table gives no nodes and no turns; other columns are not read.

    Conversations are sorted by their paths, so that those with the same first turns are neighbours at each
    depth; a node belongs to the first path through it, and the order by path and depth is depth first.
    A popular first turn is grouped with map-side combine, and its tree spans many tasks; only
    the turns of one conversation are read one after the other.
    """
    spark = conversations.sparkSession
    kind = conversations.schema[id_col].dataType.simpleString()
    df = conversations
    rows = df.select(
        df[id_col].alias("conv"), F.coalesce(df[role_col], F.lit("")).alias("role"), F.coalesce(df[text_col], F.lit("")).alias("text"), df[turn_col].alias("turn")
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    chained = rows.mapInArrow(_chain, f"c bigint, conv {kind}, depth bigint, node binary, parent binary, role string, text string, path binary")
    turns = stored(chained, "turns")

    leaves = turns.where("path is not null").select("c", F.col("node").alias("leaf"), "path")
    paths = leaves.groupBy("leaf").agg(F.min("path").alias("path"), F.min("c").alias("c"))
    paths = paths.repartitionByRange("path").sortWithinPartitions("path")
    paths = paths.select("c", "leaf", F.substring("path", 1, _PATH_BYTES).alias("tree")).withColumn("rank", F.monotonically_increasing_id())
    paths = stored(paths, "paths")
    ranked = leaves.select("c", "leaf").join(paths.select("leaf", "rank"), "leaf").select("c", "rank")
    owners = turns.select("c", "node").join(ranked, "c").groupBy("node").agg(F.min("rank").alias("owner"))
    first = turns.drop("path", "conv").join(paths.select("c", "rank", "tree"), "c")
    own = first.join(owners.select(F.col("node").alias("own_node"), "owner"), (F.col("node") == F.col("own_node")) & (F.col("rank") == F.col("owner")))
    nodes = stored(_tokenised(own.select("rank", "tree", "node", "parent", "depth", "role", "text"), vocabulary), "nodes")

    starts = stored(_starts(nodes, paths), "starts")
    known = starts.select("node", "start", "size", F.col("rank").alias("owner"))
    on_path = first.select("rank", "depth", "node").join(known, "node")
    on_path = on_path.repartition("rank").sortWithinPartitions("rank", "depth")
    seen = on_path.select("rank", "node", (F.col("rank") == F.col("owner")).alias("owned"), "start", "size").mapInArrow(
        _attention, "node binary, position bigint, attends array<struct<from: bigint, to: bigint>>"
    )
    nodes = nodes.join(starts.select("node", "start"), "node").join(seen, "node")
    nodes = nodes.select("tree", "node", "parent", "depth", "start", "position", "tokens", "learn_from", "learn_to", "attends")
    return stored(nodes, "tree"), turns.select("c", "conv", "depth", "node")


def _tokenised(nodes: DataFrame, vocabulary: str) -> DataFrame:
    sent = nodes.sparkSession.sparkContext.broadcast(ranks(vocabulary))
    made: list[Tokens] = []

    def run(block: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Tokens(sent.value))
        tokens, begin, end = [], [], []
        for role, text in zip(block["role"], block["text"]):
            before, middle, after = formatted(role, text)
            head, body, tail = made[0].mark(before), made[0].text(middle), made[0].mark(after)
            tokens.append(head + body + tail)
            begin.append(len(head) if role == LEARNED else 0)
            end.append(len(head) + len(body) if role == LEARNED else 0)
        kept = {k: block[k] for k in ("rank", "tree", "node", "parent", "depth")}
        return kept | {"tokens": tokens, "learn_from": begin, "learn_to": end}

    schema = "rank bigint, tree binary, node binary, parent binary, depth bigint, tokens array<int>, learn_from int, learn_to int"
    return map_blocks(nodes, run, schema)


def _starts(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, rank, start, size): places in the tree, from sums by part of the paths' order, by path and inside the path."""
    sized = nodes.select("rank", "tree", "depth", "node", F.size("tokens").cast("bigint").alias("size"))
    part = F.shiftright("rank", 33).alias("part")
    by_path = sized.groupBy("rank", "tree").agg(F.sum("size").alias("size")).select("*", part)
    by_part = by_path.groupBy("part").agg(F.sum("size").alias("size"))
    none = F.lit(0).cast("bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select(F.col("part"), F.coalesce(F.sum("size").over(before), none).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    by_path = by_path.withColumn("inner", F.coalesce(F.sum("size").over(inside), none)).join(by_part, "part")
    by_path = by_path.select("rank", "tree", (F.col("part_start") + F.col("inner")).alias("begin"))
    trees = by_path.groupBy("tree").agg(F.min("begin").alias("tree_begin"))
    by_path = by_path.join(trees, "tree").select("rank", (F.col("begin") - F.col("tree_begin")).alias("begin"))
    along = Window.partitionBy("rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("inner", F.coalesce(F.sum("size").over(along), none)).join(by_path, "rank")
        .select("node", "rank", (F.col("begin") + F.col("inner")).alias("start"), "size")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its turns in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    begun, state, conv, out = False, None, None, []
    types = None
    for batch in batches:
        types = [batch.schema.field(1).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for c, this, role, text, learned, chars, size in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if not begun or c != state[0]:
                if begun:
                    out.append(_row(conv, state))
                begun, conv, state = True, this, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += chars
            state[6] += size
        yield _rows(out, names, types)
        out = []
    if begun:
        yield _rows([_row(conv, state)], names, types)


def _row(conv: object, state: list) -> tuple:
    return (conv, state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6])


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def read_back(nodes: DataFrame, turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(c, conv, depth, role, text, learned, chars, size) of each turn, from the tree's tokens.

    ``learned`` is the text under the loss mask, ``chars`` the length of the formatted turn, ``size`` its tokens.
    """
    sent = nodes.sparkSession.sparkContext.broadcast(ranks(vocabulary))
    made: list[Tokens] = []

    def run(block: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Tokens(sent.value))
        turn = [made[0].read(t) for t in block["tokens"]]
        both = [parsed(t) for t in turn]
        learned = [unescaped(made[0].read(t[a:b])) for t, a, b in zip(block["tokens"], block["learn_from"], block["learn_to"])]
        return {
            "node": block["node"], "role": [r for r, _ in both], "text": [t for _, t in both], "learned": learned,
            "chars": [len(t) for t in turn], "size": [len(t) for t in block["tokens"]],
        }

    schema = "node binary, role string, text string, learned string, chars bigint, size bigint"
    read = map_blocks(nodes.select("node", "tokens", "learn_from", "learn_to"), run, schema)
    return turns.join(read, "node").select("c", "conv", "depth", "role", "text", "learned", "chars", "size")


def conversation_digests(nodes: DataFrame, turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens of each conversation, read back from the tree."""
    kind = turns.schema["conv"].dataType.simpleString()
    rows = read_back(nodes, turns, vocabulary).repartition("c").sortWithinPartitions("c", "depth")
    rows = rows.select("c", "conv", "role", "text", "learned", "chars", "size")
    return rows.mapInArrow(
        _digests,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint",
    )


def with_control_strings(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """The table and conversation -1, whose texts look like the template's own control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
