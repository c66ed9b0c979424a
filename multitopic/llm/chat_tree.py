r"""Chat formatting as packed prefix trees.

Conversations that begin with the same turns share those turns' tokens. Each
turn has a key chained over all turns before it, so the keys of a
conversation are its path in the prefix tree of all conversations. Sorting by
(path, id), which Spark does as a range partitioning that can cut anywhere,
also between equal conversations, is the depth-first order of the tree. Each task walks its
part of that order and fills packs of about ``pack_tokens`` tokens: a turn
already in the pack is not written again. A pack holds

* ``tokens``, ``position_ids`` (a turn's positions go on from its parent's end),
* ``nodes``: per turn its token range, its parent and the range under the loss mask,
* ``attend``: per turn the merged token intervals of its ancestors and itself;
  a token sees those intervals up to its own place, nothing else of the pack,
* ``ends``: per conversation its id and its last turn.

Template of a turn: ``<|turn|>role\ntext<|end|>\n``. In roles and texts a
backslash becomes two, and a backslash goes behind the first character of
every control string (``CONTROL``); in roles a line break becomes ``\n``. So
no control string is left inside a text, and the original comes back exactly.
Marks and text are tokenised apart, so the loss mask (assistant texts) lies on
token borders.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), ties by role and text; repeated rows are turns of their own; a null
id is a conversation of its own; an empty table gives an empty result; further
columns are ignored. A turn longer than a pack gets a longer pack. Memory is
bounded by one pack and one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PACK_TOKENS = 8192
#: conversations that end in one pack at most
PACK_ENDS = 4096
CONTROL = [
    "<|turn|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|user|>", "<|assistant|>", "<|system|>",
    "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
#: the conversation that every run formats beside the table's own
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"

_MARK = re.compile(r"([<\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_UNMARK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNMARK.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def turn_parts(role: str | None, text: str | None) -> tuple[str, str, str]:
    """Formatted turn as head, text and tail."""
    return f"<|turn|>{escape(role or '').replace(chr(10), chr(92) + 'n')}\n", escape(text or ""), "<|end|>\n"


def read_turn(formatted: str) -> tuple[str, str]:
    """``(role, text)`` of one formatted turn."""
    if not (formatted.startswith("<|turn|>") and formatted.endswith("<|end|>\n")):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len("<|turn|>") : -len("<|end|>\n")].partition("\n")
    return unescape(role), unescape(text)


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def conversation_paths(turns: DataFrame) -> DataFrame:
    """``(path, conv_id, roles, texts)``: one row per conversation; the path
    is 16 bytes per turn."""
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                key, path = b"", []
                for role, text in zip(roles, texts, strict=True):
                    head = role.encode()
                    key = hashlib.blake2b(b"%s%d %s%s" % (key, len(head), head, text.encode()), digest_size=16).digest()
                    path.append(key)
                out.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *b.columns], names=["path", *b.schema.names])

    return whole.mapInArrow(paths, "path binary, conv_id bigint, roles array<string>, texts array<string>")


PACK_SCHEMA = (
    "tokens array<int>, position_ids array<int>, "
    "nodes array<struct<parent:int,start:int,end:int,loss_start:int,loss_end:int>>, "
    "attend array<array<struct<start:int,end:int>>>, ends array<struct<conv_id:bigint,node:int>>"
)
_NODE = pa.struct([(k, pa.int32()) for k in ("parent", "start", "end", "loss_start", "loss_end")])
_PACK = pa.schema([
    ("tokens", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("nodes", pa.list_(_NODE)),
    ("attend", pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))),
    ("ends", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))),
])


class Pack:
    """Tokens of a part of the tree, each turn once."""

    def __init__(self):
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.nodes: list[dict] = []
        self.attend: list[list[dict]] = []
        self.ends: list[dict] = []

    def add(self, parent: int, parts: tuple[list[int], list[int], list[int]], loss: bool) -> int:
        head, text, tail = parts
        start, at = len(self.tokens), self.positions[self.nodes[parent]["end"] - 1] + 1 if parent >= 0 else 0
        for x in parts:
            self.tokens += x
        end = len(self.tokens)
        self.positions += range(at, at + end - start)
        a = start + len(head)
        self.nodes.append({"parent": parent, "start": start, "end": end, "loss_start": a, "loss_end": a + len(text) if loss else a})
        seen = [dict(x) for x in self.attend[parent]] if parent >= 0 else []
        if seen and seen[-1]["end"] == start:
            seen[-1]["end"] = end
        else:
            seen.append({"start": start, "end": end})
        self.attend.append(seen)
        return len(self.nodes) - 1

    def row(self) -> dict:
        return {"tokens": self.tokens, "position_ids": self.positions, "nodes": self.nodes, "attend": self.attend, "ends": self.ends}


def pack_trees(turns: DataFrame, tokenizer: str = TOKENIZER, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """Packs of the conversations in ``turns (conv_id, turn, role, text)``."""
    rows = materialize(conversation_paths(turns), "paths")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_tokenizer(tokenizer)
        encode = lambda texts: [x.ids for x in coder.encode_batch(texts, add_special_tokens=False)]
        pack = Pack()
        stack: list[tuple[bytes, int, tuple]] = []  # path of the conversation before: key, node, tokens
        for b in batches:
            for path, conv, roles, texts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                keys = [path[i : i + 16] for i in range(0, len(path), 16)]
                same = 0
                while same < min(len(keys), len(stack)) and stack[same][0] == keys[same]:
                    same += 1
                del stack[same:]
                texts_new = [p for r, t in zip(roles[same:], texts[same:], strict=True) for p in turn_parts(r, t)]
                ids = encode(texts_new)
                fresh = [tuple(ids[i : i + 3]) for i in range(0, len(ids), 3)]
                size = sum(len(x) for p in fresh for x in p)
                if pack.ends and (len(pack.tokens) + size > pack_tokens or len(pack.ends) >= PACK_ENDS):
                    yield pa.RecordBatch.from_pylist([pack.row()], schema=_PACK)
                    pack = Pack()
                    again, stack = stack, []
                    for k, (key, _, p) in enumerate(again):
                        stack.append((key, pack.add(stack[-1][1] if stack else -1, p, roles[k] == "assistant"), p))
                for k, p in enumerate(fresh, same):
                    stack.append((keys[k], pack.add(stack[-1][1] if stack else -1, p, roles[k] == "assistant"), p))
                pack.ends.append({"conv_id": conv, "node": stack[-1][1]})
        if pack.ends:
            yield pa.RecordBatch.from_pylist([pack.row()], schema=_PACK)

    return ordered.mapInArrow(fill, PACK_SCHEMA)


def read_conversations(packs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per conversation, from what its last token attends to: n_turns, the
    turns' and the loss text's digests, loss and formatted characters."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load_tokenizer(tokenizer)
        decode = lambda ids: coder.decode(ids, skip_special_tokens=False)
        for b in batches:
            for pack in b.to_pylist():
                tokens, nodes, got, result = pack["tokens"], pack["nodes"], {}, {}
                out = []
                for end in pack["ends"]:
                    leaf = end["node"]
                    if leaf not in result:
                        result[leaf] = _conversation(leaf, nodes, pack["attend"][leaf], pack["position_ids"], tokens, decode, got)
                    out.append((end["conv_id"], *result[leaf]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                    names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    return packs.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _conversation(leaf: int, nodes, attend, positions, tokens, decode, got: dict) -> tuple:
    path = []
    while leaf >= 0:
        path.append(leaf)
        leaf = nodes[leaf]["parent"]
    path.reverse()
    seen = [i for x in attend for i in range(x["start"], x["end"])]
    if [positions[i] for i in seen] != list(range(len(seen))) or len(seen) != sum(nodes[k]["end"] - nodes[k]["start"] for k in path):
        raise ValueError("attention intervals are not the conversation's tokens in order")
    turns, loss = hashlib.sha256(), hashlib.sha256()
    loss_chars = formatted = 0
    for k in path:
        if k not in got:
            n = nodes[k]
            whole = decode(tokens[n["start"] : n["end"]])
            got[k] = (len(whole), *read_turn(whole), unescape(decode(tokens[n["loss_start"] : n["loss_end"]])))
        size, role, text, under = got[k]
        formatted += size
        turns.update(f"{role}\n{text}\n".encode())
        loss.update(under.encode())
        loss_chars += len(under)
    return len(path), turns.hexdigest(), loss_chars, loss.hexdigest(), formatted


def with_probe(turns: DataFrame) -> DataFrame:
    probe = [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)]
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.unionByName(turns.sparkSession.createDataFrame(probe, "conv_id bigint, turn bigint, role string, text string"))


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return read_conversations(materialize(pack_trees(turns), "packs"))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(17 + length(replace({_sql_escape('role')}, chr(10), '\\n')) + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
