"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns are merged: in the order of their paths (a chained hash of the turns),
those that share a prefix are neighbours, and each is compared with the one before it, turn by turn. A tree is
emitted depth-first into packs, each shared turn once; a pack ends after `pack_chars` tokens, as training sequences
do, and the next one begins with the ancestors it needs. Tokens are code points of the formatted text. Each node
(turn) carries its place in the pack, the position id of its first token (position ids run on along a path, not
along the pack), the intervals of the pack that its tokens attend to (ancestors, then itself, causally), and the
interval under the loss mask (the text of an assistant's turn).

Template of a turn: `<|im_start|>role LF text<|im_end|>LF`. Inside texts and roles, `<`, any number of backslashes
and `|` get one more backslash, so no control string can stand there, and the change is undone exactly. In roles,
backslashes and line feeds are written `\\\\` and `\\n`.

Turns are ordered by turn, then role, then text; null texts and roles are empty, a null turn comes first. Rows with a
null id are one conversation. Repeated rows are repeated turns. Only the four named columns are read. A conversation
is one record: one task holds all its turns, as it does a document's text. An empty table gives no packs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

PACKS = (
    "tokens string, nodes array<struct<begin:long,end:long,parent:int,position:long,loss_begin:long,loss_end:long,attends:array<struct<begin:long,end:long>>>>, "
    "leaves array<struct<conv_id:long,node:int>>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        if not rest.endswith(END + "\n"):
            raise ValueError("a turn without its end")
        out.append((unescape_role(role), unescape(rest[: -len(END) - 1])))
    return out


class _Pack:
    """A pack in the making; path: the nodes from the root to the last conversation's leaf, with their turns."""

    def __init__(self):
        self.parts, self.size, self.nodes, self.leaves, self.path = [], 0, [], [], []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.path)) and self.path[same][1] == turns[same]:
            same += 1
        del self.path[same:]
        for role, text in turns[same:]:
            head = f"{START}{escape_role(role)}\n"
            body = escape(text)
            formatted = f"{head}{body}{END}\n"
            begin, end = self.size, self.size + len(formatted)
            up = self.path[-1][0] if self.path else -1
            above = self.nodes[up] if self.path else None
            seen = [dict(x) for x in above["attends"]] if above else []
            if seen and seen[-1]["end"] == begin:
                seen[-1]["end"] = end
            else:
                seen.append({"begin": begin, "end": end})
            said = role == "assistant"
            at = begin + len(head)
            self.nodes.append({"begin": begin, "end": end, "parent": up, "position": above["position"] + above["end"] - above["begin"] if above else 0, "loss_begin": at if said else begin, "loss_end": at + len(body) if said else begin, "attends": seen})
            self.path.append((len(self.nodes) - 1, (role, text)))
            self.parts.append(formatted)
            self.size = end
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][0]})

    def row(self) -> dict:
        return {"tokens": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


_NODE = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("loss_begin", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
_PACK = pa.schema([("tokens", pa.string()), ("nodes", pa.list_(_NODE)), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])


def pack(conversations: DataFrame, pack_chars: int = 1 << 16) -> DataFrame:
    """Packs of all conversations (columns conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for turns in part.column(1).to_pylist():
                    h, path = b"", []
                    for t in turns:
                        role, text = t["role"].encode(), t["text"].encode()
                        h = hashlib.blake2b(h + len(role).to_bytes(8, "big") + role + text, digest_size=8).digest()
                        path.append(h)
                    out.append(b"".join(path))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["conv_id", "turns", "path"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Pack()
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now.size >= pack_chars or len(now.leaves) >= pack_chars:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=_PACK)
                    now = _Pack()
                now.add(conv_id, [(t["role"], t["text"]) for t in turns])
        if now.leaves:
            yield pa.RecordBatch.from_pylist([now.row()], schema=_PACK)

    # the id follows the path in the order, so that many copies of a conversation are dealt to many tasks
    ordered = whole.mapInArrow(paths, "conv_id long, turns array<struct<role:string,text:string>>, path binary").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", "turns").mapInArrow(build, PACKS)


def read_back(packs: DataFrame) -> DataFrame:
    """Every conversation as its leaf attends to it: conv_id, formatted, turns, loss (the text under the loss mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for row in range(batch.num_rows):
                tokens, nodes, leaves = (batch.column(i)[row].as_py() for i in range(3))
                for at in range(0, len(leaves), 500):
                    ids, texts, turns, loss = [], [], [], []
                    for leaf in leaves[at : at + 500]:
                        node = nodes[leaf["node"]]
                        text = "".join(tokens[x["begin"] : x["end"]] for x in node["attends"])
                        said, up = [], leaf["node"]
                        while up >= 0:
                            n = nodes[up]
                            said.append(unescape(tokens[n["loss_begin"] : n["loss_end"]]))
                            up = n["parent"]
                        ids.append(leaf["conv_id"])
                        texts.append(text)
                        turns.append([{"role": r, "text": t} for r, t in parse(text)])
                        loss.append("".join(reversed(said)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(turns, kind), pa.array(loss, pa.string())], ["conv_id", "formatted", "turns", "loss"])

    return packs.mapInArrow(run, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss string")


def digest(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL over a relation `chats` (conv_id, turn, role, text) with the rows of digest(read_back(pack(...))).
DIGEST_SQL = r"""
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM chats) GROUP BY conv_id
"""
