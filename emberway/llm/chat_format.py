"""Chat formatting as a prefix tree: shared first turns are emitted once, depth first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberway.llm._store import written

# A turn is OPEN role BODY text CLOSE; control strings and their escapes.
OPEN, BODY, CLOSE = "<s>[TURN]", "[BODY]", "</s>"
ESCAPES = {
    "\\": "\\\\",
    "<s>": "\\s",
    "</s>": "\\e",
    "[TURN]": "\\t",
    "[BODY]": "\\b",
    "[INST]": "\\i",
    "[/INST]": "\\j",
    "<<SYS>>": "\\y",
    "<</SYS>>": "\\z",
    "<|im_start|>": "\\p",
    "<|im_end|>": "\\q",
    "<|endoftext|>": "\\x",
}
_CONTROL = re.compile("|".join(map(re.escape, sorted(ESCAPES, key=len, reverse=True))))
_BACK = {v: k for k, v in ESCAPES.items()}
_ESCAPED = re.compile("|".join(map(re.escape, _BACK)))
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}", re.DOTALL)

PACK = 1 << 16  #: characters that a pack aims at; only one longer conversation makes it longer
SEGMENTS = "pack string, node string, leaf boolean, seq_start long, seq_end long, pos_start long, text string, loss_start long, loss_end long, ancestors array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def turn_text(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{BODY}{escape(text)}{CLOSE}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def nodes(turns: DataFrame) -> DataFrame:
    """conv_id, keys, texts: a conversation's path in the tree; a key is a digest of all turns up to its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for conv in batch.column("turns").to_pylist():
                h, own, said = hashlib.sha256(), [], []
                for t in conv:
                    said.append(turn_text(t["role"], t["text"]))
                    h.update(f"{len(said[-1])} {said[-1]}".encode())
                    own.append(h.hexdigest()[:32])
                keys.append(own)
                texts.append(said)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(keys, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))], names=["conv_id", "keys", "texts"])

    text = lambda c: F.coalesce(c, F.lit(""))
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", text("role").alias("role"), text("text").alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    return convs.mapInArrow(run, "conv_id long, keys array<string>, texts array<string>")


def packs(paths: DataFrame, limit: int = PACK) -> DataFrame:
    """path, keys, texts, pack for each distinct path: subtrees that fit are binned, so that no pack outgrows the limit much.

    A path's pack root is its first node whose subtree has at most `limit` characters (else its
    last node). Subtrees under one parent share that parent's bins, ceil(weight / limit) of them
    by hash; the parent's own path is emitted in each of its packs. Weights are aggregates by
    node, of which a popular first turn is one.
    """
    paths = paths.withColumn("path", F.element_at("keys", -1))
    steps = paths.select("path", F.posexplode("keys").alias("depth", "key"), F.col("texts"))
    steps = steps.select("path", "depth", "key", F.length(F.col("texts")[F.col("depth")]).alias("n"))
    # characters below a node, its own among them; shared ones count once
    # written, so that joins by a key which very many paths share may be split among tasks
    own = written(steps.groupBy("key").agg(F.first("n").alias("n"), F.min("path").alias("any_path")), "own")
    below = steps.select("path", "key", "depth").join(own.select(F.col("key").alias("leaf_key"), "any_path", "n"), F.col("key") == F.col("leaf_key"))
    spent = below.withColumn("n", F.when(F.col("path") == F.col("any_path"), F.col("n")).otherwise(0))
    run = F.sum("n").over(W.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0))
    weight = written(spent.withColumn("w", run).groupBy("key").agg(F.sum("w").alias("weight")), "weights")
    weighed = below.select("path", "depth", "key").join(weight, "key").select("path", F.struct("depth", "key", "weight").alias("s"))
    total = F.lit(own.agg(F.sum("n")).first()[0] or 0)
    lists = weighed.groupBy("path").agg(F.sort_array(F.collect_list("s")).alias("s"))
    fits = F.filter("s", lambda s: s["weight"] <= limit)
    root = F.when(F.size(fits) > 0, fits[0]).otherwise(F.element_at("s", -1))
    lists = lists.withColumn("root", root)
    up = F.when(F.col("root.depth") > 0, F.col("s")[F.col("root.depth") - 1])
    bins = F.ceil(F.coalesce(up["weight"], total) / F.lit(limit))
    pack = F.concat_ws("/", F.coalesce(up["key"], F.lit("all")), F.pmod(F.xxhash64("root.key"), F.greatest(bins, F.lit(1))).cast("string"))
    return lists.select("path", pack.alias("pack")).join(paths.select("path", "keys", "texts"), "path")


def format_chats(turns: DataFrame, limit: int = PACK, loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Segments (SEGMENTS) of packed sequences, and the leaf (conv_id, pack, node) of every conversation.

    A segment is a turn that one or more conversations share, in the order of a depth-first walk:
    its characters are seq_start to seq_end of its pack; their positions go up from pos_start, the
    length of all turns before it in its conversation; it attends to its own characters up to the
    same one and to the intervals `ancestors`, its path's earlier turns (those side by side are one
    interval), and to nothing else. leaf: a conversation ends with it.
    loss_start to loss_end is the escaped text of a turn of loss_role (empty for other roles).

    Turns are sorted by turn (null last), role and text, so ties have one order; a null role or
    text is empty; repeated rows are repeated turns; rows of a null conv_id are one conversation;
    an empty table gives no rows. Equal conversations have one leaf. A conversation is built
    in one task; a popular first turn is not, as its subtree is cut into packs of about `limit`.
    """
    paths = written(nodes(turns), "paths")
    leaf = paths.select("conv_id", F.element_at("keys", -1).alias("node"))
    distinct = paths.groupBy(F.element_at("keys", -1).alias("k")).agg(F.first("keys").alias("keys"), F.first("texts").alias("texts")).drop("k")
    packed = written(packs(distinct, limit), "packs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen, at = None, {}, 0
        loss = OPEN + escape(loss_role) + BODY
        for batch in batches:
            rows = []
            for p, keys, texts in zip(*(batch.column(c).to_pylist() for c in ("pack", "keys", "texts"))):
                if p != pack:
                    pack, seen, at = p, {}, 0
                spans, pos = [], 0
                for depth, (key, text) in enumerate(zip(keys, texts)):
                    if (span := seen.get(key)) is None:
                        span = seen[key] = {"start": at, "end": at + len(text)}
                        counts = text.startswith(loss)
                        rows.append((p, key, depth == len(keys) - 1, at, at + len(text), pos, text, at + len(loss) if counts else at, at + len(text) - len(CLOSE) if counts else at, list(map(dict, spans))))
                        at += len(text)
                    if spans and spans[-1]["end"] == span["start"]:
                        spans[-1] = {"start": spans[-1]["start"], "end": span["end"]}
                    else:
                        spans.append(span)
                    pos += len(text)
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SEGMENTS.replace(",end:", "|").split(", ")])

    # sorted by path, a node's descendants follow it: depth first; a conversation that is another's beginning comes before it
    walk = packed.repartition("pack").sortWithinPartitions("pack", "keys").select("pack", "keys", "texts")
    return walk.mapInArrow(run, SEGMENTS), leaf.join(packed.select(F.col("path").alias("node"), "pack"), "node").select("conv_id", "pack", "node")


def read_back(segments: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """pack, node, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for every leaf, read from the packed sequences.

    A leaf's conversation is the characters of its ancestors' intervals and its own; turns are
    parsed from them, loss text is cut by the loss spans. A pack is read once, front to back.
    """
    schema = "pack string, node string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = ["pack", "node", "leaf", "seq_start", "text", "loss_start", "loss_end", "ancestors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, said, losses, place = None, [], [], {}
        for batch in batches:
            out = []
            for p, node, leaf, start, text, lo, hi, ancestors in zip(*(batch.column(c).to_pylist() for c in names)):
                if p != pack:
                    pack, said, losses, place = p, [], [], {}
                place[start] = len(said)
                said.append(text)
                losses.append(text[lo - start : hi - start])
                if not leaf:
                    continue
                path = []
                for a in ancestors:
                    at, i = a["start"], place[a["start"]]
                    while at < a["end"]:
                        path.append(i)
                        at, i = at + len(said[i]), i + 1
                path.append(place[start])
                whole, lost = "".join([said[i] for i in path]), "".join([unescape(losses[i]) for i in path])
                turns = parse(whole)
                digest = hashlib.sha256("".join([f"{r}\n{t}\n" for r, t in turns]).encode()).hexdigest()
                out.append((pack, node, len(turns), digest, len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(whole)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    rows = segments.repartition("pack").sortWithinPartitions("pack", "seq_start")
    return rows.select(*names).mapInArrow(run, schema)
