"""A trie of conversation prefixes, from adaptive radix trees over turn ids of fixed width.

A turn becomes WIDTH bytes: 16 of a digest of its role and text, and 4 of the text's length, both big-endian, so
a conversation is a byte string and equal prefixes are equal bytes. Tasks hold adaptive radix trees (nodes of 4,
16, 48 or 256 children, paths without branches compressed) over sorted ranges of these strings; only depths at
the end of a turn give nodes of the trie, also inside compressed paths. What several tasks know of a node is added
up by its id, so no node, however common, needs one task.

Long conversations are cut into segments of TURNS turns: a segment is the key, and the id of the node it begins at
says which tree it belongs to. Sums over a node's subtree are sums over its members: a conversation owns the
nodes of which it is the smallest member, and these are the end of its path. So every saved character and every
leaf is counted once, as a weight of the conversation that owns it, and a second pass over the trees adds the
weights; nothing runs level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.llm.common import crc32_sql
from leadflow.plans.session import materialise

WIDTH = 20
TURNS = 256
#: Turns that come in a row from one task of the first pass; keys and bytes that one tree holds.
RUN, TREE_KEYS, TREE_BYTES = 1024, 20_000, 16 << 20
ROOT = bytes(16)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Text of one row of members on their way to a digest.
BLOCK_CHARS = 1 << 16


class Small:
    """A node with up to 4 or 16 children: two lists side by side."""

    __slots__ = ("bytes", "nodes")
    most = 4

    def __init__(self):
        self.bytes, self.nodes = bytearray(), []

    def get(self, b: int):
        at = self.bytes.find(b)
        return self.nodes[at] if at >= 0 else None

    def put(self, b: int, node) -> "Small | Indexed | Full":
        at = self.bytes.find(b)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.most:
            return larger(self).put(b, node)
        self.bytes.append(b)
        self.nodes.append(node)
        return self

    def items(self):
        return zip(self.bytes, self.nodes)


class Medium(Small):
    __slots__ = ()
    most = 16


class Indexed:
    """A node with up to 48 children: a table of 256 places in their list."""

    __slots__ = ("place", "nodes")
    most = 48

    def __init__(self):
        self.place, self.nodes = bytearray(256), []

    def get(self, b: int):
        at = self.place[b]
        return self.nodes[at - 1] if at else None

    def put(self, b: int, node):
        if self.place[b]:
            self.nodes[self.place[b] - 1] = node
            return self
        if len(self.nodes) == self.most:
            return larger(self).put(b, node)
        self.nodes.append(node)
        self.place[b] = len(self.nodes)
        return self

    def items(self):
        return ((b, self.nodes[at - 1]) for b, at in enumerate(self.place) if at)


class Full:
    """A node with up to 256 children, one place for each byte."""

    __slots__ = ("nodes",)
    most = 256

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, b: int):
        return self.nodes[b]

    def put(self, b: int, node):
        self.nodes[b] = node
        return self

    def items(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


def larger(old):
    """The next layout, with the same children."""
    new = {Small: Medium, Medium: Indexed, Indexed: Full}[type(old)]()
    for b, n in old.items():
        new.put(b, n)
    return new


class Node:
    """`path`: the bytes that lead here from the parent, its own first one included; values: those of all keys at or below it."""

    __slots__ = ("path", "children", "values")

    def __init__(self, path: bytes, values):
        self.path, self.children, self.values = path, Small(), values


class RadixTree:
    """Keys with values, which `add` puts together along the path of a key."""

    def __init__(self, add):
        self.add, self.root, self.keys, self.bytes = add, Node(b"", None), 0, 0

    def insert(self, key: bytes, values) -> None:
        add, node, at = self.add, self.root, 0
        self.keys, self.bytes = self.keys + 1, self.bytes + len(key)
        node.values = values if node.values is None else add(node.values, values)
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children = node.children.put(key[at], Node(key[at:], values))
                return
            path = child.path
            if key.startswith(path, at):
                child.values, node, at = add(child.values, values), child, at + len(path)
                continue
            same, most = 1, min(len(path), len(key) - at)
            while same < most and path[same] == key[at + same]:
                same += 1
            fork = Node(path[:same], add(child.values, values))
            child.path = path[same:]
            fork.children.put(child.path[0], child)
            node.children = node.children.put(key[at], fork)
            if at + same < len(key):
                fork.children.put(key[at + same], Node(key[at + same :], values))
            return

    def nodes(self) -> Iterator[tuple[bytes, object]]:
        """(bytes from the root, values) of every depth that ends a turn, the root's included, parents first."""
        stack = [(b"", self.root)]
        while stack:
            above, node = stack.pop()
            key = above + node.path
            first = len(above) - len(above) % WIDTH + WIDTH
            if not key and node.values is not None:
                yield key, node.values
            for end in range(first, len(key) + 1, WIDTH):
                yield key[:end], node.values
            stack.extend((key, child) for _, child in node.children.items())


def node_id(begin: bytes, inside: bytes) -> bytes:
    """The id of the node that `inside` (turn ids) leads to from the node `begin`."""
    return hashlib.blake2b(begin + hashlib.blake2b(inside, digest_size=16).digest(), digest_size=16).digest() if inside else begin


def chars_of(ids: bytes) -> list[int]:
    return [int.from_bytes(ids[i - 4 : i], "big") for i in range(WIDTH, len(ids) + 1, WIDTH)]


def turns(conversations: DataFrame) -> DataFrame:
    """{conv_id, turn, role, text} of rows with a conversation; nulls of role and text are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role").alias("role"), text("text").alias("text"))


def _runs(rows: DataFrame) -> DataFrame:
    """{conv_id, part, k, n, ids}: the turn ids of each conversation in order, in rows of up to RUN turns; (part, k) puts a conversation's rows in order.

    Rows are cut into ranges of (conversation, turn), so a long conversation spans tasks; ties of turns follow role and text."""
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head")]
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    wide = rows.select("*", F.substring("text", 1, 64).alias("head"), F.concat(F.unhex(F.substring(digest, 1, 32)), F.unhex(F.lpad(F.hex(F.length("text").cast("long")), 8, "0"))).alias("id"))
    dealt = wide.repartitionByRange(*key).sortWithinPartitions(*key[:3], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ids, k, out = None, [], 0, []

        def rows_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["conv_id", "part", "k", "n", "ids"])

        part = -1
        for batch in batches:
            for p, c, i in zip(batch.column("part").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("id").to_pylist()):
                if ids and (c != conv or len(ids) == RUN):
                    out.append((conv, part, k, len(ids), b"".join(ids)))
                    k, ids = k + 1, []
                conv, part = c, p
                ids.append(i)
            if len(out) > 2000:
                yield rows_of(out)
                out = []
        if ids:
            out.append((conv, part, k, len(ids), b"".join(ids)))
        if out:
            yield rows_of(out)

    return dealt.select(F.spark_partition_id().alias("part"), "conv_id", "id").mapInArrow(run, "conv_id long, part int, k long, n long, ids binary")


def rebuilt(conversations: DataFrame, block: int = 100, shares: int = 6) -> DataFrame:
    """{conv_id, seg, ids, turns}: segment `seg` of the rebuilt conversation, and how many turns that has in all.

    A conversation c begins with the first h = crc32(c) % shares turns of conversation c - c % block, and goes on with its
    own turns after its first h. One without any has an empty segment 0."""
    runs = materialise(_runs(turns(conversations)), "trie-runs")
    whole = W.partitionBy("conv_id")
    # without the ids: a row for RUN turns
    slim = runs.select("conv_id", "part", "k", "n").withColumn("at", F.coalesce(F.sum("n").over(whole.orderBy("part", "k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = runs.join(slim.select("conv_id", "part", "k", "at"), ["conv_id", "part", "k"])
    most = shares - 1
    early = placed.where((F.col("conv_id") % block == 0) & (F.col("at") < most))
    part = F.struct("at", F.substring("ids", F.lit(1), ((F.lit(most) - F.col("at")) * WIDTH).cast("int")).alias("ids"))
    joined = F.aggregate(F.array_sort(F.collect_list(part)), F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"]))
    heads = early.groupBy(F.col("conv_id").alias("base")).agg(joined.alias("head"))  # most rows of most turns each
    sizes = slim.groupBy("conv_id").agg(F.sum("n").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares).alias("h")
    known = sizes.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % block).alias("base")).join(heads, "base", "left")
    head = F.substring(F.coalesce("head", F.unhex(F.lit(""))), F.lit(1), (F.col("h") * WIDTH).cast("int"))
    known = known.withColumn("head", head).withColumn("b", (F.octet_length("head") / WIDTH).cast("long"))
    known = known.select("conv_id", "h", "head", "b", (F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    skip = F.least(F.greatest(F.col("h") - F.col("at"), F.lit(0)), F.col("n"))
    rest = F.expr(f"substring(ids, cast(skip * {WIDTH} + 1 as int), cast((n - skip) * {WIDTH} as int))")
    own = placed.join(known.select("conv_id", "h", "b", "turns"), "conv_id").withColumn("skip", skip).select("conv_id", "turns", (F.greatest("at", "h") - F.col("h") + F.col("b")).alias("at"), rest.alias("ids")).where("octet_length(ids) > 0")
    first = known.select("conv_id", "turns", F.lit(0).cast("long").alias("at"), F.col("head").alias("ids"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, total, at, ids in zip(*(col.to_pylist() for col in batch.columns)):
                start = 0
                while start < len(ids) or not (start or ids):
                    take = (TURNS - at % TURNS) * WIDTH
                    out.append((c, total, at // TURNS, at, ids[start : start + take]))
                    start, at = start + take, at + take // WIDTH
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["conv_id", "turns", "seg", "at", "ids"])

    pieces = first.unionByName(own).mapInArrow(cut, "conv_id long, turns long, seg long, at long, ids binary")
    # the pieces of a segment hold TURNS turns together
    ids = F.aggregate(F.array_sort(F.collect_list(F.struct("at", F.octet_length("ids").alias("size"), "ids"))), F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("conv_id", "seg").agg(F.first("turns").alias("turns"), ids.alias("ids"))


def _linked(segments: DataFrame) -> DataFrame:
    """segments with `begin` (id of the node before), `before` (characters up to it), `end` (id of the node after) and
    `chars` (of the segment). Only what is longer than a segment is put in order, without its ids."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            inner = [hashlib.blake2b(x, digest_size=16).digest() for x in ids]
            end = [node_id(ROOT, x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inner, pa.binary()), pa.array(end, pa.binary()), pa.array([sum(chars_of(x)) for x in ids], pa.int64())], names=[*batch.schema.names, "inner", "end", "chars"])

    marked = materialise(segments.select("conv_id", "seg", "turns", "ids").mapInArrow(marks, "conv_id long, seg long, turns long, ids binary, inner binary, end binary, chars long"), "trie-segments")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begin, before = None, ROOT, 0
        for batch in batches:
            out = []
            for c, s, inner, chars in zip(*(col.to_pylist() for col in batch.columns)):
                if c != conv:
                    conv, begin, before = c, ROOT, 0
                end = hashlib.blake2b(begin + inner, digest_size=16).digest()
                out.append((c, s, begin, before, end))
                begin, before = end, before + chars
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names=["conv_id", "seg", "begin", "before", "end"])

    long = F.col("turns") > TURNS
    order = marked.where(long).select("conv_id", "seg", "inner", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    more = order.mapInArrow(chain, "conv_id long, seg long, begin binary, before long, end binary")
    one = marked.where(~long).select("conv_id", "seg", "turns", "ids", "chars", F.lit(ROOT).alias("begin"), F.lit(0).cast("long").alias("before"), "end")
    many = marked.where(long).drop("inner", "end").join(more, ["conv_id", "seg"])
    return materialise(one.unionByName(many.select(*one.columns)), "trie-linked")


NODE = "id binary, parent binary, depth long, chars long, before long, "


def _trees(keys: DataFrame, names: list[str], add, shape: bool) -> DataFrame:
    """Partial nodes of radix trees over keys {begin, seg, before, ids, *names}: id and the values of each task's keys under
    it; with `shape` also parent, depth, characters of the last turn and of the turns above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {}

        def emit() -> Iterator[pa.RecordBatch]:
            out = []
            for (begin, seg, before), tree in at.items():
                length = {}
                for key, values in tree.nodes():
                    if not key:
                        length[key] = (begin, before)
                        if seg == 0:
                            out.append((begin, None, 0, 0, 0, *values) if shape else (begin, *values))
                        continue
                    own = node_id(begin, key)
                    if shape:
                        above, sofar = length[key[:-WIDTH]]
                        n = int.from_bytes(key[-4:], "big")
                        length[key] = (own, sofar + n)
                        out.append((own, above, seg * TURNS + len(key) // WIDTH, n, sofar, *values))
                    else:
                        out.append((own, *values))
                    if len(out) >= 8192:
                        yield rows_of(out)
                        out = []
            at.clear()
            if out:
                yield rows_of(out)

        types = [pa.binary(), *([pa.binary(), pa.int64(), pa.int64(), pa.int64()] if shape else []), *[pa.int64()] * len(names)]
        titles = ["id", *(["parent", "depth", "chars", "before"] if shape else []), *names]

        def rows_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=titles)

        held = size = 0
        for batch in batches:
            for begin, seg, before, ids, *values in zip(*(c.to_pylist() for c in batch.columns)):
                tree = at.setdefault((begin, seg, before), None) or RadixTree(add)
                at[begin, seg, before] = tree
                tree.insert(ids, tuple(values))
                held, size = held + 1, size + len(ids)
                if held >= TREE_KEYS or size >= TREE_BYTES:
                    yield from emit()
                    held = size = 0
        yield from emit()

    kept = keys.select("begin", "seg", "before", "ids", *names).repartitionByRange("begin", "ids").sortWithinPartitions("begin", "ids")
    return kept.mapInArrow(run, (NODE if shape else "id binary, ") + ", ".join(f"{n} long" for n in names))


def _ends(linked: DataFrame) -> DataFrame:
    """{id, ends_sha256}: the digest of the ids, in order, of the conversations that end at a node. They are put into blocks
    of text by ranges; a node's blocks then run through its digest one after another, as a hash needs, never held together."""
    last = linked.where(F.col("seg") == F.when(F.col("turns") > 0, F.floor((F.col("turns") - 1) / TURNS)).otherwise(0)).select(F.col("end").alias("id"), "conv_id")
    sorted_ = last.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")

    def rows_of(out, types, names):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = (pa.binary(), pa.int64(), pa.string()), ["id", "first", "text"]
        node, first, held, size, out = None, None, [], 0, []
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (n != node or size > BLOCK_CHARS):
                    out.append((node, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    node, first = n, c
                held.append(str(c))
                size += len(held[-1]) + 1
                if len(out) >= 4096:
                    yield rows_of(out, types, names)
                    out = []
        if held:
            out.append((node, first, ",".join(held)))
        if out:
            yield rows_of(out, types, names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = (pa.binary(), pa.string()), ["id", "ends_sha256"]
        node, state = None, None
        for batch in batches:
            out = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if out:
                yield rows_of(out, types, names)
        if state is not None:
            yield rows_of([(node, state.hexdigest())], types, names)

    packed = sorted_.mapInArrow(blocks, "id binary, first long, text string")
    return packed.repartition("id").sortWithinPartitions("id", "first").select("id", "text").mapInArrow(digests, "id binary, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, block: int = 100, shares: int = 6) -> DataFrame:
    """conversations {conv_id, turn, role, text} -> one row per node of the trie of rebuilt conversations: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role, then text; a null role or text is empty; repeated rows are
    repeated turns. Rows with a null conv_id belong to no conversation. The root (depth 0) is there if any
    conversation is; an empty table gives an empty one. Other columns are not looked at.
    """
    linked = _linked(rebuilt(conversations, block, shares))
    totals = linked.groupBy("conv_id").agg(F.sum("chars").alias("total"))
    known = materialise(linked.join(totals, "conv_id").select("conv_id", "begin", "seg", "before", "ids", "total"), "trie-totals")
    group = ["begin", "seg", "before", "ids"]
    # equal segments are one key, so copies of a conversation are added up before any tree sees them
    first = known.groupBy(*group).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("total").alias("total"))
    partial = _trees(first, ["n_convs", "conv_id", "total"], lambda a, b: (a[0] + b[0], a[1] if a[1] < b[1] else b[1], a[2] + b[2]), True)
    nodes = materialise(partial.groupBy("id").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "chars", "before")], F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("total").alias("total")), "trie-nodes")

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _ends(linked)
    told = nodes.join(children, "id", "left").join(ends, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told = materialise(told.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))), "trie-told")
    # a conversation owns the end of its path, from the node where it becomes the smallest member
    owners = told.groupBy("conv_id").agg(F.min("before").alias("owned_from"), F.max(F.col("n_children") == 0).cast("long").alias("leaves"))
    weights = owners.join(totals, "conv_id").select("conv_id", (F.col("total") - F.col("owned_from")).alias("owned"), "leaves", F.col("total").alias("own_total"))
    weights = materialise(weights, "trie-weights")
    second = known.join(weights.select("conv_id", "owned", "leaves"), "conv_id").groupBy(*group).agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves"))
    sums = _trees(second, ["owned", "leaves"], lambda a, b: (a[0] + b[0], a[1] + b[1]), False).groupBy("id").agg(F.sum("owned").alias("owned"), F.sum("leaves").alias("n_leaves"))

    above = told.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own = weights.select("conv_id", F.col("owned").alias("own_owned"), "own_total")
    out = told.join(sums, "id").join(above, "parent", "left").join(own, "conv_id")
    # characters of members below the node's parent, less those of distinct nodes there
    members = F.col("total") - F.col("n_convs") * F.col("before")
    distinct = F.col("owned") - F.col("own_owned") + F.col("own_total") - F.col("before")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), (members - distinct).cast("long").alias("saved_tokens"), "ends_sha256")


#: The same rows in DuckDB: prefixes as texts of digests, subtrees by what a prefix begins with.
NODES_SQL = f"""
WITH t AS (
  SELECT conv_id, sha256(coalesce(role, '') || chr(1) || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("cast(conv_id AS VARCHAR)")} % 6 AS h FROM t),
r AS (
  SELECT c.conv_id, t.no - 1000000000 AS o, t.id, t.chars FROM c JOIN t ON t.conv_id = c.base AND t.no <= c.h
  UNION ALL SELECT c.conv_id, t.no, t.id, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.no > c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(id, '') OVER w AS path, chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY o)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (
  SELECT path, any_value(p.depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (p.depth = e.depth), '')) AS ends_sha256
  FROM p JOIN e USING (conv_id) GROUP BY path),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (
  SELECT left(f.path, 64 * d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, cast(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
  FROM f, LATERAL (SELECT unnest(range(0, f.depth + 1)) AS d) GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n u ON f.depth > 0 AND u.path = left(f.path, length(f.path) - 64)
"""
