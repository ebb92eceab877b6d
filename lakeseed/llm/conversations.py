"""Conversation prefix trie: what conversations share from their start, node by node.

A node of depth d is a distinct sequence of first d turns (role and text); the root has none. Conversations
that begin with it are its members, and what it saves is what a cache of prefixes would: for every node of its
subtree the words of the node's last text, once for every member but one.

* Turns are known by the first 16 bytes of their SHA-256 hash, so texts are read once and never exchanged. They are
  numbered in range parts, so a conversation of any length takes as many tasks as it needs, and strung in
  units of up to ``SEGMENT`` turns. A unit's trie hangs below the node where the unit before it ended.
* Units are range-partitioned in the order of their turns, then of their conversations; every ``SHARD`` of them
  in a row are a shard. A shard encodes its turns with a dictionary of its own and builds a ternary search
  tree: a node has its turn's number, the lesser and greater alternatives, and what follows. Sequences are
  inserted in median order, so the alternatives are balanced. The tree is traversed with a stack, and
  members, leaves and savings are added up from the last node to the first.
* Only nodes on a shard's first or last sequence can occur in other shards, and only those on full units go on in
  other units. These boundary nodes are merged by the hash of their path; all others are done in their shard.
  The sums below a boundary node are taken along witnesses, the conversations of these sequences: each
  boundary node counts with one witness, and a witness's running sums from its end add to its nodes.
* The conversations that end at a boundary node are hashed in a stream over their ids in order, so a third of
  all conversations may be copies of one.

A null role or text is empty. Turns are ordered by their number, null first, equal numbers by their hash.
Repeated rows are turns of their own. Rows without a conversation id are left out. Other columns are ignored; an
empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseed.operators.skew import ordered_scan
from lakeseed.workspace import stored

#: Every conversation starts with up to HEAD - 1 turns of the one whose id is the last multiple of BLOCK.
BLOCK, HEAD = 20, 4
#: Turns of a unit, units of a shard, and ids in a row of the list of a boundary node.
SEGMENT, SHARD, IDS = 64, 10_000, 500
WORD = r"[^\x20\x09-\x0D]+"
CLOSED, OPEN, WITNESS, ENDS = range(4)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, mark, words of every turn: no text is needed after this."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    # The size of the role tells where it ends.
    whole = F.concat_ws(":", F.octet_length(role), F.concat(role, text))
    mark = F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)
    rows = conversations.where("conv_id is not null")
    return rows.select("conv_id", "turn", mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, place, mark, words, total: the turns of the rebuilt conversations, and a row of place 0 for each."""
    rows = turns_of(conversations)
    sizes = stored(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    convs = sizes.select("conv_id", "n", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    bases = sizes.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("held"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("held", F.lit(0)).cast("long")))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    convs = convs.select("conv_id", "base", F.struct("head", "taken", "total").alias("known"))

    # The first row of a conversation tells what the scan carries to all its turns.
    lead = convs.select("conv_id", F.lit(0).alias("own"), "known")
    both = rows.withColumn("own", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    scanned = ordered_scan(both, ["conv_id"], ["own", "turn", "mark"], sums={"at": "own"}, lasts={"of": ("known", 0)})
    own = scanned.where("own = 1 and at > of.head")
    own = own.select("conv_id", (F.col("at") - F.col("of.head") + F.col("of.taken")).alias("place"), "mark", "words", "of.total")
    starts = scanned.where((F.col("own") == 1) & (F.col("at") < HEAD) & (F.col("conv_id") % BLOCK == 0))
    starts = starts.select(F.col("conv_id").alias("base"), F.col("at").alias("place"), "mark", "words")
    heads = convs.select("conv_id", "base", "known.total", F.explode(F.sequence(F.lit(1), F.lit(HEAD - 1))).alias("place"), "known.taken")
    heads = heads.where("place <= taken").join(starts, ["base", "place"]).select(own.columns)
    first = convs.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("words"), "known.total")
    return own.union(heads).union(first)


def units_of(turns: DataFrame) -> DataFrame:
    """conv_id, segment, goes_on, marks, words, start, next: conversations in units, and the paths they hang at."""
    segment = F.when(F.col("place") > 0, F.expr(f"(place - 1) div {SEGMENT}")).otherwise(0).alias("segment")
    entry = F.when(F.col("place") > 0, F.struct("place", "mark", "words"))
    units = turns.groupBy("conv_id", segment).agg(F.array_sort(F.collect_list(entry)).alias("turns"), F.max("total").alias("total"))
    marks = F.transform("turns", lambda t: t["mark"])
    units = units.select(
        "conv_id", "segment", (F.col("total") > (F.col("segment") + 1) * SEGMENT).alias("goes_on"),
        marks.alias("marks"), F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    units = stored(units, "units")
    # A path of whole units is known by the sums of hashes of its units.
    full = units.where(F.size("marks") == SEGMENT)
    hashes = [F.xxhash64("segment", "marks", F.lit(seed)).cast("decimal(38,0)").alias(f"h{seed}") for seed in (0, 1)]
    scanned = ordered_scan(full.select("conv_id", "segment", *hashes), ["conv_id"], ["segment"], sums={"s0": "h0", "s1": "h1"})
    path = F.unhex(F.md5(F.concat_ws(":", F.col("segment") + 1, "s0", "s1").cast("binary"))).alias("path")
    none = F.lit(None).cast("binary")
    paths = scanned.select("conv_id", "segment", path)
    ends = paths.select("conv_id", "segment", none.alias("start"), F.col("path").alias("next"))
    ends = ends.union(paths.select("conv_id", F.col("segment") + 1, "path", none))
    ends = ends.groupBy("conv_id", "segment").agg(F.max("start").alias("start"), F.max("next").alias("next"))
    root = F.unhex(F.md5(F.lit("0").cast("binary")))
    return units.join(ends, ["conv_id", "segment"], "left").withColumn("start", F.coalesce("start", root))


class Trie:
    """A ternary search tree over numbers: nodes are numbered as they are made, so parents come first."""

    def __init__(self) -> None:
        self.key: list[int] = []
        self.less: list[int] = []
        self.more: list[int] = []
        self.next: list[int] = []
        self.up: list[int] = []
        self.root = -1

    def _node(self, key: int, up: int) -> int:
        for column, value in ((self.key, key), (self.less, -1), (self.more, -1), (self.next, -1), (self.up, up)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, sequence: list[int]) -> list[int]:
        """The nodes of a sequence, which is not empty."""
        path: list[int] = []
        up, side, holder = -1, "root", -1
        for key in sequence:
            at = self.root if up < 0 else self.next[up]
            side, holder = ("root", -1) if up < 0 else ("next", up)
            while at >= 0 and self.key[at] != key:
                side, holder = ("less" if key < self.key[at] else "more"), at
                at = (self.less if side == "less" else self.more)[at]
            if at < 0:
                at = self._node(key, up)
                if side == "root":
                    self.root = at
                else:
                    getattr(self, side)[holder] = at
            path.append(at)
            up = at
        return path

    def walk(self) -> Iterator[int]:
        """All nodes, each before what follows it."""
        waiting = [self.root] if self.root >= 0 else []
        while waiting:
            at = waiting.pop()
            yield at
            waiting += [n for n in (self.more[at], self.next[at], self.less[at]) if n >= 0]


def median_order(n: int) -> Iterator[int]:
    """The numbers below n: the middle one, then the same of either half."""
    waiting = [(0, n)]
    while waiting:
        low, high = waiting.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(middle + 1, high), (low, middle)]


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _below(path: bytes, mark: bytes) -> bytes:
    return hashlib.blake2b(path + mark, digest_size=16).digest()


def shard_rows(units: list[dict], shard: int) -> Iterator[dict]:
    """The nodes of one shard: closed ones with all their values, of open ones the shard's part.

    Besides, the witnesses of open nodes, and the ids that end at them. Units come in order.
    """
    groups: list[tuple[dict, list[int]]] = []
    for unit in units:
        if not groups or any(unit[name] != groups[-1][0][name] for name in ("segment", "start", "marks")):
            groups.append((unit, []))
        groups[-1][1].append(unit["conv_id"])
    numbers = {turn: n for n, turn in enumerate(sorted({(0, g["segment"], g["start"]) for g, _ in groups} | {(1, 0, m) for g, _ in groups for m in g["marks"]}))}
    trie, paths = Trie(), {}
    for n in median_order(len(groups)):
        unit = groups[n][0]
        paths[n] = trie.insert([numbers[0, unit["segment"], unit["start"]], *(numbers[1, 0, mark] for mark in unit["marks"])])
    size = len(trie.key)
    depth, words, mark, path, ended = [0] * size, [0] * size, [b""] * size, [b""] * size, {}
    members, least, goes_on, is_open = [0] * size, [0] * size, [False] * size, [False] * size
    for n, (unit, ids) in enumerate(groups):
        nodes = paths[n]
        depth[nodes[0]], path[nodes[0]] = unit["segment"] * SEGMENT, unit["start"]
        for k, at in enumerate(nodes[1:]):
            depth[at], words[at], mark[at] = depth[nodes[0]] + k + 1, unit["words"][k], unit["marks"][k]
        last = nodes[-1]
        members[last], least[last] = len(ids), ids[0]
        if len(nodes) > SEGMENT:
            path[last] = unit["next"]
        if n in (0, len(groups) - 1) or len(nodes) > SEGMENT:
            for at in nodes:
                is_open[at] = True
        else:
            is_open[nodes[0]] = True
    going: dict[int, set[int]] = {}
    for unit in units:
        if unit["goes_on"]:
            going.setdefault(unit["segment"], set()).add(unit["conv_id"])
    for n, (unit, ids) in enumerate(groups):
        on = going.get(unit["segment"], ())
        ended[paths[n][-1]] = [c for c in ids if c not in on] if on else ids

    order = list(trie.walk())
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for at in order:
        if trie.up[at] >= 0 and not path[at]:
            # Only open nodes are told by their path.
            path[at] = _below(path[trie.up[at]], mark[at]) if is_open[at] else b""
    for at in reversed(order):
        up = trie.up[at]
        if not is_open[at]:
            saved[at] += (members[at] - 1) * words[at]
            leaves[at] += not children[at]
            children[up], leaves[up], saved[up] = children[up] + 1, leaves[up] + leaves[at], saved[up] + saved[at]
        if up >= 0:
            least[up] = min(least[up], least[at]) if members[up] else least[at]
            members[up] += members[at]

    for at in order:
        up, inner = trie.up[at], trie.up[at] >= 0
        row = {
            "shard": shard, "depth": depth[at], "conv_id": least[at], "n_convs": members[at], "n_children": children[at],
            "n_leaves": leaves[at], "saved_tokens": saved[at],
        }
        if not is_open[at]:
            row |= {"kind": CLOSED, "ends": digest(ended.get(at, []))}
            row |= {"above": path[up]} if is_open[up] else {"parent": least[up]}
        else:
            row |= {"kind": OPEN, "path": path[at], "words": words[at], "above": path[up] if inner else None}
            if not inner and depth[at]:
                # The node itself is counted where the unit before this one ends.
                row |= {"conv_id": None, "n_convs": 0}
        yield row
        if is_open[at]:
            ids = ended.get(at, [])
            for n in range(0, len(ids), IDS):
                part = ids[n : n + IDS]
                yield {"kind": ENDS, "path": path[at], "conv_id": part[0], "ends": ",".join(map(str, part))}
    for n, (unit, ids) in enumerate(groups):
        on = going.get(unit["segment"], ())
        witnesses = {c for c in ids if c in on} if on else set()
        witnesses |= {ids[0]} if n in (0, len(groups) - 1) or len(unit["marks"]) == SEGMENT else set()
        for c in witnesses:
            for at in paths[n][1 if unit["segment"] else 0 :]:
                yield {"kind": WITNESS, "conv_id": c, "depth": depth[at], "path": path[at]}


NODES = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("words", pa.int64()), ("path", pa.binary()), ("above", pa.binary()), ("ends", pa.string()),
])
NODES_SQL = (
    "kind int, shard long, depth long, conv_id long, parent long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, words long, path binary, above binary, ends string"
)
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shards(units: DataFrame) -> DataFrame:
    """The rows of all shards, written once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= SHARD:
                yield from _batches(shard_rows(held[:SHARD], number))
                held, number = held[SHARD:], number + 1
        if held:
            yield from _batches(shard_rows(held, number))

    order = ["segment", "start", "marks", "conv_id"]
    placed = units.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.mapInArrow(build, NODES_SQL), "shards")


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_pylist(held, schema=NODES)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=NODES)


def list_hashes(ends: DataFrame) -> DataFrame:
    """path, ends_sha256: the hash of the ids that end at each path, read as a stream in their order."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, sha = None, hashlib.sha256()
        for batch in batches:
            out = []
            for now, ids in zip(batch.path, batch.ends, strict=True):
                if now == path:
                    sha.update(b",")
                else:
                    if path is not None:
                        out.append((path, sha.hexdigest()))
                    path, sha = now, hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["path", "ends_sha256"])
        if path is not None:
            yield pd.DataFrame({"path": [path], "ends_sha256": [sha.hexdigest()]})

    placed = ends.select("path", "conv_id", "ends").repartition("path").sortWithinPartitions("path", "conv_id")
    return placed.mapInPandas(follow, "path binary, ends_sha256 string")


def boundary(rows: DataFrame) -> DataFrame:
    """The open nodes of all shards, merged: path, above and the values of a node."""
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = rows.where(F.col("kind") == OPEN).groupBy("path").agg(
        F.max("depth").alias("depth"), F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *sums
    )
    merged = stored(merged, "boundary")
    kids = merged.where("above is not null").groupBy(F.col("above").alias("path")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    merged = merged.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    merged = merged.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))

    seen = rows.where(F.col("kind") == WITNESS).select(F.col("conv_id").alias("witness"), "depth", "path")
    # Each node counts with its least witness; what a witness counts below a node, the node gets.
    counts = seen.groupBy("path").agg(F.min("witness").alias("witness"), F.first("depth").alias("depth"))
    counts = counts.join(merged, "path").select("witness", counts["depth"], "n_leaves", "saved_tokens")
    steps = seen.distinct().join(counts, ["witness", "depth"], "left").withColumn("end", -F.col("depth"))
    steps = steps.fillna(0, ["n_leaves", "saved_tokens"])
    summed = ordered_scan(steps, ["witness"], ["end"], sums={"leaves": "n_leaves", "saved": "saved_tokens"})
    totals = summed.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return merged.drop("n_leaves", "saved_tokens").join(totals, "path")


def nodes(conversations: DataFrame) -> DataFrame:
    """Every node of the trie, with its members, children, leaves and savings."""
    rows = shards(units_of(rebuilt(conversations)))
    merged = stored(boundary(rows), "boundary")
    hashes = list_hashes(rows.where(F.col("kind") == ENDS))
    ids = merged.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    opened = merged.join(hashes, "path", "left").join(ids, "above", "left")
    opened = opened.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(digest([]))))

    closed = rows.where(F.col("kind") == CLOSED).withColumnRenamed("ends", "ends_sha256")
    # A shard has few open nodes: their ids are looked up once for each shard, then within the shard.
    links = closed.where("above is not null").select("shard", "above").distinct().join(ids, "above")
    closed = closed.join(links, ["shard", "above"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    return opened.select(OUT).union(closed.select(OUT))
