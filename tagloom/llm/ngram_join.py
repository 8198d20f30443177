"""N-gram Jaccard join with a token-group matrix, and the components of its links.

1. Every text becomes its set of hashed word shingles; equal sets become one node.
2. Similar nodes are put into groups: nodes that share a minimum hash are compared with each other,
   block by block, and their verified links form provisional components, cut into groups of bounded size.
3. The matrix tells which token occurs in which component. Tokens stand in one fixed order, tokens known
   to be frequent last. Of a set of ``n``, the first ``n - ceil(t * n) + l`` are entered: two sets that reach the
   threshold ``t`` share at least ``l`` of them, and one of the first ``n - ceil(t * n) + 1``. A token that stands in one
   component only can meet nothing, so a node with fewer than ``l`` others, or none among those first, is done with. Of the rest, the tokens that fewest nodes have are asked for, as many as
   must hold one of any ``l``: a node is a candidate for a component that has one of these.
4. A group is opened for a node only if the node's overlap with the union of the group's tokens can
   reach the threshold; then the node is compared with the members, token by token.

Nodes that are connected already need no further comparison, so a large group of near copies costs
comparisons in proportion to its size, not to its square. Of two components the smaller asks the larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import BLANKS, LOWER, chunks, join_by_weight, most_frequent, portable, stored
from tagloom.llm.components import components

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
NONE = -(1 << 63)  # stands for a null id
MEMBERS = 128  # of a block or group
STRETCH = 1 << 20  # bytes of text that a task hashes at once; it needs some 15 times as much memory


class _Shingles:
    """Sorted distinct 64-bit hashes of each text's word shingles; one of the whole text if it is shorter.

    Words are hashed by a polynomial over their bytes: a running sum over a stretch of all texts
    gives every word at once.
    """

    STRETCH = 1 << 17

    def __init__(self, width: int):
        self.width = width
        self.blank = np.zeros(256, bool)
        self.blank[list(BLANKS.encode())] = True
        self.lower = np.frombuffer(LOWER, np.uint8)
        self._powers(1 << 16)

    def _powers(self, size: int):
        self.up, self.down = (
            np.cumprod(np.array([1] + [p] * size, np.uint64), dtype=np.uint64)
            for p in (int(MIX[2]) | 1, pow(int(MIX[2]) | 1, -1, 1 << 64))
        )

    def words(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and in which text it stands; ``edges`` are the texts' borders."""
        blank = self.blank[data]
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]
        first[inner] |= ~blank[inner]
        last[inner - 1] |= ~blank[inner - 1]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        texts = np.searchsorted(edges, begins, side="right") - 1
        hashes = np.empty(len(begins), np.uint64)
        at = 0
        while at < len(begins):  # words that end within a stretch; a longer word is a stretch of its own
            to = max(at + 1, int(np.searchsorted(ends, begins[at] + self.STRETCH, side="right")))
            low, high = int(begins[at]), int(ends[to - 1])
            if high - low >= len(self.up):
                self._powers(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.lower[data[low:high]].astype(np.uint64) + np.uint64(1)) * self.up[: high - low], out=sums[1:])
            hashes[at:to] = (sums[ends[at:to] - low] - sums[begins[at:to] - low]) * self.down[begins[at:to] - low]
            at = to
        hashes ^= hashes >> np.uint64(32)
        hashes *= MIX[3]
        hashes ^= hashes >> np.uint64(29)
        return hashes, texts

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        column = column.cast(pa.binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
        hashes, texts = self.words(data, edges - edges[0])
        counts = np.bincount(texts, minlength=len(column)) if len(texts) else np.zeros(len(column), np.int64)
        starts = np.concatenate(([0], np.cumsum(counts))).tolist()
        grams = {size: self._grams(hashes, size) for size in {min(self.width, n) for n in counts.tolist()} if size}
        out = []
        for begin, end in zip(starts[:-1], starts[1:]):
            size = min(self.width, end - begin)
            if not size:
                out.append(np.zeros(0, np.uint64))
                continue
            own = np.sort(grams[size][begin : end - size + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        return out

    @staticmethod
    def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of ``size`` words from each place on; the size itself is part of it."""
        out = np.full(max(0, len(hashes) - size + 1), size, np.uint64)
        for i in range(size if len(out) else 0):
            out = (out ^ hashes[i : i + len(out)]) * MIX[0]
            out ^= out >> np.uint64(29)
        return out * MIX[1]


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _repeated(values: np.ndarray, often: int) -> tuple[np.ndarray, np.ndarray]:
    """The values found ``often`` times, and how often. Sorts its argument and holds no copy of it."""
    values.sort()
    last = len(values) - often + 1
    found = np.unique(values[:last][values[:last] == values[often - 1 :]]) if last > 0 else values[:0]
    return found, np.searchsorted(values, found, side="right") - np.searchsorted(values, found)


def sets_of(docs: DataFrame, text: str, key: str, width: int, often: int = 3) -> DataFrame:
    """Per row ``doc_id, origin, n, f1, f2``; besides, rows ``token, times`` of shingles found often among some four million."""

    names = ["doc_id", "origin", "n", "f1", "f2", "token", "times"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(width)
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def frequent() -> pa.RecordBatch:
            whole = np.concatenate([*held.values(), np.zeros(0, np.uint64)])
            held.clear()  # of some four million hashes there is this one copy, sorted in place
            tokens, times = _repeated(whole, often)
            none = [pa.nulls(len(tokens), pa.int64())] * 5
            return pa.RecordBatch.from_arrays([*none, pa.array(_signed(tokens), pa.int64()), pa.array(times, pa.int64())], names=names)

        for batch in chunks(batches, "text", STRETCH):
            sets = shingles(batch.column("text"))
            found = [_identity(s) if len(s) else (0, 0) for s in sets]
            n = [pa.array(v, pa.int64()) for v in ([len(s) for s in sets], [f for f, _ in found], [f for _, f in found])]
            none = [pa.nulls(len(sets), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("origin"), *n, *none], names=names)
            held.update(zip(found, sets))  # copies count once
            size += sum(map(len, sets))
            if size > 4_000_000:
                yield frequent()
                size = 0
        if held:
            yield frequent()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("origin"), F.col(text).alias("text"))
    schema = "doc_id bigint, origin bigint, n bigint, f1 bigint, f2 bigint, token bigint, times bigint"
    return rows.mapInArrow(read, schema)


def _slots(wanted: DataFrame, bits: int = 24) -> np.ndarray:
    """A bitmap of the slots of ``f1`` in use. It has ``2 ** bits`` bits for any input."""
    slot = F.shiftrightunsigned("f1", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(f1, {64 - bits}) & 63 as int))")
    words = wanted.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _needed(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """The wanted nodes (``f1, f2`` and other columns) with ``tokens``, read anew from the texts.

    A bitmap keeps most other texts from being sent; the join leaves exactly the wanted ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_slots(wanted).tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.frombuffer(sent.value, np.uint64)
        drop = 64 - int(np.log2(len(used) * 64))
        shingles = _Shingles(width)
        for batch in chunks(batches, "text", STRETCH):
            rows: dict[tuple[int, int], bytes] = {}
            for tokens in shingles(batch.column("text")):
                if len(tokens):
                    name = _identity(tokens)
                    slot = (name[0] & 0xFFFFFFFFFFFFFFFF) >> drop
                    if int(used[slot >> 6]) >> (slot & 63) & 1:
                        rows[name] = tokens.tobytes()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for f, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.int64()), pa.array(rows.values(), pa.binary())],
                    names=["f1", "f2", "tokens"],
                )

    found = docs.select(F.col(text).alias("text")).mapInArrow(read, "f1 bigint, f2 bigint, tokens binary")
    found = found.groupBy("f1", "f2").agg(F.first("tokens").alias("tokens"))
    return found.join(wanted, ["f1", "f2"]).drop("f1", "f2")


def _blocks_of(count: str | F.Column, of: str):
    """A block number below ``ceil(count / MEMBERS)`` from the hash of a node."""
    return F.pmod(F.xxhash64(of), F.greatest(F.lit(1), F.ceil(F.col(count) / MEMBERS)))


def _reach(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of these sizes that reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class _Roots(dict):
    """Union-find over the nodes of one block."""

    def top(self, node):
        while (up := self.get(node, node)) != node:
            self[node] = self.get(up, up)
            node = up
        return node

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    need = _reach(len(a), len(b), percent)
    return min(len(a), len(b)) >= need and _overlap(a, b) >= need


def _with_tokens(docs, text, width, rows: DataFrame, nodes: DataFrame, *work: str) -> DataFrame:
    """Add each row's set. The set of a node that many rows want is copied for every thousand of them.

    ``part`` gathers units of ``work``, each of bounded size, into some 500 rows per call.
    """
    uses = stored(rows.groupBy("node").agg(F.count("*").alias("uses")).join(nodes.select("node", "f1", "f2"), "node"), "token-uses")
    total = max(1, rows.count())
    copies = F.ceil(F.col("uses") / 1000)
    rows = join_by_weight(rows, uses.select("node", "uses"), ["node"], "uses", total, how="inner")
    rows = rows.withColumn("copy", F.pmod(F.xxhash64(*work), copies)).drop("uses")
    sets = _needed(docs, text, width, uses).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("uses")
    part = F.pmod(F.xxhash64(*work), F.lit(max(1, total // 500))).cast("int")
    return rows.join(sets, ["node", "copy"]).withColumn("part", part)


def _first_links(docs, nodes, text, width, rounds, percent) -> DataFrame:
    """Edges ``(a, b)`` between verified similar nodes that share a minimum hash and are of like size."""
    keys = nodes.select("node", "n", F.posexplode("mins").alias("round", "least"))
    # Classes of sizes that the threshold allows; every other round has its borders half a class further.
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + F.col("round") % 2 / 2)
    keys = keys.select("node", "round", "least", size.alias("size"))
    on = ["round", "least", "size"]
    groups = keys.groupBy(*on).agg(F.count("*").alias("count"), F.min("node").alias("pivot")).filter("count > 1")
    groups = stored(groups, "similar-groups")
    placed = join_by_weight(keys, groups, on, "count", max(1, nodes.count() * rounds), how="inner")
    placed = placed.select(*on, "pivot", "node", _blocks_of("count", "node").alias("block"))
    placed = stored(placed, "similar-members")
    # Every block of a group holds the group's pivot, so that links to it tie the blocks together.
    others = placed.filter("node != pivot")
    pivots = others.select(*on, "pivot", F.col("pivot").alias("node"), "block").distinct()
    placed = stored(others.unionByName(pivots), "similar-placed")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, rows in frame.groupby(["round", "least", "size", "block"], sort=True):
            sets = {n: np.frombuffer(t, np.uint64) for n, t in zip(rows["node"], rows["tokens"])}
            pivot = int(rows["pivot"].iloc[0])
            order = [pivot, *sorted(n for n in sets if n != pivot)] if pivot in sets else sorted(sets)
            roots = _Roots()
            for i, a in enumerate(order):
                for b in order[i + 1 :]:
                    if roots.top(a) != roots.top(b) and _linked(sets[a], sets[b], percent):
                        roots.join(a, b)
                        links.append((a, b))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    parts = _with_tokens(docs, text, width, placed, nodes, *on, "block")
    return parts.groupBy("part").applyInPandas(compare, "a bigint, b bigint")


def _shared_least(n: int, percent: int) -> int:
    """``l``: how many of the entered tokens sets of ``n`` and more have to share, two thirds of what may differ."""
    return max(1, (100 - percent) * n // 150)


def _prefixes(docs, text, width, percent, rounds, common) -> DataFrame:
    """``(f1, f2, rare, common, asked, edge, mins)`` of every text with words; equal sets repeat.

    ``rare`` and then ``common`` are the entered tokens; those known to be frequent are common, the most frequent last. Any
    ``asked`` of the tokens hold one that a linked set enters, too, and so do the first ``n - ceil(t * n) + 1``, of which ``edge``
    is the last (null if it is common). The minimum hashes are taken of the rare tokens, but of all tokens where frequent ones
    had to be entered: in a large group of near copies only the words that differ are rare, and no two sets share these.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common.tobytes())

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        edges = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(arrays)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = np.frombuffer(sent.value, np.uint64)  # by rank
        by_value = np.argsort(ranked)
        values = ranked[by_value]
        shingles = _Shingles(width)
        for batch in chunks(batches, "text", STRETCH):
            rows: dict[tuple[int, int], tuple] = {}
            for tokens in shingles(batch.column("text")):
                if not len(tokens):
                    continue
                n, least = len(tokens), -(-percent * len(tokens) // 100)  # the least size of a partner is the least overlap
                size = min(n, n - least + _shared_least(n, percent))
                rare, known = tokens, tokens[:0]
                if len(values):
                    at = np.searchsorted(values, tokens)
                    at[at == len(values)] = 0
                    frequent = values[at] == tokens
                    rare = tokens[~frequent]
                    if len(rare) < size:
                        known = ranked[np.sort(by_value[at[frequent]])][: size - len(rare)]
                of = tokens if len(known) else rare
                asked = size - _shared_least(least, percent) + 1
                edge = int(_signed(rare[n - least])) if len(rare) > n - least else None
                rows[_identity(tokens)] = _signed(rare[:size]), _signed(known), asked, edge, [int(_signed((of * m).min())) for m in MIX[:rounds]]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f for f, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.int64()),
                        *(lists([r[i] for r in rows.values()]) for i in (0, 1)),
                        pa.array([r[2] for r in rows.values()], pa.int32()), pa.array([r[3] for r in rows.values()], pa.int64()),
                        pa.array([r[4] for r in rows.values()], pa.list_(pa.int64())),
                    ],
                    names=["f1", "f2", "rare", "common", "asked", "edge", "mins"],
                )

    schema = "f1 bigint, f2 bigint, rare array<bigint>, common array<bigint>, asked int, edge bigint, mins array<bigint>"
    return docs.select(F.col(text).alias("text")).mapInArrow(read, schema)


def _candidates(heads: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct ``(node, component)``: a node and a component that may hold a partner.

    ``heads`` come from ``_prefixes``, ``nodes`` have ``f1, f2, node, component, size, n``. The rare tokens are shuffled once; none
    of them is hot, as frequent ones are known and taken for shared. Only tokens asked for by nodes whose entries are shared almost
    throughout are joined to components.

    A ``whole`` node has entered all its rare tokens. Those of a node that no other component has entered are in no whole node of
    one; what remains, ``open``, bounds the overlap. All nodes hold their open tokens in one order, by count and hash, common ones
    last by rank. Of a pair the first shared token decides: none before it is shared, so on either side only the open tokens from
    there on count, and a pair that fails by this is left to its earlier tokens, if it has any. So texts that share a very common
    passage meet only where it makes up enough of both.
    """
    keys = ["f1", "f2"]
    entered = heads.groupBy(*keys).agg(F.first("rare").alias("rare")).join(nodes.select(*keys, "node", "component"), keys)
    entered = entered.select("node", "component", F.explode("rare").alias("token"))
    of_token = Window.partitionBy("token")
    met = entered.select("node", "token", *[f("component").over(of_token).alias(n) for f, n in ((F.min, "low"), (F.max, "high"), (F.count, "times"))])
    met = met.filter("low != high").groupBy("node")
    met = stored(met.agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("met")), "met-tokens")  # of one set, at most
    facts = heads.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("common", "asked")], F.first("edge", ignorenulls=False).alias("edge"), F.first(F.size("rare")).alias("rares")
    )
    live = facts.join(nodes, keys).join(met, "node", "left")
    found = F.coalesce(F.transform("met", lambda t: t["token"]), F.array().cast("array<bigint>"))
    alone = F.col("rares") - F.size(found)
    place = lambda token: token.bitwiseXOR(F.lit(NONE))  # noqa: E731  # hashes are ordered as unsigned numbers
    early = F.col("edge").isNull() | F.exists(found, lambda t: place(t) <= place(F.col("edge")))
    live = live.filter((F.col("asked") > alone) & early)
    live = live.select(
        "node", "component", "size", "n", F.concat(found, "common").alias("tokens"), (F.col("asked") - alone).alias("ask"),
        (F.col("n") - alone).alias("open"), (F.size("common") > 0).alias("whole"),
    )
    live = stored(live, "live-nodes")
    asking = live.select("node", "component", "size", "n", "open", "whole", F.posexplode(F.slice("tokens", F.lit(1), F.col("ask"))).alias("at", "token"))
    asking = asking.withColumn("open", F.col("open") - F.col("at")).drop("at")
    wanted = asking.groupBy("token").agg(F.count("*").alias("asks"))
    wanted = stored(wanted, "asked-tokens")
    there = live.select(F.col("component").alias("target"), "size", "n", "open", "whole", F.posexplode("tokens").alias("at", "token"))
    # one row per token and component, however many nodes have the token there
    there = there.groupBy("token", "target").agg(
        F.first("size").alias("target_size"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max(F.col("open") - F.col("at")).alias("target_open"), F.bool_and("whole").alias("target_whole"),
    )
    there = there.join(wanted, "token")
    owners = stored(there.drop("asks"), "asked-components")
    counted = stored(owners.groupBy("token").agg(F.count("*").alias("owners")).join(wanted, "token"), "asked-counts")
    # A hot token's components are dealt to blocks, and so are none of its asking nodes: each block is asked by all of them.
    blocks = F.ceil(F.col("owners") / 1000)
    asking = join_by_weight(asking, counted.select("token", "asks", "owners"), ["token"], "asks", max(1, asking.count()), how="inner")
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("asks", "owners")
    owners = join_by_weight(owners, counted.select("token", "owners"), ["token"], "owners", max(1, owners.count()), how="inner")
    owners = owners.withColumn("block", F.pmod(F.xxhash64("target"), blocks)).drop("owners")
    smaller = F.struct("size", "component") < F.struct(F.col("target_size").alias("size"), F.col("target").alias("component"))
    near = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)
    # As much as both may share; the partner is no smaller than the smallest there.
    overlap = F.least(F.when(F.col("target_whole"), F.col("open")).otherwise(F.col("n")), F.when(F.col("whole"), F.col("target_open")).otherwise(F.col("most")))
    near = near & (overlap * 100 >= (F.col("n") + F.col("least") - overlap) * percent)
    pairs = asking.join(owners, ["token", "block"]).filter(smaller & near)
    return pairs.select("node", F.col("target").alias("component")).distinct()


def _open_groups(docs, text, width, percent, nodes, found) -> DataFrame:
    """Edges between candidates and members of the groups that they open."""
    asking = stored(found, "group-queries")
    sizes = nodes.groupBy("component").agg(F.max("size").alias("size"))
    targets = asking.groupBy("component").agg(F.count("*").alias("queries")).join(sizes, "component")
    targets = stored(targets, "opened-groups")
    chunk = F.ceil(F.col("queries") / (2 * MEMBERS))
    asked = join_by_weight(asking, targets, ["component"], "queries", max(1, asking.count()), how="inner")
    asked = asked.select(
        "node", "component", F.pmod(F.xxhash64("node"), chunk).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("size") / MEMBERS)) - 1)).alias("block"), F.lit(True).alias("query"),
    )
    members = join_by_weight(nodes.select("node", "component"), targets, ["component"], "size", max(1, nodes.count()), how="inner")
    members = members.select(
        "node", "component", F.explode(F.sequence(F.lit(0), chunk - 1)).alias("chunk"),
        _blocks_of("size", "node").alias("block"), F.lit(False).alias("query"),
    )
    rows = stored(asked.unionByName(members), "opened-rows")
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, group in frame.groupby(["component", "block", "chunk"], sort=True):
            sets = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
            asks = group["query"].to_numpy()
            nodes = group["node"].tolist()
            inside = [i for i in range(len(nodes)) if not asks[i]]
            if not inside:
                continue
            union = np.unique(np.concatenate([sets[i] for i in inside]))
            for q in np.flatnonzero(asks).tolist():
                if 100 * _overlap(sets[q], union) < percent * len(sets[q]):
                    continue  # no member can reach the threshold
                for i in inside:
                    if nodes[i] != nodes[q] and _linked(sets[q], sets[i], percent):
                        links.append((nodes[q], nodes[i]))
                        break  # the members of a group are connected already
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    parts = _with_tokens(docs, text, width, rows, nodes, "component", "block", "chunk")
    return parts.groupBy("part").applyInPandas(verify, "a bigint, b bigint")


def join(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, percent: int = 85,
    rounds: int = 4, max_common: int = 1 << 20,
) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id`` and ``origin``, a hash of the text.

    A text's set holds its distinct shingles of ``width`` words (runs without blanks, lower-cased in
    A-Z); a shorter text is one shingle; a null, empty or blank text has none and is linked with
    nothing. Sets link when ``100 * intersection >= percent * union``. ``component_id`` is the least
    id that links reach; a null id counts as the least of all. Rows that share an id count as one document.
    """
    rows = stored(sets_of(docs, text, key, width), "shingle-sets")
    sets = rows.filter(F.col("n").isNotNull())
    nodes = sets.filter("n > 0").groupBy("f1", "f2").agg(
        F.min(F.coalesce("doc_id", F.lit(NONE))).alias("node"), F.max("n").alias("n"), F.count("*").alias("copies")
    )
    nodes, shared = _own_ids(stored(nodes, "shingle-nodes"), sets)
    often = rows.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("times").alias("times"))
    often = most_frequent(stored(often, "frequent-shingles"), "times", max_common).toPandas().sort_values(["times", "token"])
    common = often["token"].to_numpy(np.int64).view(np.uint64)  # the most frequent last
    heads = stored(_prefixes(docs, text, width, percent, rounds, common), "prefix-rows")
    entries = stored(heads.groupBy("f1", "f2").agg(F.first("mins").alias("mins")).join(nodes, ["f1", "f2"]), "minimum-hashes")

    links = _first_links(docs, entries, text, width, rounds, percent).unionByName(shared)
    known = stored(components(links), "first-components")
    sizes = known.groupBy("component").agg((F.count("*") + 1).cast("int").alias("size"))
    # The smallest node of a component has no row in known: its component is itself.
    labelled = nodes.select("f1", "f2", "node", "n").join(known, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    labelled = join_by_weight(labelled, sizes, ["component"], "size", max(1, nodes.count())).fillna(1, ["size"])
    labelled = stored(labelled, "labelled-nodes")
    found = _candidates(heads, labelled, percent)
    more = _open_groups(docs, text, width, percent, labelled, found)
    final = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    answers = nodes.join(final, "node", "left").select("f1", "f2", "copies", F.coalesce("component", "node").alias("component"))
    result = join_by_weight(sets, stored(answers, "shingle-answers"), ["f1", "f2"], "copies", max(1, sets.count()))
    answer = F.coalesce("component", "doc_id")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(answer != NONE, answer).alias("component_id"), "origin")


def _own_ids(nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tie the sets of an id that several sets share to that id; sets named by it get numbers of their own."""
    whole = sets.filter("n > 0").select(F.coalesce("doc_id", F.lit(NONE)).alias("id"), "f1", "f2")
    ends = [f(c).alias(f"{c}{e}") for c in ("f1", "f2") for e, f in (("a", F.min), ("b", F.max))]
    shared = whole.groupBy("id").agg(*ends, F.count("*").alias("many")).filter("f1a != f1b or f2a != f2b").select("id", "many")
    shared = stored(shared, "shared-ids")
    if shared.isEmpty():
        return nodes, nodes.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    total = whole.count()
    ties = join_by_weight(whole, shared, ["id"], "many", total, how="inner").select("id", "f1", "f2").distinct()
    own = F.lit(1 << 62) + F.xxhash64("f1", "f2").bitwiseAND(F.lit((1 << 62) - 1))  # above every common id
    marked = join_by_weight(nodes.withColumnRenamed("node", "id"), shared, ["id"], "many", total)
    marked = marked.withColumn("node", F.when(F.col("many").isNull(), F.col("id")).otherwise(own)).drop("id", "many")
    marked = stored(marked, "shingle-nodes")
    return marked, ties.join(marked, ["f1", "f2"]).select(F.col("node").alias("a"), F.col("id").alias("b"))


portable(__name__)
