"""Similarity join of word-shingle sets by signature trees.

Every distinct set is a leaf entry with a token bitmap and its size. Entries are gathered under tree nodes that hold the OR of
the bitmaps and the range of sizes; two nodes are compared by the largest overlap any pair below them can have,
and only surviving pairs are opened, down to entries, whose sets are then compared exactly.

The roots are spread over the cluster by tokens: two sets that link must share one of the first tokens of each in a common order
(as many as can be missing, and COMMON), so only nodes below a shared token and of fitting size meet. The order puts
frequent tokens last. Entries that share their commonest such token form leaf nodes of about LEAF entries, so a large group
of near copies is a few nodes, and node pairs below a token are compared by their combined bitmaps, then by the
bitmaps of their entries, then by the sets. Entries that are connected already are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.components import components
from tickweave.llm.frames import map_slices, pick, raw_bytes
from tickweave.llm.hashing import mix, shingle_sets
from tickweave.session import cut

#: Entries of a leaf node, about; children of an inner node.
LEAF, FAN = 64, 8
#: Tokens that the order puts last: so many at most, each in as many documents at least. They only set the order.
FREQUENT_TOKENS, FREQUENT = 100_000, 16
#: First tokens that linked sets share at least, if they share so many at all; each set offers that many more.
COMMON = 4
#: Ids up to which a list is broadcast (8 bytes each); a longer one is joined by shuffle.
BROADCAST_IDS = 1_000_000


def missing(n: np.ndarray | int, percent: int):
    """Tokens of a set of n that a linked set can lack."""
    return n - -(-percent * n // 100)


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, so a longer bitmap folds onto a shorter one."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    marks = np.zeros(bits, dtype=bool)
    marks[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks)


def fold(packed: np.ndarray, size: int) -> np.ndarray:
    while len(packed) > size:
        packed = packed[: len(packed) // 2] | packed[len(packed) // 2 :]
    return packed


def may_link(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Whether any pair below two nodes (smallest size, largest size, most colliding tokens, bits) can link."""
    (low_a, high_a, slack_a, bits_a), (low_b, high_b, slack_b, bits_b) = a, b
    most = np.bitwise_count(bits_a & bits_b).sum(axis=-1, dtype=np.int64) + np.minimum(slack_a, slack_b)
    most = np.minimum(most, np.minimum(high_a, high_b))
    fits = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    return fits & ((100 + percent) * most >= percent * (low_a + low_b))


class Tree:
    """Signature tree over a bounded number of entries: entries by size, inner nodes of FAN of them."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.size, self.bits = sizes[self.order], maps[self.order]
        self.slack = self.size - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        cuts = np.arange(0, len(sizes), FAN)
        self.inner = (self.size[cuts], np.maximum.reduceat(self.size, cuts), np.maximum.reduceat(self.slack, cuts), np.bitwise_or.reduceat(self.bits, cuts, axis=0))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], bits: int) -> Tree:
        return cls(np.array([len(s) for s in sets], dtype=np.int64), np.stack([bitmap(s, bits) for s in sets]))

    def entries(self, node: int) -> tuple:
        part = slice(node * FAN, (node + 1) * FAN)
        return self.size[part], self.size[part], self.slack[part], self.bits[part]


def crossed(a: tuple, b: tuple) -> tuple[tuple, tuple]:
    return tuple(x[:, None] for x in a), tuple(x[None, :] for x in b)


def surviving(a: Tree, b: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of entries (their numbers as given) that the dual traversal does not prune."""
    for i, j in zip(*np.nonzero(may_link(*crossed(a.inner, b.inner), percent)), strict=True):
        if a is b and j < i:
            continue
        for x, y in zip(*np.nonzero(may_link(*crossed(a.entries(i), b.entries(j)), percent)), strict=True):
            x, y = i * FAN + x, j * FAN + y
            if a is not b or x < y:
                yield int(a.order[x]), int(b.order[y])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def groups_within(sets: list[np.ndarray], names: list[int], percent: int) -> list[int]:
    """For each set the index of the first set of its component among `sets`; pairs already connected are not compared.

    Sets of one name belong together from the start.
    """
    start = {name: i for i, name in reversed([*enumerate(names)])}
    parent = [start[name] for name in names]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    tree = Tree.of_sets(sets, width(max(map(len, sets))))
    for x, y in surviving(tree, tree, percent):
        p, q = root(x), root(y)
        if p != q and linked(sets[x], sets[y], percent):
            parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(sets))]


def links_across(a: list[np.ndarray], b: list[np.ndarray], parts_a: list[int], parts_b: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between entries of two tree nodes, as pairs of the entries' parts; parts already connected are not compared again."""
    bits = width(max(map(len, a + b)))
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    out = []
    for x, y in surviving(Tree.of_sets(a, bits), Tree.of_sets(b, bits), percent):
        p, q = root(parts_a[x]), root(parts_b[y])
        if p != q and linked(a[x], b[y], percent):
            parent[max(p, q)] = min(p, q)
            out.append((parts_a[x], parts_b[y]))
    return out


def numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u8")


def lowered(column: pa.Array) -> list[bytes]:
    return [t.lower() for t in raw_bytes(column)]


def short(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def listed(ids: DataFrame) -> DataFrame:
    """A list of ids, as a broadcast if its measured size allows."""
    ids = cut(ids.distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def first_tokens(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token: 32 bits of it) once per document and token among its first ones by hash alone."""

    def make():
        def step(batch: pa.RecordBatch):
            values, bounds = shingle_sets(lowered(batch.column(1)), size)
            n = np.diff(bounds)
            keep = np.arange(len(values)) - np.repeat(bounds[:-1], n) < np.repeat(missing(n, percent) + COMMON, n)
            return [pa.array(short(values[keep]))]

        return step

    return map_slices(docs, make, "token int")


def facts(docs: DataFrame, size: int, percent: int, late: np.ndarray) -> DataFrame:
    """doc_id, n, two keys of the set, its first tokens in the common order."""

    def make():
        def step(batch: pa.RecordBatch):
            values, bounds = shingle_sets(lowered(batch.column(1)), size)
            brief = short(values)
            at = np.minimum(np.searchsorted(late, brief), max(len(late) - 1, 0))
            last = late[at] == brief if len(late) else np.zeros(len(values), dtype=bool)
            n, key_a, key_b, first = [], [], [], []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                own, end = values[lo:hi], last[lo:hi]
                n.append(hi - lo)
                key_a.append(int(mix(own).sum(dtype=np.uint64).view(np.int64)))
                key_b.append(int(mix(own ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64)))
                ordered = np.concatenate([own[~end], own[end]]) if end.any() else own
                first.append(ordered[: missing(len(own), percent) + COMMON].view(np.int64))
            return batch.column(0), n, key_a, key_b, first

        return step

    return map_slices(docs, make, "doc_id long, n long, key_a long, key_b long, first array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, tokens): the sets of the named documents, ascending, as little-endian unsigned 64-bit numbers."""

    def make():
        def step(batch: pa.RecordBatch):
            values, bounds = shingle_sets(lowered(batch.column(1)), size)
            return batch.column(0), [values[lo:hi].astype("<u8").tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)]

        return step

    wanted = docs.join(listed(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").select("doc_id", "text")
    return map_slices(wanted, make, "node long, tokens binary").filter(F.octet_length("tokens") > 0)


def pairs_that_may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of distinct (a, b), those whose bitmaps and size ranges leave room for a link."""
    side = lambda s: nodes.select(*[F.col(c).alias(c if c == s else f"{s}_{c}") for c in ("low", "high", "slack", "bits")], F.col("node").alias(s))
    fitting = (100 * F.col("a_high") >= percent * F.col("b_low")) & (100 * F.col("b_high") >= percent * F.col("a_low"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(fitting)

    def make():
        def step(batch: pa.RecordBatch):
            c = {f: batch.column(i).to_pylist() for i, f in enumerate(batch.schema.names)}
            keep = []
            for i in range(batch.num_rows):
                bits = [np.frombuffer(c[s + "_bits"][i], dtype=np.uint8) for s in "ab"]
                size = min(map(len, bits))
                # Folding lets more tokens meet in one bit; the other side's count still bounds the overlap.
                slack = [c[s + "_high"][i] if len(x) > size else c[s + "_slack"][i] for s, x in zip("ab", bits, strict=True)]
                node = [(c[s + "_low"][i], c[s + "_high"][i], k, fold(x, size)) for s, k, x in zip("ab", slack, bits, strict=True)]
                keep.append(bool(may_link(*node, percent)))
            kept = batch.filter(pa.array(keep))
            return [kept.column("a"), kept.column("b")]

        return step

    return map_slices(both.select("a", "b", *[f"{s}_{c}" for s in "ab" for c in ("low", "high", "slack", "bits")]), make, "a long, b long", rows=2048)


def beside_pairs(pairs: DataFrame, entries: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, a_…, b_…): the named columns of all entries of either node, as arrays that a leaf's size bounds."""
    wanted = listed(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    lists = entries.join(wanted, "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("member", *columns))).alias("_e"))
    side = lambda s: lists.select(F.col("node").alias(s), *[F.col("_e")[c].alias(f"{s}_{c}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{s}_{c}" for s in "ab" for c in columns])


def pairs_with_entries(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Of the node pairs (a, b), those of which the traversal down to the entries' bitmaps leaves some."""

    def make():
        def step(batch: pa.RecordBatch):
            keep = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                maps = [[np.frombuffer(m, dtype=np.uint8) for m in side] for side in (one, other)]
                size = min(len(m) for side in maps for m in side)
                keep.append(tuple(np.stack([fold(m, size) for m in side]) for side in maps))
            sizes = zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)
            alive = [any(True for _ in surviving(Tree(np.array(p), x), Tree(np.array(q), y), percent)) for (x, y), (p, q) in zip(keep, sizes, strict=True)]
            kept = batch.filter(pa.array(alive, pa.bool_()))
            return [kept.column(0), kept.column(1)]

        return step

    return map_slices(beside_pairs(pairs, entries, ["map", "n"]), make, "a long, b long", rows=64)


def verified(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): parts of entries that a link connects across the node pairs."""

    def make():
        def step(batch: pa.RecordBatch):
            a_sets, a_parts, b_sets, b_parts = (batch.column(i).to_pylist() for i in range(2, 6))
            found = [link for w, x, y, z in zip(a_sets, b_sets, a_parts, b_parts, strict=True) for link in links_across(list(map(numbers, w)), list(map(numbers, x)), y, z, percent)]
            return [[a for a, _ in found], [b for _, b in found]]

        return step

    return map_slices(beside_pairs(pairs, entries, ["tokens", "part"]), make, "a long, b long", rows=16)


def leaf_nodes(entries: DataFrame, percent: int) -> DataFrame:
    """One row per entry: member, node (the leaf's smallest member), part (the smallest member linked in the leaf), tokens, n, map.

    The row of a node's first entry also has the node's low, high and slack and its OR-combined bits.
    """

    def within(group: pa.Table) -> pa.Table:
        group = group.sort_by("member")
        names, sets = group.column("member").to_pylist(), [numbers(t) for t in group.column("tokens").to_pylist()]
        first = groups_within(sets, names, percent)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        maps = np.stack([bitmap(s, width(int(size.min()))) for s in sets])
        slack = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        info = [int(size.min()), int(size.max()), int(slack.max()), np.bitwise_or.reduce(maps).tobytes()]
        once = [pa.array([x] + [None] * (len(sets) - 1), k) for x, k in zip(info, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        columns = [group.column("member"), pa.array([names[0]] * len(sets), pa.int64()), pa.array([names[i] for i in first], pa.int64()), group.column("tokens"), pa.array(size), pa.array([bitmap(s, width(len(s))).tobytes() for s in sets])]
        return pa.table([*columns, *once], names=["member", "node", "part", "tokens", "n", "map", "low", "high", "slack", "bits"])

    return entries.groupBy("leaf", "slot").applyInArrow(within, "member long, node long, part long, tokens binary, n long, map binary, low long, high long, slack long, bits binary")


def jaccard_classes(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of `docs`.

    Two documents link when 100 * common >= percent * union of their distinct `size`-word shingles (words: runs of bytes
    outside \\x20\\x09-\\x0D, A-Z lowered; fewer words: the whole sequence). component_id is the smallest doc_id reachable. Null
    and empty texts and texts of blanks have no shingles and link with nothing, not even with each other. Rows with equal
    doc_id are one document; a null doc_id keeps its count and has a null component. Other columns are not read.
    """
    slim = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    counts = first_tokens(slim, size, percent).groupBy("token").count().filter(F.col("count") >= FREQUENT)
    # FREQUENT_TOKENS rows at most.
    late = np.sort(np.array([r[0] for r in counts.orderBy(F.desc("count"), "token").limit(FREQUENT_TOKENS).select("token").collect()], dtype=np.int32))
    known = cut(facts(slim, size, percent, late))
    named = known.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    firsts = listed(named.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    # Band k holds sizes whose ratio is at least percent / 100; linked sets stand in one band or in neighbours.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / percent) * (1 + 1e-9))).cast("int")
    posts = named.join(firsts, "doc_id", "left_semi").select(F.col("doc_id").alias("member"), band.alias("band"), F.explode("first").alias("token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("token")
    near = cut(posts.join(shared, "token").select("member", F.col("token").alias("_token"), F.explode(F.array(F.xxhash64("token", "band"), F.xxhash64("token", F.col("band") + 1))).alias("token")))
    meeting = near.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    near = near.join(meeting, "token")
    least = named.select(F.col("doc_id").alias("member"), F.least(F.lit(COMMON), F.ceil(F.col("n") * percent / 100)).alias("_least"))
    # Entries gather below the token that they share with most others.
    offers = near.groupBy("member").agg(F.count_distinct("_token").alias("_n"), F.max(F.struct("_n", "token"))["token"].alias("leaf")).join(least, "member").filter("_n >= _least")
    leaves = cut(offers.groupBy("member").agg(F.first("leaf").alias("leaf")))
    slots = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(LEAF)).alias("_slots"))
    placed = leaves.join(slots, "leaf").select("member", "leaf", F.pmod(F.xxhash64("member"), F.col("_slots")).alias("slot"))
    sets = sets_of(slim, leaves.select(F.col("member").alias("node")), size).withColumnRenamed("node", "member")
    entries = cut(leaf_nodes(placed.join(sets, "member"), percent))
    nodes = entries.filter("bits IS NOT NULL").select("node", "low", "high", "slack", "bits")
    below = cut(near.join(entries.select("member", "node").distinct(), "member").select("token", "node").distinct())
    several = below.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("token")
    below = below.join(several, "token")

    left, right = below.alias("l"), below.alias("r")
    meet = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.node") < F.col("r.node")))
    pairs = cut(pairs_that_may_link(meet.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct(), nodes, percent))
    pairs = cut(pairs_with_entries(pairs, entries, percent))
    links = verified(pairs, entries, percent)

    label = components(cut(links))
    label = entries.select("member", "part").distinct().join(label, F.col("part") == F.col("node"), "left").select("member", F.coalesce("component", "part").alias("component"))
    return finish(known, label)


def finish(known: DataFrame, label: DataFrame) -> DataFrame:
    """Labels of the sets' first documents, carried to every row."""
    keys = known.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).select("doc_id", "key_a", "key_b")
    first = keys.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("member"))
    # Rows of one doc_id with different texts tie their sets together.
    tied = first.join(label, "member", "left").select("key_a", "key_b", F.coalesce("component", "member").alias("component"))
    several = keys.groupBy("doc_id").agg(F.count_distinct("key_a", "key_b").alias("_n")).filter("_n > 1").select("doc_id")
    bridges = cut(keys.join(several, "doc_id").join(tied, ["key_a", "key_b"]).select(F.col("doc_id").alias("a"), F.col("component").alias("b")))
    if not bridges.isEmpty():
        higher = components(bridges)
        tied = tied.join(higher.withColumnRenamed("component", "_to").withColumnRenamed("node", "component"), "component", "left").select("key_a", "key_b", F.coalesce("_to", "component").alias("component"))
    joined = known.select("doc_id", "n", "key_a", "key_b").join(tied, ["key_a", "key_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that are the first of their class: smallest doc_id, rows without one and without words all stay.

    Of rows with one doc_id all stay or none.
    """
    classes = jaccard_classes(docs, size, percent)
    later = classes.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
