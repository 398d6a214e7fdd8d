"""MinHash near-deduplication by a chosen-path set similarity join.

Every text becomes the set of its distinct five-word shingles, and equal sets become one node entry first, so a group
of copies, however large, is one member. Each set has a signature of minwise tokens, split among independent trees
and, within a tree, among levels. At the root each set follows BRANCHES paths, one for each of the level's tokens;
sets that share a path form a node. A node of at most NODE_SETS sets and NODE_SHINGLES shingles is compared
exhaustively; a larger one is branched again by the next level's tokens. A pair of similarity s survives a level
with probability 1 - (1 - s)^BRANCHES, so at s = 0.85 a tree of depth d misses it with probability below 0.0034 d,
and TREES independent trees miss it with the power of that: 1e-5 for depth one. A large node that tokens don't part
(dense near copies), or that is still large at the last level, is split into blocks, and every pair of blocks is one
comparison: nothing is capped, at the price of work that grows with the square of such a group of different texts.

Comparing a node: signatures, then full sets. What no chain of pairs with AGREE equal tokens connects is parted (a pair
at s = 0.85 agrees in fewer with probability about 2e-6); within what is left every pair is held against 100 |A & B| >=
85 |A | B| by the postings of the full sets' shingles. Nodes with the same members are compared once. The links given
span each connected group of a node, so components lose nothing while copies never expand into all pairs.

Null and empty texts and texts without words have no shingles and are linked with nothing. Rows without an id are
linked with nothing either: their component is null and they are kept. A row repeated with the same id gets the same
component each time. Ties do not arise. Other columns are ignored, and an empty table gives no rows. Sets are told
apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.llm import shingles
from pictorium.llm.common import id_and_text, slices, tidy, written
from pictorium.llm.components import components

SIMILARITY_PERCENT = 85
TREES, LEVELS, BRANCHES = 2, 5, 3
TOKENS = TREES * LEVELS * BRANCHES
AGREE = 16
BROADCAST_IDS = 1_000_000
NODE_SETS, NODE_SHINGLES = 4_000, 2_000_000
#: A node of which one token keeps more than this share is dense.
DENSE = 0.5
_PERMUTATIONS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(distinct: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set that isn't empty."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 4096):
        low = np.minimum(low, (distinct[at : at + 4096, None] * _PERMUTATIONS).min(axis=0))
    return low.view(np.int64)


def set_id(distinct: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(distinct.tobytes()) - 2**63


def _prepared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for part in slices(batches, as_bytes=True):
        sets = [shingles.shingle_set(t) for t in part["text"]]
        yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "n_shingles": [len(s) for s in sets], "set_id": [set_id(s) if len(s) else None for s in sets], "tokens": [signature(s) if len(s) else None for s in sets]}, schema)


def _full_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("set_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for part in slices(batches, as_bytes=True):
        sets = [s for s in map(shingles.shingle_set, part["text"]) if len(s)]
        yield pa.RecordBatch.from_pydict({"set_id": [set_id(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}, schema)


def agreement(tokens: np.ndarray) -> np.ndarray:
    """In how many tokens each pair of rows agrees."""
    n = len(tokens)
    same = np.zeros((n, n), np.uint8)
    for k in range(tokens.shape[1]):
        same += tokens[:, k][:, None] == tokens[:, k][None, :]
    return same


def _rows(batch: pa.RecordBatch, name: str) -> Iterator[list[np.ndarray]]:
    """For each row of a list<list<long>> column, its inner lists as arrays."""
    outer = batch.column(batch.schema.get_field_index(name))
    inner = outer.values
    numbers = inner.values.to_numpy(zero_copy_only=False)
    at, by = inner.offsets.to_numpy(), outer.offsets.to_numpy()
    for k in range(len(outer)):
        yield [numbers[at[i] : at[i + 1]] for i in range(by[k], by[k + 1])]


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node, the groups that pairs with enough equal tokens connect."""
    schema = pa.schema([("members", pa.list_(pa.int64()))])
    for batch in batches:
        found = []
        for ids, tokens in zip(batch.column(0).to_pylist(), _rows(batch, "tokens"), strict=True):
            left = np.arange(len(ids))
            near = agreement(np.stack(tokens)) >= AGREE
            while len(left) > 1:
                group = np.zeros(len(ids), bool)
                edge = np.array([left[0]])
                while len(edge):
                    group[edge] = True
                    edge = np.flatnonzero(near[edge].any(axis=0) & ~group)
                if group.sum() > 1:
                    found.append(sorted(ids[i] for i in np.flatnonzero(group)))
                left = left[~group[left]]
        yield pa.RecordBatch.from_pydict({"members": found}, schema)


def node_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span each connected group of a node, found by its shingles' postings: exact for every pair."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posted = owner[np.argsort(code, kind="stable")]
    begins = np.cumsum(often) - often
    ends = np.cumsum(sizes)
    group, out = np.arange(n), []
    for i in range(1, n):
        own = code[ends[i] - sizes[i] : ends[i]]
        own = own[often[own] > 1]
        if not len(own):
            continue
        lengths = often[own]
        at = np.repeat(begins[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        both = np.bincount(posted[at], minlength=n)[:i]
        near = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[:i] - both))
        if len(near):
            groups, first = np.unique(group[near], return_index=True)
            out += [(i, int(j)) for j in near[first]]
            group[i] = groups[0]
            if len(groups) > 1:
                group[np.isin(group, groups)] = groups[0]
    return out


def _grouped(nodes: DataFrame, by: str, values: tuple[str, ...]) -> DataFrame:
    """One row a node with its members' columns as lists, all in the same order. Nodes are bounded."""
    rows = nodes.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("r"))
    return rows.select(*[F.col(f"r.{v}").alias(v) for v in values])


def _branched(members: DataFrame, level: int, tree: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """The next nodes of sets with their tokens: BRANCHES for each tree at the root, then within the node's tree."""
    base = lambda t, k: (t * LEVELS + level) * BRANCHES + k
    ways = []
    for t in range(TREES):
        for k in range(BRANCHES):
            ways.append(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(base(t, k)), F.col("node") if tree else F.lit(0), F.get("tokens", F.lit(base(t, k)))).alias("node")))
    every = F.array(*ways)
    chosen = F.filter(every, lambda w: w["tree"] == F.col(tree)) if tree else every
    return members.select("set_id", "size", *carried, F.explode(chosen).alias("w")).select("set_id", "size", *carried, F.col("w.tree").alias("tree"), F.col("w.node").alias("node"))


def _sized(nodes: DataFrame, node_sets: int, node_shingles: int) -> DataFrame:
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).where("n > 1")
    return sizes.withColumn("small", (F.col("n") <= node_sets) & (F.col("w") <= node_shingles))


def _lists(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.sort_array(F.collect_set("set_id")).alias("members")).select("members")


def _block_pairs(large: DataFrame, node_sets: int, node_shingles: int) -> DataFrame:
    """Every pair of blocks of a large node as a node of its own."""
    blocks = (2 * F.greatest(F.ceil(F.col("n") / node_sets), F.ceil(F.col("w") / node_shingles))).cast("int")
    cut = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    pairs = cut.select("node", "set_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return pairs.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "set_id")


def _leaves(reps: DataFrame, node_sets: int, node_shingles: int) -> DataFrame:
    """The nodes to compare exhaustively, as lists of set ids; equal lists once."""
    signed = reps.select("set_id", F.col("n_shingles").alias("size"), "tokens")
    nodes, leaves = written(_branched(signed, 0)), []
    for level in range(1, LEVELS + 1):
        sized = nodes.join(_sized(nodes, node_sets, node_shingles), "node")
        leaves.append(_lists(sized.where("small")))
        large = sized.where(~F.col("small"))
        if large.isEmpty():
            break
        dense = large
        if level < LEVELS:
            from_large = large.select(F.col("node").alias("parent"), F.col("n").alias("whole"), "node", "tree", "set_id").join(signed, "set_id")
            below = written(_branched(from_large, level, "tree", ("parent", "whole")))
            # a node that tokens don't part is dense: more of them would only copy it
            most = below.groupBy("node", "parent", "whole").agg(F.count(F.lit(1)).alias("n")).groupBy("parent", "whole").agg(F.max("n").alias("n"))
            parted = most.where(F.col("n") <= DENSE * F.col("whole")).select("parent")
            dense = large.join(parted, large["node"] == parted["parent"], "left_anti")
            nodes = written(below.join(parted, "parent", "left_semi").drop("parent", "whole"))
        leaves.append(_lists(_block_pairs(dense, node_sets, node_shingles)))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out.where(F.size("members") > 1).distinct()


def _members(lists: DataFrame) -> DataFrame:
    return lists.select(F.xxhash64("members").alias("node"), F.explode("members").alias("set_id"))


def links(docs: DataFrame, reps: DataFrame, percent: int, node_sets: int = NODE_SETS, node_shingles: int = NODE_SHINGLES) -> DataFrame:
    """a, b: confirmed links between sets that span the components."""
    tokens = reps.select("set_id", "tokens")
    alike = _grouped(_members(_leaves(reps, node_sets, node_shingles)).join(tokens, "set_id"), "node", ("set_id", "tokens")).mapInArrow(tidy(_alike), "members array<long>")
    groups = _members(written(alike.distinct()))
    needed = groups.select("set_id").distinct().join(reps.select("set_id", F.col("doc_id").alias("rep")), "set_id").select("rep")
    texts = id_and_text(docs)
    full = texts.join(needed, texts["doc_id"] == needed["rep"], "left_semi").mapInArrow(tidy(_full_sets), "set_id long, shingles array<long>").dropDuplicates(["set_id"])

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            out = []
            for ids, sets in zip(batch.column(0).to_pylist(), _rows(batch, "shingles"), strict=True):
                out += [(ids[x], ids[y]) for x, y in node_links(sets, percent)]
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema)

    return _grouped(groups.join(full, "set_id"), "node", ("set_id", "shingles")).mapInArrow(tidy(confirm), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY_PERCENT, *, node_sets: int = NODE_SETS, node_shingles: int = NODE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (whether that is its own)."""
    prepared = written(id_and_text(docs).mapInArrow(tidy(_prepared), "doc_id long, n_shingles long, set_id long, tokens array<long>"))
    usable = prepared.where("doc_id is not null and set_id is not null")
    least = usable.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    reps = written(usable.join(least, ["set_id", "doc_id"]).dropDuplicates(["set_id"]))
    roots = components(links(docs, reps, percent, node_sets, node_shingles))
    rooted = reps.select("set_id", "doc_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("set_id", "component_id")
    keyed = F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")
    own = prepared.select("doc_id", "n_shingles", keyed).join(named, "set_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The documents that are kept, one of each component, with all their columns."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = written(gone)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["gone"], "left_anti")
