"""A Merkle manifest of a table, with proofs fetched as one multiproof per leaf partition.

1. Every row is a leaf. The leaves of a source, in the order of ids, are the base of
   the source's tree; the roots of all sources, in the order of sources, are the base
   of the top tree. Positions come from a range partitioning, so a source may hold any
   share of the rows.
2. Nodes are hashed in blocks of ``ARITY ** LEVELS`` leaves, a few levels a round.
3. A leaf partition is a run of at most ``PARTITION`` leaves of one source. It works out
   which nodes its proofs lack that cannot be derived from its own leaves (the octopus
   method: the union of all missing siblings, level by level), fetches that set once by a
   join, derives what its proofs share and expands each leaf's proof from it.

H is SHA-256 in lowercase hex over concatenated text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import written
from glyphlake.ordered import Ordered

ARITY = 3
#: Levels that one task hashes above a block of ARITY ** LEVELS nodes.
LEVELS = 8
#: Most leaves of a leaf partition.
PARTITION = 10_000
#: The name of the top tree; a source's tree is ``-`` for null, else ``s`` and the source.
TOP = ""
_SALTS = 64


def level_sizes(n: int) -> list[int]:
    """Nodes on each level of a tree over ``n`` leaves, the base first."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def field(value: Column) -> Column:
    """A value as the leaf's hash reads it: ``-`` for null, else its length in bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` from 0 inside their tree and ``n``, the tree's number of leaves."""
    placed = Ordered(rows, ["tree"], order).scan(number="pos").df.withColumn("pos", F.col("pos") - 1)
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return placed.withColumn("salt", (F.col("pos") % _SALTS).cast("int")).join(sizes, ["tree", "salt"]).drop("salt")


def interior_nodes(base: DataFrame) -> DataFrame:
    """(tree, level, pos, digest): all nodes above ``base`` (tree, pos, n, digest), level 0."""
    def climb(at: int):
        def run(key, table):
            tree, block = key[0].as_py(), key[1].as_py()
            rows = table.sort_by("pos")
            n, nodes, first = rows.column("n")[0].as_py(), rows.column("digest").to_pylist(), block * ARITY ** LEVELS
            out = []
            for level in range(at + 1, min(at + LEVELS, len(level_sizes(n)) - 1) + 1):
                nodes = [hashlib.sha256("".join(nodes[i:i + ARITY]).encode()).hexdigest() for i in range(0, len(nodes), ARITY)]
                first //= ARITY
                out += [(level, first + i, d) for i, d in enumerate(nodes)]
            levels, places, digests = zip(*out) if out else ((), (), ())
            return pa.table({"tree": pa.array([tree] * len(out), pa.string()), "level": pa.array(levels, pa.int32()),
                             "pos": pa.array(places, pa.int64()), "n": pa.array([n] * len(out), pa.int64()),
                             "digest": pa.array(digests, pa.string())})
        return run

    most = base.agg(F.max("n")).first()[0] or 1
    found, level = None, 0
    while True:
        block = F.floor(F.col("pos") / ARITY ** LEVELS).cast("bigint").alias("block")
        up = base.select("tree", "pos", "n", "digest", block).groupBy("tree", "block").applyInArrow(
            climb(level), "tree string, level int, pos bigint, n bigint, digest string")
        up = written(up, "nodes")
        found = up if found is None else found.unionByName(up)
        level += LEVELS
        if len(level_sizes(most)) - 1 <= level:
            return found.drop("n")
        base = up.where((F.col("level") == level) & (F.col("n") > ARITY ** level))


def missing(positions: list[int], n: int) -> list[tuple[int, int]]:
    """(level, position) of the fewest nodes that, with the leaves at ``positions``, give all their proofs and the root."""
    known, out = sorted(set(positions)), []
    for level, size in enumerate(level_sizes(n)[:-1]):
        runs, held = sorted({p // ARITY for p in known}), set(known)
        out += [(level, c) for r in runs for c in range(r * ARITY, min(r * ARITY + ARITY, size)) if c not in held]
        known = runs
    return out


def derive(nodes: dict[tuple[int, int], str], positions: list[int], n: int) -> None:
    """Add all ancestors of the leaves at ``positions`` to ``nodes``, which holds the leaves and the missing nodes."""
    known = set(positions)
    for level, size in enumerate(level_sizes(n)[:-1]):
        known = {p // ARITY for p in known}
        for r in known:
            run = range(r * ARITY, min(r * ARITY + ARITY, size))
            nodes[level + 1, r] = hashlib.sha256("".join(nodes[level, c] for c in run).encode()).hexdigest()


def siblings(nodes: dict[tuple[int, int], str], place: int, n: int) -> Iterator[tuple[str, str]]:
    """Per level the joined digests left and right of the path from leaf ``place`` to the root."""
    for level, size in enumerate(level_sizes(n)[:-1]):
        first = place - place % ARITY
        run = range(first, min(first + ARITY, size))
        yield ("".join(nodes[level, c] for c in run if c < place), "".join(nodes[level, c] for c in run if c > place))
        place //= ARITY


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def build(rows: DataFrame, source: str, order: str, leaf: str, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves (tree, pos, n, digest, order, keep), nodes of all trees (tree, level, pos, digest) and sources (tree, top_pos, top_n).

    Rows of one source and order value are ordered by their leaf; nulls come first.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("-"))
    named = rows.select(tree.alias("tree"), F.col(order).alias("_order"), F.col(leaf).alias("digest"), *keep)
    leaves = written(_numbered(named, ["_order", "digest"]), "leaves")
    inner = interior_nodes(leaves)
    base = leaves.select("tree", F.lit(0).alias("level"), "pos", "digest")
    single = leaves.where("n = 1").select("tree", "digest")
    roots = leaves.where("pos = 0 and n > 1").select("tree", "n").join(inner.where("pos = 0"), "tree")
    height = sum((F.col("n") > ARITY ** k).cast("int") for k in range(40))
    subroots = roots.where(F.col("level") == height).select("tree", "digest").unionByName(single)
    tops = written(_numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest"), ["of"]), "subroots")
    top_nodes = tops.select("tree", F.lit(0).alias("level"), "pos", "digest").unionByName(interior_nodes(tops))
    nodes = base.unionByName(inner).unionByName(top_nodes)
    return leaves, nodes, tops.select(F.col("of").alias("tree"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"))


def prove(leaves: DataFrame, nodes: DataFrame, sources: DataFrame, tampered: str, keep: list[str],
          partition: int = PARTITION) -> DataFrame:
    """(keep, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``leaves``.

    ``leaves`` may be any part of the leaves of ``build``. ``tampered`` names the column
    with the leaf to be checked, against the siblings of the table as it was built.
    """
    parted = leaves.withColumn("part", F.floor(F.col("pos") / partition).cast("bigint"))
    parts = parted.groupBy("tree", "part").agg(F.collect_list("pos").alias("places"), F.max("n").alias("n")).join(sources, "tree")

    def lacking(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                here = (row["tree"], row["part"])
                out.append((*here, None, -1, row["top_pos"], row["top_n"]))
                out += [(*here, row["tree"], level, p, None) for level, p in missing(row["places"], row["n"])]
                out += [(*here, TOP, level, p, None) for level, p in missing([row["top_pos"]], row["top_n"])]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            names = ["tree", "part", "node_tree", "level", "pos", "top_n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names)

    wanted = parts.mapInArrow(lacking, "tree string, part bigint, node_tree string, level int, pos bigint, top_n bigint")
    held = nodes.select(F.col("tree").alias("node_tree"), "level", "pos", "digest")
    fetched = wanted.join(held, ["node_tree", "level", "pos"], "left").select(
        "tree", "part", "node_tree", "level", "pos", "top_n", "digest")
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (
        ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    def expand(key, mine, fetched):
        tree, inner, top, header = key[0].as_py(), {}, {}, None
        for row in fetched.select(["node_tree", "level", "pos", "top_n", "digest"]).to_pylist():
            if row["level"] < 0:
                header = row
            else:
                (top if row["node_tree"] == TOP else inner)[row["level"], row["pos"]] = row["digest"]
        places, digests, checked = (mine.column(c).to_pylist() for c in ("pos", "digest", tampered))
        n = mine.column("n")[0].as_py()
        inner |= {(0, p): d for p, d in zip(places, digests)}
        derive(inner, places, n)
        subroot = inner[len(level_sizes(n)) - 1, 0]
        place, top_n = header["pos"], header["top_n"]
        top[0, place] = subroot
        derive(top, [place], top_n)
        root = top[len(level_sizes(top_n)) - 1, 0]
        above = list(siblings(top, place, top_n))
        out = []
        for p, leaf, other in zip(places, digests, checked):
            path = list(siblings(inner, p, n)) + above
            proof = hashlib.sha256("".join(left + right for left, right in path).encode()).hexdigest()
            folded = root if other == leaf else fold(other, path)
            out.append((leaf, subroot, root, proof, folded, folded == root))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pa.table({**{c: mine.column(c) for c in keep}, **dict(zip(names, map(list, zip(*out))))})

    columns = list(dict.fromkeys(["tree", "part", "pos", "n", "digest", tampered, *keep]))
    return parted.select(*columns).groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(expand, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, proof and the check of a tampered copy for each row of ``documents``.

    A row is tampered with where 2 divides the CRC-32 of its id: line feeds of its text
    are deleted. Nulls in any column are part of the leaf; rows without an id come first
    in their source and stay untampered, rows without a source are a source of their own,
    before all others. Equal rows are leaves of their own. An empty table has no rows.
    Other columns are not read.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    bare = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf_hash(*rest, F.col("text")).alias("digest"), leaf_hash(*rest, bare).alias("tampered"))
    leaves, nodes, sources = build(rows, "source", "doc_id", "digest", ["doc_id", "tampered"])
    return prove(leaves, nodes, sources, "tampered", ["doc_id"])
