"""A Merkle manifest of a dataset, with proofs from one multiproof per leaf partition.

Every document is a leaf. Leaves of a language, in order of their ids, are hashed in runs of
two until one node is left, its subroot; the subroots, in order of the languages, are hashed
the same way into the root. Positions come from a range partitioning and sums over its parts,
so no language meets in one task. Trees are built in storeys: a task hashes blocks of 4,096
neighbours up twelve levels, and the tops of the blocks are the leaves of the next storey.

Proofs (octopus): a leaf partition holds some 16,384 neighbouring leaves in whole blocks.
From its coordinates alone it works out the least set of nodes that it cannot derive, fetches
these once, in one join for all partitions, derives the interior nodes its leaves share, each
once, and expands the proof of every leaf locally. A proof is a list of steps from leaf to
root, (left, hash): the sibling's hash and whether it stands to the left; a node without a
sibling is hashed alone (hash null).

Only nodes above the blocks are kept, two for every 4,096 leaves, and all of the tree of
subroots. Workers hold one block or one leaf partition. Intermediate tables lie in the shared
checkpoint folder.

Defined cases: a null field is hashed as ``-``; null ids and languages come first; documents
of equal id follow one another by their leaf's hash, equal ones in any order, with the same
root; empty texts are fields of no bytes; a single document is its own root, its proof is
empty; an empty table has no root and no proofs. Other columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern.llm.common import lasting

# workers get these functions themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Levels that one task hashes at once, and the leaves below its top.
HEIGHT = 12
BLOCK = 1 << HEIGHT
#: A leaf partition takes the blocks that start within 2 to the so many leaves.
PART = HEIGHT + 2

#: Whose nodes: of a language's tree or of the tree of subroots.
LANGUAGE, SUBROOTS = 0, 1
STEPS = "array<struct<left: boolean, hash: string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of fields are hashed alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf of a document, as lower-case hexadecimal digits."""
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]).cast("binary"), 256)


def node(*children: str) -> str:
    return sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` neighbours, until one is left."""
    return (n - 1).bit_length()


def missing(known: set[int], n: int, level: int = 0) -> list[tuple[int, int]]:
    """The fewest (level, index) that, with the known nodes of a level of ``n``, give all their ancestors."""
    found = []
    while n > 1:
        found += [(level, i ^ 1) for i in known if i ^ 1 < n and i ^ 1 not in known]
        known = {i >> 1 for i in known}
        n, level = (n + 1) >> 1, level + 1
    return found


def derived(known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[dict[int, str]], str]:
    """Per level the nodes at hand, siblings included, and the node at the top."""
    levels = []
    while n > 1:
        at_hand = dict(known)
        for i in known:
            if i ^ 1 < n and i ^ 1 not in known:
                at_hand[i ^ 1] = fetched[len(levels), i ^ 1]
        levels.append(at_hand)
        known = {p: node(*[at_hand[c] for c in (2 * p, 2 * p + 1) if c < n]) for p in {i >> 1 for i in known}}
        n = (n + 1) >> 1
    return levels, known[0]


def steps(levels: list[dict[int, str]], at: int) -> list[tuple[bool, str | None]]:
    """The siblings on the way up from a place."""
    path = []
    for nodes in levels:
        path.append((at & 1 == 1, nodes.get(at ^ 1)))
        at >>= 1
    return path


def leaves(docs: DataFrame, **carried: Column) -> DataFrame:
    """(doc_id, leaf, group) of every document; ``carried`` columns go along up to its proof.

    ``group`` stands for the language, in byte order, null first.
    """
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    own = leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return docs.select("doc_id", own.alias("leaf"), group.alias("group"), *[c.alias(name) for name, c in carried.items()])


def ordered(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with their place ``at`` in their group, and (group, n, rank, start) of every group.

    Rows are sorted by ranges of (group, id, leaf); only counts per part and group are added up.
    """
    order = [F.col(c).asc_nulls_first() for c in ("group", "doc_id", "leaf", "row")]
    cut = given.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    spot = F.monotonically_increasing_id()
    placed = lasting(cut.withColumn("spot", spot).drop("row").withColumn("part", F.shiftright("spot", 33)))
    inside = F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy("group", "part").agg(F.count("*").alias("rows"), F.min(inside).alias("first"))
    mine = Window.partitionBy("group")
    before = mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = lasting(
        counts.withColumns(
            {
                "before": F.coalesce(F.sum("rows").over(before), F.lit(0)),
                "n": F.sum("rows").over(mine),
                "opens": F.min("part").over(mine) == F.col("part"),
            }
        )
    )
    # one row per part of the range partitioning
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("rows").alias("rows"), F.count_if("opens").alias("opened"))
    parts = parts.select(
        "part",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("opened").over(earlier), F.lit(0)).alias("groups_before"),
    )
    nth = F.row_number().over(Window.partitionBy("part").orderBy("group")) - 1
    groups = (
        counts.where("opens")
        .withColumn("nth", nth)
        .join(parts, "part")
        .select("group", "n", (F.col("groups_before") + F.col("nth")).alias("rank"), (F.col("rows_before") + F.col("first")).alias("start"))
    )
    at = (inside - F.col("first") + F.col("before")).alias("at")
    others = [c for c in placed.columns if c not in ("spot", "part")]
    return placed.join(counts.select("group", "part", "first", "before"), ["group", "part"]).select(*others, at), lasting(groups)


def _storey(rows: DataFrame, base: int, inner: bool) -> DataFrame:
    """Nodes above (group, at, n, hash) at level ``base``: block tops and, if ``inner``, what is below them.

    Rows (group, level, at, n, hash, top); ``n`` counts the nodes of the top's level.
    """

    def up(group: str, block: int, n: int, hashes: list[str], out: list[tuple]):
        first, level = block << HEIGHT, base
        for _ in range(min(HEIGHT, height(n))):
            if inner:
                out += [(group, level, first + i, n, h, False) for i, h in enumerate(hashes)]
            hashes = [node(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)]
            first, level, n = first >> 1, level + 1, (n + 1) >> 1
        out.append((group, level, first, n, hashes[0], True))

    def build(batches):
        now, size, hashes = None, 0, []
        for batch in batches:
            out: list[tuple] = []
            for group, at, n, own in zip(*(batch.column(c).to_pylist() for c in ("group", "at", "n", "hash")), strict=True):
                if now != (group, at >> HEIGHT):
                    if hashes:
                        up(*now, size, hashes, out)
                    now, size, hashes = (group, at >> HEIGHT), n, []
                hashes.append(own)
            if out:
                yield _batch(out)
        if hashes:
            out = []
            up(*now, size, hashes, out)
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = ["group", "level", "at", "n", "hash", "top"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    block = F.shiftright("at", HEIGHT)
    dealt = rows.select("group", "at", "n", "hash").repartition("group", block).sortWithinPartitions("group", "at")
    return dealt.mapInArrow(build, "group string, level int, at long, n long, hash string, top boolean")


def _climb(rows: DataFrame, most: int, inner: bool) -> tuple[DataFrame, DataFrame]:
    """All nodes kept (group, level, at, hash) and the (group, hash) of every tree's root; trees hold ``most`` leaves."""
    kept, roots, level = [], [], 0
    while True:
        made = lasting(_storey(rows, level, inner or level > 0))
        kept.append(made.where("not top").select("group", "level", "at", "hash"))
        roots.append(made.where("top and n = 1").select("group", "hash"))
        most = -(-most // BLOCK)
        if most <= 1:
            return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, roots)
        rows, level = made.where("top and n > 1"), level + HEIGHT


@dataclass
class Manifest:
    """A dataset's leaves with their places, its groups with their subroots, the nodes kept, and the root."""

    leaves: DataFrame
    groups: DataFrame
    nodes: DataFrame
    root: str | None


def manifest(given: DataFrame) -> Manifest:
    """Builds the trees over leaves as :func:`leaves` makes them."""
    placed, groups = ordered(given)
    extent = groups.agg(F.max("n").alias("n"), F.count("*").alias("groups")).first()
    sized = lasting(placed.join(groups, "group"))
    rows = sized.withColumnRenamed("leaf", "hash")
    inside, subroots = _climb(rows, extent["n"] or 1, inner=False)
    groups = groups.join(subroots.withColumnRenamed("hash", "subroot"), "group")
    tops = groups.select(F.lit("").alias("group"), F.col("rank").alias("at"), F.lit(extent["groups"]).cast("long").alias("n"), F.col("subroot").alias("hash"))
    above, root = _climb(tops, extent["groups"] or 1, inner=True)
    found = root.first()  # the one root
    nodes = inside.withColumn("tree", F.lit(LANGUAGE)).unionByName(above.withColumn("tree", F.lit(SUBROOTS)))
    return Manifest(sized, groups, nodes, found and found["hash"])


def _part(start: Column, block: Column) -> Column:
    return F.shiftright(start + block * BLOCK, PART)


def wanted(groups: DataFrame) -> DataFrame:
    """(part, tree, group, level, at): per leaf partition the coordinates of the nodes it has to fetch."""
    n_groups = groups.count()
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, HEIGHT)))
    units = groups.select("group", "n", "rank", "start", block.alias("block"))

    def ask(units: pa.Table) -> pa.Table:
        part, held, sizes, out = units.column("part")[0].as_py(), {}, {}, []
        ranks = set(units.column("rank").to_pylist())
        for group, n, block in zip(*(units.column(c).to_pylist() for c in ("group", "n", "block")), strict=True):
            held.setdefault(group, set()).add(block)
            sizes[group] = n
        for group, blocks in held.items():
            level = min(HEIGHT, height(sizes[group]))
            out += [(LANGUAGE, group, *c) for c in missing(blocks, -(-sizes[group] // (1 << level)), level)]
        out += [(SUBROOTS, "", *c) for c in missing(ranks, n_groups)]
        tree, group, level, at = zip(*out, strict=True) if out else ((), (), (), ())
        made = [pa.array([part] * len(out), pa.int64()), pa.array(tree, pa.int32()), pa.array(group, pa.string()), pa.array(level, pa.int32())]
        return pa.table([*made, pa.array(at, pa.int64())], names=["part", "tree", "group", "level", "at"])

    dealt = units.withColumn("part", _part(F.col("start"), F.col("block")))
    return dealt.groupBy("part").applyInArrow(ask, "part long, tree int, group string, level int, at long")


def proofs(made: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) and the carried columns, a row per document."""
    n_groups = made.groups.count()
    own = [f for f in made.leaves.schema if f.name not in ("group", "at", "n", "rank", "start")]
    names = [f.name for f in own]
    fetched = wanted(made.groups).join(made.nodes, ["tree", "group", "level", "at"])
    dealt = made.leaves.withColumn("part", _part(F.col("start"), F.shiftright("at", HEIGHT)))

    def expand(rows: pa.Table, given: pa.Table) -> pa.Table:
        sent: dict[tuple, dict] = {}
        for tree, group, level, at, own in zip(*(given.column(c).to_pylist() for c in ("tree", "group", "level", "at", "hash")), strict=True):
            sent.setdefault((tree, group), {})[level, at] = own
        columns = [rows.column(c).to_pylist() for c in ("group", "at", "leaf", "n", "rank")]
        known: dict[str, dict] = {}
        shape = {}
        for group, at, own, n, rank in zip(*columns, strict=True):
            known.setdefault(group, {})[at] = own
            shape[group] = n, rank
        trees = {g: derived(nodes, shape[g][0], sent.get((LANGUAGE, g), {})) for g, nodes in known.items()}
        top, _ = derived({shape[g][1]: root for g, (_, root) in trees.items()}, n_groups, sent.get((SUBROOTS, ""), {})) if trees else ([], "")
        ends, left, hashes = [0], [], []
        for group, at, *_, rank in zip(*columns, strict=True):
            for side, sibling in steps(trees[group][0], at) + steps(top, rank):
                left.append(side)
                hashes.append(sibling)
            ends.append(len(left))
        flat = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(hashes, pa.string())], ["left", "hash"])
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        subroots = pa.array([trees[g][1] for g in columns[0]], pa.string())
        return pa.table([*(rows.column(c) for c in names), subroots, proof], names=[*names, "subroot", "proof"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    expanded = dealt.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, f"{schema}, subroot string, proof {STEPS}")
    return expanded.withColumn("root", F.lit(made.root).cast("string"))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def step(below: Column, sibling: Column) -> Column:
        other = F.coalesce(sibling["hash"], F.lit(""))
        pair = F.when(sibling["left"], F.concat(other, below)).otherwise(F.concat(below, other))
        return F.sha2(pair.cast("binary"), 256)

    return F.aggregate(proof, start, step)


def proof_digest(proof: Column) -> Column:
    """One hash over all siblings of a proof."""
    siblings = F.array_compact(F.transform(proof, lambda s: s["hash"]))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)
