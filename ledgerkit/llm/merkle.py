"""Operator 11 - Merkle dataset manifest: checkpoint and recompute.

* A leaf is the hash of one row's fields. Leaves of a tree (one per language) ascend by
  id; every two consecutive nodes are hashed into their parent, a last single node alone.
  What remains of each tree is a leaf of the root tree.
* ``build`` climbs ``STEP`` levels at once and persists only the nodes at the end of each
  climb: an aligned subtree of ``2 ** STEP`` stored nodes is one row of a map.
* ``proofs`` goes down from the root: the nodes between two stored levels are made again
  per subtree from its stored descendants, the siblings are emitted as paths and the
  nodes discarded. All leaves of a subtree share the path above it, so paths are stored
  per subtree, never per leaf.

Scale: texts are hashed in one map; what is shuffled is an id and a hash per row. Positions
come from range-sorted partitions and their counts, so a language with most of the
rows is spread over all tasks; a subtree has at most ``2 ** STEP`` rows.

Defined results: null fields are hashed as ``-``; null ids come first and are not
altered; a null language is a tree of its own, the first; rows with equal ids are leaves of
their own in order of their hash; an empty table has no leaves and an empty result; extra
columns are ignored; texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import materialize, pick
from ledgerkit.operators.ordered import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = 6
TAMPER_EVERY = 7
BLOCKS_AT_ONCE = 256


# --------------------------------------------------------------------------- leaves
def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**fields: Column) -> Column:
    """Hash (32 bytes) of a row's fields, in the order of ``FIELDS``."""
    return F.unhex(F.sha2(F.concat(*[_field(fields[f]) for f in FIELDS]), 256))


def tampered(fields: dict[str, Column]) -> dict[str, Column]:
    """The same row with 1 added to ``n_chars`` (as a decimal: no overflow)."""
    return fields | {"n_chars": fields["n_chars"].cast("decimal(20,0)") + 1}


def leaves(docs: DataFrame, every: int = TAMPER_EVERY) -> DataFrame:
    """``key, doc_id, lang, h, altered``: the tree's key (sorts as the language, null first),
    the leaf, and the leaf that is found later where the row was tampered with."""
    fields = {f: F.col(f) for f in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return pick(docs, *FIELDS).select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "lang",
        leaf_of(**fields).alias("h"), F.when(hit, leaf_of(**tampered(fields))).alias("altered"), F.monotonically_increasing_id().alias("tie"))


# --------------------------------------------------------------------------- subtrees
def node(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def climbs(n: int, step: int) -> int:
    """Levels from ``n`` nodes towards one, at most ``step``."""
    return min(step, (n - 1).bit_length())


def subtree(hashes: list[str], levels: int) -> list[list[str]]:
    """All levels of an aligned subtree, the given nodes first."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([node("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def path_in(tree: list[list[str]], at: int) -> str:
    """Path of node ``at`` to the top of ``tree``: per level ``L`` or ``R`` (the side of the
    sibling) and the sibling, or ``-`` without one."""
    steps = []
    for level in tree[:-1]:
        other = at ^ 1
        steps.append("-" if other >= len(level) else ("R" if other > at else "L") + level[other])
        at >>= 1
    return "".join(steps)


def siblings(path: str) -> str:
    return path.translate({ord(c): None for c in "LR-"})


def fold(leaf: str, path: str) -> str:
    """The root to which ``leaf`` leads along ``path``."""
    at = 0
    while at < len(path):
        if path[at] == "-":
            leaf, at = node(leaf), at + 1
        else:
            other = path[at + 1 : at + 65]
            leaf, at = node(other + leaf if path[at] == "L" else leaf + other), at + 65
    return leaf


def _blocks(nodes: DataFrame, step: int, *payload: str) -> DataFrame:
    """One row per aligned subtree: ``key, block, n, nodes`` (at most ``2 ** step`` of them)."""
    member = F.struct("pos", "h", *payload)
    return nodes.groupBy("key", F.shiftright("pos", step).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(member)).alias("nodes"))


def _map_blocks(blocks: DataFrame, work: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``work`` yields output rows for one block (its columns as arguments)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                part = batch.slice(start, BLOCKS_AT_ONCE)
                rows = [r for block in zip(*[c.to_pylist() for c in part.columns]) for r in work(*block)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return blocks.mapInArrow(run, schema)


_NODE = "key string, pos long, n long, h binary"


def _climber(step: int):
    def work(key, block, n, nodes):
        levels = climbs(n, step)
        top = subtree([x["h"].hex() for x in nodes], levels)[-1]
        yield key, block, -(-n >> levels) if levels else n, bytes.fromhex(top[0])

    return work


@dataclass(frozen=True)
class Forest:
    """Stored levels of many trees: ``levels[0]`` the leaves, then every ``step``-th level up
    to the trees' tops (``n`` is 1 there)."""

    levels: list[DataFrame]
    step: int

    def tops(self) -> DataFrame:
        """``key, h`` of what remains of each tree."""
        found = [level.where("n = 1").select("key", "h") for level in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out


def climb(base: DataFrame, step: int = STEP) -> Forest:
    """Persist every ``step``-th level above ``base`` (``key, pos, n, h``)."""
    levels = [base]
    while not levels[-1].where("n > 1").isEmpty():
        blocks = _blocks(levels[-1].where("n > 1"), step)
        levels.append(materialize(_map_blocks(blocks, _climber(step), _NODE), "llm-merkle-level"))
    return Forest(levels, step)


def _pather(step: int):
    def work(key, block, n, nodes, above):
        tree = subtree([x["h"].hex() for x in nodes], climbs(n, step))
        for i, x in enumerate(nodes):
            yield key, x["pos"], path_in(tree, i) + above

    return work


def _with_above(level: DataFrame, above: DataFrame, step: int, *payload: str) -> DataFrame:
    """The blocks of a stored level with the path above each."""
    over = above.select("key", F.col("pos").alias("block"), F.col("path").alias("above"))
    return _blocks(level, step, *payload).join(over, ["key", "block"])


def paths_above(forest: Forest, tops: DataFrame) -> DataFrame:
    """``key, pos, path`` for every subtree of the leaves: the path from its top to the
    root. ``tops`` (``key, path``): the path of each tree's top."""
    top = tops.select("key", F.lit(0).cast("long").alias("pos"), "path")
    above = top.limit(0)
    for level, stored in reversed(list(enumerate(forest.levels))):
        # trees that end at this level: nothing of theirs is stored above it
        ended = stored.where("n = 1").select("key").join(top, "key").select("key", "pos", "path")
        above = above.unionAll(ended)
        if level:
            blocks = _with_above(stored, above, forest.step)
            above = materialize(_map_blocks(blocks, _pather(forest.step), "key string, pos long, path string"), "llm-merkle-paths")
    return above


# --------------------------------------------------------------------------- manifest
@dataclass(frozen=True)
class Manifest:
    trees: Forest       # one tree per language over all documents
    root_tree: Forest   # one tree over the languages' roots

    def subroots(self) -> DataFrame:
        """``key, h`` per language."""
        return self.trees.tops()

    def root(self) -> str | None:
        """The one hash of the whole dataset; None if it is empty."""
        row = self.root_tree.tops().first()
        return None if row is None else bytes(row["h"]).hex()


def build(docs: DataFrame, step: int = STEP, every: int = TAMPER_EVERY) -> Manifest:
    """Hash all documents and persist every ``step``-th level."""
    rows = materialize(leaves(docs, every), "llm-merkle-leaves")
    base = numbered(rows, "key", ["doc_id", "h", "tie"]).drop("tie")
    trees = climb(materialize(base, "llm-merkle-base"), step)
    tops = materialize(trees.tops(), "llm-merkle-subroots").select(F.lit("").alias("key"), F.col("key").alias("tree"), "h")
    return Manifest(trees, climb(materialize(numbered(tops, "key", ["tree"]), "llm-merkle-root-base"), step))


def _prover(step: int, root: str):
    def work(key, block, n, nodes, above, subroot):
        tree = subtree([x["h"].hex() for x in nodes], climbs(n, step))
        for i, x in enumerate(nodes):
            leaf = tree[0][i]
            path = path_in(tree, i) + above
            found = leaf if x["altered"] is None else x["altered"].hex()
            folded = fold(found, path)
            digest = hashlib.sha256(siblings(path).encode()).hexdigest()
            yield x["doc_id"], x["lang"], x["pos"], leaf, subroot.hex(), root, path, digest, folded, folded == root

    return work


_PROOF = ("doc_id long, lang string, position long, leaf string, subroot string, root string, path string, proof_sha256 string, "
          "folded_root string, verified boolean")


def proofs(manifest: Manifest) -> DataFrame:
    """One row per document: its leaf, its path to the root (side and sibling per level),
    the root recomputed from what is found now, and whether it is the manifest's."""
    step = manifest.trees.step
    subroots = materialize(manifest.subroots(), "llm-merkle-subroots")
    base, lone = manifest.root_tree.levels[0], F.lit("")
    above = paths_above(manifest.root_tree, manifest.root_tree.tops().select("key", lone.alias("path")))
    blocks = _with_above(base, above, step, "tree")

    def work(key, block, n, nodes, over):
        tree = subtree([x["h"].hex() for x in nodes], climbs(n, step))
        for i, x in enumerate(nodes):
            yield x["tree"], path_in(tree, i) + over

    tops = materialize(_map_blocks(blocks, work, "key string, path string"), "llm-merkle-tops")
    above = paths_above(manifest.trees, tops)
    blocks = _with_above(manifest.trees.levels[0], above, step, "doc_id", "lang", "altered")
    rows = blocks.join(subroots.withColumnRenamed("h", "subroot"), "key")
    return _map_blocks(rows, _prover(step, manifest.root() or ""), _PROOF)
