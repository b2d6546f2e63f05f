"""Parent-child rows to full hierarchies.

Steps: leaves are peeled to expose cycles, one edge of every cycle is cut, the
forest's Euler tours are built as lists of entry and exit arcs, parallel list
ranking (:mod:`quillon.operators.pointers`) gives each arc its distance from the
end of its tour, and the entry-exit intervals give depth, root, ancestors,
descendants and paths.

Defined results: rows with a null id are no nodes; of several rows with one id the
greatest ``order`` holds (ties cannot occur where ``order`` is unique; among equal
orders the greatest parent holds); a parent that is null, empty or nobody's id
makes a root.  An empty table gives an empty result.  Columns other than the three
named are never looked at, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import pointers
from quillon.session import Scratch

#: Siblings are chained inside blocks of so many neighbouring keys, then block to block, so that a parent with any number of children fits.
SIBLING_BLOCK_BITS = 16
#: Positions of a tour that one path scan holds.
PATH_BLOCK = 1 << 16


def _nodes(df: DataFrame, node_id: str, parent_id: str, order: str, scratch: Scratch) -> DataFrame:
    """``(k, id, parent)``: one row an id; ``k`` numbers the ids so that neighbours in the order of ids have neighbouring numbers."""
    rows = df.select(F.col(node_id).cast("string").alias("id"), F.col(parent_id).cast("string").alias("parent"), F.col(order).alias("o")).where("id is not null")
    last = rows.groupBy("id").agg(F.max(F.struct("o", "parent")).alias("m")).select("id", F.nullif(F.col("m.parent"), F.lit("")).alias("parent"))
    ordered = last.repartitionByRange("id").sortWithinPartitions("id")
    return scratch.save(ordered.select(F.monotonically_increasing_id().alias("k"), "id", "parent"), "nodes")


def _edges(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(k, pk)``, ``pk`` null for roots.  Null parents stay out of the join, else they would all meet in one task."""
    named = nodes.where("parent is not null")
    parents = nodes.select(F.col("k").alias("pk"), F.col("id").alias("pid"))
    linked = named.join(parents, F.col("parent") == F.col("pid"), "left").select("k", "pk")
    alone = nodes.where("parent is null").select("k", F.lit(None).cast("long").alias("pk"))
    return scratch.save(linked.unionByName(alone), "edges")


def _rows(df: DataFrame, key, ptr, gain) -> DataFrame:
    """Pointer rows; a null ``ptr`` ends at the row itself."""
    end = ptr.isNull()
    return df.select(key.alias("key"), F.coalesce(ptr, key).alias("ptr"), F.when(end, 0).otherwise(1).cast("long").alias("steps"), F.when(end, 0).otherwise(gain).cast("long").alias("gain"), end.alias("done"))


def _cuts(edges: DataFrame, scratch: Scratch, core_limit: int) -> DataFrame:
    """``(r, p)``: one node of every cycle and its parent."""
    rows = _rows(edges, F.col("k"), F.col("pk"), F.lit(0))
    levels, core = pointers.contract(rows, F.shiftright("key", 33), scratch, "peel", cut=True, core_limit=core_limit)
    marked = core.where("gain = -1").select("key")
    for level in levels:
        marked = marked.unionByName(level.where("gain = -1").select("key"))
    marked = marked.distinct().select(F.col("key").alias("r"))
    return scratch.save(edges.join(marked, F.col("k") == F.col("r")).select("r", F.col("pk").alias("p")), "cuts")


def _tour(edges: DataFrame, cuts: DataFrame, scratch: Scratch, core_limit: int) -> DataFrame:
    """``(key, ptr, steps, gain)`` of every arc: node ``k`` is entered by arc ``2k`` and left by ``2k+1``."""
    forest = edges.join(cuts, F.col("k") == F.col("r"), "left").select("k", F.when(F.col("r").isNull(), F.col("pk")).alias("pk"))
    block = F.shiftright("k", SIBLING_BLOCK_BITS)
    own = Window.partitionBy("pk", "block")
    chained = forest.where("pk is not null").withColumn("block", block).select("k", "pk", "block", F.lead("k").over(own.orderBy("k")).alias("nxt"), F.min("k").over(own).alias("first"))
    chained = scratch.save(chained, "siblings")
    blocks = chained.where("nxt is null").select(F.col("k").alias("last"), "pk", "first", F.lead("first").over(Window.partitionBy("pk").orderBy("block")).alias("nf"), F.row_number().over(Window.partitionBy("pk").orderBy("block")).alias("rn"))
    blocks = scratch.save(blocks, "blocks")
    exits = chained.where("nxt is not null").select((F.col("k") * 2 + 1).alias("a"), (F.col("nxt") * 2).alias("b"))
    exits = exits.unionByName(blocks.select((F.col("last") * 2 + 1).alias("a"), F.coalesce(F.col("nf") * 2, F.col("pk") * 2 + 1).alias("b")))
    exits = exits.unionByName(forest.where("pk is null").select((F.col("k") * 2 + 1).alias("a"), F.lit(None).cast("long").alias("b")))
    firsts = blocks.where("rn = 1").select(F.col("pk").alias("fk"), "first")
    enters = forest.join(firsts, F.col("k") == F.col("fk"), "left").select((F.col("k") * 2).alias("a"), F.coalesce(F.col("first") * 2, F.col("k") * 2 + 1).alias("b"))
    arcs = _rows(enters.unionByName(exits), F.col("a"), F.col("b"), F.when(F.col("a") % 2 == 0, 1).otherwise(-1))
    levels, core = pointers.contract(arcs, F.shiftright("key", 34), scratch, "tour", core_limit=core_limit)
    return scratch.save(pointers.expand(levels, core), "ranked")


class Hierarchy:
    """The ranked forest of a table of parent-child rows.

    ``Hierarchy(df, "id", "parent_id", "node_key")`` builds it; the methods are plans
    over its written tables.
    """

    def __init__(self, df: DataFrame, node_id: str = "id", parent_id: str = "parent_id", order: str = "node_key", core_limit: int = pointers.CORE_LIMIT):
        self.scratch = Scratch(df.sparkSession, "hierarchy")
        self.nodes = _nodes(df, node_id, parent_id, order, self.scratch)
        edges = _edges(self.nodes, self.scratch)
        self.cuts = _cuts(edges, self.scratch, core_limit)
        self.arcs = _tour(edges, self.cuts, self.scratch, core_limit)
        for gone in ("edges", "siblings", "blocks", "peel-jump0", "peel-core", "tour-jump0", "tour-core"):
            self.scratch.drop(gone)

    def intervals(self, arcs: DataFrame | None = None) -> DataFrame:
        """``(k, root, depth, entry, exit)``: positions count from the end of the tour, so ``entry > exit``; a node's descendants are the nodes of its root whose entry lies between."""
        arcs = self.arcs if arcs is None else arcs
        entering = F.col("key") % 2 == 0
        return arcs.groupBy(F.shiftright("key", 1).alias("k")).agg(
            F.max(F.shiftright("ptr", 1)).alias("root"), F.max(F.when(entering, 1 - F.col("gain"))).alias("depth"), F.max(F.when(entering, F.col("steps"))).alias("entry"), F.max(F.when(~entering, F.col("steps"))).alias("exit")
        )

    def _on_cycles(self) -> tuple[DataFrame, DataFrame]:
        """``(c, mark)`` of the nodes that reach no root (-1 on a cycle, -2 leading into one) and ``(cut, cycle_id)`` with the smallest id on the cycle: the ancestors of the cut parent are the cycle."""
        ends = self.cuts.select((F.col("r") * 2 + 1).alias("end"), (F.col("p") * 2).alias("pin"))
        bad = self.intervals(self.arcs.join(ends, F.col("ptr") == F.col("end"), "left_semi"))
        at = self.arcs.join(ends, F.col("key") == F.col("pin")).select(F.shiftright("end", 1).alias("cut"), F.col("steps").alias("at"))
        marked = bad.join(at, F.col("root") == F.col("cut")).select(F.col("k").alias("c"), "cut", F.when(F.col("at").between(F.col("exit"), F.col("entry")), -1).otherwise(-2).alias("mark"))
        marked = self.scratch.save(marked, "cyclic")
        names = marked.where("mark = -1").join(self.nodes, F.col("c") == F.col("k")).groupBy("cut").agg(F.min("id").alias("cycle_id"))
        return marked, self.scratch.save(names, "cycle_ids")

    def found(self) -> DataFrame:
        """``(node_id, root_id, depth)``: depth 0 and up below a root, -1 on a cycle, -2 leading into one; those two have the smallest id on the cycle as root_id."""
        marked, names = self._on_cycles()
        entered = self.arcs.where("key % 2 = 0").select(F.shiftright("key", 1).alias("node"), F.shiftright("ptr", 1).alias("root"), (1 - F.col("gain")).alias("depth"))
        ids = self.nodes.select("k", "id")
        roots = entered.where("depth = 0").join(ids, F.col("node") == F.col("k")).join(names, F.col("node") == F.col("cut"), "left").select(F.col("node").alias("rk"), F.coalesce("cycle_id", "id").alias("root_id"))
        return (
            entered.join(ids, F.col("node") == F.col("k"))
            .select("node", F.col("id").alias("node_id"), "root", "depth")
            .join(marked.select("c", "mark"), F.col("node") == F.col("c"), "left")
            .join(roots, F.col("root") == F.col("rk"))
            .select("node_id", "root_id", F.coalesce("mark", "depth").cast("int").alias("depth"))
        )

    def spans(self) -> DataFrame:
        """``(node_id, entry, exit, n_descendants)`` with the root's number; on cyclic components the tree is the one left by the cut."""
        iv = self.intervals()
        return iv.join(self.nodes.select("k", "id"), "k").select(F.col("id").alias("node_id"), "root", F.col("depth").cast("int").alias("tree_depth"), "entry", "exit", F.expr("(entry - exit + 1) div 2 - 1").alias("n_descendants"))

    def paths(self, separator: str = " > ") -> DataFrame:
        """``(node_id, path)``: ids from the root to the node.

        Tours are cut into blocks of :data:`PATH_BLOCK` positions.  A block's task scans
        its entries in order with a stack of open nodes; nodes that are open across a
        block border are sent to the later blocks as well.
        """
        iv = self.intervals().join(self.nodes.select("k", "id"), "k")
        first, final = F.expr(f"entry div {PATH_BLOCK}"), F.expr(f"exit div {PATH_BLOCK}")
        spread = iv.select("root", "entry", "exit", "id", "depth", F.explode(F.sequence(final, first)).alias("block"), first.alias("home"))
        packed = spread.repartition("root", "block").sortWithinPartitions("root", F.desc("block"), F.desc("entry"))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, stack = None, []
            for b in batches:
                ids, paths = [], []
                for root, entry, exit_, name, block, home in zip(*(b.column(c).to_pylist() for c in ("root", "entry", "exit", "id", "block", "home"))):
                    if at != (root, block):
                        at, stack = (root, block), []
                    while stack and stack[-1][0] > entry:
                        stack.pop()
                    path = stack[-1][1] + separator + name if stack else name
                    stack.append((exit_, path))
                    if block == home:
                        ids.append(name)
                        paths.append(path)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(paths, pa.string())], names=["node_id", "path"])

        return packed.mapInArrow(scan, "node_id string, path string")

    def ancestors(self, node_ids: DataFrame) -> DataFrame:
        """``(node_id, ancestor_id)`` of the given ids (one column), nearest and farthest alike, read off the paths."""
        wanted = node_ids.toDF("node_id").distinct()
        sep = "\u0000"
        return self.paths(sep).join(wanted, "node_id", "left_semi").select("node_id", F.explode(F.expr(r"slice(split(path, '\u0000'), 1, size(split(path, '\u0000')) - 1)")).alias("ancestor_id"))

    def descendants(self, node_ids: DataFrame) -> DataFrame:
        """``(node_id, descendant_id)``: every entry of the same tour between the node's own entry and exit, joined block by block so that a tour of any length is spread."""
        wanted = node_ids.toDF("id").distinct()
        iv = self.intervals().join(self.nodes.select("k", "id"), "k")
        tops = iv.join(wanted, "id", "left_semi").select(F.col("id").alias("node_id"), F.col("root").alias("t_root"), F.col("entry").alias("t_entry"), F.col("exit").alias("t_exit"), F.explode(F.sequence(F.expr(f"exit div {PATH_BLOCK}"), F.expr(f"entry div {PATH_BLOCK}"))).alias("t_block"))
        inner = iv.select("root", "entry", F.expr(f"entry div {PATH_BLOCK}").alias("block"), F.col("id").alias("descendant_id"))
        hit = (F.col("root") == F.col("t_root")) & (F.col("block") == F.col("t_block")) & (F.col("entry") < F.col("t_entry")) & (F.col("entry") > F.col("t_exit"))
        return tops.join(inner, hit).select("node_id", "descendant_id")
