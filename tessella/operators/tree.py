"""Parent-child rows to full hierarchies.

1. Euler tours. Each node has an arc down into it and an arc up out of it; the successor of an arc follows from its first
   child or next sibling. Hot parents are handled by salting: siblings are ordered within one of `buckets` hash buckets
   and the buckets are chained, so no task sorts all children of one parent.
2. Parallel list ranking of the arcs by pointer doubling, with the sum of arcs up less arcs down. The tour of a tree ends with its
   root's arc up; that of a component with a cycle closes on itself and never ends, which tells them apart. What is left is
   peeled: a node survives j layers of leaf peeling exactly if it is in the image of the j-fold parent map, which is squared
   in each round, so round k peels 2**k layers. What survives are the nodes on cycles, the rest hangs below them.
3. The ranks give each node's root, depth, entry and exit: u is an ancestor of v exactly if they share the root and
   entry(u) < entry(v) < exit(u). In the order of root and entry, a node's ancestors are the intervals that are open at
   it. One scan in that order, which begins in every partition with the intervals that are open there, gives paths, ancestors and what is
   known of the root; so even a single tree is spread over many tasks and nothing is joined on a root.

Rounds are in number logarithmic in the size of the largest tree, and cut with reliable checkpoints. Finished rows leave the joins
as the moving side, so their null pointers never gather in one partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.common import dense_ordinals, durable, latest


def valid_sections(sections: DataFrame) -> DataFrame:
    """The valid row of each section: the one written last. Rows without a section_id are left out."""
    return latest(sections, "section_id", "written_at", "doc_id", "parent_id", "title", "path", "ordinal").drop("written_at")


def _ancestry(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Root, depth and titles of every node of the forest; and the nodes that reach no root, with their jump.

    nodes: id, parent (null at a root or where no such node exists), title.
    """
    steps = nodes.select("id", F.col("parent").alias("jump"), F.col("id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.array("title").alias("titles"), F.col("id").alias("least"))
    state = durable(steps)
    before = -1
    while True:
        going = state.filter("jump is not null")
        count = going.count()
        if count == 0 or count == before:
            break
        before = count
        # the state is the lookup as well: a row at an ancestor that has finished finishes too
        up = state.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("titles").alias("_titles"), F.col("least").alias("_least"), F.lit(True).alias("_known"))
        moved = going.join(up, going.jump == up._id).select(
            "id", F.col("_jump").alias("jump"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_titles", "titles").alias("titles"), F.least("least", "_least").alias("least")
        )
        state = durable(state.filter("jump is null").unionByName(moved))
    return state.filter("jump is null"), state.filter("jump is not null")


def _cycles(lost: DataFrame) -> DataFrame:
    """(id, fault, anchor) of nodes that reach no root: on a cycle, or below one. lost: id, jump, least."""
    state = durable(lost.select("id", "jump", "least"))
    before = None
    while True:
        image = state.select(F.col("jump").alias("id")).distinct()
        on = state.join(image, "id", "left_semi")
        now = on.agg(F.count("*"), F.count_distinct("least"), F.sum(F.xxhash64("id", "least").cast("decimal(38,0)"))).head()
        if now == before or now[0] == 0:
            break
        before = now
        up = state.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("least").alias("_least"))
        state = durable(state.join(up, state.jump == up._id).select("id", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least")))
    on = on.select("id", F.col("least").alias("anchor"))
    below = state.join(on.select("id"), "id", "left_anti").join(on.select(F.col("id").alias("jump"), "anchor"), "jump")
    return on.select("id", F.lit("cycle").alias("fault"), "anchor").unionByName(below.select("id", F.lit("below_cycle").alias("fault"), "anchor"))


def _arcs(forest: DataFrame, buckets: int) -> DataFrame:
    """The Euler tour as a linked list: (arc, next); arc 2*id goes down into a node and 2*id+1 up out of it. forest: id (bigint), parent,
    ordinal."""
    down, up = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    kids = forest.filter("parent is not null").select("id", "parent", "ordinal", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    inside = W.partitionBy("parent", "bucket").orderBy("ordinal", "id")
    linked = kids.withColumn("sibling", F.lead("id").over(inside))
    heads = kids.groupBy("parent", "bucket").agg(F.min(F.struct("ordinal", "id"))["id"].alias("head"))
    chain = heads.withColumn("after", F.lead("head").over(W.partitionBy("parent").orderBy("bucket")))  # at most `buckets` rows a parent
    first = chain.groupBy("parent").agg(F.min(F.struct("bucket", "head"))["head"].alias("child"))
    ups = linked.join(chain.select("parent", "bucket", "after"), ["parent", "bucket"]).select("id", "parent", F.coalesce("sibling", "after").alias("sibling"))
    into = forest.join(first.withColumnRenamed("parent", "id"), "id", "left").select(down("id").alias("arc"), F.coalesce(down("child"), up("id")).alias("next"))
    out = ups.select(up("id").alias("arc"), F.coalesce(down("sibling"), up("parent")).alias("next"))
    roots = forest.filter("parent is null").select(up("id").alias("arc"), F.lit(None).cast("bigint").alias("next"))
    return into.unionByName(out).unionByName(roots)


def list_rank(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arc, rank, height, last) of the arcs of lists that end: the number of elements to the end, itself included, the arcs up less the
    arcs down among them, and the last element; and (arc) of those on closed lists. arcs: arc, next."""
    state = durable(arcs.select("arc", "next", F.lit(1).cast("long").alias("rank"), F.when(F.col("arc") % 2 == 1, 1).otherwise(-1).cast("long").alias("height"), F.col("arc").alias("last")))
    before = -1
    while (going := state.filter("next is not null").count()) not in (0, before):  # a round that ends no arc leaves closed lists only
        before = going
        then = state.select(*(F.col(c).alias("_" + c) for c in state.columns))
        moved = state.filter("next is not null").join(then, F.col("next") == F.col("_arc"))
        moved = moved.select("arc", F.col("_next").alias("next"), (F.col("rank") + F.col("_rank")).alias("rank"), (F.col("height") + F.col("_height")).alias("height"), F.col("_last").alias("last"))
        state = durable(state.filter("next is null").unionByName(moved))
    return state.filter("next is null").drop("next"), state.filter("next is not null").select("arc")


#: What the scan knows of a tree: root, the length of its tour, its root's row; and the open intervals from some depth on.
Open = tuple[Any, int, dict | None, int, list]


def _follow(rows: Iterator[dict], state: Open, value: str) -> Iterator[tuple[dict, Open]]:
    """Each row, in the order of root and entry, with the intervals that are open at it, its own included."""
    root, length, head, base, stack = state
    for r in rows:
        if r["root"] != root:
            root, length, head, base, stack = r["root"], r["down"], r, r["depth"], []
            if r["depth"]:  # a partition that begins inside a tree and is given nothing
                length, head = 0, None
        if r["depth"] < base:
            base = r["depth"]
        del stack[r["depth"] - base :]
        stack.append(r[value])
        yield r, (root, length, head, base, stack)


def scan_tours(nodes: DataFrame, value: str, schema: str, use: Callable[[dict, int, dict, list], tuple]) -> DataFrame:
    """`use(row, length of the tour, root's row, [value of each ancestor and of itself])` for every row, as a table of the given schema.

    nodes: root, down and up (places from the end of the tour), depth, value and further columns. Of each partition only what is open at
    its end, a value for each level, comes to the driver and goes to the partitions behind it.
    """
    ordered = durable(nodes.repartitionByRange(F.col("root"), F.desc("down")).sortWithinPartitions(F.col("root"), F.desc("down")).withColumn("_p", F.spark_partition_id()))

    def ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, p = (None, 0, None, 0, []), None
        for b in it:
            for r, state in _follow(iter(b.to_pylist()), state, value):
                p = r["_p"]
        if p is not None:
            yield pa.RecordBatch.from_pylist([{"p": p, "state": pickle.dumps(state)}], schema=pa.schema([("p", pa.int32()), ("state", pa.binary())]))

    begins: dict[int, Open] = {}
    now: Open = (None, 0, None, 0, [])
    for p, state in sorted(tuple(r) for r in ordered.mapInArrow(ends, "p int, state binary").collect()):
        begins[p] = now
        root, length, head, base, stack = pickle.loads(state)
        now = (root, length, head, 0, stack) if head else (root, now[1], now[2], 0, now[4][:base] + stack)
    shared = nodes.sparkSession.sparkContext.broadcast(begins)
    names = [f.split()[0] for f in schema.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in it:
            rows = b.to_pylist()
            if state is None and rows:
                root, length, head, base, stack = shared.value[rows[0]["_p"]]
                state = root, length, head, base, list(stack)
            out = []
            for r, state in _follow(iter(rows), state, value):
                out.append(use(r, state[1], state[2], list(state[4])))
            kinds = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, schema.split(", "), strict=True)], names=names)

    return ordered.mapInArrow(batches, schema)


PLACED = "section_id string, doc_id string, parent_id string, root_id string, depth bigint, path array<string>, entry bigint, exit bigint, root_doc string, root_parent string"


def section_trees(sections: DataFrame, buckets: int = 32) -> DataFrame:
    """Every section, by its valid row, with its place in its tree and the first fault that applies.

    Columns: section_id, doc_id, parent_id (null at a root), root_id, depth (0 at the root), path (titles from the root), entry and exit (position in
    the Euler tour of the root's tree, from 0), descendants (their number), fault, anchor_id.

    A null or empty parent_id marks a root. A node whose parent does not exist counts as the root of what hangs below it.
    Sections on or below a cycle have no root, depth, path or interval (null). Rows without section_id are left out;
    repeated and older rows count once; further columns of the input are ignored; an empty table gives an empty one.
    """
    valid = valid_sections(sections).withColumn("parent_id", F.expr("nullif(parent_id, '')"))
    # numbers in the order of section_id stand for the nodes in all rounds; the smallest number of a cycle is its smallest id
    rows = durable(dense_ordinals(valid.withColumnRenamed("ordinal", "_place"), "section_id").withColumnRenamed("ordinal", "id"))
    known = rows.select(F.col("section_id").alias("parent_id"), F.col("id").alias("parent"))
    nodes = durable(rows.select("id", "parent_id", F.col("_place").alias("ordinal")).join(known, "parent_id", "left").select("id", "parent", "ordinal"))
    ended, closed = list_rank(_arcs(nodes, buckets))
    way = F.col("arc") % 2
    places = ended.groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(F.max(F.when(way == 0, F.col("rank"))).alias("down"), F.max(F.when(way == 1, F.col("rank"))).alias("up"), F.max(F.when(way == 0, F.col("height"))).alias("depth"), F.max(F.floor(F.col("last") / 2)).alias("root"))
    own = rows.select("id", "section_id", "doc_id", "parent_id", "title", "path")
    everywhere = own.withColumnRenamed("path", "_stored").join(places, "id")

    def place(r: dict, length: int, head: dict, path: list) -> tuple:
        parent = r["parent_id"] if r["depth"] else None
        return r["section_id"], r["doc_id"], parent, head["section_id"], r["depth"], path, length - r["down"], length - r["up"], head["doc_id"], head["parent_id"], r["_stored"]

    placed = scan_tours(everywhere, "title", PLACED + ", stored array<string>", place)
    fault = F.when(F.col("root_parent").isNotNull(), F.lit("missing_parent")).when(~F.col("root_doc").eqNullSafe(F.col("doc_id")), F.lit("foreign_root")).when(~F.col("stored").eqNullSafe(F.col("path")), F.lit("stale_path"))
    placed = placed.withColumn("fault", fault).withColumn("anchor_id", F.when(F.col("fault") == "missing_parent", F.col("root_parent")).when(F.col("fault").isNotNull(), F.col("root_id")))
    placed = placed.select("section_id", "doc_id", "parent_id", "root_id", "depth", "path", "entry", "exit", ((F.col("exit") - F.col("entry") - 1) / 2).cast("long").alias("descendants"), "fault", "anchor_id")

    lost = nodes.join(closed.filter(way == 0).select(F.floor(F.col("arc") / 2).alias("id")), "id").select("id", F.col("parent").alias("jump"), F.col("id").alias("least"))
    name = rows.select(F.col("id").alias("anchor"), F.col("section_id").alias("anchor_id"))
    loops = _cycles(lost).join(name, "anchor").join(own, "id")
    empty = {"root_id": "string", "depth": "bigint", "path": "array<string>", "entry": "bigint", "exit": "bigint", "descendants": "bigint"}
    return placed.unionByName(loops.select("section_id", "doc_id", "parent_id", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), "fault", "anchor_id"))


def faulty_sections(sections: DataFrame) -> DataFrame:
    """(section_id, fault, anchor_id) of the sections that have a fault."""
    return section_trees(sections).filter("fault is not null").select("section_id", "fault", "anchor_id")


def descendant_pairs(trees: DataFrame) -> DataFrame:
    """(section_id, descendant_id) for every ancestor and descendant of the sound forest; the result has as many rows as the
    sum of all depths. trees: section_trees(); each section is paired with the sections whose intervals are open at it."""
    sound = trees.filter("root_id is not null").select("section_id", F.col("root_id").alias("root"), (-F.col("entry")).alias("down"), "depth")
    chains = scan_tours(sound, "section_id", "descendant_id string, above array<string>", lambda r, length, head, path: (r["section_id"], path[:-1]))
    return chains.select(F.explode("above").alias("section_id"), "descendant_id")
