"""A Merkle manifest of a table: one tree a source, their roots in a tree above, and a proof for every row.

Rows are numbered by a range sort (so a source of any share spreads over tasks), then vertex
programs run as supersteps on RDDs, Pregel-style. Upward, a vertex sends its digest to its
parent; a parent keeps what it has until all its children have written, then hashes and
writes on. Trees of different heights meet in the tree above, whose vertices wait the
longer. Downward, each vertex sends its children the siblings on their way to the root; the
lowest vertices, which hold the rows of one run, fold every row's digest up that path.

Every superstep ends as a table in the shared folder: a lost executor costs a re-read, and
the lineage never grows. A vertex holds at most ``arity`` children; nothing but the root
and two counts reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import partitions, staged

TOP = -1  # the tree above all sources' trees, which are numbered from 0
_RUNS = "tree long, idx long, n long, leaves array<struct<slot:int,doc_id:long,leaf:string,seen:string>>"
_VERTICES = "tree long, level int, idx long, n long, step int, done boolean, hash string, children array<struct<slot:int,hash:string,level:int,step:int>>"
_MESSAGES = "tree long, level int, idx long, step int, subroot string, path array<struct<slot:int,others:array<string>>>"
_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` if null."""

    def shown(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.sha2(F.concat(*map(shown, fields)).cast("binary"), 256)


def lowered(doc_id: Column, text: Column) -> Column:
    """The tampering of the query: A-Z become a-z where 5 divides the unsigned crc32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(text)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(hashed: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a digest reaches over a path of its slots and siblings."""
    for slot, others in path:
        hashed = digest([*others[:slot], hashed, *others[slot:]])
    return hashed


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df``, staged, with ``number``, its place from 0 in the given order, and the sorted
    table's ``part``. The ordered window holds a row a partition."""
    sort = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = staged(sort.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.count("*").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(parts, "part").withColumn("number", F.col("_before") + F.col("_at")).drop("_before", "_at")


def _placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """``tree, idx, n, doc_id, leaf, seen`` of every row, and the number of trees. Sources are
    joined by the part of the sort as well, so that a large one is no single key."""
    rows = numbered(leaves, "source", "doc_id", "leaf", "seen")
    held = rows.groupBy("source", "part").agg(F.count("*").alias("c"), F.min("number").alias("first"))
    whole = Window.partitionBy("source")
    held = held.select("source", "part", F.sum("c").over(whole).alias("n"), F.min("first").over(whole).alias("first"))
    trees = numbered(held.groupBy("source").agg(F.first("n").alias("n")), "source").select("source", F.col("number").alias("tree"))
    trees = staged(trees, "trees")
    held = held.join(trees, held.source.eqNullSafe(trees.source)).select(held.source.alias("of"), F.col("part").alias("at"), "n", "first", "tree")
    placed = rows.join(held.hint("merge"), rows.source.eqNullSafe(F.col("of")) & (rows.part == F.col("at")))
    return placed.select("tree", (F.col("number") - F.col("first")).alias("idx"), "n", "doc_id", "leaf", "seen"), trees.count()


class Shape:
    """Where a vertex of a forest of so many trees sends its digest."""

    def __init__(self, trees: int, arity: int):
        self.trees, self.arity = trees, arity

    def width(self, n: int, level: int) -> int:
        """Vertices of a level of a tree of n leaves."""
        for _ in range(level):
            n = -(-n // self.arity)
        return n

    def parent(self, tree: int, level: int, idx: int, n: int) -> tuple[tuple[int, int, int], int, int] | None:
        """Key, leaves of the tree, and slot; none above the root."""
        if self.width(n, level) > 1:
            return (tree, level + 1, idx // self.arity), n, idx % self.arity
        if tree == TOP or self.trees == 1:
            return None
        return (TOP, 1, tree // self.arity), self.trees, tree % self.arity

    def expected(self, level: int, idx: int, n: int) -> int:
        return min(self.arity, self.width(n, level - 1) - idx * self.arity)

    def upward(self, row) -> Iterator[tuple]:
        """Messages of a vertex: its digest to its parent or, where it still waits, what it has to itself."""
        if not row.done:
            for c in row.children:
                yield (row.tree, row.level, row.idx), (row.n, tuple(c))
        elif (to := self.parent(row.tree, row.level, row.idx, row.n)) is not None:
            yield to[0], (to[1], (to[2], row.hash, row.level, row.step))

    def received(self, step: int):
        def vertex(item):
            (tree, level, idx), messages = item
            messages = list(messages)
            n, children = messages[0][0], sorted(m[1] for m in messages)
            done = len(children) == self.expected(level, idx, n)
            return tree, level, idx, n, step, done, digest(c[1] for c in children) if done else None, children

        return vertex

    def downward(self, row, path: list, subroot: str | None) -> Iterator[tuple]:
        """Messages of a vertex to its children: the siblings of each, and the path above."""
        hashes = [c.hash for c in row.children]
        for k, c in enumerate(row.children):
            way = [(k, hashes[:k] + hashes[k + 1 :]), *path]
            below = row.idx * self.arity + k
            if row.tree == TOP and row.level == 1:
                yield below, c.level, 0, c.step, c.hash, way
            else:
                yield row.tree, row.level - 1, below, c.step, subroot, way


def proven(leaves: DataFrame, arity: int = 16, with_paths: bool = False) -> DataFrame:
    """One row for each of ``leaves(doc_id long, source, leaf, seen)``: its ``leaf``, its source's
    ``subroot``, the ``root``, ``proof_sha256`` (of its siblings, level by level up to the
    root), ``folded_root`` (from ``seen``, the digest to verify, and the siblings) and
    ``verified``; with ``with_paths`` also ``path``, slots and siblings by level.

    In a source rows ascend by doc_id (null first), equal ones by digest; sources ascend by
    their bytes, null first. A lone row is its source's subroot, a lone source's subroot the
    root. An empty table gives no rows. Repeated rows are leaves of their own; a null
    ``seen`` can't be verified: its ``folded_root`` is null.
    """
    if arity < 2:
        raise ValueError("a vertex needs two children or more")
    spark, schema = leaves.sparkSession, _PROOFS + (", path array<struct<slot:int,others:array<string>>>" if with_paths else "")
    leaves = staged(leaves.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "leaf", "seen"), "leaves")
    placed, trees = _placed(leaves)
    if not trees:
        return spark.createDataFrame([], schema)
    shape, dealt = Shape(trees, arity), partitions(spark)

    def table(rdd, kinds: str, name: str) -> DataFrame:
        return staged(spark.createDataFrame(rdd, kinds, verifySchema=False), name)

    def run(item):
        (tree, idx), rows = item
        rows = sorted(rows, key=lambda r: r[1])
        return tree, idx, rows[0][0], [(k, *r[2:]) for k, r in enumerate(rows)]

    held = placed.rdd.map(lambda r: ((r.tree, r.idx // arity), (r.n, r.idx, r.doc_id, r.leaf, r.seen))).groupByKey(dealt)
    runs = table(held.map(run), _RUNS, "runs")

    def lowest(r):
        """A run's own vertex; the run of a lone row is that row, a level lower."""
        hashes = [x.leaf for x in r.leaves]
        return r.tree, int(r.n > 1), r.idx, r.n, 1, True, digest(hashes) if r.n > 1 else hashes[0], []

    steps = [table(runs.rdd.map(lowest), _VERTICES, "vertices")]
    top = trees if trees > 1 else None
    while True:
        last = steps[-1].filter("done").filter(F.col("tree") == (TOP if top else 0))
        last = [r for r in last.select("tree", "level", "idx", "n", "hash").filter("idx = 0").collect() if shape.parent(r.tree, r.level, r.idx, r.n) is None]
        if last:
            break
        sent = steps[-1].rdd.flatMap(shape.upward).groupByKey(dealt)
        steps.append(table(sent.map(shape.received(len(steps) + 1)), _VERTICES, "vertices"))
    root = last[0]
    known = root.hash

    begun = [(root.tree, root.level, root.idx, len(steps), known if trees == 1 else None, [])]
    sent = [spark.createDataFrame(begun, _MESSAGES)]

    def inbox(step: int):
        out = sent[0].filter(F.col("step") == step)
        for m in sent[1:]:
            out = out.unionByName(m.filter(F.col("step") == step))
        return out.rdd.map(lambda m: ((m.tree, m.level, m.idx), (m.subroot, [(p.slot, p.others) for p in m.path])))

    for step in range(len(steps), 1, -1):
        vertices = steps[step - 1].filter("done").rdd.map(lambda v: ((v.tree, v.level, v.idx), v))
        met = vertices.join(inbox(step), dealt)
        sent.append(table(met.flatMap(lambda x: shape.downward(x[1][0], x[1][1][1], x[1][1][0])), _MESSAGES, "messages"))

    def proofs(item):
        run, (subroot, above) = item[1]
        hashes = [x.leaf for x in run.leaves]
        for k, x in enumerate(run.leaves):
            path = [(k, hashes[:k] + hashes[k + 1 :]), *above] if run.n > 1 else above
            folded = None if x.seen is None else fold(x.seen, path)
            row = (x.doc_id, x.leaf, subroot, known, digest(o for _, others in path for o in others), folded, folded == known)
            yield (*row, path) if with_paths else row

    keyed = runs.rdd.map(lambda r: ((r.tree, int(r.n > 1), r.idx), r))
    return spark.createDataFrame(keyed.join(inbox(1), dealt).flatMap(proofs), schema, verifySchema=False)


def manifest(docs: DataFrame, seen_text: Column | None = None, **how) -> DataFrame:
    """Proofs of ``docs(doc_id, source, lang, n_chars, text)``; ``seen_text``, if given, is the
    text as found later, to be verified against the tree of the given text. Other columns
    don't count; nulls in any column have a digest of their own."""
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    whole = leaf(*row, F.col("text"))
    seen = whole if seen_text is None else leaf(*row, seen_text)
    return proven(docs.select("doc_id", "source", whole.alias("leaf"), seen.alias("seen")), **how)
