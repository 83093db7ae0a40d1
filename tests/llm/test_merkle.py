"""The Merkle manifest against a tree built by definition, and its query against DuckDB."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows, arity=16):
    """``rows(doc_id, source, leaf, seen)`` -> the contract's columns, by levels held as lists."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            a = i // arity * arity
            yield i - a, nodes[a:i] + nodes[i + 1 : a + arity]
            i //= arity

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])) for s in sources}
    trees = {s: levels([r[2] for r in of[s]]) for s in sources}
    above = levels([trees[s][-1][0] for s in sources])
    root, out = above[-1][0], []
    for k, s in enumerate(sources):
        for i, (doc_id, _, leaf, seen) in enumerate(of[s]):
            way, folded = [*path(trees[s], i), *path(above, k)], seen
            for slot, others in way:
                folded = sha([*others[:slot], folded, *others[slot:]])
            out.append((doc_id, leaf, trees[s][-1][0], root, sha(o for _, others in way for o in others), folded, folded == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("sizes", "arity"), [([1], 16), ([16, 1, 17, 3], 16), ([40, 1, 2, 5, 1, 9], 2), ([300, 1], 16), ([2] * 37, 3)])
def test_trees_of_all_shapes(spark, sizes, arity):
    rows = [(i, f"s{k}", sha([f"{k},{i}"]), sha([f"{k},{i}", "!" * (i % 3 == 0)])) for k, n in enumerate(sizes) for i in range(n)]
    got = merkle.proven(spark.createDataFrame(rows, "doc_id long, source string, leaf string, seen string"), arity, with_paths=True).collect()
    assert order(tuple(r)[:7] for r in got) == order(plain(rows, arity))
    for r in got:
        assert merkle.fold(r.leaf, [(p.slot, p.others) for p in r.path]) == r.root
        assert r.proof_sha256 == sha(o for p in r.path for o in p.others)


def test_odd_rows(spark, odd, nothing):
    df = odd.select("doc_id", F.col("key").alias("source"), F.lit(None).cast("string").alias("lang"), F.col("fp").alias("n_chars"), "text", F.lit("x").alias("leaf"), F.lit(1).alias("root"))
    df = df.unionByName(df.filter("source IS NULL")).unionByName(df.filter("doc_id = 4").withColumn("source", F.lit("ä")).unionByName(df.filter("doc_id = 4").withColumn("source", F.lit("z\U0001f600"))))
    rows = []
    for r in df.collect():
        low = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        text = "".join(c.lower() if c.isascii() else c for c in r.text) if low else r.text
        rows.append((r.doc_id, r.source, *(sha(map(shown, (r.doc_id, r.source, r.lang, r.n_chars, t))) for t in (r.text, text))))
    got = merkle.manifest(df, merkle.lowered(F.col("doc_id"), F.col("text"))).collect()
    assert order(map(tuple, got)) == order(plain(rows))
    assert merkle.manifest(df).filter("verified").count() == df.count()
    assert merkle.manifest(nothing.select("doc_id", F.col("key").alias("source"), F.col("key").alias("lang"), F.col("fp").alias("n_chars"), "text")).count() == 0


def test_query_equals_its_sql_and_definition(spark, documents):
    got = queries.op11_merkle_manifest(spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(queries.ORACLE["op11_merkle_manifest"]).fetchall()
    names = [x[0] for x in con.description]
    found = order(map(tuple, got.select(*names).collect()))
    assert found == order(want) and names == got.columns
    assert {r[-1] for r in found} == {True, False} and len(found) == documents.count()
    rows = []
    for r in documents.collect():
        text = "".join(c.lower() if c.isascii() else c for c in r.text) if r.text and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.text
        rows.append((r.doc_id, r.source, *(sha(map(shown, (r.doc_id, r.source, r.lang, r.n_chars, t))) for t in (r.text, text))))
    assert found == order(plain(rows))
