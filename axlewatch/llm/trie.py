"""A trie of conversation prefixes, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is the pair of sums, over its turns, of hashes of (place, digest of
role and text), so a node's key is a running sum along a conversation and its parent's is that sum without the last turn.
A node is named by its smallest member and its depth.

Totals come from rounds of joins: rake removes all leaves and adds their totals to their parents; compress splices nodes
with one child out of unary chains, where a seeded priority is lower than those of both neighbours. Rounds grow with the
logarithm of the depth. The spliced nodes are put back in reverse order, each with its own sum plus its child's total.

Defined results: turns are ordered by (turn, role, text), null first; null role or text is empty; repeated rows are turns
of their own; rows without a conv_id belong to no conversation and are left out; an empty table gives an empty result
(there is no root without a member). Ranks and prefix keys of one very long conversation are dealt into ranges; only the
digest of a node's ends is a sequential read of ids, in one task a node, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.common import settled
from axlewatch.operators.ranked import running_sums

#: Conversations that share a base, and one more than the most turns that are taken from it.
BASE, TAKEN = 100, 6
WIDE = "decimal(30,0)"


def numbered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, r (place from 1), digest, chars."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_row"))
    placed = running_sums(rows, ["turn", "role", "text", "_row"], {"r": F.lit(1).cast("long")}, ["conv_id"])
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return placed.select("conv_id", "r", digest.alias("digest"), F.length("text").cast("long").alias("chars"))


def taken(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(TAKEN))


def base(conv_id: Column) -> Column:
    return conv_id - conv_id % BASE


def rebuilt(turns: DataFrame) -> DataFrame:
    """numbered turns -> conv_id, d (place from 1), digest, chars: the base's first turns, then the conversation's own after as many."""
    own_id = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(base(F.first(own_id)).alias("base"), taken(F.first(own_id)).alias("h"))
    heads = turns.where((own_id % BASE == 0) & (F.col("r") < TAKEN)).withColumnRenamed("conv_id", "base")
    copied = convs.join(heads, "base").where("r <= h").select("conv_id", F.col("r").alias("d"), "digest", "chars")
    held = heads.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    rest = turns.withColumns({"base": base(own_id), "h": taken(own_id)}).where("r > h").join(held, "base", "left")
    return copied.unionAll(rest.select("conv_id", (F.least("h", F.coalesce("held", F.lit(0))) + F.col("r") - F.col("h")).alias("d"), "digest", "chars"))


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes(c, d, pc, pd, values...), a tree whose root has null pc and pd -> c, d, values summed over each subtree.

    c and d are integers that name a node, pc and pd name its parent. k is the number of children left, xc and xd are the
    exclusive or of their names, so a node with one child knows it without a join.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    over, under = [f"_over_{v}" for v in values], [f"_under_{v}" for v in values]  # sums of the nodes spliced out of the edge above, and of the edges below
    each = list(zip(values, over, under, strict=True))
    kids = nodes.where("pc is not null").groupBy(F.col("pc").alias("tc"), F.col("pd").alias("td")).agg(F.count(F.lit(1)).alias("uk"), F.bit_xor("c").alias("uc"), F.bit_xor("d").alias("ud"))
    at = (F.col("c") == F.col("tc")) & (F.col("d") == F.col("td"))

    def counted(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    def turned(name: str, by: str) -> Column:
        return F.col(name).bitwiseXOR(counted(by)).alias(name)

    active = nodes.join(kids, at, "left").select("c", "d", "pc", "pd", counted("uk").alias("k"), counted("uc").alias("xc"), counted("ud").alias("xd"), *values, *[zero.alias(x) for x in (*over, *under)]).checkpoint()
    raked: list[DataFrame] = []
    spliced: list[DataFrame | None] = []
    while True:
        raked.append(active.where("k = 0").select("c", "d", *values))
        up = active.where("k = 0 and pc is not null").groupBy(F.col("pc").alias("tc"), F.col("pd").alias("td")).agg(F.count(F.lit(1)).alias("uk"), F.bit_xor("c").alias("uc"), F.bit_xor("d").alias("ud"), *[x for v, o, _ in each for x in (F.sum(F.col(v) + F.col(o)).alias(f"u_{v}"), F.sum(o).alias(f"b_{v}"))])
        sums = [x for v, _, u in each for x in ((F.col(v) + counted(f"u_{v}")).alias(v), (F.col(u) - counted(f"b_{v}")).alias(u))]
        active = active.where("k > 0").join(up, at, "left").select("c", "d", "pc", "pd", (F.col("k") - counted("uk")).alias("k"), turned("xc", "uc"), turned("xd", "ud"), *sums, *over).checkpoint()
        priority = [F.xxhash64(*pair, F.lit(len(raked))) for pair in (("c", "d"), ("pc", "pd"), ("xc", "xd"))]
        chosen = (F.col("k") == 1) & F.col("pc").isNotNull() & (priority[0] < priority[1]) & (priority[0] < priority[2])
        left, out = active.agg(F.count(F.lit(1)), F.count_if(chosen)).first()
        if not left:
            break
        gone = active.where(chosen)
        spliced.append(gone.select("c", "d", F.col("xc").alias("kc"), F.col("xd").alias("kd"), *[(F.col(v) + F.col(u)).alias(v) for v, _, u in each]) if out else None)
        if out:
            to_child = gone.select(F.col("xc").alias("tc"), F.col("xd").alias("td"), F.col("pc").alias("nc"), F.col("pd").alias("nd"), zero.alias("uc"), zero.alias("ud"), *[x for v, o, _ in each for x in ((F.col(v) + F.col(o)).alias(f"u_{v}"), zero.alias(f"b_{v}"))])
            to_parent = gone.select("pc", "pd", none, none, F.col("c").bitwiseXOR(F.col("xc")), F.col("d").bitwiseXOR(F.col("xd")), *[x for v, _, u in each for x in (zero, F.col(v) + F.col(u))])
            told = to_child.unionAll(to_parent).groupBy("tc", "td").agg(F.max("nc").alias("nc"), F.max("nd").alias("nd"), F.bit_xor("uc").alias("uc"), F.bit_xor("ud").alias("ud"), *[F.sum(f"{x}_{v}").alias(f"{x}_{v}") for v in values for x in ("u", "b")])
            carried = [x for v, o, u in each for x in ((F.col(o) + counted(f"u_{v}")).alias(o), (F.col(u) + counted(f"b_{v}")).alias(u))]
            active = active.where(~chosen).join(told, at, "left").select("c", "d", F.coalesce("nc", "pc").alias("pc"), F.coalesce("nd", "pd").alias("pd"), "k", turned("xc", "uc"), turned("xd", "ud"), *values, *carried).checkpoint()
    known = raked.pop()
    for leaves, chain in zip(reversed(raked), reversed(spliced), strict=True):
        more = leaves
        if chain is not None:
            child = known.select(F.col("c").alias("tc"), F.col("d").alias("td"), *[F.col(v).alias(f"u_{v}") for v in values])
            more = more.unionAll(chain.join(child, (F.col("kc") == F.col("tc")) & (F.col("kd") == F.col("td"))).select("c", "d", *[(F.col(v) + F.col(f"u_{v}")).alias(v) for v in values]))
        known = known.unionAll(more).coalesce(parts).checkpoint()
    return known


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends(key, conv_id) -> key, sha: the digest of the ids of each key in ascending order, read row by row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            keys, done = [], []
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last:
                    if sha:
                        keys.append(last), done.append(sha.hexdigest())
                    last, sha = key, hashlib.sha256(b"%d" % i)
                else:
                    sha.update(b",%d" % i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(done, pa.string())], names=["key", "sha"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([sha.hexdigest()])], names=["key", "sha"])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(each, "key string, sha string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    first = settled(numbered(turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")), "trie-turns")
    rows = rebuilt(first).withColumns({"v1": F.xxhash64("digest", "d").cast("decimal(20,0)"), "v2": F.xxhash64("d", "digest").cast("decimal(20,0)")})
    paths = running_sums(rows.select("conv_id", "d", "chars", "v1", "v2"), ["d"], {"s1": F.col("v1"), "s2": F.col("v2")}, ["conv_id"])
    paths = settled(paths.select("conv_id", "d", "chars", *[F.col(s).cast(WIDE).alias(s) for s in ("s1", "s2")], *[(F.col(s) - F.col(v)).cast(WIDE).alias(p) for s, v, p in (("s1", "v1", "p1"), ("s2", "v2", "p2"))]), "trie-paths")
    zero = F.lit(0).cast(WIDE)
    convs = first.select("conv_id").distinct()
    root = convs.agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(0).cast("long").alias("d"), zero.alias("s1"), zero.alias("s2"), "c", "n", F.lit(0).cast("long").alias("chars"), zero.alias("p1"), zero.alias("p2"))
    deep = paths.groupBy("d", "s1", "s2").agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = settled(root.unionAll(deep), "trie-nodes")
    named = nodes.select((F.col("d") + 1).alias("u_d"), F.col("s1").alias("u_1"), F.col("s2").alias("u_2"), F.col("c").alias("pc"))
    top = F.broadcast(nodes.where("d = 0").select(F.col("c").alias("pc"), F.lit(1).cast("long").alias("u_d")))  # the root, one row
    keep = ["d", "s1", "s2", "c", "n", "chars"]
    below = nodes.where("d > 1").join(named, (F.col("d") == F.col("u_d")) & (F.col("p1") == F.col("u_1")) & (F.col("p2") == F.col("u_2"))).select(*keep, "pc")
    tree = nodes.where("d = 0").select(*keep, F.lit(None).cast("long").alias("pc")).unionAll(nodes.where("d = 1").join(top, F.col("d") == F.col("u_d")).select(*keep, "pc")).unionAll(below)
    children = tree.where("pc is not null").groupBy(F.col("pc").alias("k_c"), (F.col("d") - 1).alias("k_d")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = settled(tree.join(children, (F.col("c") == F.col("k_c")) & (F.col("d") == F.col("k_d")), "left").select(*keep, "pc", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "trie-tree")
    own = tree.select("c", "d", "pc", F.when(F.col("pc").isNotNull(), F.col("d") - 1).alias("pd"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"]).select(F.col("c").alias("t_c"), F.col("d").alias("t_d"), "n_leaves", "saved_tokens")
    last = paths.groupBy(F.col("conv_id").alias("l_c")).agg(F.max(F.struct("d", "s1", "s2")).alias("e"))
    place = F.concat_ws(":", "d", "s1", "s2")
    ends = convs.join(last, F.col("conv_id") == F.col("l_c"), "left").select(F.concat_ws(":", F.coalesce("e.d", F.lit(0).cast("long")), F.coalesce("e.s1", zero), F.coalesce("e.s2", zero)).alias("key"), "conv_id")
    full = tree.join(totals, (F.col("c") == F.col("t_c")) & (F.col("d") == F.col("t_d"))).withColumn("place", place).join(ends_digests(ends), F.col("place") == F.col("key"), "left")
    return full.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
