"""Jaccard join of documents on word n-grams by signature trees.

Each distinct set of shingles is a member of one tree. A tree's nodes hold the OR of their members' token bitmaps and
their range of sizes; the traversal goes down two nodes at a time and leaves a pair of nodes once the sizes or the most
tokens that the bitmaps can share rule every link out. Member pairs that remain are bounded by their own bitmaps, then
counted exactly. Inside a traversal, members that are already connected aren't compared again, so a group whose texts all
resemble each other costs a comparison for each member, and no links of its components are lost.

One tree over all sets would be traversed in the square of the input, so there is a forest: sets are given keys such that
two that link share at least one, and a tree is a component of pairs of sets that share a key and that their sizes and
bitmaps allow to link. Where over CROWD sets share a key, not all their pairs are formed: in order of size each is tied to
the next if these two sizes allow a link, which connects all pairs that can link.

Keys: single tokens would be shared by chance, by more sets the more sets there are. So a key is a part of a set: the token
space is cut into parts, and a part's key is a digest of all tokens in it. Two sets that differ in d tokens differ in d
parts at most, so in one order of all such digests the first d + 1 of both have one in common (the principle of prefix
filters, with parts for tokens). Parts come by how much their tokens tell: many tokens, in cells of the token space that
are seldom met, come first. The number of parts depends on a class of sizes; a set that can link with sets of the class
below has keys of that class as well. Sets of few tokens, or all at a low `percent`, would leave parts empty; their keys are
the first of their tokens, by how often the cells are met: of a set of n tokens a linked one has at least `percent` of n, so
the first of what the two share stands among the first n - that + 1 of both.

A tree's upper
nodes are blocks of bounded bytes in order of size. Blocks are traversed with themselves, then with the tree's
first block, then with each other where they aren't connected by then and their nodes' bounds allow a link.

Defined results: a text without words, or a null one, has an empty set, links with nothing and is its own component; a
text of fewer words than a shingle is one shingle; equal sets of non-empty texts are one member; repeated rows keep their
rows; a null doc_id is a component's id only if all of its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.llm.common import run_hashes, settled, small
from axlewatch.llm.simhash import components
from axlewatch.operators.ranked import running_sums

SEED, MULTIPLIER = 42, 0x9E3779B97F4A7C15
#: Members of a leaf node; bytes of token hashes in a block; bits in the bitmap of a block.
FANOUT, BLOCK_BYTES, BLOCK_BITS = 16, 1 << 20, 1 << 16
#: Bytes of the bitmaps of a block's members; narrower ones are taken where there are many members.
MAPS_BYTES = 16 << 20
#: Cells of the token space whose tokens are counted, by the leading bits of their hashes; cells that travel as one row.
CELL_BITS, CELLS_OF_ROW = 21, 1 << 16
#: Sets of up to FEW tokens, and all below LOOSE percent, have tokens as keys, others parts. Classes of sizes begin at powers of RATIO; parts for each that linked sets may differ in.
FEW, LOOSE, RATIO, PARTS = 15, 75, 3, 1.5
#: Sets that a task remembers, so that it gives keys to one of equal sets.
REMEMBERED = 100_000
#: Sets that share a key up to which all their pairs are formed; the most bits in the bitmap of a set.
CROWD, MAP_BITS = 32, 1 << 17


class Threshold:
    """Links are pairs with 100 * intersection >= percent * union; all bounds are in whole numbers."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be 50 to 100")
        self.percent = percent

    def differ(self, a: int, b: int) -> int:
        """The most tokens that stand in one of two linked sets only."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def shared(self, a, b):
        """The fewest tokens that two linked sets share; numbers or arrays."""
        return -((-self.percent * (a + b)) // (100 + self.percent))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in w), np.uint64, len(w))
    return np.unique(run_hashes(h, min(words, len(w)), MULTIPLIER))


def cells_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def token_marks(docs: DataFrame, words: int) -> np.ndarray:
    """docs(text) -> for each cell a mark that grows with the tokens of all texts in it: 0 up to one token, then 8 for each doubling.

    A task counts its texts in one table of bounded size, to 255 a cell; the tables are added cell by cell and one byte of each cell comes to the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(met, cells_of(shingles(text.as_py(), words)), np.uint32(1))
        few = np.minimum(met, 255).astype(np.uint8)
        for k in range(0, len(few) if few.any() else 0, CELLS_OF_ROW):
            yield pa.RecordBatch.from_pylist([{"part": k, "cells": few[k : k + CELLS_OF_ROW].tobytes()}], schema=ARROW_CELLS)

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(min(CELLS_OF_ROW, 1 << CELL_BITS), np.int64)
        for batch in batches:
            for cells in batch.column("cells"):
                met += np.frombuffer(cells.as_py(), np.uint8)
        marks = np.minimum(8 * np.log2(np.maximum(met, 1)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_pylist([{"part": key[0].as_py(), "cells": marks.tobytes()}], schema=ARROW_CELLS)

    out = np.zeros(1 << CELL_BITS, np.uint8)
    for row in docs.select("text").mapInArrow(counted, CELLS).groupBy("part").applyInArrow(added, CELLS).collect():
        out[row.part : row.part + len(row.cells)] = np.frombuffer(row.cells, np.uint8)
    return out


CELLS = "part long, cells binary"
ARROW_CELLS = pa.schema([("part", pa.int64()), ("cells", pa.binary())])


def keys(tokens: np.ndarray, t: Threshold, marks: np.ndarray | None = None) -> list[int]:
    """The keys of a set: the first of its tokens by mark and hash, one more than a linked set may lack. A token that no other text has is none."""
    most = len(tokens) - -(-t.percent * len(tokens) // 100) + 1
    if marks is None:
        return tokens[:most].view(np.int64).tolist()
    own = marks[cells_of(tokens)]
    first = np.argsort(own, kind="stable")[:most]
    return tokens[first[own[first] > 0]].view(np.int64).tolist()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def part_keys(tokens: np.ndarray, size_class: int, furthest: int, t: Threshold, marks: np.ndarray, top: int) -> np.ndarray:
    """The keys of a set among sets of a class of sizes, the largest of which that it can link with has `furthest` tokens."""
    largest = RATIO ** (size_class + 1) - 1
    parts, most = int(PARTS * (t.differ(largest, 100 * largest // t.percent) + 1)), t.differ(len(tokens), furthest) + 1
    at = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # tokens ascend, so a part's stand together
    starts, own = np.flatnonzero(np.append(True, at[1:] != at[:-1])), marks[cells_of(tokens)].astype(np.int64)
    digest, told, alone = np.add.reduceat(mixed(tokens), starts), np.add.reduceat(top - own, starts), np.minimum.reduceat(own, starts) == 0
    place = lambda part: part.astype(np.uint64) + np.uint64(size_class << 56)
    key = mixed(digest + mixed(place(at[starts])))
    first = np.lexsort((key, -told))[:most]
    out = key[first[~alone[first]]]  # no other text has a part with a token that is met once
    if len(starts) < most:
        out = np.append(out, mixed(mixed(place(np.setdiff1d(np.arange(parts), at)[: most - len(starts)]))))
    return out


def keys_of(tokens: np.ndarray, t: Threshold, marks: np.ndarray, top: int) -> list[int]:
    """The keys of a set, at least one of them in common with each set that it links with. top: more than the marks."""
    n = len(tokens)
    if t.percent < LOOSE:
        return keys(tokens, t, marks)
    out = keys(tokens, t, marks) if t.percent * n <= 100 * FEW else []
    if n > FEW:
        size_class = next(c for c in range(64) if n < RATIO ** (c + 1))
        below = RATIO**size_class - 1
        out += part_keys(tokens, size_class, 100 * n // t.percent, t, marks, top).view(np.int64).tolist()
        if below > FEW and t.percent * n <= 100 * below:
            out += part_keys(tokens, size_class - 1, below, t, marks, top).view(np.int64).tolist()
    return out


def map_of(tokens: np.ndarray) -> bytes:
    """A bitmap of two to four bits a token, with a bit for the last digits of each; the halves of a wider one, put together, are one of half its width."""
    bits = min(MAP_BITS, max(64, 1 << (2 * len(tokens) - 1).bit_length()))
    bit, out = tokens & np.uint64(bits - 1), np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.tobytes()


def most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """The most tokens that sets of n and m tokens with these bitmaps can share."""
    width = min(len(x), len(y)) // 8
    a, b = (np.bitwise_or.reduce(np.frombuffer(z, np.uint64).reshape(-1, width)) for z in (x, y))
    return min(n - int(ones(a & ~b)), m - int(ones(b & ~a)))


class Sketch:
    """What a task finds out about sets: a digest, and for the first of equal ones its keys and its bitmap."""

    def __init__(self, t: Threshold, marks: np.ndarray):
        self.t, self.marks, self.top, self.met = t, marks, int(marks.max()) + 1, set()

    def of(self, tokens: np.ndarray) -> tuple[bytes | None, list[int] | None, bytes | None]:
        """node, keys, map: nulls for an empty set; keys and map are null for a set that this task has met."""
        if not len(tokens):
            return None, None, None
        node = xxhash.xxh3_128_digest(tokens.tobytes())
        if node in self.met:
            return node, None, None
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        self.met.add(node)
        return node, keys_of(tokens, self.t, self.marks, self.top), map_of(tokens)


def sketches(docs: DataFrame, words: int, t: Threshold) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h, n, node (a digest of the set, null if empty), keys, map (both at least once for each node)."""
    marks = docs.sparkSession.sparkContext.broadcast(token_marks(docs, words))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(t, marks.value)
        for batch in batches:
            sets = [shingles(text.as_py(), words) for text in batch.column(2)]
            node, held, maps = zip(*map(sketch.of, sets), strict=True) if sets else ((), (), ())
            columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(held, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "node", "keys", "map"])

    out = [docs.schema["doc_id"], *[T.StructField(c, k) for c, k in (("h", T.LongType()), ("n", T.LongType()), ("node", T.BinaryType()), ("keys", T.ArrayType(T.LongType())), ("map", T.BinaryType()))]]
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(each, T.StructType(out))


class Members:
    """Sets of a block: their tokens one behind the other, with bitmaps of a width that the traversal chooses."""

    def __init__(self, nodes: list[bytes], sizes: np.ndarray, tokens: np.ndarray):
        self.nodes, self.sizes, self.tokens, self.ends = nodes, sizes, tokens, np.cumsum(sizes)

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i] - self.sizes[i] : self.ends[i]]

    def bitmaps(self, bits: int) -> np.ndarray:
        """A row of 64-bit words for each member, with a bit for the leading digits of each token's hash."""
        bit = self.tokens >> np.uint64(64 - bits.bit_length() + 1)
        out = np.zeros((len(self.sizes), bits // 64), np.uint64)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        return out

    def union(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The OR of the members' bitmaps and the bits of each, without a bitmap for each: tokens ascend, so those of one bit stand together."""
        bit = self.tokens >> np.uint64(64 - bits.bit_length() + 1)
        out = np.zeros(bits // 64, np.uint64)
        np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        new, starts = np.append(True, bit[1:] != bit[:-1]), self.ends - self.sizes
        new[starts] = True
        return out, np.add.reduceat(new, starts, dtype=np.int64)


def ones(bitmaps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmaps).sum(axis=-1, dtype=np.int64)


class Tree:
    """The lower levels of a signature tree: a block's members in order of size, and nodes of FANOUT of them."""

    def __init__(self, members: Members, bits: int):
        self.members, self.maps, n = members, members.bitmaps(bits), members.sizes
        starts = np.arange(0, len(n), FANOUT)
        self.starts, self.ends = starts, np.minimum(starts + FANOUT, len(n))
        self.union = np.bitwise_or.reduceat(self.maps, starts, axis=0)
        self.low, self.high = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
        self.hidden = np.maximum.reduceat(n - ones(self.maps), starts)  # tokens that share a bit with another of their set


def linked(a: Members, b: Members, t: Threshold, labels: dict[bytes, bytes]) -> tuple[list[tuple[bytes, bytes]], list[bytes]]:
    """(links that connect what the traversal of two blocks, or of one with itself, can connect; a label for each member of b: equal labels are connected).

    labels: what is connected already. Roots are members of a where there is one, so that blocks met with the same a get labels that can be compared.
    """
    bits = int(min(1 << 17, max(256, 1 << int(max(a.sizes.max(), b.sizes.max()) * 8 - 1).bit_length())))
    while bits > 256 and bits // 8 * max(len(a.sizes), len(b.sizes)) > MAPS_BYTES:
        bits //= 2
    left = Tree(a, bits)
    right = left if a is b else Tree(b, bits)
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    first = set(a.nodes)

    def join(x: bytes, y: bytes) -> None:
        x, y = find(x), find(y)
        if x != y:
            top, low = sorted((x, y), key=lambda r: (r not in first, r))
            parent[low] = top

    for x, y in labels.items():
        join(x, y)
    found = []
    for p in range(len(left.starts)):
        near = (100 * right.high >= t.percent * left.low[p]) & (100 * left.high[p] >= t.percent * right.low)
        if a is b:
            near[:p] = False
        at = np.flatnonzero(near)
        most = ones(right.union[at] & left.union[p]) + np.minimum(right.hidden[at], left.hidden[p])
        for q in at[most >= t.shared(left.low[p], right.low[at])]:
            i, j = np.arange(left.starts[p], left.ends[p]), np.arange(right.starts[q], right.ends[q])
            x, y = left.maps[i][:, None], right.maps[j][None]
            n, m = a.sizes[i][:, None], b.sizes[j][None]
            most_each = np.minimum(n - ones(x & ~y), m - ones(y & ~x))
            for u, v in np.argwhere(most_each >= t.shared(n, m)):
                k, l = int(i[u]), int(j[v])
                if a is b and k >= l:
                    continue
                if find(a.nodes[k]) == find(b.nodes[l]):
                    continue
                s, r = a.of(k), b.of(l)
                at_r = np.minimum(np.searchsorted(r, s), len(r) - 1)
                if int(np.count_nonzero(r[at_r] == s)) >= t.shared(len(s), len(r)):
                    join(a.nodes[k], b.nodes[l])
                    found.append((a.nodes[k], b.nodes[l]))
    return found, [find(x) for x in b.nodes]


BLOCK = "tree long, block long, nodes array<binary>, sizes array<long>, tokens binary, map binary, low long, high long, hidden long"


def blocks_of(sets: DataFrame) -> DataFrame:
    """sets(tree, block, node, n, tokens) -> a row for each block of a tree, with its node: bitmap, sizes, hidden tokens. A block is bounded by BLOCK_BYTES and its last member."""

    def each(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(r["n"], r["node"]): r["tokens"] for batch in batches for r in batch.to_pylist()}.items())
        if rows:
            m = Members([k[1] for k, _ in rows], np.array([k[0] for k, _ in rows]), np.frombuffer(b"".join(v for _, v in rows), np.uint64))
            bitmap, distinct = m.union(BLOCK_BITS)
            row = {"tree": key[0].as_py(), "block": key[1].as_py(), "nodes": m.nodes, "sizes": m.sizes.tolist(), "tokens": m.tokens.tobytes(), "map": bitmap.tobytes(), "low": int(m.sizes.min()), "high": int(m.sizes.max()), "hidden": int((m.sizes - distinct).max())}
            yield pa.RecordBatch.from_pylist([row], schema=ARROW_BLOCK)

    return sets.select("tree", "block", "node", "n", "tokens").groupBy("tree", "block").applyInArrow(each, BLOCK)


ARROW_BLOCK = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("nodes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("map", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("hidden", pa.int64())])


def members(row: dict, side: str) -> Members:
    return Members(row[f"nodes{side}"], np.array(row[f"sizes{side}"]), np.frombuffer(row[f"tokens{side}"], np.uint64))


def traversed(pairs: DataFrame, t: Threshold, both: bool) -> DataFrame:
    """Blocks, or pairs of blocks (the second's columns end in 2, both with roots) -> tree, block (the second's), links (a, b), roots of its members."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                a = members(row, "")
                known = {m: r for s in ("", "2") for m, r in zip(row[f"nodes{s}"], row[f"roots{s}"], strict=True)} if both else {}
                links, roots = linked(a, members(row, "2") if both else a, t, known)
                yield pa.RecordBatch.from_pylist([{"tree": row["tree"], "block": row["block2" if both else "block"], "links": [{"a": x, "b": y} for x, y in links], "roots": roots}], schema=ARROW_LINKS)

    sides = ("", "2") if both else ("",)
    columns = [f"{c}{s}" for s in sides for c in ("block", "nodes", "sizes", "tokens", *(["roots"] if both else []))]
    return pairs.select("tree", *columns).mapInArrow(each, "tree long, block long, links array<struct<a: binary, b: binary>>, roots array<binary>")


ARROW_LINKS = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("links", pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())]))), ("roots", pa.list_(pa.binary()))])


def bounded(pairs: DataFrame, t: Threshold) -> DataFrame:
    """Pairs of nodes (map, low, high, hidden and the same with 2) that the bounds leave."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.select(["map", "map2", "low", "low2", "hidden", "hidden2"]).to_pylist():
                most = int(ones(np.frombuffer(r["map"], np.uint64) & np.frombuffer(r["map2"], np.uint64))) + min(r["hidden"], r["hidden2"])
                keep.append(most >= t.shared(r["low"], r["low2"]))
            yield batch.select(["tree", "block", "block2"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(each, "tree long, block long, block2 long")


def plausible(rows: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """rows(node, n, keys), classes(node, n, map) -> a, b (hashes of nodes): edges that connect all classes that can link."""
    short = F.xxhash64("node")  # classes of one hash merely share a tree
    shared = rows.select(short.alias("id"), "n", F.explode("keys").alias("key")).repartition("key")  # dealt once, for the keys of several sets and for these sets
    several = shared.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key")
    met = shared.join(several, "key").dropDuplicates(["key", "id"]).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("key")))
    met = settled(met, "jaccard-met")

    few = met.where(F.col("held") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("sets")).select("sets", F.posexplode("sets").alias("at", "x"))
    after = F.filter(F.slice("sets", F.col("at") + 2, CROWD), lambda y: 100 * F.col("x.n") >= t.percent * y["n"])
    pairs = few.select("x", F.explode(after).alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = small(settled(pairs, "jaccard-pairs"))

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [most_shared(r["map"], r["map2"], r["n"], r["n2"]) >= t.shared(r["n"], r["n2"]) for r in batch.select(["map", "map2", "n", "n2"]).to_pylist()]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [classes.select(short.alias(c), F.col("n").alias(f"n{s}"), F.col("map").alias(f"map{s}")) for c, s in (("a", ""), ("b", "2"))]
    alike = sides[0].join(pairs, "a").join(sides[1], "b").select("a", "b", "n", "n2", "map", "map2").mapInArrow(allowed, "a long, b long")

    before = Window.partitionBy("key").orderBy("n", "id")
    tied = met.where(F.col("held") > CROWD).select("id", "n", F.lag("id").over(before).alias("a"), F.lag("n").over(before).alias("less"))
    return alike.unionAll(tied.where(100 * F.col("less") >= t.percent * F.col("n")).select("a", F.col("id").alias("b")).distinct())


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, t: Threshold, row_hash: Column | None = None) -> DataFrame:
    """docs(doc_id, text), rows(node, n, keys), classes(node, n, rep, map) -> a, b: links that connect all linked classes. rep is the doc_id and h of a row, h its text's hash or row_hash."""
    short = F.xxhash64("node")
    trees = settled(components(classes.select(short.alias("node")), plausible(rows, classes, t)), "jaccard-trees")
    wanted = settled(classes.select("node", "n", "rep").join(trees.select(F.col("node").alias("t_node"), F.col("root").alias("tree")), short == F.col("t_node")).select("tree", "node", "n", "rep"), "jaccard-members")
    placed = running_sums(wanted, ["n", "node"], {"bytes": 8 * F.col("n")}, ["tree"]).select("rep", "node", "n", "tree", F.floor((F.col("bytes") - 1) / BLOCK_BYTES).alias("block"))
    placed = small(settled(placed, "jaccard-placed"))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["tree", "block", "node", "n"]).append_column("tokens", pa.array([shingles(x.as_py(), words).tobytes() for x in batch.column("text")], pa.binary()))

    texts = docs.select("doc_id", (F.xxhash64("text") if row_hash is None else row_hash).alias("h"), "text")
    chosen = texts.join(placed, F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.h") == F.col("h"))).select("tree", "block", "node", "n", "text")
    blocks = settled(blocks_of(chosen.mapInArrow(tokens_of, "tree long, block long, node binary, n long, tokens binary")), "jaccard-blocks")
    inside = settled(traversed(blocks, t, False), "jaccard-inside")
    found = inside.select(F.inline("links"))
    large = blocks.groupBy("tree").agg(F.count(F.lit(1)).alias("held"), F.min("block").alias("first")).where("held > 1")
    many = settled(blocks.join(small(large), "tree"), "jaccard-many")
    labels = inside.select("tree", "block", "roots")
    for to_first in (True, False) if many.limit(1).count() else ():
        single = F.when(F.size(F.array_distinct("roots")) == 1, F.col("roots")[0])
        now = many.join(labels, ["tree", "block"]).withColumn("single", single)
        nodes = now.select("tree", "block", "first", "single", "map", "low", "high", "hidden")
        other = nodes.select("tree", *[F.col(c).alias(f"{c}2") for c in ("block", "single", "map", "low", "high", "hidden")])
        sides = (F.col("block") == F.col("first")) if to_first else (F.col("block") > F.col("first"))
        sizes = (100 * F.col("high2") >= t.percent * F.col("low")) & (100 * F.col("high") >= t.percent * F.col("low2"))
        pairs = nodes.where(sides).join(other, "tree").where((F.col("block2") > F.col("block")) & sizes & ~F.coalesce(F.col("single") == F.col("single2"), F.lit(False)))
        carried = now.select("tree", "block", "nodes", "sizes", "tokens", "roots")
        full = bounded(pairs, t).join(carried, ["tree", "block"]).join(carried.select("tree", *[F.col(c).alias(f"{c}2") for c in ("block", "nodes", "sizes", "tokens", "roots")]), ["tree", "block2"])
        across = settled(traversed(full, t, True), "jaccard-across")
        found = found.unionAll(across.select(F.inline("links")))
        labels = labels.join(across.select("tree", "block", F.col("roots").alias("now")), ["tree", "block"], "left").select("tree", "block", F.coalesce("now", "roots").alias("roots"))
    return found


def jaccard_components(docs: DataFrame, percent: int = 90, words: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: the least doc_id reachable by links of at least `percent` similarity."""
    t = Threshold(percent)
    rows = settled(sketches(docs, words, t), "jaccard-rows")
    rep = F.struct("doc_id", "h")
    classes = rows.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.min(rep).alias("rep"), F.min("doc_id").alias("first"), F.first("map", True).alias("map"))
    classes = settled(classes, "jaccard-classes")
    roots = components(classes.select("node"), links(docs, rows, classes, words, t))
    of = classes.select("node", "first").join(roots.select(F.col("node").alias("r_node"), "root"), F.col("node") == F.col("r_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    of = settled(of, "jaccard-roots")
    ids = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(ids, "root").select(F.col("node").alias("c_node"), "component_id")
    own: Column = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n", "node").join(named, F.col("node") == F.col("c_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
