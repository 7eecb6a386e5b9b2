"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Two sets of a Jaccard
similarity of t or more share a token among the first ``n - ceil(t * n) + 1`` tokens of each
under *any* one order of all tokens.  Three orders are used, and a pair is verified only if its
prefixes meet under all three.

The first order looks at all documents.  A hash picks a share of all tokens, somewhat more than
a prefix holds; their exact document frequencies come from the shuffle that brings equal tokens
together, and the picked tokens lead the order, rare ones first.  So most documents' prefixes
hold tokens that no other document has, and only the others stay candidates.  Tokens that are
very frequent, known from counts of all picked tokens in ``2**SKETCH_BITS`` buckets (4 MB at any
input size), stand behind in the order of their hashes and never meet in that shuffle, so no
group in it is large.  A document with too few leading tokens fills up its prefix with others.

The second order is made among the candidates alone, from the exact frequencies of all their
tokens, rare ones first.  Its prefixes are the index that makes pairs.  The third order is a
hash.  A pair that meets under a token of the second order must also fit by size, by the places
of that token in both sets, and by a bitmap: each token flips one of ``BITS`` bits, so the bits
in which two maps differ are at most the tokens that only one set has.

Equal sets are one node.  Tokens with at most ``SMALL_GROUP`` nodes give all their pairs that
fit.  In a larger group every node is first paired with up to ``HUBS`` hubs, nodes with the
largest shares of tokens that others have; links join nodes to components, and then only nodes
outside the group's main component are held against the whole group, in blocks of bounded size
that carry bitmaps and no sets.  So no group is collected, no pair across components is left
out, and pairs within a component, which cannot change it, are not made.

Defined results: a null or empty text, or one of white space, has the empty set and links
with nothing.  A text with fewer than ``n`` words has its whole sequence as its one shingle.
A null id gets a null component.  Rows of one id count as one document.  An empty table gives
no row.  Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import raw_bytes, runs
from pagewright.session import bounded_batches, drop, staged

SKETCH_BITS = 20
PARTS = 64
BITS = 256
SMALL_GROUP = 6
HUBS = 4
BLOCK = 1024
#: Candidates up to which their ids are broadcast to the documents (about 60 bytes each).
BROADCAST_IDS = 2_000_000
#: A token is very frequent from this many times the mean of a bucket on.
FREQUENT = 4
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
WEYL = np.uint64(0xBF58476D1CE4E5B9)
MAPS = [f"map{i}" for i in range(BITS // 64)]


@dataclass(frozen=True)
class Rule:
    """Link where ``percent * union <= 100 * intersection`` of the word ``n``-gram sets."""

    n: int = 3
    percent: int = 90

    def prefix(self, size: int) -> int:
        return size + (-self.percent * size // 100) + 1

    @property
    def prefix_sql(self) -> str:
        return f"(size - (size * {self.percent} + 99) div 100 + 1)"

    @property
    def picked(self) -> float:
        """The share of all tokens that leads the first order."""
        return min(1.0, 1.8 * (100 - self.percent) / 100)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * WEYL
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def folded(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of each sequence of hashes, one sequence a place."""
    found = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for p in parts:
        found = mixed(found ^ p, 0x2545F4914F6CDD1D)
        found += p
    return found


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; only A-Z are lower-cased."""
    for a, b in runs(texts, 1 << 20):
        split = [t.lower().split() for t in texts[a:b]]
        hashes = np.array([h for words in split for h in map(xxhash.xxh3_64_intdigest, words)], dtype=np.uint64)
        rolled = folded([hashes[i : len(hashes) - n + 1 + i] for i in range(n)]) if len(hashes) >= n else hashes[:0]
        at = 0
        for words in split:
            k = len(words)
            if k >= n:
                yield np.unique(rolled[at : at + k - n + 1])
            elif k:
                yield folded([hashes[at + i : at + i + 1] for i in range(k)])
            else:
                yield hashes[:0]
            at += k


def node_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def short_of(node: bytes) -> int:
    """Half a node's name, to shuffle less."""
    return int.from_bytes(node[:8], "little", signed=True)


def similar(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


# The first order: all documents.


def stored(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """All picked tokens of a set, or the first of the hash's order if these are under a prefix."""
    hashed = mixed(tokens, ORDERS[0])
    lead = hashed < np.uint64(int(rule.picked * (2**64 - 1)))
    size = rule.prefix(len(tokens))
    if int(lead.sum()) >= size:
        return tokens[lead]
    return tokens[np.argsort(hashed, kind="stable")[:size]]


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


SETS = "doc_id long, size long, node binary, short long, tokens array<long>, part int, counts binary"


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """A row a document; the first row of a node in a task has its stored tokens too.  Then the
    task's counts of these tokens by bucket, in parts."""
    names = [x.split()[0] for x in SETS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    seen: set[bytes] = set()
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for batch in batches:
        keys, texts = batch.column("__id").to_pylist(), raw_bytes(batch, "__text")
        for a, b in runs(texts, 1 << 21):
            sizes, nodes, shorts, kept = [], [], [], []
            for tokens in shingle_sets(texts[a:b], rule.n):
                node = node_of(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                nodes.append(node)
                shorts.append(short_of(node) if node else None)
                if node is None or node in seen:
                    kept.append(None)
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                kept.append(stored(tokens, rule).view(np.int64))
            some = [x for x in kept if x is not None]
            if some:
                counts += np.bincount(_bucket(np.concatenate(some).view(np.uint64)), minlength=len(counts))
            yield rows(doc_id=keys[a:b], size=sizes, node=nodes, short=shorts, tokens=kept)
    if counts.any():
        yield rows(part=list(range(PARTS)), counts=[zlib.compress(p.tobytes(), 1) for p in counts.astype("<i8").reshape(PARTS, -1)])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(blob), "<i8")
            total[part] = total[part] + own if part in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "counts"])


def frequencies(rows: DataFrame) -> np.ndarray:
    """Counts of the stored tokens by bucket over all documents, as 32-bit numbers."""
    parts = rows.where(F.col("part").isNotNull()).select("part", "counts")
    total = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), dtype=np.int64)
    for row in parts.repartition(PARTS, "part").mapInArrow(_summed, "part int, counts binary").collect():
        total[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return np.minimum(total.reshape(-1), 2**32 - 1).astype(np.uint32)


def _posted(batches: Iterator[pa.RecordBatch], counts, rule: Rule) -> Iterator[pa.RecordBatch]:
    """short, the stored tokens that may stand in the first prefix, how many of them lead the
    order, and those among the others that are very frequent."""
    frequent = max(8.0, FREQUENT * float(counts.value.mean()))
    limit = np.uint64(int(rule.picked * (2**64 - 1)))
    for batch in batches:
        leads, posts, hots = [], [], []
        for size, own in zip(batch.column("size").to_pylist(), batch.column("tokens"), strict=True):
            tokens = own.values.to_numpy().view(np.uint64)
            hashed, many = mixed(tokens, ORDERS[0]), counts.value[_bucket(tokens)] >= frequent
            lead = (hashed < limit) & ~many
            n, wanted = int(lead.sum()), rule.prefix(size)
            rest = np.zeros(0, np.int64)
            if n < wanted:
                other = np.flatnonzero(~lead)
                rest = other[np.argsort(hashed[other], kind="stable")[: wanted - n]]
            leads.append(n)
            posts.append(np.concatenate([tokens[lead], tokens[rest[~many[rest]]]]).view(np.int64))
            hots.append(tokens[rest[many[rest]]].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("short"), batch.column("size"), pa.array(leads, pa.int64()), pa.array(posts, pa.list_(pa.int64())), pa.array(hots, pa.list_(pa.int64()))],
            names=["short", "size", "lead", "tokens", "hot"],
        )


def first_prefixes(rows: DataFrame, rule: Rule) -> DataFrame:
    """short and ``first`` (halves of the tokens of its first prefix that another prefix may have)
    of every node that has such tokens."""
    counts = rows.sparkSession.sparkContext.broadcast(frequencies(rows))
    held = rows.where(F.col("tokens").isNotNull()).select("short", "size", "tokens")
    posted = held.mapInArrow(lambda it: _posted(it, counts, rule), "short long, size long, lead long, tokens array<long>, hot array<long>")
    nodes = posted.select("short", "size", "lead").distinct()
    by_token, by_node = Window.partitionBy("token"), Window.partitionBy("short")
    postings = posted.select("short", F.explode("tokens").alias("token")).repartition("token").dropDuplicates(["token", "short"])
    met = postings.withColumn("n", F.count("*").over(by_token)).where("n > 1").join(nodes, "short")
    met = met.withColumn("place", F.row_number().over(by_node.orderBy("n", F.xxhash64("token")))).withColumn("shared", F.count("*").over(by_node))
    # leading tokens that no other node has come first; a node with too few of them posted its prefix alone
    inside = met.where(f"lead < {rule.prefix_sql} OR place <= {rule.prefix_sql} - lead + shared").select("token", "short")
    twice = inside.withColumn("n", F.count("*").over(by_token)).where("n > 1").select("token", "short")
    hot = posted.select("short", F.explode("hot").alias("token")).select("token", "short")
    half = F.shiftright("token", 32).cast("int")
    return twice.unionByName(hot).groupBy("short").agg(F.collect_set(half).alias("first"))


# The second order: all tokens of the candidates.


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for each place, set if an odd number of tokens fall on it."""
    at = (mixed(tokens, 0x6A09E667F3BCC909) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(bool), bitorder="little").view("<i8")


def third_prefix(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    hashed = mixed(tokens, ORDERS[2])
    size = rule.prefix(len(tokens))
    return tokens[np.argpartition(hashed, size - 1)[:size]] if size < len(tokens) else tokens


CANDIDATES = f"short long, size long, tokens array<long>, third array<int>, {', '.join(f'{m} long' for m in MAPS)}"


def _candidates(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Name, size, set, third prefix and bitmap of each text."""
    for batch in batches:
        texts = raw_bytes(batch, "__text")
        for a, b in runs(texts, 1 << 21):
            sets = [s for s in shingle_sets(texts[a:b], rule.n) if len(s)]
            maps = np.array([bitmap(s) for s in sets], dtype=np.int64).reshape(len(sets), len(MAPS))
            # half of a hash is enough for a filter: it can only let more pairs through
            third = [(third_prefix(s, rule) >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([short_of(node_of(s)) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(third, pa.list_(pa.int32())),
                    *(pa.array(maps[:, i]) for i in range(len(MAPS))),
                ],
                names=[x.split()[0] for x in CANDIDATES.split(", ")],
            )


def second_index(sets: DataFrame, rule: Rule) -> DataFrame:
    """token, short, size, after and maps: the second prefixes' tokens that another set has.

    ``after`` counts a set's tokens from this one on in the second order.
    """
    postings = sets.select("short", "size", F.explode("tokens").alias("token"))
    # counted apart from the join, so that a very frequent token's rows are summed before they meet
    n = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    by_node = Window.partitionBy("short")
    met = postings.join(n, "token")
    met = met.withColumn("place", F.row_number().over(by_node.orderBy("n", "token"))).withColumn("shared", F.count("*").over(by_node))
    met = met.withColumn("after", F.col("shared") - F.col("place") + 1).where(f"size - after < {rule.prefix_sql}")
    return met.select("token", "short", "after").join(sets.select("short", "size", *MAPS), "short")


def fits(rule: Rule, *sides: str) -> Column:
    """Whether two postings of one token may belong to linked sets."""
    a, b = sides
    size = f"({a}.size + {b}.size)"
    apart = " + ".join(f"bit_count({a}.{m} ^ {b}.{m})" for m in MAPS)
    return F.expr(
        f"100 * {a}.size >= {rule.percent} * {b}.size AND 100 * {b}.size >= {rule.percent} * {a}.size "
        f"AND {100 + rule.percent} * least({a}.after, {b}.after) >= {rule.percent} * {size} AND {100 + rule.percent} * ({apart}) <= {100 - rule.percent} * {size}"
    )


def _block_pairs(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs that fit between nodes outside their group's main component and a block of the group."""
    group, outer = pdf[~pdf["outer"]], pdf[pdf["outer"]]
    found_a, found_b = [], []
    if len(group) and len(outer):
        size, after, short, component = (group[c].to_numpy() for c in ("size", "after", "short", "component"))
        maps = group[MAPS].to_numpy()
        for row in outer.itertuples():
            both = size + row.size
            fit = (component != row.component) & (100 * size >= percent * row.size) & (100 * row.size >= percent * size)
            at = np.flatnonzero(fit & ((100 + percent) * np.minimum(after, row.after) >= percent * both))
            if len(at):
                apart = np.bitwise_count((maps[at] ^ np.array([getattr(row, m) for m in MAPS], dtype=np.int64)).view(np.uint64)).sum(axis=1, dtype=np.int64)
                at = at[(100 + percent) * apart <= (100 - percent) * both[at]]
                found_a.append(np.minimum(short[at], row.short))
                found_b.append(np.maximum(short[at], row.short))
    none = [np.zeros(0, np.int64)]
    return pd.DataFrame({"a": np.concatenate(found_a or none), "b": np.concatenate(found_b or none)}).drop_duplicates()


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [batch.column(f"tokens_{x}") for x in "ab"]
        kept = []
        for x, y in zip(*sides, strict=True):
            p, q = x.values.to_numpy(), y.values.to_numpy()
            both = np.sort(np.concatenate([p, q]))
            kept.append(bool(similar(int((both[1:] == both[:-1]).sum()), len(p), len(q), percent)))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame, first: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose first and third prefixes meet as well and that pass the rule."""
    light = sets.select("short", "third").dropDuplicates(["short"]).join(first, "short")
    one, two = (light.select(*(F.col(c).alias(f"{c}_{x}") for c in light.columns)) for x in "ab")
    met = pairs.join(one, pairs["a"] == one["short_a"]).join(two, F.col("b") == two["short_b"])
    met = met.where(F.arrays_overlap("first_a", "first_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    left, right = (sets.select(F.col("short").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    percent = rule.percent
    return met.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(lambda it: _verified(it, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of ``links`` (a, b).

    Each round gives a node the smallest label beside it and then the label of that label, so
    the number of rounds grows with the logarithm of the longest path.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = label.join(near, "node").select("node", F.least("component", "near").alias("lower"), "component")
        jump = label.select(F.col("node").alias("lower"), F.col("component").alias("further"))
        after = lower.join(jump, "lower", "left").select("node", F.least("lower", F.coalesce("further", "lower")).alias("component"), F.col("component").alias("before"))
        after = staged(after, "labels")
        drop(label)
        label = after
        if after.where("component <> before").isEmpty():
            drop(both)
            return after


def _linked_pairs(index: DataFrame, sets: DataFrame, first: DataFrame, names: DataFrame, rule: Rule, small_group: int, block: int) -> DataFrame:
    """Node ids with their components, for every node that has a link."""
    hub = F.struct((F.col("after") / F.col("size")).alias("share"), "size", "short", "after", *MAPS)
    # summed by token and part of its nodes first, so that no group meets in one task
    parts = index.groupBy("token", F.pmod("short", F.lit(HUBS)).alias("part")).agg(F.count("*").alias("n"), F.max(hub).alias("hub"))
    groups = staged(parts.groupBy("token").agg(F.sum("n").alias("n"), F.collect_list("hub").alias("hubs")).where("n > 1"), "groups")
    postings = index.select("token", "short", "size", "after", *MAPS)
    few = postings.join(groups.where(F.col("n") <= small_group).select("token"), "token")
    pairs = few.alias("x").join(few.alias("y"), "token").where("x.short < y.short").where(fits(rule, "x", "y"))
    large_groups = groups.where(F.col("n") > small_group)
    stars = postings.join(large_groups.select("token", F.explode("hubs").alias("y")), "token").alias("x").where("x.short <> x.y.short").where(fits(rule, "x", "x.y"))
    stars = stars.select(F.least("x.short", "x.y.short").alias("a"), F.greatest("x.short", "x.y.short").alias("b"))
    pairs = staged(pairs.select(F.col("x.short").alias("a"), F.col("y.short").alias("b")).union(stars).distinct(), "pairs")

    def by_id(found: DataFrame) -> DataFrame:
        a, b = (names.select(F.col("short").alias(x), F.col("id").alias(f"id_{x}")) for x in "ab")
        return found.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    links = staged(by_id(verified(pairs, sets, first, rule)), "links")
    drop(pairs)
    joined = components(links)
    # large groups that are not one component yet
    own = names.join(joined.select(F.col("node").alias("id"), "component"), "id", "left").select("short", F.coalesce("component", "id").alias("component"))
    large = staged(postings.join(large_groups.select("token"), "token").join(own, "short"), "large")
    sizes = large.groupBy("token", "component").agg(F.count("*").alias("n"))
    kinds = sizes.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("kinds"))
    kinds = staged(kinds.where("kinds > 1").select("token", "main", "n", (F.col("n") - F.col("most")).alias("outside")), "open")
    if not kinds.isEmpty():
        inner_blocks, outer_blocks = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("outside") / block).cast("int")
        at = lambda n, salt: F.pmod(F.xxhash64("short", F.lit(salt)), n).cast("int")
        open_ = large.join(kinds, "token")
        columns = ["token", "short", "size", "after", *MAPS, "component"]
        every = open_.select(*columns, F.lit(False).alias("outer"), at(inner_blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), outer_blocks - 1)).alias("outer_block"))
        outer = open_.where("component <> main").select(
            *columns, F.lit(True).alias("outer"), F.explode(F.sequence(F.lit(0), inner_blocks - 1)).alias("block"), at(outer_blocks, 2).alias("outer_block")
        )
        percent = rule.percent
        more = every.unionByName(outer).groupBy("token", "block", "outer_block").applyInPandas(lambda pdf: _block_pairs(pdf, percent), "a long, b long")
        pairs = staged(more.distinct(), "pairs")
        more = staged(by_id(verified(pairs, sets, first, rule)), "links")
        drop(pairs, joined)
        joined = components(links.union(more))
        drop(more)
    drop(groups, links, large, kinds)
    return joined


def group(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", small_group: int = SMALL_GROUP, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    rows = staged(source.mapInArrow(lambda it: _sets(it, rule), SETS), "sets")
    members = staged(rows.where(F.col("part").isNull()).select("doc_id", "size", "node", "short"), "members")
    first = staged(first_prefixes(rows, rule), "first")
    drop(rows)
    nodes = members.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node", "short").agg(F.min("doc_id").alias("id"))
    names = staged(nodes.select("node", "short", "id"), "nodes")
    wanted = staged(names.join(first.select("short"), "short").select(F.col("id").alias("__id")).distinct(), "candidate-ids")
    few = wanted.count() <= BROADCAST_IDS
    texts = source.join(F.broadcast(wanted) if few else wanted, "__id").select("__text")
    sets = staged(texts.mapInArrow(lambda it: _candidates(it, rule), CANDIDATES), "candidates")
    if not sets.groupBy("short").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        once = staged(sets.dropDuplicates(["short"]), "candidates")
        drop(sets)
        sets = once
    index = staged(second_index(sets, rule), "index")
    joined = _linked_pairs(index, sets, first, names, rule, small_group, block)
    whole = names.join(joined.select(F.col("node").alias("id"), "component"), "id", "left").select("node", F.coalesce("component", "id").alias("component_id"))
    whole = staged(whole, "components")
    drop(first, wanted, sets, index, joined, names)
    found = members.select("doc_id", F.col("size").alias("n_shingles"), "node").join(whole, "node", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, one row an id.

    Rows without an id stay; rows without a shingle are groups of their own.  The ids that go
    are far fewer than the rows, so they are broadcast where a count of them allows it, and the
    texts of the rest are not shuffled; beyond that count both sides are.
    """
    grouped = staged(group(docs, rule, key, text).where("doc_id IS NOT NULL"), "grouped")
    gone = staged(grouped.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    often = staged(grouped.groupBy(F.col("doc_id").alias("__often")).agg(F.count("*").alias("n")).where("n > 1").select("__often"), "often")
    drop(grouped)
    number = F.col(key).cast("long")

    def side(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= broadcast_ids else ids

    kept = docs.join(side(gone), number == F.col("__gone"), "left_anti")
    if not often.isEmpty():
        ids = side(often)
        once = kept.join(ids, number == F.col("__often"), "left_semi").dropDuplicates([key])
        kept = kept.join(ids, number == F.col("__often"), "left_anti").unionByName(once)
    return kept
