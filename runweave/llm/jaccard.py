"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and the groups that its links make.

A document's set holds its distinct `SHINGLE`-word shingles (A-Z in lower case; a shorter text is one shingle). Two sets
link if intersection / union >= `numerator` / `denominator`. Equal sets are one node. The join is exact:

* Small sets, up to a boundary, are enumerated: a pair of sizes fixes how many shingles must be common, so every subset of
  that size is a key, and sets that meet at a key are linked without looking further. The boundary is where enumerating
  the corpus' small sets would cost more than scanning lists for them, from the counts of sizes.
* Large sets go to inverted lists: of n shingles the first n - ceil(n t) + 1 in an order that all sets agree on, as two
  linked sets share one of them. The order is that of the hashes, but common shingles come last: those that many documents
  have among their smallest hashes, up to `COMMON` of them. Any choice of them gives the same links, so tasks count on
  their own and only what is frequent in a task is summed.
* Lists with at least two sets are kept. Light lists (up to `LIGHT` sets) are scanned for pairs; the lists that two sets
  share bound their intersection, and only pairs that can still reach the threshold are candidates. What is heavy is a
  large group of near copies: each set is compared with one leader, then with the likest of some sets of its lists, and then
  only sets of different components are. Each set has a parity sketch, `PARITIES` longs in which every shingle flips one
  bit: two sketches differ in no more bits than the sets do in shingles, so pairs whose sketches differ in more than a link
  allows are left out where heavy lists are scanned, and are not shuffled; other candidates are left out by them before any
  set is fetched. The smaller set of a pair looks up the first ninth
  of its shingles only, as the first one that both have must leave the others behind it.
* Candidates are verified on the whole sets, first one for each set, then those that are not connected by these.

Links that join what is connected already are not tested, so a group of m copies costs about m comparisons. No links are
lost: every pair that could link is either verified or inside one component.

Null, empty and blank texts have an empty set and are linked with nothing. Rows that repeat a key or a text have the same
set. A null key keeps its row; a component of null keys only has a null id. Further columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import Spans, Words, chunks, mix, released, signed, texts_of, written
from runweave.llm.graph import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Sets in a list that is scanned for all its pairs.
LIGHT = 32
#: Common shingles that are sent to all tasks: at most so many, of 8 bytes.
COMMON = 1 << 18
#: What a place in a list costs against a subset, and the largest set that is considered for enumeration.
LIST_COST, LARGEST_SMALL = 8, 16
#: Longs of a parity sketch; more tell larger sets apart, any number gives the same links.
PARITIES = 16


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def common_needed(a: int, b: int) -> int:
    """Shingles that sets of these sizes must share."""
    return ceil_div(NUMERATOR * (a + b), NUMERATOR + DENOMINATOR)


def prefix_size(n):
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def partner_sizes(n: int) -> range:
    return range(ceil_div(NUMERATOR * n, DENOMINATOR), DENOMINATOR * n // NUMERATOR + 1)


def subset_count(n: int) -> int:
    return sum(math.comb(n, common_needed(n, m)) for m in partner_sizes(n))


def boundary(sizes: dict[int, int]) -> int:
    """Largest size up to which enumerating subsets costs no more than the lists of the same sets."""
    best = subsets = lists = 0
    for n in range(1, LARGEST_SMALL + 1):
        subsets += sizes.get(n, 0) * subset_count(n)
        lists += sizes.get(n, 0) * prefix_size(n) * LIST_COST
        if subsets <= lists:
            best = n
    return best


class Sets:
    """Sorted hashes of the distinct shingles of some texts."""

    def __init__(self, texts: list[bytes], salt: int):
        words = Words(texts, lower=True)
        hashes = words.hashes()
        spans = Spans(hashes)
        size = np.diff(words.first)
        grams = spans.grams(SHINGLE)
        short = spans(words.first[:-1], words.first[1:])
        self.sets = []
        for i, (at, n) in enumerate(zip(words.first[:-1].tolist(), size.tolist(), strict=True)):
            self.sets.append(np.unique(grams[at:at + n - SHINGLE + 1]) if n >= SHINGLE else short[i:i + 1] if n else grams[:0])
        self.salt = np.uint64(salt)

    def node(self, i: int) -> int:
        mine = self.sets[i]
        total = mix(mine ^ mix(np.array([self.salt + np.uint64(1)])))
        size = np.array([len(mine)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return int(signed(mix(total.sum(keepdims=True) + size))[0])

    def parities(self, i: int) -> list[int]:
        """A bit for each residue of the set's shingles: whether an odd number of them has it."""
        odd = np.bincount((mix(self.sets[i]) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()

    def check(self, i: int) -> int:
        return int(signed(np.array([np.bitwise_xor.reduce(mix(self.sets[i] + np.uint64(0x5851F42D4C957F2D)))]))[0])


def _sets(batch: pa.RecordBatch, salt: int):
    texts = texts_of(batch.column("text"))
    for low, high in chunks([len(t) for t in texts]):
        yield low, high, Sets(texts[low:high], salt)


def members(docs: DataFrame, salt: int) -> DataFrame:
    """Key, `name`, size of the set, its 64-bit `node` and a second hash; null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in _sets(batch, salt):
                size = [len(s) for s in found.sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in ("key", "name")), pa.array(size, pa.int64()),
                     pa.array([found.node(i) if n else None for i, n in enumerate(size)], pa.int64()),
                     pa.array([found.check(i) if n else None for i, n in enumerate(size)], pa.int64())],
                    names=["key", "name", "n", "node", "other"])

    return docs.select("key", "name", "text").mapInArrow(released(run), "key long, name long, n long, node long, other long")


def common_shingles(docs: DataFrame, salt: int) -> np.ndarray:
    """Shingles that more than `LIGHT` documents have among their smallest hashes, the most frequent ones."""

    def run(batches):
        for batch in batches:
            rows = [mine[:prefix_size(len(mine))] for _, _, found in _sets(batch, salt) for mine in found.sets if len(mine)]
            if rows:
                values, often = np.unique(np.concatenate(rows), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values[often > 1])), pa.array(often[often > 1])], names=["list", "n"])

    counted = docs.select("text").mapInArrow(released(run), "list long, n long").groupBy("list").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") > LIGHT).orderBy(F.desc("n"), "list").limit(COMMON).select("list").collect()
    return np.sort(np.array([r["list"] for r in rows], np.int64)).view(np.uint64)


def common_last(mine: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a set that go to lists."""
    take = prefix_size(len(mine))
    late = common[np.searchsorted(common, mine).clip(max=len(common) - 1)] == mine if len(common) else np.zeros(len(mine), bool)
    return mine[:take] if not late.any() else np.concatenate([mine[~late], mine[late]])[:take]


def prefixes(docs: DataFrame, salt: int, small: int, common: np.ndarray) -> DataFrame:
    """List and node for the first shingles of each set that may link beyond the boundary."""

    def run(batches):
        for batch in batches:
            for _, _, found in _sets(batch, salt):
                nodes, rows = [], []
                for i, mine in enumerate(found.sets):
                    if len(mine) and DENOMINATOR * len(mine) // NUMERATOR > small:
                        rows.append(common_last(mine, common))
                        nodes.append(np.full(len(rows[-1]), found.node(i), np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(rows))), pa.array(np.concatenate(nodes))],
                                                     names=["list", "node"])

    return docs.select("text").mapInArrow(released(run), "list long, node long")


def small_links(sets: DataFrame, small: int) -> DataFrame:
    """Links (`a`, `b`) among sets up to the boundary, by common subsets."""

    def run(batches):
        for batch in batches:
            keys, nodes, sizes, lows, highs = [], [], [], [], []
            for node, n, mine in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shingles")), strict=True):
                values = [int(v) for v in mix(np.frombuffer(mine, np.uint64))]
                for m in partner_sizes(n):
                    if m <= small:
                        low, high = min(n, m), max(n, m)
                        for subset in itertools.combinations(values, common_needed(n, m)):
                            keys.append((sum(subset) * 0x9E3779B97F4A7C15 + low * 1000 + high) & ((1 << 63) - 1))
                            nodes.append(node)
                            sizes.append(n)
                            lows.append(low)
                            highs.append(high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lows, pa.int32()),
                 pa.array(highs, pa.int32())], names=["subset", "node", "n", "low", "high"])

    few = sets.filter(F.col("n") <= small).select("node", "n", "shingles")
    rows = few.mapInArrow(released(run), "subset long, node long, n int, low int, high int").distinct()
    met = rows.groupBy("subset", "low", "high").agg(F.min("node").alias("a"), F.min("n").alias("_least"), F.max("n").alias("_most"))
    met = met.filter("_least = low and _most = high").select("subset", "low", "high", "a")
    return rows.join(met, ["subset", "low", "high"]).filter("a <> node").select("a", F.col("node").alias("b")).distinct()


def met(lists: DataFrame) -> DataFrame:
    """Each two nodes (`a` < `b`) of a list; what else the lists have is named `a_...` and `b_...`."""
    extra = [c for c in lists.columns if c not in ("list", "node")]
    left = lists.select("list", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in extra])
    right = lists.select("list", F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in extra])
    return left.join(right, "list").filter(F.col("a") < F.col("b"))


def pairs_of(lists: DataFrame) -> DataFrame:
    """Pairs of nodes in common lists and how many these are."""
    return met(lists).groupBy("a", "b").agg(F.count("*").alias("shared"))


def placed_lists(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """List, node, size and place (from 0, in the order that all sets agree on) of the shingles that go to lists; of those
    that a column `lists` names, if there is one."""
    named = "lists" in sets.columns

    def run(batches):
        for batch in batches:
            rows = [common_last(np.frombuffer(x, np.uint64), common) for x in batch.column("shingles").to_pylist()]
            places = [np.arange(len(r)) for r in rows]
            if named:
                only = (x.values.to_numpy() for x in batch.column("lists"))
                places = [np.flatnonzero(np.isin(signed(r), x)) for r, x in zip(rows, only, strict=True)]
            often = np.array([len(p) for p in places], np.int64)
            if often.sum():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate([r[p] for r, p in zip(rows, places, strict=True)]))),
                     *(pa.array(np.repeat(batch.column(c).to_numpy(), often)) for c in ("node", "n")), pa.array(np.concatenate(places))],
                    names=["list", "node", "n", "place"])

    columns = ["node", "n", "shingles", *(["lists"] if named else [])]
    return sets.select(*columns).mapInArrow(released(run), "list long, node long, n long, place long")


def bits_apart() -> Column:
    """Bits in which the sketches `a_p0` ... and `b_p0` ... differ."""
    return sum((F.bit_count(F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}"))) for i in range(PARITIES)), F.lit(0))


def alike(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs whose sketches (`node`, `n`, `p0` ...) differ in no more bits than linked sets may in shingles."""
    for side in "ab":
        pairs = pairs.join(sketch.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sketch.columns if c != "node"]), side)
    na, nb = F.col("a_n"), F.col("b_n")
    return pairs.filter(bits_apart() <= na + nb - 2 * common_of(na, nb)).select("a", "b")


def meetings(lists: DataFrame, key: str) -> DataFrame:
    """Pairs of different components (`label`) that meet under a key of lists and may link by size (`n`), place and parity
    sketch (`p0` ...), with `apart`, the bits in which the sketches differ. Of two linked sets the first common shingle has
    all others behind it, in both: that leaves the smaller set a ninth of its shingles to meet it by, the larger one a fifth."""
    extra = ["n", "label", "place", *[f"p{i}" for i in range(PARITIES)]]
    side = lambda rows, s: rows.select(key, F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in extra])
    na, nb = F.col("a_n"), F.col("b_n")
    apart = bits_apart()
    first = lists.filter(F.col("n") - F.col("place") >= common_of(F.col("n"), F.col("n")))
    # Linked sets have `common` shingles or more in common, all others are in one of them alone.
    common = common_of(na, nb)
    rows = side(first, "a").join(side(lists, "b"), key).filter(
        ((na < nb) | (na == nb) & (F.col("a") < F.col("b"))) & (F.col("a_label") != F.col("b_label")) & (nb * NUMERATOR <= na * DENOMINATOR)
        & (na - F.col("a_place") >= common) & (nb - F.col("b_place") >= common) & (apart <= na + nb - 2 * common))
    return rows.select("a", "b", apart.alias("apart"))


def pairs_across(lists: DataFrame) -> DataFrame:
    """Pairs of different components in heavy lists that may link."""
    return meetings(lists, "list").select("a", "b").distinct()


def near_ones(lists: DataFrame) -> DataFrame:
    """For each node the one of another component that has the likest sketch of those it meets in parts of its lists,
    `LIGHT` sets on average. This only finds links early, so that fewer components are left for `pairs_across`."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("f") / LIGHT))
    dealt = lists.withColumn("part", F.struct("list", F.pmod(F.xxhash64("list", "node"), parts).alias("number")))
    rows = written(meetings(dealt, "part"), "near")
    best = F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("x")
    return rows.groupBy("a").agg(best).select("x.*").unionByName(rows.groupBy("b").agg(best).select("x.*")).distinct()


def common_of(na: Column, nb: Column) -> Column:
    """`common_needed` of columns."""
    return F.ceil((na + nb) * NUMERATOR / (NUMERATOR + DENOMINATOR))


def can_link(na: Column, nb: Column) -> Column:
    return (na * NUMERATOR <= nb * DENOMINATOR) & (nb * NUMERATOR <= na * DENOMINATOR)


def shared_needed(na: Column, nb: Column) -> Column:
    """Lists that two linked sets must share: their intersection is at most those and what lies behind one prefix."""
    needed = F.ceil((na + nb) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    return needed - F.greatest(F.ceil(na * NUMERATOR / DENOMINATOR), F.ceil(nb * NUMERATOR / DENOMINATOR)) + 1


def reachable(pairs: DataFrame, nodes: DataFrame, slack: DataFrame) -> DataFrame:
    """Pairs whose sizes fit and whose shared lists, with those that were not scanned (`slack` of a node), suffice."""
    sizes = nodes.join(slack, "node", "left").select("node", "n", F.coalesce("slack", F.lit(0)).alias("slack"))
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("slack").alias(f"s{side}")), side)
    enough = F.col("shared") + F.least("sa", "sb") >= shared_needed(F.col("na"), F.col("nb"))
    return pairs.filter(can_link(F.col("na"), F.col("nb")) & enough).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def side(node: str, shingles: str) -> DataFrame:
        """The sets that pairs ask for on one side. What they ask for is a table of its own, so that its size is known and few
        nodes do not have all sets shuffled to them."""
        asked = written(pairs.select(F.col(node).alias("node")).distinct(), "asked")
        return sets.join(asked, "node", "left_semi").select(F.col("node").alias(node), F.col("shingles").alias(shingles))

    rows = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(released(run), "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """Whole sets of the wanted nodes (`node`, `key` of one document) and their parity sketches, with the `lists` of the wanted
    row, written; a node is there once for each row that repeats its key and text. A node of rows without a key is fetched by the
    `name` of one of its texts, equal texts once."""

    def run(batches):
        for batch in batches:
            want = batch.column("want").to_pylist()
            for low, _, found in _sets(batch, salt):
                keep = [i for i, mine in enumerate(found.sets) if len(mine) and found.node(i) == want[low + i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([want[low + i] for i in keep], pa.int64()), pa.array([len(found.sets[i]) for i in keep], pa.int64()),
                     pa.array([found.sets[i].tobytes() for i in keep], pa.binary()),
                     pa.array([found.parities(i) for i in keep], pa.list_(pa.int64())),
                     batch.column("lists").take(pa.array([low + i for i in keep], pa.int64()))],
                    names=["node", "n", "shingles", "parities", "lists"])

    fetched = ("text", "want", "lists")
    rows = docs.join(wanted.select(F.col("node").alias("want"), "lists", F.col("key").alias("_key")), F.col("key") == F.col("_key"))
    unnamed = wanted.filter("key is null").select(F.col("node").alias("want"), "lists", F.col("name").alias("_name"))
    texts = docs.filter("key is null").select("name", "text").distinct()
    rows = rows.select(*fetched).unionByName(texts.join(unnamed, F.col("name") == F.col("_name")).select(*fetched))
    return written(rows.mapInArrow(released(run), "node long, n long, shingles binary, parities array<long>, lists array<long>"), "sets")


def kept_lists(rows: DataFrame, label: str) -> DataFrame:
    """Rows of lists with at least two nodes, with the number of nodes as `f`, written."""
    often = rows.groupBy("list").agg(F.count("*").alias("_n")).filter("_n > 1").select("list")
    # The join has dealt the rows by list already; a list's nodes are counted where they are.
    sole = rows.join(often, "list").dropDuplicates(["list", "node"])
    return written(sole.withColumn("f", F.count("*").over(Window.partitionBy("list"))).filter("f > 1"), label)


def leaders(lists: DataFrame) -> DataFrame:
    """For each node the smallest node that it shares most lists with as their smallest."""
    least = lists.groupBy("list").agg(F.min("node").alias("a"))
    shared = lists.join(least, "list").filter("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    return shared.groupBy("b").agg(F.min_by("a", F.struct(-F.col("shared"), "a")).alias("a")).select("a", "b")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `n_shingles` and `component_id` (smallest key reachable by links) of every row."""
    base = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    # What a row without a key is fetched by.
    base = base.withColumn("name", F.when(F.col("key").isNull(), F.xxhash64("text")))
    for salt in itertools.count():
        all_ = written(members(base, salt), "members")
        named = all_.filter("node is not null")
        # Different sets under one hash: hash again, so that equal nodes are equal sets.
        if named.groupBy("node").agg((F.min("other") != F.max("other")).alias("clash")).filter("clash").isEmpty():
            break
    nodes = written(named.groupBy("node").agg(
        F.min("key").alias("key"), F.min("name").alias("name"), F.max("n").alias("n")), "nodes")
    sizes = {r["n"]: r["count"] for r in nodes.filter(F.col("n") <= LARGEST_SMALL).groupBy("n").count().collect()}
    small = boundary(sizes)

    common = common_shingles(base, salt)
    lists = kept_lists(prefixes(base, salt, small, common), "lists")
    light, heavy = lists.filter(F.col("f") <= LIGHT).drop("f"), lists.filter(F.col("f") > LIGHT).drop("f")
    slack = written(heavy.groupBy("node").agg(F.count("*").alias("slack")), "slack")
    close = written(reachable(pairs_of(light), nodes, slack), "close")
    wanted = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).unionByName(
        slack.select("node")).unionByName(nodes.filter(F.col("n") <= small).select("node")).distinct()
    # Grouped by node: as many lists at most as its set has shingles.
    own = heavy.groupBy("node").agg(F.collect_list("list").alias("lists"))
    sets = sets_of(base, nodes.join(wanted, "node").join(own, "node", "left"), salt)

    # Once for each node: the sets themselves are not shuffled for pairs that their sketches rule out.
    sketch = written(sets.select("node", "n", *[F.col("parities")[i].alias(f"p{i}") for i in range(PARITIES)]).dropDuplicates(["node"]), "sketch")
    close = written(alike(close, sketch), "alike")
    one = close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(alike(leaders(heavy), sketch))
    one = written(one.distinct(), "one")
    linked = written(verified(one, sets).unionByName(small_links(sets, small)), "linked")
    label = components(linked)

    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        other = label.select(F.col("node").alias(node), F.col("label").alias(name))
        return rows.join(other, node, "left").withColumn(name, F.coalesce(name, F.col(node)))

    often = heavy.groupBy("list").agg(F.count("*").alias("f"))
    placed = written(placed_lists(sets.filter("lists is not null"), common).join(often, "list").dropDuplicates(["list", "node"]), "placed")

    def mixed() -> DataFrame:
        """Of the heavy lists only those that still join different components."""
        parts = labelled(placed, "node", "label")
        kept = parts.groupBy("list").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("list")
        return parts.join(kept, "list").join(sketch.drop("n"), "node")

    early = written(near_ones(mixed()), "early")
    linked = written(linked.unionByName(verified(early, sets)), "linked")
    label = components(linked)
    rest = labelled(labelled(close, "a", "la"), "b", "lb").filter("la <> lb").select("a", "b")
    late = written(rest.unionByName(pairs_across(mixed())).distinct(), "late")
    late = verified(late, sets)
    final = components(written(linked.unionByName(late), "linked"))

    told = all_.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    root = told.filter("label is not null").groupBy("label").agg(F.min("key").alias("component_id"))
    return told.join(root, "label", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", F.col("key")).alias("component_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE: dict[str, str] = {}
