"""SimHash near-duplicates, found with vantage-point trees over Hamming distance.

A document's fingerprint has a bit for each hash bit that most of its shingles set.  Equal fingerprints are one
class, so copies cost nothing further.  Trees divide the classes: a node has a vantage point and a radius; a class
closer than the radius goes inside, any other outside, and by the triangle inequality only classes whose distance lies
within the search range of the radius go to both.  The upper tree is fitted on a bounded sample and deals all classes
to shards, boundary classes to several; a task goes on dividing its shard in the same way down to small leaves, where
distances are compared exactly.  A shard that the sample shows to hold too many classes for one task, as of a dense group
that no tree divides, is cut into blocks, and each pair of its blocks is one task.

Distances of random fingerprints all lie near half the bits, where a search range of several bits prunes little.
So each tree measures distance on a part of the bits, its view, with a smaller range: of two fingerprints that differ
in few bits, some view must differ in very few.  A view's distance is never above the whole distance, so its triangle
bounds hold, and the leaves compare whole fingerprints.

Two texts' fingerprints differ in a bit with probability angle / pi, the angle being that between their counts of
shingles.  A few words of fingerprint find copies to the letter; with eight, the cosine is known to about 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ceil_div, join_spread, materialize, small, table
from quillon.llm.components import Labels, components

SEED = 42
#: Fingerprint classes that the upper trees are fitted on, at most, and never more than a quarter of them; all classes are
#: dealt out and compared, whatever the sample.
SAMPLE = 65_536
#: Classes aimed at for a shard, and in a leaf of a task's own tree.  Each level of the upper tree deals boundary classes
#: twice, so shards are as large as a task's memory comfortably holds.
SHARD, LEAF = 100_000, 64
#: Classes that a task deals at a time; those that go to one shard travel as one row.
DEALT = 20_000
#: Different classes that a class may expect by chance within a loose view's reach.
CHANCE = 64
#: Cosine from which texts are near-duplicates in the pipeline, words of their fingerprints, and the share of pairs just at
#: that cosine that some view must find.
SIMILAR, WORDS, RECALL = 0.8, 8, 0.95
#: Rows (id and hash) up to which those to be dropped are sent to all tasks; more are shuffled with the texts.
DROPPED = 1_000_000

Block = tuple[int, int, int]  # word, shift, width
View = tuple[Block, ...]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle in its place; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() changes A to Z only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def document_fingerprint(text: str | None, shingle: int, n_words: int) -> bytes:
    """The fingerprint as big-endian 64-bit words; all zero for a text without words.

    The first word counts the bits of each shingle's XXH64; further words count those of its mixes.
    """
    h = shingle_hashes(text, shingle)
    if not len(h):
        return bytes(8 * n_words)
    salts = np.array([w * 0x9E3779B97F4A7C15 % (1 << 64) for w in range(n_words)], np.uint64)
    counts = np.zeros(64 * n_words, np.int64)
    for at in range(0, len(h), 255 * 16):
        x = h[at : at + 255 * 16, None]
        words = mix(x + salts) if n_words > 1 else x.copy()
        words[:, 0] = x[:, 0]
        # Bits as bytes, eight of them added as one integer; 255 rows cannot overflow a byte.
        lanes = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(lanes, np.arange(0, len(x), 255), axis=0)
        counts += sums.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8").astype(">u8").tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(prints) -> np.ndarray:
    """Fingerprints as rows of unsigned 64-bit words."""
    joined = b"".join(prints)
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(len(prints), -1) if len(prints) else np.zeros((0, 1), np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, n_words: int) -> DataFrame:
    """(id, print): each row's fingerprint."""

    @F.pandas_udf("binary")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([document_fingerprint(t, shingle, n_words) for t in texts])

    return docs.select(F.col(id_col).alias("id"), found(F.col(text_col)).alias("print"))


def farthest(cosine: float, bits: int) -> int:
    """The most differing bits at which the estimated cosine is at least the given one."""
    return int(bits * acos(cosine) / pi)


def loose_views(max_distance: int, n_words: int, n: int, recall: float) -> tuple[list[View], int]:
    """Views of random bits and their range, such that a pair at max_distance is in some view's range with the given probability.

    With more classes the views take more bits, so that by chance only a bounded number of classes is within range of
    one, and there are more views.
    """
    bits, width = 64 * n_words, 16
    while n * (width + 1) > CHANCE << width:
        width += 1
    p = max_distance / bits
    one = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    rng, order = np.random.default_rng(SEED), np.zeros(0, np.int64)
    count = max(1, ceil(log(1 - recall) / log(1 - one)))
    while len(order) < count * width:
        order = np.append(order, rng.permutation(bits)[: bits // width * width])
    chosen = order[: count * width].reshape(count, width)
    return [tuple((int(b) // 64, int(b) % 64, 1) for b in view) for view in chosen], 1


def exact_views(max_distance: int, n: int) -> tuple[list[View], int]:
    """Views of one 64-bit word and their range, such that no pair within max_distance is missed.

    With more classes the views take more bits, so that leaves stay small.
    """
    for blocks, taken, most in ((4, 1, 1 << 22), (5, 2, 1 << 27), (6, 3, 1 << 33), (8, 5, 1 << 62)):
        if n <= most or blocks == 8:
            cuts = [64 * i // blocks for i in range(blocks + 1)]
            parts = [(0, cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
            views = list(combinations(parts, taken))
            reach = max(sum(sorted(d)[:taken]) for d in spread(max_distance, blocks))
            return views, reach
    raise AssertionError


def spread(total: int, parts: int) -> Iterator[list[int]]:
    """All ways to write total as a sum of that many non-increasing parts."""

    def go(left: int, k: int, most: int) -> Iterator[list[int]]:
        if k == 1:
            if left <= most:
                yield [left]
            return
        for x in range(min(left, most), -1, -1):
            for rest in go(left - x, k - 1, x):
                yield [x, *rest]

    yield from go(total, parts, total)


def view_values(prints: np.ndarray, view: View) -> np.ndarray:
    """The bits of a view, packed into one unsigned 64-bit value a row."""
    out = np.zeros(len(prints), np.uint64)
    for word, shift, width in view:
        out = (out << np.uint64(width)) | ((prints[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def best_split(values: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[int, int, float]:
    """A vantage value, a radius, and the work that remains as a share of comparing all with all."""
    n, vantages = len(values), values[rng.integers(0, len(values), 4)]
    distances = np.bitwise_count(values[None, :] ^ vantages[:, None]) + (np.arange(4, dtype=np.int64) * 65)[:, None]
    upto = np.cumsum(np.bincount(distances.ravel(), minlength=4 * 65).reshape(4, 65), axis=1)
    outside = np.full((4, 65), n)
    outside[:, reach:] -= upto[:, : 65 - reach]
    share = np.where(upto > 0, (upto / n) ** 2 + (outside / n) ** 2, 2.0)
    k, radius = divmod(int(share.argmin()), 65)
    return int(vantages[k]), radius, float(share[k, radius])


def split(values: np.ndarray, rows: np.ndarray, vantage: int, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows inside, and those outside or within reach of the boundary from inside."""
    d = np.bitwise_count(values[rows] ^ np.uint64(vantage)).astype(np.int64)
    return rows[d <= radius], rows[d > radius - reach]


def fit_tree(values: np.ndarray, reach: int, shards: int) -> tuple[list[tuple], list[int]]:
    """Nodes as (vantage, radius, inner, outer), a negative child -k-1 being shard k, and how many values each shard gets.

    One shard: no nodes.
    """
    rng, nodes, shares = np.random.default_rng(SEED), [], []
    least = max(32, len(values) // max(1, shards))

    def grow(rows: np.ndarray) -> int:
        if len(rows) > least:
            v, radius, share = best_split(values[rows], reach, rng)
            if share < 0.85:
                k = len(nodes)
                nodes.append(())
                inside, outside = split(values, rows, v, radius, reach)
                nodes[k] = (v, radius, grow(inside), grow(outside))
                return k
        shares.append(len(rows))
        return -len(shares)

    grow(np.arange(len(values)))
    return nodes, shares


def route(values: np.ndarray, nodes: list[tuple], reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the rows that it gets."""
    todo = [(0 if nodes else -1, np.arange(len(values)))]
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        if k < 0:
            yield -k - 1, rows
            continue
        v, radius, inner, outer = nodes[k]
        inside, outside = split(values, rows, v, radius, reach)
        todo += [(inner, inside), (outer, outside)]


def link_shard(prints: np.ndarray, view: View, reach: int, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the shard's rows that link all rows which chains of pairs within max_distance connect."""
    values, labels, rng = view_values(prints, view), Labels(len(prints)), np.random.default_rng(SEED)
    todo = [np.arange(len(prints))]
    while todo:
        rows = todo.pop()
        if len(rows) > LEAF:
            v, radius, share = best_split(values[rows], reach, rng)
            if share < 0.9:
                todo += split(values, rows, v, radius, reach)
                continue
        compare(prints, values, rows, reach, max_distance, labels)
    return labels.stars()


def compare(prints: np.ndarray, values: np.ndarray, rows: np.ndarray, reach: int, max_distance: int, labels: Labels) -> None:
    """Join all rows within max_distance of each other and, in the view, within reach; rows that are one component already
    are not compared again."""
    v = values[rows]
    step = max(1, (1 << 17) // max(1, len(rows)))
    for at in range(0, len(rows) - 1, step):
        near = np.bitwise_count(v[at : at + step, None] ^ v[None, at:]) <= reach
        i, j = np.nonzero(near)
        later = j > i
        a, b = rows[at + i[later]], rows[at + j[later]]
        apart = labels.roots(a) != labels.roots(b)
        a, b = a[apart], b[apart]
        linked = np.bitwise_count(prints[a] ^ prints[b]).sum(1, dtype=np.int64) <= max_distance
        labels.join(a[linked], b[linked])


def link_prints(classes: DataFrame, views: list[View], reach: int, max_distance: int) -> DataFrame:
    """Links (a, b) between classes (cls long, print binary) that connect all classes within max_distance in some view's range.

    Rows out are at most one a class, view and shard that it was dealt to, however dense a group is.
    """
    n = classes.count()
    shards = ceil_div(n, SHARD)
    if shards > 1:
        held = words_of(classes.select("print").sample(min(0.25, SAMPLE / n), SEED).toPandas()["print"])
        trees = [fit_tree(view_values(held, v), reach, shards) for v in views]
    else:  # all classes fit in one shard, and nothing needs fitting
        held, trees = np.zeros((1, 1), np.uint64), [([], [1])] * len(views)
    # Blocks of each shard: more than one where the sample foretells more than a task should hold.
    blocks = [[1 if (m := s * n // len(held)) <= 2 * SHARD else ceil_div(2 * m, SHARD) for s in shares] for _, shares in trees]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> Iterator[pd.DataFrame]:
            names, prints = (np.concatenate(x) for x in zip(*held))
            for k, (view, (nodes, _)) in enumerate(zip(views, trees)):
                rows = []
                for shard, at in route(view_values(prints, view), nodes, reach):
                    b = blocks[k][shard]
                    for x, some in [(0, at)] if b == 1 else [(x, at[names[at] % b == x]) for x in range(b)]:
                        body = names[some].tobytes(), prints[some].tobytes()
                        rows += [(k, shard, min(x, y), max(x, y), *body) for y in range(b) if b == 1 or x != y]
                yield pd.DataFrame(rows, columns=["view", "shard", "low", "high", "cls", "prints"])

        for batch in batches:
            if len(batch):
                held.append((batch["cls"].to_numpy(np.int64), words_of(batch["print"])))
                if sum(len(names) for names, _ in held) >= DEALT:
                    yield from dealt()
                    held = []
        if held:
            yield from dealt()

    def link(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(b"".join(group["cls"]), np.int64)
        prints = np.frombuffer(b"".join(group["prints"]), np.uint64).reshape(len(names), -1)
        i, j = link_shard(prints, views[key[0]], reach, max_distance)
        return pd.DataFrame({"a": names[i], "b": names[j]})

    out = classes.select("cls", "print").mapInPandas(deal, "view int, shard int, low int, high int, cls binary, prints binary")
    return out.groupBy("view", "shard", "low", "high").applyInPandas(link, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, n_words: int = 1, max_distance: int = 4, recall: float | None = None
) -> DataFrame:
    """For each row: its id, its fingerprint as hexadecimal digits, and the smallest id that links lead to.

    Without recall, which needs one word, every pair within max_distance is found.  With it, a pair that differs in
    max_distance bits is found with that probability, and closer ones more surely.  Null texts and texts without words
    share the zero fingerprint.  Rows with a null id take part but are never the smallest; a component of null ids only
    has a null id.  Repeated rows are reported each.  Other columns are ignored.  An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, n_words), "prints")
    # Classes are numbered in the order of their smallest ids, so the smallest class of a component has its smallest id.
    rising = F.col("least").asc_nulls_last()
    ordered = prints.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("n")).repartitionByRange(rising).sortWithinPartitions(rising)
    classes = materialize(ordered.select("print", "least", "n", F.monotonically_increasing_id().alias("cls")), "classes")
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    views, reach = exact_views(max_distance, size["n"]) if recall is None else loose_views(max_distance, n_words, size["n"], recall)
    found = components(link_prints(classes, views, reach, max_distance))
    of = materialize(classes.join(found, F.col("cls") == F.col("node"), "left").select("print", "n", F.coalesce("component", "cls").alias("component")), "class-components")
    heads = of.groupBy("component").agg(F.count("*").alias("n")).join(classes.select(F.col("cls").alias("component"), F.col("least").alias("component_id")), "component")
    named = join_spread(of.withColumnRenamed("n", "copies"), heads, ["component"], size["n"]).select("print", F.col("copies").alias("n"), "component_id")
    rows = join_spread(prints, materialize(named, "named-classes"), ["print"], size["rows"])
    return rows.select(F.col("id").alias(id_col), F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, and of equal ids the smallest hash of its text.

    Texts link when the cosine of their counts of five-word shingles, as their fingerprints of WORDS words tell it, is at
    least SIMILAR.  Null ids come after all others.  Of rows equal in id and text any one stays.  Texts without words are
    near-duplicates of each other.
    """
    id_, mark = F.col(id_col), F.xxhash64(F.col(text_col))
    keyed = docs.select(F.struct(id_.isNull().alias("none"), id_.alias("id"), mark.alias("mark")).alias("row"), F.col(text_col).alias("text"))
    groups = near_duplicates(keyed, "row", "text", 5, WORDS, farthest(SIMILAR, 64 * WORDS), RECALL)
    groups = materialize(groups.select("row", (F.col("row") == F.col("component_id")).alias("first")), "groups")
    copies = groups.where("not first").select("row.id", "row.mark").distinct()
    kept = docs.join(small(copies, DROPPED), docs[id_col].eqNullSafe(copies["id"]) & (F.xxhash64(docs[text_col]) == copies["mark"]), "left_anti")
    twice = groups.where("first").groupBy("row").count().where("count > 1").select("row.id", "row.mark")
    if twice.isEmpty():
        return kept
    match = kept[id_col].eqNullSafe(twice["id"]) & (F.xxhash64(kept[text_col]) == twice["mark"])
    twice = small(twice, DROPPED)
    return kept.join(twice, match, "left_anti").unionByName(kept.join(twice, match, "left_semi").dropDuplicates([id_col, text_col]))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: fingerprints of four-word shingles and their components at four bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
