"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

The corpus is cut into blocks of whole documents; a block keeps its tokens as indexes into its own sorted vocabulary
of 64-bit word hashes.  Counts of a key (a word, or a pair of words) over all blocks are found by one exchange: each
block sends its different keys with its own counts, cut by key range into buckets; a bucket adds them up and sends each
block the totals of the keys it asked for, in the order asked, so no key travels back.  However frequent a key is, a
block sends it once.  Pairs with a word that only one block holds, in training or held-out texts, are counted there and
not sent.

P(w | h) = l2 c(h,w)/c(h) + l1 c(w)/N + l0/(V+1), where the weights depend on the bucket of c(h) by powers of two.
They are learned by expectation-maximisation on deleted counts: each training token is predicted from the counts
without itself.  The tokens enter as a histogram over the context bucket and the two estimates on a fine logarithmic
grid, whose size does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ceil_div, crc_fold, materialize, scratch, table
from quillon.llm.shared_files import opened, written
from quillon.llm.simhash import mix

SEED = 42
#: Stand for the end and the start of a text; no word holds these characters.
END, START = b"\n", b"\r"
#: Tokens in a block, keys in a bucket, and tokens of a block whose estimates are held at a time.
BLOCK_TOKENS, BUCKET_KEYS, SLICE = 2_000_000, 1_000_000, 1 << 17
#: Grid steps per factor of two, and rounds of expectation-maximisation.
STEPS, ROUNDS = 8, 60


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as many bytes each as the largest needs; the first byte says how many."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw) -> np.ndarray:
    """The integers that pack() wrote, with 32 bits where these suffice."""
    width = raw[0] if isinstance(raw, bytes) else memoryview(raw)[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    size = 4 if width <= 4 else 8
    out = np.zeros((len(body), size), np.uint8)
    out[:, :width] = body
    return out.view(f"<u{size}").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


class Indexed(dict):
    """Numbers new keys in the order met."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def blocks_of(docs: DataFrame, id_col: str, text_col: str, folds: int, held_out: int, block_tokens: int) -> DataFrame:
    """One row a block: its documents' ids, folds and lengths, its vocabulary, and its tokens, each document with an end."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 24, 0
        ids, held, sizes, tokens, index, n = [], [], [], [], Indexed(), 0

        def block() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in index], np.uint64)
            words, inverse = np.unique(hashes, return_inverse=True)
            all_tokens = inverse.astype(np.uint32)[np.concatenate(tokens)]
            names, out = pa.concat_arrays(ids), pa.array(held, pa.bool_())
            whole = pa.array([0, len(held)], pa.int32())
            columns = {
                "block": [first + made], "ids": pa.ListArray.from_arrays(whole, names), "held": pa.ListArray.from_arrays(whole, out), "sizes": [np.array(sizes, "<u4").tobytes()],
                "words": [pack_sorted(words)], "tokens": [pack(all_tokens)], "n_words": [len(words)], "n_tokens": [n],
            }
            return pa.RecordBatch.from_pydict(columns)

        for b in batches:
            since = 0
            for k, (out, text) in enumerate(zip(b["held"].to_pylist(), b["text"])):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() changes A to Z only
                words.append(END)
                tokens.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                held.append(out)
                sizes.append(len(words))
                n += len(words)
                if n >= block_tokens:
                    ids.append(b["id"].slice(since, k + 1 - since))
                    yield block()
                    made, since = made + 1, k + 1
                    ids, held, sizes, tokens, index, n = [], [], [], [], Indexed(), 0
            ids.append(b["id"].slice(since))
        if held:
            yield block()

    fold = F.coalesce(crc_fold(F.col(id_col), folds) == held_out, F.lit(False))
    texts = docs.select(F.col(id_col).alias("id"), fold.alias("held"), F.col(text_col).alias("text"))
    schema = f"block long, ids array<{id_type}>, held array<boolean>, sizes binary, words binary, tokens binary, n_words long, n_tokens long"
    return materialize(texts.mapInArrow(run, schema), "lm-blocks")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of Arrow batches, unpacked one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block({name: batch[name][k] for name in batch.schema.names})


class Block:
    """The arrays of a block's row."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.name, self.ids = row["block"].as_py(), row["ids"].values
        self.sizes = np.frombuffer(row["sizes"].as_buffer(), "<u4").astype(np.int64)
        self.words, self.tokens = unpack_sorted(row["words"].as_buffer()), unpack(row["tokens"].as_buffer()).astype(np.int32)
        self.held = row["held"].values.to_numpy(zero_copy_only=False).astype(bool)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)

    def own(self) -> np.ndarray:
        """Training tokens of each word in this block."""
        return np.bincount(self.tokens[self.train], minlength=len(self.words))

    def before(self) -> np.ndarray:
        """Each token's previous word (-1: start)."""
        out = np.empty_like(self.tokens)
        out[1:] = self.tokens[:-1]
        out[self.firsts] = -1
        return out

    def pairs(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted different pair keys, each token's place among them, and a token of each key."""
        scrambled = np.append(mix(self.words + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(2), np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        key = np.empty(len(self.tokens), np.uint64)
        for at in range(0, len(key), SLICE):
            part = slice(at, at + SLICE)
            key[part] = mix(scrambled[before[part]] ^ self.words[self.tokens[part]])
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        place = np.empty(len(key), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        return key[new], place, order[new]


def requests(name: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A block's sorted keys and their counts, cut by key range."""
    edges = np.array([(1 << 64) * i // buckets for i in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    parts = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    columns = {"block": pa.array([name] * len(parts), pa.int64()), "bucket": pa.array([i for i, _, _ in parts], pa.int32())}
    packed = {"keys": [pack_sorted(keys[a:b]) for _, a, b in parts], "n": [pack(n[a:b]) for _, a, b in parts]}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v, pa.binary()) for k, v in packed.items()})


def add_up(asked: DataFrame, folder: str) -> tuple[int, int]:
    """Answer requests: a file for each block with the totals of its keys in order; returns (different keys counted, sum).

    Keys that no block counted more than zero times have the total zero and are not counted as keys.  A total is stored
    doubled, plus one if no other block asked for the key.
    """

    def total(g: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in g["keys"]]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, np.concatenate([unpack(n) for n in g["n"]])).astype(np.int64)
        told = (2 * sums + (np.bincount(place) == 1)).astype(np.uint64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        stats = np.zeros((len(g), 2), np.int64)
        stats[0] = (sums > 0).sum(), sums.sum()
        return pd.DataFrame({"block": g["block"], "bucket": g["bucket"], "totals": [pack(told[p]) for p in np.split(place, cuts)], "keys": stats[:, 0], "sum": stats[:, 1]})

    def store(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bucket")
        with written(f"{folder}/{g['block'].iloc[0]}.u64") as f:
            f.write(pack(np.concatenate([unpack(t) for t in g["totals"]])))
        return pd.DataFrame({"keys": [g["keys"].sum()], "sum": [g["sum"].sum()]})

    answers = asked.groupBy("bucket").applyInPandas(total, "block long, bucket int, totals binary, keys long, sum long")
    files = materialize(answers.groupBy("block").applyInPandas(store, "keys long, sum long"), "lm-answers")
    r = files.agg(F.sum("keys"), F.sum("sum")).first()
    return r[0] or 0, r[1] or 0


def answered(folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The totals of a block's keys, and which of them no other block asked for."""
    with opened(f"{folder}/{block}.u64") as f:
        told = unpack(f.read())
    return (told >> 1).astype(np.int64), (told & 1).astype(bool)


class Counts:
    """The corpus counts of a block's words and pairs, and its tokens' places among them."""

    def __init__(self, b: Block, words_in: str, pairs_in: str | None, starts: int):
        self.block, self.before, self.starts = b, b.before(), starts
        self.word, here = answered(words_in, b.name)
        keys, self.place, one = b.pairs(self.before)
        left, right = self.before[one], b.tokens[one]
        settled = here[right] | np.where(left < 0, False, here[left])
        self.pair = np.bincount(self.place[b.train], minlength=len(keys))
        self.asked = keys[~settled], self.pair[~settled]
        if pairs_in is not None and not settled.all():
            self.pair[~settled] = answered(pairs_in, b.name)[0]

    def slices(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Some of the block's tokens at a time, with the counts of each one's context, pair and word."""
        for at in range(0, len(self.place), SLICE):
            part = slice(at, at + SLICE)
            before = self.before[part]
            yield part, np.where(before < 0, self.starts, self.word[before]), self.pair[self.place[part]], self.word[self.block.tokens[part]]


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for 0, 1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.frexp(c.astype(np.float64))[1]


def learn(cells: pd.DataFrame, floor: float) -> np.ndarray:
    """Weights (l0, l1, l2) of each context bucket, by expectation-maximisation over a histogram of deleted estimates.

    cells: bucket, q1, q2 (grid places, q2 -1 for zero), n.  A bucket without tokens takes the weights of all, and one
    token's worth of the uniform estimate keeps every weight l0 above zero.
    """
    weights = np.zeros((65, 3))
    whole = cells.groupby(["q1", "q2"], as_index=False)["n"].sum()

    def fit(part: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        n = part["n"].to_numpy(float)
        q1, q2 = part["q1"].to_numpy(), part["q2"].to_numpy()
        p = np.stack([np.full(len(n), floor), np.where(q1 < 0, 0, floor * 2.0 ** (q1 / STEPS)), np.where(q2 < 0, 0, floor * 2.0 ** (q2 / STEPS))], 1)
        w = start.copy()
        for _ in range(ROUNDS):
            each = p * w
            shares = each / each.sum(1, keepdims=True) * n[:, None]
            w = shares.sum(0) + np.array([1.0, 0.0, 0.0])
            w /= w.sum()
        return w

    common = fit(whole, np.array([0.2, 0.4, 0.4])) if len(whole) else np.array([1.0, 0.0, 0.0])
    weights[:] = common
    for k, part in cells.groupby("bucket"):
        weights[int(k)] = fit(part, np.maximum(common, 1e-3))
    # No context seen: there is no pair estimate to weigh.
    none = weights[0, :2] / weights[0, :2].sum()
    weights[0] = [*none, 0.0]
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Score every text by a model of all texts outside the held-out fold (crc32 of the id as text, modulo folds).

    Null texts are empty: their only token is the end.  Rows with null ids are in the training part.  Ids of any type
    are returned as they are.  Equal ids and repeated rows are scored, and counted, each.  Without training rows the
    counts are zero and all tokens share one uniform probability.  An empty table gives no rows.  Other columns are
    ignored.  A text longer than a block is a block of its own and is held whole.
    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = blocks_of(docs, id_col, text_col, folds, held_out, block_tokens)
    sizes = blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum(F.size(F.filter("held", lambda x: ~x)))).first()
    n_words, n_tokens, starts = (x or 0 for x in sizes)
    words_in, pairs_in = scratch(docs.sparkSession, "lm-words"), scratch(docs.sparkSession, "lm-pairs")
    asked = "block long, bucket int, keys binary, n binary"

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            yield requests(b.name, b.words, b.own(), ceil_div(n_words, bucket_keys))

    total_words, total = add_up(blocks.mapInArrow(ask_words, asked), words_in)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            yield requests(b.name, *Counts(b, words_in, None, starts).asked, ceil_div(n_tokens, bucket_keys))

    add_up(blocks.mapInArrow(ask_pairs, asked), pairs_in)
    floor = 1.0 / (total_words + 1)

    def place(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.rint(np.log2(np.maximum(p, floor) / floor) * STEPS), -1).astype(np.int64)

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for part, *counts in Counts(b, words_in, pairs_in, starts).slices():
                context, pair, token = (x[b.train[part]] - 1 for x in counts)
                q1, q2 = place(token / max(1, total - 1)), place(pair / np.maximum(context, 1))
                found.append(np.unique((context_bucket(context).astype(np.int64) << 40) + ((q1 + 1) << 20) + q2 + 1, return_counts=True))
            cells, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in found]), len(cells)).astype(np.int64)
            low = (1 << 20) - 1
            yield pa.RecordBatch.from_pydict({"bucket": (cells >> 40).astype(np.int32), "q1": (cells >> 20 & low) - 1, "q2": (cells & low) - 1, "n": n})

    cells = blocks.mapInArrow(deleted, "bucket int, q1 long, q2 long, n long").groupBy("bucket", "q1", "q2").agg(F.sum("n").alias("n")).toPandas()
    weights = learn(cells, floor)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            base, own, known = np.empty(len(b.tokens)), np.empty(len(b.tokens)), np.empty(len(b.tokens), np.int64)
            for part, context, pair, token in Counts(b, words_in, pairs_in, starts).slices():
                w = weights[context_bucket(context)]
                own[part] = np.log10(w[:, 0] * floor + w[:, 1] * token / max(1, total) + w[:, 2] * pair / np.maximum(context, 1))
                base[part] = np.log10((token + 1) / (total + (total_words + 1)))
                known[part] = token > 0
            columns = {
                "id": b.ids, "held_out": b.held, "n_tokens": b.sizes, "n_known": np.add.reduceat(known, b.firsts), "train_tokens": np.full(len(b.sizes), total, np.int64),
                "base_score": np.add.reduceat(base, b.firsts), "score": np.add.reduceat(own, b.firsts),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.mapInArrow(score, schema).withColumnRenamed("id", id_col)


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: log10 probabilities of every document."""
    return score_texts(table(spark, sf_dir, "documents"))
