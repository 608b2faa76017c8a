"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of a fixed length. For each output
shard the number of blocks from each source is drawn multinomially from what is still due, so that all shards
together meet the targets. The slots of a source are numbered through all shards; a slot's block is found by a
pseudorandom permutation of the block indexes, another one for each pass through the source. Blocks and slots
are joined by source and index. No block is taken more than three times, hence no document either.

Only one row per source comes to the driver (at most MOST_SOURCES), and one row per shard and source goes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, for_python, table, trimmed

BLOCK, SHARD_BLOCKS, SEED = 64, 4096, 20_240_601
WEIGHTS, MOST_COPIES = (1.0, 2.0, 3.0), 3
MOST_SOURCES, MOST_SHARDS = 1_000_000, 10_000
#: Draws (a shard and a source each) that the driver makes, if there are so many sources at least as many; slots of one task.
DRAWS, SLOTS = 1_000_000, 1 << 16
#: Characters of text that go back to Spark at once.
PIECE = 1 << 20
#: Documents of one source whose sizes are summed up in one place.
GROUP = 2_000
_WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """The sum of sizes shared by weight; a share stops at most times its size, the excess is shared again."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        closed = set(above)
        open_ = [i for i in open_ if i not in closed]
    return out


def draw(due: list[int], shard_blocks: int, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): multinomial counts per shard out of what is still due of each source."""
    rng, left = np.random.default_rng(seed), np.array(due, dtype=np.int64)
    done, out, shard = np.zeros_like(left), [], 0
    while (total := int(left.sum())) > 0:
        n = min(shard_blocks, total)
        got = np.minimum(rng.multinomial(n, left / total), left)
        while (more := n - int(got.sum())) > 0:  # what a source had no more of is drawn again from the others
            rest = left - got
            got = np.minimum(got + rng.multinomial(more, rest / rest.sum()), left)
        i = np.flatnonzero(got)
        out += zip([shard] * len(i), i.tolist(), done[i].tolist(), got[i].tolist(), strict=True)
        done, left, shard = done + got, left - got, shard + 1
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: int, rounds: int = 24) -> np.ndarray:
    """Images of indexes under a pseudorandom permutation of range(size): rounds of swap-or-not."""
    x = index.astype(np.uint64)
    n = np.uint64(size)
    for r in range(rounds):
        k = _mix(np.array([key * 1_000_003 + r], dtype=np.uint64))[0]
        other = (k % n + n - x) % n
        swap = _mix(np.maximum(x, other) ^ k ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)
        x = np.where(swap == 1, other, x)
    return x.astype(np.int64)


def _plan(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sized rows (doc_id, source, h, sid, size, first word), sources (sid, source_size, target, blocks) and block counts."""
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long").alias("size")))
    known = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(known) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    known.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in known]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(known))])
    blocks = [-(-s // block) for s in sizes]
    due = [min(MOST_COPIES * b, round(t * b / s)) if s else 0 for s, t, b in zip(sizes, goal, blocks, strict=True)]
    shards = max(1, min(MOST_SHARDS, DRAWS // max(1, len(known))))
    ranges = draw(due, max(SHARD_BLOCKS, -(-sum(due) // shards)))
    sources = spark.createDataFrame([(i, r.source, s, t, b) for i, (r, s, t, b) in enumerate(zip(known, sizes, goal, blocks, strict=True))], "sid int, source string, source_size long, target double, blocks long")
    parts = max(1, -(-max((r.docs for r in known), default=0) // GROUP))
    spread = sized.join(sources.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)))
    before = spread.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = before.select("sid", "part", (F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("sid", "part").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = cut(placed.join(before, ["sid", "part"]).select("doc_id", "source", "h", "sid", "size", (F.col("before") + F.col("within")).alias("first")))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sid, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at in range(first, first + n, 1 << 16):
                    slot = np.arange(at, min(at + (1 << 16), first + n))
                    turn, index = slot // blocks[sid], slot % blocks[sid]
                    found = np.concatenate([permuted(index[turn == t], blocks[sid], SEED + 7919 * sid + int(t)) for t in np.unique(turn)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), sid), pa.int32()), pa.array(found)], ["sid", "block"])

    drawn = spark.createDataFrame(ranges, "shard long, sid int, first long, n long")
    counts = drawn.repartition(min(MOST_SHARDS, 1 + sum(due) // SLOTS), "shard", "sid").mapInArrow(slots, "sid int, block long").groupBy("sid", "block").agg(F.count("*").alias("times"))
    return placed, sources, counts


def _pieces(placed: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """For each row with words and each taken block of it: words in common and how often the block is taken."""
    spans = placed.where("size > 0").select("sid", "first", "size", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block"))
    words = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("first", F.col("block") * block)
    return spans.join(counts, ["sid", "block"]).select("sid", "first", "block", words.alias("words"), "times")


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of docs (doc_id, text, source).

    size counts words (runs of characters other than space and U+0009 to U+000D), none in null and empty texts.
    Sources by code point, null last, weigh 1, 2, 3, repeating. taken counts the words that the mix takes of a
    row, repeats included: at most three times its size, and together within a block of the source's target.
    Repeated rows and doc_ids count each; a null doc_id is as good as any. Reruns agree. No rows, no rows.
    """
    for_python(docs.sparkSession)
    placed, sources, counts = _plan(docs.select("doc_id", "text", "source"), block)
    taken = _pieces(placed, counts, block).groupBy("sid", "first").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = placed.withColumn("key", F.when(F.col("size") > 0, F.col("first"))).join(taken.withColumnRenamed("first", "key"), ["sid", "key"], "left")
    return out.join(sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of docs (doc_id, text, lang, source, n_chars).

    A document gives up to three rows: row k holds what is taken k times or more, as it stands in the text
    (stretches of words from blocks that follow each other are cut out whole, others joined by a line break).
    A document that is taken whole gives its text unchanged. What is not taken is not there: this is how
    sources above their target shrink. Documents without words have nothing to take and give no row.
    """
    for_python(docs.sparkSession)
    names = docs.columns
    placed, _, counts = _plan(docs.select("doc_id", "text", "source"), block)
    got = _pieces(placed, counts, block).groupBy("sid", "first").agg(F.sort_array(F.collect_list(F.struct("block", "times"))).alias("x"))
    takes = placed.where("size > 0").join(got, ["sid", "first"]).select("h", "doc_id", "source", F.lit(0).alias("kind"), "first", F.col("x.block").alias("block"), F.col("x.times").alias("times"))
    whole = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in names)).alias("row")
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "doc_id", "source", F.lit(1).alias("kind"), whole)
    met = takes.unionByName(rows, allowMissingColumns=True).repartition("h", "doc_id").sortWithinPartitions("h", "doc_id", "source", "kind")
    at = names.index("text")
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # takes of the rows that are equal in doc_id, source and text; the first of these rows has them all
        for b in batches:
            picked, texts, size = [], [], 0
            kind, cols = b.column(3).to_pylist(), [b.column(n) for n in range(3)]
            first, blocks, times = (b.column(n) for n in (4, 5, 6))
            fields = b.column(7).flatten()
            for i, now in enumerate(zip(*(c.to_pylist() for c in cols), strict=True)):
                if now != key:
                    key, held = now, []
                if kind[i] == 0:
                    held.append((first[i].as_py(), blocks[i].as_py(), times[i].as_py()))
                elif held:
                    text = fields[at][i].as_py()
                    for said in (x for t in held for x in taken_texts(text, *t, block)):
                        picked.append(i), texts.append(said)
                        size += len(said)
                    held = []
                    if size > PIECE:
                        yield rows_of(fields, picked, texts)
                        picked, texts, size = [], [], 0
            if picked:
                yield rows_of(fields, picked, texts)

    def rows_of(fields: list[pa.Array], picked: list[int], texts: list[str]) -> pa.RecordBatch:
        rows = pa.array(picked, pa.int64())
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in names:
            new["n_chars"] = pa.array([len(t) for t in texts], fields[names.index("n_chars")].type)
        return pa.RecordBatch.from_arrays([new[n] if n in new else f.take(rows) for n, f in zip(names, fields, strict=True)], names)

    return met.mapInArrow(trimmed(run), schema)


def taken_texts(text: str, first: int, blocks: list[int], times: list[int], block: int) -> list[str]:
    """For k = 1, 2, 3 the parts of a text whose blocks are taken k times or more."""
    raw = text.encode()
    byte = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(byte) + 2, dtype=np.int8)  # of a word; other bytes of a character are never these six
    inside[1:-1] = (byte != 32) & ((byte < 9) | (byte > 13))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    for k in range(1, MOST_COPIES + 1):
        runs: list[list[int]] = []
        for b, n in zip(blocks, times, strict=True):
            if n >= k:
                lo, hi = max(b * block - first, 0), min((b + 1) * block - first, len(start))
                if runs and runs[-1][1] == lo:
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
        if runs == [[0, len(start)]]:
            out.append(text)
        elif runs:
            out.append(b"\n".join([raw[start[lo] : end[hi - 1]] for lo, hi in runs]).decode())
    return out


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixture() of all documents; nulls, ties, repeated rows and empty tables as there."""
    return mixture(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
