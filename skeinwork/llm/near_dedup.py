"""Near-duplicate detection: SetSketch bands for candidates, joint likelihood, exact verification, components.

1. One pass makes each document's set size, a 128-bit hash of its shingle set and its sketch. Documents with
   equal sets form a class; the smallest id stands for it from here on, so copies are never paired.
2. Band keys of the sketches give buckets. Every member of a bucket is tied to one hub (the bucket's smallest id);
   a member keeps the hub that it meets in most bands. The likelihood test and then the full sets decide.
3. Buckets whose members still lie in several components hold pairs that were not compared. A bucket of two is one
   more pair for the likelihood test and verification. Members of larger ones meet in blocks of bounded size, where an
   inverted index counts exact intersections and only links that join components come out. So each pair that shares a
   bucket ends up in one component or is compared, and no bucket is gathered in one task: a large one is split into
   pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import _text as tx
from skeinwork.llm._store import Store
from skeinwork.llm.components import connected_components
from skeinwork.llm.sketch import band_keys, may_be_similar, registers, shingle_sets

#: Rows and shingles of a block of a bucket, on average, in step 3 (8 bytes a shingle).
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Ids that may be broadcast (8 MB); their number is counted first.
FEW_IDS = 1_000_000


def _sketches(docs: DataFrame, size: int, m: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.chunks(batches):
            value, begin = shingle_sets(tx.Words(texts, lower=True), size)
            n = np.diff(begin)
            full = np.flatnonzero(n)
            ids = part.column("id").to_numpy().astype(np.int64)
            # Of documents without words: their own id, so that they meet no other.
            one, two = tx.mix(ids.view(np.uint64)), ids.view(np.uint64).copy()
            if len(full):
                one[full] = np.add.reduceat(tx.mix(value ^ np.uint64(0x5851F42D4C957F2D)), begin[full])
                two[full] = np.add.reduceat(tx.mix(value + np.uint64(0x14057B7EF767814F)), begin[full])
            sketch = np.full(len(texts), None, dtype=object)
            for i, row in zip(full, registers(value, begin, m), strict=True):
                sketch[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(tx.signed(one)), pa.array(tx.signed(two)), pa.array(list(sketch), pa.binary())], names=["id", "n", "c1", "c2", "sketch"])

    return docs.mapInArrow(emit, "id long, n long, c1 long, c2 long, sketch binary")


def _bands(reps: DataFrame, m: int, rows: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                regs = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, m)
                keys = band_keys(regs, rows)
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(keys.ravel())), *[pa.array(np.repeat(part.column(c).to_numpy(), keys.shape[1])) for c in ("id", "n")]], names=["key", "id", "n"])

    return reps.select("id", F.col("n").cast("int").alias("n"), "sketch").mapInArrow(emit, "key long, id long, n int")


def _plausible(pairs: DataFrame, reps: DataFrame, m: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that pass the likelihood test."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(-1, m) for c in ("s_a", "s_b"))
            n_a, n_b = (b.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            ok = may_be_similar((x == y).sum(1), (x > y).sum(1), (x < y).sum(1), n_a, n_b, similarity) if b.num_rows else np.zeros(0, dtype=bool)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(emit, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, n: int, size: int, store: Store, name: str) -> DataFrame:
    """Full shingle sets of the documents with the given n ids, stored."""
    ids = F.broadcast(ids) if n <= FEW_IDS else ids

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.chunks(batches):
            value, begin = shingle_sets(tx.Words(texts, lower=True), size)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([value[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], names=["id", "shingles"])

    return store.put(docs.join(ids, "id", "left_semi").mapInArrow(emit, "id long, shingles binary"), name)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, store: Store, name: str) -> DataFrame:
    """The stored pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = _sets(docs, ids, 2 * pairs.count(), size, store, f"{name}_sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda i, x: sets.select(F.col("id").alias(i), F.col("shingles").alias(x))
    out = store.put(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), name)
    store.drop(f"{name}_sets")
    return out


def _torn(bands: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the buckets that hold several components: the rows, and the buckets with their size, outermost ids and number of blocks."""
    placed = bands.join(components.withColumnRenamed("component", "__c"), "id", "left").select("key", "id", "n", F.coalesce("__c", "id").alias("c"))
    held = (F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("a"), F.max("id").alias("b"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.col("size")))
    return placed, placed.groupBy("key").agg(*held).where("lo < hi").select("key", "size", "a", "b", blocks.cast("int").alias("blocks"))


def _dealt(placed: DataFrame, torn: DataFrame) -> DataFrame:
    """Each row of a torn bucket once for every pair of blocks (i, j) that its own block belongs to."""
    rows = placed.join(torn.select("key", "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", "id", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def links_between(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a group of documents that join different components, without those that others make needless.

    An inverted index over the group's shingles counts the intersections of one document with all others at once. Only
    documents outside the largest component are looked up: they see every pair of different components.
    """
    size = np.array([len(x) for x in sets])
    shingle, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(place, kind="stable")
    posting, at = owner[order], np.searchsorted(place[order], np.arange(len(shingle) + 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    names, of = np.unique(component, return_inverse=True)
    largest, out = np.bincount(of).argmax(), []
    for x in np.flatnonzero(of != largest):
        common = np.bincount(np.concatenate([posting[at[t] : at[t + 1]] for t in place[begin[x] : begin[x + 1]]]), minlength=len(sets))
        linked = np.flatnonzero((100 * common >= percent * (size + size[x] - common)) & (of != of[x]))
        for c in np.unique(of[linked]):
            y = linked[of[linked] == c][0]
            out.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
            of[of == c] = of[x]
    return out


def _compared(dealt: DataFrame, docs: DataFrame, size: int, percent: int, store: Store, name: str) -> DataFrame:
    """Step 3 for buckets of three and more: whole groups of rows are compared on full sets where they are."""
    ids = dealt.select("id").distinct()
    sets = _sets(docs, ids, ids.count(), size, store, f"{name}_sets")
    rows = dealt.join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            columns = (b.column(x).to_pylist() for x in ("key", "i", "j", "id", "c", "shingles"))
            for key, i, j, *row in zip(*columns, strict=True):
                if (key, i, j) != now:
                    yield from found(held)
                    now, held = (key, i, j), []
                held.append(row)
        yield from found(held)

    def found(held: list) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            sets = [np.frombuffer(x, dtype=np.uint64) for _, _, x in held]
            pairs = links_between(np.array([x for x, _, _ in held]), np.array([c for _, c, _ in held]), sets, percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    out = store.put(rows.select("key", "i", "j", "id", "c", "shingles").mapInArrow(compare, "a long, b long").distinct(), name)
    store.drop(f"{name}_sets")
    return out


def _merged(components: DataFrame, links: DataFrame, store: Store, name: str) -> DataFrame:
    """The components after further links, which are drawn between the old components."""
    of = lambda x: components.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b"))
    over = connected_components(between.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), store, name)
    ids = components.union(between.select("a", "c_a")).union(between.select("b", "c_b")).distinct()
    return store.put(ids.join(over.select(F.col("id").alias("component"), F.col("component").alias("__over")), "component", "left").select("id", F.coalesce("__over", "component").alias("component")), f"{name}_ids")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, band_rows: int = 6, bands: int = 53) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``class_id``, ``component_id`` and ``kept``.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a document's set holds its distinct shingles
    of ``shingle_words`` words, or the whole sequence if it has fewer. Documents are linked when 100 * intersection
    >= ``percent`` * union. ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id
    reachable, ``kept`` whether that is the row's own. Null, empty or blank texts have no set and stay alone. Ids must
    be unique and not null (rows with a null id are left out). A pair at exactly 80 % shares no bucket with
    probability (1 - 0.8**6)**53 = 1e-7.
    """
    spark = docs.sparkSession
    tx.small_batches(spark)
    store, m, similarity = Store(spark), bands * band_rows, percent / 100
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    all_docs = store.put(_sketches(small, shingle_words, m), "sketches")
    classes = store.put(all_docs.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep")), "classes")
    reps = store.put(all_docs.where("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "sketch"), "reps")

    banded = _bands(reps, m, band_rows)
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    shared = store.put(banded.join(hubs, "key"), "buckets")
    met = shared.where("id > hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    tied = store.put(_plausible(best.select(F.col("hub").alias("a"), F.col("id").alias("b")), reps, m, similarity), "tied")
    links = _verified(tied, small, shingle_words, percent, store, "links")
    near = connected_components(links, store, "near")

    placed, torn = _torn(shared.select("key", "id", "n"), near)
    torn = store.put(torn, "torn")
    twos = store.put(_plausible(torn.where("size = 2").select("a", "b").distinct(), reps, m, similarity), "twos")
    more = _verified(twos, small, shingle_words, percent, store, "more")
    dealt = store.put(_dealt(placed, torn.where("size > 2")), "dealt")
    more = more.union(_compared(dealt, small, shingle_words, percent, store, "compared"))
    components = _merged(near, more, store, "all")
    store.drop("buckets")

    placed = classes.join(components.select(F.col("id").alias("rep"), "component"), "rep", "left").select("c1", "c2", "rep", F.coalesce("component", "rep").alias("component"))
    out = all_docs.select("id", "n", "c1", "c2").join(placed, ["c1", "c2"], "left")
    component, own = F.coalesce("component", "id"), F.coalesce("rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("class_id"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
