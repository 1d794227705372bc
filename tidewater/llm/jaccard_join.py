"""N-gram Jaccard join by token-combination prefixes, exact, down to connected components.

A document is its set of word shingles. Equal sets are one class. Tokens of a set are ordered from rare to
frequent (a fixed-size count sketch over all documents gives the order; any one order gives right results).
Two sets within the threshold share `k` tokens of their prefixes extended by `k - 1`; of those, either one is
rare, and both index it alone, or all are frequent, and both index the k-combination. Sets too large for
combinations index their frequent tokens alone; sets near that limit do both, so no pair falls between.

Pairs of a bucket are never all listed. Round one verifies each member of a bucket against two of its
members, one of them the most central; links found that way join most of a large group. Round two lists the pairs of the members outside
a bucket's largest component with the members of other components, exactly, behind bounds on size, on token
position and on the symmetric difference (parity bitmaps). What both rounds verify spans the link graph.

Defined results: null and wordless texts have the empty set, link with nothing and keep their own id; texts
of fewer words than a shingle are one shingle; equal texts link; repeated rows are rows of one class; a null
id takes part in its class and never names it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut, discard, forget, tidy
from tidewater.llm.components import connected

_U = np.uint64
MAPS = 4  # longs in a parity bitmap


@dataclass(frozen=True)
class JoinSpec:
    """Shingle width, threshold in percent, combination size, sketch size and class border.

    The sketch has 2**sketch_bits one-byte counters whatever the input; a token is frequent when its
    counter exceeds `frequent` and four times the mean counter.
    """

    width: int = 3
    percent: int = 90
    k: int = 2
    sketch_bits: int = 24
    frequent: int = 32
    combine_up_to: int = 400

    def least_overlap(self, n: int) -> int:
        return -(-n * self.percent // 100)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text; A-Z folded, words cut at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, _U)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1 + len(words))], _U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    out = np.zeros(len(words) - width + 1, _U)
    for i in range(width):
        out = _mix(out + h[i : len(h) - width + 1 + i] + _U(0x9E3779B97F4A7C15))
    return np.unique(out)


def fingerprint(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


# --- the order of tokens ------------------------------------------------------------------------

_SLICES = 64


def sketch(docs: DataFrame, spec: JoinSpec) -> np.ndarray:
    """Counters of how many documents hold a token of each slot, over all documents, in half powers of two.

    Tasks add up their own counters; slices of them are summed per slice. Only the summed bytes, of fixed
    size, reach the driver.
    """
    size = 1 << spec.sketch_bits
    part = size // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.uint32)
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append((shingle_set(text, spec.width) & _U(size - 1)).astype(np.int64))
                n += len(held[-1])
                if n > 2_000_000:
                    np.add.at(counters, np.concatenate(held), 1)
                    held, n = [], 0
        if held:
            np.add.at(counters, np.concatenate(held), 1)
        pack = zstandard.ZstdCompressor(level=1)
        for s in range(_SLICES):
            own = counters[s * part : (s + 1) * part]
            if own.any():
                planes = own.view(np.uint8).reshape(-1, 4).T.copy()
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "packed": pa.array([pack.compress(planes.tobytes())], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, total = zstandard.ZstdDecompressor(), None, None

        def done() -> pa.RecordBatch:
            level = np.minimum(255, np.round(2 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"slice": pa.array([last], pa.int32()), "packed": pa.array([level.tobytes()], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})

        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != last:
                    if last is not None:
                        yield done()
                    last, total = s, np.zeros(part, np.int64)
                raw = np.frombuffer(unpack.decompress(packed, max_output_size=4 * part), np.uint8).reshape(4, part)
                total += np.ascontiguousarray(raw.T).view(np.uint32).ravel()
        if last is not None:
            yield done()

    partial = docs.select("__text").mapInArrow(tidy(count), "slice int, packed binary")
    summed = partial.repartition(_SLICES, "slice").sortWithinPartitions("slice").mapInArrow(tidy(add), "slice int, packed binary, total long")
    out, total = np.zeros(size, np.uint8), 0
    for r in summed.collect():
        out[r.slice * part : (r.slice + 1) * part] = np.frombuffer(r.packed, np.uint8)
        total += r.total
    border = max(spec.frequent, 4 * total / size)
    return np.concatenate((out, [np.uint8(np.ceil(2 * np.log2(border)))]))


# --- keys ---------------------------------------------------------------------------------------


def prefix_keys(tokens: np.ndarray, levels: np.ndarray, spec: JoinSpec) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and each key's position bound: tokens of the set before the key's first one."""
    n, border = len(tokens), levels[-1]
    level = levels[(tokens & _U(len(levels) - 2)).astype(np.int64)]
    order = np.lexsort((tokens, level))
    ranked, level = tokens[order], level[order]
    slack = n - spec.least_overlap(n)
    keys, places = [], []
    combine = n * spec.percent <= spec.combine_up_to * 100
    single = n * 100 >= spec.combine_up_to * spec.percent
    if combine and n >= spec.k:
        reach = min(n, slack + spec.k)
        rare = np.flatnonzero(level[:reach] <= border)
        keys.append(_mix(ranked[rare]))
        places.append(rare)
        often = np.flatnonzero(level[:reach] > border)
        if len(often) >= spec.k:
            groups = np.array(list(itertools.combinations(often.tolist(), spec.k)), np.int64)
            value = np.full(len(groups), spec.k, _U)
            for column in groups.T:
                value = _mix(value * _U(31) + ranked[column])
            keys.append(value)
            places.append(groups[:, 0])
    elif combine:  # fewer tokens than a combination: the set joins equal sets only, by its class
        pass
    if single:
        reach = min(n, slack + 1)
        keys.append(_mix(ranked[:reach] ^ _U(0x5851F42D4C957F2D)))
        places.append(np.arange(reach))
    return (np.concatenate(keys), np.concatenate(places)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))


def parity_map(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((_mix(tokens) & _U(64 * MAPS - 1)).astype(np.int64), minlength=64 * MAPS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


_SIGNED = ", ".join(f"m{i} long" for i in range(MAPS))
_SET_SCHEMA = f"doc_id long, print long, n_shingles long, class binary, keys array<long>, places array<int>, {_SIGNED}"


def describe(docs: DataFrame, spec: JoinSpec, levels: np.ndarray) -> DataFrame:
    """One row a document: set size, class (fingerprint of the set), and, for the first of a class in a task, its keys."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["doc_id", "print", "n_shingles", "class", "keys", "places", *(f"m{i}" for i in range(MAPS))]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.int64()] * MAPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                columns: list[list] = [batch.column("__id").to_pylist(), batch.column("__print").to_pylist(), [], [], [], []]
                maps = []
                for text in batch.column("__text").to_pylist():
                    tokens = shingle_set(text, spec.width)
                    name = fingerprint(tokens) if len(tokens) else None
                    fresh = name is not None and name not in seen
                    if fresh:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(name)
                        keys, places = prefix_keys(tokens, shared.value, spec)
                    columns[2].append(len(tokens))
                    columns[3].append(name)
                    columns[4].append(keys.view(np.int64) if fresh else None)
                    columns[5].append(places.astype(np.int32) if fresh else None)
                    maps.append(parity_map(tokens))
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                arrays += [pa.array(c, pa.int64()) for c in np.array(maps).T]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(tidy(run), _SET_SCHEMA)


def _tokens(docs: DataFrame, spec: JoinSpec) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(t, spec.width).view(np.int64) for t in batch.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sets, pa.list_(pa.int64()))], names=["class", "tokens"])

    return docs.select("class", "__text").mapInArrow(tidy(run), "class binary, tokens array<long>")


def live_keys(described: DataFrame) -> DataFrame:
    """Keys that two classes or more hold: one group-by of two numbers a key, combined on the map side."""
    held = described.filter("keys IS NOT NULL").select(F.explode("keys").alias("key"), F.xxhash64("class").alias("c"))
    return held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")


LIVE_BITS = 26


def live_filter(keys: DataFrame) -> np.ndarray:
    """A fixed-size bit array that has every live key's bit; others pass it rarely and fall out later."""
    size = 1 << LIVE_BITS
    part = size // _SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy())] = True
        pack = zstandard.ZstdCompressor(level=1)
        for s in range(_SLICES):
            own = bits[s * part : (s + 1) * part]
            if own.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "packed": pa.array([pack.compress(np.packbits(own).tobytes())], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, total = zstandard.ZstdDecompressor(), None, None
        done = lambda: pa.RecordBatch.from_pydict({"slice": pa.array([last], pa.int32()), "packed": pa.array([total.tobytes()], pa.binary())})
        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != last:
                    if last is not None:
                        yield done()
                    last, total = s, np.zeros(part // 8, np.uint8)
                total |= np.frombuffer(unpack.decompress(packed, max_output_size=part // 8), np.uint8)
        if last is not None:
            yield done()

    marked = keys.mapInArrow(tidy(mark), "slice int, packed binary")
    joined = marked.repartition(_SLICES, "slice").sortWithinPartitions("slice").mapInArrow(tidy(join), "slice int, packed binary")
    out = np.zeros(size // 8, np.uint8)
    for r in joined.collect():
        out[r.slice * part // 8 : (r.slice + 1) * part // 8] = np.frombuffer(r.packed, np.uint8)
    return out


def _slot(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.view(_U)) >> _U(64 - LIVE_BITS)).astype(np.int64)


def live_index(described: DataFrame, live: np.ndarray) -> DataFrame:
    """`(class, key, place)` and the set's facts, for the keys that pass the live filter."""
    shared, maps = described.sparkSession.sparkContext.broadcast(live), [f"m{i}" for i in range(MAPS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            lists, places = batch.column("keys"), batch.column("places")
            keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = _slot(keys)
            keep = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)[keep]
            facts = batch.select(["class", "n_shingles", *maps]).take(pa.array(owner))
            columns = [pa.array(keys[keep], pa.int64()), pa.array(places.flatten().to_numpy(zero_copy_only=False)[keep], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *facts.columns], names=["key", "place", *facts.schema.names])

    rows = described.filter("keys IS NOT NULL").select("class", "keys", "places", "n_shingles", *maps)
    return rows.mapInArrow(tidy(run), f"key long, place int, class binary, n_shingles long, {_SIGNED}")


# --- verification and rounds -----------------------------------------------------------------------


def _may_link(spec: JoinSpec) -> Column:
    """Exact bounds for rows l and r of one bucket: sizes, tokens left after the key, symmetric difference."""
    p = spec.percent
    a, b = F.col("l.n_shingles"), F.col("r.n_shingles")
    sizes = (100 * F.least(a, b) >= p * F.greatest(a, b))
    left = F.least(a - F.col("l.place"), b - F.col("r.place"))
    placed = (100 + p) * left >= p * (a + b)
    apart = F.lit(0)
    for i in range(MAPS):
        apart = apart + F.bit_count(F.col(f"l.m{i}").bitwiseXOR(F.col(f"r.m{i}")))
    return sizes & placed & ((100 + p) * apart <= (100 - p) * (a + b))


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, spec: JoinSpec, label: str) -> DataFrame:
    """The pairs `(a, b)` of classes whose sets reach the threshold; sets are made anew for these classes only."""
    pairs = cut(pairs.select("a", "b").distinct(), label)
    forget(pairs.sparkSession)  # the buckets' shuffles, before the texts are joined
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    chosen = classes.join(needed, "class").select("class", "sample.*")
    text = docs.join(
        chosen, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__print") == F.col("print"))
    ).select("class", "__text").dropDuplicates(["class"])
    sets = cut(_tokens(text, spec), label)
    forget(pairs.sparkSession)  # the texts' shuffles, before the sets are joined
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .filter((100 + spec.percent) * common >= spec.percent * (F.size("ta") + F.size("tb")))
        .select("a", "b")
    )


def components(docs: DataFrame, spec: JoinSpec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, print, n_shingles, class, component_id)`, one row a document row.

    `print` is a 64-bit hash of the text, with which callers find the row again; `class` names the set.
    """
    spec = spec or JoinSpec()
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    docs = docs.withColumn("__print", F.xxhash64("__text"))
    keyed = cut(describe(docs, spec, sketch(docs, spec)), "jaccard-keys")
    described = cut(keyed.select("doc_id", "print", "n_shingles", "class"), "jaccard-sets")
    classes = described.filter("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct("doc_id", "print")).alias("sample"), F.min("doc_id").alias("least")
    )
    facts = ["key", "class", "place", "n_shingles", *(f"m{i}" for i in range(MAPS))]
    index = live_index(keyed, live_filter(live_keys(keyed)))
    # buckets of two classes or more, each with two hubs: the member with the fewest tokens before the key, which among
    # near copies is the one with the fewest tokens of its own, and another one drawn by hash
    draw = F.struct(F.xxhash64("class", "key").alias("d"), F.col("class").alias("c"))
    central = F.struct(F.col("place"), F.xxhash64("class", "key").alias("d"), F.col("class").alias("c"))
    buckets = index.groupBy("key").agg(
        F.count("*").alias("members"), F.min(central)["c"].alias("p"), F.min(draw)["c"].alias("low"), F.max(draw)["c"].alias("high")
    ).filter("low <> high").select("key", "members", "p", F.when(F.col("high") != F.col("p"), F.col("high")).otherwise(F.col("low")).alias("q"))
    # a class that several tasks met has one row a key; the rows of a key are together already
    live = cut(index.join(buckets, "key").dropDuplicates(["key", "class"]), "jaccard-live")
    discard(keyed)  # the keys that matter are in the buckets
    # every member is compared with both hubs, and the hubs with each other, once
    hub = F.when(F.col("class") == F.col("p"), F.array("q")).when(F.col("class") != F.col("q"), F.array("p", "q")).otherwise(F.array().cast("array<binary>"))
    probes = live.select(*facts, F.explode(hub).alias("hub"))
    hubs = live.filter("class = q OR (class = p AND members > 2)").select(*facts)
    first = (
        probes.alias("l")
        .join(hubs.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.hub") == F.col("r.class")) & _may_link(spec))
        .select(F.least("l.class", "r.class").alias("a"), F.greatest("l.class", "r.class").alias("b"))
    )
    links = cut(_verify(first, docs, classes, spec, "jaccard-probe"), "jaccard-links")
    roots = connected(links, "jaccard-roots")
    # exact remainder: members outside a bucket's largest component against members of other components;
    # a bucket of three rows or fewer has no pair without a hub
    rest_rows = live.filter("members > 3").select(*facts)
    marked = rest_rows.join(roots.withColumnRenamed("node", "class"), "class", "left")
    marked = cut(marked.withColumn("root", F.coalesce("root", "class")), "jaccard-marked")
    discard(live)
    shares = marked.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = marked.join(largest.filter("roots > 1").select("key", "main"), "key")
    second = (
        mixed.filter("root <> main").alias("l")
        .join(mixed.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root"))
              & ((F.col("r.root") == F.col("r.main")) | (F.col("l.class") < F.col("r.class"))) & _may_link(spec))
        .select(F.least("l.class", "r.class").alias("a"), F.greatest("l.class", "r.class").alias("b"))
    )
    rest = cut(_verify(second, docs, classes, spec, "jaccard-rest"), "jaccard-late")
    discard(marked)
    joined = roots
    if not rest.isEmpty():
        joined = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest), "jaccard-final")
    named = classes.select("class", "least").join(joined.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "root").select("class", "component_id")
    rows = described.select("doc_id", "print", "n_shingles", "class")
    return rows.join(by_class, "class", "left").select(
        "doc_id", "print", "n_shingles", "class",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, spec: JoinSpec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the least id, then the least text hash; its row unchanged.

    Of rows with the same id and text one stays; a null and an empty text are different.
    """
    found = components(docs, spec, id_col, text_col)
    group = F.coalesce("component_id", F.lit(-1)), F.coalesce(F.hex("class"), F.concat_ws("-", F.lit("own"), F.col("doc_id"), F.col("print")))
    component = F.when(F.col("class").isNull() | F.col("component_id").isNull(), group[1]).otherwise(group[0].cast("string"))
    chosen = found.groupBy(component.alias("__c")).agg(F.min(F.struct("doc_id", "print")).alias("s")).select(F.col("s.doc_id").alias("__kid"), F.col("s.print").alias("__kprint"))
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").cast("long").alias("__id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__print"), F.col(f"`{text_col}`").isNull().alias("__null"),
    )
    kept = own.join(chosen, F.col("__id").eqNullSafe(F.col("__kid")) & (F.col("__print") == F.col("__kprint")), "left_semi")
    return kept.dropDuplicates(["__id", "__print", "__null"]).select("__row.*")
