"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, a shingle's weight its count in the text times its
inverse document frequency. That is augmented: a shingle of every document weighs half of a unique one. So
copies in large groups, whose common shingles are frequent just because of the group, still reach the
threshold; shingles of less than a thousandth of the documents all weigh 1. Frequencies are counted over all
documents in 2 ** 20 hashed slots, a table of fixed size that is summed in rounds of 64 parts and is the only
thing that reaches the driver. What other shingles add to a slot on average is taken off again; a rare shingle
counts as frequent only where it meets a frequent one in its slot. Improved consistent weighted sampling draws
100 samples of each set, alike with the probability of the weighted Jaccard similarity of two sets; bands of
five make 20 bucket keys (two texts of similarity 0.8 miss each other with a probability of 0.0004). Random
numbers belong to the pair of shingle and sample, so long texts without common shingles share no samples.

Texts of the same words are first reduced to one. In each bucket the member with the most frequent
shingles, the middle of a group, is compared with all others: no pairs within groups are listed. Members of
a bucket that then lie in different components are compared by their samples first, in pairs of blocks of
the clusters that buckets connect; where 60 of 100 samples agree (texts of similarity 0.8 fall short of that
once in a million times), the whole texts are compared, again in pairs of blocks. Both return links only,
no more than rows. Every link is verified by the exact weighted Jaccard similarity. Pairs whose weight sums
alone rule out the threshold are not compared. Tables between the steps lie in the shared folder.

Result: component_id, the smallest identifier of the row's component. Null and empty texts have no shingles
and link with nothing, nor do rows without identifier. Rows that share an identifier count as one document,
with the smallest component of their texts; where duplicates are dropped they go together, and if they stay,
one row of each of their texts does.
Columns of the input named like an output column are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliopanel.llm.common import col, stored, without
from heliopanel.llm.graph import components, roots
from heliopanel.llm.shingles import mixed, passes, shingle_hashes, weighted_sets

OUTPUT = ("component_id", "kept")
SLOTS, PART = 1 << 20, 4096
#: Shingles of a smaller share of the documents weigh alike.
RARE = 0.001
BANDS, ROWS = 20, 5
FAN_IN = 64
#: Texts of a block, and shingles compared at once, where clusters are compared.
BLOCK, SAMPLE_BLOCK, COLUMNS = 512, 2048, 4096
#: Shingles that are sampled together.
SAMPLED = 256
#: Word sequences that a task remembers while it looks for copies.
REMEMBERED = 1 << 20


def document_counts(docs: DataFrame) -> DataFrame:
    """From (id, text): rows (id, digest, n) for documents and (part, task, counts) for slots, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(SLOTS, np.int64)
        names = ["id", "digest", "n", "part", "task", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            ids, place = batch.column("id"), 0
            for texts in passes([t or "" for t in batch.column("text").to_pylist()]):
                hashes, counts, whole = shingle_hashes(texts)
                ones = np.ones(SLOTS, np.int8)
                distinct = [d for d, _ in weighted_sets(hashes, counts, ones)]
                if distinct:
                    totals += np.bincount((np.concatenate(distinct) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([ids.slice(place, n).cast(pa.int64()), pa.array(whole.view(np.int64)), pa.array(counts.astype(np.int64)),
                                                  *[pa.nulls(n, k) for k in kinds[3:]]], names=names)
                place += n
        task = TaskContext.get().partitionId()
        filled = [p for p in range(SLOTS // PART) if totals[p * PART:(p + 1) * PART].any()]
        if filled:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(filled), k) for k in kinds[:3]], pa.array(filled, pa.int32()), pa.array(
                [task] * len(filled), pa.int64()), pa.array([packed(totals[p * PART:(p + 1) * PART]) for p in filled], pa.binary())], names=names)

    return stored(docs.mapInArrow(run, "id long, digest long, n long, part int, task long, counts binary"))


def packed(counts: np.ndarray) -> bytes:
    """Places and counts other than zero."""
    places = np.flatnonzero(counts)
    return places.astype(np.uint16).tobytes() + counts[places].astype(np.uint64).tobytes()


def unpacked(value: bytes) -> np.ndarray:
    n = len(value) // 10
    counts = np.zeros(PART, np.int64)
    counts[np.frombuffer(value, np.uint16, n)] = np.frombuffer(value[2 * n:], np.uint64)
    return counts


def slot_weights(slots: np.ndarray, documents: int) -> np.ndarray:
    """Augmented inverse document frequency of each slot: 0.5 + 0.5 min(1, ln((documents + 1) / (n + 1)) / ln(least + 2)).

    n is the slot's count less the mean count of a slot, which is what other shingles add to it; least is the number of
    documents, 1 / RARE at most. So the weights depend on shares of documents and stay as they are when the input grows.
    """
    n = np.clip(np.rint(slots - slots.sum() / len(slots)), 1, max(documents, 1))
    share = np.log((documents + 1) / (n + 1)) / np.log(min(documents, 1 / RARE) + 2)
    return (0.5 + 0.5 * np.clip(share, 0, 1)).astype(np.float32)


def inverse_frequencies(counted: DataFrame) -> np.ndarray:
    """Weight of each slot."""
    parts = counted.where(F.col("part").isNotNull()).select("part", "task", "counts")
    most = parts.agg(F.max("task")).first()[0] or 0

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum((unpacked(v) for v in group["counts"]), np.zeros(PART, np.int64))
        return pd.DataFrame({"part": group["part"].iloc[:1], "task": group["task"].iloc[:1], "counts": [packed(total)]})

    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("part", "task").applyInPandas(add, parts.schema)
        most //= FAN_IN
        if most == 0:
            break
    slots = np.zeros(SLOTS, np.int64)
    for row in parts.collect():  # SLOTS / PART rows at most
        slots[row["part"] * PART:(row["part"] + 1) * PART] = unpacked(row["counts"])
    documents = counted.where(F.col("digest").isNotNull()).count()
    return slot_weights(slots, documents)


@lru_cache(maxsize=1)
def sampling_tables() -> tuple[np.ndarray, ...]:
    """Gamma(2, 1) by its quantiles in 2 ** 16 steps, their logarithms, and one odd factor per sample."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(share)), np.full(len(share), 64.0)
    for _ in range(64):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    odd = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    return low.astype(np.float32), np.log(low).astype(np.float32), odd * np.uint64(2) + np.uint64(1)


def samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """ICWS of one set. The smallest value of each sample tells its shingle and quantised weight apart.

    A shingle's hash times the sample's odd factor gives 16 bits each for r ~ Gamma(2, 1), c ~ Gamma(2, 1)
    and beta ~ U(0, 1), so every shingle has numbers of its own in every sample.
    """
    gamma, log_gamma, odd = sampling_tables()
    least = np.full(len(odd), np.inf, np.float32)
    logs = np.log(weights).astype(np.float32)[:, None]
    product, (r, c, beta, t) = np.empty((SAMPLED, len(odd)), np.uint64), np.empty((4, SAMPLED, len(odd)), np.float32)
    for low in range(0, len(hashes), SAMPLED):
        n = min(SAMPLED, len(hashes) - low)
        np.multiply(hashes[low:low + n, None], odd, out=product[:n])
        bits = product[:n].view(np.uint16).reshape(n, len(odd), 4)
        gamma.take(bits[..., 3], out=r[:n], mode="clip")
        log_gamma.take(bits[..., 2], out=c[:n], mode="clip")
        np.multiply(bits[..., 1], np.float32(2 ** -16), out=beta[:n])
        now = np.divide(logs[low:low + n], r[:n], out=t[:n])
        now += beta[:n]
        np.floor(now, out=now)
        now -= beta[:n]
        now += 1
        now *= r[:n]
        np.minimum(least, np.subtract(c[:n], now, out=now).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, digest, weight, rarity, bands, drawn) of every document with shingles.

    rarity is the mean weight of a shingle, drawn has one byte of each sample. A task leaves out a document
    when it has met the same words under a smaller identifier.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("id").to_pylist()
            place = 0
            for texts in passes([t or "" for t in batch.column("text").to_pylist()]):
                hashes, counts, whole = shingle_hashes(texts)
                fresh = np.zeros(len(texts), bool)
                for i, words in enumerate(whole.tolist()):
                    fresh[i] = ids[place + i] < smallest.get(words, 1 << 63)
                    if fresh[i]:
                        smallest[words] = ids[place + i]
                if len(smallest) > REMEMBERED:
                    smallest.clear()
                found = [(i, samples(h, w), float(np.sum(w, dtype=np.float64))) for i, (h, w) in
                         enumerate(weighted_sets(hashes, counts, shared.value)) if len(h) and fresh[i]]
                rows = [i for i, _, _ in found]
                if rows:
                    values = np.stack([s for _, s, _ in found]).view(np.uint32).astype(np.uint64).reshape(-1, BANDS, ROWS)
                    drawn = (mixed(values) & np.uint64(0xFF)).astype(np.uint8).reshape(len(rows), -1)
                    bands = salt + np.zeros((len(rows), 1), np.uint64)
                    for k in range(ROWS):
                        bands = mixed(bands ^ values[:, :, k])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[place + i] for i in rows], pa.int64()), pa.array(whole[rows].view(np.int64)),
                        pa.array([w for _, _, w in found], pa.float64()),
                        pa.array([w / counts[i] for i, _, w in found], pa.float64()), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                        pa.array([d.tobytes() for d in drawn], pa.binary())], names=["id", "digest", "weight", "rarity", "bands", "drawn"])
                place += len(texts)

    return docs.mapInArrow(run, "id long, digest long, weight double, rarity double, bands array<long>, drawn binary")


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of sorted hashes with weights."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    common = np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64)
    return float(common / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - common))


def verified(pairs: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, linked) for pairs (a, b), by their whole texts; one row for each two texts of identifiers that have several."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    with_b = pairs.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {}

        def sets(texts: list[str]) -> None:
            for group in passes([t for t in dict.fromkeys(texts) if t not in last]):
                hashes, counts, _ = shingle_hashes(group)
                last.update(zip(group, weighted_sets(hashes, counts, shared.value)))

        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                left, right = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
                if len(last) > 256:
                    last.clear()
                sets(left + right)
                linked = [jaccard(last[x], last[y]) >= threshold for x, y in zip(left, right)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def repeated_keys(members: DataFrame, rows: int) -> DataFrame:
    """The members, about `rows`, whose key more than one member has."""
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return stored(members.join(shared, "key"), rows)


def unsettled(members: DataFrame, joined: DataFrame, rows: int) -> DataFrame:
    """Members, about `rows`, with their component, of those keys whose members lie in different components."""
    placed = members.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return stored(placed.join(keys, "key"), rows)


def tile_pairs(sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, first: np.ndarray, second: np.ndarray,
               component: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between the sets numbered `first` and `second` that lie in different components.

    A shingle that occurs n times in a text counts as n elements, so the common weight of two sets is a
    matrix product; what comes near the threshold is computed again exactly.
    """
    elements, owners, weights = [], [], []
    for i, (h, w) in enumerate(sets):
        own = idf[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
        times = np.rint(w / own).astype(np.int64)
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        elements.append(mixed(np.repeat(h, times) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        weights.append(np.repeat(own, times))
        owners.append(np.full(len(turn), i))
    values, column, times = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    weight, owner = np.concatenate(weights), np.concatenate(owners)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    column, weight, owner = number[column[use]], weight[use], owner[use]
    order = np.argsort(column, kind="stable")
    column, weight, owner = column[order], weight[order], owner[order]
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[first], place_b[second] = np.arange(len(first)), np.arange(len(second))
    common = np.zeros((len(first), len(second)))
    for low in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        left, right = np.zeros((len(first), COLUMNS), np.float32), np.zeros((len(second), COLUMNS), np.float32)
        a, b, at = place_a[owner[part]], place_b[owner[part]], column[part] - low
        left[a[a >= 0], at[a >= 0]] = weight[part][a >= 0]
        right[b[b >= 0], at[b >= 0]] = 1
        common += left @ right.T
    total = np.array([w.sum(dtype=np.float64) for _, w in sets])
    near = common >= (threshold - 0.001) / (1 + threshold) * (total[first][:, None] + total[second])
    near &= component[first][:, None] != component[second]
    i, j = np.nonzero(near)
    i, j = first[i], second[j]
    linked = np.array([x < y and jaccard(sets[x], sets[y]) >= threshold for x, y in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())], bool)
    return i[linked], j[linked]


def blocked(clusters: DataFrame, joined: DataFrame, facts: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of each cluster: (cluster, i, j, own, id, component, facts ...).

    A cluster of n members has n / block blocks, and each member is copied once for each of them.
    """
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumnRenamed("component", "cluster")
    placed = (clusters.select(F.col("component").alias("cluster"), F.col("node").alias("id")).join(sizes, "cluster")
              .join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
              .join(facts, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return placed.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component",
                         *[c for c in facts.columns if c != "id"])


def rooted(tile: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """The pairs of a tile as one link per row, to the smallest that the row reaches."""
    ids = tile["id"].to_numpy()
    root = roots(len(ids), i, j)
    return pd.DataFrame({"a": ids, "b": ids[root]})[root != np.arange(len(ids))]


def sides(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(tile["own"] == tile["i"].iloc[0]), np.flatnonzero(tile["own"] == tile["j"].iloc[0])


def likely_clusters(members: DataFrame, joined: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(node, component): members of different components, connected where their samples are alike often enough.

    Two texts of similarity 0.8 agree in 80 of 100 samples, give or take 4; 60 are asked for.
    """
    rows = members.count()
    least = members.groupBy("key").agg(F.min("id").alias("low"))
    clusters = components(members.join(least, "key").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")), rows=rows)
    n = BANDS * ROWS
    enough = n * (threshold - 0.2)

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id", kind="stable")
        first, second = sides(tile)
        drawn = np.frombuffer(b"".join(tile["drawn"]), np.uint8).reshape(len(tile), n)
        weight, component = tile["weight"].to_numpy(), tile["component"].to_numpy()
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(first), 128):
            some = first[low:low + 128]
            agree = np.zeros((len(some), len(second)), np.uint8)
            for k in range(n):
                agree += drawn[some, k, None] == drawn[second, k]
            near = (agree >= enough) & (component[some][:, None] != component[second])
            near &= np.minimum(weight[some][:, None], weight[second]) >= np.maximum(weight[some][:, None], weight[second]) * (threshold - 1e-6)
            i, j = np.nonzero(near)
            found_i.append(some[i])
            found_j.append(second[j])
        return rooted(tile, np.concatenate(found_i), np.concatenate(found_j))

    tiles = blocked(clusters, joined, signed.select("id", "weight", "drawn"), SAMPLE_BLOCK)
    return components(tiles.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long"), rows=rows)


def cluster_links(clusters: DataFrame, joined: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) between members of different components of a cluster, by their whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id", kind="stable")
        sets = []
        for texts in passes(tile["text"].tolist()):
            hashes, counts, _ = shingle_hashes(texts)
            sets += list(weighted_sets(hashes, counts, shared.value))
        return rooted(tile, *tile_pairs(sets, shared.value, *sides(tile), tile["component"].to_numpy(), threshold))

    return blocked(clusters, joined, docs, BLOCK).groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def candidate_links(signed: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Components (node, component) of the links."""
    close = F.least("weight", "weight_a") >= F.greatest("weight", "weight_a") * (threshold - 1e-6)
    members = repeated_keys(signed.select(F.explode("bands").alias("key"), "id", "weight", "rarity"), BANDS * signed.count())
    rows = members.count()
    # Only texts that share a bucket are read again.
    docs = stored(docs.join(members.select("id").distinct(), "id", "left_semi"))
    # A text of frequent shingles lies in the middle of a group, so it is the one to compare the others with.
    middle = F.min(F.struct("rarity", F.col("id").alias("id_a"), F.col("weight").alias("weight_a"))).alias("middle")
    heads = members.groupBy("key").agg(middle).select("key", "middle.id_a", "middle.weight_a")
    pairs = members.join(heads, "key").where("id <> id_a").where(close)
    pairs = stored(pairs.select(F.least("id", "id_a").alias("a"), F.greatest("id", "id_a").alias("b")).distinct(), rows)
    joined = components(verified(pairs, docs, idf, threshold).where("linked"), rows=pairs.count())
    # What lies in one bucket and not in one component may still be linked to others than the middle.
    clusters = likely_clusters(unsettled(members, joined, rows), joined, signed, threshold)
    links = cluster_links(clusters, joined, docs, idf, threshold)
    return components(links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), rows=rows)


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(id, component) of every distinct identifier that is not the first of its component."""
    docs = df.select(col(id_col).cast("long").alias("id"), col(text).alias("text"))
    counted = document_counts(docs)
    idf = inverse_frequencies(counted)
    rows = counted.where(F.col("n") > 0).select("id", "digest").where(F.col("id").isNotNull())
    classes = stored(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    first = classes.select("digest", F.col("first").alias("id"))
    signed = stored(signatures(docs.where(F.col("id").isNotNull()), idf).join(first, ["digest", "id"], "left_semi"))
    joined = candidate_links(signed, docs.where(F.col("id").isNotNull()), idf, threshold)
    roots = classes.join(joined.withColumnRenamed("node", "first"), "first", "left").select(
        "digest", F.coalesce("component", "first").alias("component"))
    return rows.join(roots, "digest").where("id <> component").groupBy("id").agg(F.min("component").alias("component"))


def minhash_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """All rows with component_id and kept (the row is its component's first)."""
    df = without(df, *OUTPUT)
    found = near_duplicates(df, text, id_col, threshold)
    p = "_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    found = found.select(F.col("id").alias(p + "id"), F.col("component").alias(p + "component"))
    rows = df.join(found, col(id_col) == F.col(p + "id"), "left")
    component = F.coalesce(F.col(p + "component"), col(id_col))
    return rows.select(*[col(c) for c in df.columns], component.alias("component_id"), F.col(p + "component").isNull().alias("kept"))


def drop_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """One document of each component, with the columns of the input; rows without identifier stay."""
    gone = near_duplicates(df, text, id_col, threshold).select(F.col("id").alias("_gone"))
    others = [c for c in df.columns if c not in (id_col, text) and "map<" not in df.schema[c].dataType.simpleString()]
    order = F.xxhash64(F.lit(0), *[col(c) for c in others])
    packed = df.select(F.struct("*").alias("row"), col(id_col).alias("id"), col(text).alias("text"), order.alias("order"))
    stay = packed.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    one = stay.where(F.col("id").isNotNull()).groupBy("id", "text").agg(F.min_by("row", "order").alias("row"))
    return one.select("row").unionByName(stay.where(F.col("id").isNull()).select("row")).select("row.*")
