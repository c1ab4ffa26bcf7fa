"""SimHash near-duplicates: BK-trees over pigeonhole shards of the distinct fingerprints."""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest, xxh64_intdigest

from graphspark.llm.common import Forest, cut, in_worker, sorted_groups
from graphspark.llm.components import connected_components

#: Shingles whose bits are counted at a time, so that a very long text needs bounded memory.
_BLOCK = 1 << 16
#: Spread fingerprints that a shard may hold on average before keys take more bits.
SHARD_GOAL = 256
#: Parts of a text's shingles in ``minhashes``, and deviations below a similarity at which an estimate gives up.
BINS, DOUBT = 128, 3.5


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``width`` words
    joined by a space, repeats included; fewer words make one shingle of them all. A bit is 1 if
    more than half of the shingles' XXH64 hashes set it. Null, empty and blank texts give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        n = len(words) - width + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, count=n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _BLOCK):
        part = hashes[lo : lo + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long): the SimHash of every text, as a signed 64-bit integer.

    Null and empty texts have 0; null ids and repeated rows stay, other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, width, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))}
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(in_worker("simhash", run), "doc_id long, fp long")


class BKTree:
    """A Burkhard-Keller tree of 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while True:
            d = (value ^ self.values[at]).bit_count()
            if d == 0:
                return
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """Stored values at most ``radius`` bits away, following only edges that can lead to one."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(self.values[at])
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                stack.extend(i for e, i in kids.items() if d - radius <= e <= d + radius)
            else:
                stack.extend(kids[e] for e in range(max(1, d - radius), d + radius + 1) if e in kids)
        return found


def _masks(count: int, radius: int) -> list[int]:
    """The bits that make a shard's key, one mask a way to choose them.

    Of ``radius + agree`` blocks two fingerprints within ``radius`` bits share ``agree``; every choice
    of so many is a key. As many are taken as keep shards of ``count`` spread fingerprints small.
    """
    for agree in range(1, 5):
        cuts = np.linspace(0, 64, radius + agree + 1).astype(int).tolist()
        if count <= SHARD_GOAL << 64 * agree // (radius + agree):
            break
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts[:-1], cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def _cells(nodes: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """Route every distinct fingerprint to the shards it has to be compared in.

    A shard is the value of some bits, as ``_masks`` chooses them; one with more than ``shard_rows``
    members is dealt into parts, and its members meet in one cell for each pair of parts.
    """
    signed = [int(np.array([m], np.uint64).view(np.int64)[0]) for m in _masks(nodes.count(), radius)]
    keys = [F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)]
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("node", "fp", "k.band", "k.value")
    large = (
        rows.groupBy("band", "value")
        .count()
        .where(F.col("count") > shard_rows)
        .select("band", "value", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    )
    rows = rows.join(large, ["band", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other)
    return rows.select(
        F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("int").alias("side"),
        (F.col("own") == F.col("other")).alias("same"),
        "node",
        "fp",
    )


def links(nodes: DataFrame, radius: int = 3, shard_rows: int = 2048) -> DataFrame:
    """Spanning links (a long, b long) between the ids of fingerprints within ``radius`` bits.

    ``nodes`` is (node long, fp long) with distinct fingerprints. In each cell a BK-tree holds one
    part of the shard and is sent to where the other part probes it. Of the links of a cell only a
    spanning forest is returned, so a dense group of near copies gives rows in proportion to its
    members; which nodes are connected stays exact.
    """
    if not 0 <= radius <= 15:
        raise ValueError("radius must lie between 0 and 15")

    def run(batches):
        out_a: list[int] = []
        out_b: list[int] = []
        for _, table in sorted_groups(batches, "cell"):
            if table.num_rows < 2:
                continue
            node = table.column("node").to_pylist()
            fp = (table.column("fp").to_numpy().astype(np.int64)).view(np.uint64).tolist()
            side = table.column("side").to_pylist()
            same = table.column("same").to_pylist()
            ids = dict(zip(fp, node))
            tree, forest = BKTree(), Forest()
            if all(same):
                for f, n in zip(fp, node):
                    for hit in tree.within(f, radius):
                        forest.join(n, ids[hit])
                    tree.add(f)
            else:
                for f, s in zip(fp, side):
                    if s == 0:
                        tree.add(f)
                for f, n, s in zip(fp, node, side):
                    if s == 1:
                        for hit in tree.within(f, radius):
                            forest.join(n, ids[hit])
            a, b = forest.edges()
            out_a += a
            out_b += b
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
                out_a, out_b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    cells = _cells(nodes, radius, shard_rows)
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, shard_rows: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints at most ``radius`` bits
    apart. Rows with a null text count as empty (fingerprint 0); rows with a null doc_id are
    returned with the component of their fingerprint, but never name one unless every row of it
    has a null id (then it is null). Repeated rows are returned as often as they come. An empty
    table gives no rows. Other columns of ``docs`` are ignored.

    Copies meet first: links are looked for between distinct fingerprints only.
    """
    fps = cut(fingerprints(docs, width, seed))
    nodes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    parts = connected_components(links(nodes, radius, shard_rows))
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def sketch(text: bytes | None, width: int = 2) -> bytes:
    """A 128-bit SimHash, as 16 bytes, of the distinct ``width``-word shingles hashed by XXH3; blank texts give 0."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(16)
    width = min(width, len(words))
    hashes = list(set(map(xxh3_128_digest, map(b" ".join, zip(*(words[i:] for i in range(width)))))))
    ones = np.zeros(128, np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        part = np.frombuffer(b"".join(hashes[lo : lo + _BLOCK]), np.uint8).reshape(-1, 16)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def minhashes(text: bytes | None, width: int = 5) -> tuple[bytes, int]:
    """One byte of the smallest hash in each of BINS parts of a text's shingles, and how many parts have one.

    An empty part takes the next one's, changed by the distance, so that two texts agree in a part
    with the chance of their shingle sets' Jaccard index (and 1 in 256).
    """
    words = (text or b"").lower().split()
    width = min(width, max(1, len(words)))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if words else [b""]
    hashes = np.unique(np.fromiter(map(xxh3_64_intdigest, shingles), np.uint64))
    part, first = np.unique(hashes % BINS, return_index=True)
    small = hashes[first]  # sorted, so the first of a part is its smallest
    every = np.arange(BINS, dtype=np.uint64)
    at = np.searchsorted(part, every)
    far = np.where(at < len(part), part[at % len(part)] - every, part[0] + np.uint64(BINS) - every)
    value = (small[at % len(part)] + far) * np.uint64(0x9E3779B97F4A7C15)
    return (value >> np.uint64(56)).astype(np.uint8).tobytes(), len(part)


def _shingle_set(text: str | None, width: int) -> set:
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(width))))


def shingle_similarity(a: str | None, b: str | None, width: int = 5) -> float:
    """The Jaccard index of two texts' sets of ``width``-word shingles (a shorter text is one)."""
    p, q = _shingle_set(a, width), _shingle_set(b, width)
    return len(p & q) / len(p | q)


def _from_the_middle(group: pa.Table) -> list[int]:
    """The rows of a shard, those nearest to its majority sketch first: the best of leaders."""
    n = group.num_rows
    if n < 4:
        return list(range(n))
    bits = np.stack([group.column(c).to_numpy() for c in ("f0", "f1")], 1).view(np.uint64)
    ones = np.zeros(128, np.int64)
    for lo in range(0, n, _BLOCK):
        ones += np.unpackbits(bits[lo : lo + _BLOCK].view(np.uint8), axis=1).sum(0, dtype=np.int64)
    middle = np.packbits(2 * ones > n).view(np.uint64)
    return np.argsort(np.bitwise_count(bits ^ middle[None, :]).sum(1), kind="stable").tolist()


def _tables(count: int, differ: float, miss: float) -> tuple[int, int]:
    """(bits, tables): samples of so many bits, about one to a bucket, that miss few similar pairs."""
    bits = min(48, max(12, count.bit_length()))
    hit = (1 - differ) ** bits
    return bits, max(1, int(np.ceil(np.log(miss) / np.log(1 - hit))))


def _text_keys() -> list[Column]:
    return [F.xxhash64(F.lit(i), F.col("text")).alias(f"key{i}") for i in (1, 2)]


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, **search) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: near-duplicates at a shingle similarity.

    ``component_id`` is the smallest doc_id of the row's group. A row with a null id is its own
    component, null; null texts count as empty; repeated rows stay, and no rows give none. See
    ``_marked`` for the search and its parameters.
    """
    return _marked(docs, width, similarity, **search).select("doc_id", "component_id")


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, **search) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, and the rows without an id.

    The row with the smallest doc_id stays, of several with that id (in the same group) the one
    with the smallest text hash, and of rows equal in both the one whose other columns come first
    as JSON. Texts decide, not ids: different texts that share an id are different documents. No
    rows give none; other columns may have any names.
    """
    kept = _marked(docs, width, similarity, **search).where("kept").select("doc_id", "key1", "key2").distinct()
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct("*").alias("row"), F.to_json(F.struct(*rest)).alias("order"), F.col("doc_id").cast("long").alias("doc_id"), *_text_keys()
    )
    place = Window.partitionBy("doc_id", "key1", "key2").orderBy("order")
    found = rows.join(kept, ["doc_id", "key1", "key2"], "left_semi").withColumn("n", F.row_number().over(place)).where("n = 1")
    return found.select("row.*").unionByName(docs.where("doc_id is null"))


def _shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of ``_shingle_set``."""
    words = (text or b"").lower().split()
    width = min(width, len(words)) or 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if words else [b""]
    return np.unique(np.fromiter(map(xxh3_64_intdigest, shingles), np.uint64))


def _links_of(p: list[int], q: list[int], part: list[int], texts: pa.ChunkedArray, width: int, similarity: float) -> list[tuple[int, int]]:
    """Those of the pairs (p, q) that are similar and not connected already, by their parts or by earlier ones."""
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            text = texts[i].as_py()
            sets[i] = _shingle_hashes(None if text is None else text.encode(), width)
        return sets[i]

    forest, out = Forest(), []
    for i, j in zip(p, q):
        if forest.find(part[i]) == forest.find(part[j]):
            continue
        a, b = shingles(i), shingles(j)
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            continue
        both = len(np.intersect1d(a, b, assume_unique=True))
        if both / (len(a) + len(b) - both) >= similarity:
            forest.join(part[i], part[j])
            out.append((i, j))
    return out


def _marked(
    docs: DataFrame,
    width: int,
    similarity: float,
    radius: int = 26,
    differ: float = 0.1,
    miss: float = 0.005,
    shard_rows: int = 65536,
    shard_chars: int = 1 << 27,
) -> DataFrame:
    """(doc_id, key1, key2, component_id, kept) for every row of ``docs``.

    Two documents link if the Jaccard index of their sets of ``width``-word shingles is at least
    ``similarity``. Candidates come from 128-bit SimHashes of word pairs, of which similar texts
    share all but a tenth of the bits (``differ``) or fewer: tables of sampled bits, sized so that
    a table's bucket holds about one unrelated text and all tables together miss a pair with a
    chance of about ``miss``, are the shards. In each a BK-tree of leaders, those in the middle of the
    shard first, takes what lies within ``radius`` bits of one as that leader's candidate, and the
    rest as leaders, so a group gives rows in proportion to its members. A bucket of more than ``shard_rows`` members or
    ``shard_chars`` of text is dealt into parts, any two of which meet. Candidates are then compared
    exactly. Whoever candidates connect is a family. Where its members are in
    several components after that, they come together once, and all its pairs of different components
    within ``radius`` are compared, by MinHashes of their shingles first; those that may be similar (an
    estimate no more than DOUBT deviations below) by the shingles' hashes, the likeliest first and none
    that others connect. So of followers a pair in thousands is lost, and a family gives no more links
    than members. Texts of the same words are one class, a node of the graph.
    ``kept`` marks the row of each component that has the smallest id, of several the smallest text
    hash (``key1``, ``key2``); rows equal in both are marked alike.
    """
    texts_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(), "text")
    source = texts_of.withColumn("size", F.coalesce(F.length("text"), F.lit(0))).withColumn("text", F.col("text").cast("binary"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            data = np.frombuffer(b"".join(sketch(t) for t in texts), ">i8").reshape(-1, 2)
            f0, f1 = (pa.array(data[:, i].astype(np.int64)) for i in (0, 1))
            same = pa.array([xxh3_128_digest(b" ".join((t or b"").lower().split())) for t in texts], pa.binary())
            small, filled = zip(*(minhashes(t, width) for t in texts)) if texts else ((), ())
            names = ["doc_id", "key1", "key2", "size"]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, f0, f1, same, pa.array(small, pa.binary()), pa.array(filled, pa.int32())], [*names, "f0", "f1", "same", "small", "filled"]
            )

    fps = cut(source.mapInArrow(in_worker("simhash", run), "doc_id long, key1 long, key2 long, size int, f0 long, f1 long, same binary, small binary, filled int"))
    whose = F.struct("doc_id", "key1", "key2")
    nodes = fps.where("doc_id is not null").groupBy("same", "f0", "f1").agg(F.min(whose).alias("first"), F.min("small").alias("small"), F.min("filled").alias("filled"), F.max("size").alias("size"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    bits, tables = _tables(nodes.count(), differ, miss)
    rng = np.random.default_rng(17)
    masks = np.zeros((tables, 2), np.uint64)
    for t in range(tables):
        for b in rng.choice(128, bits, replace=False):
            masks[t, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    signed = masks.view(np.int64).tolist()
    keys = [F.xxhash64(F.lit(t), F.col("f0").bitwiseAND(F.lit(m[0])), F.col("f1").bitwiseAND(F.lit(m[1]))) for t, m in enumerate(signed)]
    def dealt(rows: DataFrame, group: str, whole: DataFrame) -> DataFrame:
        """``rows`` with ``own`` and ``other``: a group over the limits goes into parts, and any two of them meet."""
        many = F.greatest(F.ceil(F.col("n") / shard_rows), F.ceil(F.col("chars") / shard_chars), F.lit(1))
        parted = rows.join(whole.select(group, F.least("n", many).cast("int").alias("parts")), group)
        parted = parted.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int"))
        return parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    place = F.struct(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    routed = nodes.select("node", "f0", "f1", "size", F.explode(F.array(*keys)).alias("key"))
    shared = routed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).where("n > 1")
    # A part alone meets itself in its own cell; in one of two parts it meets itself again, which is no harm.
    cells = dealt(routed, "key", shared).where("parts = 1 or own <> other").select(F.xxhash64("key", place).alias("cell"), "node", "f0", "f1")

    cells = cut(cells)

    def members(group):
        low = (1 << 64) - 1
        return [(a & low) << 64 | (b & low) for a, b in zip(group.column("f0").to_pylist(), group.column("f1").to_pylist())]

    def lead(batches):
        def pairs():
            for _, group in sorted_groups(batches, "cell"):
                leaders, owner = BKTree(), {}  # equal sketches: the first one leads
                ids, values = group.column("node").to_pylist(), members(group)
                for i in _from_the_middle(group):
                    hits = leaders.within(values[i], radius)
                    yield from ((ids[i], owner[h]) for h in hits)
                    if not hits:
                        leaders.add(values[i])
                        owner[values[i]] = ids[i]

        found = pairs()
        while block := list(islice(found, 50_000)):
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(("a", "b"), zip(*block))})

    def others(batches):
        for _, group in sorted_groups(batches, "cell"):
            part, own = (group.column(c).to_numpy() for c in ("part", "own"))
            _, code, size = np.unique(part, return_inverse=True, return_counts=True)
            # The largest component asks no one: each pair comes from its smaller side.
            rank = np.argsort(np.argsort(-size, kind="stable"), kind="stable")[code]
            apart = own.min() != own.max()
            filled = group.column("filled").to_numpy()
            bits = np.stack([group.column(c).to_numpy() for c in ("f0", "f1")], 1).view(np.uint64)
            small = np.frombuffer(b"".join(group.column("small").to_pylist()), np.uint8).reshape(-1, BINS)
            asking = np.flatnonzero(rank > 0)
            step = max(1, (1 << 19) // len(part))
            found = []
            for lo in range(0, len(asking), step):
                mine = asking[lo : lo + step]
                near = np.bitwise_count(bits[mine, None, 0] ^ bits[None, :, 0]) + np.bitwise_count(bits[mine, None, 1] ^ bits[None, :, 1]) <= radius
                near &= rank[None, :] < rank[mine][:, None]
                if apart:
                    near &= own[None, :] != own[mine][:, None]
                i, j = np.nonzero(near)
                for at in range(0, len(i), 1 << 15):
                    p, q = mine[i[at : at + (1 << 15)]], j[at : at + (1 << 15)]
                    alike = (small[p] == small[q]).mean(1)
                    keep = alike >= similarity - DOUBT * np.sqrt(similarity * (1 - similarity) / np.minimum(filled[p], filled[q]))
                    found.append((p[keep].astype(np.int32), q[keep].astype(np.int32), alike[keep].astype(np.float32)))
            if found:
                p, q, alike = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(-alike, kind="stable")
                linked = _links_of(p[order].tolist(), q[order].tolist(), part.tolist(), group.column("text"), width, similarity)
                a, b = zip(*linked) if linked else ((), ())
                node = group.column("node")
                yield pa.RecordBatch.from_arrays([pa.array([node[i].as_py() for i in x], pa.int64()) for x in (a, b)], ["a", "b"])

    def verify(batches):
        for batch in batches:
            alike = [
                shingle_similarity(p, q, width) >= similarity
                for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    def compared(candidates: DataFrame) -> DataFrame:
        named = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
        asked = nodes.join(named, "node").select("node", "first.*")
        texts = cut(texts_of.join(asked, ["doc_id", "key1", "key2"]).groupBy("node").agg(F.first("text").alias("text")))
        pairs = candidates.join(texts.select(F.col("node").alias("a"), F.col("text").alias("p")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("q")), "b"
        )
        return cut(pairs.select("a", "b", "p", "q").mapInArrow(verify, "a long, b long"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    first = cut(ordered(cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(in_worker("simhash", lead), "a long, b long")))
    linked = compared(first)
    # A family: whoever is connected by candidates, similar or not. Its members come together once.
    family = connected_components(first).withColumnRenamed("component", "family")
    named = cut(family.join(connected_components(linked), "node", "left").select("family", "node", F.coalesce("component", "node").alias("part")))
    mixed = named.groupBy("family").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("family")
    told = nodes.select("node", "first.*", "f0", "f1", "small", "filled", "size").join(named.join(mixed, "family", "left_semi"), "node")
    told = cut(told.select("family", "node", "part", "size", "doc_id", "key1", "key2", "f0", "f1", "small", "filled"))
    whole = told.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    texts = texts_of.join(told.select("doc_id", "key1", "key2"), ["doc_id", "key1", "key2"], "left_semi").groupBy("doc_id", "key1", "key2").agg(F.first("text").alias("text"))
    held = dealt(told, "family", whole).join(texts, ["doc_id", "key1", "key2"])
    held = held.select(F.xxhash64("family", place).alias("cell"), "node", "own", "part", "f0", "f1", "small", "filled", "text")
    second = held.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(in_worker("simhash", others), "a long, b long")
    parts = connected_components(linked.union(cut(second)))
    labels = nodes.join(parts, "node", "left").select("same", "first", F.coalesce("component", "node").alias("component"))
    firsts = labels.groupBy("component").agg(F.min("first").alias("leader"))
    labels = labels.join(firsts, "component").select("same", "leader")
    out = fps.join(labels, "same", "left")
    named = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "key1", "key2", F.when(named, F.col("leader.doc_id")).alias("component_id"), (named & (whose == F.col("leader"))).alias("kept")
    )
