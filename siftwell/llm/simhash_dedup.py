"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is cut into two 32-bit halves. Of two fingerprints at most ``radius`` (3) bits apart, one half
differs by at most half the radius, rounded down (1). So every fingerprint emits, for each half, the variants of
that half within half the radius; close fingerprints meet at an equal (half, variant), where they are verified on
all 64 bits. Distance 1 always joins an even half with an odd one, so only even halves need to emit their
32 neighbours and odd halves just themselves: 34 rows a fingerprint instead of 66, and nothing is lost.

Meeting points never expand into all pairs. A point with at most ``group_bound`` fingerprints is resolved in one
task into a star per local component. A larger one (a swarm of near copies) is handed to the full 64-bit ball, in which
fingerprints within 1 (A) and within 2 (B) of a variant meet: A and B are at most 3 apart, so all link to the least of A,
and geometry bounds such a group to 2,081. Stars are merged by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import discard, drop_caches, release_shuffles, small_batches, stage

RADIUS = 3
SHINGLE = 3
GROUP_BOUND = 4096
#: A node of more edges than HUB (and than 2 in HUBS of all) has its label broadcast.
HUB = 256
HUBS = 200_000
#: Shared keys (one long each) are broadcast up to so many; beyond, the join shuffles by key.
BROADCAST_KEYS = 500_000


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: A-Z lower-cased, word shingles with repeats, XXH64 seed 42."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp long) for every row; a null, empty or blank text has fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        drop_caches()
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[id_col, "fp"])

    picked = docs.select(id_col, F.col(text_col).cast("binary").alias("text"))
    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _half_variants(fps: DataFrame, radius: int) -> DataFrame:
    def side(n: int):
        half = F.shiftrightunsigned("fp", 32) if n else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        own = F.array(half.bitwiseOR(F.lit(n << 32)))
        if radius < 2:
            return own
        near = F.transform(F.array(*[F.lit(1 << i) for i in range(32)]), lambda b: half.bitwiseXOR(b).bitwiseOR(F.lit(n << 32)))
        return F.when(F.bit_count(half) % 2 == 0, F.concat(own, near)).otherwise(own)

    return fps.select("fp", F.explode(F.concat(side(0), side(1))).alias("key"))


def local_stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, least member) for each component of more than one in one meeting group."""
    left, out = np.unique(fps), []
    while len(left) > 1:
        root, frontier, rest = left[0], left[:1], left[1:]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), bool)
            for f in frontier:
                near |= np.bitwise_count(rest ^ f) <= radius
            frontier, rest = rest[near], rest[~near]
            out += [(int(f), int(root)) for f in frontier]
        left = rest
    return out


def _group_edges(keyed: DataFrame, radius: int) -> DataFrame:
    """Stars of bounded groups; keyed has (key, fp) sorted by key within each partition."""

    def run(batches):
        key, held = None, []

        def close(parts):
            return local_stars(np.concatenate(parts).view(np.uint64), radius)

        for b in batches:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            edges = []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if held and keys[lo] != key:
                    edges += close(held)
                    held = []
                key = keys[lo]
                held.append(fps[lo:hi])
            yield _edge_batch(np.array(edges, np.uint64).view(np.int64))
        if held:
            yield _edge_batch(np.array(close(held), np.uint64).view(np.int64))

    return keyed.mapInArrow(run, "a long, b long")


def _edge_batch(edges: np.ndarray) -> pa.RecordBatch:
    x = edges.reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["a", "b"])


def _ball_edges(fps: DataFrame, radius: int) -> DataFrame:
    """Exact links at most radius bits apart, with no group beyond the size of a ball of radius 2.

    Variants carry how far they are from their fingerprint. At radius 3 one of a pair 3 apart has odd parity, so only
    odd fingerprints emit the variants at distance 2.
    """
    root_far = radius // 2
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    none = F.array(F.struct(F.col("fp").alias("key"), F.lit(0).alias("far")))
    ball = none
    if radius:
        one = F.transform(bits, lambda b: F.struct(F.col("fp").bitwiseXOR(b).alias("key"), F.lit(1).alias("far")))
        ball = F.concat(none, one)
    if radius == 3:
        two = F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(62)),
                lambda i: F.transform(
                    F.slice(bits, i + 2, 64),
                    lambda b: F.struct(F.col("fp").bitwiseXOR(b).bitwiseXOR(F.element_at(bits, i + 1)).alias("key"), F.lit(2).alias("far")),
                ),
            )
        )
        ball = F.when(F.bit_count("fp") % 2 == 1, F.concat(none, one, two)).otherwise(F.concat(none, one))
    met = fps.select("fp", F.explode(ball).alias("v")).select("v.key", "v.far", "fp")
    met = met.repartition("key").sortWithinPartitions("key", "far", "fp")

    def run(batches):
        key, root = None, None
        for b in batches:
            edges = []
            for k, far, f in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != key:
                    key, root = k, f if far <= root_far else None
                elif root is not None and f != root:
                    edges.append((f, root))
            yield _edge_batch(np.array(edges, np.int64))

    return met.mapInArrow(run, "a long, b long")


def connected(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(a, b): every node of the edges but the least of its component, with that least node. Nodes are longs.

    Labels of hubs (nodes with so many edges that only HUBS of them can exist) are broadcast, so the rows of a hub stay where they
    are; its own minimum is aggregated by task before the shuffle. Each half of a round is written before the next reads it: as one
    plan they would repeat each other's steps, and the driver holds such a plan many times over. What a round shuffled or wrote goes
    after it, from disk and from the driver.
    """

    def labelled(e: DataFrame, low: DataFrame, hub: int) -> DataFrame:
        hubs = low.where(F.col("n") > hub).select(F.col("a").alias("hub"), F.col("m").alias("hub_m"))  # at most 2 * HUBS + 1 rows
        if not hubs.limit(1).count():
            return e.join(low.select("a", "m"), "a").select("a", "b", "m")
        tried = e.join(F.broadcast(hubs), e["a"] == F.col("hub"), "left")
        rest = tried.where("hub IS NULL").select("a", "b").join(low.where(F.col("n") <= hub).select("a", "m"), "a")
        return tried.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")).unionByName(rest)

    def large(e: DataFrame, hub: int) -> DataFrame:
        back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = stage(e.union(back).groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), f"{label}-low")
        grown = stage(labelled(back, low, hub).select(F.col("b").alias("a"), F.col("m").alias("b")), f"{label}-large")
        discard(low)
        return grown

    def small(e: DataFrame, hub: int) -> DataFrame:
        low = stage(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), f"{label}-low")
        more = labelled(e, low, hub).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        shrunk = stage(more.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), label)
        discard(low)
        return shrunk

    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen, size = None, now.count()
    while True:
        hub = max(HUB, 2 * size // HUBS)
        grown = large(now, hub)
        discard(now)
        now = small(grown, hub)
        discard(grown)
        release_shuffles(now.sparkSession)
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen:
            return now
        seen, size = mark, mark[0]


def components(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, group_bound: int = GROUP_BOUND) -> DataFrame:
    """(fp, component_id) for every distinct fp of prints (id_col, fp): the least id in its component.

    radius is 0 to 3. Null ids take no part in the least; a component of null ids alone has a null component_id.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    nodes = stage(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "fingerprints")
    keyed = _half_variants(nodes.select("fp"), radius)
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "meetings")
    near = keyed.join(shared.where(F.col("n") <= group_bound), "key").select("key", "fp")
    edges = _group_edges(near.repartition("key").sortWithinPartitions("key"), radius)
    if shared.where(F.col("n") > group_bound).limit(1).count():
        swarm = keyed.join(shared.where(F.col("n") > group_bound), "key", "left_semi").select("fp").distinct()
        edges = edges.union(_ball_edges(stage(swarm, "swarm"), radius))
    stars = connected(edges)
    rooted = nodes.join(stars.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("b", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id for every row of docs.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows give repeated rows.
    Rows with a null id keep it and take the component of their fingerprint. Other columns are ignored.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = components(prints, id_col, radius)
    return prints.join(classes, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- copies that are looser than one fingerprint's radius reaches

#: 64-bit words of a wide fingerprint, those of them whose halves are searched by ball hashing, and the radius in a half.
WORDS = 8
SEARCHED = 5
HALF_RADIUS = 2
#: Wide fingerprints of texts with a 5-word Jaccard similarity of 0.8 differ in about 60 of 512 bits.
WIDE_LIMIT = 64


def wide_fingerprint(data: bytes | None, shingle: int = SHINGLE, words: int = WORDS) -> np.ndarray:
    """Independent 64-bit SimHashes of one text, over remixed shingle hashes; zeros for a text without words."""
    said = (data or b"").lower().split()
    if not said:
        return np.zeros(words, np.uint64)
    grams = [b" ".join(said)] if len(said) <= shingle else map(b" ".join, zip(*(said[i:] for i in range(shingle))))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64)
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        for t in range(words):
            z = part + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64)
            if t:  # a bijection of 64 bits that keeps nothing of the words before
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(31)
            ones[t] += np.unpackbits(z.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8").ravel()


def _verified(x: np.ndarray, y: np.ndarray, word: int, limit: int) -> np.ndarray:
    """Which rows of x and y (wide fingerprints; y may be one) that meet by a half of this word link."""
    apart = np.bitwise_count(x ^ y)
    near = apart.sum(axis=1, dtype=np.int64) <= limit
    return near | (apart[:, 0] <= RADIUS) if word == 0 else near


def _met_first(x: np.ndarray, y: np.ndarray, word: int, side: int, key: np.ndarray | int, limit: int) -> np.ndarray:
    """Which of the linking rows of x and y (y may be one) meet at key for the first time, in the order of words, halves and keys.

    Two halves at most 2 apart share every variant (equal ones), their own values (1 apart) or the two between them; the least is the
    first. A link is only given where it is met first, as the group there joins the two in any case.
    """
    low = np.uint64(0xFFFFFFFF)
    before = (x ^ y)[:, :word]
    later = ((np.bitwise_count(before & low) <= HALF_RADIUS) | (np.bitwise_count(before >> np.uint64(32)) <= HALF_RADIUS)).any(axis=1)
    u, v = (z[..., word] >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF) for z in (x, y))
    if side:
        later |= np.bitwise_count((x[..., word] ^ y[..., word]) & low) <= HALF_RADIUS
    apart = u ^ v
    one = apart & (~apart + np.uint64(1))
    between = np.minimum(u ^ one, u ^ (apart ^ one))
    top = u.copy()
    for k in (1, 2, 4, 8, 16):
        top |= top >> np.uint64(k)
    first = np.where(apart == 0, u ^ (top ^ (top >> np.uint64(1))), np.where(apart == one, np.minimum(u, v), between))
    return ~later & (first == key)


def near_links(fps: np.ndarray, nodes: np.ndarray, word: int, side: int, key: int, limit: int) -> list[tuple[int, int]]:
    """(node, neighbour that links by this word and meets here first), of a spanning forest of one meeting group."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        frontier, rest = left[:1], left[1:]
        while len(frontier) and len(rest):
            grown = []
            for f in frontier:
                near = _verified(fps[rest], fps[f], word, limit)
                new = rest[near]
                if len(new):
                    out += [(int(nodes[i]), int(nodes[f])) for i in new[_met_first(fps[new], fps[f], word, side, np.uint64(key), limit)]]
                grown.append(new)
                rest = rest[~near]
                if not len(rest):
                    break
            frontier = np.concatenate(grown)
        left = rest
    return out


#: Groups of at most so many that lie within an Arrow batch are compared pair by pair, all at once.
SMALL_GROUP = 8


def _word_links(keyed: DataFrame, word: int, side: int, limit: int) -> DataFrame:
    """(a, b): verified links of bounded groups; keyed has (group, key, node, fps) sorted by group within each partition."""

    def run(batches):
        drop_caches()
        held: list[tuple] = []
        at_group = at_key = None

        def close() -> list[tuple[int, int]]:
            return near_links(*(np.concatenate(x) for x in zip(*held)), word, side, at_key, limit) if held else []

        for b in batches:
            if not b.num_rows:
                continue
            groups, keys, nodes = (b.column(i).to_numpy() for i in range(3))
            keys = keys.astype(np.uint64)
            fps = b.column(3).flatten().to_numpy().view(np.uint64).reshape(len(keys), -1)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(keys)]])
            small = np.diff(cuts) <= SMALL_GROUP
            small[0] = small[-1] = False  # these may go on in another batch
            inner = np.repeat(small, np.diff(cuts))
            pairs = [np.zeros((0, 2), np.int64)]
            for d in range(1, min(SMALL_GROUP, len(keys))):
                at = np.flatnonzero(inner[:-d] & (groups[:-d] == groups[d:]))
                at = at[_verified(fps[at], fps[at + d], word, limit)]
                at = at[_met_first(fps[at], fps[at + d], word, side, keys[at], limit)]
                pairs.append(np.stack([nodes[at], nodes[at + d]], axis=1))
            edges: list[tuple[int, int]] = []
            for x, y in zip(cuts[:-1][~small].tolist(), cuts[1:][~small].tolist()):
                if groups[x] != at_group:
                    edges += close()
                    held, at_group, at_key = [], groups[x], int(keys[x])
                held.append((fps[x:y], nodes[x:y]))
            found = np.concatenate([*pairs, np.array(edges, np.int64).reshape(-1, 2)])
            yield _edge_batch(np.unique(np.sort(found, axis=1), axis=0))
        yield _edge_batch(np.array(close(), np.int64))

    return keyed.select("group", "key", "node", "fps").mapInArrow(run, "a long, b long")


def _across(big: DataFrame, stars: DataFrame, bound: int) -> DataFrame | None:
    """(group, key, node): groups of about twice bound in which all of a large meeting point that isn't linked yet meets; None if all is.

    big has (key, node, parts, part), and the parts have been linked, to stars. Of two nodes that aren't linked, one at least is
    outside the point's largest component; so those, cut up into runs of about bound, meet every part.
    """
    of = big.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = of.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    main = stage(main.where("rest > 0").select("key", "main", F.ceil(F.col("rest") / bound).alias("runs")), "wide-rest")
    if not main.limit(1).count():
        return None
    of = of.join(main, "key")
    every = of.select("key", "node", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"))
    rest = of.where("root <> main").withColumn("run", F.pmod(F.xxhash64("node", F.lit(1)), F.col("runs")))
    rest = rest.select("key", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "run")
    return every.unionByName(rest).select(F.xxhash64("key", "part", "run").alias("group"), "key", "node").distinct()


def wide_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = WIDE_LIMIT, shingle: int = SHINGLE, group_bound: int = GROUP_BOUND) -> DataFrame:
    """(id_col, component_id) for every row: texts link whose wide fingerprints differ in at most RADIUS bits of the first word (the
    fingerprint of simhash_components), or in at most limit of all WORDS x 64 bits and at most HALF_RADIUS of a half of a searched word.

    Both sides emit a half's variants within half that radius, 1, and meet at a common one. Halves are searched one after the other, so disk and memory are those of one. Whole fingerprints are compared where they meet, so each
    group's forest is of real links; a link is given once, where the two meet first. Meeting points of more than group_bound nodes
    are dealt into parts, each is linked, and what then lies outside the point's largest component meets all parts: nothing is lost,
    and only a point that stays in many components costs more than in proportion. Nulls and repeats are treated as in
    simhash_components.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        drop_caches()
        for b in batches:
            fps = np.stack([wide_fingerprint(t, shingle) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, WORDS), np.uint64)
            lists = pa.ListArray.from_arrays(np.arange(0, fps.size + 1, WORDS, dtype=np.int32), pa.array(fps.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "fps"])

    picked = docs.select(id_col, F.col(text_col).cast("binary").alias("text"))
    prints = stage(picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, fps array<long>"), "wide-prints")
    nodes = prints.groupBy("fps").agg(F.min(id_col).alias("least_id")).withColumn("node", F.monotonically_increasing_id())
    nodes = stage(nodes, "wide-nodes")  # numbers hold once they are written
    half_bound = max(1, group_bound // 2)
    small_batches(spark, 10_000, 8)

    def links_of(t: int, side: int, met: DataFrame) -> DataFrame:
        """Links by half side of word t where rows of met (group, key, node) meet; fingerprints join only what meets."""
        wide = met.join(nodes.select("node", "fps"), "node").select("group", "key", "node", "fps")
        return _word_links(wide.repartition("group").sortWithinPartitions("group"), t, side, limit)

    def search(t: int, side: int) -> tuple[DataFrame, DataFrame | None]:
        """Links by one half of a word, and what its large meeting points hold. What they took up on disk can go when this returns."""
        word = F.get("fps", F.lit(t))
        half = F.shiftrightunsigned(word, 32) if side else word.bitwiseAND(F.lit(0xFFFFFFFF))
        near = F.transform(F.array(*[F.lit(1 << i) for i in range(32)]), lambda bit: half.bitwiseXOR(bit))
        keyed = nodes.select("node", F.explode(F.concat(F.array(half), near)).alias("key"))
        shared = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "wide-meetings")
        large = F.col("n") > group_bound
        many, few = shared.agg(F.count_if(~large), F.count_if(large)).first()
        plain = shared.where(~large).select("key")
        plain = F.broadcast(plain) if many <= BROADCAST_KEYS else plain
        now = links_of(t, side, keyed.join(plain, "key").select(F.col("key").alias("group"), "key", "node"))
        big = None
        if few:
            parts = F.ceil(F.col("n") / half_bound)
            swarm = shared.where(large)
            swarm = F.broadcast(swarm) if few <= BROADCAST_KEYS else swarm
            big = stage(keyed.join(swarm, "key").select("key", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part")), "wide-swarm")
            now = now.union(links_of(t, side, big.select(F.xxhash64("key", "part").alias("group"), "key", "node")))
        now = stage(now.where("a <> b"), "wide-links")
        discard(shared)
        return now, big

    links, swarms = None, []
    for t in range(SEARCHED):
        for side in range(2):
            now, big = search(t, side)
            links = now if links is None else links.union(now)
            swarms += [(t, side, big)] if big is not None else []
            release_shuffles(spark)
    stars = connected(links, "wide-stars")
    more = None  # links that the stars lack
    for t, side, big in swarms:
        rest = _across(big, stars, half_bound)
        if rest is not None:
            now = stage(links_of(t, side, rest).where("a <> b"), "wide-links")
            more = now if more is None else more.union(now)
        release_shuffles(spark)
    if more is not None:
        stars = connected(stars.union(more), "wide-stars")
    rooted = nodes.join(stars.select(F.col("a").alias("node"), "b"), "node", "left").select("fps", "least_id", F.coalesce("b", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fps", "component_id"), "fps").select(id_col, "component_id")


def drop_loose_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As drop_near_duplicates, by wide_components: near copies of a 5-word Jaccard similarity of about 0.8 or more go too."""
    return _least_of_each(docs, wide_components(docs, id_col, text_col), id_col)


def _least_of_each(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id names a component, and those without an id. Of different rows that repeat an id the least as JSON stays."""
    stays = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("__stays")).agg(F.count("*").alias("n"))
    stays = stage(stays, "stays")
    same = docs[id_col] == F.col("__stays")
    # as many ids stay as there are documents, all but: they are never broadcast, at no size
    kept = docs.join(stays.where("n = 1").select("__stays").hint("merge"), same, "left_semi")
    if stays.where("n > 1").limit(1).count():
        row = F.struct(*[docs[c] for c in docs.columns])
        again = docs.join(stays.where("n > 1").select("__stays"), same, "left_semi")
        kept = kept.unionAll(again.groupBy(id_col).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*"))
    return kept.unionAll(docs.where(F.col(id_col).isNull()))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the least id. Of rows that repeat an id, one stays.

    Rows with a null id can't be named as anyone's copy and stay. Columns are kept as they are, extra ones too.
    """
    return _least_of_each(docs, simhash_components(docs, id_col, text_col, radius, shingle), id_col)
