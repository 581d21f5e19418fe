"""SimHash near-dedup: fingerprints, links at few differing bits through vantage-point trees, components or verified near copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import Scratch, below, salted_join
from .components import components

#: Fingerprints that the first trees are fitted on (about), points a shard should hold, rows that one task compares (at most), and
#: rows of an over-full shard that its own tree is fitted on (about).
SAMPLE, SHARD, CELL, REGROW = 1 << 14, 1500, 20_000, 4_096
#: Levels of trees within trees; what is over-full after them is dealt in blocks.
LEVELS = 8
#: Fingerprints of a text for near copies, the differing bits at which any one of them makes a candidate, and the parts that its
#: trees look at: of pairs whose shingles have a similarity of 0.8, 99 of 100 come together by at least one.
TABLES, REACH, PARTS = 4, 7, 4


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text (A-Z lower-cased, words without ASCII white space, repeats included)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    # bytes.lower and bytes.split know ASCII only, as wanted
    flat = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = np.concatenate([[0], ends[:-1]])[:n].tolist(), (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts, stops, strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        total += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.select(F.col(f"`{id_col}`")).dtypes[0][1]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def grow(values: np.ndarray, leaf: int, reach: int) -> list[tuple]:
    """A vantage-point tree over 32-bit values as a list of nodes (point, radius, left, right); a child below 0 is leaf ~child.

    The radius is, of those that leave at least a quarter of the sample on either side, the one with the fewest points on the
    last `reach` rings inside it, for these are also sent to the other side. No split where no radius does that.
    """
    nodes: list[tuple] = []
    leaves = 0

    def build(v: np.ndarray) -> int:
        nonlocal leaves
        if len(v) > leaf:
            for p in v[:: max(1, len(v) // 4)][:4]:
                rings = np.bincount(np.bitwise_count(v ^ p), minlength=33)
                inside = np.cumsum(rings)
                fair = [r for r in range(reach, 32) if 4 * inside[r] >= len(v) and 4 * (len(v) - inside[r]) >= len(v)]
                if fair:
                    radius = min(fair, key=lambda r: (rings[r - reach + 1 : r + 1].sum(), abs(2 * inside[r] - len(v))))
                    near = np.bitwise_count(v ^ p) <= radius
                    at = len(nodes)
                    nodes.append(())
                    left, right = build(v[near]), build(v[~near])
                    nodes[at] = (int(p), int(radius), left, right)
                    return at
        leaves += 1
        return -leaves

    build(values)
    return nodes


def route(nodes: list[tuple], values: np.ndarray, reach: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): for each value its home leaf, and the leaves beyond it that may hold values within reach.

    Of two values in reach of each other on different sides of a node, the one inside is sent across, so each pair meets where
    the outer one lives. A branch is left out if the triangle inequality rules its values out. home: False for values that only
    ask here, as their own home is elsewhere.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    stack = [(0 if nodes else -1, np.arange(len(values)), np.ones(len(values), bool) if home is None else home)]
    while stack:
        at, rows, own = stack.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((rows, ~at, own))
            continue
        p, radius, left, right = nodes[at]
        d = np.bitwise_count(values[rows] ^ np.uint32(p)).astype(np.int16)
        near = d <= radius
        go = near | (~own & (d - reach <= radius))
        stack.append((left, rows[go], own[go]))
        go = ~near | (d + reach > radius)
        stack.append((right, rows[go], own[go] & ~near[go]))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))
    return np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), k, np.int32) for r, k, _ in out]), np.concatenate([h for _, _, h in out])


def part_of(fp: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Bits of one of `parts` equal parts of 64-bit fingerprints, as 32-bit values."""
    width = 64 // parts
    return (fp >> np.uint64(part * width)).astype(np.uint32) & np.uint32((1 << width) - 1)


def local_links(fp: np.ndarray, resident: np.ndarray, asks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) that join what pairs of asking and resident fingerprints at up to `bits` differing bits join.

    One link per fingerprint, not one per pair: the pairs are merged into trees as they are found, a block at a time.
    """
    root = np.arange(len(fp))
    r = np.flatnonzero(resident)
    q = np.flatnonzero(asks)
    step = max(1, (1 << 22) // max(1, len(r)))
    for k in range(0, len(q), step):
        block = q[k : k + step]
        i, j = np.nonzero(np.bitwise_count(fp[block][:, None] ^ fp[r][None, :]) <= bits)
        u, v = root[block[i]], root[r[j]]
        while True:
            differ = u != v
            if not differ.any():
                break
            u, v = u[differ], v[differ]
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root[root] != root).any():
                root = root[root]
            u, v = root[u], root[v]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def near_links(points: DataFrame, scratch: Scratch, bits: int = 3, parts: int = 2, sample: int = SAMPLE, shard: int = SHARD, cell: int = CELL, regrow: int = REGROW) -> DataFrame:
    """(tab, a, b): links that connect exactly the fingerprints of points (tab int, fp long, distinct) of one tab at up to `bits`
    differing bits.

    Two fingerprints that differ in at most `bits` bits differ in at most bits // parts in one of `parts` equal parts. Each part
    has a vantage-point tree, fitted on about `sample` fingerprints taken by a hash threshold, whose leaves are the shards; all
    fingerprints go to their home shard and, as queries, to the shards across a boundary that the triangle inequality does not
    rule out. Distances on a part spread less than on the whole, so with a reach of bits // parts far fewer fingerprints lie on a
    boundary. A shard of over `cell` rows grows a tree of its own, on the executors, from its own rows, so that shards stay small
    however many fingerprints there are; what can't be split (equal parts) is dealt in blocks of residents and queries.
    """
    reach = bits // parts
    total = points.count()
    picked: dict[int, list[int]] = {}
    for x in points.filter(below(F.xxhash64("tab", "fp"), 1.0 * sample / max(1, total))).collect():
        picked.setdefault(x.tab, []).append(x.fp)
    trees = {}
    for tab, values in picked.items():
        some = np.sort(np.array(values, np.int64).view(np.uint64))
        some = some[np.argsort(some * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
        leaf = max(8, int(shard * sum(map(len, picked.values())) / max(total, 1)))
        trees[tab] = [grow(part_of(some, k, parts), leaf, reach) for k in range(parts)]

    def to_shards(batches):
        for b in batches:
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            tabs = b.column(0).to_numpy(zero_copy_only=False)
            for tab in np.unique(tabs).tolist():
                own = fp[tabs == tab]
                for k in range(parts):
                    rows, shards, home = route(trees.get(tab, [[]] * parts)[k], part_of(own, k, parts), reach)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), tab, np.int32)), pa.array(np.full(len(rows), k, np.int32)), pa.array(own[rows].view(np.int64)), pa.array(shards.astype(np.int64)), pa.array(home)], names=["tab", "part", "fp", "shard", "home"])

    schema = "tab int, part int, fp long, shard long, home boolean"
    key = ["tab", "part", "shard"]
    routed, path = scratch.keep(points.select("tab", "fp").mapInArrow(to_shards, schema))
    done, paths = [], [path]
    for _ in range(LEVELS):
        sizes, sizes_path = scratch.keep(routed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("home"), 1)).alias("residents")).filter(F.col("n") > cell))
        paths.append(sizes_path)
        if sizes.isEmpty():
            break
        some = routed.filter("home").join(sizes, key).filter(F.pmod(F.xxhash64("fp", F.lit(43)), F.lit(1 << 30)) < F.lit(float(regrow) * (1 << 30)) / F.col("residents"))

        def fit(t: pa.Table) -> pa.Table:
            part = t.column("part")[0].as_py()
            fp = np.unique(t.column("fp").to_numpy().view(np.uint64))
            fp = fp[np.argsort(fp * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
            leaf = max(1, int(shard * len(fp) / max(1, t.column("residents")[0].as_py())))
            tree = np.array(grow(part_of(fp, part, parts), leaf, reach), np.int64).reshape(-1, 4)
            return pa.table({**{k: t.column(k)[:1] for k in key}, "tree": pa.array([tree.tobytes()], pa.binary())})

        grown, grown_path = scratch.keep(some.groupBy(*key).applyInArrow(fit, "tab int, part int, shard long, tree binary").filter(F.octet_length("tree") > 0))
        paths.append(grown_path)
        if grown.isEmpty():
            break

        def again(batches):
            for b in batches:
                keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
                fp, home = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64), b.column(4).to_numpy(zero_copy_only=False).astype(bool)
                _, first, which = np.unique(keys, axis=0, return_index=True, return_inverse=True)
                for g, at in enumerate(first.tolist()):
                    mine = np.flatnonzero(which.ravel() == g)
                    tab, part, old = keys[at].tolist()
                    tree = [tuple(x) for x in np.frombuffer(b.column(5)[at].as_py(), np.int64).reshape(-1, 4).tolist()]
                    rows, leaf, own = route(tree, part_of(fp[mine], part, parts), reach, home[mine])
                    # a shard of the next level is named by its place in the last one
                    new = np.array([xxhash.xxh64_intdigest(f"{old}/{x}") for x in range(int(leaf.max(initial=0)) + 1)], np.uint64).view(np.int64)[leaf]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), tab, np.int32)), pa.array(np.full(len(rows), part, np.int32)), pa.array(fp[mine][rows].view(np.int64)), pa.array(new), pa.array(own)], names=["tab", "part", "fp", "shard", "home"])

        done.append(routed.join(grown.select(*key), key, "left_anti"))
        split = routed.join(grown, key).select("tab", "part", "shard", "fp", "home", "tree").mapInArrow(again, schema)
        routed, path = scratch.keep(split)
        paths.append(path)
    for d in done:
        routed = routed.unionByName(d)
    full = routed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).select(*key, F.ceil(F.col("n") / cell).cast("int").alias("k"))
    routed = routed.join(full, key, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    # residents meet every block of queries; queries (residents are queries too) meet every block of residents
    here = routed.select(*key, "fp", "home", own.alias("own"), F.sequence(F.lit(0), F.col("k") - 1).alias("ks"))
    as_resident = here.filter("home").select(*key, "fp", F.col("own").alias("rb"), F.explode("ks").alias("qb"), F.lit(True).alias("resident"))
    as_query = here.select(*key, "fp", F.explode("ks").alias("rb"), F.col("own").alias("qb"), F.lit(False).alias("resident"))

    def compare(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().view(np.uint64)
        resident = t.column("resident").to_numpy(zero_copy_only=False).astype(bool)
        points, inverse = np.unique(fp, return_inverse=True)
        is_r, is_q = np.zeros(len(points), bool), np.zeros(len(points), bool)
        is_r[inverse[resident]] = True
        is_q[inverse[~resident]] = True
        a, b = local_links(points, is_r, is_q, bits)
        return pa.table({"tab": pa.array(np.full(len(a), t.column("tab")[0].as_py(), np.int32)), "a": a.view(np.int64), "b": b.view(np.int64)})

    found = as_resident.unionByName(as_query).groupBy(*key, "rb", "qb").applyInArrow(compare, "tab int, a long, b long")
    links, _ = scratch.keep(found.distinct())
    scratch.drop(*paths)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id reachable by links at up to `bits` differing bits.

    Null or empty texts have fingerprint zero and link like any other. Null ids are never the smallest; a component of null ids
    only has a null component_id. Rows that repeat an id are all returned. An empty table gives no rows. Copies of a text meet
    as one fingerprint before any comparison, and neither links nor fingerprints come to the driver but for the tree's sample.
    """
    scratch = Scratch(docs.sparkSession)
    prints, _ = scratch.keep(fingerprints(docs, id_col, text_col))
    nodes, _ = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = components(near_links(nodes.select(F.lit(0).alias("tab"), "fp"), scratch, bits).select("a", "b"), scratch)
    named = nodes.join(joined.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("b", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    placed = salted_join(named, smallest, "root", "m", F.col("fp")).select("fp", "n", "component_id")
    return salted_join(prints, placed, "fp", "n", F.col("doc_id")).select("doc_id", "fp", "component_id")


def candidate_groups(nodes: DataFrame, scratch: Scratch, bits: int = REACH, parts: int = PARTS) -> DataFrame:
    """(node, root): the group of every node of nodes (node long, prints array<long>) that has candidates: nodes that agree to
    within `bits` bits in one of their fingerprints, and what they join."""
    prints = nodes.select("node", F.posexplode("prints").alias("tab", "fp"))
    points, _ = scratch.keep(prints.groupBy("tab", "fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")))
    links = near_links(points.select("tab", "fp"), scratch, bits, parts)
    # a fingerprint stands for the least of its nodes
    shared = points.filter("n > 1").select(F.xxhash64("tab", "fp").alias("key"), "tab", "fp", "least", "n")
    keyed = prints.select("node", F.xxhash64("tab", "fp").alias("key"))
    same = salted_join(keyed, shared.select("key", "least", "n"), "key", "n", F.col("node")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    of = lambda c: points.select("tab", F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    near = links.join(of("a"), ["tab", "a"]).join(of("b"), ["tab", "b"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    joined = components(same.unionByName(near), scratch)
    return joined.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(joined.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, tables: int = TABLES, bits: int = REACH) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest id.

    Near copies share `similarity` of their shingles of `width` words (intersection by union of the sets). Candidates are texts
    of which one of `tables` fingerprints of these sets (similar.set_prints) agree to within `bits` bits; vantage-point shards
    find them, and the exact similarity decides. In a group of candidates a text is linked to the first one, by id, that stays and that it is a
    near copy of; so every row that goes is a near copy of one that stays, but where a group is dealt to several tasks: there it
    may be one of a row that goes for being a near copy of one that stays. Texts with the same shingles meet as one before any
    comparison, null and empty ones among them. Rows that repeat an id but not their text are rows of their own; null ids come
    last in their group, and ties go by a hash of the text, then of the whole row, so that a retry keeps the same one.
    """
    scratch = Scratch(docs.sparkSession)
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    kept, kept_path = scratch.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    kind = docs.select(ident).dtypes[0][1]
    source = kept.select(F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"), F.xxhash64("doc").alias("h"), "row")

    def sign(batches):
        for b in batches:
            sets = [similar.shingles(x, width) for x in b.column(1).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = pa.array([similar.set_prints(s, tables).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), prints, pa.array([len(s) for s in sets], pa.int64()), b.column(2), b.column(3)], names=["id", "node", "prints", "size", "h", "row"])

    signed, _ = scratch.keep(source.mapInArrow(sign, f"id {kind}, node long, prints array<long>, size long, h long, row long"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "row")).alias("first")
    nodes, _ = scratch.keep(signed.groupBy("node").agg(first, F.first("prints").alias("prints"), F.first("size").alias("size")).select("node", F.col("first.id").alias("least"), F.col("first.row").alias("row"), "prints", "size"))
    groups = candidate_groups(nodes.select("node", "prints"), scratch, bits)
    members, _ = scratch.keep(nodes.drop("prints").join(groups, "node"))
    links = similar.verified(members, source.select("row", "text"), scratch, width, similarity)
    gone = components(links, scratch).select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = nodes.select("node", "least", "row").join(gone, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winner = F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "node", "row")).alias("w")
    stay = named.groupBy("root").agg(winner).select(F.col("w.row").alias("row"))
    # fewer rows go than stay: only their numbers meet the texts, which then often need no shuffle
    copies, copies_path = scratch.keep(signed.select("row").join(stay, "row", "left_anti"))
    # all else has done its work
    scratch.drop(*(x for x in scratch.paths if x not in (kept_path, copies_path)))
    return kept.join(copies, "row", "left_anti").select("doc.*")


def op8_simhash(spark, sf_dir):
    from .common import table

    d = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
