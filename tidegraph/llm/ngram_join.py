"""N-gram Jaccard self-join by vertical partitioning, and its connected components.

1. Global order. Each task sends the hashes of its documents' word shingles, cut by leading bits into
   buckets, as packed binary rows; a bucket keeps the shingles that occur twice or more, with a capped
   count, in sorted arrays in the shared folder. Shingles are ordered by (count, hash); those that occur
   once come first and can match nothing, so they are counted, not stored.
2. Prefixes. Two sets with Jaccard similarity t share one of the first n - ceil(t n) + 1 shingles of the
   order. Only such shingles that occur twice become postings; documents without any are done.
   Equal sets are one node, named by a hash of the set.
3. The order is cut into fragments, runs of (count, hash) that hold about as many occurrences each, and a node's
   shingles are stored by fragment. For a candidate pair partial overlaps are counted per fragment in separate tasks and summed.
4. Candidates. In each posting group all nodes are compared with one leader, the node whose shingles are
   repeated most (the text that others were copied from, if it is there). A link between two nodes of a
   group that both link to its leader adds nothing to the components; any other link has an end that does not
   link to the leader, so those nodes are compared with the rest of their group: first with the leader
   of those nodes, again and again for ROUNDS rounds as components merge, and then with all that is left.
   Pairs that cannot link by bounds that never err are not compared: set sizes, the positions of the shared
   shingle in both orders, the triangle inequality of the Jaccard distance, and parity bitmaps of the sets
   (two sets differ in at least as many elements as their bitmaps in bits). No link between components is lost,
   and a group of near copies costs one comparison per member.

Buckets are as many as the bytes of the input ask for, so a task of the first step holds some tens of millions of hashes at any size.

Defined cases: null text, or text without words, gives an empty set, linked with nothing; fewer words than
``width`` give one shingle of them all; a very long text is one row of its hashes, 8 bytes a word, in a worker; repeated rows are equal
sets and link; rows that share a doc_id are judged by their own texts; null doc_ids are never a component's name unless alone; an empty
table gives an empty result; near_components() ignores extra columns, one_each() keeps them, whatever their names.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import caches, files
from tidegraph.llm.components import components
from tidegraph.llm.tables import checked, content_key, drop_rows
from tidegraph.session import Scratch, delete

WIDTH, PERCENT = 5, 80
#: Buckets of the order are 2 to a power between these; so many bytes of text ask for one.
BUCKET_BITS = (12, 18)
BUCKET_BYTES = 1 << 28
FRAGMENTS = 4
COUNT_CAP = 8  # what one chunk adds at most to a shingle's count; it orders shingles and decides nothing else
CHUNK_SHINGLES = 1_000_000
WORDS_CACHED = 1 << 18
#: Members of one leader are dealt to one more task per so many; each gets the leader's segment too, one row more.
SALT_ROWS = 256
#: Rounds in which one more leader of each unsettled group is compared, before all pairs that are left.
ROUNDS = 2
#: Rows of one shingle that are still compared in one task; the rows of a more frequent one are dealt to a task per so many.
SPLIT_ROWS = 1_000
#: 64-bit words of the parity bitmap of a set.
SIG_WORDS = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)

_word_hash: dict[bytes, int] = {}
caches.register("ngram_join", lambda: (_word_hash.clear(), _orders.clear()))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_word_hash) > WORDS_CACHED:
        _word_hash.clear()
    caches.claim("ngram_join")
    cache, digest = _word_hash, xxhash.xxh3_64_intdigest
    for w in words:
        if w not in cache:
            cache[w] = digest(w)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _MUL
            out ^= out >> np.uint64(31)
    return np.unique(out)


def parity(s: np.ndarray) -> list[int]:
    """Parity bitmap of a set: bit k tells whether an odd number of its hashes fall on k."""
    odd = np.bincount(((s >> np.uint64(20)) % np.uint64(64 * SIG_WORDS)).astype(np.int64), minlength=64 * SIG_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def set_name(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


# --- 1. global order ------------------------------------------------------------------------------


def bucket_bits(n_bytes: int) -> int:
    """Leading bits of a hash that name its bucket, for so many bytes of text."""
    return min(max((n_bytes // BUCKET_BYTES).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])


def cuts(histogram: list[int], fragments: int = FRAGMENTS) -> list[int]:
    """Where the order is cut, as keys of order_key(). histogram[c]: shingles that occur c times."""
    weight = [c * n for c, n in enumerate(histogram)]
    out, before = [], 0
    targets = [sum(weight) * f / fragments for f in range(1, fragments)]
    for c, w in enumerate(weight):
        while targets and before + w >= targets[0] and w:
            share = (targets.pop(0) - before) / w
            out.append((c << 56) + min(int(share * 2**56), 2**56 - 1))
        before += w
    return out


def order_key(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place in the global order, by count and then by hash."""
    return (counts.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))


def global_order(docs: DataFrame, scratch: Scratch, bits: int | None = None, width: int = WIDTH) -> str:
    """Folder of sorted arrays of the shingles that occur more than once: per bucket, 32 more bits and a count."""
    bits = bits or bucket_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    root, kind = scratch.path("order"), "bucket int, packed binary"

    def packed(parts: list[np.ndarray]):
        import pyarrow as pa

        flat, n = np.unique(np.concatenate(parts), return_counts=True)
        flat = np.repeat(flat, np.minimum(n, COUNT_CAP))
        bucket = (flat >> np.uint64(64 - bits)).astype(np.int64)
        low = (flat >> np.uint64(32 - bits)).astype(np.uint32)
        names, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(flat))
        blobs = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    def send(batches):
        held, n = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingles(t, width)
                if len(s):
                    held.append(s)
                    n += len(s)
                if n > CHUNK_SHINGLES:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def keep(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name, keys, counts, index, seen = files.attempt_name("shard"), None, None, [], np.zeros(256, np.int64)
        at, now, held = 0, None, []

        def close():
            nonlocal at, keys, counts, seen
            low, n = np.unique(np.concatenate(held), return_counts=True)
            low, n = low[n > 1], np.minimum(n[n > 1], 255)
            if len(low):
                if keys is None:
                    keys, counts = files.create(f"{root}/{name}.keys"), files.create(f"{root}/{name}.counts")
                keys.write(low.astype("<u4").tobytes())
                counts.write(n.astype("u1").tobytes())
                index.append([now, at, len(low)])
                seen += np.bincount(n, minlength=256)
                at += len(low)

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now:
                    if held:
                        close()
                    now, held = bucket, []
                held.append(np.frombuffer(blob, "<u4"))
        if held:
            close()
        if keys is not None:
            keys.close()
            counts.close()
            yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "buckets": [json.dumps(index)], "seen": [seen.tolist()]})

    rows = docs.select("text").mapInArrow(send, kind).repartition("bucket").sortWithinPartitions("bucket")
    shards = scratch.cut(rows.mapInArrow(keep, "pid int, name string, buckets string, seen array<long>"), "shards").collect()  # a row per task
    cut = cuts(np.sum([s["seen"] for s in shards], axis=0).tolist() if shards else [])
    with files.create(f"{root}/manifest.json") as f:
        f.write(json.dumps({"bits": bits, "cuts": cut, "shards": [[s["name"], json.loads(s["buckets"])] for s in shards]}).encode())
    return root


class Order:
    """Counts of shingles, from memory-mapped arrays; 1 for those that are not listed."""

    def __init__(self, root: str) -> None:
        m = json.loads(files.read_bytes(f"{root}/manifest.json"))
        self.root, self.bits, self.where, self.open = root, m["bits"], {}, {}
        self.cuts = np.array(m["cuts"], np.uint64)
        for name, buckets in m["shards"]:
            for b, at, n in buckets:
                self.where[b] = (name, at, n)

    def _shard(self, name: str):
        if name not in self.open:
            self.open[name] = tuple(np.frombuffer(files.open_input(f"{self.root}/{name}.{e}").read_buffer(), t) for e, t in (("keys", "<u4"), ("counts", "u1")))
        return self.open[name]

    def counts(self, sorted_hashes: np.ndarray) -> np.ndarray:
        """Counts of ascending shingle hashes."""
        out = np.ones(len(sorted_hashes), np.uint8)
        bucket = (sorted_hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        low = (sorted_hashes >> np.uint64(32 - self.bits)).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            if a == b or (place := self.where.get(int(bucket[a]))) is None:
                continue
            name, at, n = place
            keys, counts = self._shard(name)
            keys, counts = keys[at : at + n], counts[at : at + n]
            found = np.searchsorted(keys, low[a:b])
            found[found == n] = 0
            hit = keys[found] == low[a:b]
            out[a:b][hit] = counts[found[hit]]
        return out


_orders: dict[str, Order] = {}


def order_of(root: str) -> Order:
    if root not in _orders:
        _orders.clear()
        _orders[root] = Order(root)
    return _orders[root]


# --- 2. nodes, prefixes and fragments -----------------------------------------------------------------


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def nodes(docs: DataFrame, root: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, k1 and k2 (key of the text), node, n (set size), mass (mean count of its shingles, in thousandths), posts (prefix shingles that occur elsewhere), places (their positions in the order), sig (parity bitmap) and segs (repeated shingles by fragment; null without posts)."""

    def flush(ids, keys, sets):
        import pyarrow as pa

        own = order_of(root)
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        unique, back = np.unique(flat, return_inverse=True)
        counts = own.counts(unique)[back]
        posts, places, sigs, segs, names, mass = [], [], [], [], [], []
        at = 0
        for s, n in zip(sets, sizes.tolist(), strict=True):
            c = counts[at : at + n]
            at += n
            names.append(set_name(s) if n else None)
            mass.append(int(c.sum(dtype=np.int64) * 1000 // n) if n else 0)
            p = prefix_length(n, percent) if n else 0
            first = np.lexsort((s, c))[:p] if int((c == 1).sum()) < p else np.zeros(0, int)
            place = np.flatnonzero(c[first] > 1)
            first = first[place]
            posts.append(s[first].view(np.int64).tolist())
            places.append(place.tolist())
            sigs.append(parity(s) if len(first) else None)
            if len(first):
                rep = s[c > 1]
                frag = np.searchsorted(own.cuts, order_key(c[c > 1], rep), "right")
                segs.append([rep[frag == k].astype("<u8").tobytes() for k in range(len(own.cuts) + 1)])
            else:
                segs.append(None)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(k, pa.int64()) for k in keys), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(mass, pa.int64()), pa.array(posts, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64())), pa.array(segs, pa.list_(pa.binary()))], names=["doc_id", "k1", "k2", "node", "n", "mass", "posts", "places", "sig", "segs"])

    def run(batches):
        for b in batches:
            ids, keys, sets, held = [], ([], []), [], 0
            for i, k1, k2, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "k1", "k2", "text")), strict=True):
                ids.append(i)
                keys[0].append(k1)
                keys[1].append(k2)
                sets.append(shingles(t, width))
                held += len(sets[-1])
                if held > CHUNK_SHINGLES:
                    yield flush(ids, keys, sets)
                    ids, keys, sets, held = [], ([], []), [], 0
            if ids:
                yield flush(ids, keys, sets)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *content_key("text"), "text")
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, node long, n long, mass long, posts array<long>, places array<long>, sig array<long>, segs array<binary>")


# --- 3. overlaps by fragment -----------------------------------------------------------------------


def overlaps(pairs: DataFrame, segments: DataFrame, scratch: Scratch) -> DataFrame:
    """(lead, node) -> (lead, node, common): partial counts of each fragment, summed.

    segments: (node, frag, seg). A task gets, for a leader, a fragment and a salt, the leader's segment
    first and then the members' segments, and holds one leader segment at a time.
    """
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    sizes = scratch.cut(sizes, "leaders")
    salted = pairs.join(sizes, "lead").select("lead", "node", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    members = salted.join(segments, "node").select("lead", "salt", "frag", F.col("node").alias("member"), "seg")
    lead = segments.select(F.col("node").alias("lead"), "frag", "seg")
    leaders = sizes.select("lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(lead, "lead").select("lead", "salt", "frag", F.lit(None).cast("long").alias("member"), "seg")

    def count(batches):
        import pyarrow as pa

        # the order is deleted by now, but its space is only free when no worker maps it; words are not hashed again
        caches.claim("overlaps")
        key, own = None, None
        for b in batches:
            lead_id, salt, frag, member, seg = (b.column(i).to_pylist() for i in range(5))
            out: list[tuple[int, int, int]] = []
            for le, sa, fr, me, se in zip(lead_id, salt, frag, member, seg, strict=True):
                s = np.frombuffer(se, "<u8")
                if me is None:
                    key, own = (le, sa, fr), s
                elif key == (le, sa, fr) and len(own) and len(s):
                    at = np.searchsorted(own, s)
                    at[at == len(own)] = 0
                    if hit := int((own[at] == s).sum()):
                        out.append((le, me, hit))
            if out:
                a, m, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(m, pa.int64()), pa.array(n, pa.int64())], names=["lead", "node", "part"])

    rows = leaders.unionByName(members).repartition("lead", "salt", "frag").sortWithinPartitions("lead", "salt", "frag", F.asc_nulls_first("member"))
    return rows.mapInArrow(count, "lead long, node long, part long").groupBy("lead", "node").agg(F.sum("part").alias("common"))


def verified(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(lead, node, linked, dist) for every pair."""
    pairs = scratch.cut(pairs, "pairs")
    met = pairs.select("node").unionByName(pairs.select(F.col("lead").alias("node"))).distinct()
    segments = segments.join(checked(scratch.cut(met, "met")), "node", "left_semi")  # only what is compared is moved
    n = lambda c: sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    common = overlaps(pairs, segments, scratch)
    rows = pairs.join(common, ["lead", "node"], "left").join(n("lead"), "lead").join(n("node"), "node")
    both = F.coalesce("common", F.lit(0))
    union = F.col("n_lead") + F.col("n_node") - both
    return scratch.cut(rows.select("lead", "node", (both * 100 >= union * percent).alias("linked"), (1 - both / union).alias("dist")), "verified")


# --- 4. candidates and components -------------------------------------------------------------------


def _may_link(x: str, y: str, percent: int):
    """False only for pairs that cannot link: by set sizes, or by the parity bitmaps. x, y: suffixes of columns n_ and b0_ to b7_."""
    nx, ny = F.col(f"n_{x}"), F.col(f"n_{y}")
    differ = sum((F.bit_count(F.col(f"b{k}_{x}").bitwiseXOR(F.col(f"b{k}_{y}"))) for k in range(1, SIG_WORDS)), F.bit_count(F.col(f"b0_{x}").bitwiseXOR(F.col(f"b0_{y}"))))
    return (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent) & (differ * (100 + percent) <= (nx + ny) * (100 - percent))


def _marks(marks: DataFrame, at: str) -> DataFrame:
    return marks.select(F.col("node").alias(at), *(F.col(c).alias(f"{c}_{at}") for c in marks.columns if c != "node"))


def live_nodes(rows: DataFrame) -> DataFrame:
    """Of the table of nodes(), one row of each node that has posts."""
    live = rows.where(F.col("segs").isNotNull()).select("node", "n", "mass", "posts", "places", "sig", "segs")
    return live.dropDuplicates(["node"])  # equal sets fall together before they leave their tasks


def links(live: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between nodes that connect all nodes of a component. live: live_nodes(), written."""
    segments = live.select("node", F.posexplode("segs").alias("frag", "seg"))
    marks = live.select("node", "n", *(F.col("sig")[k].alias(f"b{k}") for k in range(SIG_WORDS)))
    sizes = marks.select("node", "n")
    posts = live.select(F.explode(F.arrays_zip("posts", "places")).alias("p"), "node", "mass").select(F.col("p.posts").alias("h"), F.col("p.places").alias("place"), "node", "mass")
    groups = posts.groupBy("h").agg(F.max(F.struct("mass", "node")).alias("top"), F.min("node").alias("first"), F.max("node").alias("last"))
    groups = scratch.cut(groups.where("first <> last").select("h", F.col("top.node").alias("lead")), "groups")
    # nothing above this join needs the rows of a shingle together, so a frequent one is split
    shared = scratch.cut(posts.join(groups, "h"), "members")
    stars = scratch.cut(shared.where("node <> lead").select("lead", "node").distinct(), "stars")
    tried = stars.join(_marks(marks, "lead"), "lead").join(_marks(marks, "node"), "node").where(_may_link("lead", "node", percent)).select("lead", "node")
    done = verified(tried, segments, sizes, scratch, percent)
    apart = stars.join(done.where("linked"), ["lead", "node"], "left_anti")
    open_groups = scratch.cut(shared.join(apart, ["lead", "node"], "left_semi").select("h").distinct(), "open")
    around = shared.join(open_groups, "h", "left_semi").join(done, ["lead", "node"], "left")
    own = F.col("node") == F.col("lead")
    around = around.select("h", "place", "node", "mass", own.alias("top"), F.when(own, 0.0).otherwise(F.col("dist")).alias("dist"), (own | F.coalesce("linked", F.lit(False))).alias("near"))
    around = scratch.cut(around.join(marks, "node"), "around")
    comp = None
    for left in range(ROUNDS, -1, -1):
        if comp is not None and left:
            continue  # the last round compared nothing, so one like it would not either
        if comp is None:
            comp = components(done.where("linked").select(F.col("lead").alias("a"), F.col("node").alias("b")), scratch)
        more = scratch.cut(_across(around, comp, done, scratch, percent, all_pairs=not left), "across")
        if more.isEmpty():
            continue
        done = scratch.cut(done.unionByName(verified(more, segments, sizes, scratch, percent)), "done")
        comp = None
    return done.where("linked").select(F.col("lead").alias("a"), F.col("node").alias("b"))


def _meet(many: DataFrame, few: DataFrame, hot: DataFrame, by: str) -> DataFrame:
    """many joined with few on h. Rows of many whose h is in hot (_h, salts) are dealt by ``by`` to as many tasks as it has salts, each of which gets all of few's rows of that h."""
    salts = F.coalesce("salts", F.lit(1))
    dealt = many.join(hot, F.col("h") == F.col("_h"), "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_h", "salts")
    copies = few.join(hot, F.col("h") == F.col("_h"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_h", "salts")
    return dealt.join(copies, ["h", "salt"]).drop("salt")


def _across(around: DataFrame, comp: DataFrame, done: DataFrame, scratch: Scratch, percent: int, all_pairs: bool) -> DataFrame:
    """Pairs (lead, node) of different components in a posting group that may link and were not compared yet.

    One end did not link to the group's first leader. Unless all_pairs, that end is the node with the
    largest mass of those that are not in the component of the group's first leader.
    """
    rooted = around.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = rooted.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("rows")).where("r0 <> r1").select("h", "rows")
    spread = scratch.cut(spread, "spread")
    hot = checked(spread.where(F.col("rows") > SPLIT_ROWS).select(F.col("h").alias("_h"), F.ceil(F.col("rows") / SPLIT_ROWS).cast("int").alias("salts")))
    rooted = scratch.cut(rooted.join(spread.select("h"), "h", "left_semi"), "rooted")
    far = rooted.where(~F.col("near"))
    if not all_pairs:
        home = rooted.where("top").groupBy("h").agg(F.first("root").alias("home"))
        far = _meet(far, home, hot, "node").where("root <> home").groupBy("h").agg(F.max(F.struct("mass", *(c for c in rooted.columns if c not in ("h", "mass")))).alias("f")).select("h", "f.*")
    a = far.select("h", *(F.col(c).alias(f"{c}_x") for c in rooted.columns if c not in ("h", "mass", "top", "near")))
    b = rooted.select("h", "near", *(F.col(c).alias(f"{c}_y") for c in rooted.columns if c not in ("h", "mass", "top", "near")))
    once = F.lit(True) if not all_pairs else F.col("near") | (F.col("node_x") < F.col("node_y"))
    apart = F.abs(F.col("dist_x") - F.col("dist_y")) > 1 - percent / 100 + 1e-9
    # the first shingle that two sets share leaves room for as many as come after it in both
    room = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    met = _meet(a, b, hot, "node_x") if all_pairs else _meet(b, a, hot, "node_y")
    pairs = met.where(
        once & (F.col("root_x") != F.col("root_y")) & ~F.coalesce(apart, F.lit(False)) & (room * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent) & _may_link("x", "y", percent)
    )
    seen = done.select(F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node"))
    return pairs.select(F.least("node_x", "node_y").alias("lead"), F.greatest("node_x", "node_y").alias("node")).distinct().join(seen, ["lead", "node"], "left_anti")


def parts(docs: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, k1, k2, n, part (a name of the component; null for empty sets) of every row."""
    with scratch.lean(), scratch.small_batches():
        order = global_order(docs, scratch, width=width)
        wide = scratch.cut(nodes(docs, order, width, percent), "nodes")
        delete(scratch.spark, order)
        # shingles are kept once a node, not once a row
        rows, live = scratch.cut(wide.select("doc_id", "k1", "k2", "node", "n"), "rows"), scratch.cut(live_nodes(wide), "live")
        scratch.drop(wide)
        comp = components(links(live, scratch, percent), scratch).withColumnRenamed("node", "_node")
        full, empty = rows.where("node is not null"), rows.where("node is null")
        named = full.join(comp, F.col("node") == F.col("_node"), "left").select("doc_id", "k1", "k2", "n", F.coalesce("root", "node").alias("part"))
        named = scratch.cut(named.unionByName(empty.select("doc_id", "k1", "k2", "n", F.col("node").alias("part"))), "named")
        scratch.sweep(named)
    return named


def near_components(docs: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    named = parts(docs, scratch, width, percent).select("doc_id", "n", "part")
    least = scratch.cut(named.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least")), "least")
    out = named.where("part is not null").join(least, "part").select("doc_id", "n", "least")
    out = out.unionByName(named.where("part is null").select("doc_id", "n", F.col("doc_id").alias("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_each(docs: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, null ids last; of rows that share it, one text.

    Rows are told apart by doc_id and text; of rows with the same both, the one whose other columns hash lowest stays. Rows without words stay.
    """
    key = [F.col("doc_id").cast("long"), *content_key("text")]
    found = parts(docs, scratch, width, percent).where("part is not null").select("part", "doc_id", "k1", "k2")
    copies = scratch.cut(found.groupBy("part", "doc_id", "k1", "k2").agg(F.count("*").alias("copies")), "copies")
    first = copies.groupBy(F.col("part").alias("_part")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("w"))
    first = scratch.cut(first, "first")
    stays = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("k1") == F.col("w.k1")) & (F.col("k2") == F.col("w.k2"))
    ruled = copies.join(first, F.col("part") == F.col("_part")).select("doc_id", "k1", "k2", "copies", stays.alias("stays"))
    ruled = scratch.cut(ruled, "ruled")
    kept = drop_rows(docs, key, ruled.where("not stays").select("doc_id", "k1", "k2"))
    again = scratch.cut(ruled.where("stays and copies > 1").select("doc_id", "k1", "k2"), "again")
    if again.isEmpty():
        return kept
    marked = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = kept.select(marked, key[0].alias("id"), *(k.alias(f"h{i}") for i, k in enumerate(key[1:])), F.xxhash64(*(F.col(c) for c in plain)).alias("rest"))
    right = checked(again)
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h0") == F.col("k1")) & (F.col("h1") == F.col("k2"))
    one = rows.join(right, same, "left_semi").groupBy("id", "h0", "h1").agg(F.min_by("row", "rest").alias("row"))
    return rows.join(right, same, "left_anti").select("row.*").unionByName(one.select("row.*"))
