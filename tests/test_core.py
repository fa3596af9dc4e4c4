"""Semirings, strategies, construction and sources against plain Python and DuckDB."""

import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegraph import SEMIRINGS, EvolveConfig, queries, run, session
from tidegraph.config import INF, NEVER
from tidegraph.functions import bits
from tidegraph.functions.semiring import Semiring
from tidegraph.operators import dependency, evolve, fixpoint, frontier
from tidegraph.plans import STRATEGIES
from tidegraph.session import Scratch
from tidegraph.sources import edgelist, read_edges, results
from tidegraph.streaming.changes import LiveQuery

SF = "/root/testdata/sf0.001"


def plain(edges, ring, source, sid, vertices):
    """Bellman-Ford over edges alive in sid."""
    step = {"sssp": lambda v, w: v + w, "ssnp": max, "sswp": min, "viterbi": lambda v, w: v // w, "bfs": lambda v, w: v + 1, "cc": lambda v, w: v}[ring.name]
    val = {v: (v if not ring.sourced else ring.at_source if v == source else ring.start) for v in vertices}
    better = (lambda a, b: a > b) if ring.maximise else (lambda a, b: a < b)
    changed = True
    while changed:
        changed = False
        for s, d, w, a, e in edges:
            if a <= sid < e and better(new := step(val[s], w), val[d]):
                val[d], changed = new, True
    return val


def random_graph(seed, n=9, m=14, snaps=3):
    rnd = random.Random(seed)
    und = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)} | {(3, 3)})
    rows = []
    for u, v in und:
        a = rnd.choice([0, 0, 0, 1, 2])
        e = rnd.choice([NEVER, NEVER] + [x for x in (1, 2, 3) if x > a])
        for s, d in {(u, v), (v, u)}:
            rows.append((s, d, (s + d) % 5 + 1, a, e))
    return rows


@pytest.mark.parametrize("name", list(SEMIRINGS))
def test_strategies_agree_with_plain_relaxation(spark, name):
    ring, cfg, rows = SEMIRINGS[name], EvolveConfig(snapshots=3, source=0, roots=3, degree_limit=2), random_graph(5)
    edges = spark.createDataFrame(rows, "src long, dst long, w int, snap_a int, snap_d int")
    vs = {s for s, *_ in rows}
    want = {(sid, v): x for sid in range(4) for v, x in plain(rows, ring, 0, sid, vs).items()}
    for plan, f in STRATEGIES.items():
        got = {(r.sid, r.v): r.val for r in f(edges, ring, cfg, Scratch(spark, "t")).collect()}
        assert got == want, plan


def test_rounds_need_no_rows_of_unreached_vertices(spark):
    """The same values from a state of the source alone as from one with a row for each vertex."""
    edges = spark.createDataFrame([(a, b, (a + b) % 7 + 1, 0, 9) for x in ((2, 3), (3, 5), (5, 8), (8, 2), (20, 21)) for a, b in (x, x[::-1])], "src long, dst long, w int, snap_a int, snap_d int")
    for name in ("ssnp", "sswp"):
        ring, scratch = SEMIRINGS[name], Scratch(spark, "t")
        dense = fixpoint.dense_state(evolve.vertices(edges), [0], ring, 2)
        own = dependency.start(evolve.vertices(edges), ring, 2)
        met = lambda df: {(r.v, r.val) for r in df.where(ring.reached(F.col("val"))).collect()}
        want = met(fixpoint.relax(dense, dense, edges, ring, scratch)[0])
        assert {v for v, _ in want} == {2, 3, 5, 8}
        few, roots = dense.where("v = 2"), own.where("v = 2")
        assert met(fixpoint.relax(few, few, edges, ring, scratch)[0]) == want
        assert met(dependency.relax(roots, roots, edges, ring, scratch)) == want == met(dependency.relax(own, own, edges, ring, scratch))


@pytest.mark.parametrize("most", [session.LIGHT, 0])
def test_rounds_leave_out_edges_of_unreached_vertices(spark, monkeypatch, most):
    """Edges of a far component are not read once no new vertex is met; a vertex met later still sends (4 gives 5 nothing before its second value)."""
    monkeypatch.setattr(session, "LIGHT", most)
    near = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (0, 4, 32767), (4, 5, 2), (5, 6, 1)]
    rows = [(s, d, w, 0, NEVER) for s, d, w in near + [(i, i + 1, 1) for i in range(100, 140)]]
    edges = spark.createDataFrame(rows, "src long, dst long, w int, snap_a int, snap_d int")
    vs = spark.createDataFrame([(v,) for v in sorted({x for r in rows for x in r[:2]})], "v long")
    for name in ("viterbi", "sssp"):
        ring, one, two = SEMIRINGS[name], Scratch(spark, "t"), Scratch(spark, "t")
        want = plain(rows, ring, 0, 0, [r.v for r in vs.collect()])
        dense, own = fixpoint.dense_state(vs, [0], ring, 0), dependency.start(vs, ring, 0)
        assert {r.v: r.val for r in fixpoint.relax(dense, dense, edges, ring, one)[0].collect()} == want
        assert {r.v: r.val for r in dependency.relax(own, own, edges, ring, two).collect()} == want
        for scratch in (one, two):
            read = [spark.read.parquet(path) for path in scratch.made if path.endswith("-narrow")]
            assert len(read) == (1 if most else 0)
            assert all({r.src for r in few.collect()} <= set(range(7)) for few in read)


def test_lifetimes_follow_the_ranks(spark):
    """Against ranks of all rows, with equal hashes and more deletions than are worked out side by side."""
    pairs = [(i + 1000003 * j, 50 + i) for i in range(12) for j in range(7)]
    cfg, h = EvolveConfig(snapshots=10, add_percent=3, del_percent=4), lambda seed, e: ((e[0] * 7919 + e[1] * 104729 + seed * 1299709) % 1000003, *e)
    und = [tuple(sorted(x)) for x in pairs]
    base, add, gone = cfg.sizes(len(und))
    want = {e: [max(0, (r - base) // add + 1), NEVER] for r, e in enumerate(sorted(und, key=lambda e: h(cfg.seed, e))) if r < base + 10 * add}
    for s in range(1, 11):
        for e in sorted((e for e, (a, d) in want.items() if a < s < d), key=lambda e: h(cfg.seed + s, e))[:gone]:
            want[e][1] = s
    life = evolve.assign_lifetimes(evolve.canonical(spark.createDataFrame(pairs, "src long, dst long")), cfg, Scratch(spark, "t"))
    assert {(r.u, r.v): [r.snap_a, r.snap_d] for r in life.collect()} == want


def test_absent_source_and_single_snapshot(spark):
    edges = spark.createDataFrame([(1, 2, 1, 0, NEVER), (2, 1, 1, 0, NEVER)], "src long, dst long, w int, snap_a int, snap_d int")
    cfg = EvolveConfig(snapshots=0, source=99, roots=2)
    for plan, f in STRATEGIES.items():
        assert {(r.sid, r.v, r.val) for r in f(edges, SEMIRINGS["bfs"], cfg, Scratch(spark, "t")).collect()} == {(0, 1, INF), (0, 2, INF)}, plan


def test_everything_deleted_resets_values(spark):
    rows = [(0, 1, 1, 0, 1), (1, 0, 1, 0, 1), (1, 2, 1, 0, 1), (2, 1, 1, 0, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long, w int, snap_a int, snap_d int")
    got = STRATEGIES["incremental"](edges, SEMIRINGS["sssp"], EvolveConfig(snapshots=1, source=0), Scratch(spark, "t")).collect()
    assert {(r.sid, r.v): r.val for r in got} == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 0): 0, (1, 1): INF, (1, 2): INF}


def test_forest_has_no_cycles(spark):
    rows = random_graph(11, n=12, m=25)
    edges = spark.createDataFrame(rows, "src long, dst long, w int, snap_a int, snap_d int")
    s = Scratch(spark, "t")
    state = s.cut(dependency.start(evolve.vertices(edges), SEMIRINGS["ssnp"], 0))
    state = dependency.relax(state, state, evolve.snapshot_edges(edges, 0), SEMIRINGS["ssnp"], s)
    parent = {r.v: r.parent for r in state.collect()}
    for v in parent:
        seen = set()
        while v is not None:
            assert v not in seen
            seen.add(v)
            v = parent[v]


def test_lifetimes_sizes_and_bitmap(spark):
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(i, 12)], "src long, dst long")
    cfg = EvolveConfig(snapshots=3)
    life = evolve.assign_lifetimes(evolve.canonical(pairs), cfg, Scratch(spark, "t"))
    base, add, gone = cfg.sizes(78)
    rows = life.collect()
    assert len(rows) == base + 3 * add
    for s in (1, 2, 3):
        assert sum(r.snap_a == s for r in rows) == add
        assert sum(r.snap_d == s for r in rows) == gone
    edges = evolve.symmetrize(life, 50, 3)
    assert edges.where("src = dst").count() == sum(r.u == r.v for r in rows)
    for sid in range(4):
        assert edges.where(bits.alive(sid)).exceptAll(edges.where(bits.bit_alive(sid))).isEmpty()


def test_bitmap_reaches_the_last_bit(spark):
    row = spark.range(1).select(F.lit(0).alias("snap_a"), F.lit(NEVER).alias("snap_d"))
    assert row.select(bits.bitmap(62).alias("b")).first().b == (1 << 63) - 1


def test_config_is_validated():
    for bad in ({"snapshots": 63}, {"add_percent": 101}, {"weight_modulus": 0}):
        with pytest.raises(ValueError):
            EvolveConfig(**bad)


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    sql, qs = queries.oracle_sql(), queries.queries()
    for name in ("canonical_edges", "evolve_edges", "edge_bitmap", "delta_changes", "edge_offsets", "event_succession", "reevaluate_sssp", "dependency_forest", "deleted_tree_vertices", "proxy_graph", "source_bin", "source_wel", "printed_parents", "processing_log", "concurrent_viterbi", "run_el_sssp"):
        df = qs[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
        want = sorted(map(str, con.sql(f"select {','.join(cols)} from ({sql[name]})").fetchall()))
        assert got == want, name


def test_compress_round_trip_and_frontiers(spark):
    state = spark.createDataFrame([(s, v, 5 if v == 1 and s else v) for s in range(3) for v in range(4)], "sid int, v long, val long")
    base = state.where("sid = 0").select("v", "val")
    over = fixpoint.compress(state, base)
    assert over.count() == 2
    assert fixpoint.expand(base, over, [0, 1, 2]).exceptAll(state).isEmpty()
    a, b = state.where("v < 2").select("v"), state.where("v > 0").select("v")
    assert {r.v for r in frontier.mixed(a, b).collect()} == {0, 1, 2, 3}
    assert {r.v for r in frontier.without(a, b).collect()} == {0}


def test_readers_and_writers(spark, tmp_path):
    el, out = tmp_path / "g.el", tmp_path / "g.bin"
    el.write_text("% sym unweighted\n1\t2\n2 1 7\n\n3 3\n")
    edges = read_edges(spark, str(el))
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 2), (2, 1), (3, 3)}
    edgelist.write_binary(edges, str(out), Scratch(spark, "t"))
    assert struct.unpack("<II", out.read_bytes()[:8]) == (4, 2)
    edgelist.register(spark)
    got = spark.read.format("edge_bin").option("splitRows", 1).load(str(out))
    assert got.rdd.getNumPartitions() == 2
    assert {(r.src, r.dst) for r in got.collect()} == {(1, 2), (3, 3)}
    with pytest.raises(ValueError):
        read_edges(spark, "graph.xyz")


def test_distances_beyond_any_short(spark):
    """A chain of heavy edges, and ids near the end of 64 bits."""
    big = 10**15
    rows = [(s, d, 20_000, 0, NEVER) for i in range(6) for s, d in ((big + i, big + i + 1), (big + i + 1, big + i))]
    edges = spark.createDataFrame(rows, "src long, dst long, w int, snap_a int, snap_d int")
    cfg = EvolveConfig(snapshots=1, source=big, roots=2)
    for plan, f in STRATEGIES.items():
        got = {(r.sid, r.v): r.val for r in f(edges, SEMIRINGS["sssp"], cfg, Scratch(spark, "t")).collect()}
        assert got == {(s, big + i): 20_000 * i for s in (0, 1) for i in range(7)}, plan
    hashed = edges.select(bits.edge_hash(999, "src", "dst").alias("h"), "src", "dst").collect()
    assert all(r.h == (r.src * 7919 + r.dst * 104729 + 999 * 1299709) % 1000003 for r in hashed)


def test_a_user_made_ring(spark):
    """Fewest edges of weight 3 on a path."""
    ring = Semiring("threes", False, INF, 0, lambda v, w: v + F.when(w == 3, 1).otherwise(0), "{v} + ({w} = 3)")
    rows = random_graph(3)
    edges = spark.createDataFrame(rows, "src long, dst long, w int, snap_a int, snap_d int")
    want = {(r.sid, r.v): r.val for r in STRATEGIES["reevaluate"](edges, ring, EvolveConfig(snapshots=2, source=0), Scratch(spark, "t")).collect()}
    for plan, f in STRATEGIES.items():
        got = {(r.sid, r.v): r.val for r in f(edges, ring, EvolveConfig(snapshots=2, source=0, roots=2), Scratch(spark, "t")).collect()}
        assert got == want, plan


def test_weights_of_a_file(spark, tmp_path):
    path = tmp_path / "g.wel"
    path.write_text("1 2 9\n2 1 4\n2 3 5\n3 4\n")
    edges = run.evolve_file(spark, str(path), EvolveConfig(snapshots=0, init_percent=100), Scratch(spark, "t"))
    assert {(r.src, r.dst): r.w for r in edges.collect()} == {(1, 2): 4, (2, 1): 4, (2, 3): 5, (3, 2): 5, (3, 4): 8, (4, 3): 8}


def test_results(spark, tmp_path):
    state = spark.createDataFrame([(1, 3), (0, INF)], "v long, val long")
    assert results.render(state) == ["0 INF", "1 3"]
    results.save(state, str(tmp_path / "t"), "text")
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {"1 3", f"0 {INF}"}
    assert results.processing_ms(">>Processing finished in 1.5 (ms).\nx\n>>Processing finished in 2 (ms).") == 3.5


def test_live_query_replays_a_batch(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1)], "src long, dst long, w int")
    live = LiveQuery(spark, SEMIRINGS["bfs"], 0, edges.select(F.col("src").alias("v")).distinct(), edges)
    batch = spark.createDataFrame([("del", 0, 1, 1), ("del", 1, 0, 1), ("add", 0, 5, 1), ("add", 5, 0, 1)], "op string, src long, dst long, w int")
    for _ in range(2):  # a replay overwrites its own version
        live.apply(batch, 0)
        assert {r.v: r.val for r in live.values().collect()} == {0: 0, 1: INF, 2: INF, 5: 1}


@pytest.mark.parametrize("name", ["ssnp", "sswp"])
def test_few_edges_are_relaxed_by_workers(spark, name):
    """The forest of Spark's rounds, ties included, and the values of plain relaxation."""
    ring, rows = SEMIRINGS[name], random_graph(7)
    edges, scratch = spark.createDataFrame(rows, "src long, dst long, w int, snap_a int, snap_d int"), Scratch(spark, "t")
    vs, first = evolve.vertices(edges), evolve.snapshot_edges(edges, 0)
    own = scratch.cut(dependency.start(vs, ring, 0).unionByName(dependency.start(vs, ring, 3).withColumn("k", F.lit(5).cast("long"))))
    slow, fast = (dependency.relax(own, own, first, ring, scratch, few=few).where(ring.reached(F.col("val"))).collect() for few in (False, True))
    assert {tuple(r) for r in slow} == {tuple(r) for r in fast} and len(slow) == len(fast) > 9
    dense = scratch.cut(fixpoint.dense_state(vs, [0, 1, 2, 3], ring, 0))
    got = fixpoint.relax(dense, dense, edges, ring, scratch, few=True)[0].collect()
    assert {(r.sid, r.v): r.val for r in got} == {(sid, v): x for sid in range(4) for v, x in plain(rows, ring, 0, sid, {s for s, *_ in rows}).items()}


@pytest.mark.parametrize("name", ["ssnp", "sswp"])
def test_proxy_needs_no_job_per_round(spark, name):
    """A long path of light edges beside heavy shortcuts, and a far component of higher degree."""
    und = [(i, i + 1, 1 + i % 2, 0, 2 if i % 9 == 8 else NEVER) for i in range(60)] + [(0, i, 40, i % 3, NEVER) for i in range(3, 6)]
    und += [(100, i, 5, 0, NEVER) for i in range(101, 115)]
    rows = [x for s, d, *more in und for x in ((s, d, *more), (d, s, *more))]
    edges = spark.createDataFrame(rows, "src long, dst long, w int, snap_a int, snap_d int")
    vs, cfg, ring, scratch = {s for s, *_ in rows}, EvolveConfig(snapshots=2, source=30, roots=2, degree_limit=2), SEMIRINGS[name], Scratch(spark, "t")
    got = {(r.sid, r.v): r.val for r in STRATEGIES["proxy"](edges, ring, cfg, scratch).collect()}
    assert got == {(sid, v): x for sid in range(3) for v, x in plain(rows, ring, 30, sid, vs).items()}
    assert not any("-round1" in p or "-dep" in p for p in scratch.made)
