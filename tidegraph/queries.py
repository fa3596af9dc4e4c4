"""One query per operator and strategy, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph import run
from tidegraph.functions import bits
from tidegraph.functions.semiring import SEMIRINGS
from tidegraph.operators import dependency, evolve, fixpoint, frontier
from tidegraph.plans import STRATEGIES, proxy
from tidegraph.plans.graphs import CONFIG, event_succession, evolving, supplier_part
from tidegraph.session import Scratch
from tidegraph.sources import edgelist, read_edges, results
from tidegraph.streaming.changes import LiveQuery, change_stream

S = CONFIG.snapshots
Query = Callable[[SparkSession, str], DataFrame]


# --- SQL -----------------------------------------------------------------------------------

_H = "(u * 7919 + v * 104729 + {seed} * 1299709) % 1000003, u, v"


def _life_sql() -> str:
    base, add, gone = CONFIG.init_percent, CONFIG.add_percent, CONFIG.del_percent
    steps = [
        "pairs AS (SELECT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem)",
        "und AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM pairs)",
        f"n AS (SELECT CAST(floor(count(*) * {base} / 100) AS BIGINT) AS base, CAST(floor(count(*) * {add} / 100) AS BIGINT) AS add, CAST(floor(count(*) * {gone} / 100) AS BIGINT) AS gone FROM und)",
        f"ranked AS (SELECT u, v, row_number() OVER (ORDER BY {_H.format(seed=CONFIG.seed)}) - 1 AS r FROM und)",
        f"life0 AS (SELECT u, v, CAST(CASE WHEN r < base THEN 0 ELSE (r - base) // add + 1 END AS INTEGER) AS snap_a, 2147483647 AS snap_d FROM ranked, n WHERE r < base + {S} * add)",
    ]
    for s in range(1, S + 1):
        there = f"(snap_a < {s} AND snap_d > {s})"
        steps.append(
            f"life{s} AS (SELECT u, v, snap_a, CASE WHEN {there} AND row_number() OVER (PARTITION BY {there} ORDER BY {_H.format(seed=CONFIG.seed + s)}) <= gone THEN {s} ELSE snap_d END AS snap_d FROM life{s - 1}, n)"
        )
    steps.append(f"life AS (SELECT u, v, snap_a, snap_d FROM life{S})")
    steps.append(
        "e AS (SELECT u AS src, v AS dst, CAST((u + v) % 50 + 1 AS INTEGER) AS w, snap_a, snap_d FROM life UNION ALL SELECT v, u, CAST((u + v) % 50 + 1 AS INTEGER), snap_a, snap_d FROM life WHERE u <> v)"
    )
    return ",\n".join(steps)


LIFE = _life_sql()


#: What SQL writes for vertices that nothing reaches and, for the widest path, at the source.
FAR = 4611686018427387904


def _reached(name: str) -> str:
    """WITH clauses up to r (sid, v, val): rows of reached vertices alone, so no value stands for "unreached" in the recursion."""
    ring = SEMIRINGS[name]
    agg, cmp = ("max", ">") if ring.maximise else ("min", "<")
    at_source = {"sssp": 0, "ssnp": 0, "bfs": 0, "sswp": FAR, "viterbi": 32767}.get(name)
    first = "SELECT sid, v, CAST(v AS BIGINT) FROM grid" if at_source is None else f"SELECT sid, v, CAST({at_source} AS BIGINT) FROM grid WHERE v = {CONFIG.source}"
    value = ring.sql.format(v="r.val", w="e.w")
    return f"""WITH RECURSIVE {LIFE},
grid AS (SELECT CAST(s.sid AS INTEGER) AS sid, vs.v FROM (SELECT DISTINCT src AS v FROM e) vs, range({S + 1}) AS s(sid)),
r(sid, v, val) USING KEY (sid, v) AS (
  {first}
  UNION
  SELECT c.sid, c.v, c.val FROM (
    SELECT r.sid AS sid, e.dst AS v, CAST({agg}({value}) AS BIGINT) AS val FROM r JOIN e ON e.src = r.v AND e.snap_a <= r.sid AND r.sid < e.snap_d GROUP BY r.sid, e.dst
  ) c LEFT JOIN recurring.r AS old ON old.sid = c.sid AND old.v = c.v WHERE old.val IS NULL OR c.val {cmp} old.val
)"""


def _fixpoint_sql(name: str) -> str:
    missing = 0 if SEMIRINGS[name].maximise else FAR
    return f"""{_reached(name)}
SELECT g.sid, g.v, coalesce(r.val, {missing}) AS val FROM grid g LEFT JOIN r ON r.sid = g.sid AND r.v = g.v"""


# --- queries ---------------------------------------------------------------------------------


def _strategy(plan: str, ring: str) -> Query:
    return lambda spark, d: STRATEGIES[plan](evolving(spark, d), SEMIRINGS[ring], CONFIG, Scratch(spark, f"{plan}-{ring}"))


def _state(spark: SparkSession, d: str, ring: str = "sssp") -> DataFrame:
    return STRATEGIES["reevaluate"](evolving(spark, d), SEMIRINGS[ring], CONFIG, Scratch(spark, f"state-{ring}"))


def _stream(spark: SparkSession, d: str, ring: str) -> DataFrame:
    """A query kept current over the change rows of every snapshot, one micro-batch per snapshot."""
    edges, ring, scratch = evolving(spark, d), SEMIRINGS[ring], Scratch(spark, "stream")
    rows, path = evolve.changes(edges, S), f"{scratch.root}/changes"
    for s in range(1, S + 1):
        rows.where(F.col("sid") == s).coalesce(1).write.mode("append").parquet(path)
    live = LiveQuery(spark, ring, CONFIG.source, evolve.vertices(edges), evolve.snapshot_edges(edges, 0))
    live.run(change_stream(spark, path))
    parts = [live.values(s - 1).select(F.lit(s).alias("sid"), "v", "val") for s in range(S + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _incidence(spark: SparkSession, d: str) -> DataFrame:
    return frontier.edge_offsets(evolve.out_degree(evolving(spark, d)))


def _compressed(spark: SparkSession, d: str) -> DataFrame:
    state = _state(spark, d)
    base = state.where("sid = 0").select("v", "val")
    return fixpoint.compress(state, base)


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "amva")
    state = _state(spark, d)
    base = state.where("sid = 0").select("v", "val")
    return fixpoint.expand(base, scratch.cut(fixpoint.compress(state, base)), list(range(S + 1)))


def _one_relax(spark: SparkSession, d: str) -> DataFrame:
    """The first round alone: what the source sends in each snapshot."""
    edges, ring = evolving(spark, d), SEMIRINGS["sssp"]
    state = fixpoint.dense_state(evolve.vertices(edges), list(range(S + 1)), ring, CONFIG.source)
    return fixpoint.candidates(state.where("val = 0"), edges, ring)


def _cut_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Vertices whose edge to their parent in the BFS forest of snapshot 0 is deleted in snapshot 1."""
    edges, ring, scratch = evolving(spark, d), SEMIRINGS["bfs"], Scratch(spark, "cut")
    state = scratch.cut(dependency.start(evolve.vertices(edges), ring, CONFIG.source), "init")
    state = dependency.relax(state, state, evolve.snapshot_edges(edges, 0), ring, scratch)
    gone = edges.where("snap_d = 1 and snap_a < 1")
    return dependency.cut_by(gone, state).select("v")


def _forest(spark: SparkSession, d: str) -> DataFrame:
    edges, ring, scratch = evolving(spark, d), SEMIRINGS["bfs"], Scratch(spark, "forest")
    state = scratch.cut(dependency.start(evolve.vertices(edges), ring, CONFIG.source), "init")
    return dependency.relax(state, state, evolve.snapshot_edges(edges, 0), ring, scratch).select("v", "val", "level", "parent")


def _proxy_edges(spark: SparkSession, d: str) -> DataFrame:
    return proxy.proxy_edges(evolving(spark, d), SEMIRINGS["bfs"], CONFIG, Scratch(spark, "proxy"))


def _bounded(spark: SparkSession, d: str) -> DataFrame:
    """Edges that survive the bound test against converged BFS values: none can improve all, few remain."""
    return proxy.bounded_edges(evolving(spark, d), _state(spark, d, "bfs"), SEMIRINGS["bfs"]).select("src", "dst", "w", "snap_a", "snap_d")


def _file(spark: SparkSession, d: str, kind: str) -> str:
    """The canonical supplier-part edges as a file of this kind."""
    scratch = Scratch(spark, "files")
    path = f"{scratch.root}/graph.{kind}"
    edges = evolve.canonical(supplier_part(spark, d)).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    if kind == "bin":
        edgelist.write_binary(edges, path, scratch)
    elif kind == "parquet":
        edges.write.parquet(path)
    else:
        edgelist.write_text(edges.withColumn("w", (F.col("src") % 7 + 1).cast("int")) if kind == "wel" else edges, path)
    return path


def _from_file(kind: str) -> Query:
    return lambda spark, d: read_edges(spark, _file(spark, d, kind))


def _run(kind: str, strategy: str, algorithm: str) -> Query:
    """File, lifetimes, strategy, sink: what the command line does; the result is read back from the sink."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        out = f"{Scratch(spark, 'sink').root}/out"
        run.run(spark, run.parser().parse_args(["--input", _file(spark, d, kind), "--output", out, "--format", "text", "--strategy", strategy, "--algorithm", algorithm]))
        part = F.split("value", " ")
        return spark.read.text(out).select(part[0].cast("int").alias("sid"), part[1].cast("long").alias("v"), part[2].cast("long").alias("val"))

    return query


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return results.lines(_forest(spark, d), "parent")


def _log(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    said = F.concat(F.lit(">>Processing finished in "), (F.col("event_id") % 97).cast("string"), F.lit(".5 (ms)."))
    return results.processing_total(events.select(F.when(F.col("event_id") % 3 == 0, F.lit("Total Analysis Time: 7 (ms).")).otherwise(said).alias("value")))


def _formats(spark: SparkSession, d: str) -> DataFrame:
    names = ("a.el", "b.WEL", "c.bin", "dir.x/plain", "e.wcsr", "f.tar.bwcsr")
    return spark.createDataFrame([(n, edgelist.extension(n), edgelist.is_weighted(n)) for n in names], "name string, extension string, weighted boolean")


def _near(spark: SparkSession, d: str, far: bool) -> DataFrame:
    return frontier.near_far(frontier.active(_state(spark, d), SEMIRINGS["sssp"]), 12)[far]


def _fronts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = evolve.affected_vertices(evolve.changes(evolving(spark, d), S))
    return tuple(rows.where(F.col("sid") == s).select("v") for s in (1, 2))


#: The affected vertices of snapshots 1 and 2 in SQL.
_FRONTS = f"WITH {LIFE}, x AS (SELECT DISTINCT sid, v FROM (SELECT snap_a AS sid, dst AS v FROM e UNION ALL SELECT snap_d, dst FROM e)), a AS (SELECT v FROM x WHERE sid = 1), b AS (SELECT v FROM x WHERE sid = 2)"

#: BFS levels of snapshot 0 from vertices (k), and each vertex's parent: the smallest one a level below.
_TREES = """t(k, v, lvl) USING KEY (k, v) AS (
  SELECT k, k, 0 FROM roots
  UNION
  SELECT c.k, c.v, c.lvl FROM (SELECT t.k AS k, b0.dst AS v, min(t.lvl) + 1 AS lvl FROM t JOIN b0 ON b0.src = t.v GROUP BY t.k, b0.dst) c
  LEFT JOIN recurring.t AS old ON old.k = c.k AND old.v = c.v WHERE old.lvl IS NULL OR c.lvl < old.lvl
),
par AS (SELECT t.k, t.v, min(p.v) AS parent FROM t JOIN b0 ON b0.dst = t.v JOIN t p ON p.k = t.k AND p.v = b0.src AND p.lvl + 1 = t.lvl GROUP BY 1, 2)"""
_B0 = "b0 AS (SELECT src, dst FROM e WHERE snap_a <= 0 AND snap_d > 0)"
_CUT_SQL = f"""WITH RECURSIVE {LIFE}, {_B0}, roots AS (SELECT {CONFIG.source} AS k), {_TREES}
SELECT DISTINCT CAST(par.v AS BIGINT) AS v FROM par JOIN e ON e.src = par.parent AND e.dst = par.v WHERE e.snap_d = 1 AND e.snap_a < 1"""
_PARENTS_SQL = f"""WITH RECURSIVE {LIFE}, {_B0}, roots AS (SELECT {CONFIG.source} AS k), {_TREES}
SELECT vs.v, vs.v || ' ' || coalesce(CAST(parent AS VARCHAR), 'none') AS line FROM (SELECT DISTINCT src AS v FROM e) vs LEFT JOIN par ON par.v = vs.v ORDER BY vs.v LIMIT 30"""
_PROXY_SQL = f"""WITH RECURSIVE {LIFE}, {_B0}, roots AS (SELECT src AS k FROM e GROUP BY 1 ORDER BY count(*) DESC, src LIMIT {CONFIG.roots}), {_TREES},
links AS (SELECT parent AS src, v AS dst FROM par UNION SELECT v, parent FROM par),
orphans AS (SELECT DISTINCT src AS v FROM e WHERE src NOT IN (SELECT v FROM par)),
hubs AS (SELECT src AS v FROM e GROUP BY 1 HAVING count(*) > {CONFIG.degree_limit}),
added AS (SELECT * FROM e WHERE snap_a > 0 AND snap_a <= {S})
SELECT src, dst, w, snap_a, snap_d FROM e JOIN links USING (src, dst)
UNION SELECT * FROM added WHERE src IN (SELECT v FROM hubs) AND dst IN (SELECT v FROM hubs)
UNION SELECT * FROM added WHERE src IN (SELECT v FROM orphans) OR dst IN (SELECT v FROM orphans)"""
_UND = "(SELECT DISTINCT least(l_suppkey * 2, l_partkey * 2 + 1) AS src, greatest(l_suppkey * 2, l_partkey * 2 + 1) AS dst FROM lineitem)"

_E = "src, dst, w, snap_a, snap_d"

#: name -> (query, SQL or None)
OPERATORS: dict[str, tuple[Query, str | None]] = {
    "canonical_edges": (lambda s, d: evolve.canonical(supplier_part(s, d)), "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem)"),
    "evolve_edges": (lambda s, d: evolving(s, d).select("src", "dst", "w", "snap_a", "snap_d"), f"WITH {LIFE} SELECT {_E} FROM e"),
    "edge_bitmap": (
        lambda s, d: evolving(s, d).select("src", "dst", "bitmap"),
        f"WITH {LIFE} SELECT src, dst, CAST((1::BIGINT << least(snap_d, {S + 1})) - (1::BIGINT << snap_a) AS BIGINT) AS bitmap FROM e",
    ),
    "common_graph_edges": (lambda s, d: evolve.common_edges(evolving(s, d), S).select("src", "dst", "w"), f"WITH {LIFE} SELECT src, dst, w FROM e WHERE snap_a = 0 AND snap_d > {S}"),
    "common_by_bitmap": (lambda s, d: evolving(s, d).where(bits.all_alive(S)).select("src", "dst", "w"), f"WITH {LIFE} SELECT src, dst, w FROM e WHERE snap_a = 0 AND snap_d > {S}"),
    "noncommon_edges": (lambda s, d: evolve.noncommon_edges(evolving(s, d), S).select("src", "dst", "snap_a", "snap_d"), f"WITH {LIFE} SELECT src, dst, snap_a, snap_d FROM e WHERE NOT (snap_a = 0 AND snap_d > {S})"),
    "snapshot_edges": (lambda s, d: evolve.snapshot_edges(evolving(s, d), 2).select("src", "dst", "w"), f"WITH {LIFE} SELECT src, dst, w FROM e WHERE snap_a <= 2 AND snap_d > 2"),
    "snapshot_by_bitmap": (lambda s, d: evolving(s, d).where(bits.bit_alive(3)).select("src", "dst", "w"), f"WITH {LIFE} SELECT src, dst, w FROM e WHERE snap_a <= 3 AND snap_d > 3"),
    "snapshot_counts": (lambda s, d: evolve.snapshot_counts(evolving(s, d), S), f"WITH {LIFE} SELECT CAST(sid AS INTEGER) AS sid, count(*) AS edges FROM e, range({S + 1}) AS s(sid) WHERE snap_a <= sid AND sid < snap_d GROUP BY 1"),
    "delta_changes": (
        lambda s, d: evolve.changes(evolving(s, d), S),
        f"WITH {LIFE} SELECT snap_a AS sid, 'add' AS op, src, dst, w FROM e WHERE snap_a BETWEEN 1 AND {S} UNION ALL SELECT snap_d, 'del', src, dst, w FROM e WHERE snap_d BETWEEN 1 AND {S}",
    ),
    "affected_vertices": (
        lambda s, d: evolve.affected_vertices(evolve.changes(evolving(s, d), S)),
        f"WITH {LIFE} SELECT DISTINCT sid, v FROM (SELECT snap_a AS sid, dst AS v FROM e UNION ALL SELECT snap_d, dst FROM e) WHERE sid BETWEEN 1 AND {S}",
    ),
    "out_degree": (lambda s, d: evolve.out_degree(evolving(s, d)), f"WITH {LIFE} SELECT src AS v, count(*) AS degree FROM e GROUP BY 1"),
    "top_degree": (lambda s, d: evolve.top_degree(evolving(s, d)), f"WITH {LIFE} SELECT src AS v, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, v LIMIT 10"),
    "edge_offsets": (_incidence, f"WITH {LIFE} SELECT v, degree, CAST(sum(degree) OVER (ORDER BY v) - degree AS BIGINT) AS start FROM (SELECT src AS v, count(*) AS degree FROM e GROUP BY 1)"),
    "active_edges": (
        lambda s, d: frontier.active_edges(evolving(s, d), evolve.top_degree(evolving(s, d)).select("v")).select("src", "dst"),
        f"WITH {LIFE}, top AS (SELECT src AS v FROM e GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 10) SELECT src, dst FROM e WHERE src IN (SELECT v FROM top)",
    ),
    "relax_once": (_one_relax, f"WITH {LIFE} SELECT CAST(sid AS INTEGER) AS sid, dst AS v, CAST(min(w) AS BIGINT) AS new FROM e, range({S + 1}) AS s(sid) WHERE src = {CONFIG.source} AND snap_a <= sid AND sid < snap_d GROUP BY 1, 2"),
    "state_min_max": (lambda s, d: fixpoint.min_max(_state(s, d)), f"WITH f AS ({_fixpoint_sql('sssp')}) SELECT v, min(val) AS lo, max(val) AS hi FROM f GROUP BY v"),
    "state_settled": (lambda s, d: fixpoint.settled(_state(s, d)), f"WITH f AS ({_fixpoint_sql('sssp')}) SELECT v, min(val) AS val FROM f GROUP BY v HAVING min(val) = max(val)"),
    "state_overrides": (_compressed, f"WITH f AS ({_fixpoint_sql('sssp')}) SELECT a.sid, a.v, a.val FROM f a JOIN f b ON a.v = b.v AND b.sid = 0 WHERE a.val <> b.val"),
    "state_expanded": (_expanded, _fixpoint_sql("sssp")),
    "active_vertices": (lambda s, d: frontier.active(_state(s, d, "sswp"), SEMIRINGS["sswp"]), f"WITH f AS ({_fixpoint_sql('sswp')}) SELECT sid, v, val FROM f WHERE val <> 0"),
    "light_edges": (
        lambda s, d: proxy.light_edges(evolving(s, d)).select("src", "dst", "w"),
        f"WITH {LIFE}, f AS (SELECT * FROM e WHERE snap_a <= 0 AND snap_d > 0) SELECT src, dst, w FROM f WHERE w <= (SELECT quantile_disc(w, 0.1) FROM f)",
    ),
    "random_edges": (lambda s, d: proxy.random_edges(evolving(s, d)).select("src", "dst", "w"), f"WITH {LIFE} SELECT src, dst, w FROM e WHERE (least(src, dst) * 7919 + greatest(src, dst) * 104729 + 7 * 1299709) % 1000003 < 100000"),
    "event_succession": (
        event_succession,
        """WITH p AS (SELECT user_id AS a, lag(user_id) OVER (ORDER BY ts, event_id) AS b, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events WHERE ts IS NOT NULL)
SELECT least(a, b) AS u, greatest(a, b) AS v, CAST(floor(min(d) / 6) AS INTEGER) AS snap_a, CAST(floor(max(d) / 6) + 1 AS INTEGER) AS snap_d FROM p WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2""",
    ),
    "dependency_forest": (
        _forest,
        f"""WITH f AS ({_fixpoint_sql('bfs')}), {LIFE.replace('e AS (', 'e AS (')}
SELECT f.v, f.val, CASE WHEN f.val = {FAR} THEN 2147483646 ELSE CAST(f.val AS INTEGER) END AS level, (SELECT min(e.src) FROM e JOIN f g ON g.sid = 0 AND g.v = e.src WHERE e.dst = f.v AND e.snap_a = 0 AND g.val < {FAR} AND g.val + 1 = f.val) AS parent FROM f WHERE f.sid = 0""",
    ),
    "bound_pruned_edges": (
        _bounded,
        f"""WITH f AS ({_fixpoint_sql('bfs')}), {LIFE}, m AS (SELECT v, min(val) AS lo, max(val) AS hi FROM f GROUP BY v)
SELECT src, dst, w, snap_a, snap_d FROM e JOIN m a ON a.v = src JOIN m b ON b.v = dst WHERE a.lo + 1 < b.hi""",
    ),
    "deleted_tree_vertices": (_cut_vertices, _CUT_SQL),
    "proxy_graph": (_proxy_edges, _PROXY_SQL),
    "hub_hint": (
        lambda s, d: proxy.hub_hint(evolving(s, d), proxy.random_edges(evolving(s, d), 0.002)),
        f"""WITH {LIFE}, core AS (SELECT src, dst FROM e WHERE (least(src, dst) * 7919 + greatest(src, dst) * 104729 + 7 * 1299709) % 1000003 < 2000)
SELECT src AS v, count(*) AS degree FROM e WHERE src NOT IN (SELECT src FROM core) AND (SELECT count(*) FROM core) < 0.05 * (SELECT count(*) FROM e WHERE snap_a <= 0 AND snap_d > 0) GROUP BY 1 ORDER BY degree DESC, v LIMIT 1""",
    ),
    "vertex_ranges": (
        lambda s, d: frontier.vertex_ranges(evolve.out_degree(evolving(s, d)), 5_000),
        f"""WITH {LIFE}, o AS (SELECT v, degree, sum(degree) OVER (ORDER BY v) - degree AS start FROM (SELECT src AS v, count(*) AS degree FROM e GROUP BY 1))
SELECT CAST(start // 5000 AS BIGINT) AS part, min(v) AS first, max(v) AS last, CAST(sum(degree) AS BIGINT) AS edges FROM o GROUP BY 1""",
    ),
    "frontier_near": (lambda s, d: _near(s, d, False), f"WITH f AS ({_fixpoint_sql('sssp')}) SELECT sid, v, val FROM f WHERE val <= 12"),
    "frontier_far": (lambda s, d: _near(s, d, True), f"WITH f AS ({_fixpoint_sql('sssp')}) SELECT sid, v, val FROM f WHERE val > 12 AND val < {FAR}"),
    "frontier_mixed": (lambda s, d: frontier.mixed(*_fronts(s, d)), f"{_FRONTS} SELECT v FROM a UNION SELECT v FROM b"),
    "frontier_without": (lambda s, d: frontier.without(*_fronts(s, d)), f"{_FRONTS} SELECT v FROM a EXCEPT SELECT v FROM b"),
    "frontier_total": (lambda s, d: frontier.total(evolve.affected_vertices(evolve.changes(evolving(s, d), S))), f"{_FRONTS} SELECT DISTINCT v FROM x WHERE sid BETWEEN 1 AND {S}"),
    "source_bin": (_from_file("bin"), f"SELECT src, dst FROM {_UND}"),
    "source_el": (_from_file("el"), f"SELECT src, dst FROM {_UND}"),
    "source_wel": (_from_file("wel"), f"SELECT src, dst, CAST(src % 7 + 1 AS INTEGER) AS w FROM {_UND}"),
    "source_parquet": (_from_file("parquet"), f"SELECT src, dst FROM {_UND}"),
    "file_formats": (_formats, "SELECT * FROM (VALUES ('a.el', 'el', false), ('b.WEL', 'wel', true), ('c.bin', 'bin', false), ('dir.x/plain', '', false), ('e.wcsr', 'wcsr', true), ('f.tar.bwcsr', 'bwcsr', true)) AS t(name, extension, weighted)"),
    "printed_results": (
        lambda s, d: results.lines(_state(s, d, "bfs").where("sid = 0")),
        f"WITH f AS ({_fixpoint_sql('bfs')}) SELECT v, v || ' ' || CASE WHEN val = {FAR} THEN 'INF' ELSE CAST(val AS VARCHAR) END AS line FROM f WHERE sid = 0 ORDER BY v LIMIT 30",
    ),
    "printed_parents": (_parents, _PARENTS_SQL),
    "processing_log": (_log, "SELECT CAST(sum(event_id % 97 + 0.5) AS DOUBLE) AS ms FROM events WHERE event_id % 3 <> 0"),
    "run_el_sssp": (_run("el", "commongraph", "sssp"), _fixpoint_sql("sssp")),
    "run_bin_sswp": (_run("bin", "reevaluate", "sswp"), _fixpoint_sql("sswp")),
} | {f"stream_{ring}": ((lambda s, d, r=ring: _stream(s, d, r)), _fixpoint_sql(ring)) for ring in SEMIRINGS}


def queries() -> dict[str, Query]:
    out = {name: q for name, (q, _) in OPERATORS.items()}
    out |= {f"{plan}_{ring}": _strategy(plan, ring) for plan in STRATEGIES for ring in SEMIRINGS}
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in OPERATORS.items() if sql}
    out |= {f"{plan}_{ring}": _fixpoint_sql(ring) for plan in STRATEGIES for ring in SEMIRINGS}
    return out
