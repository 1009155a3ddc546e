"""Pairwise tables, networks and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .filters import drop_weak


def cov_to_cor(cov: DataFrame) -> DataFrame:
    """Long (i, j, cov) to (i, j, cor)."""
    diag = cov.where("i = j")
    di = diag.select("i", F.col("cov").alias("_vi"))
    dj = diag.select("j", F.col("cov").alias("_vj"))
    return cov.join(di, "i").join(dj, "j").select("i", "j", (F.col("cov") / F.sqrt(F.col("_vi") * F.col("_vj"))).alias("cor"))


def unordered_pairs(df: DataFrame, a: str = "name", b: str = "variable") -> DataFrame:
    return df.where(F.col(a) < F.col(b))


def threshold_edges(pairs: DataFrame, eps: float = 0.01, a: str = "name", b: str = "variable", value: str = "value") -> DataFrame:
    """Positive pairs of at least eps as weighted undirected edges (src < dst)."""
    kept = drop_weak(unordered_pairs(pairs, a, b), eps, a, b, value).where(F.col(value) > 0)
    return kept.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(value).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols)
    return edges.select("src", "dst", *cols).unionByName(back)


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex that can be reached.

    Each round points every vertex at the least of itself and its neighbours,
    follows the pointers to their ends, and puts the ends in the place of the
    vertices.  Pointers only go down, so an end is the least vertex of its tree;
    edges within a tree are dropped, so what is left shrinks by round.
    """
    links, roots = materialize(edges.select("src", "dst"), "links"), None
    while True:
        near = both_ways(links).groupBy(F.col("src").alias("vertex")).agg(F.min("dst").alias("_near"))
        ends = _ends(materialize(near.select("vertex", F.least("vertex", "_near").alias("component")), "hook"))
        at = lambda c: ends.toDF(c, f"_{c}")
        between = links.join(at("src"), "src").select("_src", "dst").join(at("dst"), "dst").where("_src <> _dst")
        rest = between.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).distinct()
        rest = materialize(rest, "links")
        discard(links)
        links = rest
        if roots is None:
            roots = ends
        else:
            after = roots.join(ends.toDF("component", "_c"), "component", "left").select("vertex", F.coalesce("_c", "component").alias("component"))
            after = materialize(after, "labels")
            discard(roots, ends)
            roots = after
        if links.isEmpty():
            discard(links)
            return roots


def _ends(trees: DataFrame) -> DataFrame:
    """Pointers (vertex, component) followed to their ends, twice as far in each round; the input is dropped."""
    while True:
        jump = trees.select(F.col("vertex").alias("component"), F.col("component").alias("_next"))
        after = materialize(trees.join(jump, "component").select("vertex", F.col("_next").alias("component"), F.col("component").alias("_old")), "jump")
        still = after.where(F.col("component") != F.col("_old")).isEmpty()
        discard(trees)
        trees = after.select("vertex", "component")
        trees.scratch_path = after.scratch_path
        if still:
            return trees


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most vertices (ties: smallest label)."""
    edges = materialize(edges, "edges")
    comp = connected_components(edges)
    best = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    keep = comp.join(best, "component", "left_semi").select(F.col("vertex").alias("src"))
    return edges.join(keep, "src", "left_semi")


def modularity(links: DataFrame, verts: DataFrame, labels: DataFrame) -> float:
    """Modularity of a partition: ``links`` both ways (src, dst, weight), ``verts`` (vertex, k, loop), ``labels`` (vertex, community)."""
    one, two = labels.toDF("src", "_a"), labels.toDF("dst", "_b")
    inside = links.join(one, "src").join(two, "dst").where("_a = _b").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    sizes = verts.join(labels, "vertex").groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
    tot = sizes.agg(F.sum("k").alias("m2"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.sum("loop").alias("loop"))
    r = tot.withColumn("w", inside.scalar()).first()
    return (r["w"] + 2 * r["loop"]) / r["m2"] - r["sq"] / r["m2"] ** 2 if r["m2"] else 0.0


def _options(links: DataFrame, verts: DataFrame, labels: DataFrame, m2: float) -> DataFrame:
    """Per vertex its community, the neighbouring one of largest gain, the rise of that move, and what its own adds to modularity."""
    sizes = labels.join(verts, "vertex").groupBy("community").agg(F.sum("k").alias("tot"))
    to = links.join(labels.withColumnRenamed("vertex", "dst"), "dst").select(F.col("src").alias("vertex"), "community", F.col("weight").alias("w"))
    own = labels.select("vertex", "community", F.lit(0.0).alias("w"))
    options = to.unionByName(own).groupBy("vertex", "community").agg(F.sum("w").alias("w"))
    options = options.join(sizes, "community").join(verts.select("vertex", "k"), "vertex")
    options = options.join(labels.withColumnRenamed("community", "_now"), "vertex")
    here = F.col("community") == F.col("_now")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)) / m2
    options = options.withColumn("_gain", gain)
    at = lambda c: F.max(F.when(here, c))
    return options.groupBy("vertex", F.col("_now").alias("community")).agg(
        F.min_by("community", F.struct(-F.round("_gain", 9), F.col("community"))).alias("to"),
        (F.max("_gain") - at(F.col("_gain"))).alias("rise"), (at(F.col("w")) / m2 - at(F.col("k") * F.col("tot")) / m2**2).alias("q"),
    )


def _local_moves(links: DataFrame, verts: DataFrame) -> tuple[DataFrame, bool]:
    """Labels from which no single move raises modularity, and whether any differ from the vertices.

    In a pass half of the vertices (by hash and pass) may move to the
    neighbouring community of largest gain.  Moves that are good alone may be
    bad together: a pass that does not raise modularity is replaced by its best
    single move.  So modularity rises with every pass, and the passes end.  A
    pass is one written table and one row of sums.
    """
    m2 = verts.agg(F.sum("k")).first()[0]
    if not m2:
        return verts.select("vertex", F.col("vertex").alias("community")), False
    good = (F.col("to") != F.col("community")) & (F.col("rise") > 1e-9)

    def tried(labels: DataFrame) -> tuple[DataFrame, object]:
        best = materialize(_options(links, verts, labels, m2), "moves")
        half = F.pmod(F.xxhash64("vertex"), F.lit(2))
        sums = best.agg(
            F.sum("q").alias("q"), F.count_if(good & (half == 0)).alias("n0"), F.count_if(good & (half == 1)).alias("n1"),
            F.max_by("vertex", F.when(good, F.struct("rise", "vertex"))).alias("top"),
        )
        return best, sums.first()

    def labels_of(best: DataFrame, pick=None) -> DataFrame:
        return best.select("vertex", F.col("community") if pick is None else F.when(pick, F.col("to")).otherwise(F.col("community")).alias("community"))

    best, now = tried(verts.select("vertex", F.col("vertex").alias("community")))
    moved, turn = False, 0
    while now["n0"] or now["n1"]:
        side = turn % 2 if now[f"n{turn % 2}"] else 1 - turn % 2
        for pick in (good & (F.pmod(F.xxhash64("vertex"), F.lit(2)) == side), F.col("vertex") == F.lit(now["top"])):
            after, found = tried(labels_of(best, pick))
            if found["q"] > now["q"]:
                break
            discard(after)
        else:  # no more than rounding is left
            break
        discard(best)
        best, now, moved, turn = after, found, True, turn + 1
    return labels_of(best), moved


def communities(edges: DataFrame) -> DataFrame:
    """(vertex, community) of high modularity, by moves of vertices, then of whole communities.

    When no move of a single vertex raises modularity, communities become
    vertices with self loops, and moves go on between them, until a level moves
    nothing.  A community is named by its smallest vertex; ties go to the
    smallest label.
    """
    links = materialize(both_ways(edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))), "links")
    verts = materialize(links.groupBy(F.col("src").alias("vertex")).agg(F.sum("weight").alias("k")).withColumn("loop", F.lit(0.0)), "verts")
    members = verts.select("vertex", F.col("vertex").alias("at"))
    old = []
    while True:
        labels, moved = _local_moves(links, verts)
        if not moved:
            break
        members = materialize(members.join(labels.toDF("at", "_c"), "at").select("vertex", F.col("_c").alias("at")), "members")
        between = links.join(labels.toDF("src", "_a"), "src").join(labels.toDF("dst", "_b"), "dst").groupBy("_a", "_b").agg(F.sum("weight").alias("weight"))
        between = materialize(between, "between")
        loops = between.where("_a = _b").select(F.col("_a").alias("community"), (F.col("weight") / 2).alias("_in"))
        sums = verts.join(labels, "vertex").groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("_loop"))
        merged = sums.join(loops, "community", "left").select(F.col("community").alias("vertex"), "k", (F.col("_loop") + F.coalesce("_in", F.lit(0.0))).alias("loop"))
        verts_next = materialize(merged, "verts")
        links_next = materialize(between.where("_a <> _b").toDF("src", "dst", "weight"), "links")
        discard(links, verts, between, *old)
        old = [members]
        links, verts = links_next, verts_next
    names = members.groupBy("at").agg(F.min("vertex").alias("community"))
    return members.join(names, "at").select("vertex", "community")


# Rows of sources times edges that betweenness handles at once.
BLOCK_ROWS = 50_000_000


def betweenness(edges: DataFrame, weighted: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vertex, betweenness) of an undirected network; weights are distances.

    Sources are taken in blocks of about ``block_rows`` rows of source and edge,
    one after the other; a block's tables are dropped before the next begins.
    Weights must be positive, so that relaxing ends after as many rounds as
    there are vertices, at most.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    links = materialize(both_ways(edges.select("src", "dst", w.cast("double").alias("weight"))), "links")
    if not links.where(~(F.col("weight") > 0)).isEmpty():
        raise ValueError("weights must be positive")
    verts = materialize(links.select(F.col("src").alias("v")).distinct(), "verts")
    blocks = max(1, -(-verts.count() * links.count() // block_rows))
    total = None
    for b in range(blocks):
        sums = _from_sources(links, verts.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == b))
        both = sums if total is None else total.unionByName(sums).groupBy("v").agg(F.sum("t").alias("t"))
        after = materialize(both, "betweenness")
        discard(sums, *([total] if total is not None else []))
        total = after
    return verts.join(total, "v", "left").select(F.col("v").alias("vertex"), (F.coalesce("t", F.lit(0.0)) / 2).alias("betweenness"))


def _from_sources(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(v, t): dependencies of the given sources on each vertex.

    Distances by relaxing until nothing changes, path counts hop by hop along
    tight edges, then dependencies back along the same edges, all as joins; no
    side is assumed small.
    """
    start = sources.select(F.col("v").alias("s"), "v")
    dist = materialize(start.withColumn("d", F.lit(0.0)), "dist")
    front, old = dist, []
    while True:
        step = front.join(links, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("weight")).alias("_n"))
        # Only strict improvements beyond rounding go on.
        better = step.join(dist, ["s", "v"], "left").where(F.col("d").isNull() | (F.col("_n") < F.col("d") - 1e-12))
        next_front = materialize(better.select("s", "v", F.col("_n").alias("d")), "front")
        discard(*old)
        front, old = next_front, [next_front]
        if front.isEmpty():
            discard(front)
            break
        next_dist = materialize(dist.unionByName(front).groupBy("s", "v").agg(F.min("d").alias("d")), "dist")
        discard(dist)
        dist = next_dist
    # Tight edges u -> v of each source's shortest-path graph.
    du = dist.select("s", F.col("v").alias("u"), F.col("d").alias("du"))
    dv = dist.select("s", "v", F.col("d").alias("dv"))
    out = du.join(links, F.col("u") == F.col("src")).select("s", "u", F.col("dst").alias("v"), "du", "weight")
    tight = out.join(dv, ["s", "v"]).where(F.abs(F.col("du") + F.col("weight") - F.col("dv")) <= 1e-12 * (1 + F.col("dv")))
    tight = materialize(tight.where(F.col("v") != F.col("s")).select("s", "u", "v"), "tight")
    discard(dist)

    def summed(first: DataFrame, hop) -> DataFrame:
        """Sum by (s, v) of a first table and all that follows from it hop by hop; values are in ``t``."""
        total, now = materialize(first, "sum"), materialize(first, "hop")
        while True:
            after = materialize(hop(now), "hop")
            discard(now)
            now = after
            if now.isEmpty():
                discard(now)
                return total
            more = materialize(total.unionByName(now).groupBy("s", "v").agg(F.sum("t").alias("t")), "sum")
            discard(total)
            total = more

    sigma = summed(
        start.withColumn("t", F.lit(1.0)),
        lambda now: now.withColumnRenamed("v", "u").join(tight, ["s", "u"]).groupBy("s", "v").agg(F.sum("t").alias("t")),
    )
    share = tight.join(sigma.select("s", F.col("v").alias("u"), F.col("t").alias("su")), ["s", "u"])
    share = share.join(sigma.select("s", "v", F.col("t").alias("sv")), ["s", "v"])
    share = materialize(share.select("s", "u", "v", (F.col("su") / F.col("sv")).alias("r")), "share")

    def back(now: DataFrame) -> DataFrame:
        terms = share.join(now, ["s", "v"]).groupBy("s", "u").agg(F.sum(F.col("r") * F.col("t")).alias("t"))
        return terms.select("s", F.col("u").alias("v"), "t")

    ones = sigma.select("s", "v", F.lit(1.0).alias("t"))
    # Every vertex counts one for itself; that is taken off again.
    delta = summed(ones, back)
    sums = materialize(delta.where("s <> v").groupBy("v").agg((F.sum("t") - F.count("*")).alias("t")), "sums")
    discard(tight, sigma, share, delta)
    return sums


def subgraph(edges: DataFrame, names: DataFrame, attrs: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Edges with both ends in the set, with attributes of both ends if given."""
    keep = names.select(F.col(name).alias("_k")).distinct()
    out = edges.join(keep, F.col("src") == F.col("_k"), "left_semi").join(keep, F.col("dst") == F.col("_k"), "left_semi")
    if attrs is None:
        return out
    cols = [c for c in attrs.columns if c != name]
    for end in ("src", "dst"):
        named = attrs.select(F.col(name).alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols])
        out = out.join(named, end, "left")
    return out


def ego_profile(pairs: DataFrame, name: str, measures: list[str], corr: str = "value", a: str = "name", b: str = "variable") -> DataFrame:
    """Pairs that hold a name: (other, corr, measure, value) in long form."""
    hit = pairs.where((F.col(a) == name) | (F.col(b) == name))
    other = F.when(F.col(a) == name, F.col(b)).otherwise(F.col(a))
    rows = hit.select(other.alias("other"), F.col(corr).alias("corr"), *measures)
    return rows.unpivot(["other", "corr"], measures, "measure", "value")
