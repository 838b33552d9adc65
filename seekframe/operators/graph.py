"""Graph operators on edge tables (src, dst[, weight]).  Node ids are strings with their type in front."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekframe.functions.tables import discard, step


def both_ways(edges: DataFrame) -> DataFrame:
    """The simple undirected graph: each pair in both directions, once, no loops."""
    pairs = edges.where("src <> dst").select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", most: int | None = None) -> DataFrame:
    """id, hop of all nodes within ``depth`` steps of the seeds (id); ``most`` keeps the nearest, ties by id."""
    steps = {"forward": edges.select("src", "dst"), "reverse": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}.get(direction)
    steps = both_ways(edges) if steps is None else steps.where("src <> dst").distinct()
    seen = seeds.select("id", F.lit(0).cast("long").alias("hop")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).cast("long").alias("hop"))
        if depth > 2:
            frontier = step(frontier, "bfs")
        seen = seen.unionByName(frontier)
    if most is not None:
        seen = seen.orderBy("hop", "id").limit(most)
    return seen


def expansion_scores(found: DataFrame, base: float, decay: float = 0.5) -> DataFrame:
    """Each hop away from a seed halves the score."""
    return found.withColumn("score", F.round(F.lit(base) * F.pow(F.lit(decay), F.col("hop")), 9))


def expand_calls(calls: DataFrame, seeds: DataFrame, ranks: DataFrame, base: float, depth: int = 1, most: int = 10) -> DataFrame:
    """id, hop, score, rank of the symbols around the seeds: nearer ones first, within a hop by PageRank; each hop halves the score.

    Where fewer than three are found, ranks say too little and ids decide.
    """
    found = bfs(calls, seeds, depth).where("hop > 0").join(ranks.select("id", F.col("rank").alias("central")), "id", "left")
    found = found.crossJoin(found.agg(F.count(F.lit(1)).alias("found")))  # one row
    order = Window.orderBy("hop", F.when(F.col("found") >= 3, F.coalesce("central", F.lit(0.0))).otherwise(0.0).desc(), "id")
    first = found.orderBy("hop", F.when(F.col("found") >= 3, F.coalesce("central", F.lit(0.0))).otherwise(0.0).desc(), "id").limit(most)
    return expansion_scores(first.withColumn("rank", F.row_number().over(order).cast("long")), base).select("id", "hop", "score", "rank")


def expand_imports(imports: DataFrame, seeds: DataFrame, symbols: DataFrame, base: float, depth: int = 1, direction: str = "both", most: int = 5, most_files: int = 60, per_file: int = 3) -> DataFrame:
    """id, grp, score, rank of the first symbols of files (grp) that imports lead to from the seeds' files.

    ``imports``: src, dst files.  ``seeds``: grp.  ``symbols``: id, grp, kind, line.  Seeds count among the ``most_files``.
    """
    from seekframe.operators.lookup import top_per_file

    files = bfs(imports, seeds.select(F.col("grp").alias("id")).distinct(), depth, direction, most_files).where("hop > 0")
    top = top_per_file(symbols, per_file).join(files.select(F.col("id").alias("grp"), "hop"), "grp")
    first = top.orderBy("hop", "grp", "n").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("hop", "grp", "n")).cast("long"))
    return first.select("id", "grp", F.round(F.lit(base * 0.15), 9).alias("score"), "rank")


def expand_types(edges: DataFrame, seeds: DataFrame, base: float, children: int = 15, most: int = 5) -> DataFrame:
    """id, score, rank of parents and of the first ``children`` children of each seed (id, place), in the seeds' order.

    ``edges``: src extends dst.
    """
    up = edges.join(seeds, F.col("src") == F.col("id")).select("place", F.lit(0).alias("way"), F.col("dst").alias("to"))
    down = edges.join(seeds, F.col("dst") == F.col("id")).select("place", F.lit(1).alias("way"), F.col("src").alias("to"))
    down = down.distinct().withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("to"))).where(F.col("n") <= children).drop("n")
    met = up.unionByName(down).join(seeds.select(F.col("id").alias("to")), "to", "left_anti").groupBy("to").agg(F.min(F.struct("place", "way")).alias("at"))
    first = met.orderBy("at", "to").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("at", "to")).cast("long"))
    return first.select(F.col("to").alias("id"), F.round(F.lit(base * 0.2), 9).alias("score"), "rank")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 8) -> DataFrame:
    """place, id along a shortest way between two nodes, direction ignored; of several the one whose nodes, from the end back, come first.

    Empty if they are more than ``most`` steps apart.
    """
    spark = edges.sparkSession
    pairs = step(both_ways(edges), "path-edges")
    seen = spark.createDataFrame([(start, 0, None)], "id string, hop int, via string")
    for hop in range(1, most + 1):
        if not seen.where(F.col("id") == end).isEmpty():
            break
        edge = seen.where(F.col("hop") == hop - 1)
        reached = pairs.join(edge.select(F.col("id").alias("src")), "src").groupBy("dst").agg(F.min("src").alias("via"))
        new = reached.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("id"), F.lit(hop).alias("hop"), "via")
        seen = step(seen.unionByName(new), "path")
    way, at = [], end
    while (row := seen.where(F.col("id") == at).first()) is not None:  # one node a step, ``most`` at most
        way.append((row["hop"], at))
        if row["via"] is None:
            break
        at = row["via"]
    return spark.createDataFrame(sorted(way), "place int, id string")


def code_graph(calls: DataFrame, imports: DataFrame, types: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """src, dst, kind, weight of all edges between typed nodes, each pair and kind once; other edges count both ways.

    Tables have src and dst (``other`` kind and weight too); ids have their type in front.
    """
    parts = [df.groupBy("src", "dst").agg(F.lit(kind).alias("kind"), F.lit(1.0).alias("weight")) for kind, df in (("calls", calls), ("imports", imports), ("extends", types))]
    if other is not None:
        both = other.select("src", "dst", "kind", "weight").unionByName(other.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "weight"))
        parts.append(both.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85, *, teleport: DataFrame | None = None, simple: bool = False, normalise: bool = False, tolerance: float | None = None) -> DataFrame:
    """id, rank.  Parallel edges and weights add up unless ``simple``; dangling mass goes where teleports go.

    ``teleport`` (id) restricts the restart to some nodes; ``normalise`` divides by the largest rank.
    """
    weighted = edges.select("src", "dst", F.col("weight").cast("double").alias("w") if "weight" in edges.columns else F.lit(1.0).alias("w"))
    weighted = step(weighted.groupBy("src", "dst").agg(F.lit(1.0).alias("w") if simple else F.sum("w").alias("w")), "rank-edges")
    out = weighted.groupBy("src").agg(F.sum("w").alias("out"))
    links = step(weighted.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")), "rank-links")
    nodes = nodes_of(weighted)
    if teleport is not None:
        marked = nodes.join(teleport.select("id", F.lit(1.0).alias("t")).distinct(), "id", "left").fillna(0.0, ["t"])
    else:
        marked = nodes.withColumn("t", F.lit(1.0))
    start = marked.crossJoin(F.broadcast(marked.agg(F.sum("t").alias("all"), F.count(F.lit(1)).alias("n"))))
    start = start.select("id", F.when(F.col("all") > 0, F.col("t") / F.col("all")).otherwise(1 / F.col("n")).alias("v"))
    start = step(start.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").fillna(True, ["dangling"]), "rank-nodes")
    n = start.count()
    ranks, written = start.withColumn("rank", F.lit(1.0 / n if n else 0.0)), None
    for _ in range(iterations):
        # one number; each round is written down, so plans don't grow with the rounds
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()[0]
        sent = ranks.join(links, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        next_ = start.join(sent, F.col("id") == F.col("dst"), "left")
        next_ = next_.select("id", "v", "dangling", ((1 - damping) * F.col("v") + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("v"))).alias("rank"))
        next_ = step(next_, "rank")
        change = None
        if tolerance is not None:
            change = next_.select("id", "rank").join(ranks.select("id", F.col("rank").alias("was")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        if written is not None:
            discard(written)
        ranks = written = next_
        if change is not None and change < tolerance * n:
            break
    discard(weighted, links)
    if normalise:
        top = ranks.agg(F.max("rank")).first()[0]
        ranks = ranks.withColumn("rank", F.col("rank") / F.lit(top))
    return ranks.select("id", "rank")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """id, degree, centrality: incident edges over the number of other nodes."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    n = counts.agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(n)).select("id", "degree", F.round(F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0), 9).alias("centrality"))


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that can be reached."""
    pairs = step(both_ways(edges), "components-edges")
    labels = written = step(pairs.select(F.col("src").alias("id")).unionByName(edges.where("src = dst").select(F.col("src").alias("id"))).distinct().select("id", F.col("id").alias("component")), "components")
    while True:
        near = pairs.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("near"))
        moved = labels.join(near, F.col("id") == F.col("src"), "left").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        # the label's own label: chains shrink by half each round
        hop = moved.select(F.col("id").alias("to"), F.col("to").alias("far"))
        moved = step(moved.join(hop, "to").select("id", F.least("to", "far").alias("component"), "was"), "components")
        discard(written)
        if moved.where("component <> was").isEmpty():
            discard(pairs)
            return moved.select("id", "component")
        labels, written = moved.select("id", "component"), moved


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community: every round each node takes the commonest label around it, of equal ones the smallest."""
    pairs = step(both_ways(edges), "labels-edges")
    labels, written = nodes_of(edges).select("id", F.col("id").alias("community")), None
    order = Window.partitionBy("src").orderBy(F.col("votes").desc(), "community")
    for _ in range(rounds):
        votes = pairs.join(labels, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("src").alias("id"), F.col("community").alias("next"))
        labels = step(labels.join(best, "id", "left").select("id", F.coalesce("next", "community").alias("community")), "labels")
        if written is not None:
            discard(written)
        written = labels
    discard(pairs)
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: modularity of the simple undirected graph, communities, singletons, isolated nodes."""
    pairs = both_ways(edges)
    tagged = pairs.join(communities.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(communities.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    m2 = tagged.agg(F.count(F.lit(1)).cast("double").alias("m2"))
    parts = tagged.groupBy(F.col("a").alias("community")).agg(F.sum((F.col("a") == F.col("b")).cast("double")).alias("inside"), F.count(F.lit(1)).cast("double").alias("degree"))
    q = parts.crossJoin(F.broadcast(m2)).agg(F.round(F.coalesce(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)), F.lit(0.0)), 6).alias("modularity"))
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    shape = sizes.agg(F.count(F.lit(1)).alias("communities"), F.sum((F.col("size") == 1).cast("long")).alias("singletons"), F.max("size").alias("largest"))
    isolated = communities.join(pairs.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    return q.crossJoin(shape).crossJoin(isolated)


def louvain(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """id, community by local moves: each round the nodes of one parity go where modularity gains most.

    Half of the nodes move at a time, chosen by a hash, so that two neighbours don't just swap places.
    """
    pairs = step(both_ways(edges), "louvain-edges")
    m2 = float(pairs.count() or 1)
    degree = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    state = step(nodes_of(edges).join(degree, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k"), F.col("id").alias("community")), "louvain")
    for r in range(2 * rounds):
        totals = state.groupBy("community").agg(F.sum("k").alias("total"))
        near = pairs.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("links"))
        own = state.select(F.col("id").alias("src"), "k", F.col("community").alias("own"))
        gain = near.join(own, "src").join(totals, "community")
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
        gain = gain.withColumn("gain", F.col("links") - F.col("k") * rest / m2)
        order = Window.partitionBy("src").orderBy(F.col("gain").desc(), (F.col("community") == F.col("own")).desc(), "community")
        best = gain.withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("src").alias("id"), F.col("community").alias("best"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2
        before, state = state, step(state.join(best, "id", "left").select("id", "k", F.when(turn, F.coalesce("best", "community")).otherwise(F.col("community")).alias("community")), "louvain")
        discard(before)
    discard(pairs)
    return state.select("id", "community")


def community_summary(nodes: DataFrame, groups: int = 5, names: int = 10) -> DataFrame:
    """community, size, its commonest groups and first names; ``nodes``: id, community, grp, name."""
    size = nodes.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    per = nodes.groupBy("community", "grp").agg(F.count(F.lit(1)).alias("n"))
    top = per.withColumn("i", F.row_number().over(Window.partitionBy("community").orderBy(F.col("n").desc(), "grp"))).where(F.col("i") <= groups)
    top = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "grp"))), lambda x: x["grp"]), ",").alias("top_groups"))
    first = nodes.withColumn("i", F.row_number().over(Window.partitionBy("community").orderBy("name", "id"))).where(F.col("i") <= names)
    first = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), ",").alias("names"))
    return size.join(top, "community").join(first, "community")


def frontier(edges: DataFrame, seeds: DataFrame, communities: DataFrame) -> DataFrame:
    """Nodes whose community is worth looking at again after the seeds changed: they, their neighbours, and all in their communities."""
    near = both_ways(edges).join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    touched = communities.join(seeds.select("id"), "id", "left_semi").select("community").distinct()
    same = communities.join(touched, "community", "left_semi").select("id")
    return seeds.select("id").unionByName(near).unionByName(same).distinct()


def update_communities(edges: DataFrame, seeds: DataFrame, communities: DataFrame, rounds: int = 5, most: float = 0.5) -> DataFrame:
    """id, community after the seeds (id) changed: labels spread anew within their frontier, all other nodes keep theirs.

    Nodes without a community yet start as their own.  A frontier of more than ``most`` of all nodes is no saving: then all labels
    spread anew.
    """
    nodes = step(nodes_of(edges), "update-nodes")
    known = nodes.join(communities.select("id", "community"), "id", "left").select("id", F.coalesce("community", "id").alias("community"))
    touched = step(frontier(edges, seeds, known).join(nodes, "id", "left_semi").distinct(), "update-frontier")
    if touched.count() > most * nodes.count():
        discard(nodes, touched)
        return label_propagation(edges, rounds)
    marked = known.join(touched.select("id", F.lit(True).alias("free")), "id", "left").select("id", F.when(F.col("free"), F.col("id")).otherwise(F.col("community")).alias("community"), F.coalesce("free", F.lit(False)).alias("free"))
    labels = written = step(marked, "update")
    pairs = step(both_ways(edges).join(touched.select(F.col("id").alias("src")), "src", "left_semi"), "update-edges")
    order = Window.partitionBy("src").orderBy(F.col("votes").desc(), "community")
    for _ in range(rounds):
        votes = pairs.join(labels, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("src").alias("id"), F.col("community").alias("next"))
        labels = step(labels.join(best, "id", "left").select("id", F.coalesce("next", "community").alias("community"), "free"), "update")
        discard(written)
        written = labels
    discard(nodes, touched, pairs)
    return labels.select("id", "community")


def largest_communities(communities: DataFrame, most: int = 5) -> DataFrame:
    """place, community, size, share of all nodes of the largest communities, ties to the smaller name."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    total = communities.agg(F.count(F.lit(1)).alias("all"))  # one row
    first = sizes.orderBy(F.col("size").desc(), "community").limit(most)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(F.col("size").desc(), "community")).cast("long"))
    return placed.crossJoin(F.broadcast(total)).select("place", "community", "size", F.round(F.col("size") / F.col("all"), 6).alias("share"))


def drawn(edges: DataFrame, communities: DataFrame, most: int = 500, colours: int = 10) -> DataFrame:
    """id, community, degree, size, colour of what a picture shows: the ``most`` nodes with the most edges, sized by the edges among them.

    ``communities``: id, community (a number, 0 if null or missing).
    """
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    first = step(ends.groupBy("id").agg(F.count(F.lit(1)).alias("all")).orderBy(F.col("all").desc(), "id").limit(most).select("id"), "drawn")
    inside = subgraph(edges, first)
    degree = inside.select(F.col("src").alias("id")).unionByName(inside.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    rows = first.join(degree, "id", "left").join(communities.select("id", "community"), "id", "left")
    n, community = F.coalesce("degree", F.lit(0)).cast("long"), F.coalesce("community", F.lit(0)).cast("long")
    return rows.select("id", community.alias("community"), n.alias("degree"), F.least(F.lit(50), 10 + n * 3).cast("long").alias("size"), F.pmod(community, F.lit(colours)).cast("long").alias("colour"))


def callers_callees(edges: DataFrame, node: DataFrame) -> DataFrame:
    """id, direction for everything one step from ``node`` (id)."""
    up = edges.join(node, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id"), F.lit("caller").alias("direction"))
    down = edges.join(node, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"), F.lit("callee").alias("direction"))
    return up.unionByName(down).distinct()


def blast_radius(calls: DataFrame, imports: DataFrame, symbols: DataFrame, target: DataFrame) -> DataFrame:
    """Symbols that a change of ``target`` (id) may break: its callers and the first symbol of each importing file, one per file.

    ``calls``: src, dst symbols.  ``imports``: src, dst files.  ``symbols``: id, grp (file).
    """
    callers = calls.join(target, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id"), F.lit(0).alias("way"))
    files = symbols.join(target.select("id"), "id", "left_semi").select("grp").distinct()
    importing = imports.join(files, F.col("dst") == F.col("grp"), "left_semi").select(F.col("src").alias("grp")).distinct()
    of_files = symbols.join(importing, "grp", "left_semi").select("id", F.lit(1).alias("way"))
    found = callers.unionByName(of_files).join(target.select("id"), "id", "left_anti").groupBy("id").agg(F.min("way").alias("way")).join(symbols.select("id", "grp"), "id")
    one = found.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("way", "id"))).where("n = 1")
    return one.select("grp", "id", F.when(F.col("way") == 0, "call").otherwise("import").alias("reason"))
