"""Operators on small tables worked out by hand, and what must hold for any input."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekframe.functions import text as T
from seekframe.operators import audit, fusion, graph, incremental, legs, metrics, packing, resolve, routing, search, structure
from seekframe.plans import graphs

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def hits(spark, data):
    return spark.createDataFrame(data, "query_id bigint, list_idx bigint, source string, pos bigint, id bigint, score double")


def test_rrf_formula_and_first_seen_source(spark):
    h = hits(spark, [(1, 0, "bm25", 1, 7, 9.0), (1, 0, "bm25", 2, 8, 8.0), (1, 1, "grep", 1, 8, 1.0)])
    got = {r["id"]: (r["score"], r["source"], r["rank"]) for r in fusion.rrf(h).collect()}
    assert got[8] == (round(1 / 62 + 1 / 61, 9), "bm25", 1)
    assert got[7] == (round(1 / 61, 9), "bm25", 2)


def test_rrf_counts_repeated_ids_twice_and_weighs_lists(spark):
    h = hits(spark, [(1, 0, "a", 1, 5, 1.0), (1, 0, "a", 3, 5, 1.0), (1, 1, "b", 1, 6, 1.0)])
    got = {r["id"]: r["score"] for r in fusion.rrf(h, leg_weights={"b": 0.5}).collect()}
    assert got == {5: round(1 / 61 + 1 / 63, 9), 6: round(0.5 / 61, 9)}


@FEW
@given(st.permutations(list(range(6))))
def test_rrf_does_not_depend_on_row_order(spark, order):
    data = [(1, i % 2, "ab"[i % 2], i // 2 + 1, i * 3 % 4, 1.0) for i in range(6)]
    assert rows(fusion.rrf(hits(spark, [data[i] for i in order])), "id", "score", "source", "rank") == rows(fusion.rrf(hits(spark, data)), "id", "score", "source", "rank")


def test_dedup_keeps_the_best_and_is_idempotent(spark):
    h = hits(spark, [(1, 0, "a", 1, 5, 0.5), (1, 1, "b", 1, 5, 0.9), (1, 1, "b", 2, 5, 0.9)])
    once = fusion.dedup_best(h)
    assert rows(once, "id", "source", "pos") == [(5, "b", 1)]
    assert rows(fusion.dedup_best(once), "id", "source") == rows(once, "id", "source")


def test_xtr_imputes_missing_tokens(spark):
    scores = spark.createDataFrame([(1, 10, 5, 0.8), (1, 10, 5, 0.6), (1, 11, 6, 0.4)], "query_id bigint, token bigint, id bigint, score double")
    tokens = spark.createDataFrame([(1, 10), (1, 11)], "query_id bigint, token bigint")
    assert rows(fusion.xtr(scores, tokens, 0.1), "id", "score") == [(5, 0.45), (6, 0.25)]


def test_bm25_needs_all_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma"), (4, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, ["alpha", "beta"])], "query_id bigint, terms array<string>")
    assert rows(search.bm25(docs, q, {"body": (F.col("text"), 1.0)}), "id", "rank") == [(1, 1)]


def test_grep_ranks_names_before_bodies(spark):
    docs = spark.createDataFrame([(1, "Foo\nbar"), (2, "x\nfoo"), (3, "y")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "foo")], "query_id bigint, pattern string")
    assert rows(search.grep(docs, q, T.first_line(F.col("text")), F.col("text")), "rank", "id", "score") == [(1, 1, 1.0), (2, 2, 0.8)]


def test_knn_leaves_out_zero_and_other_widths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [0.0, 2.0])], "id bigint, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, q array<double>")
    assert rows(search.knn(v, q, 5, "cosine"), "id", "score") == [(1, 1.0), (4, 0.0)]
    assert rows(search.knn(v, q, 5, "l2"), "id", "score") == [(1, 1.0), (2, 0.0), (4, 0.0)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_pagerank_sums_to_one_and_prefers_the_hub(spark):
    e = edges(spark, [("a", "hub"), ("b", "hub"), ("c", "hub"), ("hub", "a")])
    got = {r["id"]: r["rank"] for r in graph.pagerank(e, 15).collect()}
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-9)
    assert max(got, key=got.get) == "hub"
    personal = {r["id"]: r["rank"] for r in graph.pagerank(e, 15, teleport=spark.createDataFrame([("c",)], "id string")).collect()}
    assert personal["c"] > got["c"]


def test_pagerank_parallel_edges_count_unless_simple(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")])
    multi = {r["id"]: r["rank"] for r in graph.pagerank(e, 10).collect()}
    simple = {r["id"]: r["rank"] for r in graph.pagerank(e, 10, simple=True).collect()}
    assert multi["b"] > multi["c"] and math.isclose(simple["b"], simple["c"])


def test_components_and_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")])
    assert rows(graph.components(e), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    chain = edges(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)])
    assert {r["component"] for r in graph.components(chain).collect()} == {"n00"}


def test_bfs_directions(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("d", "b")])
    seed = spark.createDataFrame([("b",)], "id string")
    assert rows(graph.bfs(e, seed, 1, "forward"), "id", "hop") == [("b", 0), ("c", 1)]
    assert rows(graph.bfs(e, seed, 1, "reverse"), "id", "hop") == [("a", 1), ("b", 0), ("d", 1)]
    assert rows(graph.bfs(e, spark.createDataFrame([("a",)], "id string"), 3, "both"), "id", "hop") == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]


def test_louvain_is_no_worse_than_singletons(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    e = edges(spark, [*clique("a"), *clique("b"), ("a0", "b0")])
    assert graph.modularity(e, graph.louvain(e)).first()["modularity"] > 0.3


def test_calls_cascade_and_strictness(spark):
    s = spark.createDataFrame([(1, "run", "A.run"), (2, "run", "B.run"), (3, "solo", "C.solo")], "id bigint, name string, qualified_name string")
    c = spark.createDataFrame([(1, "A.run", None), (2, "run", "B"), (3, "solo", None), (4, "run", None), (5, "none", None)], "call_id bigint, callee_name string, hint string")
    assert rows(resolve.resolve_calls(c, s).fillna(0), "call_id", "callee_id", "step") == [(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 0, 0), (5, 0, 0)]
    assert rows(resolve.resolve_calls(c, s, strict=True).fillna(0), "call_id", "callee_id") == [(1, 1), (2, 2), (3, 3), (4, 0), (5, 0)]


TREE = ["pkg/sub/mod.py", "pkg/sub/__init__.py", "pkg/__init__.py", "pkg/db.py", "src/app/main.ts", "web/index.ts", "web/deep/page.ts", "web/util.ts", "core/mod.rs", "deep/er/store.go"]


@pytest.mark.parametrize(
    ("importer", "specifier", "expected"),
    [
        ("pkg/sub/mod.py", ".", "pkg/sub/__init__.py"),
        ("pkg/sub/mod.py", "..", "pkg/__init__.py"),
        ("pkg/sub/mod.py", "..db", "pkg/db.py"),
        ("pkg/db.py", ".sub.mod", "pkg/sub/mod.py"),
        ("pkg/sub/mod.py", ".db", None),
        ("pkg/sub/mod.py", "....db", None),
        ("web/deep/page.ts", "../util", "web/util.ts"),
        ("web/deep/page.ts", "../util.js", "web/util.ts"),
        ("web/deep/page.ts", "./../../web", "web/index.ts"),
        ("web/deep/page.ts", "./missing", None),
        ("web/util.ts", "app/main", "src/app/main.ts"),
        ("pkg/db.py", "other.pkg.sub.mod", "pkg/sub/mod.py"),
        ("pkg/db.py", "pkg.db", None),
        ("pkg/db.py", "react/mod", None),
        ("pkg/db.py", "os", None),
        ("pkg/db.py", "crate::core", "core/mod.rs"),
        ("pkg/db.py", "github.com/x/deep/er/store", "deep/er/store.go"),
        ("pkg/db.py", None, None),
    ],
)
def test_import_resolution(spark, importer, specifier, expected):
    files = spark.createDataFrame([(i, p) for i, p in enumerate(TREE)], "file_id bigint, rel_path string")
    asked = spark.createDataFrame([(9, TREE.index(importer), specifier)], "import_id bigint, file_id bigint, specifier string")
    found = resolve.resolve_imports(asked, files).first()["target_id"]
    assert (None if found is None else TREE[found]) == expected


def test_tickets_have_boundaries(spark):
    said = "Merge #1 from feature/PROJ-456-thing: UTF-8, SHA3-256, CVE-2021-44228, xAB-1, AB-1x, B-1, AB-12, v-ENG-7"
    commits = spark.createDataFrame([(1, said, ["f"]), (2, None, ["f"])], "commit_id bigint, message string, files array<string>")
    got = resolve.link_tickets(commits, spark.createDataFrame([(3, "f")], "id bigint, grp string"))
    assert rows(got, "symbol_id", "ticket") == [(3, "AB-12"), (3, "ENG-7"), (3, "PROJ-456")]


def test_tickets_of_symbols_in_several_files(spark):
    commits = spark.createDataFrame([(1, "AB-1 CD-2 AB-1", ["f", "g", None]), (2, "AB-1", ["g", "x"]), (3, "EF-3", ["h"]), (4, "none", ["f"]), (5, "GH-4", None)], "commit_id bigint, message string, files array<string>")
    symbols = spark.createDataFrame([(1, "f"), (1, "f"), (2, "g"), (2, "f"), (3, "h"), (3, "g"), (4, "h"), (5, None), (None, "h"), (6, "z")], "id bigint, grp string")
    got = [tuple(r) for r in resolve.link_tickets(commits, symbols).collect()]
    assert sorted(got, key=str) == sorted([(1, "AB-1"), (1, "CD-2"), (2, "AB-1"), (2, "CD-2"), (3, "AB-1"), (3, "CD-2"), (3, "EF-3"), (4, "EF-3"), (None, "EF-3")], key=str)


def test_tickets_are_not_dealt_out_again_with_their_symbols(spark):
    """The result of 500 tickets and 800 symbols in each of two files; what is shuffled is some multiple of tickets and symbols."""
    commits = spark.range(500).selectExpr("id AS commit_id", "concat('AB-', id) AS message", "array('f', 'g') AS files")
    symbols = spark.range(1600).selectExpr("id", "IF(id < 800, 'f', 'g') AS grp").repartition(4)

    def shuffled() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert len(resolve.link_tickets(commits, symbols).collect()) == 800_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < shuffled() - before < 50_000


def test_tickets_broadcast_nothing_that_grows(spark, sf_dir, tmp_path):
    """Files and shuffled tables of far less than Spark's limit for a broadcast, which says little of the rows that are made of them."""
    spark.range(100).selectExpr("id AS commit_id", "concat('AB-', id, ' CD-', id % 7) AS message", "array(concat('f', id % 5), 'g') AS files").write.parquet(f"{tmp_path}/commits")
    # symbols 0 to 9 stand in two files
    spark.range(210).selectExpr("id % 200 AS id", "IF(id < 100, concat('f', id % 5), 'g') AS grp").write.parquet(f"{tmp_path}/symbols")
    commits, symbols = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("commits", "symbols"))
    by_hand, query = resolve.link_tickets(commits, symbols), graphs.ticket_linker(spark, sf_dir)
    g = {f"AB-{i}" for i in range(100)} | {f"CD-{i}" for i in range(7)}
    f = {k: {f"AB-{i}" for i in range(100) if i % 5 == k} | {f"CD-{i % 7}" for i in range(100) if i % 5 == k} for k in range(5)}
    assert rows(by_hand, "symbol_id", "ticket") == sorted((i, t) for i in range(200) for t in (f[i % 5] if 10 <= i < 100 else g))
    assert query.collect()
    for ran in (by_hand, query):
        assert "Broadcast" not in ran._jdf.queryExecution().executedPlan().toString()


def test_expansions_and_paths(spark):
    e = edges(spark, [("a", "b"), ("c", "a"), ("b", "d"), ("a", "e"), ("d", "z")])
    ranks = spark.createDataFrame([("b", 0.1), ("c", 0.9), ("e", 0.5), ("d", 1.0)], "id string, rank double")
    seed = spark.createDataFrame([("a", 1)], "id string, place int")
    assert rows(graph.expand_calls(e, seed, ranks, 1.0, 2, 3), "rank", "id", "score") == [(1, "c", 0.5), (2, "e", 0.5), (3, "b", 0.5)]
    assert rows(graph.expand_types(e, seed, 1.0), "rank", "id", "score") == [(1, "b", 0.2), (2, "e", 0.2), (3, "c", 0.2)]
    symbols = spark.createDataFrame([(f"{f}{i}", f, "function", i) for f in "abcde" for i in range(5)], "id string, grp string, kind string, line int")
    files = spark.createDataFrame([("a",)], "grp string")
    assert rows(graph.expand_imports(e, files, symbols, 1.0, direction="forward"), "rank", "id") == [(1, "b0"), (2, "b1"), (3, "b2"), (4, "e0"), (5, "e1")]
    assert rows(graph.shortest_path(e, "c", "z"), "place", "id") == [(0, "c"), (1, "a"), (2, "b"), (3, "d"), (4, "z")]
    assert graph.shortest_path(e, "c", "nowhere").count() == 0
    assert rows(graph.subgraph(e, spark.createDataFrame([("a",), ("b",), ("z",)], "id string")), "src", "dst") == [("a", "b")]
    assert rows(graph.components(edges(spark, [("x", "x"), ("a", "b")])), "id", "component") == [("a", "a"), ("b", "a"), ("x", "x")]


def test_pagerank_plan_does_not_grow_with_rounds(spark):
    e = edges(spark, [("a", "hub"), ("b", "hub"), ("hub", "a")])
    size = lambda n: len(graph.pagerank(e, n)._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(2) == size(9)


def test_direct_paths_and_path_measures(spark):
    files = spark.createDataFrame([(1, "README.md"), (2, "a/long/app.py"), (3, "app.py"), (4, "node_modules/x/package.json"), (5, "package.json"), (6, ".env"), (7, "b/app.py")], "file_id bigint, rel_path string")
    symbols = spark.createDataFrame([(10, 1, "section", 1), (20, 2, "module", 1), (31, 3, "function", 9), (30, 3, "class", 2), (40, 4, "constant", 1), (50, 5, "constant", 1), (70, 7, "function", 1)], "id bigint, file_id bigint, kind string, line int")
    hints = spark.createDataFrame([("APP.py",), (".env",), ("package",)], "hint string")
    assert rows(legs.file_overview(files, symbols, hints), "file_id", "rank", "id", "score") == [(3, 1, 30, 0.999), (3, 2, 31, 0.998), (4, 1, 40, 0.999), (5, 1, 50, 0.999), (7, 1, 70, 0.999)]
    assert rows(legs.project_overview(files, symbols), "rank", "id", "priority") == [(1, 10, 0), (2, 50, 2), (3, 20, 4)]
    assert rows(legs.config_lookup(files, hints), "hint", "file_id") == [("package", 4), ("package", 5)]
    found = spark.createDataFrame([(1, 1, "x/y.py"), (1, 2, "x/config.py"), (1, 3, "config.py"), (2, 1, "z.py")], "query_id bigint, rank bigint, rel_path string")
    expected = spark.createDataFrame([(1, "config.py"), (2, "nowhere"), (3, "z")], "query_id bigint, piece string")
    got = rows(legs.by_path(found, expected), "query_id", "place", "recall_1", "recall_5", "mrr", "ndcg")
    assert got == [(1, 2, 0.0, 1.0, 0.5, 0.63093), (2, -1, 0.0, 0.0, 0.0, 0.0), (3, -1, 0.0, 0.0, 0.0, 0.0)]


def test_variants_and_recorded_scores(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "query_id bigint, query string")
    more = spark.createDataFrame([(1, 1, " c "), (1, 2, "a"), (1, 3, " "), (1, 4, "d"), (1, 5, "e")], "query_id bigint, place bigint, query string")
    assert rows(legs.variants(asked, more, 3), "query_id", "place", "query") == [(1, 0, "a"), (1, 1, "c"), (1, 3, "d"), (2, 0, "b")]
    hits = spark.createDataFrame([(1, 0, 7, 0.5, 1), (1, 1, 7, 0.9, 1), (1, 1, 8, 0.5, 2), (1, 0, 9, 0.5, 2)], "query_id bigint, place bigint, id bigint, score double, rank bigint")
    assert rows(legs.merge_variants(hits, 5), "rank", "id", "score") == [(1, 7, 0.9), (2, 9, 0.5), (3, 8, 0.5)]
    ranked = spark.createDataFrame([(1, 7, 0.9, 1), (1, 8, 0.8, 2), (1, 9, 0.7, 3), (2, 7, 0.4, 1)], "query_id bigint, id bigint, score double, rank bigint")
    scores = spark.createDataFrame([(1, 9, 5.0), (1, 7, 1.0), (1, 99, 9.0)], "query_id bigint, id bigint, score double")
    assert rows(legs.rerank(ranked, scores, 3), "query_id", "rank", "id", "outcome") == [(1, 1, 9, "reranked"), (1, 2, 7, "reranked"), (1, 3, 8, "reranked"), (2, 1, 7, "kept")]
    calls = spark.createDataFrame([(1, "r", "f"), (2, "r", "g"), (3, "s", "f")], "call_id bigint, repo string, name string")
    symbols = spark.createDataFrame([(5, "r", "f"), (6, "s", "f"), (7, "s", "g"), (8, "t", "g")], "id bigint, repo string, name string")
    assert rows(legs.cross_repository(calls, symbols), "call_id", "repo", "id") == [(1, "s", 6), (3, "r", 5)]


def test_drift_and_prune(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, hash string")
    index = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "path string, hash string")
    states = incremental.drift(disk, index)
    assert rows(states, "path", "state") == [("a", "unchanged"), ("b", "stale"), ("c", "missing"), ("d", "new")]
    assert incremental.prune_plan(states).first()["refused"] == ""
    assert incremental.prune_plan(states, trusted=False).first()["refused"] == "untrusted_walk"
    many = spark.createDataFrame([(str(i), "missing" if i < 11 else "unchanged") for i in range(40)], "path string, state string")
    assert incremental.prune_plan(many).first()["refused"] == "too_many"


def packed(spark, tokens, budget):
    data = [(1, i, i + 1, t) for i, t in enumerate(tokens)]
    return rows(packing.greedy(spark.createDataFrame(data, "query_id bigint, id bigint, rank bigint, tokens bigint"), budget), "id", "tokens")


def test_greedy_skips_what_does_not_fit(spark):
    assert packed(spark, [5, 100, 3, 2], 9) == [(0, 5), (2, 3)]
    assert packed(spark, [100, 1], 9) == [(1, 1)]


@FEW
@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(1, 100))
def test_greedy_never_exceeds_the_budget(spark, tokens, budget):
    taken = packed(spark, tokens, budget)
    used, expected = 0, []
    for i, t in enumerate(tokens):
        if used + t <= budget:
            used += t
            expected.append((i, t))
    assert taken == expected


@FEW
@given(st.lists(st.integers(0, 8), min_size=0, max_size=12), st.sets(st.integers(0, 8), min_size=1))
def test_metrics_stay_between_zero_and_one(spark, ranked, relevant):
    found = spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ranked)], "query_id bigint, id bigint, rank bigint")
    good = spark.createDataFrame([(1, i) for i in relevant], "query_id bigint, id bigint")
    r = metrics.ranking(found, good, 5).first()
    assert all(0 <= r[c] <= 1 for c in ("ndcg", "recall", "mrr"))
    unique = list(dict.fromkeys(ranked))
    first = next((n for n, i in enumerate(unique, 1) if i in relevant), None)
    assert r["mrr"] == (round(1 / first, 6) if first else 0)


def test_synthesis_metrics(spark):
    a = spark.createDataFrame([(1, "uses alpha and beta", ["alpha", "beta"], ["uses", "gamma"], ["alpha"], "alpha beta")], "query_id bigint, answer string, expected array<string>, fragments array<string>, retrieved array<string>, context string")
    r = metrics.synthesis(a).first()
    assert (r["hallucination"], r["completeness"]) == (0.5, 0.5)
    assert r["faithfulness"] == round(2 / 3, 6)


def test_audit_finds_the_first_fault(spark):
    log = audit.build(spark.createDataFrame([(u, i, f"{u}{i}") for u in (1, 2) for i in range(5)], "u bigint, n bigint, text string"), "u", "n")
    assert rows(audit.verify(log, "u"), "u", "fault") == [(1, ""), (2, "")]
    bad = log.withColumn("text", F.when((F.col("u") == 2) & (F.col("id") >= 3), "x").otherwise(F.col("text")))
    assert rows(audit.verify(bad, "u").fillna(0), "u", "fault", "fault_id") == [(1, "", 0), (2, "row_mutated", 3)]
    heads = spark.createDataFrame([(1, 5, "0" * 64), (3, 1, "0" * 64)], "u bigint, count bigint, head string")
    assert rows(audit.verify(log, "u", heads), "u", "fault") == [(1, "head_mismatch"), (2, "anchor_missing"), (3, "log_emptied")]


def test_router(spark):
    q = spark.createDataFrame([(1, "what is strix?"), (2, "walk me through login"), (3, "parser registry dispatch order details explained here")], "query_id bigint, query string")
    assert rows(routing.route(q), "query_id", "tier", "lexical_only") == [(1, 1, True), (2, 3, True), (3, 2, False)]


def test_line_windows_and_sections(spark):
    f = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\n"), (2, None), (3, "")], "id bigint, text string")
    assert rows(structure.markdown_sections(f), "path", "line_start", "line_end") == [("A", 1, 4), ("A > B", 3, 4), ("C", 5, 6)]
    assert rows(structure.line_windows(f, 2), "id", "name", "line_start", "line_end") == [(1, "section_1", 1, 2), (1, "section_2", 3, 4), (1, "section_3", 5, 6)]


def test_empty_tables(spark):
    none = hits(spark, []).where("false")
    assert fusion.rrf(none).count() == fusion.dedup_best(none).count() == 0
    no_edges = edges(spark, []).where("false")
    assert graph.components(no_edges).count() == graph.degree_centrality(no_edges).count() == 0
    assert graph.pagerank(no_edges, 2).count() == 0
