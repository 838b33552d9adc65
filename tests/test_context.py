from __future__ import annotations

from collections import Counter

import pytest

from seekframe.operators import context, graph, point, shorten

BODY = '''def login(user):
    """Checks a user."""
    first = 1

    token = make(user)
    check(token)

    if user {
        alpha()

        beta()
    }

    unrelated words here'''


def test_blocks_follow_braces():
    assert [(b.start, b.stop - 1) for b in shorten.blocks(BODY.splitlines())] == [(0, 2), (4, 5), (7, 11), (13, 13)]
    assert [(b.start, b.stop - 1) for b in shorten.blocks(["a {", "", "b", "", ""])] == [(0, 2)]
    assert shorten.blocks(["", " "]) == shorten.blocks([]) == []


def test_shorten_keeps_header_docstring_and_best_block():
    text, tokens, spans = shorten.shorten(BODY, "token check", 10, "Checks a user.")
    assert spans == [(0, 1), (4, 5)]
    assert text.splitlines()[2] == "# ... 2 lines elided ..." and text.endswith("# ... 8 lines elided ...")
    assert tokens == len(text.split())
    # parts by vectors outrank words
    assert shorten.shorten(BODY, "token check", 8, None, [(13, 13, 0.9), (4, 5, 0.1)])[2] == [(0, 0), (13, 13)]
    # the header stays whatever it takes; a whole body comes back as it is
    assert shorten.shorten(BODY, "", 1)[2] == [(0, 0)]
    assert shorten.shorten("a\nb\n", "", 99) == ("a\nb\n", 2, [(0, 1)])
    assert shorten.shorten("", "x", 5) == ("", 0, [])


def test_second_wave(spark):
    rows = [(1, "token check", 1, 10, "w " * 30, None, 30), (1, "token check", 2, 11, BODY + " pad" * 40, "Checks a user.", 61), (1, "token check", 3, 12, "w " * 10, None, 10), (1, "q", 4, 13, "", None, 90), (1, "q", 5, 14, None, None, 90)]
    hits = spark.createDataFrame(rows, "query_id bigint, query string, rank bigint, id bigint, body string, docstring string, tokens bigint")
    got = {r["id"]: (r["how"], r["tokens"]) for r in shorten.second_wave(hits, 80, 0.45, 5).collect()}
    assert got[10] == ("whole", 30) and got[12] == ("whole", 10) and got[11] == ("compressed", 36)
    assert set(got) == {10, 11, 12} and sum(t for _, t in got.values()) <= 80
    assert {r["id"]: r["how"] for r in shorten.second_wave(hits, 51, 0.45, 5).collect()}[11] == "floor"
    assert {r["id"] for r in shorten.second_wave(hits, 41, 0.45, 5).collect()} == {10, 12}
    assert shorten.second_wave(hits.where("false"), 41).count() == 0


def test_shortened_on_odd_rows(spark):
    units = spark.createDataFrame([(1, "q", None, None, 0), (2, None, "a\n\nb", None, 2), (2, None, "a\n\nb", None, 2)], "id bigint, query string, body string, docstring string, tokens bigint")
    assert sorted((r["id"], r["text"]) for r in shorten.shortened(units, 0.5).collect()) == [(1, ""), (2, "a\n# ... 2 lines elided ..."), (2, "a\n# ... 2 lines elided ...")]


def spread(edges, free, labels, rounds):
    """Label propagation among ``free`` nodes, one dictionary a round."""
    near = {n: {b if a == n else a for a, b in edges if n in (a, b) and a != b} for n in labels}
    labels = {n: n if n in free else c for n, c in labels.items()}
    for _ in range(rounds):
        new = dict(labels)
        for n in free:
            votes = Counter(labels[m] for m in near[n])
            if votes:
                new[n] = min(votes, key=lambda c: (-votes[c], c))
        labels = new
    return labels


@pytest.mark.parametrize("most", [0.5, 0.0])
def test_update_communities(spark, most):
    pairs = [("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "h"), ("h", "i"), ("x", "a")]
    before = {"a": "1", "b": "1", "c": "1", "d": "2", "e": "2", "f": "2", "g": "3", "h": "3", "i": "3"}
    edges = spark.createDataFrame(pairs, "src string, dst string")
    known = spark.createDataFrame([*before.items()], "id string, community string")
    got = {r["id"]: r["community"] for r in graph.update_communities(edges, spark.createDataFrame([("x",)], "id string"), known, 3, most).collect()}
    nodes = {n: before.get(n, n) for p in pairs for n in p}
    free = {"x", "a"} if most else set(nodes)
    assert got == spread(pairs, free, nodes, 3)


def test_drawn_and_largest(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b"), ("c", "d")], "src string, dst string")
    communities = spark.createDataFrame([("a", 12), ("b", None)], "id string, community bigint")
    got = {r["id"]: (r["community"], r["degree"], r["size"], r["colour"]) for r in graph.drawn(edges, communities, 3).collect()}
    assert got == {"a": (12, 3, 19, 2), "b": (0, 2, 16, 0), "c": (0, 1, 13, 0)}
    sizes = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q")], "id bigint, community string")
    assert [(r["place"], r["community"], r["size"]) for r in graph.largest_communities(sizes, 1).collect()] == [(1, "q", 2)]


def test_settings_and_flows(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    c = spark.createDataFrame([(1, "a", None), (2, "c", "x"), (3, "c", "y"), (4, "a", "3"), (5, "b", None)], "seq bigint, key string, value string")
    assert sorted((r["key"], r["value"]) for r in point.settings_after(s, c).collect()) == [("a", "3"), ("c", "y")]
    assert sorted((r["key"], r["value"]) for r in point.settings_after(s, c.where("false")).collect()) == [("a", "1"), ("b", "2")]
    e = spark.createDataFrame([(1, 1, 1, "h"), (1, 2, 2, "h"), (1, 3, 3, None), (1, 4, 4, None), (2, 1, 5, "h")], "path bigint, ts bigint, seq bigint, hash string")
    assert sorted(r["seq"] for r in point.changed(e, "path").collect()) == [1, 3, 5]


def test_prompts_on_odd_rows(spark):
    hits = spark.createDataFrame([(1, 1, "a.py", "method", "m", "A.m", 1, 2)], "query_id bigint, rank bigint, rel_path string, kind string, name string, qualified_name string, line_start bigint, line_end bigint")
    asked = spark.createDataFrame([(1, "file_overview"), (2, "file_overview"), (1, None)], "query_id bigint, intent string")
    assert {(r["query_id"], r["intent"]): r["preamble"] for r in context.preamble(hits, asked).collect()} == {(1, "file_overview"): "# File Overview: a.py\n# Contents:", (2, "file_overview"): "", (1, None): ""}
    hunks = spark.createDataFrame([(1, 1, "f", 3, 2, "x\n```", "y")], "id bigint, hunk bigint, file string, new_start bigint, new_count bigint, added string, removed string")
    none = spark.createDataFrame([], "id bigint, hunk bigint, context string")
    assert context.review_prompts(hunks, none).first()["prompt"] == "File: f (lines 3–5)\n\nChanged code:\n````\n- y\n+ x\n+ ```\n````\n\nProvide review comments as a JSON array."
