"""Queries on graphs and on resolving names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekframe.operators import graph, resolve
from seekframe.plans.tables import EDGES, SYMBOLS, part_edges, part_symbols, table


def _seeds(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


SEEDS = ["p:1", "p:7", "p:42"]
_SEED_SQL = ", ".join(f"('{s}')" for s in SEEDS)


def _bfs(direction: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = graph.bfs(part_edges(spark, sf_dir), _seeds(spark, SEEDS), 2, direction)
        return graph.expansion_scores(found, 1.0)

    return query


def _bfs_sql(direction: str) -> str:
    steps = {"both": "u", "forward": "e", "reverse": "(SELECT dst AS src, src AS dst FROM e)"}[direction]
    return f"""
WITH RECURSIVE {EDGES}, w AS (SELECT DISTINCT src, dst FROM {steps}), r AS (
  SELECT col0 AS id, 0::BIGINT AS hop FROM (VALUES {_SEED_SQL}) UNION SELECT w.dst, hop + 1 FROM r JOIN w ON w.src = r.id WHERE hop < 2)
SELECT id, min(hop) AS hop, round(pow(0.5::DOUBLE, min(hop)), 9) AS score FROM r GROUP BY id"""


def callers_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers_callees(part_edges(spark, sf_dir), _seeds(spark, SEEDS))


CALLERS_SQL = f"""
WITH {EDGES}, s AS (SELECT col0 AS id FROM (VALUES {_SEED_SQL}))
SELECT DISTINCT src AS id, 'caller' AS direction FROM e WHERE dst IN (SELECT id FROM s) UNION SELECT dst, 'callee' FROM e WHERE src IN (SELECT id FROM s)"""

ROUNDS = 8


def _pagerank_sql(teleport: bool) -> str:
    v = "CASE WHEN id IN (SELECT id FROM tp) THEN 1::DOUBLE / (SELECT count(*) FROM tp) ELSE 0::DOUBLE END" if teleport else "1::DOUBLE / (SELECT count(*) FROM nn)"
    steps = ", ".join(
        f"""r{i} AS MATERIALIZED (SELECT n.id, n.v, 0.15::DOUBLE * n.v + 0.85::DOUBLE * (coalesce(g.got, 0) + l.lost * n.v) AS rank FROM n
  LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r{i - 1} JOIN k ON k.src = r{i - 1}.id GROUP BY 1) g ON g.dst = n.id,
  (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM k)) l)"""
        for i in range(1, ROUNDS + 1)
    )
    return f"""
WITH {EDGES}, w AS (SELECT src, dst, count(*)::DOUBLE AS w FROM e GROUP BY 1, 2), k AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w),
nn AS (SELECT src AS id FROM e UNION SELECT dst FROM e), tp AS (SELECT col0 AS id FROM (VALUES {_SEED_SQL}) WHERE col0 IN (SELECT id FROM nn)), n AS MATERIALIZED (SELECT id, {v} AS v FROM nn),
r0 AS (SELECT id, v, 1::DOUBLE / (SELECT count(*) FROM nn) AS rank FROM n), {steps}
SELECT id, round(rank / (SELECT max(rank) FROM r{ROUNDS}), 6) AS rank FROM r{ROUNDS}"""


def pagerank_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(part_edges(spark, sf_dir), ROUNDS, normalise=True).select("id", F.round("rank", 6).alias("rank"))


def pagerank_personalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(part_edges(spark, sf_dir), ROUNDS, teleport=_seeds(spark, SEEDS), normalise=True).select("id", F.round("rank", 6).alias("rank"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(part_edges(spark, sf_dir))


#: The least label around, twelve times over: enough for a graph whose nodes are so many steps apart at most.
COMPONENTS_SQL = f"""
WITH {EDGES}, l0 AS (SELECT DISTINCT src AS id, src AS component FROM u), """ + ", ".join(
    f"""l{i} AS MATERIALIZED (SELECT src AS id, least(any_value(a.component), min(b.component)) AS component FROM u JOIN l{i - 1} a ON a.id = src JOIN l{i - 1} b ON b.id = dst GROUP BY src)""" for i in range(1, 13)
) + " SELECT id, component FROM l12"


def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(part_edges(spark, sf_dir), 3)


LABELS_SQL = f"""
WITH {EDGES}, l0 AS (SELECT DISTINCT src AS id, src AS community FROM u), """ + ", ".join(
    f"""l{i} AS MATERIALIZED (SELECT src AS id, community FROM (SELECT src, community, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, community) AS n
  FROM u JOIN l{i - 1} ON l{i - 1}.id = u.dst GROUP BY src, community) WHERE n = 1)"""
    for i in range(1, 4)
) + " SELECT id, community FROM l3"


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_brand").alias("community"), F.col("p_type").alias("grp"), F.col("p_name").alias("name"))


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.modularity(part_edges(spark, sf_dir), _brands(spark, sf_dir).select("id", "community"))


MODULARITY_SQL = f"""
WITH {EDGES}, c AS (SELECT 'p:' || p_partkey AS id, p_brand AS community FROM part), t AS (SELECT a.community AS a, b.community AS b FROM u JOIN c a ON a.id = u.src JOIN c b ON b.id = u.dst
), p AS (SELECT a, sum(CASE WHEN a = b THEN 1::DOUBLE ELSE 0 END) AS inside, count(*)::DOUBLE AS degree, (SELECT count(*)::DOUBLE FROM t) AS m2 FROM t GROUP BY 1
), z AS (SELECT community, count(*) AS size FROM c GROUP BY 1)
SELECT (SELECT round(sum(inside / m2 - pow(degree / m2, 2)), 6) FROM p) AS modularity, (SELECT count(*) FROM z) AS communities, (SELECT sum((size = 1)::BIGINT)::BIGINT FROM z) AS singletons,
  (SELECT max(size) FROM z) AS largest, (SELECT count(*) FROM c WHERE id NOT IN (SELECT src FROM u)) AS isolated"""


def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_centrality(part_edges(spark, sf_dir))


DEGREE_SQL = f"""
WITH {EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT id, degree, round(degree / (SELECT count(*) - 1 FROM d)::DOUBLE, 9) AS centrality FROM d"""


def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_summary(_brands(spark, sf_dir))


SUMMARY_SQL = """
WITH n AS (SELECT 'p:' || p_partkey AS id, p_brand AS community, p_type AS grp, p_name AS name FROM part
), g AS (SELECT community, string_agg(grp, ',' ORDER BY i) AS top_groups FROM (SELECT community, grp, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, grp) AS i FROM n GROUP BY 1, 2) WHERE i <= 5 GROUP BY 1
), f AS (SELECT community, string_agg(name, ',' ORDER BY i) AS names FROM (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY name, id) AS i FROM n) WHERE i <= 10 GROUP BY 1)
SELECT community, (SELECT count(*) FROM n WHERE n.community = g.community) AS size, top_groups, names FROM g JOIN f USING (community)"""


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.frontier(part_edges(spark, sf_dir), _seeds(spark, SEEDS), _brands(spark, sf_dir).select("id", "community"))


FRONTIER_SQL = f"""
WITH {EDGES}, s AS (SELECT col0 AS id FROM (VALUES {_SEED_SQL})), c AS (SELECT 'p:' || p_partkey AS id, p_brand AS community FROM part)
SELECT id FROM s UNION SELECT dst FROM u WHERE src IN (SELECT id FROM s) UNION SELECT id FROM c WHERE community IN (SELECT community FROM c WHERE id IN (SELECT id FROM s))"""


def type_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations extend regions: parents and children of two nodes, at a fifth of the first hit's score."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("src"), F.concat(F.lit("r:"), "n_regionkey").alias("dst"))
    seeds = spark.createDataFrame([("n:3", 1), ("r:1", 2)], "id string, place int")
    return graph.expand_types(nation, seeds, 0.8)


TYPES_SQL = """
WITH e AS (SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst FROM nation), x AS (SELECT 1 AS place, 0 AS way, dst AS id FROM e WHERE src = 'n:3' UNION ALL (SELECT 2, 1, src FROM e WHERE dst = 'r:1' ORDER BY src LIMIT 15)
), o AS (SELECT id, row_number() OVER (ORDER BY min([place, way]), id) AS rank FROM x WHERE id NOT IN ('n:3', 'r:1') GROUP BY id)
SELECT id, 0.16::DOUBLE AS score, rank FROM o WHERE rank <= 5"""


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.concat("p_type", F.lit("/"), "p_brand").alias("grp"))
    imports = part_edges(spark, sf_dir).join(symbols.select(F.col("id").alias("src"), F.col("grp").alias("a")), "src").join(symbols.select(F.col("id").alias("dst"), F.col("grp").alias("b")), "dst")
    return graph.blast_radius(part_edges(spark, sf_dir), imports.select(F.col("a").alias("src"), F.col("b").alias("dst")), symbols, _seeds(spark, SEEDS))


BLAST_SQL = f"""
WITH {EDGES}, t AS (SELECT col0 AS id FROM (VALUES {_SEED_SQL})), s AS (SELECT 'p:' || p_partkey AS id, p_type || '/' || p_brand AS grp FROM part
), i AS (SELECT a.grp AS src, b.grp AS dst FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst
), f AS (SELECT DISTINCT grp FROM s WHERE id IN (SELECT id FROM t)
), x AS (SELECT src AS id, 0 AS way FROM e WHERE dst IN (SELECT id FROM t) UNION ALL SELECT id, 1 FROM s WHERE grp IN (SELECT src FROM i WHERE dst IN (SELECT grp FROM f))
), y AS (SELECT id, min(way) AS way FROM x WHERE id NOT IN (SELECT id FROM t) GROUP BY 1)
SELECT grp, id, CASE way WHEN 0 THEN 'call' ELSE 'import' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY way, id) AS n FROM y JOIN s USING (id)) WHERE n = 1"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made of parts: by qualified name, by name with a hint, by name alone, or of nothing that exists."""
    s = part_symbols(spark, sf_dir)
    name = F.when(F.col("id") % 4 == 0, F.col("qualified_name")).when(F.col("id") % 4 == 3, F.concat(F.lit("no_"), "name")).otherwise(F.col("name"))
    return s.select(F.col("id").alias("call_id"), name.alias("callee_name"), F.when(F.col("id") % 4 == 1, F.substring_index("qualified_name", ".", 1)).alias("hint"))


def resolve_calls_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_calls(_calls(spark, sf_dir), part_symbols(spark, sf_dir))


CALLS_SQL = f"""
WITH {SYMBOLS}, c AS (SELECT id AS call_id, CASE id % 4 WHEN 0 THEN qualified_name WHEN 3 THEN 'no_' || name ELSE name END AS callee_name, CASE WHEN id % 4 = 1 THEN split_part(qualified_name, '.', 1) END AS hint FROM sym
), r AS (SELECT *, (SELECT min(id) FROM sym WHERE qualified_name = callee_name) AS a, (SELECT min(id) FROM sym WHERE name = callee_name AND starts_with(qualified_name, hint || '.')) AS b,
  (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM sym WHERE name = callee_name) AS d FROM c)
SELECT call_id, callee_name, coalesce(a, b, d) AS callee_id, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN d IS NOT NULL THEN 3 END::BIGINT AS step FROM r"""


def resolve_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = part_symbols(spark, sf_dir)
    return resolve.resolve_types(s.select(F.col("id").alias("edge_id"), F.col("name").alias("to_type_name")), s)


TYPE_EDGES_SQL = f"""
WITH {SYMBOLS} SELECT id AS edge_id, name AS to_type_name, (SELECT min(id) FROM sym b WHERE b.name = a.name AND kind IN ('class', 'interface', 'struct', 'enum')) AS to_symbol_id FROM sym a"""


def resolve_import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are the paths of page urls; each page imports the next page: by its dotted name, relative to its package, or by a relative path."""
    url = r"^\w+://([^/?#]+)/(\w+)/(\d+)"
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", url, 1), r"\.", "_").alias("host"), F.regexp_extract("url", url, 2).alias("dir"), F.regexp_extract("url", url, 3).alias("n")).where("n <> ''")
    files = paths.select(F.col("page_id").alias("file_id"), F.concat_ws("/", "host", "dir", F.concat("n", F.lit(".py"))).alias("rel_path"))
    next_ = paths.select((F.col("page_id") - 1).alias("page_id"), F.concat_ws(".", "host", "dir", "n").alias("dotted"), F.concat(F.lit(".."), F.concat_ws(".", "dir", "n")).alias("relative"), F.concat(F.lit("../"), F.concat_ws("/", "dir", "n"), F.lit(".py")).alias("path"))
    turn = F.col("page_id") % 3
    imports = paths.join(next_, "page_id").select(F.col("page_id").alias("import_id"), F.col("page_id").alias("file_id"), F.when(turn == 0, F.col("dotted")).when(turn == 1, F.col("relative")).otherwise(F.col("path")).alias("specifier"))
    return resolve.resolve_imports(imports, files).select("import_id", "specifier", "target_id")


IMPORTS_SQL = r"""
WITH p AS (SELECT page_id, replace(regexp_extract(url, '^\w+://([^/?#]+)/(\w+)/(\d+)', 1), '.', '_') AS host, regexp_extract(url, '^\w+://([^/?#]+)/(\w+)/(\d+)', 2) AS dir, regexp_extract(url, '^\w+://([^/?#]+)/(\w+)/(\d+)', 3) AS n FROM pages
), f AS (SELECT host || '/' || dir || '/' || n AS k, min(page_id) AS f FROM p WHERE n <> '' GROUP BY 1
), i AS (SELECT a.page_id, a.host, b.host AS h2, b.dir AS d2, b.n AS n2 FROM p a JOIN p b ON b.page_id = a.page_id + 1 WHERE a.n <> '' AND b.n <> ''
), t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN h2 || '.' || d2 || '.' || n2 WHEN 1 THEN '..' || d2 || '.' || n2 ELSE '../' || d2 || '/' || n2 || '.py' END AS specifier,
  CASE page_id % 3 WHEN 0 THEN h2 ELSE host END || '/' || d2 || '/' || n2 AS k FROM i)
SELECT page_id AS import_id, specifier, CASE WHEN f <> page_id THEN f END AS target_id FROM t LEFT JOIN f USING (k)"""


def selector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a component with a selector and an element with the name of another's; some edges are there already."""
    part = part_symbols(spark, sf_dir)
    decorated = part.select("id", F.array(F.concat(F.lit("Component({selector: 'app-"), F.lower(F.regexp_replace("qualified_name", r"[._]", "-")), F.lit("'})"))).alias("decorators"))
    elements = part.select((F.col("id") + 1).alias("id"), F.concat(F.lit("app-"), F.lower(F.regexp_replace("qualified_name", r"[._]", "-"))).alias("name"))
    existing = part.where("id % 2 = 0").select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    return resolve.selector_edges(decorated, elements, existing)


SELECTOR_SQL = f"""
WITH {SYMBOLS} SELECT DISTINCT e.id + 1 AS src, d.id AS dst FROM sym e JOIN sym d ON lower(replace(replace(d.qualified_name, '.', '-'), '_', '-')) = lower(replace(replace(e.qualified_name, '.', '-'), '_', '-'))
WHERE NOT (e.id = d.id AND e.id % 2 = 0)"""


def artifact_linker(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    texts = part.select(F.concat(F.lit("ticket:"), "p_partkey").alias("ref"), F.concat(F.lit("Fix "), "p_name", F.lit(" and "), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("."), F.regexp_replace("p_name", " ", "_"), F.lit("_"), (F.col("p_partkey") % 97).cast("string"), F.lit(".")).alias("text"))
    return resolve.link_texts(texts, part_symbols(spark, sf_dir))


LINKER_SQL = f"""
WITH {SYMBOLS}, t AS (SELECT 'ticket:' || p_partkey AS ref, unnest(regexp_extract_all('Fix ' || p_name || ' and ' || lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '_') || '_' || (p_partkey % 97) || '.', '[A-Za-z_][A-Za-z0-9_.]{{2,}}')) AS w FROM part
), k AS (SELECT key, min(id) AS symbol_id FROM (SELECT lower(name) AS key, id FROM sym WHERE lower(name) NOT IN ('get','set','run','test','tests','process','update','data','file','files') UNION ALL SELECT lower(qualified_name), id FROM sym) GROUP BY 1)
SELECT DISTINCT ref, symbol_id FROM t JOIN k ON key = lower(rtrim(w, '.'))"""


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_type", "p_brand", F.col("p_size").cast("string")).alias("grp"))


def ticket_linker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit that touches the files of its parts and names its customer's ticket."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("id"))
    # dealt out by commit as plain rows: sets made before would be larger than the rows
    files = lines.join(_part_files(spark, sf_dir).hint("merge"), "id").select("commit_id", "grp").repartition("commit_id").groupBy("commit_id").agg(F.collect_set("grp").alias("files"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.concat(F.lit("Fix PROJ-"), F.col("o_custkey"), F.lit(" from feature-ENG-"), F.col("o_custkey"), F.lit("-branch, see UTF-8, SHA3-256, CVE-2021-44228, xAB-1, AB-1x")).alias("message"))
    return resolve.link_tickets(orders.join(files.hint("merge"), "commit_id"), _part_files(spark, sf_dir))


TICKET_SQL = """
WITH f AS (SELECT p_partkey AS id, p_type || '/' || p_brand || '/' || p_size AS grp FROM part
), c AS (SELECT DISTINCT o_custkey, grp FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN f ON id = l_partkey)
SELECT DISTINCT id AS symbol_id, unnest(['PROJ-' || o_custkey, 'ENG-' || o_custkey]) AS ticket FROM c JOIN f USING (grp)"""


def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat_ws("/", "p_type", F.regexp_replace("p_brand", "#", ""), F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".py"))).alias("rel_path"))
    asked = files.select(F.substring_index("rel_path", "/", -2).alias("suffix")).unionByName(files.select(F.substring_index("rel_path", "/", -1).alias("suffix"))).distinct()
    return resolve.suffix_lookup(files, asked)


SUFFIX_SQL = """
WITH f AS (SELECT p_partkey AS file_id, p_type || '/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '_' || p_size || '.py' AS rel_path FROM part
), a AS (SELECT split_part(rel_path, '/', 2) || '/' || split_part(rel_path, '/', 3) AS suffix, file_id FROM f UNION ALL SELECT split_part(rel_path, '/', 3), file_id FROM f)
SELECT suffix, min(file_id) AS file_id FROM a GROUP BY 1 HAVING count(*) = 1"""


def scip_symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seekframe.functions.text import scip_id

    return part_symbols(spark, sf_dir).select("id", scip_id(F.col("grp"), F.lit("1.0"), F.col("qualified_name")).alias("scip_id"))


SCIP_SQL = f"WITH {SYMBOLS} SELECT id, substr(sha256(grp || '||' || '1.0' || '||' || qualified_name), 1, 16) AS scip_id FROM sym"


def louvain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the communities found are better than each node alone, whose modularity is given."""
    edges = part_edges(spark, sf_dir)
    found = graph.modularity(edges, graph.louvain(edges, 4)).select("modularity", "isolated")
    alone = graph.modularity(edges, graph.nodes_of(edges).select("id", F.col("id").alias("community"))).select(F.col("modularity").alias("alone"))
    return alone.crossJoin(found).select("alone", (F.col("modularity") > F.col("alone")).alias("better"), "isolated")


LOUVAIN_SQL = f"""
WITH {EDGES}, d AS (SELECT src, count(*)::DOUBLE AS k FROM u GROUP BY 1), m AS (SELECT sum(k) AS m2 FROM d)
SELECT round(-sum(pow(k / m2, 2)), 6) AS alone, true AS better, 0::BIGINT AS isolated FROM d, m"""


def _part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("class", "function", "method", "interface")]), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.concat("p_type", F.lit("/"), "p_brand").alias("grp"), kinds.alias("kind"), F.col("p_partkey").alias("line"))


def call_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    ranks = graph.pagerank(edges, ROUNDS, normalise=True).select("id", F.round("rank", 6).alias("rank"))
    return graph.expand_calls(edges, _seeds(spark, SEEDS), ranks, 0.8, 1, 10)


EXPAND_SQL = f"""
WITH {EDGES}, s AS (SELECT col0 AS id FROM (VALUES {_SEED_SQL})), n AS (SELECT DISTINCT dst AS id FROM u WHERE src IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM s)), pr AS ({_pagerank_sql(False)}
), o AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN (SELECT count(*) FROM n) >= 3 THEN pr.rank ELSE 0 END DESC, id) AS r FROM n JOIN pr USING (id))
SELECT id, 1::BIGINT AS hop, 0.4::DOUBLE AS score, r AS rank FROM o WHERE r <= 10"""


def import_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges = _part_groups(spark, sf_dir), part_edges(spark, sf_dir)
    a, b = (symbols.select(F.col("id").alias(end), F.col("grp").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    imports = edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.expand_imports(imports, symbols.where(F.col("id").isin(SEEDS)).select("grp"), symbols, 0.8, most=100)


IMPORT_EXPANSION_SQL = f"""
WITH {EDGES}, y AS (SELECT 'p:' || p_partkey AS id, p_type || '/' || p_brand AS grp, p_partkey AS line, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS k FROM part
), i AS (SELECT DISTINCT a.grp AS src, b.grp AS dst FROM e JOIN y a ON a.id = e.src JOIN y b ON b.id = e.dst
), s AS (SELECT DISTINCT grp FROM y WHERE id IN (SELECT col0 FROM (VALUES {_SEED_SQL}))
), f AS (SELECT dst AS grp FROM i WHERE src IN (SELECT grp FROM s) UNION SELECT src FROM i WHERE dst IN (SELECT grp FROM s)
), g AS (SELECT grp FROM f WHERE grp NOT IN (SELECT grp FROM s) ORDER BY grp LIMIT (SELECT 60 - count(*) FROM s)
), t AS (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY k, line, id) AS n FROM y WHERE grp IN (SELECT grp FROM g)
), o AS (SELECT id, grp, row_number() OVER (ORDER BY grp, n) AS rank FROM t WHERE n <= 3)
SELECT id, grp, 0.12::DOUBLE AS score, rank FROM o WHERE rank <= 100"""


def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graph.bfs(part_edges(spark, sf_dir), _seeds(spark, SEEDS[:1]), 1)
    return graph.subgraph(part_edges(spark, sf_dir).distinct(), near)


SUBGRAPH_SQL = f"""
WITH {EDGES}, n AS (SELECT dst AS id FROM u WHERE src = '{SEEDS[0]}' UNION SELECT '{SEEDS[0]}') SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)"""


def typed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _part_groups(spark, sf_dir)
    files = symbols.select(F.col("id").alias("src"), F.concat(F.lit("f:"), "grp").alias("dst"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("src"), F.concat(F.lit("r:"), "n_regionkey").alias("dst"))
    tickets = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("src"), F.concat(F.lit("n:"), "s_nationkey").alias("dst"), F.lit("mentions").alias("kind"), F.lit(0.5).alias("weight"))
    return graph.code_graph(part_edges(spark, sf_dir), files, nation, tickets).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.sum("weight").alias("weight"))


TYPED_SQL = f"""
WITH {EDGES}, x AS (SELECT DISTINCT src, dst, 'calls' AS kind, 1::DOUBLE AS weight FROM e UNION ALL SELECT DISTINCT 'p:' || p_partkey, 'f:' || p_type || '/' || p_brand, 'imports', 1 FROM part
  UNION ALL SELECT DISTINCT 'n:' || n_nationkey, 'r:' || n_regionkey, 'extends', 1 FROM nation UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'mentions', 0.5 FROM supplier UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'mentions', 0.5 FROM supplier)
SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, sum(weight) AS weight FROM x GROUP BY 1"""


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(part_edges(spark, sf_dir), "p:1", "p:42").select(F.col("place").cast("long").alias("place"), "id")


PATH_SQL = f"""
WITH RECURSIVE {EDGES}, r AS (SELECT 'p:1' AS id, 0 AS hop UNION SELECT dst, hop + 1 FROM r JOIN u ON src = id WHERE hop < 4), h AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1
), w AS (SELECT id, hop FROM h WHERE id = 'p:42' UNION ALL SELECT (SELECT min(h.id) FROM h JOIN u ON u.src = h.id AND u.dst = w.id WHERE h.hop = w.hop - 1), hop - 1 FROM w WHERE hop > 0)
SELECT hop::BIGINT AS place, id FROM w"""


QUERIES = {
    "bfs_2hop": (_bfs("both"), _bfs_sql("both")),
    "import_expand_forward": (_bfs("forward"), _bfs_sql("forward")),
    "import_expand_reverse": (_bfs("reverse"), _bfs_sql("reverse")),
    "callers_callees": (callers_callees, CALLERS_SQL),
    "pagerank_uniform": (pagerank_uniform, _pagerank_sql(False)),
    "pagerank_personalised": (pagerank_personalised, _pagerank_sql(True)),
    "connected_components": (connected_components, COMPONENTS_SQL),
    "label_propagation": (label_propagation, LABELS_SQL),
    "modularity": (modularity, MODULARITY_SQL),
    "degree_centrality": (degree_centrality, DEGREE_SQL),
    "community_summary": (community_summary, SUMMARY_SQL),
    "community_frontier": (frontier, FRONTIER_SQL),
    "type_expansion": (type_expansion, TYPES_SQL),
    "blast_radius": (blast_radius, BLAST_SQL),
    "resolve_calls_cascade": (resolve_calls_cascade, CALLS_SQL),
    "resolve_types": (resolve_types, TYPE_EDGES_SQL),
    "resolve_import_paths": (resolve_import_paths, IMPORTS_SQL),
    "selector_edges": (selector_edges, SELECTOR_SQL),
    "artifact_linker": (artifact_linker, LINKER_SQL),
    "ticket_linker": (ticket_linker, TICKET_SQL),
    "suffix_lookup": (suffix_lookup, SUFFIX_SQL),
    "scip_symbol_ids": (scip_symbol_ids, SCIP_SQL),
    "louvain_quality": (louvain_quality, LOUVAIN_SQL),
    "call_expansion": (call_expansion, EXPAND_SQL),
    "import_expansion": (import_expansion, IMPORT_EXPANSION_SQL),
    "induced_subgraph": (induced_subgraph, SUBGRAPH_SQL),
    "typed_graph": (typed_graph, TYPED_SQL),
    "shortest_path": (shortest_path, PATH_SQL),
}
