"""Cascades that turn names into ids.  Each pass touches only what the passes before left open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_calls(calls: DataFrame, symbols: DataFrame, strict: bool = False) -> DataFrame:
    """``calls`` (call_id, callee_name, hint) with callee_id and the pass that found it.

    1: the name is a qualified name; 2: the hint qualifies it; 3: it is the only symbol of
    that name.  Passes 1 and 2 take the smallest id, or with ``strict`` only a single one.
    """
    def unique(df: DataFrame, *key: str) -> DataFrame:
        out = df.groupBy(*key).agg(F.min("id").alias("found"), F.count(F.lit(1)).alias("n"))
        return out.where("n = 1") if strict else out

    exact = unique(symbols.select("id", F.col("qualified_name").alias("callee_name")), "callee_name").select("callee_name", F.col("found").alias("id1"))
    hinted = calls.where(F.col("hint").isNotNull()).select("callee_name", "hint").distinct()
    hinted = hinted.join(symbols.select("id", F.col("name").alias("callee_name"), "qualified_name"), "callee_name").where(F.startswith("qualified_name", F.concat("hint", F.lit("."))))
    hinted = unique(hinted, "callee_name", "hint").select("callee_name", "hint", F.col("found").alias("id2"))
    single = symbols.groupBy(F.col("name").alias("callee_name")).agg(F.min("id").alias("id3"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    joined = calls.join(exact, "callee_name", "left").join(hinted, ["callee_name", "hint"], "left").join(single, "callee_name", "left")
    step = F.when(F.col("id1").isNotNull(), 1).when(F.col("id2").isNotNull(), 2).when(F.col("id3").isNotNull(), 3)
    return joined.select("call_id", "callee_name", F.coalesce("id1", "id2", "id3").alias("callee_id"), step.cast("long").alias("step"))


# Extensions of modules, folders that module names leave out, and names that are never files of a repository.
MODULE_EXTENSIONS = "py ts tsx js jsx mjs go rs java".split()
SOURCE_ROOTS = "src lib app".split()
FOREIGN = "java. javax. android. kotlin. std:: core:: alloc:: react vue @angular @types/ lodash axios express next nuxt".split()


def _module_keys(files: DataFrame) -> DataFrame:
    """key, file_id, exact: the names by which files are imported; one file for each, whole paths before folders before last parts."""
    extension = F.regexp_extract("rel_path", r"\.([A-Za-z]+)$", 1)
    known = extension.isin(MODULE_EXTENSIONS)
    stem = F.when(known, F.regexp_replace("rel_path", r"\.[A-Za-z]+$", "")).otherwise(F.col("rel_path"))
    # a folder is a module by a file in it, whose name depends on the language
    stem = F.when(extension == "rs", F.regexp_replace(stem, "/mod$", "")).when(extension.isin("ts", "tsx", "js", "jsx", "mjs"), F.regexp_replace(stem, "/index$", "")).otherwise(stem)
    rooted = lambda c: F.regexp_replace(c, f"^({'|'.join(SOURCE_ROOTS)})/", "")
    rows = files.select("file_id", stem.alias("stem")).withColumn("folder", F.when(F.endswith("stem", F.lit("/__init__")), F.regexp_replace("stem", "/__init__$", "")))
    key = lambda turn, c: F.struct(F.lit(turn).alias("turn"), c.alias("key"))
    keys = F.array(key(0, F.col("stem")), key(0, rooted(F.col("stem"))), key(1, F.col("folder")), key(1, rooted(F.col("folder"))), key(2, F.element_at(F.split("stem", "/"), -1)))
    rows = rows.select("file_id", F.explode(keys).alias("k")).where("k.key IS NOT NULL AND k.key <> ''")
    best = rows.groupBy("k.key").agg(F.min(F.struct("k.turn", "file_id")).alias("best"))
    return best.select("key", F.col("best.file_id").alias("target_id"), (F.col("best.turn") < 2).alias("exact"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (import_id, file_id, specifier) with target_id, the file that the specifier means to the importing file.

    ``files``: file_id, rel_path.  A relative specifier names one exact path: dots without a slash
    climb from the importer's package (one dot stays), a path climbs by its ``..``; there is no
    fallback to similar names.  Others try their whole name and its last parts.  A file does not
    import itself; bare words and well-known packages are no files.
    """
    paths = files.select("file_id", F.split("rel_path", "/").alias("parts")).select("file_id", F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))).alias("dirs"))
    asked = imports.join(paths, "file_id", "left").withColumn("dirs", F.coalesce("dirs", F.array().cast("array<string>")))
    name = F.col("specifier")
    dots = F.length(F.regexp_extract(name, r"^\.*", 0))
    stay = F.size("dirs") - (dots - 1)
    package = F.when(stay >= 0, F.array_join(F.concat(F.slice("dirs", 1, F.greatest(stay, F.lit(0))), F.filter(F.split(F.regexp_replace(name, r"^\.+", ""), r"\."), lambda x: x != "")), "/"))

    def climb(done, part):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when((part == "") | (part == "."), done).otherwise(F.concat(done, F.array(part)))

    path = F.array_join(F.aggregate(F.split(name, "/"), F.col("dirs"), climb), "/")
    bare = F.regexp_replace(path, r"\.(ts|tsx|js|jsx|mjs|py)$", "")
    tails = lambda c, *n: [F.when(F.size(F.split(c, "/")) >= i, F.array_join(F.slice(F.split(c, "/"), -i, i), "/")) for i in n]
    dotted = F.regexp_replace(name, r"\.", "/")
    crate = F.regexp_replace(F.regexp_replace(name, r"^(crate::)?(super::)?(self::)?", ""), "::", "/")
    foreign = F.lit(False)
    for x in FOREIGN:
        foreign = foreign | (name == x) | F.startswith(name, F.lit(x + ".")) | F.startswith(name, F.lit(x + "/")) | F.startswith(name, F.lit(x + "::"))
    nothing = F.array().cast("array<string>")
    relative = F.startswith(name, F.lit("."))
    tries = (
        F.when(relative & ~F.contains(name, F.lit("/")), F.array(package))
        .when(relative, F.array(path, bare))
        .when(foreign | ~name.rlike(r"[./]|::"), nothing)
        .when(F.contains(name, F.lit("/")), F.array(*tails(name, 3, 2, 1)))
        .when(F.contains(name, F.lit("::")), F.array(crate, *tails(crate, 2, 1)))
        .otherwise(F.array(dotted, *tails(dotted, 2, 1)))
    )
    turns = asked.select("import_id", "file_id", relative.alias("relative"), F.posexplode(tries).alias("turn", "key")).where("key IS NOT NULL AND key <> ''")
    hits = turns.join(_module_keys(files), "key").where(~F.col("relative") | F.col("exact"))
    first = hits.groupBy("import_id", "file_id").agg(F.min(F.struct("turn", "target_id")).alias("hit"))
    found = first.select("import_id", F.col("hit.target_id").alias("target_id")).where(F.col("target_id") != F.col("file_id"))
    return imports.join(found, "import_id", "left")


def resolve_types(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``edges`` (edge_id, to_type_name) with the smallest id of a class, interface, enum or struct of that name."""
    kinds = ["class", "interface", "struct", "enum"]
    named = symbols.where(F.col("kind").isin(kinds)).groupBy(F.col("name").alias("to_type_name")).agg(F.min("id").alias("to_symbol_id"))
    return edges.join(named, "to_type_name", "left").select("edge_id", "to_type_name", "to_symbol_id")


def selector_edges(decorated: DataFrame, elements: DataFrame, existing: DataFrame) -> DataFrame:
    """Component symbols joined with the markup elements their selector names, new ones only.

    ``decorated``: id, decorators (array); ``elements``: id, name; ``existing``: src, dst.
    """
    named = decorated.select("id", F.explode("decorators").alias("d")).select(F.col("id").alias("dst"), F.regexp_extract("d", r"selector\s*:\s*['\"]([\w-]+)['\"]", 1).alias("name")).where("name <> ''")
    found = elements.select(F.col("id").alias("src"), "name").join(named, "name").select("src", "dst").distinct()
    return found.join(existing, ["src", "dst"], "left_anti")


# Words too common to link a text to a symbol by its bare name.
COMMON_NAMES = "get set run test tests process update data file files".split()


def link_texts(texts: DataFrame, symbols: DataFrame, common: list[str] | None = None) -> DataFrame:
    """ref, symbol_id for each symbol that a text names; of several of one name the smallest id.

    ``texts``: ref, text.  ``symbols``: id, name, qualified_name.
    """
    found = texts.select("ref", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_.]{2,}"), F.lit(0)), lambda t: F.lower(F.rtrim(t, F.lit(".")))))).alias("key"))
    bare = symbols.select("id", F.lower("name").alias("key")).where(~F.col("key").isin(common if common is not None else COMMON_NAMES))
    full = symbols.select("id", F.lower("qualified_name").alias("key"))
    index = bare.unionByName(full).groupBy("key").agg(F.min("id").alias("symbol_id"))
    return found.join(index, "key").select("ref", "symbol_id").distinct()


# Names before a hyphen and a number that are no ticket keys, and the pattern of a key.
NOT_TICKETS = "UTF SHA MD HTTP HTTPS BASE ISO RFC AES RSA SSL TLS IPV CRC HMAC PBKDF ARGON SIMD X EC GB KB MB TB PY CVE PEP RFE ADR".split()
TICKET = r"(?<![A-Za-z0-9])(?!(?:" + "|".join(NOT_TICKETS) + r")[0-9]*-\d)[A-Z][A-Z0-9]{1,9}-\d+(?![A-Za-z0-9])"


# Fixed value: the rows of one file are dealt out over so many groups, so a file that most tickets touch is no single task.
SPREAD = 8


def link_tickets(commits: DataFrame, symbols: DataFrame, pattern: str = TICKET) -> DataFrame:
    """symbol_id, ticket for the symbols of files that a commit naming the ticket touched.

    ``commits``: commit_id, message, files (array).  ``symbols``: id, grp (file).  Files and tickets are
    paired once before symbols are looked up.  The result, far larger than its inputs, is never sorted out:
    each symbol belongs to one file or one set of files, and each of these meets a ticket once.
    No side is broadcast, whatever its files' sizes promise: all of them grow with the input, and spread symbols more so.
    """
    tickets = commits.select("files", F.array_distinct(F.regexp_extract_all("message", F.lit(pattern), F.lit(0))).alias("tickets")).where("size(tickets) > 0")
    touched = tickets.select("tickets", F.explode("files").alias("grp")).select("grp", F.explode("tickets").alias("ticket"))
    touched = _met_once(touched, "grp")
    # symbols of several files, if any, go by their set of files
    places = symbols.where("grp IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set("grp")).alias("places"))
    one = places.where("size(places) = 1").select(F.col("id").alias("symbol_id"), F.col("places")[0].alias("grp"))
    more = places.where("size(places) > 1")
    sets = more.select("places").distinct().select("places", F.explode("places").alias("grp"))
    touched_sets = _met_once(touched.join(_spread(sets).hint("merge"), ["grp", "part"]).select("places", "ticket"), "places")
    found = touched.join(_spread(one).hint("merge"), ["grp", "part"]).select("symbol_id", "ticket")
    return found.unionByName(touched_sets.join(_spread(more).hint("merge"), ["places", "part"]).select(F.col("id").alias("symbol_id"), "ticket"))


def _met_once(touched: DataFrame, by: str) -> DataFrame:
    """Distinct ``by``, ticket with their part of ``by``: dealt out once, for these and for the join by ``by`` and part."""
    return touched.withColumn("part", F.pmod(F.hash("ticket"), F.lit(SPREAD))).repartition(by, "part").distinct()


def _spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def suffix_lookup(files: DataFrame, suffixes: DataFrame) -> DataFrame:
    """suffix, file_id where exactly one path ends with ``/suffix`` or is it.

    Both sides meet on the last path part, so no path is held against all suffixes.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    met = files.select("file_id", "rel_path", last(F.col("rel_path")).alias("tail")).join(suffixes.select("suffix", last(F.col("suffix")).alias("tail")), "tail")
    met = met.where((F.col("rel_path") == F.col("suffix")) | F.endswith("rel_path", F.concat(F.lit("/"), "suffix")))
    return met.groupBy("suffix").agg(F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("suffix", "file_id")


def first_of(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("n = 1").drop("n")
