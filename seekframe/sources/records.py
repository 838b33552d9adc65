"""Logs and reports of other tools as tables: commits, findings, tickets, golden sets, plans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD, FIELD = "\x1e", "\x1f"


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """commit_id, message, files of a log written with record and field separators between hash, subject and names."""
    records = spark.read.option("lineSep", RECORD).text(path).where(F.trim("value") != "")
    parts = F.split("value", FIELD)
    files = F.filter(F.transform(F.split(F.get(parts, F.lit(2)), "\n"), F.trim), lambda x: x != "")
    return records.select(F.trim(parts[0]).alias("commit_id"), parts[1].alias("message"), F.coalesce(files, F.array().cast("array<string>")).alias("files"))


def findings(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, severity, source and sink of a scanner's JSON report; without a trace both are the match itself."""
    schema = "results array<struct<check_id:string,path:string,start:struct<line:bigint>,extra:struct<severity:string,metadata:struct<severity:string>,dataflow_trace:struct<taint_source:struct<path:string,line:bigint>,taint_sink:struct<path:string,line:bigint>>>>>"
    r = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.inline("results"))
    trace = F.col("extra.dataflow_trace")
    return r.select(
        F.col("check_id").alias("rule_id"),
        F.upper(F.coalesce("extra.severity", "extra.metadata.severity", F.lit("INFO"))).alias("severity"),
        F.coalesce(trace["taint_source"]["path"], "path").alias("source_file"),
        F.coalesce(trace["taint_source"]["line"], F.col("start.line")).alias("source_line"),
        F.coalesce(trace["taint_sink"]["path"], "path").alias("sink_file"),
        F.coalesce(trace["taint_sink"]["line"], F.col("start.line")).alias("sink_line"),
    )


def by_severity(flows: DataFrame) -> DataFrame:
    """Severities in descending order of their names, as listed by the engine's reports."""
    return flows.orderBy(F.col("severity").desc(), "source_file", "source_line")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, relevant_files of a JSON-lines file; all bad lines are reported together."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("query_id"), F.trim("value").alias("line")).where("line <> ''")
    parsed = lines.withColumn("r", F.from_json("line", "query string, relevant_files array<string>"))
    bad = parsed.where(F.col("r.query").isNull() | (F.trim("r.query") == "") | F.col("r.relevant_files").isNull() | (F.size("r.relevant_files") == 0) | F.exists("r.relevant_files", lambda p: F.startswith(p, F.lit("/")) | F.contains(p, F.lit(".."))))
    problems = [r["line"][:80] for r in bad.orderBy("query_id").limit(100).collect()]
    if problems:
        raise ValueError(f"{len(problems)} bad lines: " + "; ".join(problems))
    return parsed.select("query_id", "r.query", "r.relevant_files")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """alias, path, weight (1 if none is told) of the repositories that a registry file lists; empty if there is no file or it is damaged.

    An alias that stands twice is an error.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = "repos array<struct<alias:string,path:string,weight:double>>"
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "alias string, path string, weight double")
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.inline("repos"))
    rows = rows.where("alias IS NOT NULL AND path IS NOT NULL").select("alias", "path", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    twice = rows.groupBy("alias").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"alias {twice['alias']!r} is registered twice")
    return rows


def replay_plans(queries: DataFrame, frozen: DataFrame) -> DataFrame:
    """Each query with its recorded plan; a query without one is an error."""
    key = lambda c: F.lower(F.trim(c))
    joined = queries.withColumn("key", key(F.col("query"))).join(frozen.select(key(F.col("query")).alias("key"), "plan"), "key", "left").drop("key")
    missing = joined.where(F.col("plan").isNull()).limit(1).collect()
    if missing:
        raise LookupError(f"no recorded plan for {missing[0]['query']!r}")
    return joined


def rich_text(node: object, depth: int = 0, most: int = 150) -> str:
    """The plain text of a nested rich-text document."""
    if depth > most or not isinstance(node, dict):
        return ""
    own = node.get("text", "") if node.get("type") == "text" else ""
    inner = [rich_text(c, depth + 1, most) for c in node.get("content", []) or []]
    return own + ("\n" if node.get("type") in ("doc", "bulletList", "orderedList") else "").join(inner)


class _Page(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class ArtifactReader(DataSourceReader):
    """Tickets of a tracker's exported pages, one partition for each page."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Page]:
        import pyarrow.fs as fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return [_Page(f.path) for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path) if f.path.endswith(".json")]

    def read(self, partition: _Page) -> Iterator[tuple]:
        import json

        import pyarrow.fs as fs

        system, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), "")
        with system.open_input_stream(partition.path) as f:
            page = json.loads(f.read())
        for issue in page.get("issues", []):
            fields = issue.get("fields", {})
            body = fields.get("description")
            text = rich_text(body) if isinstance(body, dict) else body or ""
            yield f"ticket:{issue['key']}", "ticket", fields.get("summary") or "", text, issue.get("self"), {k: str(fields[k]) for k in ("status", "priority") if k in fields}


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tickets"

    def schema(self) -> str:
        return "source_ref string, artifact_kind string, title string, body string, url string, metadata map<string,string>"

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options["path"])


def pull_request(ref):
    """owner, repo and number of a pull request's address or short name, as a struct column."""
    pattern = r"(?:github\.com/)?([\w.-]+)/([\w.-]+)(?:/pull/|#)(\d+)"
    return F.struct(F.regexp_extract(ref, pattern, 1).alias("owner"), F.regexp_extract(ref, pattern, 2).alias("repo"), F.nullif(F.regexp_extract(ref, pattern, 3), F.lit("")).cast("bigint").alias("number"))
