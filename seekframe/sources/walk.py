"""Walking a repository into a table of files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension and by file name.
EXTENSIONS = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "c": "c", "h": "c",
    "cs": "csharp", "razor": "razor", "cshtml": "cshtml", "csproj": "csproj", "fsproj": "csproj", "vbproj": "csproj",
    "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css", "less": "css",
    "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "proto": "proto", "mk": "make",
}
NAMES = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "make", "gnumakefile": "make"}
IGNORED_DIRS = {".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "target"}
LARGEST = 500_000
# Folders that hold a repository's own code only where something beside them says so; files that say so; files that deny it.
CONDITIONAL_DIRS = ["packages", "bin"]
WORKSPACE_FILES = ["pnpm-workspace.yaml", "pnpm-workspace.yml", "lerna.json", "nx.json", "rush.json"]
DOTNET_FILES = ["directory.build.props", "directory.build.targets", "directory.packages.props", "packages.config", "packages.lock.json", "nuget.config"]
DOTNET_EXTENSIONS = ["sln", "slnx", "slnf", "csproj", "fsproj", "vbproj", "vcxproj"]


def language(path: Column) -> Column:
    """By the file's name, then its stem, then its extension; else ``unknown``."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    stem = F.substring_index(name, ".", 1)
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.coalesce(F.element_at(table(NAMES), name), F.element_at(table(NAMES), stem), F.element_at(table(EXTENSIONS), extension), F.lit("unknown"))


def pattern_regex(pattern: str) -> re.Pattern[str]:
    """A pattern of an ignore file for paths relative to its folder: ``*`` and ``?`` stay within a name, ``**`` spans folders."""
    anchored = "/" in pattern.strip().rstrip("/")
    body = pattern.rstrip("/").removeprefix("/")
    out = "" if anchored else "(?:.*/)?"
    for piece in re.split(r"((?:(?<=/)|^)\*\*/|/\*\*$|\*+|\?|\[!?\]?[^\]]*\]|\\.)", body):
        if piece == "**/":
            out += "(?:[^/]+/)*"
        elif piece == "/**":
            out += "/.+"
        elif piece.startswith("*"):
            out += "[^/]*"
        elif piece == "?":
            out += "[^/]"
        elif piece.startswith("[") and piece.endswith("]") and len(piece) > 2:
            out += "(?!/)[" + piece[1:-1].replace("\\", "\\\\").replace("!", "^", 1 if piece[1] == "!" else 0) + "]"
        elif piece.startswith("\\") and len(piece) == 2:
            out += re.escape(piece[1])
        else:
            out += re.escape(piece)
    return re.compile(out)


class Ignore:
    """The patterns of one folder's ignore file; a later one overrules an earlier, ``!`` takes back."""

    def __init__(self, lines: list[str]):
        wanted = [re.sub(r"(?<!\\)\s+$", "", x) for x in lines]
        self.rules = [(x.startswith("!"), x.endswith("/"), pattern_regex(x.removeprefix("!"))) for x in wanted if x and not x.startswith("#")]

    def verdict(self, rel: str, is_dir: bool) -> bool | None:
        out = None
        for back, only_dirs, regex in self.rules:
            if (is_dir or not only_dirs) and regex.fullmatch(rel):
                out = not back
        return out


def own_folders(folder: str, names: Sequence[str]) -> set[str]:
    """The conditional folders among ``names``, all entries of ``folder``, that are shown to hold the repository's own code.

    ``packages`` needs a workspace file or the key ``workspaces`` of package.json, ``bin`` a target of its key ``bin`` inside it.
    Beside a .NET project neither is: there they hold what a build made.  Without proof a folder stays ignored.
    """
    lower = {n.lower() for n in names}
    asked = {n for n in names if n.lower() in CONDITIONAL_DIRS and os.path.isdir(os.path.join(folder, n))}
    if not asked or lower & set(DOTNET_FILES) or any(n.rpartition(".")[2] in DOTNET_EXTENSIONS for n in lower if "." in n):
        return set()
    try:
        with open(os.path.join(folder, "package.json"), encoding="utf-8", errors="ignore") as f:
            manifest = json.load(f)
    except (OSError, ValueError):
        manifest = None
    manifest = manifest if isinstance(manifest, dict) else {}
    declared = manifest.get("bin")
    targets = [t.removeprefix("./").lower() for t in (declared.values() if isinstance(declared, dict) else [declared]) if isinstance(t, str)]
    workspace = "workspaces" in manifest or bool(set(names) & set(WORKSPACE_FILES))
    return {n for n in asked if (workspace if n.lower() == "packages" else any(t.startswith(n.lower() + "/") and len(t) > len(n) + 1 for t in targets))}


def listing(root: str) -> list[str]:
    """Relative paths of a local repository in sorted order; no link leads out of it or round in a circle."""
    real_root = os.path.realpath(root)
    out: list[str] = []

    def visit(folder: str, chain: list[tuple[str, Ignore]], above: tuple[str, ...]) -> None:
        real = os.path.realpath(folder)
        if real in above or os.path.commonpath([real, real_root]) != real_root:
            return
        ignore = os.path.join(folder, ".gitignore")
        if os.path.isfile(ignore):
            with open(ignore, encoding="utf-8", errors="replace") as f:
                chain = [*chain, (folder, Ignore(f.read().splitlines()))]
        names = sorted(os.listdir(folder))
        own = own_folders(folder, names)
        for name in names:
            path = os.path.join(folder, name)
            is_dir = os.path.isdir(path)
            verdict = None
            for base, rules in chain:
                v = rules.verdict(os.path.relpath(path, base).replace(os.sep, "/"), is_dir)
                verdict = v if v is not None else verdict
            if verdict or is_dir and (name in IGNORED_DIRS or name.lower() in CONDITIONAL_DIRS and name not in own):
                continue
            if is_dir:
                visit(path, chain, (*above, real))
            elif os.path.commonpath([os.path.realpath(path), real_root]) == real_root:
                out.append(os.path.relpath(path, root).replace(os.sep, "/"))

    visit(root, [], ())
    return out


def repository(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, language, hash, size, text of the files worth indexing below ``root``.

    The listing is a driver's job, as ignore files nest; bytes are read and hashed by tasks, those of the files listed only.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    wanted = [os.path.join(os.path.realpath(root), re.sub(r"([\\\[\]{}*?,])", r"\\\1", p)) for p in listing(root)]
    files = spark.read.format("binaryFile").load(wanted) if wanted else spark.createDataFrame([], schema)
    prefix = os.path.realpath(root).rstrip("/") + "/"
    files = files.select(F.substring(F.regexp_replace("path", r"^file:/+", "/"), len(prefix) + 1, 1 << 20).alias("rel_path"), F.col("length").alias("size"), "content").where(F.col("size") <= LARGEST)
    return files.select("rel_path", language(F.col("rel_path")).alias("language"), F.sha2("content", 256).alias("hash"), "size", F.decode("content", "UTF-8").alias("text")).where("language <> 'unknown'")
