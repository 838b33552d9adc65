"""Text functions as columns: tokens, stop words, lines, headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that say nothing about what is looked for.
STOP_WORDS = (
    "a an the is it in of to do be as at by or and for on are was has had can not but this that with from "
    "what how why who when where which show me tell give get all about does did will would could should have been "
    "into than then them they their there use used using any our each more also just some such like over after before "
    "between out make know find list return returns code file function method class type value call calls new my you your "
    "so no if am we he she his her"
).split()

IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_]*"
TERM = r"[a-z_][a-z0-9_]*"
WORD = r"[A-Za-z0-9_]+"


def terms(text: Column) -> Column:
    """All lower-case identifier tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))


def query_terms(query: Column) -> Column:
    """The terms a query asks for: no stop words, at least three letters; if none is left, those of three letters."""
    raw = terms(query)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    long = F.filter(raw, lambda t: F.length(t) > 2)
    kept = F.filter(long, lambda t: ~F.array_contains(stop, t))
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(long))


def meaningful_tokens(query: Column) -> Column:
    """How many tokens of a query are neither short nor stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.size(F.filter(terms(query), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))).cast("long")


def is_identifier(query: Column) -> Column:
    return F.trim(query).rlike(r"^[A-Za-z0-9_.]+$")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def words(text: Column) -> Column:
    """The default token count: words between white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\r\n]+"), F.lit(0))).cast("long")


def import_header(names: Column, most: int = 8, shown: int = 3) -> Column:
    """``mod.{a, b, c}`` for the first imports; ``names`` is array<struct<module, names>>."""

    def one(x: Column) -> Column:
        inner = F.concat_ws(", ", F.slice(x["names"], 1, shown))
        bare = (F.size(x["names"]) == 0) | F.array_contains(x["names"], "*")
        return F.when(bare, x["module"]).otherwise(F.concat(x["module"], F.lit(".{"), inner, F.lit("}")))

    return F.concat_ws(", ", F.transform(F.slice(names, 1, most), one))


def chunk_text(path: Column, language: Column, kind: Column, parent: Column, doc: Column, body: Column, imports: Column | None = None) -> Column:
    """A symbol's chunk: header lines, a blank one, the docstring unless the body starts with a quote, the body."""
    quoted = F.coalesce(body, F.lit("")).rlike(r"""^\s*["']""")
    header = F.array_compact(
        F.array(
            F.concat(F.lit("# File: "), path, F.lit(" | Language: "), language),
            F.when(imports.isNotNull() & (imports != ""), F.concat(F.lit("# Imports: "), imports)) if imports is not None else F.lit(None).cast("string"),
            F.when(parent.isNotNull(), F.concat(F.lit("# "), F.initcap(kind), F.lit(": "), parent)),
            F.lit(""),
            F.when(doc.isNotNull() & ~quoted, F.concat(F.lit("# Doc: "), doc)),
            F.coalesce(body, F.lit("")),
        )
    )
    return F.concat_ws("\n", header)


def truncate_words(text: Column, most: int, trailer: str = "# ... truncated") -> Column:
    """The first ``most`` words of a text with a trailer line, or the text if it has no more."""
    head = F.regexp_extract(text, rf"^\s*(?:\S+\s+){{{most - 1}}}\S+", 0)
    return F.when(words(text) > most, F.concat(head, F.lit("\n" + trailer))).otherwise(text)


def fence(text: Column) -> Column:
    """A fence longer than the longest run of backticks inside, of three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f\x80-\x9f]", "")


def any_of(text: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(F.lower(text), F.lit(p))
    return found


# Phrases by which an answer admits that it isn't sure.
UNCERTAIN = ["unable to locate", "no relevant code", "insufficient context", "not enough information", "couldn't find", "could not find"]


def scip_id(package: Column, version: Column, name: Column) -> Column:
    """A symbol's id across repositories."""
    return F.substring(F.sha2(F.concat_ws("||", package, version, name), 256), 1, 16)
