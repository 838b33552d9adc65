"""Shortening bodies to the lines that matter, and filling a budget with shortened hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How left-out lines are told, how far a header may reach, the last ratio tried.
ELIDED = "# ... {n} lines elided ..."
HEADER_LINES, FLOOR = 8, 0.01


def _word_set(text: str) -> set[str]:
    import re

    return set(re.findall(r"[a-z0-9_]+", text.lower()))


def blocks(lines: list[str]) -> list[range]:
    """Runs of lines between blank ones; a run that opens more braces than it closes goes on over the next ones."""
    out: list[range] = []
    start, still_open = None, 0
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            if start is None:
                start = i
            still_open += line.count("{") - line.count("}")
        elif start is not None and (still_open <= 0 or not any(x.strip() for x in lines[i:])):
            end = i
            while not lines[end - 1].strip():
                end -= 1
            out.append(range(start, end))
            start, still_open = None, 0
    return out


def always_kept(lines: list[str], docstring: str | None) -> set[int]:
    """The header's lines, and those from the docstring's first to its last."""
    header = next((i for i, line in enumerate(lines[:HEADER_LINES]) if line.rstrip().endswith((":", "{"))), 0)
    kept = set(range(header + 1))
    wanted = [w for w in map(str.strip, (docstring or "").splitlines()) if w]
    of_doc = [i for i, line in enumerate(map(str.strip, lines)) if line and any(line in w or w in line for w in wanted)]
    return kept | set(range(of_doc[0], of_doc[-1] + 1)) if of_doc else kept


def shorten(body: str, query: str, target: int, docstring: str | None = None, scored: list[tuple[int, int, float]] | None = None) -> tuple[str, int, list[tuple[int, int]]]:
    """The text, its words, and the runs of lines kept (from 0, both ends inside).

    The header and the docstring stay whatever they take; then parts by score, as far as all kept lines have no more than
    ``target`` words.  ``scored``: parts by their vectors (first line, last line, score); without them the blocks of the body by
    the words that they share with the query, over the root of their own.  A body of which all is kept comes back as it is.
    """
    lines = body.splitlines()
    if not lines:
        return body, 0, []
    words = [len(line.split()) for line in lines]
    if scored:
        parts = [(score, range(max(first, 0), min(last, len(lines) - 1) + 1)) for first, last, score in scored]
    else:
        asked, parts = _word_set(query), []
        for block in blocks(lines):
            own = _word_set("\n".join(lines[block.start : block.stop]))
            parts.append((len(asked & own) / (len(own) + 1) ** 0.5, block))
    kept = always_kept(lines, docstring)
    used = sum(words[i] for i in kept)
    for _, block in sorted(parts, key=lambda p: (-p[0], p[1].start)):
        more = [i for i in block if i not in kept]
        if used + sum(words[i] for i in more) <= target:
            kept.update(more)
            used += sum(words[i] for i in more)
    if len(kept) == len(lines):
        return body, used, [(0, len(lines) - 1)]
    text: list[str] = []
    runs: list[tuple[int, int]] = []
    gap = 0
    for i, line in enumerate(lines):
        if i not in kept:
            gap += 1
            continue
        if gap:
            text.append(ELIDED.format(n=gap))
        if gap or not runs:
            runs.append((i, i))
        else:
            runs[-1] = (runs[-1][0], i)
        text.append(line)
        gap = 0
    if gap:
        text.append(ELIDED.format(n=gap))
    done = "\n".join(text)
    return done, len(done.split()), runs


def _parts(value: object) -> list[tuple[int, int, float]] | None:
    return [(p["first"], p["last"], p["score"]) for p in value] if value is not None and len(value) else None


def shortened(units: DataFrame, ratio: float) -> DataFrame:
    """id, text, tokens, spans of every unit (id, query, body, docstring, tokens[, scored]), each to ``ratio`` of its tokens.

    Spans count lines from 0.  A null body counts as empty.  ``scored``: array of structs first, last, score.
    """
    columns = [c for c in ("id", "query", "body", "docstring", "tokens", "scored") if c in units.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                text, tokens, spans = shorten(r["body"] or "", r["query"] or "", max(1, int(ratio * r["tokens"])), r["docstring"], _parts(r.get("scored")))
                rows.append((r["id"], text, tokens, [list(s) for s in spans]))
            yield pd.DataFrame(rows, columns=["id", "text", "tokens", "spans"])

    return units.select(*columns).mapInPandas(run, f"id {units.schema['id'].dataType.simpleString()}, text string, tokens bigint, spans array<array<bigint>>")


def second_wave(hits: DataFrame, budget: int, ratio: float = 0.45, least: int = 64) -> DataFrame:
    """query_id, id, rank, tokens, how, text: what a greedy pack takes whole, then shortened hits while the budget lasts.

    ``hits``: query_id, query, rank, id, body, docstring, tokens; a query has no more of them than its retrieval's k, so one
    task holds them.  A hit that didn't fit is shortened to ``ratio`` of its tokens, or to what is left if that is less, and
    failing that to its header (``floor``); one of less than ``least`` tokens, or that stays too large, is left out.
    """
    schema = f"query_id {hits.schema['query_id'].dataType.simpleString()}, id {hits.schema['id'].dataType.simpleString()}, rank bigint, tokens bigint, how string, text string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        used, out, late = 0, [], []
        for r in rows:
            if used + r["tokens"] <= budget:
                used += r["tokens"]
                out.append((r["query_id"], r["id"], r["rank"], r["tokens"], "whole", r["body"]))
            else:
                late.append(r)
        for r in late:
            left, body = budget - used, r["body"] or ""
            if left <= 0 or r["tokens"] < max(least, 1) or not body.strip():
                continue
            for share, how in ((min(ratio, left / r["tokens"]), "compressed"), (FLOOR, "floor")):
                text, tokens, _ = shorten(body, r["query"] or "", max(1, int(share * r["tokens"])), r["docstring"])
                if tokens <= left and tokens < r["tokens"]:
                    used += tokens
                    out.append((r["query_id"], r["id"], r["rank"], tokens, how, text))
                    break
        return pd.DataFrame(sorted(out, key=lambda x: x[2]), columns=["query_id", "id", "rank", "tokens", "how", "text"])

    rows = hits.select("query_id", "query", F.col("rank").cast("long").alias("rank"), "id", "body", "docstring", F.col("tokens").cast("long").alias("tokens"))
    return rows.groupBy("query_id").applyInPandas(run, schema)
