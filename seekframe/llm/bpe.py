"""BPE encoding and decoding with forced boundaries (operator 9).

A merge can only build a token of the vocabulary, so two neighbouring bytes that
stand side by side in no token are never joined: between them there is a certain
cut.  Each word is cut there, the fragments are encoded independently, and their
ids are concatenated.

Results: a null text is an empty one, with no ids and an empty decoded text.  Rows
are independent of each other, so repeated rows give repeated results, an empty
table gives an empty table, and columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from seekframe.llm.runtime import text_batches, tidy

#: Chunks between blanks, and words, whose ids are remembered at least; twice as many at most.
REMEMBERED_CHUNKS, REMEMBERED_WORDS = 80_000, 160_000
#: Characters up to which one is remembered: longer ones hardly come again, and thousands of them would fill a worker.
REMEMBERED_LENGTH = 100
#: Symbols up to which the best pair is looked for in a list, not a heap.
SHORT = 24

# The white space of Unicode, as regular expressions with Unicode classes see it.
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class _Memory(dict):
    """key -> what ``make`` makes of it.  A full memory becomes the old one; what is met again moves over from it."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(key) > REMEMBERED_LENGTH:
            return self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}


class WordBpe:
    """A tokenizer file of kind BPE with byte letters and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.letters = byte_letters()
        self.joined = self._joined_pairs()
        self.digits = [str(i) for i in range(max(self.token) + 1)]
        self._memory = _Memory(self._chunk, REMEMBERED_CHUNKS)
        self._words = _Memory(self._word, REMEMBERED_WORDS)

    def forget(self) -> None:
        """Drops what is remembered of texts; the vocabulary stays."""
        self._memory.forget()
        self._words.forget()

    def _joined_pairs(self) -> dict[str, int]:
        """All pairs of letters that stand side by side inside some token, with the rank of their own merge, if there is one."""
        out = {}
        none = len(self.rank)
        for token in self.vocab:
            core = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else token
            for i in range(len(core) - 1):
                out[core[i : i + 2]] = self.rank.get((core[i], core[i + 1]), none)
        return out

    def fragments(self, word: str) -> list[str]:
        """The pieces of ``word`` (in byte letters) between its certain cuts."""
        return [word[a:b] for a, b, _ in self._cut(word)]

    def _cut(self, word: str) -> list[tuple[int, int, list[int]]]:
        """Start, end and ranks of neighbouring letters of each fragment."""
        get = self.joined.get
        ranks = [get(word[i : i + 2], -1) for i in range(len(word) - 1)]
        if -1 not in ranks:
            return [(0, len(word), ranks)]
        out, start = [], 0
        for i, r in enumerate(ranks):
            if r < 0:
                out.append((start, i + 1, ranks[start:i]))
                start = i + 1
        return [*out, (start, len(word), ranks[start:])]

    def merge_short(self, symbols: list[str], ranks: list[int]) -> list[str]:
        """``merge`` for a few symbols, given the ranks of neighbours."""
        rank, none = self.rank.get, len(self.rank)
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i] = made = symbols[i] + symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((made, symbols[i + 1]), none)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], made), none)
        return symbols

    def merge(self, symbols: list[str]) -> list[str]:
        """Joins the pair of lowest rank, the leftmost first, until none is left: O(n log n)."""
        n, rank = len(symbols), self.rank
        if n < 2:
            return symbols
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            if (k := left[i]) >= 0 and (r := rank.get((symbols[k], a + b))) is not None:
                heapq.heappush(heap, (r, k, symbols[k], a + b))
        return [s for s in symbols if s]

    def word_tokens(self, word: str) -> list[str]:
        """The tokens of one word: bytes to letters, certain cuts, then merges within each fragment."""
        if not (word.isascii() and word.isalnum()):
            letters = self.letters
            word = "".join([letters[b] for b in word.encode("utf-8")])
        out: list[str] = []
        last = len(word)
        for a, b, ranks in self._cut(word):
            symbols = [*word[a:b]]
            if b == last:
                symbols[-1] += self.suffix
                if ranks and self.suffix:
                    ranks[-1] = self.rank.get((symbols[-2], symbols[-1]), len(self.rank))
            if len(symbols) == 1:
                out += symbols
            else:
                out += self.merge_short(symbols, ranks) if len(symbols) <= SHORT else self.merge(symbols)
        return out

    def word_ids(self, word: str) -> list[int]:
        vocab = self.vocab
        return [vocab[t] for t in self.word_tokens(word)]

    def _word(self, word: str) -> tuple[str, str]:
        """The ids of a word, and what they decode to."""
        ids = self.word_ids(word)
        return " ".join([self.digits[i] for i in ids]), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids and tokens of what stands between two blanks."""
        if chunk.isascii() and chunk.isalpha():
            return self._words[chunk]
        found = [self._words[word] for word in self.words.findall(chunk)]
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def normal(self, text: str) -> str:
        """Composed characters, single spaces, lower case letter by letter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return WHITE.sub(" ", text).lower().strip(" ")

    def encode_joined(self, text: str) -> tuple[str, str]:
        """The ids of a text, and the tokens, each joined by one space."""
        parts: Iterable[str] = [text]
        if self.special_at and "<" in text:
            parts = self.special_at.split(text)
        ids, tokens = [], []
        for part in parts:
            if part in self.special:
                ids.append(str(self.special[part]))
                tokens.append(part)
            elif part := self.normal(part):
                pairs = [*map(self._memory.__getitem__, part.split(" "))]
                ids += [p[0] for p in pairs]
                tokens += [p[1] for p in pairs]
        return " ".join(ids), " ".join(tokens)

    def encode(self, text: str | None) -> list[int]:
        return [*map(int, self.encode_joined(text or "")[0].split())]

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: the tokens, special ones too, joined by one space."""
        return " ".join([self.token[i] for i in ids])


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Ids and decoded text of each row's whole text.

    ``path`` is a tokenizer file that every executor can read, or the bare name of one
    sent out with ``SparkContext.addFile``.  Columns: the id, ``ids`` (array of int),
    ``n_tokens``, ``ids_sha256``, ``decoded`` and ``decoded_sha256``; ``ids`` and
    ``decoded`` can be left out.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path if "/" in path else SparkFiles.get(path))
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                counts, shas, back_shas, all_ids, texts = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    joined, back = bpe.encode_joined(text or "")
                    counts.append(joined.count(" ") + 1 if joined else 0)
                    shas.append(hashlib.sha256(joined.encode()).hexdigest())
                    back_shas.append(hashlib.sha256(back.encode()).hexdigest())
                    if ids:
                        all_ids.append([*map(int, joined.split())])
                    if decoded:
                        texts.append(back)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back_shas, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                if decoded:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)
        bpe.forget()  # workers are reused, by other operators too

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
