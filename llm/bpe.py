"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that no vocabulary token holds side by side can never end up in one
token, so a word is cut there for certain: the fragments are encoded on their own (and
remembered), and their ids concatenated. Ids and decoded text equal those of the tokenizers
library for the same file, with add_special_tokens=False and skip_special_tokens=False.

Null text counts as empty: no tokens, the hashes are those of empty strings. Rows repeat as they
come; other columns are not read. Very long texts need memory in proportion to their length; a
fragment of n symbols takes n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import once

#: White space of the tokenizer's normaliser that str.split() knows too; it also splits at 1C-1F.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Entries in each of the two generations of what a worker remembers.
REMEMBERED = 150_000
#: Longer runs without white space, words and fragments are not remembered.
BRIEF = 64

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory(dict):
    """key -> make(key), remembered in two generations: what was not asked for during a whole one is forgotten."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.before = {}


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes that print stand for themselves, others count up from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder for a word BPE with an end-of-word suffix (a tokenizers JSON file)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        library = Tokenizer.from_file(path)
        self._normalise, self._pretokenise = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.suffix = made["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = made["model"]["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self._token = {str(i): t for i, t in self.tokens.items()}.__getitem__
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        symbol = byte_symbols()
        self._plain = re.compile("[!-~\u00c0-\u00ff]+").fullmatch
        self._plain_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
        self._latin = {c: "".join(symbol[x] for x in chr(c).encode()) for c in range(0xC0, 0x100)}
        self._odd = regex.compile(f"[{SEPARATORS}]").search
        self._spaces = regex.compile(r"[\t-\r \x85\xa0  -     　]+").split
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in made["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        inner, final = set(), set()
        for token in self.vocab:
            ends = token.endswith(self.suffix) and token != self.suffix
            symbols = token[: -len(self.suffix)] if ends else token
            pairs = list(zip(symbols, symbols[1:], strict=False))
            if ends and pairs:
                final.add(pairs.pop())
            inner.update(pairs)
        self.inner, self.final = inner, final
        self._fragments = Memory(self._merge)
        self._words = Memory(self._encode_word)
        self._chunks = Memory(self._encode_chunk)

    def fragments(self, word: str) -> list[tuple[str, bool]]:
        """The word's byte symbols, cut where no token can span; whether a fragment ends the word."""
        inner = self.inner
        cuts = [i for i, pair in enumerate(zip(word, word[1:-1], strict=False), 1) if pair not in inner]
        if len(word) > 1 and (word[-2], word[-1]) not in self.final:
            cuts.append(len(word) - 1)
        if not cuts:
            return [(word, True)]
        return [(word[a:b], False) for a, b in zip([0, *cuts], cuts, strict=False)] + [(word[cuts[-1] :], True)]

    def _merge(self, key: tuple[str, bool]) -> str:
        """Ids of a fragment, joined by one space: of its neighbouring parts those of least rank, leftmost first, are joined until none has a rank."""
        fragment, ends = key
        parts: list[str] = list(fragment)
        if ends:
            parts[-1] += self.suffix
        rank, vocab, n = self.rank.get, self.vocab, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or rank((parts[i], parts[j])) != r:
                continue  # one of the two is in another part by now
            parts[i] += parts[j]
            parts[j] = ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := rank((parts[i], parts[j]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return " ".join([str(vocab[t]) for t in parts if t])

    def _encode_word(self, symbols: str) -> str:
        return " ".join([self._fragments[f] if len(f[0]) <= BRIEF else self._merge(f) for f in self.fragments(symbols)])

    def _encode_chunk(self, chunk: str) -> str:
        """Ids, joined by one space, of a text without white space."""
        if self._plain(chunk):
            lower = chunk.lower()
            words = [lower] if lower.isalpha() else self._plain_words(lower)
            if not lower.isascii():
                words = [w.translate(self._latin) for w in words]
        else:
            words = [w for w, _ in self._pretokenise(self._normalise(chunk))]
        return " ".join([self._words[w] if len(w) <= BRIEF else self._encode_word(w) for w in words])

    def encode(self, text: str | None) -> str:
        """The text's ids, joined by one space."""
        if not text:
            return ""
        ids: list[str] = []
        for piece in self._split_special(text) if self._split_special and "<|" in text else (text,):
            if piece in self.special:
                ids.append(str(self.special[piece]))
                continue
            found, brief = self._chunks, self._encode_chunk
            chunks = [x for x in self._spaces(piece) if x] if self._odd(piece) else piece.split()
            ids += filter(None, [found[x] if len(x) <= BRIEF else brief(x) for x in chunks])
        return " ".join(ids)

    def forget(self) -> None:
        """Frees what was remembered: a worker that goes on to other work keeps the vocabulary alone."""
        for memory in (self._fragments, self._words, self._chunks):
            memory.forget()

    def decode(self, ids: str) -> str:
        """The text of ids that one space joins: this tokenizer has no decoder, so its tokens are joined by one space as well."""
        return " ".join(map(self._token, ids.split(" "))) if ids else ""


def encode_documents(docs: DataFrame, path: str | None = None, *, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text; ids=True adds the column token_ids, a list of int."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(("bpe", path), lambda: ForcedBoundaryBpe(path))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [coder.encode(t) for t in batch.column(1).to_pylist()]
                columns = [
                    batch.column(0),
                    pa.array([a.count(" ") + 1 if a else 0 for a in rows], pa.int64()),
                    pa.array([hashlib.sha256(a.encode()).hexdigest() for a in rows]),
                    pa.array([hashlib.sha256(coder.decode(a).encode()).hexdigest() for a in rows]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([[int(i) for i in a.split(" ")] if a else [] for a in rows], pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        coder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + (", token_ids array<int>" if ids else ""))
