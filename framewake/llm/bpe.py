"""BPE encoding and decoding in batched numpy merge rounds.

Many words lie in one flat array of symbols. Each round finds, for every word,
the lowest-rank pair by binary search over the sorted keys of all known pairs,
merges its occurrences from left to right in all words at once and closes the
gaps; words without a known pair leave the array. As a merge can only make pairs
of higher rank, that is the order in which one pair at a time would be merged.

Which texts: normalisation (NFC, lower case letter by letter, white space
dropped), splitting and the byte alphabet follow the vocabulary file's own
settings for a word-end BPE. Its special tokens are found in the raw text, as
the tokenizers library does by default. Decoding joins token strings by a space,
which is that library's rule for a file without a decoder.

Null texts encode as empty ones: no ids, the empty string decoded. Repeated rows
repeat their results, an empty table gives an empty one, other columns are never
read. A very long text is encoded whole; memory is bounded by the longest text,
and memos of pieces are emptied at a fixed size.
"""

from __future__ import annotations

import json
import unicodedata
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, load, per_text

# The word pattern of the vocabulary file, and white space as its regular expressions have it.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LINE_WORD = regex.compile(_WORD.pattern + "|\n")
_SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")
#: str.split() takes these for white space too.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def merge_rounds(symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that are left of all words, and how many each word has. symbols: of all words, one after another; starts: where each word begins.

    keys: sorted left * n_symbols + right of the known pairs; ranks, made: each one's rank and the symbol it becomes.
    """
    none = np.iinfo(np.int64).max
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rank, result = np.full(len(symbols), none), np.zeros(len(symbols), np.int64)

    def look_up(i: np.ndarray) -> None:
        """The rank and result of the pairs that begin at i."""
        pair = symbols[i] * n_symbols + symbols[i + 1]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = (keys[at] == pair) & (word[i] == word[i + 1])
        rank[i], result[i] = np.where(known, ranks[at], none), made[at]

    look_up(np.arange(max(0, len(symbols) - 1)))
    while len(symbols):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        length = np.diff(np.append(first, len(word)))
        best = np.minimum.reduceat(rank, first)
        over = best == none
        gone = np.repeat(over, length)
        out.append((word[gone], symbols[gone]))
        if over.all():
            break
        hits = np.flatnonzero((rank == np.repeat(best, length)) & (rank < none))
        # Of touching occurrences (the pair's symbols are equal there) every second one is merged.
        run = np.cumsum(np.append(True, np.diff(hits) > 1)) - 1
        offset = np.arange(len(hits)) - np.searchsorted(run, run)
        hits = hits[offset % 2 == 0]
        symbols[hits] = result[hits]
        stay = ~gone
        stay[hits + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[hits] = True
        rank[hits] = none
        symbols, word, rank, result, changed = symbols[stay], word[stay], rank[stay], result[stay], changed[stay]
        hits = np.flatnonzero(changed)
        rank[hits] = none
        near = np.unique(np.concatenate([hits, hits - 1]))
        look_up(near[(near >= 0) & (near < len(symbols) - 1)])
    order = np.argsort(np.concatenate([w for w, _ in out]), kind="stable") if out else np.zeros(0, np.int64)
    left = np.concatenate([s for _, s in out])[order] if out else symbols
    counts = np.bincount(np.concatenate([w for w, _ in out]), minlength=len(starts)) if out else np.zeros(len(starts), np.int64)
    return left, counts


class Bpe:
    """Encodes and decodes batches of texts. settings: of read_vocabulary()."""

    def __init__(self, settings: dict):
        self.__dict__.update(settings)
        self.numbers = list(range(self.n_symbols))
        self.memos = Memo(250), Memo(250)
        self.pieces, self.words = (m.known for m in self.memos)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _new_words(self, words: list[str]) -> None:
        spelled = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(spelled), np.uint8)
        ends = np.cumsum([len(w) for w in spelled])
        symbols = self.first_id[flat]
        symbols[ends - 1] = self.last_id[flat[ends - 1]]
        left, counts = merge_rounds(symbols, np.append(0, ends[:-1]), self.keys, self.ranks, self.made, self.n_symbols)
        # One object for each id, however many words have it.
        ids = list(map(self.numbers.__getitem__, left.tolist()))
        stops = np.cumsum(counts).tolist()
        self.words.update((w, tuple(ids[i:j])) for w, i, j in zip(words, [0, *stops], stops, strict=False))
        self.memos[1].took(words)

    def _new_pieces(self, pieces: list[str]) -> None:
        """The ids of what lies between white space. All pieces are normalised and split into words at once, a line each."""
        special = self.special_pattern
        parts = [[p] if special is None or not special.search(p) else special.split(p) for p in pieces]
        lines = [m for marked in parts for m in marked]
        # Lower case goes letter by letter, so a final sigma doesn't differ from another.
        found = _LINE_WORD.findall(unicodedata.normalize("NFC", "\n".join("" if m in self.special else m for m in lines)).replace("Σ", "σ").lower())
        if new := set(found).difference(self.words, "\n"):
            self._new_words(sorted(new))
        ids: list[tuple[int, ...]] = []
        own: list[tuple[int, ...]] = []
        for w in found:
            if w == "\n":
                ids.append(own[0] if len(own) == 1 else tuple(chain.from_iterable(own)))
                own = []
            else:
                own.append(self.words[w])
        ids.append(tuple(chain.from_iterable(own)))
        at = 0
        for p, marked in zip(pieces, parts, strict=True):
            if len(marked) == 1 and p not in self.special:
                self.pieces[p] = ids[at]
            else:
                self.pieces[p] = tuple(chain.from_iterable((self.special[m],) if m in self.special else ids[at + k] for k, m in enumerate(marked)))
            at += len(marked)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        for memo in self.memos:
            memo.trim()
        cut = [(_SPACES.split(t) if _NOT_SPACE.search(t) else t.split()) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.pieces)
        if new:
            self._new_pieces(sorted(new))
            self.memos[0].took(new)
        get = self.pieces.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        get = self.tokens.__getitem__
        return [" ".join(map(get, i)) for i in ids]


def read_vocabulary(path: str) -> dict:
    """What Bpe needs from a tokenizers file of this kind; read on the driver, so executors need no such file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, vocab = file["model"], file["model"]["vocab"]
    end = model["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    tokens = {i: t for t, i in {**vocab, **special}.items()}
    n = max(tokens) + 1
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * n + vocab[b] for a, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    letters = byte_alphabet()
    return {
        "n_symbols": n,
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "made": made[order],
        "special": special,
        "tokens": [tokens.get(i, "") for i in range(n)],
        "first_id": np.array([vocab[c] for c in letters], np.int64),
        "last_id": np.array([vocab[c + end] for c in letters], np.int64),
    }


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), a row for each row of df."""
    settings = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        bpe = Bpe(settings.value)

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            ids = bpe.encode([t and t.decode("utf-8", "replace") for t in texts])
            ends = np.cumsum([0, *map(len, ids)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])))]

        return work

    return per_text(df, [id_col], text_col, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def digest_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what the codec returns, taken where the ids are, as these outgrow the texts."""
    settings = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        bpe = Bpe(settings.value)
        number = [str(i) for i in range(bpe.n_symbols)]

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            ids = bpe.encode([t and t.decode("utf-8", "replace") for t in texts])
            hexes = lambda strings: pa.array([sha256(s.encode()).hexdigest() for s in strings], pa.string())
            return [pa.array(map(len, ids), pa.int64()), hexes(" ".join(map(number.__getitem__, i)) for i in ids), hexes(bpe.decode(ids))]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return per_text(df, [id_col], text_col, make, fields)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return digest_documents(load(spark, sf_dir, "documents"), word_vocabulary())
