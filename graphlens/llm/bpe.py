"""Byte-level BPE encoding by speculation and verification, and decoding.

A word's tokens are first guessed by greedy longest match. A sequence of tokens is the word's BPE encoding exactly when
every two neighbours are compatible, that is, when no merge across their boundary would have come before the merges that
made them. The check runs on all neighbour pairs of a batch of words at once in numpy; words with a pair that fails are
merged exactly. Texts are cut at lone spaces first, where the pre-tokenizer's pattern always cuts, so that the
work is done once for each different piece that a task holds in its bounded cache.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import table

#: White space as the pre-tokenizer's pattern has it (fixed values).
_S = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-tokenizer's pattern (fixed values).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Entries that a cache holds before it is emptied.
CACHE = 500_000
#: Bytes of a failing word from which on it is merged alone, over a heap.
LONG_WORD = 256
#: Characters of text that are encoded together.
CHUNK = 1 << 20
#: Odd factor and mask that fold two 64-bit numbers into a sort key; matches are compared in full.
_MIX, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_NEVER = np.iinfo(np.int64).max

#: Scripts whose letters and digits have long been the same in all Unicode versions; pieces with other letters are cut by the tokenizers library itself.
_odd = regex.compile("[^\0-\u0377\u0400-\u052f\u05d0-\u05ea\u2000-\u2064\u20a0-\u20bf\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]").search
_plain = regex.compile(PATTERN).findall
_uneven = regex.compile(f" [{_S}]|[{_S}] ").search
_cut = regex.compile(f"(?<=[^{_S}]) (?=[^{_S}])").split


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else U+0100 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """The vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.tokens = [b""] * size
        for b, i in self.ids.items():
            self.tokens[i] = b
        for s, i in self.specials.items():
            self.tokens[i] = s.encode()
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.pairs.setdefault((x, y), (r, made))
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        keys = np.array([x << 32 | y for x, y in self.pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.key_rank, self.key_made = keys[by], *(np.array(c, np.int64)[by] for c in zip(*self.pairs.values(), strict=True))
        made = np.flatnonzero(self.rank >= 0)
        sound = np.zeros(size, bool)
        sound[[self.ids[bytes([b])] for b in range(256)]] = True
        alone = np.zeros(size, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])].tolist():
            sound[t] = alone[t] and sound[self.left[t]] and sound[self.right[t]]
        self.sizes = np.array([len(b) for b in self.tokens], np.int64)
        #: Tokens that their own bytes encode to; only these are proposed.
        self.known = {b: i for b, i in self.ids.items() if sound[i]}
        lengths: dict[bytes, set[int]] = {}
        for b in self.known:
            if len(b) > 2:
                lengths.setdefault(b[:3], set()).add(len(b))
        #: Lengths of the tokens that start with these three bytes, longest first.
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        heads = sorted((int.from_bytes(k), v[0]) for k, v in self.lengths.items())
        self.heads, self.head_longest = np.array([k for k, _ in heads], np.uint64), np.array([v for _, v in heads], np.int64)
        #: For each length up to 16, the tokens as sorted numbers: the first eight bytes, then the rest.
        self.of_length = []
        for k in range(2, 17):
            own = sorted((int.from_bytes(b[:8]), int.from_bytes(b[8:]), i) for b, i in self.known.items() if len(b) == k)
            key = np.array([x * _MIX + y & _MASK for x, y, _ in own], np.uint64)
            by = np.argsort(key)
            self.of_length.append((key[by], np.array([x for x, _, _ in own], np.uint64)[by], np.array([y for _, y, _ in own], np.uint64)[by], np.array([i for *_, i in own], np.int64)[by]))
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged token of pairs; _NEVER where none merges or a side is negative."""
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (x >= 0) & (y >= 0)
        return np.where(hit, self.key_rank[at], _NEVER), self.key_made[at]

    def compatible(self, x, y, limit=None) -> np.ndarray:
        """For each pair of tokens, whether they stay apart when their bytes stand side by side.

        The pair is taken apart backwards in time, the token made last first. It fails if at some moment a merge across the
        boundary ranks before what the tokens at the boundary went into; of equal ranks the one to the left comes first.
        """
        x, y = np.array(x, np.int64), np.array(y, np.int64)
        into_x = np.full(len(x), _NEVER) if limit is None else np.array(limit, np.int64)
        into_y = into_x - 1 if limit is not None else into_x.copy()
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            m, _ = self.rank_of(a, b)
            bad = (m < into_x[live]) & (m <= into_y[live])
            good[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            p, q = live[first], live[~first]
            into_x[p], x[p] = ra[first], self.right[a[first]]
            into_y[q], y[q] = rb[~first], self.left[b[~first]]
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match of one word; for words with tokens of over 16 bytes."""
        known, lengths, out, i, n = self.known, self.lengths, [], 0, len(word)
        while i < n:
            for k in lengths.get(word[i : i + 3], ()):
                if i + k <= n and (t := known.get(word[i : i + k])) is not None:
                    break
            else:
                k = 2 if i + 2 <= n and word[i : i + 2] in known else 1
                t = known[word[i : i + k]]
            out.append(t)
            i += k
        return out

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: the ids one after the other, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words) + bytes(24), np.uint8)
        n = len(raw) - 24
        left = np.repeat(ends, size) - np.arange(n)
        eight = np.zeros(n + 16, np.uint64)
        for j in range(8):
            eight = eight << np.uint64(8) | raw[j : j + n + 16]
        head = eight[:n] >> np.uint64(40)
        at = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        longest = np.minimum(np.where(self.heads[at] == head, self.head_longest[at], 2), left)
        step, best = np.ones(n, np.int64), self.byte_ids[raw[:n]]
        for k, (keys, first, second, ids) in enumerate(self.of_length, 2):
            where = np.flatnonzero(longest >= k)
            if not len(keys) or not len(where):
                continue
            x = eight[where] >> np.uint64(8 * (8 - min(k, 8)))
            y = eight[where + 8] >> np.uint64(8 * (16 - k)) if k > 8 else np.zeros(len(where), np.uint64)
            key = x * np.uint64(_MIX) + y
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (first[at] == x) & (second[at] == y)
            step[where[hit]], best[where[hit]] = k, ids[at[hit]]
        word, pos = np.arange(len(words)), ends - size
        owners, found = [], []
        while len(word):
            go = pos < ends[word]
            word, pos = word[go], pos[go]
            owners.append(word)
            found.append(best[pos])
            pos = pos + step[pos]
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        flat = np.concatenate(found)[by] if len(by := np.argsort(owner, kind="stable")) else np.empty(0, np.int64)
        count = np.bincount(owner, minlength=len(words))
        far = np.unique(np.searchsorted(ends, np.flatnonzero(longest > 16), "right"))
        return self._replaced(flat, count, {k: self.propose(words[k]) for k in far.tolist()})

    @staticmethod
    def _replaced(flat: np.ndarray, count: np.ndarray, new: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """flat and count with the ids of some words put in place of theirs."""
        if not new:
            return flat, count
        cuts, parts, at = np.cumsum(count), [], 0
        for k in sorted(new):
            parts += [flat[at : cuts[k] - count[k]], np.array(new[k], np.int64)]
            at = cuts[k]
        count = count.copy()
        count[list(new)] = [len(v) for v in new.values()]
        return np.concatenate([*parts, flat[at:]]), count

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The encodings by definition: in each word the pair of the least rank merges, the leftmost first, until none is left.

        All words advance together; a row of the matrix is a word, its cells are linked to the next and the last one alive.
        """
        n, width = len(words), max(map(len, words))
        rows = np.arange(n)
        size = np.fromiter(map(len, words), np.int64, n)
        cells = np.full((n, width + 1), -1, np.int64)
        cells[:, :width][np.arange(width) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 2).clip(max=width), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        rank, made = np.full((n, width + 1), _NEVER), np.zeros((n, width + 1), np.int64)
        rank[:, :width], made[:, :width] = self.rank_of(cells[:, :-1], cells[:, 1:])
        while len(rows):
            at = rank[rows].argmin(1)
            go = rank[rows, at] < _NEVER
            rows, at = rows[go], at[go]
            gone = after[rows, at]
            cells[rows, at] = made[rows, at]
            cells[rows, gone] = -1
            nxt = after[rows, gone]
            after[rows, at], before[rows, nxt] = nxt, at
            rank[rows, gone] = _NEVER
            rank[rows, at], made[rows, at] = self.rank_of(cells[rows, at], np.where(nxt < width, cells[rows, nxt], -1))
            last = before[rows, at]
            some = last >= 0
            r, k = rows[some], last[some]
            rank[r, k], made[r, k] = self.rank_of(cells[r, k], cells[r, at[some]])
        return [c[c >= 0].tolist() for c in cells]

    def merge_long(self, word: bytes) -> list[int]:
        """As merge(), for one long word: a heap of the pairs that can merge, by rank and place, in n log n steps."""
        cells = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(cells)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pairs.get
        heap = [(p[0], k, p[1]) for k in range(n - 1) if (p := pair((cells[k], cells[k + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, at, made = heapq.heappop(heap)
            nxt = after[at]
            if cells[at] < 0 or nxt >= n or pair((cells[at], cells[nxt])) != (rank, made):
                continue  # a side has merged since
            cells[at], cells[nxt] = made, -1
            after[at] = nxt = after[nxt]
            if nxt < n:
                before[nxt] = at
                if p := pair((made, cells[nxt])):
                    heapq.heappush(heap, (p[0], at, p[1]))
            last = before[at]
            if last >= 0 and (p := pair((cells[last], made))):
                heapq.heappush(heap, (p[0], last, p[1]))
        return [c for c in cells if c >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one word after the other, and how many each has."""
        raw = [w.encode() for w in words]
        flat, count = self.propose_all(raw)
        owner = np.repeat(np.arange(len(raw)), count)
        side = np.flatnonzero(owner[1:] == owner[:-1])
        code, back = np.unique(flat[side] << 32 | flat[side + 1], return_inverse=True)
        fails = ~self.compatible(code >> 32, code & 0xFFFFFFFF)[back]
        failing = sorted(set(owner[side[fails]].tolist()), key=lambda k: len(raw[k]))
        exact: dict[int, list[int]] = {k: self.merge_long(raw[k]) for k in failing if len(raw[k]) > LONG_WORD}
        failing = failing[: len(failing) - len(exact)]
        while failing:  # words of like length share a matrix
            top = 2 * len(raw[failing[0]]) + 8
            now = [k for k in failing[:4096] if len(raw[k]) <= top]
            failing = failing[len(now) :]
            exact.update(zip(now, self.merge([raw[k] for k in now]), strict=True))
        return self._replaced(flat, count, exact)


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(text: str) -> list[str]:
    """The text cut before each lone space."""
    own = _cut(text) if _uneven(text) else text.split(" ")
    own = [" " + p for p in own]
    own[0] = own[0][1:]
    return own if own[0] else own[1:]


class Encoder:
    """Encodes texts piece by piece; `encode(str) -> ids` does what the cache lacks, many pieces in one string."""

    def __init__(self, encode, sizes: np.ndarray, specials: dict[str, int]):
        self.whole, self.sizes, self.specials = encode, sizes, specials
        self.cache: dict[str, bytes] = {}

    def _fill(self, missing: list[str]) -> None:
        """Many pieces in one string: those after a space as they are, those that start a text with line ends between."""
        even = [p for p in missing if not p[-1].isspace() and not p[:2].strip(" ")[:1].isspace() and p[:2] != "  "]
        for lead, own in ((" ", [p for p in even if p[0] == " "]), ("\n", [p for p in even if p[0] != " "])):
            if own:
                gap = int(lead != " ")
                ids = self.whole((lead * gap).join(own)).astype("<u4")
                bytes_at = np.cumsum([len(p.encode()) + gap for p in own]) - gap
                ends = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), bytes_at) + 1)).tolist()
                data, at = ids.tobytes(), 0
                for p, end in zip(own, ends, strict=True):
                    self.cache[p] = data[at:end]
                    at = end + 4 * gap
        for p in set(missing).difference(even):
            self.cache[p] = self.whole(p).astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts: list[list] = []
        for text in texts:
            own: list = [text]
            for s in self.specials:
                own = [x for p in own for x in (self._between(p, s) if isinstance(p, str) and s in p else [p])]
            parts.append([pieces(p) if isinstance(p, str) else p for p in own if p != ""])
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        self._fill(list({x for own in parts for p in own if isinstance(p, list) for x in p if x not in cache}))
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(cache.__getitem__, p)) for p in own) for own in parts]

    def _between(self, text: str, special: str) -> list:
        mark = np.array([self.specials[special]], "<u4").tobytes()
        out: list = []
        for k, part in enumerate(text.split(special)):
            out += [mark, part] if k else [part]
        return out


def own_encoder(path: str) -> Encoder:
    bpe = load(path)
    memo: dict[str, bytes] = {}
    library = Tokenizer.from_file(path).pre_tokenizer

    def whole(text: str) -> np.ndarray:
        if len(memo) > CACHE:
            memo.clear()
        words = [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)] if _odd(text) else _plain(text)
        missing = list({w for w in words if w not in memo})
        if missing:
            flat, count = bpe.encode_words(missing)
            data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            memo.update(zip(missing, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        return np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u4")

    return Encoder(whole, bpe.sizes, bpe.specials)


def grouped(texts: list[str], chars: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters, each with its start."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def decode(ids: np.ndarray, tokens: list[bytes]) -> str:
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text; a null text has no ids, repeated rows are encoded alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = own_encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, own in grouped(texts):
                found = [np.frombuffer(b, "<u4").astype(np.int32) for b in encoder.encode(own)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(own)), values], names=["doc_id", "ids"])

    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows of doc_id, ids; bytes that aren't UTF-8 become U+FFFD. Null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(tokenizer).tokens
        for batch in batches:
            texts = [decode(np.asarray(x.values, np.int64) if x.is_valid else np.empty(0, np.int64), tokens) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, joined by commas), decoded_sha256 of each row, encoded and decoded in one pass.

    A null text counts as empty and has no tokens; repeated rows and null ids each give their row; an empty table gives an
    empty result. Texts of any length are encoded whole, a word of n bytes in n log n steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = own_encoder(tokenizer), load(tokenizer).tokens
        decimal = [str(i).encode() for i in range(len(tokens))]
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            for _, own in grouped(texts):
                for b in encoder.encode(own):
                    ids = np.frombuffer(b, "<u4").tolist()
                    back = b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")
                    rows.append((len(ids), hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(_DIGEST)[1:], strict=True))], schema=_DIGEST)

    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), byte_bpe_path())


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
