"""Byte-pair encoding and decoding by speculate and verify.

Greedy longest-match proposes the tokens of each new word. Byte-pair merging yields exactly the proposed tokens if and
only if it would yield each adjacent pair of them unmerged, so a vectorised check walks the merge trees on both sides of
every boundary, for all new words of a batch at once. Only words with a failing boundary undergo exact merging.

Texts are cut into units at blanks and newlines where that provably agrees with the vocabulary's own splitting pattern;
units met before come from a bounded cache. Texts where it may not agree (adjacent white space, special tokens) are split
by the pattern as a whole. Work is row by row: no shuffle, memory bounded by one batch and the caches.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerframe.llm.shared import name, sliced

#: Fixed value: the pattern that splits text before merging (published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of each cache of a worker; a full cache is emptied. The bound is on memory only, results don't depend on it.
CACHE_ENTRIES = 500_000
#: Characters of text that are encoded together.
CHUNK_CHARS = 1 << 20
#: Longer words are not cached.
CACHED_CHARS = 200

#: Bytes of a word from which it is taken alone, in time that grows with its length; shorter words go together, by arrays.
LONG_WORD = 512

#: Latin, general punctuation and unified Han: their classes are the same in all Unicode versions.
STEADY = regex.compile(r"[\x00-\u024F\u2000-\u206F\u4E00-\u9FA5]*+")

_NEVER = np.int64(1) << 40


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class SpeculativeBpe:
    """A byte-level vocabulary with merges, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in enumerate(_byte_characters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values())
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.merges[a, b] = r, whole
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, a, b
        self.size = size
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # A token can be proposed if its parts were made before it and merging its bytes ends in it.
        made = np.flatnonzero(self.rank >= 0)
        sound = (self.rank[self.left[made]] < self.rank[made]) & (self.rank[self.right[made]] < self.rank[made])
        sound &= self._agree(self.left[made], self.right[made], self.rank[made])
        proposable = {*made[sound].tolist(), *(vocab[c] for c in byte_of)}
        self.id_of = {self.bytes_of[i]: i for i in proposable}
        self._build_trie()
        self._byte_ids = np.array([vocab[c] for c in _byte_characters()], np.int64)
        self._by_rank = np.array([whole for _, whole in self.merges.values()], np.int64)
        self.proposed = self.failed = 0

    def _agree(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair: merging leaves the boundary between tokens x and y alone, before step `until` if given.

        Goes back in time: of the two tokens at the boundary, the one made later is replaced by its part there.
        While both stand, they must not merge with each other before either merges away from the boundary.
        """
        x, y = x.copy(), y.copy()
        good = np.ones(len(x), bool)
        end_x = np.full(len(x), _NEVER) if until is None else until.copy()
        end_y = end_x.copy() if until is None else until - 1
        at = np.arange(len(x))
        while len(at):
            key = x[at] * self.size + y[at]
            place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            step = np.where(self._keys[place] == key, self._ranks[place], _NEVER)
            bad = (step < end_x[at]) & (step <= end_y[at])
            good[at[bad]] = False
            at = at[~bad]
            rank_x, rank_y = self.rank[x[at]], self.rank[y[at]]
            later_y = rank_y >= rank_x
            open_ = np.maximum(rank_x, rank_y) >= 0
            back_y, back_x = at[later_y & open_], at[~later_y & open_]
            end_y[back_y] = self.rank[y[back_y]]
            y[back_y] = self.left[y[back_y]]
            end_x[back_x] = self.rank[x[back_x]]
            x[back_x] = self.right[x[back_x]]
            at = at[open_]
        return good

    def _build_trie(self) -> None:
        """The proposable tokens' prefixes as nodes; a step from a node by a byte is a search in sorted keys."""
        node_of, steps = {b"": 0}, []
        for token in sorted(self.id_of):
            for n in range(1, len(token) + 1):
                if (prefix := token[:n]) not in node_of:
                    node_of[prefix] = len(node_of)
                    steps.append((node_of[prefix[:-1]] * 256 + prefix[-1], node_of[prefix]))
        steps.sort()
        self._steps, self._nodes = np.array([k for k, _ in steps], np.int64), np.array([n for _, n in steps], np.int64)
        self._next = dict(steps)
        self._token_at = np.full(len(node_of), -1, np.int64)
        for token, i in self.id_of.items():
            self._token_at[node_of[token]] = i
        self._token_of = self._token_at.tolist()

    def _propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match of all words data[start:end] at once: tokens in order and the place where each begins.

        Each word has a cursor in the trie; a cursor that cannot step on gives its longest token and begins anew after it.
        """
        word_at, word_end = start.copy(), end.copy()
        node, ahead = np.zeros(len(start), np.int64), start.copy()
        best, best_end = np.full(len(start), -1, np.int64), start.copy()
        places, tokens = [], []
        while len(node):
            inside = ahead < word_end
            key = node * 256 + data[np.minimum(ahead, len(data) - 1)]
            found = np.minimum(np.searchsorted(self._steps, key), len(self._steps) - 1)
            on = inside & (self._steps[found] == key)
            node = np.where(on, self._nodes[found], 0)
            ahead = ahead + on
            token = np.where(on, self._token_at[node], -1)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, ahead, best_end)
            if len(off := np.flatnonzero(~on)):
                places.append(word_at[off])
                tokens.append(best[off])
                word_at[off] = ahead[off] = best_end[off]
                open_ = word_at < word_end
                if not open_.all():
                    word_at, word_end, node, ahead, best, best_end = (x[open_] for x in (word_at, word_end, node, ahead, best, best_end))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, token = np.concatenate(places), np.concatenate(tokens)
        order = np.argsort(place)
        return token[order], place[order]

    def _propose_long(self, word: bytes) -> list[int]:
        """Greedy longest-match of one word. A token that is tried too far is at most as long as the longest token."""
        step, token_of, out, at = self._next.get, self._token_of, [], 0
        while at < len(word):
            node, ahead, best, best_end = 0, at, -1, at + 1
            while ahead < len(word) and (node := step(node * 256 + word[ahead], -1)) >= 0:
                ahead += 1
                if token_of[node] >= 0:
                    best, best_end = token_of[node], ahead
            out.append(best)
            at = best_end
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one word: the first pair of lowest rank is taken from a heap, and its neighbours are put in anew."""
        ids, merges, size = self._byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.merges, len(word)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # A rank and a place in one number; an entry is out of date if another pair stands there by now.
        heap = [found[0] << 40 | i for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := merges.get(pair))]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & (1 << 40) - 1
            j = after[i]
            if ids[i] < 0 or j >= size or (found := merges.get((ids[i], ids[j]))) is None or found[0] != entry >> 40:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < size and (found := merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, found[0] << 40 | a)
        return [x for x in ids if x >= 0]

    def _long(self, word: bytes) -> tuple[bytes, bool]:
        """The ids of one long word, and whether its proposal failed."""
        ids = np.array(self._propose_long(word), np.int64)
        pairs = np.unique(ids[:-1] * self.size + ids[1:])
        failed = not self._agree(pairs // self.size, pairs % self.size).all()
        return np.array(self._merge_long(word) if failed else ids, "<u4").tobytes(), failed

    def _step(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, or never."""
        key = a * self.size + b
        place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[place] == key, self._ranks[place], _NEVER)

    def _merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words data[start:end]: in each round every word makes its first merge of lowest rank.
        Tokens in order and the number of each word's tokens."""
        size = end - start
        word = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        ids = self._byte_ids[data[np.arange(len(word)) - np.repeat(first, size) + np.repeat(start, size)]]
        whole_of = np.full(len(self._ranks), -1, np.int64)
        whole_of[: len(self._by_rank)] = self._by_rank
        step = np.full(len(ids), _NEVER)
        inner = np.flatnonzero(word[:-1] == word[1:])
        step[inner] = self._step(ids[inner], ids[inner + 1])
        done_word, done_ids = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(step, starts)
            spread = np.repeat(least, np.diff(np.r_[starts, len(ids)]))
            still = spread < _NEVER
            if not still.all():
                done_word.append(word[~still])
                done_ids.append(ids[~still])
                word, ids, step, spread = word[still], ids[still], step[still], spread[still]
                if not len(ids):
                    break
            hit = np.flatnonzero(step == spread)
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]
            ids[hit] = whole_of[step[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            hit = (np.cumsum(keep) - 1)[hit]
            word, ids, step = word[keep], ids[keep], step[keep]
            near = np.unique(np.r_[hit, hit[hit > 0] - 1])
            near = near[near + 1 < len(ids)]
            same = word[near] == word[near + 1]
            step[hit] = _NEVER
            step[near] = _NEVER
            step[near[same]] = self._step(ids[near[same]], ids[near[same] + 1])
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(size))

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        if max(map(len, words)) > LONG_WORD:
            short = iter(self.words([w for w in words if len(w) <= LONG_WORD]))
            out = []
            for word in words:
                ids, failed = self._long(word) if len(word) > LONG_WORD else (next(short), None)
                out.append(ids)
                if failed is not None:
                    self.proposed, self.failed = self.proposed + 1, self.failed + failed
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, end = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(size)
        start = end - size
        ids, place = self._propose(data, start, end)
        owner = np.searchsorted(end, place, side="right")
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, which = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        good = self._agree(pairs // self.size, pairs % self.size)[which]
        failing = np.unique(owner[inner[~good]])
        self.proposed += len(words)
        self.failed += len(failing)
        counts = np.bincount(owner, minlength=len(words))
        proposed = ids.astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        out = [proposed[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]
        if len(failing):
            ids, counts = self._merge(data, start[failing], end[failing])
            exact, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
            for k, a, b in zip(failing.tolist(), (ends - counts * 4).tolist(), ends.tolist(), strict=True):
                out[k] = exact[a:b]
        return out

    def decoded(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class UnitEncoder:
    """Texts to ids (little-endian unsigned 32-bit) by a function that encodes distinct strings.

    A text is cut before each blank or newline. Such a cut is safe where white space stands alone, as the pattern then
    puts a token boundary there; a unit that begins or ends otherwise is remembered as unsafe, and a text that has one is
    split by the pattern at full length.
    """

    def __init__(self, path: str, words: Callable[[list[str]], list[bytes]], special: dict[str, int], entries: int = CACHE_ENTRIES) -> None:
        self._encode, self.special, self.entries = words, special, entries
        self._pattern = regex.compile(PATTERN)
        self._special_pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._library = Tokenizer.from_file(path).pre_tokenizer
        self.units: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def split(self, text: str) -> list[str]:
        """The words of a text. Outside the scripts whose classes no Unicode version changes, the library's splitter decides."""
        if text.isascii() or STEADY.fullmatch(text):
            return self._pattern.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _learn_words(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.entries:
            self.words.clear()
            new = list(words)
        self.words.update(zip(new, self._encode(new), strict=True))

    def _learn_units(self, units: list[str]) -> None:
        split: dict[str, list[str]] = {}
        for unit in units:
            body = unit[1:] if unit[:1] == "\n" else unit
            if not body or body[0].isspace() or body[-1].isspace():
                self.units[unit] = None
            else:
                split[unit] = self.split(unit if body is not unit else " " + unit)
        self._learn_words(set().union(*split.values()))
        word = self.words.__getitem__
        for unit, words in split.items():
            self.units[unit] = b"".join(map(word, words)) if len(words) > 1 else word(words[0])

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, without units."""
        parts = [[p for p in (self._special_pattern.split(t) if self._has_special(t) else [t]) if p] for t in texts]
        words = [[[p] if p in self.special else self.split(p) for p in ps] for ps in parts]
        self._learn_words({w for ws in words for each in ws for w in each if w not in self.special})
        known = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        return [b"".join(known[w] if w in known else self.words[w] for each in ws for w in each) for ws in words]

    def _chunk(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = [c[0] if c[0] and not c[0][0].isspace() and not c[0][-1].isspace() and not self._has_special(t) else None for c, t in zip(cut, texts, strict=True)]
        used = set().union(*(c[1:] for c, h in zip(cut, heads, strict=True) if h))
        new = [u for u in used if u not in self.units]
        if len(self.units) + len(new) > self.entries:
            self.units.clear()
            new = list(used)
        self._learn_units(new)
        out: list[bytes | None] = []
        for units, head in zip(cut, heads, strict=True):
            ids = list(map(self.units.__getitem__, units[1:])) if head else [None]
            out.append(None if None in ids else b"".join(ids))
        safe = [k for k, ids in enumerate(out) if ids is not None]
        for k, first in zip(safe, self.whole([heads[k] for k in safe]), strict=True):
            out[k] = first + out[k]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.whole([texts[k] for k in rest]), strict=True):
            out[k] = ids
        for long in [u for u in new if len(u) > CACHED_CHARS]:
            del self.units[long]
        for long in [w for w in self.words if len(w) > CACHED_CHARS] if len(self.words) > self.entries // 2 else ():
            del self.words[long]
        return out

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """The ids of texts, in chunks of bounded size and in order."""
        chunk, chars = [], 0
        for text in texts:
            chunk.append(text)
            chars += len(text) + 1
            if chars > CHUNK_CHARS:
                yield self._chunk(chunk)
                chunk, chars = [], 0
        if chunk:
            yield self._chunk(chunk)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


@lru_cache(maxsize=2)
def speculative_encoder(path: str) -> UnitEncoder:
    """The encoder of a worker process, with its caches."""
    bpe = vocabulary(path)
    return UnitEncoder(path, lambda new: bpe.words([w.encode() for w in new]), bpe.special)


def _appended(rows: DataFrame, column: str, fresh: list[T.StructField], work: Callable[[list], Iterator[tuple[list, ...]]]) -> DataFrame:
    """rows with fresh columns, which replace those of the same names: work takes a batch's values of `column` and yields the
    fresh columns' values for one part of the batch after another."""
    kept = rows.drop(*[f.name for f in fresh])
    fields, at = [*kept.schema.fields, *fresh], kept.columns.index(column)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in fresh]
        for batch in (part for whole in batches for part in sliced(whole)):
            done = 0
            for parts in work(batch.column(at).to_pylist()):
                old = batch.slice(done, len(parts[0]))
                done += len(parts[0])
                yield pa.RecordBatch.from_arrays([*old.columns, *map(pa.array, parts, kinds)], names=plain.names)

    return kept.mapInArrow(run, plain).toDF(*[f.name for f in fields])


def bpe_encode(docs: DataFrame, vocabulary_path: str, text_column: str = "text", ids_column: str = "ids", decoded_column: str | None = None) -> DataFrame:
    """docs with `ids_column`: the text's token ids as little-endian unsigned 32-bit integers, without added special tokens.

    A null or empty text has no ids. Special tokens written out in a text become their ids. Rows keep all other columns,
    repeated rows are encoded alike, an empty table stays empty; texts of any length are encoded whole. With
    `decoded_column`, the ids are decoded again on the spot, as `bpe_decode` does, for a round trip in one pass.
    The file at vocabulary_path must be on every machine.
    """
    fresh = [T.StructField(ids_column, T.BinaryType(), False)] + [T.StructField(c, T.StringType(), False) for c in [decoded_column] if c]

    def work(texts: list[str | None]) -> Iterator[tuple[list, ...]]:
        bpe = vocabulary(vocabulary_path)
        for ids in speculative_encoder(vocabulary_path).encode([t or "" for t in texts]):
            yield (ids, [bpe.decoded(i) for i in ids]) if decoded_column else (ids,)

    return _appended(docs, text_column, fresh, work)


def bpe_decode(rows: DataFrame, vocabulary_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """rows with `text_column`: the text of the ids, special tokens included; invalid UTF-8 becomes U+FFFD.

    Null and empty ids give an empty text. Rows keep all other columns, whatever they are called; one called `text_column` is replaced. Repeated
    rows are decoded alike, ids of any number whole; an empty table stays empty."""

    def work(ids: list[bytes | None]) -> Iterator[tuple[list, ...]]:
        bpe = vocabulary(vocabulary_path)
        yield ([bpe.decoded(b or b"") for b in ids],)

    return _appended(rows, ids_column, [T.StructField(text_column, T.StringType(), False)], work)


def token_digests(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return rows.select(
        name(id_column).alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
