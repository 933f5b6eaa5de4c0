"""BPE encoding and decoding by speculation: propose greedily, verify pairs, merge only what fails.

A word's BPE tokens are right exactly if every token encodes to itself and every two neighbours are
compatible, that is, the merges of their joint text keep the border between them. So the longest
matching tokens are proposed from the left for all distinct words of a slice at once, all distinct
pairs of neighbours are tested at once, and only the words with a failing pair are merged by rank,
again all at once.

The file is a BPE of the ``tokenizers`` library with word ends: NFC, white space dropped, lower
case, a split by pattern, byte-level symbols, and merges by rank. Special tokens inside a text keep
their own ids, as the library has it. Chunks of ASCII and Latin-1 letters are split by byte classes;
all others by the file's own pattern.

Null and empty texts give no ids and decode to the empty string. Texts of any length are encoded
whole and a word is never cut.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from talentgrid.llm.common import _BYTE, hashes, offsets_of, slices

NEVER = np.iinfo(np.int64).max
#: Words of more bytes are encoded one by one, with a heap; the others together.
LONG = 128
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
#: 64-bit odd multiplier of the rolling hash of bytes, and its inverse.
STEP = 0x9E3779B97F4A7C15
STEP_BACK = pow(STEP, -1, 2**64)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def byte_classes() -> np.ndarray:
    """The class of each byte; whatever the quick split can't decide is odd."""
    out = np.full(256, ODD, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = SPACE if c in " \t\n\v\f\r" else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    out[ord("'")] = ODD
    return out


CLASS = byte_classes()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Table:
    """Numbers by 64-bit key, looked up many at a time."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << self.BITS
        if len(keys) > size // 4:
            raise ValueError("the table is too small for its keys")
        self.key = np.zeros(size, np.uint64)
        self.value = np.full(size, -1, np.int32)
        for k, v in zip(keys.tolist(), values.tolist()):
            s = k >> (64 - self.BITS)
            while self.value[s] >= 0:
                s = (s + 1) % size
            self.key[s], self.value[s] = k, v

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        at = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            v = self.value[at]
            hit = self.key[at] == keys[left]
            hit &= v >= 0
            out[left[hit]] = v[hit]
            more = ~hit & (v >= 0)  # an empty slot ends the search
            left, at = left[more], (at[more] + 1) % len(self.key)
        return out


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One well-spread key for two ids (a bijection of the joint number)."""
    x = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the hash step and of its inverse, as far as they were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << int(n).bit_length()
            one = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate([one, np.full(size - 1, STEP, np.uint64)]))
            cls.down = np.cumprod(np.concatenate([one, np.full(size - 1, STEP_BACK, np.uint64)]))
        return cls.up, cls.down


def spread(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[k] : starts[k] + sizes[k]] for all k, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) - np.repeat(ends - sizes - starts, sizes)]


class WordBpe:
    """The vocabulary and merges of one tokenizer file, with the tables that proposals and tests need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a lower-casing BPE with word ends")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # white space as Unicode defines it; Python's own class has four control characters more
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        names = {i: t for t, i in (*vocab.items(), *self.special.items())}
        size = max(names) + 1
        self.pieces = pa.array([names.get(i, "") for i in range(size)])
        # what made each token, and when: a base symbol has no parts and exists from the start
        self.born, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), (r, z))
            if self.left[z] < 0:
                self.left[z], self.right[z], self.born[z] = x, y, r
        pairs = np.array(list(self.rank), np.int64).reshape(-1, 2)
        self.pairs = Table(pair_key(pairs[:, 0], pairs[:, 1]), np.arange(len(pairs)))
        self.pair_rank, self.pair_to = np.array(list(self.rank.values()), np.int64).reshape(-1, 2).T
        byte = byte_characters()
        self.base = np.array([vocab[c] for c in byte], np.int64)
        self.base_end = np.array([vocab[c + end] for c in byte], np.int64)
        code = {c: b for b, c in enumerate(byte)}
        inner, final = [], []
        for t, i in vocab.items():
            body, ends = t.removesuffix(end), t.endswith(end) and t != end
            if any(c not in code for c in body) or not body:
                continue
            raw = bytes(code[c] for c in body)
            if self.merged(self._symbols(raw, ends)) == [i]:  # else it may never be proposed
                (final if ends else inner).append((raw, i))
        self.longest = max(len(raw) for raw, _ in (*inner, *final))
        self.inner, self.final = self._by_bytes(inner), self._by_bytes(final)
        self.inner_of, self.final_of = dict(inner), dict(final)

    def _by_bytes(self, tokens: list[tuple[bytes, int]]) -> Table:
        down = Powers.of(256)[1]
        keys = [(_BYTE[np.frombuffer(raw, np.uint8)] * down[: len(raw)]).sum(dtype=np.uint64) for raw, _ in tokens]
        return Table(spread(np.array(keys, np.uint64)), np.array([i for _, i in tokens]))

    def _symbols(self, raw: bytes, ends: bool = True) -> list[int]:
        ids = self.base[np.frombuffer(raw, np.uint8)].tolist()
        if ends:
            ids[-1] = int(self.base_end[raw[-1]])
        return ids

    # -------------------------------------------------------- one word at a time
    def merged(self, ids: list[int]) -> list[int]:
        """Merge neighbours by rank, leftmost first: the definition that everything else agrees with."""
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if j >= n or ids[k] != pair[0] or ids[j] != pair[1]:
                continue
            ids[k], ids[j] = self.rank[pair][1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else n
                if b < n and (p := (ids[a], ids[b])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], a, p))
        return [i for i in ids if i >= 0]

    def proposed_long(self, raw: bytes) -> list[int]:
        """Longest matches from the left, for a word of any length."""
        out, at, n = [], 0, len(raw)
        while at < n:
            if n - at <= self.longest and (i := self.final_of.get(raw[at:])) is not None:
                return [*out, i]
            for stop in range(min(n - 1, at + self.longest), at, -1):
                if (i := self.inner_of.get(raw[at:stop])) is not None:
                    out.append(i)
                    at = stop
                    break
            else:
                return []
        return out

    # -------------------------------------------------------- many words at once
    def proposed(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left for every word raw[start : start + size]: (ids, how many of each word;
        0 where no tokens fit)."""
        up, down = Powers.of(len(raw) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * down[: len(raw)], dtype=np.uint64)])
        live = np.arange(len(start))
        at, end = start.copy(), start + size
        got_word, got_id = [], []
        dead = []
        while len(live):
            a, left = at[live], end[live] - at[live]
            token = np.full(len(live), -1, np.int32)
            took = np.zeros(len(live), np.int64)
            may = np.flatnonzero(left <= self.longest)
            token[may] = self.final.get(spread((total[end[live[may]]] - total[a[may]]) * up[a[may]]))
            took[token >= 0] = left[token >= 0]
            done = token >= 0
            todo = np.flatnonzero(~done)
            for n in range(min(self.longest, int(left.max())), 0, -1):
                if not len(todo):
                    break
                fits = todo[left[todo] > n]
                if len(fits):
                    p = a[fits]
                    found = self.inner.get(spread((total[p + n] - total[p]) * up[p]))
                    ok = found >= 0
                    token[fits[ok]], took[fits[ok]] = found[ok], n
                    todo = todo[token[todo] < 0]
            dead.append(live[todo])
            fine = token >= 0
            got_word.append(live[fine])
            got_id.append(token[fine])
            at[live] += took
            live = live[fine & ~done]
        word, ids = np.concatenate(got_word or [np.zeros(0, np.int64)]), np.concatenate(got_id or [np.zeros(0, np.int32)])
        keep = ~np.isin(word, np.concatenate(dead or [np.zeros(0, np.int64)]))
        word, ids = word[keep], ids[keep]
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.int64), np.bincount(word, minlength=len(start))

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens: whether merging their joint text keeps the border between them.

        Along the border stand the right parts of the first token and the left parts of the second.
        Each stands there from its own merge until the merge of what contains it. Two of them are
        joined across the border if their merge comes before both of those ends; on equal ranks the
        leftmost pair goes first, so the first token's own merge wins and the second's loses.
        """
        good = np.ones(len(first), bool)
        a, b = first.astype(np.int64), second.astype(np.int64)
        a_end, b_end = np.full(len(a), NEVER), np.full(len(b), NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = self.pairs.get(pair_key(x, y))
            when = np.where(at >= 0, np.maximum(self.pair_rank[at], np.maximum(self.born[x], self.born[y])), NEVER)
            bad = (when < a_end[live]) & (when <= b_end[live]) & (when < NEVER)
            good[live[bad]] = False
            # go back in time: undo the later of the two merges along the border
            born_x, born_y = self.born[x], self.born[y]
            more = ~bad & ((born_x >= 0) | (born_y >= 0))
            first_goes = born_x >= born_y
            ua, ub = live[more & first_goes], live[more & ~first_goes]
            a_end[ua], a[ua] = self.born[a[ua]], self.right[a[ua]]
            b_end[ub], b[ub] = self.born[b[ub]], self.left[b[ub]]
            live = live[more]
        return good

    def exact(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every word raw[start : start + size] by rank, all in step: (ids, how many of each word)."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        step = 0
        while step < len(order):
            widest = int(size[order[min(len(order), step + 8192) - 1]])
            group = order[step : step + 8192]
            step += 8192
            col = np.arange(widest)
            inside = col < size[group][:, None]
            ids = np.where(inside, self.base[raw[np.minimum(start[group][:, None] + col, len(raw) - 1)]], -1)
            last = size[group] - 1
            rows = np.arange(len(group))
            ids[rows, last] = self.base_end[raw[start[group] + last]]
            n = size[group].copy()
            pair = np.full(ids.shape, -1, np.int64)
            if widest > 1:
                both = inside[:, 1:]
                pair[:, :-1][both] = self.pairs.get(pair_key(ids[:, :-1][both], ids[:, 1:][both]))
            rank = np.where(pair >= 0, self.pair_rank[pair], NEVER)
            live = rows
            while len(live):
                k = rank[live].argmin(1)
                some = rank[live, k] < NEVER
                live, k = live[some], k[some]
                if not len(live):
                    break
                ids[live, k] = self.pair_to[pair[live, k]]
                for m in (ids, pair, rank):
                    m[live, :-1] = np.take_along_axis(m[live], col[:-1] + (col[:-1] > k[:, None]), 1)
                n[live] -= 1
                for j, fits in ((k - 1, k > 0), (k, k < n[live] - 1), (k, k >= n[live] - 1)):
                    r, c = live[fits], j[fits]
                    if not len(r):
                        continue
                    if fits is not None and (c >= n[r] - 1).all():
                        pair[r, c], rank[r, c] = -1, NEVER
                        continue
                    p = self.pairs.get(pair_key(ids[r, c], ids[r, c + 1]))
                    pair[r, c], rank[r, c] = p, np.where(p >= 0, self.pair_rank[p], NEVER)
                # what lies beyond a word's end can't be merged
                pair[live, n[live] - 1], rank[live, n[live] - 1] = -1, NEVER
            keep = col < n[:, None]
            out.append((group, n, ids[keep]))
        count = np.zeros(len(size), np.int64)
        flat = np.concatenate([x for *_, x in out]) if out else np.zeros(0, np.int64)
        at, seen = np.zeros(len(size), np.int64), 0
        for group, n, x in out:
            count[group] = n
            at[group] = seen + np.cumsum(n) - n
            seen += len(x)
        return gathered(flat, at, count), count

    def encode_words(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: proposals, one test of all distinct pairs, exact merges for the rest."""
        long = size > LONG
        ids, count = self.proposed(raw, start, np.where(long, 0, size))
        if long.any():
            own = {int(k): self.proposed_long(raw[start[k] : start[k] + size[k]].tobytes()) for k in np.flatnonzero(long)}
            ids, count = replaced(ids, count, own)
        good = count > 0
        if len(ids) > 1:
            owner = np.repeat(np.arange(len(count)), count)
            inside = owner[:-1] == owner[1:]
            pairs, back = np.unique((ids[:-1][inside] << 32) | ids[1:][inside], return_inverse=True)
            fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            good[owner[:-1][inside][~fine[back]]] = False
        short = np.flatnonzero(~good & ~long & (size > 0))
        right, n = self.exact(raw, start[short], size[short])
        all_ids, all_at = np.concatenate([ids, right]), np.cumsum(count) - count
        all_at[short], count[short] = len(ids) + np.cumsum(n) - n, n
        ids = gathered(all_ids, all_at, count)
        if (bad := np.flatnonzero(~good & long)).size:
            ids, count = replaced(ids, count, {int(k): self.merged(self._symbols(raw[start[k] : start[k] + size[k]].tobytes())) for k in bad})
        return ids, count

    def chunk_words(self, chunk: str) -> list[bytes | int]:
        """The words of any chunk, in UTF-8; special tokens as ids."""
        out: list[bytes | int] = []
        for part in self.special_split.split(chunk) if "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            else:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.extend(w.encode("utf-8") for w in self.pattern.findall(part))
        return out


def replaced(ids: np.ndarray, count: np.ndarray, own: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The same runs of ids with those of some words exchanged."""
    at = np.cumsum(count) - count
    extra = [np.array(v, np.int64) for v in own.values()]
    begin = len(ids)
    for k, v in zip(own, extra):
        at[k], count[k] = begin, len(v)
        begin += len(v)
    return gathered(np.concatenate([ids, *extra]), at, count), count


class Encoder:
    """Encodes and decodes slices of texts."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)

    def _words(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts in order: (bytes, start, size, place in the input); size -1: start is a special id."""
        n = len(raw)
        kind = CLASS[raw]
        lead = np.flatnonzero(raw == 0xC3)
        follow = raw[np.minimum(lead + 1, n - 1)]
        latin = lead[(follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)]
        kind[latin] = kind[latin + 1] = LETTER
        low = LOWER[raw]
        upper = latin[raw[latin + 1] <= 0x9E] + 1
        low[upper] += 0x20
        border = np.zeros(n + 1, bool)
        border[off] = True
        gap = kind == SPACE
        first = ~gap & (border[:-1] | np.concatenate([[True], gap[:-1]]))
        chunk_at = np.flatnonzero(first)
        chunk = np.cumsum(first) - 1
        odd = np.zeros(len(chunk_at), bool)
        odd[chunk[np.flatnonzero((kind == ODD))]] = True
        odd[chunk[np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))]] = True
        begins = first | (~gap & ((kind != np.concatenate([[SPACE], kind[:-1]])) | (kind == DIGIT)))
        stops = np.concatenate([begins[1:] | gap[1:] | border[1:-1], [True]]) & ~gap
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if odd.any():
            quick = ~odd[chunk[start]]
            which = np.flatnonzero(odd)
            ends = end[np.searchsorted(start, np.append(chunk_at[1:], n)[which]) - 1]
            text = raw.tobytes()
            extra, e_start, e_size, e_place, at = [], [], [], [], n
            for a, b in zip(chunk_at[which].tolist(), ends.tolist()):
                for w in self.bpe.chunk_words(text[a:b].decode("utf-8")):
                    e_place.append(a)
                    if isinstance(w, int):
                        e_start.append(w)
                        e_size.append(-1)
                    else:
                        extra.append(w)
                        e_start.append(at)
                        e_size.append(len(w))
                        at += len(w)
            low = np.concatenate([low, np.frombuffer(b"".join(extra), np.uint8)])
            place = np.concatenate([start[quick], np.array(e_place, np.int64)])
            order = np.argsort(place, kind="stable")
            size = np.concatenate([(end - start)[quick], np.array(e_size, np.int64)])[order]
            start = np.concatenate([start[quick], np.array(e_start, np.int64)])[order]
            return low, start, size, place[order]
        return low, start, end - start, start

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        raw, off = offsets_of(pc.fill_null(texts, ""))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        low, start, size, place = self._words(raw, off)
        special = size < 0
        word = np.flatnonzero(~special)
        joined = pa.StringArray.from_buffers(
            len(word),
            pa.py_buffer(np.concatenate([[0], np.cumsum(size[word])]).astype(np.int32).tobytes()),
            pa.py_buffer(gathered(low, start[word], size[word]).tobytes()),
        )
        _, one, back = np.unique(hashes(joined), return_index=True, return_inverse=True)
        ids, count = self.bpe.encode_words(low, start[word][one], size[word][one])
        at = np.cumsum(count) - count
        all_at, all_n = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
        all_at[word], all_n[word] = at[back], count[back]
        all_at[special] = len(ids) + np.arange(special.sum())
        flat = gathered(np.concatenate([ids, start[special]]), all_at, all_n)
        upto = np.concatenate([[0], np.cumsum(all_n)])
        return flat.astype(np.uint32), upto[np.searchsorted(place, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """The text of each run of ids as the library writes it where a file names no decoder: pieces joined by spaces."""
        pieces = self.bpe.pieces.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pieces), " ")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def digests(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    view, cut = memoryview(np.ascontiguousarray(raw)), off.tolist()
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, ids, decoded) for each row; ``ids=False`` leaves out the last two.

    Empty and null texts have no ids and decode to the empty string. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, text):
                flat, off = coder.encode(part.column(text))
                decoded = coder.decode(flat, off)
                cols = {
                    key: part.column(key),
                    "n_tokens": pa.array(np.diff(off)),
                    "ids_sha256": digests(flat.astype("<u4").view(np.uint8), off * 4),
                    "decoded_sha256": digests(*offsets_of(decoded)),
                }
                if ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int64)))
                    cols["decoded"] = decoded
                yield pa.RecordBatch.from_pydict(cols)

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if ids else "")
    return docs.select(key, text).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            lists = batch.column(ids)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            text = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "text": pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), text)})

    return docs.select(key, ids).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, text string")
