"""Token ids of whole texts, from a cache of the ids of their words."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .shared import bytes_of, mixed, word_spans

_SEPARATOR = "<|startoftext|>"
SEGMENT = 1 << 19  # bytes of words that are hashed together
LONG = 256  # bytes from which a word is not hashed but always encoded
CACHED_WORDS = 1 << 20
CACHED_IDS = 1 << 23
RUN = 256  # words encoded as one text

# Odd bases of the two hashes of a word; together they are its 128-bit mark.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"""!"#$%&()*+,-./:;=>?@[\\]^_`{|}~""")] = True  # no apostrophe: it may begin a contraction
_CLOSES_STEM = np.zeros(256, bool)
_CLOSES_STEM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
_TOKENIZERS: dict[str, TokenIds] = {}


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    if not _POWERS:
        for base in _BASES:
            up = np.full(SEGMENT + 2 * LONG, base, np.uint64)
            down = np.full(SEGMENT + 2 * LONG, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS.append((np.cumprod(up), np.cumprod(down)))
    return _POWERS


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + counts[i] - 1 for every i, on end."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class TokenIds:
    """Ids of texts by a vocabulary that drops white space, ignores case and never merges across words.

    A text's ids are those of its words between ASCII white space on end. ASCII letters are lowered
    here, but in words with an accent of their own (U+0300 to U+036F, first byte CC or CD) or with
    ``<|``, which may spell a special token. Letters never merge with marks, so marks behind a word
    count as a word of their own. Each slice of texts is looked up by its distinct words; words are
    told apart by two 64-bit hashes, and long ones are encoded each time. When the cache is full,
    the words that were met in one slice only leave it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # Threads of its own would each keep memory, beside the task's cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

        self.whole = Tokenizer.from_file(path)
        self.separator = self.whole.token_to_id(_SEPARATOR)
        # Words of lower-case ASCII letters need no normalising and no pattern.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted; the others follow this order
        self.checks = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.met = np.empty(0, np.int64)
        self.ids, self.filled = np.empty(1 << 16, np.uint32), 0

    def _trim(self) -> None:
        """Make room: words met in one slice only go; if that is not enough, all go."""
        if len(self.keys) <= CACHED_WORDS and self.filled <= CACHED_IDS:
            return
        kept = self.met > 1
        if kept.sum() > CACHED_WORDS // 2 or self.counts[kept].sum() > CACHED_IDS // 2:
            return self._forget()
        ids = self.ids[_spread(self.starts[kept], self.counts[kept])]
        self.keys, self.checks, self.counts = self.keys[kept], self.checks[kept], self.counts[kept]
        self.starts = np.cumsum(self.counts) - self.counts
        self.met = self.met[kept] // 2
        self.ids, self.filled = ids, len(ids)

    def _encode(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray) -> int:
        """Append ids; returns where they begin."""
        start, self.filled = self.filled, self.filled + len(ids)
        if self.filled > len(self.ids):
            grown = np.empty(2 * self.filled, np.uint32)
            grown[:start] = self.ids[:start]
            self.ids = grown
        self.ids[start : self.filled] = ids
        return start

    def _learn(self, words: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode distinct words and store their ids; returns where they begin and how many there are."""
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)

        def runs_of(chosen: np.ndarray) -> list[np.ndarray]:
            return [chosen[i : i + RUN] for i in range(0, len(chosen), RUN)]

        def texts_of(runs: list[np.ndarray], between: bytes) -> list[str]:
            return [between.join([words[i] for i in run.tolist()]).decode() for run in runs]

        def closed(tokenizer, chosen: np.ndarray) -> list[np.ndarray]:
            """Words of letters, many as one text: each closes with a word end. Returns those that did not."""
            runs, failed = runs_of(chosen), []
            for run, ids in zip(runs, self._encode(tokenizer, texts_of(runs, b" "))):
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(run) or ends[-1] != len(ids):
                    failed.append(run)
                    continue
                counts[run] = np.diff(ends, prepend=0)
                starts[run] = self._store(ids) + ends - counts[run]
            return failed

        rest = closed(self.plain, np.flatnonzero(letters))
        other = np.flatnonzero(~letters)
        spelled = [words[i].decode() for i in other.tolist()]
        alphabetic = np.array([t.isalpha() and t.lower().isalpha() for t in spelled], bool)
        rest += [*closed(self.whole, other[alphabetic]), other[~alphabetic]]
        rest = np.concatenate(rest)
        special = np.array([b"<|" in words[i] for i in rest.tolist()], bool)
        alone = rest[special]
        for i, ids in zip(alone.tolist(), self._encode(self.whole, [words[i].decode() for i in alone.tolist()])):
            starts[i], counts[i] = self._store(ids), len(ids)
        runs = runs_of(rest[~special])
        for run, ids in zip(runs, self._encode(self.whole, texts_of(runs, f" {_SEPARATOR} ".encode()))):
            cuts = np.flatnonzero(ids == self.separator)
            begins, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            starts[run], counts[run] = self._store(ids) + begins, ends - begins
        return starts, counts

    def _words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        every = data.tobytes()
        return [every[b:e] for b, e in zip(begin.tolist(), end.tolist())]

    def _segment(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at begin to end, on end, and how many each word has."""
        self._trim()
        low = data.astype(np.uint64) + np.uint64(1)
        marks = []
        for up, down in _powers():
            sums = np.zeros(len(low) + 1, np.uint64)
            np.cumsum(low * up[: len(low)], out=sums[1:])
            marks.append((sums[end] - sums[begin]) * down[begin])
        length = (end - begin).astype(np.uint64)
        key, check = mixed(marks[0] + length), mixed(marks[1] ^ (length << np.uint64(48)))
        unique, first, which = np.unique(key, return_index=True, return_inverse=True)

        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        near = np.minimum(place, max(len(self.keys) - 1, 0))
        if len(self.keys):
            known = self.keys[near] == unique
        starts, counts = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        at = near[known]
        self.met[at] += 1
        starts[known], counts[known] = self.starts[at], self.counts[at]
        marked = np.where(known, self.checks[near] if len(self.keys) else np.uint64(0), check[first])
        new = np.flatnonzero(~known)
        if len(new):
            b, e = begin[first[new]], end[first[new]]
            letters = np.append(0, np.cumsum(_IS_LETTER[data]))
            fresh = self._learn(self._words(data, b, e), letters[e] - letters[b] == e - b)
            starts[new], counts[new] = fresh
            self.keys = np.insert(self.keys, place[new], unique[new])
            for name, values in (("checks", check[first[new]]), ("starts", fresh[0]), ("counts", fresh[1]), ("met", 1)):
                setattr(self, name, np.insert(getattr(self, name), place[new], values))
        starts, counts = starts[which], counts[which]
        # Two words of one key differ in the other hash: such a word is encoded by itself.
        odd = np.flatnonzero(marked[which] != check)
        if len(odd):
            words = self._words(data, begin[odd], end[odd])
            starts[odd], counts[odd] = self._learn(words, np.zeros(len(odd), bool))
        return self.ids[_spread(starts, counts)], counts

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of the column on end, and where each text's ids begin and the last ones end."""
        raw, at = bytes_of(column)
        begin, end = word_spans(raw, at)
        data = _LOWER[raw]
        # Words that stay as they are written.
        odd = (raw == 0xCC) | (raw == 0xCD)
        odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        odd = np.unique(np.searchsorted(begin, np.flatnonzero(odd), side="right") - 1)
        for b, e in zip(begin[odd].tolist(), end[odd].tolist()):
            data[b:e] = raw[b:e]
        if len(begin):
            # Marks behind a word become a word.
            last = np.maximum.accumulate(np.where(_IS_MARK[data], -1, np.arange(len(data))))[end - 1]
            cut = (last >= begin) & (last < end - 1)
            cut &= _CLOSES_STEM[data[np.maximum(last, 0)]]
            # Only the search for "<|" keeps marks with their word; accents do not reach an ASCII stem's end.
            holds = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
            cut[np.unique(np.searchsorted(begin, holds, side="right") - 1)] = False
            where = np.flatnonzero(cut)
            stem = last[where] + 1
            begin, end = np.insert(begin, where + 1, stem), np.insert(end, where, stem)

        parts, counts = [], np.zeros(len(begin), np.int64)
        long = np.flatnonzero(end - begin > LONG)
        edges = [*long.tolist(), len(begin)]
        u = 0
        for edge in edges:
            while u < edge:
                v = int(np.searchsorted(end[:edge], begin[u] + SEGMENT, side="right"))
                v = max(v, u + 1)
                ids, counts[u:v] = self._segment(data[begin[u] : end[v - 1]], begin[u:v] - begin[u], end[u:v] - begin[u])
                parts.append(ids)
                u = v
            if edge < len(begin):
                ids = self._encode(self.whole, [data[begin[edge] : end[edge]].tobytes().decode()])[0]
                parts.append(ids)
                counts[edge] = len(ids)
                u = edge + 1
        sums = np.append(0, np.cumsum(counts))
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), sums[np.searchsorted(begin, at)]


def token_ids(path: str) -> TokenIds:
    """The tokenizer of a file, with its cache, once per process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TokenIds(path)
    return _TOKENIZERS[path]
