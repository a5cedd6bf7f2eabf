"""Encoding of a corpus with a byte-level BPE vocabulary, by replaying the merges over the distinct words of a block.

The words of a block of texts (tens of megabytes) are deduplicated; an
inverted index leads from each token pair to its positions in these words, and
every merge is applied once, in rank order, at all its positions, touching only
the neighbours. Words of one block are independent of those of another, so the
result does not depend on how the corpus is cut into blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
# The characters with the Unicode property White_Space
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")  # Fixed values: what may follow an apostrophe in one word

_BLOCK_CHARS = 24_000_000  # a block's texts; any single text is taken whole
_CHUNK_CHARS = 3_000_000  # split into words at once
_CACHE_WORDS = 1_500_000  # known words kept between blocks; then forgotten, which costs time only
_FEW = 10  # positions up to which plain Python beats array operations


@dataclass
class Vocabulary:
    """Ids of the 256 bytes, and the merges in rank order: left, right and resulting id."""

    of_byte: np.ndarray
    left: np.ndarray
    right: np.ndarray
    result: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        of_byte = np.array([ids[c] for c in _byte_letters()], np.int64)
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        return cls(of_byte, left, right, np.array([ids[a + b] for a, b in pairs], np.int64))


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself where printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, name in ((_LETTER, "L"), (_NUMBER, "N")):
        table[[ord(c) for c in regex.findall(rf"\p{{{name}}}", everything)]] = kind
    table[_WHITE] = _SPACE
    return table


def word_starts(code: np.ndarray, doc_start: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions at which the words of concatenated texts start.

    `code`: code points; `doc_start`: sorted distinct positions at which a text
    starts. A word is a run of letters, of numbers or of other marks, with the
    one blank (U+0020) before it; an apostrophe takes its short suffix; white
    space before a word leaves its last character alone.
    """
    n = len(code)
    kind = classes[code]
    new = np.zeros(n + 1, bool)
    new[doc_start] = True
    fresh = new[:n].copy()
    new[n] = True
    new[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new[:n])
    stop = np.append(run[1:], n)
    k = kind[run]
    start = np.zeros(n, bool)
    solid = k != _SPACE
    # does the run follow a blank of its own text?
    led = solid & (run > 0) & ~fresh[run]
    led[led] = code[run[led] - 1] == 0x20
    start[run[solid & ~led]] = True
    start[run[led] - 1] = True
    space = ~solid
    start[run[space]] = True
    follows = np.zeros(len(run), bool)  # a word follows the white space in the same text
    follows[:-1] = space[:-1] & ~fresh[run[1:]]
    start[stop[space & follows & (code[stop - 1] != 0x20) & (stop - run >= 2)] - 1] = True
    # an apostrophe alone before letters, no blank before it
    mark = np.flatnonzero((k[:-1] == _OTHER) & (k[1:] == _LETTER) & ~led[:-1] & (stop - run == 1)[:-1] & (code[run[:-1]] == 0x27) & ~fresh[run[1:]])
    if len(mark):
        at, end = run[mark + 1], stop[mark + 1]
        first = code[at]
        second = np.where(at + 1 < end, code[np.minimum(at + 1, n - 1)], 0)
        size = np.zeros(len(mark), np.int64)
        for s in _SUFFIXES:
            hit = (first == ord(s[0])) & ((second == ord(s[1])) if len(s) == 2 else True) & (size == 0)
            size[hit] = len(s)
        at, end, size = at[size > 0], end[size > 0], size[size > 0]
        start[at] = False
        more = at + size < end
        start[(at + size)[more]] = True
    return np.flatnonzero(start)


def replay(words: list[bytes], vocabulary: Vocabulary, rank_keys: np.ndarray, key_ranks: np.ndarray, rank_of: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words, end to end, and the offsets of each word in them.

    rank_keys: left * 2**32 + right of every merge, sorted; key_ranks: their ranks.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    tok = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    if n:
        nxt[ends[sizes > 0] - 1] = -1
        prv[(ends - sizes)[sizes > 0]] = -1
    buckets: list[list] = [[] for _ in range(len(vocabulary.left))]

    def enter(keys: np.ndarray, at: np.ndarray) -> None:
        """Put positions into the index under their pair's rank; pairs that never merge are left out."""
        i = np.minimum(np.searchsorted(rank_keys, keys), len(rank_keys) - 1)
        good = rank_keys[i] == keys
        if not good.any():
            return
        ranks, at = key_ranks[i[good]], at[good]
        if len(at) <= _FEW:
            for r, p in zip(ranks.tolist(), at.tolist()):
                buckets[r].append(p)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cut = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for r, lo, hi in zip(ranks[cut].tolist(), cut.tolist(), np.append(cut[1:], len(at)).tolist()):
            if hi - lo == 1:
                buckets[r].append(int(at[lo]))
            else:
                buckets[r].append(at[lo:hi])

    first = np.flatnonzero(nxt >= 0)
    enter((tok[first] << 32) | tok[first + 1], first)
    lefts, rights, results = vocabulary.left.tolist(), vocabulary.right.tolist(), vocabulary.result.tolist()
    for r, bucket in enumerate(buckets):
        if not bucket:
            continue
        buckets[r] = []
        a, b, c = lefts[r], rights[r], results[r]
        if len(bucket) <= _FEW and all(type(x) is int for x in bucket):
            done = []
            for p in sorted(set(bucket)):
                if tok[p] != a:
                    continue
                q = nxt[p]
                if q < 0 or tok[q] != b:
                    continue
                tok[p], tok[q] = c, -1
                after = nxt[q]
                nxt[p] = after
                if after >= 0:
                    prv[after] = p
                done.append(p)
            fresh = set()
            for p in done:
                if (after := int(nxt[p])) >= 0 and (k := rank_of.get((c << 32) | int(tok[after]))) is not None:
                    fresh.add((k, p))
                if (before := int(prv[p])) >= 0 and (k := rank_of.get((int(tok[before]) << 32) | c)) is not None:
                    fresh.add((k, before))
            for k, p in fresh:
                buckets[k].append(p)
            continue
        p = np.unique(np.concatenate([np.atleast_1d(x) for x in bucket]))
        p = p[tok[p] == a]
        q = nxt[p]
        good = q >= 0
        p, q = p[good], q[good]
        good = tok[q] == b
        p, q = p[good], q[good]
        if a == b and len(p) > 1:  # in a run of one token, every second pair from the left
            joined = np.r_[False, p[1:] == q[:-1]]
            lead = np.flatnonzero(~joined)
            place = np.arange(len(p)) - np.repeat(lead, np.diff(np.r_[lead, len(p)]))
            p, q = p[place % 2 == 0], q[place % 2 == 0]
        if not len(p):
            continue
        tok[p], tok[q] = c, -1
        after = nxt[q]
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        led = before >= 0
        keys = np.concatenate([(c << 32) | tok[after[has]], (tok[before[led]] << 32) | c])
        enter(keys, np.concatenate([p[has], before[led]]))
    alive = tok >= 0
    count = np.cumsum(np.r_[0, alive])
    return tok[alive].astype(np.int32), count[np.r_[0, ends]]


class Encoder:
    """Encodes texts block by block; words met before are not replayed again."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        keys = (vocabulary.left << 32) | vocabulary.right
        order = np.argsort(keys)
        self.rank_keys, self.key_ranks = keys[order], order
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.classes = _classes()
        self.slots: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.fresh: list[bytes] = []

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words of the texts, end to end, and the number of words of each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        starts = word_starts(code, (ends - sizes)[sizes > 0], self.classes)
        words_upto = np.searchsorted(starts, np.r_[0, ends])
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        byte_at = np.r_[0, np.cumsum(width)]
        blob = joined.encode("utf-8", "surrogatepass")
        lo = byte_at[starts]
        hi = np.append(lo[1:], len(blob))
        # equal words by a hash of their bytes, verified byte by byte
        raw = np.frombuffer(blob, np.uint8)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64))
            back = np.cumprod(np.full(len(raw), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64))
            value = np.cumsum(_SCATTER[raw] * power, dtype=np.uint64)
            total = value[hi - 1] - np.where(lo > 0, value[np.maximum(lo, 1) - 1], 0).astype(np.uint64)
            digest = total * back[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        _, which, word = np.unique(digest, return_index=True, return_inverse=True)
        same = np.array_equal(hi - lo, (hi - lo)[which][word])
        if same:
            shift = np.repeat(lo[which][word] - lo, hi - lo)
            same = bool((raw == raw[np.arange(len(raw)) + shift]).all())
        a, b = (lo[which].tolist(), hi[which].tolist()) if same else (lo.tolist(), hi.tolist())
        known = self.slots
        slot = np.empty(len(a), np.int64)
        for i, (x, y) in enumerate(zip(a, b)):
            w = blob[x:y]
            s = known.get(w)
            if s is None:
                s = known[w] = len(known)
                self.fresh.append(w)
            slot[i] = s
        return (slot[word] if same else slot), np.diff(words_upto)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and len(texts) + 1 offsets."""
        if len(self.slots) > _CACHE_WORDS:
            self.slots, self.flat, self.at = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        words, counts, lo = [], [], 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= _CHUNK_CHARS):
                chars += len(texts[hi])
                hi += 1
            w, c = self._chunk(texts[lo:hi])
            words.append(w)
            counts.append(c)
            lo = hi
        if self.fresh:
            ids, at = replay(self.fresh, self.vocabulary, self.rank_keys, self.key_ranks, self.rank_of)
            self.flat = np.concatenate([self.flat, ids])
            self.at = np.concatenate([self.at, at[1:] + self.at[-1]])
            self.fresh = []
        word = np.concatenate(words) if words else np.zeros(0, np.int64)
        size = self.at[word + 1] - self.at[word]
        upto = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(self.at[word] - upto[:-1], size) + np.arange(upto[-1])]
        text_ends = np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, np.int64)
        return ids, upto[np.r_[0, text_ends].astype(np.int64)]


_SCATTER = np.random.default_rng(20260101).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, ids: bool) -> DataFrame:
    """id and ids, or id and number of tokens, of each row."""
    v = Vocabulary.load(path)
    vocabulary = df.sparkSession.sparkContext.broadcast((v.of_byte, v.left, v.right, v.result))  # a few MB, as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*vocabulary.value))
        held: list[pa.RecordBatch] = []
        texts: list[str] = []
        chars = 0

        def block() -> Iterator[pa.RecordBatch]:
            flat, at = encoder.encode(texts)
            lo = 0
            for b in held:
                offsets = at[lo : lo + b.num_rows + 1]
                lo += b.num_rows
                if ids:
                    values = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(flat[offsets[0] : offsets[-1]]))
                else:
                    values = pa.array(np.diff(offsets).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), values], names=["id", "out"])

        for batch in batches:
            got = [t or "" for t in batch.column(1).to_pylist()]
            held.append(batch)
            texts += got
            chars += sum(map(len, got))
            if chars >= _BLOCK_CHARS:
                yield from block()
                held, texts, chars = [], [], 0
        if held:
            yield from block()

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, out {'array<int>' if ids else 'long'}")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids): the token ids of every row's whole text, without special tokens.

    Null and empty texts give an empty list; strings of special tokens in a text
    are ordinary text; repeated rows come out repeatedly; a null id stays. An
    empty table gives an empty result. One pass, no shuffle; extra columns are
    ignored.
    """
    return _encoded(df, id_col, text_col, path, True).select(F.col("id").alias(id_col), F.col("out").alias("ids"))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(id, tokens): the number of tokens of every row's whole text; 0 for null and empty texts."""
    return _encoded(df, id_col, text_col, path, False).select(F.col("id").alias(id_col), F.col("out").alias("tokens"))
