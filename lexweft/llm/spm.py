"""SentencePiece encoding and decoding in batched numpy, from the model file alone.

Equal-length words advance together: their characters form a matrix, prefix sums of powers give the hash of
every substring, and substring hashes probe the sorted keys of the pieces. Unigram models take the Viterbi
path: for each end position vectorised maxima over piece lengths, with backpointers. BPE models are defined by
merge order, which no best-path sum reproduces; there each round merges, in all words at once, the adjacent
pair whose joined substring has the best score. Spaces bound words, as no piece holds one inside.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE = 200_000
#: Words beyond this many characters are merged one by one with a heap.
LONG = 1024
CHUNK = 1_000_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i, value, shift = i + 1, value | (c & 127) << shift, shift + 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = (4, i) if key & 7 == 5 else (8, i) if key & 7 == 1 else _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


@dataclass
class Model:
    """Pieces with scores and kinds, and what the model file says on segmentation and normalisation."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int = BPE
    prefix: bool = True
    squeeze: bool = False
    byte_fallback: bool = True
    cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER) and self.pieces[i]]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece holds a space after other characters; words can't be encoded alone")
        keys = np.array([_hash(self.pieces[i]) for i in usable], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, dtype=np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.cost = -np.array(self.scores, dtype=np.float64)[self.ids]
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.worst = float(max(self.cost)) + 10.0  # cost of an unknown character on a best path
        alone = "".join(c for c in "\n\t\r" if not any(c in self.pieces[i] and len(self.pieces[i]) > 1 for i in usable))
        stop = re.escape(alone)
        self.split = re.compile(rf"[{stop}]|{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+" if alone else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Index among the sorted keys of each hash, -1 where no piece has it."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Model:
    """Reads a model file; raises for normalisation rules other than identity."""
    pieces, scores, kinds, more = [], [], [], {}
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            own = dict(_fields(value))
            more |= {"algorithm": own.get(3, UNIGRAM), "byte_fallback": bool(own.get(35, 0))}
        elif number == 3:
            own = dict(_fields(value))
            if own.get(2):
                raise ValueError("only models with identity normalisation are supported")
            more |= {"prefix": bool(own.get(3, 1)), "squeeze": bool(own.get(4, 1))}
    return Model(pieces, scores, kinds, **more)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, length).astype(np.uint64)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each prefix: h(x + c) = (h(x) + mixed c) * BASE, modulo 2**64."""
    n, length = codes.shape
    mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros((n, length + 1), dtype=np.uint64)
    for j in range(length):
        out[:, j + 1] = (out[:, j] + mixed[:, j]) * BASE
    return out


@lru_cache(maxsize=1)
def _powers(n: int = 1 << 12) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, dtype=np.uint64)]), dtype=np.uint64)


def _span(prefix: np.ndarray, rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of substrings [start, stop) of the rows' words."""
    return prefix[rows, stop] - prefix[rows, start] * _powers()[stop - start]


def _hash(piece: str) -> int:
    with np.errstate(over="ignore"):
        return int(_prefix_hashes(_codes([piece], len(piece)))[0, -1])


def _bpe(model: Model, prefix: np.ndarray, length: int) -> list[np.ndarray]:
    """Final boundaries of each of the equal-length words."""
    n = len(prefix)
    done: list[np.ndarray | None] = [None] * n
    rows = np.arange(n)
    cuts = np.tile(np.arange(length + 1, dtype=np.int64), (n, 1))

    def costs(r: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        at = np.full(len(r), -1)
        short = stop - start <= model.longest
        at[short] = model.probe(_span(prefix, r[short], start[short], stop[short]))
        return np.where(at >= 0, model.cost[at], np.inf)

    pairs = length - 1
    cost = costs(np.repeat(rows, pairs), cuts[:, :-2].ravel(), cuts[:, 2:].ravel()).reshape(n, pairs) if pairs else np.empty((n, 0))
    while len(rows):
        best = cost.argmin(axis=1) if cost.shape[1] else np.zeros(len(rows), dtype=np.int64)
        live = cost[np.arange(len(rows)), best] < np.inf if cost.shape[1] else np.zeros(len(rows), dtype=bool)
        for r, c in zip(rows[~live], cuts[~live], strict=True):
            done[r] = c
        rows, cuts, cost, best = rows[live], cuts[live], cost[live], best[live]
        if not len(rows):
            break
        kept = np.arange(cuts.shape[1] - 1)[None, :]
        cuts = np.where(kept <= best[:, None], cuts[:, :-1], cuts[:, 1:])  # the boundary after best goes
        kept = np.arange(cost.shape[1] - 1)[None, :]
        cost = np.where(kept < best[:, None], cost[:, :-1], cost[:, 1:])
        each = np.arange(len(rows))
        for at in (best - 1, best):  # the pairs on both sides of what was merged
            near = (at >= 0) & (at < cost.shape[1])
            r, a = each[near], at[near]
            cost[r, a] = costs(rows[near], cuts[r, a], cuts[r, a + 2])
    return done


def _viterbi(model: Model, prefix: np.ndarray, length: int) -> list[np.ndarray]:
    """Boundaries of the cheapest segmentation; of equal ones the one with the longest last piece."""
    n = len(prefix)
    best = np.full((n, length + 1), np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), dtype=np.int64)
    rows = np.arange(n)
    for stop in range(1, length + 1):
        for start in range(max(0, stop - model.longest), stop):
            at = model.probe(prefix[:, stop] - prefix[:, start] * _powers()[stop - start])
            cost = np.where(at >= 0, model.cost[at], model.worst if stop - start == 1 else np.inf) + best[:, start]
            better = cost < best[:, stop]
            best[better, stop] = cost[better]
            back[better, stop] = start
    out = []
    for r in rows:
        cuts = [length]
        while cuts[-1]:
            cuts.append(int(back[r, cuts[-1]]))
        out.append(np.array(cuts[::-1]))
    return out


def _heap_merge(model: Model, word: str) -> list[str]:
    """BPE of one long word; the same merges as ``_bpe``, from a heap."""
    if "table" not in model.cache:
        model.cache["table"] = {model.pieces[i]: float(c) for i, c in zip(model.ids, model.cost, strict=True)}
    table, parts = model.cache["table"], [*word]
    after, before, heap = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)], []

    def push(i: int) -> None:
        if 0 <= i and after[i] < len(parts) and (cost := table.get(joined := parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (cost, i, joined))

    for i in range(len(parts) - 1):
        push(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if not parts[i] or after[i] >= len(parts) or parts[i] + parts[after[i]] != joined:
            continue
        j = after[i]
        parts[i], parts[j], after[i] = joined, "", after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        push(before[i])
        push(i)
    return [p for p in parts if p]


def _long_path(model: Model, word: str) -> list[str]:
    """The cheapest segmentation of one long word; the same path as ``_viterbi``'s."""
    if "table" not in model.cache:
        model.cache["table"] = {model.pieces[i]: float(c) for i, c in zip(model.ids, model.cost, strict=True)}
    table, n = model.cache["table"], len(word)
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for stop in range(1, n + 1):
        for start in range(max(0, stop - model.longest), stop):
            cost = table.get(word[start:stop], model.worst if stop - start == 1 else float("inf")) + best[start]
            if cost < best[stop]:
                best[stop], back[stop] = cost, start
    parts, stop = [], n
    while stop:
        parts.append(word[back[stop] : stop])
        stop = back[stop]
    return parts[::-1]


def encode_words(model: Model, words: list[str]) -> dict[str, bytes]:
    """Ids of words, as little-endian 32-bit numbers."""
    groups: dict[int, list[str]] = {}
    out: dict[str, bytes] = {}
    spans: list[tuple[str, list[str]]] = []
    for w in words:
        if len(w) > LONG:
            spans.append((w, (_heap_merge if model.algorithm == BPE else _long_path)(model, w)))
        else:
            groups.setdefault(len(w), []).append(w)
    if "ids" not in model.cache:
        model.cache["ids"] = {model.pieces[i]: struct.pack("<i", i) for i in model.ids}
    ids = model.cache["ids"]
    step = _viterbi if model.algorithm == UNIGRAM else _bpe
    for length, group in groups.items():
        with np.errstate(over="ignore"):
            cuts = step(model, _prefix_hashes(_codes(group, length)), length)
        for w, c in zip(group, cuts, strict=True):
            c = c.tolist()
            spans.append((w, [w[a:b] for a, b in zip(c, c[1:])]))  # noqa: B905
    for w, parts in spans:
        out[w] = b"".join([ids.get(p) or _fallback(model, p) for p in parts])
    return out


def _fallback(model: Model, part: str) -> bytes:
    if model.byte_fallback and model.bytes:
        return b"".join(struct.pack("<i", model.bytes[b]) for b in part.encode("utf-8", "replace"))
    return struct.pack("<i", model.unknown)


def normalise(model: Model, text: str) -> str:
    if model.squeeze:
        text = re.sub(" +", " ", text).strip(" ")
    return (SPACE if model.prefix and text else "") + text.replace(" ", SPACE)


def encode_batch(model: Model, texts: list[str | None], words: dict[str, bytes] | None = None) -> list[bytes]:
    """Ids of whole texts, as little-endian 32-bit numbers. ``words`` keeps words seen before, up to CACHE."""
    words = {} if words is None else words
    out: list[bytes] = []
    chunk: list[list[str]] = []
    size = 0

    def flush() -> None:
        if new := {w for own in chunk for w in own if w not in words}:
            if len(words) + len(new) > CACHE:
                words.clear()
                new = {w for own in chunk for w in own}
            words.update(encode_words(model, [*new]))
        out.extend(b"".join(map(words.__getitem__, own)) for own in chunk)
        chunk.clear()

    for text in texts:
        chunk.append(model.split.findall(normalise(model, text or "")))
        size += len(text or "")
        if size > CHUNK:
            flush()
            size = 0
    flush()
    return out


def decode_batch(model: Model, encoded: list[bytes]) -> list[str]:
    """Texts of ids; the space put before a text is taken off again. Broken UTF-8 becomes U+FFFD."""
    table = model.out
    texts = (b"".join([table[i] for i in np.frombuffer(b, dtype="<i4").tolist()]).decode("utf-8", "replace") for b in encoded)
    return [t[1:] if model.prefix and t[:1] == " " else t for t in texts]


def encode(docs: DataFrame, path: str = MODEL, column: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out`` array<int>, the ids of ``column``. Null text: null ids; empty text: no ids.

    All other columns pass through, whatever their names; an existing ``out`` is replaced. Repeated rows are
    encoded alike; an empty table gives no rows. Texts are encoded whole, however long.
    """

    def factory():
        model, words = load(path), {}
        return lambda texts: {out: [None if t is None else np.frombuffer(b, dtype="<i4") for t, b in zip(texts, encode_batch(model, texts, words), strict=True)]}

    return add_columns(docs.drop(out), column, f"`{out}` array<int>", factory, keep=True)


def decode(frame: DataFrame, path: str = MODEL, column: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``, the text of the ids in ``column``; null ids give null, no ids an empty text.

    An existing ``out`` is replaced, other columns pass through. Repeated rows are decoded alike, however many ids they
    have; an empty table gives no rows.
    """

    def factory():
        model = load(path)

        def make(ids: list) -> dict[str, list]:
            texts = decode_batch(model, [np.asarray([] if i is None else i, dtype="<i4").tobytes() for i in ids])
            return {out: [None if i is None else t for i, t in zip(ids, texts, strict=True)]}

        return make

    return add_columns(frame.drop(out), column, f"`{out}` string", factory, keep=True)


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), decoded_crc32 and round_trip.

    Every whole text is encoded and decoded; round_trip: the decoded text is the text. Null text: null checksums
    and round_trip, no tokens; empty text: no tokens, checksums of nothing. Repeated rows give equal rows, other columns
    aren't read, an empty table gives no rows.
    """

    def factory():
        model, words = load(path), {}

        def make(texts: list) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids_crc32": [], "decoded_crc32": [], "round_trip": []}
            for lo in range(0, len(texts), 1000):
                part = texts[lo : lo + 1000]
                ids = encode_batch(model, part, words)
                for t, b, back in zip(part, ids, decode_batch(model, ids), strict=True):
                    null = t is None
                    out["n_tokens"].append(len(b) // 4)
                    out["ids_crc32"].append(None if null else zlib.crc32(b))
                    out["decoded_crc32"].append(None if null else zlib.crc32(back.encode()))
                    out["round_trip"].append(None if null else t == back)
            return out

        return make

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return add_columns(own, "text", "n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean", factory)
