"""N-gram Jaccard join by PartEnum signatures, and the groups of documents that its links form.

A document is the set of its word shingles. Jaccard similarity of at least J bounds the size of the symmetric
difference by k = (1 - J) / (1 + J) * (|A| + |B|). Sets are put in bands of size. Within a band, and between
neighbouring bands, the shingle domain is cut into first-level parts, so many that in some of them two similar
sets differ in at most ``differences`` shingles; each is cut into ``subparts``, and all subsets of them that leave
out ``differences`` are enumerated: at least one holds no difference, and its projection is a signature that both
sets have. Empty projections say nothing; a set leaves them out while at most ``spare`` first-level parts have any,
which can't hide a pair as that many more parts are cut, and only sets with more of them sign those too.

Python sees Arrow batches of numpy arrays; what travels between stages are packed blocks, hashed by signature.
Sets are named by a hash of their content, so copies are one set from the start, and no pair of copies arises.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, made, partitions, scratch, sliced, tidied

#: Signature groups up to this size are compared in all pairs; larger ones with their first member, then, by
#: blocks of BLOCK members, only where members are not yet known to hang together.
SMALL = 8
BLOCK = 2048
#: Shingles whose signatures one group holds on average at most, some 16 MB: groups follow the input, whatever the
#: session's number of partitions.
PER_GROUP = 4_000_000
#: Rows that a Python stage works on at once.
CHUNK = 2000
NO_ID = -(2**63)
PRIME = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Join:
    """Shingles of ``n`` words; links at 100 * intersection >= ``percent`` * union.

    differences and subparts shape the second level of the signatures; results don't depend on them.
    """

    n: int = 5
    percent: int = 80
    differences: int = 1
    subparts: int = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as a text needs them."""

    size, up, down = 0, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(2 * cls.size, n, 1 << 16)
            both = []
            for base in (PRIME, pow(PRIME, -1, 1 << 64)):
                step = np.full(cls.size, base, dtype=np.uint64)
                step[0] = 1
                both.append(np.cumprod(step, dtype=np.uint64))
            cls.up, cls.down = both
        return cls.up, cls.down


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: n consecutive words, of fewer words the whole sequence.

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, with
    A-Z lower-cased. Null, empty and blank texts have none.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    low = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    up, down = _Powers.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    own = _mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    width = min(n, len(own))
    count = len(own) - width + 1
    out = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(PRIME) + own[i : i + count])
    return np.unique(out)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bins(n: int) -> int:
    """Bins of the sketch of a set of n shingles: the power of two that holds two to four of them each."""
    return 1 << max(4, (max(n, 1) - 1).bit_length() - 2)


def sketch(s: np.ndarray) -> bytes:
    """Counts of hashes by their leading bits, up to 255 each.

    The sum of bin differences of two sets never exceeds their symmetric difference, at whatever number of bins
    they are compared; so pairs too far apart are told without their sets.
    """
    n = bins(len(s))
    return np.minimum(np.bincount((s >> np.uint64(65 - n.bit_length())).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def folded(sk: bytes, n: int) -> np.ndarray:
    """A sketch at fewer bins."""
    return np.frombuffer(sk, dtype=np.uint8).reshape(n, -1).sum(axis=1, dtype=np.int32)


class PartEnum:
    """Signatures of a join's sets."""

    def __init__(self, join: Join):
        self.join, self.j = join, join.percent / 100
        self.ratio = self.j**-2
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, math.floor(self.lows[-1] * self.ratio) + 1))
        chosen = [*itertools.combinations(range(join.subparts), join.subparts - join.differences)]
        self.subsets = np.array([[i in c for c in chosen] for i in range(join.subparts)], dtype=np.float64)

    @lru_cache(maxsize=None)  # noqa: B019 - one instance lives as long as its worker
    def parts(self, largest: int, smallest: int) -> tuple[int, int]:
        """(first-level parts, spare) for pairs whose sizes sum up to ``largest`` at most; no parts if none can link.

        Spare parts are as many as a set of the ``smallest`` size will seldom have with an empty projection; fewer
        would do too.
        """
        k = math.floor((100 - self.join.percent) * largest / (100 + self.join.percent))
        if k == 0:  # such sets link only if they are equal, and then they are one set
            return 0, 0
        share = 1 - self.join.differences / self.join.subparts
        spare = 0
        while True:
            n = k // (self.join.differences + 1) + 1 + spare
            empty = n * min(1, self.subsets.shape[1] * math.exp(-share * smallest / n))
            if empty + 2 * math.sqrt(empty) <= spare or spare >= k + 4:
                return n, spare
            spare += 1

    def tags(self, size: int) -> list[tuple[int, int, int]]:
        """(tag, parts, spare) under which a set of this size is signed: its band, and the borders in reach."""
        band = int(np.searchsorted(self.lows, size, side="right")) - 1
        low, high = self.lows[band], self.lows[band + 1] - 1
        out = [(2 * band, *self.parts(2 * high, low))]
        for border, near in ((band, size * self.j <= low - 1), (band + 1, size >= self.j * (high + 1))):
            if near and border:
                below = self.lows[border] - 1  # the largest set below the border; its partner has at most below / J
                out.append((2 * border - 1, *self.parts(below + math.floor(below / self.j), max(1, math.floor(below * self.j)))))
        return [t for t in out if t[1]]

    def sign(self, s: np.ndarray) -> np.ndarray:
        """The signatures of a set."""
        out = []
        for tag, parts, spare in self.tags(len(s)):
            salt = np.uint64((tag * 2 + 1) * PRIME & (1 << 64) - 1)
            n = parts * self.join.subparts
            part = ((_mix(s + salt) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            # Counts and sums of halves (exact in doubles) by subpart, then by enumerated subset.
            held, low, high = (
                np.bincount(part, weights=w, minlength=n).reshape(parts, -1) @ self.subsets
                for w in (None, (s & np.uint64(0xFFFFFFFF)).astype(np.float64), (s >> np.uint64(32)).astype(np.float64))
            )
            place = np.arange(held.size, dtype=np.uint64).reshape(held.shape) << np.uint64(40)
            own = _mix(_mix(low.astype(np.uint64) + salt) * np.uint64(PRIME) + high.astype(np.uint64) + place + salt)
            out.append(own.ravel() if (held == 0).any(axis=1).sum() > spare else own[held > 0])
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _blocks(key: np.ndarray, n: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows dealt by key modulo n, as packed columns."""
    to = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ends = np.cumsum(np.bincount(to, minlength=n))
    columns = [c[order] for c in columns]
    start = 0
    for p, stop in enumerate(ends.tolist()):
        if stop > start:
            yield p, [b"".join(c[start:stop]) if c.dtype == object else c[start:stop].tobytes() for c in columns]
        start = stop


def _sketches(packed: pd.Series, sizes: pd.Series) -> np.ndarray:
    """Unpacks sketches, whose lengths follow from the sets' sizes."""
    data, size = b"".join(packed), np.frombuffer(b"".join(sizes), dtype=np.int64)
    ends = np.cumsum([bins(n) for n in size.tolist()]).tolist()
    out = np.empty(len(size), dtype=object)
    for i, (start, stop) in enumerate(zip([0, *ends], ends)):  # noqa: B905
        out[i] = data[start:stop]
    return out


def describe(docs: DataFrame, join: Join) -> DataFrame:
    """did, th (hash of the text), sid (null for an empty set), n, sketch of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, CHUNK):
            sets = [shingles(t, join.n) for t in batch["text"]]
            sid = pd.array([set_id(s) if len(s) else None for s in sets], dtype="Int64")
            yield pd.DataFrame({"did": batch["did"], "th": batch["th"], "sid": sid, "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets]})

    return _keyed(docs).mapInPandas(tidied(run), "did long, th long, sid long, n long, sketch binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")


def _signed(docs: DataFrame, join: Join, n: int) -> DataFrame:
    """Packed (signature, set) records, dealt into n groups by signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme = PartEnum(join)
        for batch in sliced(batches, CHUNK):
            signs, sids = [], []
            seen: set[int] = set()
            for text in batch["text"]:
                s = shingles(text, join.n)
                if len(s) and (sid := set_id(s)) not in seen:
                    seen.add(sid)
                    signs.append(scheme.sign(s))
                    sids.append(np.full(len(signs[-1]), sid, dtype=np.int64))
            if signs:
                sign, sid = np.concatenate(signs), np.concatenate(sids)
                short = (sign >> np.uint64(32)).astype(np.uint32)
                rows = [*_blocks(sign & np.uint64(0xFFFFFFFF), n, [short, sid])]
                yield pd.DataFrame({"p": [p for p, _ in rows], "sign": [c[0] for _, c in rows], "sid": [c[1] for _, c in rows]})

    return docs.select("text").mapInPandas(tidied(run), "p int, sign binary, sid binary")


def _candidates(signed: DataFrame) -> DataFrame:
    """From each group: pairs (a < b) of sets to compare, and lists of the sets that share a signature of many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [*batches]
        sign = np.frombuffer(b"".join(x for f in frames for x in f["sign"]), dtype=np.uint32)
        sid = np.frombuffer(b"".join(x for f in frames for x in f["sid"]), dtype=np.int64)
        del frames
        order = np.lexsort((sid, sign))
        sign, sid = sign[order], sid[order]
        new = np.ones(len(sign), dtype=bool)
        new[1:] = (sign[1:] != sign[:-1]) | (sid[1:] != sid[:-1])
        sign, sid = sign[new], sid[new]
        first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
        size = np.diff(np.append(first, len(sign)))
        left, right = [], []
        for m in range(2, SMALL + 1):
            at = first[size == m]
            for i in range(m):
                for j in range(i + 1, m):
                    left.append(sid[at + i])
                    right.append(sid[at + j])
        large = [sid[at : at + m] for at, m in zip(first[size > SMALL], size[size > SMALL], strict=True)]
        for own in large:
            left.append(np.full(len(own) - 1, own[0]))
            right.append(own[1:])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0) if left else np.empty((0, 2), dtype=np.int64)
        yield pd.DataFrame({"a": [pairs[:, 0].tobytes()], "b": [pairs[:, 1].tobytes()]})
        # Lists go out a few at a time, so that a very large group's aren't held together.
        seen: set[int] = set()
        held: list[bytes] = []
        for own in large:
            cuts = [own[i : i + BLOCK] for i in range(0, len(own), BLOCK)]
            for i, x in enumerate(cuts):
                for y in cuts[i + 1 :] or [None] * (len(cuts) == 1):
                    both = (x if y is None else np.concatenate([x, y])).tobytes()
                    if (name := xxhash.xxh3_64_intdigest(both)) not in seen:
                        seen.add(name)
                        held.append(both)
                        if len(held) == CHUNK // 10:
                            yield pd.DataFrame({"a": [b""] * len(held), "b": held})
                            held = []
        if held:
            yield pd.DataFrame({"a": [b""] * len(held), "b": held})

    return signed.groupBy("p").applyInPandas(run, "a binary, b binary")


def _pairs(packed: DataFrame, n: int) -> DataFrame:
    """Distinct pairs of packed columns a, b: dealt by pair and made distinct while packed."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), dtype=np.int64) for c in ("a", "b"))
            rows = [*_blocks(_mix(a.view(np.uint64) * np.uint64(3) + b.view(np.uint64)), n, [a, b])]
            yield pd.DataFrame({"p": [p for p, _ in rows], "a": [c[0] for _, c in rows], "b": [c[1] for _, c in rows]})

    def distinct(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = np.stack([np.frombuffer(b"".join(frame[c]), dtype=np.int64) for c in ("a", "b")], axis=1)
        pairs = np.unique(pairs, axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = packed.where("length(a) > 0").mapInPandas(tidied(deal), "p int, a binary, b binary")
    return dealt.groupBy("p").applyInPandas(distinct, "a long, b long")


def _members(packed: DataFrame) -> DataFrame:
    """Distinct members of the lists of common signatures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"sid": np.unique(np.frombuffer(b"".join(batch["b"]), dtype=np.int64))})

    return packed.where("length(a) = 0").select("b").mapInPandas(tidied(run), "sid long")


def _possible(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    both = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {join.percent} * greatest(na, nb)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = []
            for na, nb, ka, kb in zip(batch["na"], batch["nb"], batch["ka"], batch["kb"], strict=True):
                n = min(len(ka), len(kb))
                near.append(np.abs(folded(ka, n) - folded(kb, n)).sum() <= (100 - join.percent) * (na + nb) // (100 + join.percent))
            yield batch.loc[near, ["a", "b"]]

    return both.select("a", "b", "na", "nb", "ka", "kb").mapInPandas(tidied(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The pairs that link, by their whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}

        def of(sid: int, text: str) -> np.ndarray:
            if sid not in kept:
                if len(kept) > 200:
                    kept.clear()
                kept[sid] = shingles(text, join.n)
            return kept[sid]

        for batch in batches:
            good = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= join.percent * (len(x) + len(y) - both))
            yield batch.loc[good, ["a", "b"]]

    one = texts.select(F.col("sid").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInPandas(tidied(run), "a long, b long")


def components(edges: DataFrame, tag: str = "labels") -> DataFrame:
    """(node, comp): the least node that each node of the edges (a, b) reaches.

    Labels start as least neighbours; each round takes the least label around and jumps to its label's label. Edges may
    stand several times and in either direction; rows with a null end join nothing; no edges give no rows.
    """
    full = edges.where("a is not null and b is not null")
    both = scratch(full.select("a", "b").union(full.select("b", "a")).distinct(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), tag)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), "comp")
        target = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = scratch(moved.join(target, "next").select("node", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("changed")), tag)
        labels = moved.select("node", "comp")
        if moved.where("changed").limit(1).isEmpty():
            return labels


def _across(packed: DataFrame, sets: DataFrame, comps: DataFrame, join: Join, n: int, nearest: bool) -> DataFrame:
    """Pairs within the lists of common signatures whose members aren't in one component of ``comps`` and may link.

    nearest: of each two components in a list, only the pair whose sketches differ least.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lists = [np.frombuffer(own, dtype=np.int64) for own in batch["b"]]
                lid = np.repeat([xxhash.xxh3_64_intdigest(own) - (1 << 63) for own in batch["b"]], [*map(len, lists)])
                sid = np.concatenate(lists)
                rows = [*_blocks(sid.view(np.uint64), n, [lid, sid])]
                yield pd.DataFrame({"p": [p for p, _ in rows], "lid": [c[0] for _, c in rows], "sid": [c[1] for _, c in rows], "comp": None, "n": None, "sketch": None})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sid, comp, size = (batch[c].to_numpy(dtype=np.int64) for c in ("sid", "comp", "n"))
                sk = batch["sketch"].to_numpy()
                rows = [*_blocks(sid.view(np.uint64), n, [sid, comp, size, sk])]
                yield pd.DataFrame({"p": [p for p, _ in rows], "lid": None, **{name: [c[i] for _, c in rows] for i, name in enumerate(("sid", "comp", "n", "sketch"))}})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        known, asked = frame[frame["lid"].isna()], frame[frame["lid"].notna()]
        if asked.empty or known.empty:
            return pd.DataFrame({"p": [], "lid": [], "sid": [], "comp": [], "n": [], "sketch": []})
        ids = np.frombuffer(b"".join(known["sid"]), dtype=np.int64)
        order = np.argsort(ids)
        comp, size = (np.frombuffer(b"".join(known[c]), dtype=np.int64)[order] for c in ("comp", "n"))
        sk = _sketches(known["sketch"], known["n"])[order]
        lid, sid = (np.frombuffer(b"".join(asked[c]), dtype=np.int64) for c in ("lid", "sid"))
        at = np.searchsorted(ids[order], sid)
        rows = [*_blocks(lid.view(np.uint64) >> np.uint64(8), n, [lid, sid, comp[at], size[at], sk[at]])]
        return pd.DataFrame({"p": [p for p, _ in rows], **{name: [c[i] for _, c in rows] for i, name in enumerate(("lid", "sid", "comp", "n", "sketch"))}})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        lid, sid, comp, size = (np.frombuffer(b"".join(frame[c]), dtype=np.int64) for c in ("lid", "sid", "comp", "n"))
        sk = _sketches(frame["sketch"], frame["n"])
        left, right, apart = [], [], []
        order = np.argsort(lid, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lid[order])) + 1):
            if (comp[own] == comp[own[0]]).all():
                continue
            own = own[np.argsort(size[own], kind="stable")]
            least = min(map(len, sk[own]))
            matrix = np.stack([folded(sk[m], least) for m in own])
            stops = np.searchsorted(size[own], size[own] * 100 // join.percent, side="right")
            for i, x in enumerate(own[:-1]):
                at = i + 1 + np.flatnonzero(comp[own[i + 1 : stops[i]]] != comp[x])
                far = np.abs(matrix[at] - matrix[i]).sum(axis=1)
                near = far <= (100 - join.percent) * (size[x] + size[own[at]]) // (100 + join.percent)
                rest = own[at[near]]
                left.append(np.full(len(rest), x))
                right.append(rest)
                apart.append(far[near] / (size[x] + size[rest]))
        left, right, apart = (np.concatenate(v) if v else np.empty(0, dtype=kind) for v, kind in ((left, np.int64), (right, np.int64), (apart, np.float64)))
        if nearest and len(left):
            low, high = np.minimum(comp[left], comp[right]), np.maximum(comp[left], comp[right])
            order = np.lexsort((apart, high, low, lid[left]))
            key = np.stack([lid[left], low, high])[:, order]
            order = order[np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])]
            left, right = left[order], right[order]
        pairs = np.unique(np.stack([np.minimum(sid[left], sid[right]), np.maximum(sid[left], sid[right])], axis=1), axis=0)
        return pd.DataFrame({"a": [pairs[:, 0].tobytes()], "b": [pairs[:, 1].tobytes()]})

    packing = "p int, lid binary, sid binary, comp binary, n binary, sketch binary"
    lists = packed.where("length(a) = 0").select("b").distinct().mapInPandas(tidied(spread), packing)
    joined = sets.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("comp", "sid").alias("comp"), "n", "sketch")
    known = joined.mapInPandas(tidied(pack), packing)
    return _pairs(lists.unionByName(known).groupBy("p").applyInPandas(meet, packing).groupBy("p").applyInPandas(compare, "a binary, b binary"), n)


def groups(docs: DataFrame, join: Join, count: bool = False) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least doc_id reachable by links) and n_linked of every row.

    n_linked: how many other distinct sets the document's set links with; null unless ``count``, as components need
    only pairs that aren't connected yet, and a count all pairs of large groups that sketches allow. Documents without words are alone. Null doc_ids take
    part but don't name a component unless all in it are null. Repeated rows and equal texts are in one
    component. Texts are shingled whole, however long. Other columns aren't read. An empty table gives no rows.
    """
    spark, before = docs.sparkSession, made()
    rows = scratch(describe(docs, join), "sets")
    held = rows.where("sid is not null")
    sets = scratch(held.groupBy("sid").agg(F.min(F.struct(F.col("did") == NO_ID, "did", "th")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("sid", "n", "sketch", "rep.did", "rep.th"), "distinct-sets")
    dealt = max(2 * partitions(spark), (sets.agg(F.sum("n")).first()[0] or 0) // PER_GROUP)
    packed = scratch(_candidates(_signed(docs, join, dealt)), "candidates")
    slim = sets.select("sid", "n", "sketch")

    # One fetch of the texts that either round may need.
    pairs = scratch(_possible(_pairs(packed, dealt), slim, join), "pairs")
    needed = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(_members(packed)).distinct()
    where = sets.select("sid", "did", "th").join(needed, "sid", "left_semi")
    texts = scratch(_keyed(docs).join(where, ["did", "th"]).select("sid", "text").dropDuplicates(["sid"]), "texts")
    links = scratch(_verified(pairs, texts, join), "links")
    comps = components(links)
    for nearest in (True, False):  # the likeliest pairs first, as they connect most of what is left
        more = scratch(_across(packed, slim, comps, join, dealt // 2, nearest), "across")
        if more.limit(1).isEmpty():
            break
        extra = scratch(_verified(more, texts, join), "more-links")
        if not extra.limit(1).isEmpty():
            links = scratch(links.union(extra).distinct(), "links")
            comps = components(links)
    if count:  # no set is connected with another, so that every pair is compared
        more = scratch(_across(packed, slim, comps.where("false"), join, dealt // 2, False).join(links, ["a", "b"], "left_anti"), "across")
        links = scratch(links.union(_verified(more, texts, join)).distinct(), "links")
    degree = links.select(F.col("a").alias("sid")).union(links.select("b")).groupBy("sid").agg(F.count("*").alias("n_linked"))
    named = sets.select("sid", F.when(F.col("did") != NO_ID, F.col("did")).alias("did")).join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = named.groupBy("comp").agg(F.min("did").alias("component_id"))
    named = scratch(named.join(least, "comp").join(degree, "sid", "left").select("sid", "component_id", F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "named")
    discard(before, rows, named)
    own = F.when(F.col("did") != NO_ID, F.col("did"))
    out = rows.join(named, "sid", "left")
    return out.select(own.alias("doc_id"), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), own).otherwise(F.col("component_id")).alias("component_id"), (F.coalesce("n_linked", F.lit(0)) if count else F.lit(None).cast("long")).alias("n_linked"))


def keep_one(docs: DataFrame, join: Join) -> DataFrame:
    """``docs``, all columns kept, with one document of each group: the one with the group's least doc_id.

    Documents without words stay. Of rows with that doc_id and different texts, all in the group, the one with
    the smaller text hash stays; rows equal in doc_id and text stay or go together. A group of null doc_ids only
    keeps its rows of the smallest text hash. Null and empty texts have no words. Texts are compared whole, however long;
    all columns pass through, whatever their names; an empty table gives no rows.
    """
    did, th = "__lexweft_did", "__lexweft_th"
    found = groups(docs, join).where("n_shingles > 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(did), F.col("text_hash").alias(th), F.coalesce("component_id", F.lit(NO_ID)).alias("comp")).distinct()
    best = found.where(F.col(did) == F.col("comp")).groupBy(did).agg(F.min(th).alias("best"))
    gone = found.join(best, did, "left").where((F.col(did) != F.col("comp")) | ((F.col(th) != F.col("best")) & (F.col(did) != NO_ID))).select(did, th)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.join(gone, (own == F.col(did)) & (F.xxhash64("text") == F.col(th)), "left_anti")
