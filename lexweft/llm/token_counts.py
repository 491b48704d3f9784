"""Edit-aware token counts: a segment tree over pre-tokens per document.

A leaf holds a block of pre-tokens (their lengths and token counts); inner nodes hold sums of characters,
pre-tokens and tokens. An edit re-splits only from two pre-tokens before it to the point where the new
boundaries meet the old ones again, re-encodes those, and updates the sums on the touched paths.

Trees are kept as a column beside the texts (``trees``), and ``update`` takes such a table and further edits; neither reads
nor encodes what edits don't touch.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)
BLOCK = 64
CACHE = 400_000


@lru_cache(maxsize=2)
def encoding(folder: str = TOKENIZERS) -> tiktoken.Encoding:
    with open(f"{folder}/{RANKS}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counts(dict):
    """Tokens of a pre-token; emptied when it grows past CACHE, so memory stays bounded."""

    def __init__(self, enc: tiktoken.Encoding):
        super().__init__()
        self.enc = enc

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = len(self.enc.encode_ordinary(piece))
        if len(piece) < 64:
            self[piece] = n
        return n


class TokenTree:
    """Counts tokens of a text and keeps them up to date under edits."""

    def __init__(self, text: str, counts: Counts):
        self.counts, self.encoded = counts, 0
        self._build(text)

    def _build(self, text: str) -> None:
        self.text = text
        pieces = SPLIT.findall(text)
        lengths = [len(p) for p in pieces]
        tokens = [*map(self.counts.__getitem__, pieces)]
        self.blocks = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(pieces), BLOCK)] or [([], [])]
        self._lay()

    def _lay(self) -> None:
        """The tree's sums from the blocks; nothing is encoded."""
        size = 1
        while size < len(self.blocks):
            size *= 2
        self.size = size
        self.sums = np.zeros((2 * size, 3), dtype=np.int64)
        for k, block in enumerate(self.blocks):
            self.sums[size + k] = self._of(block)
        level = size
        while level > 1:  # one vector addition for each level
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    def dump(self) -> bytes:
        """Blocks' sizes, and lengths and token counts of their pre-tokens, as little-endian 32-bit numbers."""
        sizes = [len(b[0]) for b in self.blocks]
        parts = [[len(sizes)], sizes, *[b[0] for b in self.blocks], *[b[1] for b in self.blocks]]
        return np.concatenate([np.asarray(p, dtype="<i4") for p in parts]).tobytes()

    @classmethod
    def load(cls, text: str, data: bytes, counts: Counts) -> TokenTree:
        """The tree of a text that ``dump`` gave."""
        out = cls.__new__(cls)
        out.text, out.counts, out.encoded = text, counts, 0
        numbers = np.frombuffer(data, dtype="<i4")
        sizes = numbers[1 : 1 + numbers[0]]
        lengths, tokens = (part.tolist() for part in np.split(numbers[1 + numbers[0] :], 2))
        if sum(lengths) != len(text):
            raise ValueError("a kept tree doesn't belong to its text")
        ends = np.cumsum(sizes).tolist()
        out.blocks = [(lengths[a:b], tokens[a:b]) for a, b in zip([0, *ends], ends)]  # noqa: B905
        out._lay()
        return out

    @staticmethod
    def _of(block: tuple[list[int], list[int]]) -> tuple[int, int, int]:
        return sum(block[0]), len(block[0]), sum(block[1])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 2])

    @property
    def n_pretokens(self) -> int:
        return int(self.sums[1, 1])

    def _locate(self, char: int) -> tuple[int, int, int]:
        """Block, index in it, and start of the pre-token that covers a character (the last one at the end)."""
        node, left = 1, 0
        while node < self.size:
            node *= 2
            if char >= left + self.sums[node, 0] and self.sums[node + 1, 0]:
                left += int(self.sums[node, 0])
                node += 1
        k = node - self.size
        lengths = self.blocks[k][0]
        for i, n in enumerate(lengths):
            if char < left + n or i == len(lengths) - 1:
                return k, i, left
            left += n
        return k, 0, left

    def _back(self, k: int, i: int, start: int, steps: int) -> tuple[int, int, int]:
        for _ in range(steps):
            if i == 0:
                j = k - 1
                while j >= 0 and not self.blocks[j][0]:
                    j -= 1
                if j < 0:
                    break
                k, i = j, len(self.blocks[j][0])
            i -= 1
            start -= self.blocks[k][0][i]
        return k, i, start

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replaces text[start:stop]; returns how many pre-tokens were encoded again."""
        text = self.text[:start] + new + self.text[stop:]
        if not self.n_pretokens or not text:
            self._build(text)
            self.encoded += self.n_pretokens
            return self.n_pretokens
        # A pre-token depends on the text up to two characters past its end, so two steps back are unaffected.
        k, i, at = self._back(*self._locate(max(0, start - 2)), 2)
        shift = len(new) - (stop - start)
        old_k, old_i, old_at = k, i, at
        lengths, tokens, here = [], [], at
        met = False
        for m in SPLIT.finditer(text, at):
            while old_at < here - shift or old_at < stop and old_k < len(self.blocks):  # the next old boundary at or after this one
                if old_k >= len(self.blocks):
                    break
                if old_i >= len(self.blocks[old_k][0]):
                    old_k, old_i = old_k + 1, 0
                    continue
                old_at += self.blocks[old_k][0][old_i]
                old_i += 1
            if here >= start + len(new) and old_at >= stop and old_at == here - shift:
                met = True
                break
            piece = m[0]
            lengths.append(len(piece))
            tokens.append(self.counts[piece])
            here = m.end()
        if not met:  # replaced up to the end
            old_k, old_i = len(self.blocks), 0
        self._replace(k, i, old_k, old_i, lengths, tokens)
        self.text = text
        self.encoded += len(lengths)
        if len(self.blocks[k][0]) > 4 * BLOCK:
            self._split(k)
        return len(lengths)

    def _replace(self, k: int, i: int, old_k: int, old_i: int, lengths: list[int], tokens: list[int]) -> None:
        tail = ([], [])
        touched = range(k, min(old_k + 1, len(self.blocks)))
        if old_k < len(self.blocks):
            own = self.blocks[old_k]
            tail = (own[0][old_i:], own[1][old_i:])
        head = self.blocks[k]
        merged = (head[0][:i] + lengths, head[1][:i] + tokens)
        for j in touched:
            self.blocks[j] = ([], [])
        if old_k == k:
            self.blocks[k] = (merged[0] + tail[0], merged[1] + tail[1])
        else:
            self.blocks[k] = merged
            if old_k < len(self.blocks):
                self.blocks[old_k] = tail
        for j in touched:
            self._update(j)

    def _update(self, k: int) -> None:
        node = self.size + k
        self.sums[node] = self._of(self.blocks[k])
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _split(self, k: int) -> None:
        """A block grown too large is cut; the tree is laid out anew from the blocks, nothing is encoded again."""
        lengths, tokens = self.blocks[k]
        self.blocks[k : k + 1] = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)]
        self._lay()


KIND = "array<struct<start:int,stop:int,new:string>>"


def trees(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text, tree (binary), n_tokens, n_pretokens of every whole text: a table to keep, and to ``update``.

    Null text counts as empty and gets a tree of none; it stays null. Repeated rows get equal trees, other columns aren't
    read, an empty table gives no rows.
    """

    def factory():
        counts = Counts(encoding(folder))

        def make(texts: list) -> dict[str, list]:
            made = [TokenTree(t or "", counts) for t in texts]
            return {"tree": [t.dump() for t in made], "n_tokens": [t.n_tokens for t in made], "n_pretokens": [t.n_pretokens for t in made]}

        return make

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return add_columns(own, "text", "tree binary, n_tokens long, n_pretokens long", factory, keep=True)


def update(kept: DataFrame, edits: str, folder: str = TOKENIZERS) -> DataFrame:
    """``kept`` (a table of ``trees``, with a column of edits) after the edits, with n_reencoded added.

    ``edits`` names a column array<struct<start:int, stop:int, new:string>> of replacements, applied in order, positions in
    characters of the text as it then is; it goes. text, tree, n_tokens and n_pretokens are those after the edits;
    n_reencoded counts pre-tokens encoded again. Positions outside the text are clamped; null edits are none, and leave a
    null text null. A null tree, as of documents that are new to the table, is built from the text; what that encodes
    counts as encoded again. Repeated rows are edited alike, texts are taken whole, an empty table gives no rows.
    """
    both = F.struct("text", "tree", F.col(edits).cast(KIND).alias("edits"))
    left = kept.withColumn("__lexweft_both", both).drop("text", "tree", "n_tokens", "n_pretokens", "n_reencoded", edits)

    def factory():
        counts = Counts(encoding(folder))

        def make(values: list) -> dict[str, list]:
            out: dict[str, list] = {"text": [], "tree": [], "n_tokens": [], "n_pretokens": [], "n_reencoded": []}
            for v in values:
                fresh = v["tree"] is None
                tree = TokenTree(v["text"] or "", counts) if fresh else TokenTree.load(v["text"] or "", v["tree"], counts)
                built = tree.n_pretokens if fresh else 0
                done = [e for e in v["edits"] or () if e is not None]
                for e in done:
                    start = min(max(0, e["start"] or 0), len(tree.text))
                    tree.edit(start, min(max(start, e["stop"] or 0), len(tree.text)), e["new"] or "")
                out["text"].append(tree.text if done else v["text"])
                out["tree"].append(tree.dump() if done or fresh else v["tree"])
                out["n_tokens"].append(tree.n_tokens)
                out["n_pretokens"].append(tree.n_pretokens)
                out["n_reencoded"].append(tree.encoded + built)
            return out

        return make

    return add_columns(left, "__lexweft_both", "text string, tree binary, n_tokens long, n_pretokens long, n_reencoded long", factory)


def count(docs: DataFrame, edits: str | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens, n_pretokens of every whole text; with edits also the counts after them.

    ``edits`` names a column array<struct<start:int, stop:int, new:string>> of replacements, applied in order,
    positions in characters of the text as it then is. After them: n_tokens_edited, n_reencoded (pre-tokens
    encoded again). Null text counts as empty: 0 tokens. Positions outside the text are clamped; null edits
    are none. Repeated rows are counted alike; an empty table gives no rows.
    """

    both = F.struct("text", (F.col(edits).cast(KIND) if edits else F.lit(None).cast(KIND)).alias("edits"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), both.alias("both"))

    def factory():
        counts = Counts(encoding(folder))

        def make(values: list) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "n_pretokens": [], "n_tokens_edited": [], "n_reencoded": []}
            for v in values:
                tree = TokenTree(v["text"] or "", counts)
                out["n_tokens"].append(tree.n_tokens)
                out["n_pretokens"].append(tree.n_pretokens)
                for e in v["edits"] or ():
                    if e is not None:
                        start = min(max(0, e["start"] or 0), len(tree.text))
                        tree.edit(start, min(max(start, e["stop"] or 0), len(tree.text)), e["new"] or "")
                out["n_tokens_edited"].append(tree.n_tokens)
                out["n_reencoded"].append(tree.encoded)
            return out

        return make

    out = add_columns(own, "both", "n_tokens long, n_pretokens long, n_tokens_edited long, n_reencoded long", factory)
    return out if edits else out.drop("n_tokens_edited", "n_reencoded")
