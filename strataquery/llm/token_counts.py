"""Edit-aware token counts (operator 1).

The state of a document is a segment tree over blocks of its pre-tokens: each
block's characters and tokens are leaves, each node holds the sums below it.
An edit descends to the block in front of it, tokenises from that block's
start until a piece ends where an untouched block began, replaces the leaves
between and adds the difference to the sums on the paths to the root. All
other blocks keep their counts unread.

Why it is exact: pieces are found from left to right without looking back, and
whether a piece ends at p depends on no character past p + 1, or past p plus
the length of an added token. So pieces that end further before an edit stand,
and from a point behind the edit where a piece starts in both texts, all later
pieces are the same.

With ``special``, the default, strings of added tokens are those tokens, as
operator 5 encodes them; without it they are ordinary text.

Edits are applied in order; each is (start, removed, inserted), in characters
of the text as the edits before it left it. Starts and lengths beyond the text
are clipped to it, negative ones are 0; a null start or removed is 0 and a
null inserted is empty. Null text counts as empty, null edits as none. Texts
of any length are handled: an edit costs the blocks that it touches and one
copy of the text. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.llm.bpe import ForcedCutBPE, coder, default_vocabulary
from strataquery.llm.common import arrow_udf, col

#: Pre-tokens of a block.
BLOCK = 64
TREE = "array<long>"
EDITS = "array<struct<start: long, removed: long, inserted: string>>"


class SegmentTree:
    """Sums of characters and tokens over the blocks of one text."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = max(1, len(chars))
        self.width = 1 << (self.leaves - 1).bit_length()
        self.chars = self._filled(chars)
        self.tokens = self._filled(tokens)

    def _filled(self, values: list[int]) -> list[int]:
        nodes = [0] * self.width + list(values) + [0] * (self.width - len(values))
        for i in range(self.width - 1, 0, -1):
            nodes[i] = nodes[2 * i] + nodes[2 * i + 1]
        return nodes

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The last leaf that starts at or before character ``at`` and has characters, and its start."""
        node, start = 1, 0
        while node < self.width:
            left = self.chars[2 * node]
            if at < start + left or self.chars[2 * node + 1] == 0:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.width, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node >>= 1

    def leaf_lists(self) -> tuple[list[int], list[int]]:
        low, high = self.width, self.width + self.leaves
        return self.chars[low:high], self.tokens[low:high]

    def packed(self) -> list[int]:
        return [self.leaves, *self.chars, *self.tokens]

    @classmethod
    def unpacked(cls, values: list[int]) -> SegmentTree:
        own = cls.__new__(cls)
        own.leaves = values[0]
        own.width = 1 << (own.leaves - 1).bit_length()
        own.chars, own.tokens = values[1 : 1 + 2 * own.width], values[1 + 2 * own.width :]
        return own


def build(text: str, own: ForcedCutBPE, special: bool = True) -> SegmentTree:
    """Tree of a whole text; the pieces of a long text are taken block by block."""
    chars, tokens = [], []
    pieces = own.pieces_from(text, 0, True) if special and own.has_added(text) else own.pieces(text)
    if isinstance(pieces, list):
        blocks = (pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK))
    else:
        blocks = iter(lambda: list(islice(pieces, BLOCK)), [])
    for block in blocks:
        chars.append(sum(map(len, block)))
        tokens.append(own.count(block))
    return SegmentTree(chars, tokens)


def edit(text: str, tree: SegmentTree, start: int, removed: int, inserted: str, own: ForcedCutBPE, special: bool = True) -> tuple[str, SegmentTree, int]:
    """Text and tree after one edit, and the characters that were encoded for it."""
    start = min(max(start, 0), len(text))
    end = min(start + max(removed, 0), len(text))
    new = text[:start] + inserted + text[end:]
    shift = len(new) - len(text)
    first, begin = tree.find(max(0, start - 2 - (own.longest_added if special else 0)))
    leaf, border = first, begin + tree.chars[tree.width + first]
    while border < end and leaf + 1 < tree.leaves:  # borders behind the edit are borders that may stand
        leaf += 1
        border += tree.chars[tree.width + leaf]
    pieces, at = [], begin
    for piece in own.pieces_from(new, begin, special):
        while at > border + shift and leaf + 1 < tree.leaves:
            leaf += 1
            border += tree.chars[tree.width + leaf]
        if at == border + shift and border >= end and (leaf + 1 < tree.leaves or at == len(new)):
            break
        pieces.append(piece)
        at += len(piece)
    while at > border + shift and leaf + 1 < tree.leaves:
        leaf += 1
        border += tree.chars[tree.width + leaf]
    blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
    sums = [(sum(map(len, b)), own.count(b)) for b in blocks]
    if len(sums) <= leaf - first + 1:  # the leaves do; those left over are empty
        for i in range(first, leaf + 1):
            tree.set(i, *(sums[i - first] if i - first < len(sums) else (0, 0)))
    else:
        chars, tokens = tree.leaf_lists()
        chars[first : leaf + 1], tokens[first : leaf + 1] = zip(*sums)
        tree = SegmentTree(chars, tokens)
    return new, tree, at - begin


def trees(text: Column, path: str | None = None, special: bool = True) -> Column:
    """Packed tree of each text: leaf count, character sums, token sums."""
    path = path or default_vocabulary()

    @arrow_udf(TREE)
    def make(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path)
        for part in parts:
            yield pa.array([build(x or "", own, special).packed() for x in part.to_pylist()], pa.list_(pa.int64()))

    return make(text)


def edited(text: Column, tree: Column, edits: Column, path: str | None = None, special: bool = True) -> Column:
    """Struct of the edited text, its tree, the tokens before, and the characters encoded for the edits.

    Where the tree is null it is built first.
    """
    path = path or default_vocabulary()

    @arrow_udf(f"struct<text: string, tree: {TREE}, tokens_before: long, encoded_chars: long>")
    def apply(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = coder(path)
        for texts, packed, changes in parts:
            out: list[list] = [[], [], [], []]
            for now, state, todo in zip(texts.to_pylist(), packed.to_pylist(), changes.to_pylist()):
                now, cost = now or "", 0
                state = build(now, own, special) if state is None else SegmentTree.unpacked(state)
                before = state.total
                for e in todo or []:
                    if e is not None:
                        now, state, chars = edit(now, state, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", own, special)
                        cost += chars
                for column, value in zip(out, (now, state.packed(), before, cost)):
                    column.append(value)
            kinds = (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["text", "tree", "tokens_before", "encoded_chars"])

    return apply(text, tree, edits)


def token_total(tree: Column) -> Column:
    """Tokens of a packed tree: the root of its token sums."""
    nodes = ((F.size(tree) - 1) / 2).cast("int")
    return F.get(tree, nodes + 2)


def with_trees(df: DataFrame, *, text: str = "text", into: str = "tree", path: str | None = None, special: bool = True) -> DataFrame:
    """``df`` with each text's tree; keep it beside the text to count later edits."""
    return df.withColumn(into, trees(col(text), path, special))


def apply_edits(df: DataFrame, edits: str, *, text: str = "text", tree: str | None = None, into: str = "edited", path: str | None = None, special: bool = True) -> DataFrame:
    """``df`` with the struct ``into`` of ``edited`` after the column ``edits``; without a tree column the trees are built first."""
    state = F.lit(None).cast(TREE) if tree is None else col(tree)
    return df.withColumn(into, edited(col(text), state, col(edits).cast(EDITS), path, special))
