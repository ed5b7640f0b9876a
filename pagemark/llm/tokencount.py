"""Edit-aware token counts: segment trees over the pre-tokens of a document.

A tokenizer's pattern cuts a text into pre-tokens, each encoded for itself. Whole
pre-tokens are gathered into leaves of about ``LEAF_CHARS`` characters, and a binary tree
over the leaves holds sums of characters and tokens. An edit finds its leaf by the sums,
changes the text of the leaves it touches, and encodes again from the first leaf whose
start the edit cannot move (two characters before it: the pattern looks no farther ahead)
to the first boundary of an old leaf behind the edit at which a new pre-token begins;
from there on the text and so its pre-tokens are the old ones. Only sums above changed
leaves are added up anew. A leaf that has grown too large makes the tree be built again
from the leaves.

Trees are made by a map over documents and are columns of theirs (characters and tokens
of the leaves), so they can be stored and used again. Documents and their edits are
brought together by id in one shuffle and sorted; a task then holds the tree of one
document at a time and reads the edits of it one after the other, however many there are.

Edits (doc_id, seq, at, cut, put) replace ``cut`` characters at place ``at`` of the text
as the edits before left it, by ``put``; their order is ``seq``, then the other columns.

Defined results: a null text is counted like an empty one; places and lengths beyond the
text are cut to it, negative ones are 0; a null ``put`` is empty; edits without an id,
place or document are ignored; documents without an id are counted and not edited; of
rows that repeat an id the first one by text takes the edits, the others stay as they
are; columns other than these are left out.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemark.llm.bpe import read_ranks
from pagemark.llm.common import prepare, slices

LEAF_CHARS = 512
AHEAD = 2
#: Pre-tokens remembered by a task; beyond it the memory starts afresh.
REMEMBERED = 400_000


class Counter:
    """Pre-tokens of a text and their numbers of tokens."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding(
            "counted", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.known: dict[str, int] = {}

    def tokens(self, pieces: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        encode = self.library.encode_ordinary
        for piece in set(pieces).difference(self.known):
            self.known[piece] = len(encode(piece))
        return list(map(self.known.__getitem__, pieces))

    def leaves(self, text: str, leaf_chars: int) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves of a text."""
        return self.gather(self.pattern.findall(text), leaf_chars)

    def gather(self, pieces: list[str], leaf_chars: int) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that pre-tokens make."""
        chars, tokens, size, sum_ = [], [], 0, 0
        for piece, n in zip(pieces, self.tokens(pieces)):
            size += len(piece)
            sum_ += n
            if size >= leaf_chars:
                chars.append(size)
                tokens.append(sum_)
                size = sum_ = 0
        if size:
            chars.append(size)
            tokens.append(sum_)
        return chars, tokens


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """The segment tree of one document: sums in a heap, texts at the leaves."""

    def __init__(self, count: Counter, text: str, chars: list[int], tokens: list[int],
                 leaf_chars: int = LEAF_CHARS):
        self.count, self.leaf_chars = count, leaf_chars
        at, texts = 0, []
        for n in chars:
            texts.append(text[at:at + n])
            at += n
        self.encoded_chars = 0
        self._build(texts, list(tokens))

    def _build(self, texts: list[str], tokens: list[int]) -> None:
        self.width = 1
        while self.width < len(texts):
            self.width *= 2
        pad = self.width - len(texts)
        self.texts = texts + [""] * pad
        self.chars = [0] * self.width + [len(t) for t in self.texts]
        self.tokens = [0] * self.width + tokens + [0] * pad
        for node in range(self.width - 1, 0, -1):
            self._add(node)

    def _add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = self.width + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self._add(node)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last filled one for the end), and its start."""
        node, start = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def leaf_sums(self) -> tuple[list[int], list[int]]:
        own = [i for i in range(self.width) if self.texts[i]]
        return [self.chars[self.width + i] for i in own], [self.tokens[self.width + i] for i in own]

    def text(self) -> str:
        return "".join(self.texts)

    def edit(self, at: int, cut: int, put: str) -> None:
        total = self.chars[1]
        at = min(max(at, 0), total)
        end = min(at + max(cut, 0), total)
        if at == end and not put:
            return
        first, start = self.find(max(0, at - AHEAD))
        last, last_start = self.find(max(at, end - 1))
        last_end = last_start + len(self.texts[last])
        old = "".join(self.texts[first:last + 1])
        new = old[:at - start] + put + old[end - start:]
        moved = len(new) - len(old)
        # grow to the right until a pre-token begins where an old leaf did
        border, ahead, wanted = last, last, 1
        bounds = {last_end + moved: last}
        tail = ""
        while True:
            added = 0
            while ahead + 1 < self.width and added < wanted:
                ahead += 1
                if self.texts[ahead]:
                    tail += self.texts[ahead]
                    bounds[start + len(new) + len(tail)] = ahead
                    added += 1
            scanned = new + tail
            whole = start + len(scanned) == total + moved
            safe = len(scanned) if whole else len(scanned) - AHEAD
            place, stop, pieces = 0, None, []
            for match in self.count.pattern.finditer(scanned):
                place = match.end()
                pieces.append(match.group())
                if place >= len(new) and start + place in bounds and place <= safe:
                    stop = place
                    border = bounds[start + place]
                    break
            self.encoded_chars += place
            if stop is not None or whole:
                if stop is None:
                    border = ahead
                break
            wanted *= 2
        self._set(first, "".join(pieces), sum(self.count.tokens(pieces)))
        for leaf in range(first + 1, border + 1):
            if self.texts[leaf]:
                self._set(leaf, "", 0)
        if len(self.texts[first]) > 8 * self.leaf_chars:
            texts, tokens = [], []
            for leaf, text in enumerate(self.texts):
                if leaf == first:
                    # of the pre-tokens found in their place: alone, white space at the end of
                    # the leaf would be cut in another way
                    chars, counts = self.count.gather(pieces, self.leaf_chars)
                    place = 0
                    for n in chars:
                        texts.append(text[place:place + n])
                        place += n
                    tokens += counts
                elif text:
                    texts.append(text)
                    tokens.append(self.tokens[self.width + leaf])
            self._build(texts, tokens)


def build_trees(documents: DataFrame, path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens) for every document."""
    def run(batches):
        count = counter(path, pattern)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            leaves = [count.leaves(t, leaf_chars) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()),
                 pa.array([c for c, _ in leaves], pa.list_(pa.int32())),
                 pa.array([t for _, t in leaves], pa.list_(pa.int32()))],
                ["doc_id", "text", "leaf_chars", "leaf_tokens"],
            )

    prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>")


COUNTED = (
    "doc_id long, n_tokens_before long, n_tokens long, n_edits long, n_chars long, "
    "encoded_chars long, text string, leaf_chars array<int>, leaf_tokens array<int>"
)


def apply_edits(trees: DataFrame, edits: DataFrame, path: str, pattern: str,
                leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The documents after their edits: counts before and after, text and tree.

    ``encoded_chars`` is what had to be encoded again.
    """
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [part.split()[0] for part in COUNTED.split(", ")]

    def run(batches):
        count = counter(path, pattern)
        open_: list = []  # doc_id, tree, tokens before, edits
        done: list = []
        size = 0

        def close():
            nonlocal size
            if open_:
                doc_id, tree, before, n = open_
                text = tree.text()
                done.append((doc_id, before, tree.tokens[1], n, tree.chars[1], tree.encoded_chars,
                             text, *tree.leaf_sums()))
                size += len(text)
                open_.clear()

        def flush():
            nonlocal size
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
            done.clear()
            size = 0
            return out

        for batch in slices(batches):
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    # edits come after all rows of an id and belong to the first of them
                    tree = Tree(count, row["text"] or "", row["leaf_chars"] or [], row["leaf_tokens"] or [],
                                leaf_chars)
                    if open_ and row["doc_id"] is not None and open_[0] == row["doc_id"]:
                        kept, open_[:] = list(open_), [row["doc_id"], tree, tree.tokens[1], 0]
                        close()
                        open_[:] = kept
                    else:
                        close()
                        open_[:] = [row["doc_id"], tree, tree.tokens[1], 0]
                elif open_ and open_[0] == row["doc_id"]:
                    open_[1].edit(row["at"], row["cut"], row["text"] or "")
                    open_[3] += 1
                if size > 4 << 20:
                    yield flush()
        close()
        if done:
            yield flush()

    prepare(trees.sparkSession)
    empty = F.lit(None).cast("array<int>")
    none = F.lit(None).cast("long")
    rows = trees.select(
        "doc_id", F.lit(0).alias("kind"), none.alias("seq"), none.alias("at"), none.alias("cut"), "text",
        "leaf_chars", "leaf_tokens",
    ).unionByName(edits.filter(F.col("doc_id").isNotNull() & F.col("at").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("kind"),
        F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"),
        F.coalesce(F.col("cut").cast("long"), F.lit(0)).alias("cut"), F.col("put").alias("text"),
        empty.alias("leaf_chars"), empty.alias("leaf_tokens"),
    ))
    # documents without an id have no edits and needn't meet in one task
    spread = F.coalesce("doc_id", F.xxhash64("text"))
    ordered = rows.withColumn("spread", spread).repartition("spread").sortWithinPartitions(
        "doc_id", "kind", "seq", "text", "at", "cut")
    return ordered.drop("spread").mapInArrow(run, COUNTED)
