"""Edit-aware token counts: a segment tree over runs of pre-tokens for each document.

A text is cut into leaves of at least ``LEAF`` characters, at places that are always borders of the
tokenizer's pre-tokens: before a single space between two characters that are no white space, and
between letters, digits and signs that meet (but not behind an apostrophe), so texts without spaces are
cut too.  A leaf's tokens are the tokens of its text alone, so their sum is the count of the whole text.
The sums of the leaves form a binary tree.  An edit replaces the characters start:end; only the leaves
that it touches and one neighbour on either side (whose border could have moved) are encoded again,
and the sums above them updated.

Trees are kept beside the documents as the lengths and counts of their leaves: ``with_trees`` encodes a
text once and writes them, ``edited`` opens a kept tree without encoding, applies edits and returns the
edited text with its tree, ready for the next edit.  ``edited_counts`` builds the trees, keeps them in a
table, and edits twice.

Edits are given in the text's own positions, ``array<struct<start,end,text>>``.  They are applied
from the last to the first, so earlier positions stay valid.

Defined cases: a null or empty text has no leaf and 0 tokens; null edits and edits with a null or
reversed range are left out, ranges beyond the text are cut to it, and of overlapping edits the
left one ends where the right one starts; a null replacement is empty; ties (same start) apply in
the order given, from last to first; rows that repeat are counted alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from postlens.llm.jobs import written
from postlens.session import ship

LEAF = 512
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-token pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# where one of the pattern's alternatives always ends
BORDER = regex.compile(r"(?<=\S) (?=\S)|(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])|(?<=[\p{P}\p{S}])(?<!['])(?=[\p{L}\p{N}])")


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("edit-aware", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count(enc, text: str) -> int:
    return len(enc.encode_ordinary(text)) if text else 0


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text cut at borders of pre-tokens."""
    out, begin, at = [], 0, size
    while m := BORDER.search(text, at):
        out.append(text[begin:m.start()])
        begin, at = m.start(), m.start() + size
    out.append(text[begin:])
    return out if text else []


class Tree:
    """Segment tree of token counts; ``encoded`` is the number of characters encoded so far."""

    def __init__(self, text: str, enc, stored: tuple[list[int], list[int]] | None = None):
        self.enc, self.encoded = enc, 0
        if stored is None:
            self.leaves = leaves(text)
            counts = [self._count(x) for x in self.leaves]
        else:
            lengths, counts = stored
            self.leaves, at = [], 0
            for n in lengths:
                self.leaves.append(text[at:at + n])
                at += n
        self.first = []                             # position of each leaf in the text as given
        at = 0
        for x in self.leaves:
            self.first.append(at)
            at += len(x)
        self.length = at
        self.base = 1
        while self.base < len(counts):
            self.base *= 2
        self.sums = [0] * (2 * self.base)
        self.sums[self.base:self.base + len(counts)] = counts
        for i in range(self.base - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return count(self.enc, text)

    @property
    def total(self) -> int:
        return self.sums[1]

    def state(self) -> tuple[list[int], list[int]]:
        """Lengths and counts of the leaves."""
        return [len(x) for x in self.leaves], self.sums[self.base:self.base + len(self.leaves)]

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_of(self, position: int) -> int:
        """Leaf that holds this position of the given text (the last one for its end)."""
        lo, hi = 0, len(self.first) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.first[mid] <= position:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = self.base + leaf
        change = tokens - self.sums[i]
        while i and change:
            self.sums[i] += change
            i //= 2

    def _edit(self, start: int, end: int, new: str) -> None:
        if not self.leaves:
            self.leaves, self.first = [""], [0]
        i, j = self._leaf_of(start), self._leaf_of(max(start, end - 1))
        # leaves emptied by an edit further right don't count as context
        j = min(max(j, i), len(self.leaves) - 1)
        lo, hi = max(i - 1, 0), j + 1
        while hi < len(self.leaves) - 1 and not self.leaves[hi]:
            hi += 1
        region = "".join(self.leaves[lo:hi + 1])
        a, b = start - self.first[lo], end - self.first[lo]
        region = region[:a] + new + region[b:]
        parts, slots = leaves(region), list(range(lo, min(hi, len(self.leaves) - 1) + 1))
        # one part to a slot; what is left over goes to the last one, which no later edit touches
        groups = [parts[k:k + 1] for k in range(len(slots) - 1)] + [parts[len(slots) - 1:]]
        place, base = 0, self.first[lo]
        for slot, group in zip(slots, groups, strict=True):
            self.first[slot] = base + place if group and place <= a else start + 1
            place += sum(map(len, group))
            self._set(slot, "".join(group), sum(self._count(x) for x in group))

    def apply(self, edits) -> int:
        """Apply [(start, end, text)]; returns how many were applied."""
        valid = [(max(0, min(s, self.length)), max(0, min(e, self.length)), t or "")
                 for s, e, t in (x for x in edits or () if x is not None) if s is not None and e is not None and s <= e]
        right = self.length
        done = 0
        for s, e, t in sorted(valid, key=lambda x: x[0])[::-1]:
            self._edit(s, min(e, right), t)
            right = s
            done += 1
        return done


_NUMBER = re.compile(r"[0-9]{7,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a cleaning step: lines with a word that equal an earlier line go, and runs of seven
    digits or more become one sign."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            out.append((max(at - 1, 0), at + len(line), ""))
        else:
            seen.add(line)
            out += [(at + m.start(), at + m.end(), "#") for m in _NUMBER.finditer(line)]
        at += len(line) + 1
    return out


def _ranks(spark: SparkSession, path: str):
    """The vocabulary file, read where the job is started and broadcast (under 2 MB, checked)."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 16 << 20:
        raise ValueError(f"{path} is no vocabulary file: over 16 MB")
    return spark.sparkContext.broadcast(data)


_TREE = "lengths:array<int>,counts:array<int>"
BUILT = f"struct<n_tokens:long,{_TREE}>"
EDITED = f"struct<text:string,n_edits:int,n_tokens:long,n_encoded:long,{_TREE}>"
_TYPES = {"text": pa.string(), "n_edits": pa.int32(), "n_tokens": pa.int64(), "n_encoded": pa.int64(),
          "lengths": pa.list_(pa.int32()), "counts": pa.list_(pa.int32())}


def _structs(rows: list[tuple], names: list[str]) -> pa.StructArray:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.StructArray.from_arrays([pa.array(list(c), _TYPES[n]) for c, n in zip(cols, names, strict=True)], names)


def _in_parts(make, n: int, size: int = 256) -> pa.Array:
    """A batch's result from parts, so that few documents are Python objects at a time."""
    return pa.concat_arrays([make(a, min(a + size, n)) for a in range(0, max(n, 1), size)])


def _state(tree: Tree) -> tuple[list[int], list[int]]:
    lengths, counts = tree.state()
    kept = [(a, b) for a, b in zip(lengths, counts, strict=True) if a]
    return [a for a, _ in kept], [b for _, b in kept]


def with_trees(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """``docs`` with ``tree``: struct(n_tokens, lengths, counts) of column ``text``, all of it encoded once."""
    ship(docs.sparkSession)
    ranks = _ranks(docs.sparkSession, path)

    @arrow_udf(BUILT)
    def build(text: pa.Array) -> pa.Array:
        enc = encoder(ranks.value)

        def part(a, b):
            trees = (Tree(t.as_py() or "", enc) for t in text[a:b])
            return _structs([(t.total, *_state(t)) for t in trees], ["n_tokens", "lengths", "counts"])
        return _in_parts(part, len(text))
    return docs.withColumn("tree", build("text"))


def edit_udf(spark: SparkSession, path: str = RANKS, derive=None):
    """(text, lengths, counts, edits) -> EDITED; with ``derive`` (text -> edits) it takes no edits.

    ``n_encoded`` is the number of characters encoded because of the edits.
    """
    ship(spark)
    ranks = _ranks(spark, path)

    def one(enc, text, lengths, counts, edits):
        # without a kept tree the text is encoded first, which doesn't count as edited
        tree = Tree(text, enc, None if lengths is None or counts is None else (lengths, counts))
        tree.encoded = 0
        n = tree.apply(edits)
        return tree.text(), n, tree.total, tree.encoded, *_state(tree)

    def run(text, lengths, counts, edits):
        enc = encoder(ranks.value)

        def part(a, b):
            rows = zip((x.as_py() or "" for x in text[a:b]), (x.as_py() for x in lengths[a:b]), (x.as_py() for x in counts[a:b]), edits[a:b], strict=True)
            return _structs([one(enc, t, n, c, derive(t) if derive else e) for t, n, c, e in rows],
                            ["text", "n_edits", "n_tokens", "n_encoded", "lengths", "counts"])
        return _in_parts(part, len(text))

    if derive is not None:
        @arrow_udf(EDITED)
        def derived(text: pa.Array, lengths: pa.Array, counts: pa.Array) -> pa.Array:
            return run(text, lengths, counts, [None] * len(text))
        return derived

    @arrow_udf(EDITED)
    def given(text: pa.Array, lengths: pa.Array, counts: pa.Array, edits: pa.Array) -> pa.Array:
        return run(text, lengths, counts, [[(e["start"], e["end"], e["text"]) for e in x.as_py() or () if e is not None] for x in edits])
    return given


def edited(docs: DataFrame, out: str = "edited", path: str = RANKS, derive=None, tree: str = "tree", text: str = "text") -> DataFrame:
    """``docs`` with struct(text, n_edits, n_tokens, n_encoded, lengths, counts) after the edits of column
    ``edits`` (or those that ``derive`` makes), from the kept tree in ``tree``."""
    args = [text, f"{tree}.lengths", f"{tree}.counts", *([] if derive else ["edits"])]
    return docs.withColumn(out, edit_udf(docs.sparkSession, path, derive)(*args))


def blank_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a later step: blanks at the ends of lines go, and more than one empty line becomes one."""
    return [(m.start(), m.end(), "\n\n" if m.group().count("\n") > 1 else "\n") for m in _BLANKS.finditer(text)]


_BLANKS = re.compile(r"(?<![ \t\n])[ \t]+\n[ \t\n]*|(?<![ \t\n])\n[ \t]*\n[ \t]*\n[ \t\n]*")


def edited_counts(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_encoded, n_edits_later, n_tokens_later, n_encoded_later
    for each row of ``docs``: trees are built and kept in a table; the edits of column ``edits`` (if there is
    one, else ``cleaning_edits``) are applied to the kept trees, and ``blank_edits`` to what these leave."""
    given = "edits" in docs.columns
    own = docs.select("doc_id", "text", *(["edits"] if given else []))
    kept = written(with_trees(own, path), "trees")
    first = edited(kept, "first", path, None if given else cleaning_edits)
    second = edited(first, "second", path, blank_edits, tree="first", text="first.text")
    return second.select("doc_id", F.col("tree.n_tokens").alias("n_tokens"), F.col("first.n_edits").alias("n_edits"),
                         F.col("first.n_tokens").alias("n_tokens_edited"), F.col("first.n_encoded").alias("n_encoded"),
                         F.col("second.n_edits").alias("n_edits_later"), F.col("second.n_tokens").alias("n_tokens_later"),
                         F.col("second.n_encoded").alias("n_encoded_later"))
