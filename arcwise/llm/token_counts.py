"""Exact token counts of every prefix by dynamic programming over byte-pair merges.

For a merge vocabulary the encoding of a prefix is the encoding of a shorter
prefix plus one token, and that token is the only one whose pairing with the
token before it survives the merge order. So one pass over a piece of text
gives the last token, hence the count, of every prefix; truncation and budget
questions read the stored counts and encode nothing again.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coders import byte_letters, default_path
from .common import INT, LONG, byte_column, schema, small_batches

#: Fixed value: the splitting rule of byte-level vocabularies of this kind.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DOUBLE_SPACE = re.compile(r"[\s\x1c-\x1f]{2}")
NONE = 1 << 60


class PrefixCounter:
    """Prefix token counts of whole texts under a byte-level merge vocabulary."""

    def __init__(self, path: str, limit: int = 1_200_000):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("prefix counts need a plain byte-level vocabulary")
        letters = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda text: bytes(letters[c] for c in text)
        model = spec["model"]
        plain = {k: v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        ids = {raw(k): v for k, v in plain.items()}
        #: Rank of each merge; the halves and the rank of each merged token.
        self.merges: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = ids[raw(left)], ids[raw(right)], ids[raw(left + right)]
            self.merges[a, b] = rank
            if c not in self.halves:
                self.halves[c], self.rank[c] = (a, b), rank
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        #: Tokens by their bytes from the last to the first; -1 holds the token.
        self.root: dict = {}
        stands = {v for k, v in ids.items() if len(k) == 1}
        for token, (a, b) in sorted(self.halves.items(), key=lambda x: self.rank[x[0]]):
            if a in stands and b in stands and self._apart(a, b, self.rank[token]):
                stands.add(token)
        for data, token in ids.items():
            if token in stands:
                node = self.root
                for byte in reversed(data):
                    node = node.setdefault(byte, {})
                node[-1] = token
        self.split = regex.compile(BYTE_PATTERN).findall
        self.gap = regex.compile(r"\s+").fullmatch
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, int] = {}
        self.after_space: dict[str, int] = {}
        self.limit = limit

    def _apart(self, left: int, right: int, own: int = NONE) -> bool:
        """Whether no merge crosses the seam of left and right before rank own.

        Both trees of merges are undone along the seam, latest merge first; a
        pair across the seam that would have merged earlier forbids it.
        """
        a, b, bound, right_made = left, right, NONE, False
        rank, halves, merges = self.rank, self.halves, self.merges
        while True:
            across = merges.get((a, b), NONE)
            # A tie with a merge on the right is won by the seam, which lies to its left.
            if across != own and (across < bound or right_made and across == bound < NONE):
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Of equal merges the left one is made first, so the right one is undone first.
            if ra > rb:
                bound, right_made, a = ra, False, halves[a][1]
            else:
                bound, right_made, b = rb, True, halves[b][0]

    def joins(self, left: int, right: int) -> bool:
        """Whether left then right stay apart when encoded together."""
        found = self._apart(left, right)
        if len(self.pairs) < 1_000_000:
            self.pairs[left << 20 | right] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        """Counts of every byte prefix of one piece (index 0: empty)."""
        counts, last = [0], [-1]
        root, known, joins = self.root, self.pairs.get, self.joins
        for end in range(1, len(data) + 1):
            node, start = root, end
            while True:  # tokens that end here, shortest first; exactly one fits
                start -= 1
                node = node[data[start]]
                token = node.get(-1)
                if token is None:
                    continue
                if start:
                    fits = known(last[start] << 20 | token)
                    if fits is None:
                        fits = joins(last[start], token)
                    if not fits:
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
        return counts

    def _ordinary(self, text: str) -> list[int]:
        """Counts after every character of a text without special strings, first 0."""
        out, before, after, run = [0], 0, 0, ""
        for piece in self.split(text):
            if self.gap(piece):
                if not run:
                    before = out[-1]
                # A prefix that ends in white space ends in one undivided run.
                for ch in piece:
                    run += ch
                    out.append(before + self.piece(run.encode())[-1])
                # What follows sees the pieces as split.
                after = (after if len(run) > len(piece) else before) + self.piece(piece.encode())[-1]
                continue
            base = after if run else out[-1]
            data = piece.encode()
            counts = self.piece(data)
            ends = np.cumsum([len(c.encode()) for c in piece])
            row = [base + counts[e] for e in ends]
            if piece[0] == " ":
                # A lone leading space still belongs to the run before it.
                start = before if run else out[-1]
                row[0] = start + self.piece((run + " ").encode())[-1]
            elif piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                row[1] = base + self.piece(b"'")[-1] + self.piece(piece[1].encode())[-1]
            out += row
            run = ""
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:i] for every i from 0 to len(text)."""
        import regex

        out, seen = [0], 0
        cuts = list(regex.finditer("|".join(map(regex.escape, self.special)), text)) if self.special else []
        for cut in cuts:
            body = self._ordinary(text[seen : cut.end()])  # inside the string it is still ordinary text
            base, n = out[-1], cut.start() - seen
            out += [base + c for c in body[1 : n + (cut.end() - cut.start())]]
            whole = self._ordinary(text[seen : cut.start()])[-1]
            out.append(base + whole + 1)
            seen = cut.end()
        base = out[-1]
        out += [base + c for c in self._ordinary(text[seen:])[1:]]
        return np.array(out, "int64")

    def _count_pieces(self, text: str) -> int:
        return sum([self.piece(p.encode())[-1] for p in self.split(text)])

    def count(self, text: str) -> int:
        """The last prefix count. Words with their leading space are remembered."""
        if any(s in text for s in self.special):
            return int(self.prefixes(text)[-1])
        if DOUBLE_SPACE.search(text):
            get, total = self.memo.get, 0
            for p in self.split(text):
                n = get(p)
                if n is None:
                    n = self._learn(p)
                total += n
            return total
        if not text:
            return 0
        # Single white-space characters: each space opens a piece, so chunks count apart.
        words = text.split(" ")
        head = self._count_pieces(words[0]) if words[0] else 0
        if text[-1] == " ":
            words[-1] = ""
        try:
            return head + sum(map(self.after_space.__getitem__, words[1:]))
        except KeyError:
            get, learn = self.after_space.get, self._learn_word
            return head + sum([n if (n := get(w)) is not None else learn(w) for w in words[1:]])

    def _learn_word(self, word: str) -> int:
        n = self._count_pieces(" " + word)
        if len(self.after_space) < self.limit:
            self.after_space[word] = n
        return n

    def _learn(self, piece: str) -> int:
        n = self.piece(piece.encode())[-1]
        if len(self.memo) < self.limit:
            self.memo[piece] = n
        return n


@functools.cache
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def fit_prefix(counts: list[int] | np.ndarray, budget: int) -> int:
    """Length in characters of the longest prefix with at most budget tokens."""
    within = np.flatnonzero(np.asarray(counts) <= budget)
    return int(within[-1]) if len(within) else 0


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of docs(doc_id, text).

    Null text counts as empty (0 bytes, 0 tokens). Rows are independent:
    repeated or null ids stay as they are; extra columns are ignored.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        counter = prefix_counter(tokenizer)
        for batch in batches:
            texts = byte_column(batch, "text")
            n = [counter.count(x.decode("utf-8", "replace")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text").mapInArrow(count, schema(doc_id=LONG, n_bytes=LONG, n_tokens=LONG))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, prefix_counts: the count after every character, first 0."""
    small_batches(docs.sparkSession)

    def table(batches):
        counter = prefix_counter(tokenizer)
        for batch in batches:
            rows = [counter.prefixes(x.decode("utf-8", "replace")).tolist() for x in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_counts"])

    return docs.select("doc_id", "text").mapInArrow(table, T.StructType([*schema(doc_id=LONG), T.StructField("prefix_counts", T.ArrayType(INT, False))]))


def truncate(prefixes: DataFrame, docs: DataFrame, budget: int) -> DataFrame:
    """doc_id, text cut to the longest prefix within budget, from stored counts alone."""
    fits = F.expr(f"size(prefix_counts) - 1 - (array_position(reverse(transform(prefix_counts, c -> c <= {int(budget)})), true) - 1)")
    return docs.join(prefixes.select("doc_id", fits.cast("int").alias("_fit")), "doc_id").select("doc_id", F.expr("left(text, _fit)").alias("text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under the byte-level vocabulary."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("byte_bpe_50k.json"))
