"""Alignment of two tokenizers' tokens by the bytes that they cover.

Tokens of both never begin inside ``x y`` other than at the blank, where x and y aren't white space, so a text is cut
there into units whose tokens don't depend on their neighbours, and each distinct unit of a task is aligned once: packed
bitsets mark where tokens of either side end, their AND is the shared cuts, and ranks by popcount turn a cut into
the tokens before it, that is into groups and into the two tokens that end there (a link). A text's groups and links are its
units' in a row.

Counts of id pairs are summed over the corpus by a grouped aggregation of pairs counted by Arrow batch. Pairs are as
skewed as words are, so links meet their counts in two ways: the most frequent pairs, at most ``hot`` of them, are sent to all
tasks; links of the others, none of which is frequent, are joined by shuffle.

Defined results: null and empty texts, and texts that either side's tokens don't spell byte for byte, have no tokens and
zeros; texts of any length are read whole; repeated rows are rows of their own and count as often; ties for a B id's highest count
all count; an empty table gives an empty result; ``keep`` names the columns that pass through, but for those named like new
ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, fresh, slices, with_columns_from_text, written
from .wordcache import Runs, Words

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: The published pattern that cuts texts into words for this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNITS = re.compile(r"(?<=\S) (?=\S)")
LONG_BLANK = re.compile(r"\s{1000}")
SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def spelled(flat: np.ndarray, sizes: np.ndarray, table: list[bytes], wanted: list[bytes]) -> np.ndarray:
    """Whether the tokens of each run spell its text."""
    out, at = np.empty(len(sizes), bool), 0
    ids = flat.tolist()
    for i, (n, w) in enumerate(zip(sizes.tolist(), wanted, strict=True)):
        out[i] = b"".join([table[t] for t in ids[at : at + n]]) == w
        at += n
    return out


class Bits:
    """A packed bitset of byte offsets, with ranks."""

    def __init__(self, ends: np.ndarray, size: int) -> None:
        marks = np.zeros(size, bool)
        marks[ends] = True
        self.packed = np.packbits(marks, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set up to each offset, itself included."""
        upto = (np.uint16(2) << (at & 7).astype(np.uint16)) - np.uint16(1)
        return self.before[at >> 3] + np.bitwise_count(self.packed[at >> 3] & upto.astype(np.uint8))


def shared(a: Bits, b: Bits) -> np.ndarray:
    """The offsets that both sets hold."""
    return np.flatnonzero(np.unpackbits(a.packed & b.packed, bitorder="little"))


class Aligner:
    """Both tokenizers, and what is known of the units met so far."""

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_buffer(byte_level)
        self.slow.encode_special_tokens = True
        parsed, letters = json.loads(byte_level), byte_letters()
        special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): i for k, i in parsed["model"]["vocab"].items() if k not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_a = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for k, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_a[i] = k
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.texts = [[[f"{i}{sep}" for i in range(len(table))] for sep in seps] for table, seps in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]
        self.texts = [np.array([row for row in pair], object) for pair in self.texts]
        self.lengths = [np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b)]
        self.units = Words(self.learn, self.forget)
        self.forget()

    def forget(self) -> None:
        self.pairs, self.groups, self.sizes, self.good = Runs(), [], Runs(), Runs()

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [" " + u for u in units]
        # The fast encoder's regular expressions give up on very long runs of white space.
        a = [self.fast.encode_ordinary(u) if not LONG_BLANK.search(u) else self.slow.encode(u, add_special_tokens=False).ids for u in spaced]
        return a, self.sp.encode(units, num_threads=1)

    def learn(self, units: list[str]) -> None:
        for lo, hi in slices(units, 300_000):
            self.aligned(units[lo:hi])

    def aligned(self, units: list[str]) -> None:
        """Aligns new units and keeps their counts, groups and links."""
        runs = self.encode(units)
        flat = [np.array([i for x in r for i in x], np.int64) for r in runs]
        sizes = [np.array([len(x) for x in r], np.int64) for r in runs]
        wanted = [(" " + u).encode() for u in units]
        good = np.array([bool(u) for u in units]) & spelled(flat[0], sizes[0], self.bytes_a, wanted) & spelled(flat[1], sizes[1], self.bytes_b, wanted)
        flat = [f[np.repeat(good, n)] for f, n in zip(flat, sizes, strict=True)]
        sizes = [np.where(good, n, 0) for n in sizes]
        ends = [np.cumsum(table[f]) - 1 for f, table in zip(flat, self.lengths, strict=True)]  # the last byte of each token
        total = int(ends[0][-1]) + 1 if len(ends[0]) else 0
        a, b = (Bits(e, total) for e in ends)
        cuts = shared(a, b)
        ranks = [a.rank(cuts), b.rank(cuts)]  # tokens of either side up to each cut
        begins = [np.concatenate([[0], r[:-1]]) if len(r) else r for r in ranks]
        n = [r - s for r, s in zip(ranks, begins, strict=True)]  # tokens of each group
        words = np.empty(len(flat[0]) + len(flat[1]), object)
        places = [np.arange(len(flat[0])) + np.repeat(begins[1], n[0]), np.arange(len(flat[1])) + np.repeat(ranks[0], n[1])]
        for f, at, r, table in zip(flat, places, ranks, self.texts, strict=True):
            last = np.zeros(len(f), np.int64)
            last[r - 1] = 1
            words[at] = table[last, f]
        per_unit = np.cumsum(np.where(good, [len(w) for w in wanted], 0))
        first = np.concatenate([[0], np.searchsorted(cuts, per_unit)])  # groups before each unit's end
        upto = np.cumsum(sizes[0] + sizes[1]).tolist()
        lo = 0
        for hi in upto:
            self.groups.append("".join(words[lo:hi])[:-1])
            lo = hi
        link = (flat[0][ranks[0] - 1] << SHIFT) | flat[1][ranks[1] - 1]
        self.pairs.add(link, np.diff(first))
        self.sizes.add(np.stack(sizes, 1).ravel(), np.full(len(units), 2))
        self.good.add(good.astype(np.int64), np.ones(len(units), np.int64))

    def __call__(self, texts: list[str]) -> list[list]:
        """For each text: its tokens of either side, groups, links, groups as text, distinct linked pairs and their counts."""
        units = [UNITS.split(t) if t else [] for t in texts]
        numbers = self.units.numbers([u for us in units for u in us])
        good, sizes = self.good.take(numbers), self.sizes.take(numbers).reshape(-1, 2)
        pairs, upto = self.pairs.take(numbers), np.concatenate([[0], np.cumsum(self.pairs.sizes(numbers))])
        out: list[list] = [[] for _ in range(7)]
        at = 0
        for us in units:
            lo, at = at, at + len(us)
            whole = at > lo and good[lo:at].all()
            n = sizes[lo:at].sum(0).tolist() if whole else [0, 0]
            links = pairs[upto[lo] : upto[at]] if whole else pairs[:0]
            distinct, counts = np.unique(links, return_counts=True)
            row = (*n, len(links), len(links), ";".join([self.groups[i] for i in numbers[lo:at].tolist()]) if whole else "", distinct, counts.astype(np.int32))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out


@lru_cache(2)
def aligner(byte_level: bytes, pieces: bytes) -> Aligner:
    return Aligner(byte_level, pieces)


NEW = [*(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]


def aligned(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), the distinct linked pairs (a id * 2^32 + b id) and
    how many times each is linked. A cut has one token of each side that ends there, so a group has one link. The files are
    read on the driver and sent to the tasks."""
    blobs = Path(byte_level).read_bytes(), Path(pieces).read_bytes()
    return with_columns_from_text(df, text_col, NEW, lambda: aligner(*blobs), keep=keep, most=300_000)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, cnt, best): how often each pair is linked, and whether no pair of its B id is linked more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, at = np.unique(b.column(0).flatten().to_numpy(), return_inverse=True)
            cnt = np.bincount(at, b.column(1).flatten().to_numpy(), len(pair)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(cnt)], names=["pair", "cnt"])

    cnt = written(rows.select("pairs", "times").mapInArrow(run, "pair long, cnt long").groupBy("pair").agg(F.sum("cnt").alias("cnt")), "pairs")
    side = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")
    top = cnt.groupBy(side).agg(F.max("cnt").alias("top"))  # one row for each B id
    out = written(cnt.select("pair", "cnt", side).join(top, "b").select("pair", "cnt", (F.col("cnt") == F.col("top")).alias("best")), "pair-counts")
    dropped(cnt)
    return out


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """At most ``most`` pairs, sorted, with their counts and flags: all those of at least the returned count. The count comes
    from a histogram of few classes."""
    step = F.floor(F.log2("cnt") * 4).cast("int")
    got, least = 0, 1 << 62
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("cnt").alias("low")).collect(), key=lambda r: -r["step"]):
        got += r["n"]
        if got > most:
            break
        least = r["low"]
    t = counts.where(F.col("cnt") >= least).toArrow()
    pair, cnt, best = (t.column(c).to_numpy() for c in ("pair", "cnt", "best"))
    order = np.argsort(pair)
    return pair[order], cnt[order], best[order].astype(np.int64), least


def with_pair_counts(rows: DataFrame, counts: DataFrame, keep: list[str], hot: int = 1 << 18) -> DataFrame:
    """``keep`` of each row of a written table with n_best and count_sum of its links."""
    pair, cnt, best, least = frequent(counts, hot)
    row, pairs, times, n_best, count_sum, p, t = fresh([*rows.columns, *keep], "row", "pairs", "times", "n_best", "count_sum", "p", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = b.column("pairs"), b.column("times").flatten().to_numpy().astype(np.int64)
            flat, sizes = x.flatten().to_numpy(), np.asarray(x.value_lengths())
            of = np.repeat(np.arange(b.num_rows), sizes)
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            known = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            at, of_known, n_known = at[known], of[known], n[known]
            sums = np.zeros((2, b.num_rows), np.int64)
            for i, value in enumerate((best, cnt)):
                np.add.at(sums[i], of_known, n_known * value[at])
            left = np.concatenate([[0], np.cumsum(np.bincount(of[~known], minlength=b.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(left, pa.array(v)) for v in (flat[~known], n[~known])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keep, row]), *map(pa.array, sums), *rest], names=[*keep, row, n_best, count_sum, pairs, times])

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in (row, n_best, count_sum)] + [T.StructField(c, T.ArrayType(T.LongType())) for c in (pairs, times)])
    found = written(rows.select(*keep, *(c for c in ("pairs", "times") if c not in keep), F.monotonically_increasing_id().alias(row)).mapInArrow(run, schema), "links")
    links = found.where(F.size(pairs) > 0).select(row, F.explode(F.arrays_zip(pairs, times)).alias(p)).select(row, F.col(f"{p}.{pairs}").alias("pair"), F.col(f"{p}.{times}").alias(t))
    rest = links.join(counts.where(F.col("cnt") < least), "pair").groupBy(row).agg(F.sum(F.col(t) * F.col("best").cast("long")).alias("n_best"), F.sum(F.col(t) * F.col("cnt")).alias("count_sum"))
    sums = [(F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(b) for a, b in ((n_best, "n_best"), (count_sum, "count_sum"))]
    return found.drop(pairs, times).join(rest, row, "left").select(*keep, *sums)


def digests(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, hot: int = 1 << 18, **options) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    own = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups", "pairs", "times"]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in own]
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = written(aligned(df, text_col, keep, **options).select(*keep, "n_a", "n_b", "n_groups", "n_links", sha, "pairs", "times"), "aligned")
    counts = pair_counts(rows)
    kept = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return with_pair_counts(rows, counts, kept, hot).select(*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
