"""Language-model scores by the likelihood of subword lattices.

An existing vocabulary's scores weigh all segmentations of a word; a forward recursion in log space sums them to the
word's marginal probability. A text's lattice is the product of its words' lattices, so the text's marginal is the sum of
the logs over its words and its end. The trained model takes these marginals as the prior of the word counts of the
training texts: P(token) = (c + m * marginal(token)) / (N + m), m being the number of distinct training tokens.

Counts are gathered over all training texts in one shuffled sum. Words with a share of at least ``hot`` of all tokens, of
which there can be no more than 1 / hot, are known to every task; each text's other words are joined to the counts in a
shuffle.

Defined results: null texts count as empty and have one token, the end; a null id is hashed as an empty text; repeated
rows are scored each (and counted each in training); an empty table gives an empty result; with no training text, c and N
are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written
from .lattice import Lattice, Vocabulary, load, shared

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(i, folds: int = 10) -> bool:
    return crc32(b"" if i is None else str(i).encode()) % folds == 0


def counted(df: DataFrame, id_col: str, text_col: str, folds: int, most: int = 400_000) -> DataFrame:
    """(word, c, n): how often each word of all texts stands in training texts and in all. A task holds ``most`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        train: Counter = Counter()

        def out():
            words = list(seen)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "c", "n"])
            seen.clear()
            train.clear()
            return batch

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(t)
                seen.update(words)
                if not held_out(i, folds):
                    train.update(words)
                if len(seen) > most:
                    yield out()
        if seen:
            yield out()

    return df.select(id_col, text_col).mapInArrow(count, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def with_marginals(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds marginal: the natural log of the sum over all segmentations of a blank and the word."""
    vocabulary_of = shared(words.sparkSession, vocabulary)

    def run(batches):
        v = vocabulary_of()
        for b in batches:
            units = [" " + w.decode("utf-8", "surrogatepass") for w in b.column(0).to_pylist()]
            total = [np.zeros(0)]
            for lo, hi in slices(units, 400_000):
                total.append(Lattice.of(v, units[lo:hi]).total)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(total))], names=[*b.schema.names, "marginal"])

    return words.mapInArrow(run, T.StructType([*words.schema.fields, T.StructField("marginal", T.DoubleType())]))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folds: int = 10, hot: float = 5e-6) -> DataFrame:
    """One row for each row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    lattice_score (the log10 marginal without counts). The path of the vocabulary is read on the driver only."""
    spark = df.sparkSession
    v = load(vocabulary)
    end_marginal = float(v.log_p.min())
    words = written(with_marginals(counted(df, id_col, text_col, folds), v), "lm_words")
    held_col = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0
    n_train, n_docs = df.select(F.count(F.when(~held_col, 1)), F.count("*")).first()
    c_words, n_words, types = words.select(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, types = c_words + n_train, types + (n_train > 0)
    prior = float(max(types, 1))
    base_under, under = np.log10(total + 0.1 * (types + 1)), np.log10(total + prior)

    def base(c):
        return F.log10(c + 0.1) - float(base_under)

    def full(c, marginal):
        return F.log10(c + prior * F.exp(marginal)) - float(under)

    scored = words.withColumns({"base": base(F.col("c")), "full": F.greatest(full(F.col("c"), F.col("marginal")), F.lit(np.log10(prior) - float(under)) + F.col("marginal") / float(np.log(10))), "lat": F.col("marginal") / float(np.log(10))})
    # At most 1 / hot words have this share.
    known = {bytes(r.word): (r.c > 0, r.base, r.full, r.lat) for r in scored.where(F.col("n") >= max(2.0, hot * n_words)).select("word", "c", "base", "full", "lat").toLocalIterator()}
    known_b = spark.sparkContext.broadcast(known)
    end = (n_train > 0, float(np.log10(n_train + 0.1) - base_under), float(np.log10(n_train + prior * np.exp(end_marginal)) - under), end_marginal / float(np.log(10)))
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in ("known", "base", "full", "lat"))])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, hot_words = TaskContext.get().partitionId() << 36, 0, known_b.value
        for b in batches:
            kind, ids, all_texts = b.column(0).type, b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(all_texts, 2_000_000):
                k, words, n, heads = [], [], [], []
                for t in all_texts[lo:hi]:
                    key, row = part + row, row + 1
                    toks = tokens(t)
                    a, s0, s1, s2 = float(end[0]), end[1], end[2], end[3]
                    for w, m in Counter(toks).items():
                        got = hot_words.get(w)
                        if got:
                            a += got[0] * m
                            s0 += got[1] * m
                            s1 += got[2] * m
                            s2 += got[3] * m
                        else:
                            k.append(key)
                            words.append(w)
                            n.append(m)
                    heads.append((key, len(toks) + 1, a, s0, s1, s2))
                m, h = len(k), hi - lo
                key, size, a, s0, s1, s2 = zip(*heads, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*key, *k], pa.int64()), pa.concat_arrays([ids.slice(lo, h), pa.nulls(m, kind)]), pa.concat_arrays([pa.array(size, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.nulls(h, pa.binary()), pa.array(words, pa.binary())]), pa.concat_arrays([pa.nulls(h, pa.int64()), pa.array(n, pa.int64())]), *(pa.concat_arrays([pa.array(x, pa.float64()), pa.nulls(m, pa.float64())]) for x in (a, s0, s1, s2))],
                    names=schema.names,
                )

    rows = written(df.select(id_col, text_col).mapInArrow(texts, schema), "lm_texts")  # each task's row keys are written once
    rare = rows.where(F.col("word").isNotNull()).select("k", "word", "n").join(scored.select("word", "c", "base", "full", "lat"), "word")
    rare = rare.groupBy("k").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("r_known"), *(F.sum(F.col(x) * F.col("n")).alias(f"r_{x}") for x in ("base", "full", "lat")))
    heads = rows.where(F.col("n_tokens").isNotNull()).select("k", "id", "n_tokens", "known", "base", "full", "lat")
    out = heads.join(rare, "k", "left")
    plus = lambda x: F.col(x) + F.coalesce(f"r_{x}", F.lit(0))
    return out.select(
        F.col("id").alias(id_col), (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % folds == 0).alias("held_out"), "n_tokens", plus("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("full").alias("score"), plus("lat").alias("lattice_score")
    )
