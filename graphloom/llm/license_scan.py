"""License scans by diagonal voting.

All rolling word 2-gram hashes of all texts are joined in Spark to the places of the same 2-grams in license templates.
Each hit votes for the diagonal (place in the text minus place in the template) of its template; votes are summed by
diagonal, neighbouring diagonals (insertions and deletions shift them) merge into spans, and spans with votes enough
are verified word by word against the template on the text itself.

Templates are the fixed short phrases, whose every place is reported, and the notices of ``NOTICES``.

Defined results: null texts count as empty; texts without words have no labels and the score 0; rows that repeat (the
same id and text) each get the same result; no input column but the id and the text is read. The template table is
broadcast: its size is that of the templates, whatever the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bits_of, mix, slices, within_bits, written

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of public license notices.
NOTICES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
}
HEAD = -7_046_029_254_386_353_131  # stands for the start of a text among the hashes
#: ASCII letters to lower case, other ASCII but digits to spaces; bytes of other characters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def gram_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).view(np.int64)


def templates() -> list[list[bytes]]:
    return [words_of(t) for t in (*PHRASES, *NOTICES.values())]


def hits(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, id, pos, template, t_pos, n_words): the joined 2-grams, and for each row of ``df`` one with template -1."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("id", id_type), T.StructField("pos", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n_words", T.LongType())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys, ids = b.column(2).to_pylist(), b.column(0).to_numpy(), b.column(1)
            for lo, hi in slices(texts, 2_000_000):
                found = [words_of(t) for t in texts[lo:hi]]
                sizes = np.array([len(w) for w in found])
                h = gram_hashes([w for row in found for w in (*row, b"")])  # a text's last 2-gram ends with no word
                ends = np.cumsum(sizes + 1)
                real = np.ones(len(h) + 1, bool)
                real[ends - 1] = False
                pos = np.arange(len(h) + 1) - np.repeat(ends - sizes - 1, sizes + 1)
                last = np.zeros(len(h) + 1, bool)
                last[np.maximum(ends - 2, 0)] = True
                use = (real & ~last)[:-1] if len(h) else np.zeros(0, bool)
                n, m = int(use.sum()), hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.repeat(keys[lo:hi], sizes + 1)[:-1][use] if len(h) else keys[:0], keys[lo:hi]])), pa.concat_arrays([pa.nulls(n, ids.type), ids.slice(lo, m)]), pa.array(np.concatenate([pos[:-1][use], np.full(m, -1)]).astype(np.int32)), pa.array(np.concatenate([h[use], np.full(m, HEAD)])), pa.array(np.concatenate([np.zeros(n, np.int64), sizes]))],
                    names=["k", "id", "pos", "h", "n_words"],
                )

    places = [(int(h), t, i) for t, words in enumerate(templates()) for i, h in enumerate(gram_hashes(words))]
    where = spark.createDataFrame([(HEAD, -1, 0), *places], "h long, template int, t_pos int")
    rows = df.select(F.xxhash64(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(grams, schema).join(F.broadcast(where), "h").drop("h")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", drift: int = 4, votes: float = 0.3, coverage: float = 0.6) -> DataFrame:
    """One row for each row of ``df``: its id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``drift``: the largest step between diagonals that merge; ``votes``: the share of a notice's 2-grams that makes a
    span a candidate; ``coverage``: the share of its words that must stand in order in a verified span. The score is
    the largest share verified (1 for a phrase).
    """
    all_hits = written(hits(df, id_col, text_col), "license_hits")
    sizes = [len(t) for t in templates()]
    n_phrases = len(PHRASES)
    length = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("template") + 1)
    # Repeated rows vote on the same places: distinct places are counted.
    diagonals = all_hits.where("template >= 0").groupBy("k", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.size(F.collect_set("pos")).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by_text = Window.partitionBy("k", "template").orderBy("diagonal")
    exact = diagonals.where((F.col("template") < n_phrases) & (F.col("n") == length - 1)).select("k", "template", F.col("diagonal").alias("lo"), (F.col("diagonal") + length).alias("hi"))
    step = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_text) > drift, F.lit(False)).cast("int")
    merged = (
        diagonals.where(F.col("template") >= n_phrases)
        .withColumn("span", step)
        .withColumn("span", F.sum("span").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k", "template", "span")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), (F.max("hi") + 2).alias("hi"))
        .where(F.col("n") >= F.greatest(F.lit(3), votes * (length - 1)))
        .select("k", "template", "lo", "hi")
    )
    spans = written(exact.unionByName(merged).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("template", "lo", "hi"))).alias("spans")), "license_spans")
    bits = bits_of(spans, "k")
    bits_b = df.sparkSession.sparkContext.broadcast(bits)

    def with_spans(batches):
        for b in batches:
            yield b.filter(pa.array(within_bits(bits_b.value, b.column(0).to_numpy())))

    texts = df.select(F.xxhash64(id_col, text_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(with_spans, "k long, text string").dropDuplicates(["k"])
    labels = [*PHRASES.values(), *NOTICES]

    def verify(batches):
        known = templates()
        for b in batches:
            out = []
            for k, text, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, places, got, score = words_of(text), [], set(), 0.0
                for s in found:
                    t, lo, hi = s["template"], s["lo"], s["hi"]
                    if t < n_phrases:
                        if words[lo:hi] == known[t]:
                            places.append(lo)
                            got.add((labels[t], True))
                            score = 1.0
                    else:
                        m = SequenceMatcher(None, words[lo:hi], known[t], False)
                        share = sum(x.size for x in m.get_matching_blocks() if x.size > 1) / len(known[t])
                        if share >= coverage:
                            got.add((labels[t], False))
                            score = max(score, min(1.0, share))
                out.append((k, len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, base in got if base})), ",".join(sorted({x for x, _ in got})), score))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["k", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    verified = texts.join(spans, "k").select("k", "text", "spans").mapInArrow(verify, "k long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    heads = all_hits.where("template = -1").select("k", "id", "n_words")
    return heads.join(verified, "k", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
