"""Language identification by character trigrams, trained on texts that name their language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Labelled texts of each language that train the model, in expectation, chosen by a hash of their id.
MAX_TEXTS = 2_000
#: Languages that are told apart: those with the most texts, of at least ``LEAST_TEXTS``.
MAX_LANGUAGES, LEAST_TEXTS = 64, 20


class Trigrams:
    """Hashes the letter trigrams of texts, case folded and with everything but letters as a space."""

    def __init__(self) -> None:
        self.fold = np.full(0x110000, 32, dtype=np.uint32)
        self.known = np.zeros(0x110000, dtype=bool)
        self._learn(np.arange(0x600))

    def _learn(self, codes: np.ndarray) -> None:
        for i in codes.tolist():
            c = chr(i)
            self.fold[i] = ord(c.lower()[0]) if c.isalpha() else 10 if c == "\n" else 32
        self.known[codes] = True

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text number) of each trigram."""
        x = np.frombuffer(("\n" + "\n".join(f" {t.replace(chr(10), ' ')} " for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not self.known[x].all():
            self._learn(np.unique(x[~self.known[x]]))
        x = self.fold[x].astype(np.uint64)
        of = np.cumsum(x == 10) - 1
        a, b, c = x[:-2], x[1:-1], x[2:]
        keep = (a != 10) & (b != 10) & (c != 10) & (b != 32)
        h = (a[keep] * np.uint64(0x9E3779B97F4A7C15)) ^ (b[keep] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[keep] * np.uint64(0x165667B19E3779F9))
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64), of[:-2][keep]


class Languages:
    """The log rates of trigrams in each language.

    ``texts`` has text, lang and an id. A language is the first two letters of ``lang``; texts
    without one train nothing. Without two languages there is no model and nothing is told.
    """

    def __init__(self, texts: DataFrame, row_id: str, text: str = "text", lang: str = "lang") -> None:
        code = F.substring(F.lower(F.trim(lang)), 1, 2)
        x = texts.where(code.rlike(r"^[a-z]{2}$") & F.col(text).rlike(r"\p{L}")).select(code.alias("code"), F.col(row_id).alias("id"), F.col(text).alias("text"))
        counts = [(r["code"], r["n"]) for r in x.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "code").limit(MAX_LANGUAGES).collect()]
        self.names = sorted(c for c, _ in counts)
        spark = texts.sparkSession
        table = np.zeros((BUCKETS, len(self.names)), dtype=np.float64)
        if len(counts) > 1:
            share = spark.createDataFrame([(c, self.names.index(c), min(1.0, MAX_TEXTS / n)) for c, n in counts], "code string, g int, p double")
            chosen = x.join(F.broadcast(share), "code").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("p") * 1_000_000).select("g", "text")

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                cutter, held = Trigrams(), {}
                for b in batches:
                    g, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
                    for i in range(0, len(texts), 200):
                        bucket, of = cutter(texts[i : i + 200])
                        for k in np.unique(g[i : i + 200]):
                            held[k] = held.get(k, 0) + np.bincount(bucket[g[i : i + 200][of] == k], minlength=BUCKETS)
                for k, n in held.items():
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["g", "bucket", "n"])

            # At most languages x BUCKETS numbers.
            got = chosen.mapInArrow(count, "g int, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n")).toArrow()
            table[got.column("bucket").to_numpy(), got.column("g").to_numpy()] = got.column("n").to_numpy()
        self.log_p = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)


def told(log_p: np.ndarray, cutter: Trigrams, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest language, how much its mean log rate over trigrams exceeds the next's times their number).

    -1 and 0 for a text without letters or without two languages to choose from.
    """
    n = len(texts)
    if log_p.shape[1] < 2 or not n:
        return np.full(n, -1), np.zeros(n)
    bucket, of = cutter(texts)
    score = np.zeros((n, log_p.shape[1]))
    for k in range(log_p.shape[1]):
        score[:, k] = np.bincount(of, weights=log_p[bucket, k], minlength=n)
    some = np.bincount(of, minlength=n) > 0
    top = np.sort(score, axis=1)
    return np.where(some, score.argmax(axis=1), -1), np.where(some, top[:, -1] - top[:, -2], 0.0)
