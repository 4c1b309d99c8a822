"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is read as its letters, lower-cased, with one separator for any other character. Its bigrams and
trigrams of code points are hashed into buckets. Training counts buckets per language in Spark over a
bounded sample of labelled documents; the matrix of log probabilities (buckets times languages) is broadcast
to the workers, which score whole texts in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textvec import U64, chunks, mix, valid

UNKNOWN = "und"
#: Buckets are a power of two, 2**15 at most and so few that the matrix has no more than 2**CELL_BITS numbers (32 MB).
BUCKET_BITS, CELL_BITS = 15, 23
#: The expected number of training documents at most; with fewer labelled ones, all are used.
TRAIN_DOCS = 20_000

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point below 0x20000 -> the lower-case letter's code point, or 0 if it is no letter."""
    if not _LETTERS:
        table = np.zeros(0x20000, np.uint32)
        for i in range(0x20000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(table)
    return _LETTERS[0]


def ngrams(column: pa.Array, bits: int):
    """For parts of the column: (first row, bucket of every n-gram, the row of each, letters per row)."""
    table = letters()
    for c in map(valid, chunks(column)):
        points = np.frombuffer(c.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(c.per_row((c.data & 0xC0) != 0x80))])
        low = table[np.minimum(points, 0x1FFFF)]
        far = points >= 0x20000
        if far.any():
            low[far] = [p if chr(p).isalpha() else 0 for p in points[far].tolist()]
        row = np.repeat(np.arange(c.rows), np.diff(at))
        known = low > 0
        count = np.bincount(row[known], minlength=c.rows)
        # a separator before each row and for each run of other characters
        keep = known.copy()
        keep[1:] |= known[:-1]
        keep[at[:-1][np.diff(at) > 0]] = True
        seq, owner = low[keep].astype(U64), row[keep]
        out, rows = [], []
        for n in (2, 3):
            if len(seq) < n:
                continue
            gram = seq[: len(seq) - n + 1].copy()
            for k in range(1, n):
                gram = (gram << U64(21)) | seq[k : len(seq) - n + 1 + k]
            same = owner[: len(gram)] == owner[n - 1 :]
            out.append((mix(gram[same] + U64(n * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(64 - bits)).astype(np.int64))
            rows.append(owner[: len(gram)][same])
        empty = np.zeros(0, np.int64)
        yield c.first, (np.concatenate(out) if out else empty), (np.concatenate(rows) if rows else empty), count


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray
    bits: int = BUCKET_BITS

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        best = np.full(len(column), -1)
        score = np.zeros(len(column))
        for first, bucket, row, count in ngrams(column, self.bits):
            if not self.languages:
                continue
            n = len(count)
            total = np.tile(self.prior, (n, 1))
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, weights=self.log_prob[k][bucket], minlength=n)
            top = total.max(axis=1)
            share = 1.0 / np.exp(total - top[:, None]).sum(axis=1)
            has = count > 0
            best[first : first + n][has] = total.argmax(axis=1)[has]
            score[first : first + n][has] = share[has]
        return [self.languages[i] if i >= 0 else UNKNOWN for i in best.tolist()], score


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = TRAIN_DOCS, smoothing: float = 0.5) -> Model:
    """Fit on some `most` of the labelled rows, chosen by a hash of the whole row; null labels are left out.

    The languages are those of the chosen rows. Without labelled rows the model has no language and calls every
    text undetermined.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang is not null")
    total = rows.count()
    if total > most:
        rows = rows.filter(F.pmod(F.xxhash64("id", "text", "lang"), F.lit(1 << 40)) < int((1 << 40) * most / total))
    rows = rows.select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    bits = max(1, min(BUCKET_BITS, CELL_BITS - (max(len(languages), 1) - 1).bit_length()))

    def count(batches):
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            code, names = codes.indices.to_numpy(), codes.dictionary
            for first, bucket, row, _ in ngrams(batch.column(1), bits):
                cell, n = np.unique((code[first + row].astype(np.int64) << bits) | bucket, return_counts=True)
                own = pa.array((cell & ((1 << bits) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(cell >> bits)), own, pa.array(n)], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    index = {lang: k for k, lang in enumerate(languages)}
    table = np.full((len(languages), 1 << bits), smoothing)
    lang = np.array([index[x] for x in found["lang"].to_pylist()], np.int64)
    table[lang, found["bucket"].to_numpy()] += found["n"].to_numpy()
    log_prob = np.log(table) - np.log(table.sum(axis=1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in languages], float)) - np.log(max(sum(sizes.values()), 1))
    return Model(languages, log_prob.astype(np.float32), prior, bits)


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` of `docs` with lang_pred and score (0 to 1), from the whole texts alone.

    A null text, or one without letters, is `und` with score 0. Bytes that are no UTF-8 are no letters.
    """
    source = docs.select(*keep, F.col(f"`{text_col}`").alias("the text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lang, score = shared.value.score(batch.column(batch.num_columns - 1))
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % n


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; the model learns only from rows that are not held out.

    Rows whose id's remainder is 1 are held out. Null texts are `und`; texts of any length are read whole; ties
    go to the language that sorts first; repeated rows are predicted alike; an empty table gives no rows. Only the
    id, the text and the label are read, whatever other columns are called. Many languages share fewer buckets.
    """
    held_out = remainder(id_col, folds) == 1
    model = train(docs.filter(~held_out), id_col, text_col, lang_col, most)
    return predict(docs, model, [F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out")], text_col)
