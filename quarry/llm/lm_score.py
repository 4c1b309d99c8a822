"""Perplexity under an interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting. Each task counts its own words and bigrams in numpy and ships them as blocks of sorted arrays,
one row for each range of keys, so that the shuffle carries thirteen bytes a distinct bigram and no row
overhead. Words are 64-bit hashes, of which bigrams hold 48 bits. A reducer merges a range and writes it as sorted arrays below the shared folder. Ranges of
bigrams are cut at quantiles of a sample of keys; a key's high bits come from the context and its low
bits from the pair, so a context that a third of all bigrams have is spread over several ranges.

Model. `uni` files hold every training token's hash and count, `before` files its number of distinct
predecessors; `bi` files hold a range's bigram keys and counts, and each context's total and its numbers of
followers seen once, twice and more often. Discounts come from the counts of counts of the whole corpus.

Scoring. Workers memory-map the files, a bounded number at a time, and look up whole batches of sorted, distinct
keys at once.

Bigrams are the highest order: the whole of the trigrams, most of them seen once, would take more disk
than the counting may use (see README).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, make_dirs, mapped, opened, target_partitions, writing
from .language_id import remainder
from .simhash import sorted_groups
from .textvec import U64, Chunk, chunks, join2

END_TOKEN = U64(0x6C62272E07BB0142)
#: Bits of a word's hash that bigrams hold.
WORD_BITS = 48
CUT, WIDTH = U64(64 - WORD_BITS), WORD_BITS // 8
START = U64(0x27D4EB2F165667C5) >> CUT
#: Training tokens for each range of keys, and distinct bigrams that a task holds before it ships them.
TOKENS_PER_RANGE, HELD = 2_000_000, 700_000


# --- tokens and keys -------------------------------------------------------------------------------


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's words and its end, and `at`: row i has at[i]:at[i + 1]."""
    starts, ends, at = c.words()
    out_at = at + np.arange(len(at))
    out = np.full(out_at[-1], END_TOKEN, U64)
    row = np.repeat(np.arange(c.rows), np.diff(at))
    out[np.arange(len(starts)) + row] = c.hashes(starts, ends)
    return out, out_at


def pairs(token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context and word of each token, cut to WORD_BITS; a row's first has the start as its context."""
    word = token >> CUT
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[at[:-1]] = START
    return context, word


def high_bits(context: np.ndarray) -> np.ndarray:
    """The 24 bits of a context that its bigrams' keys begin with."""
    return context >> U64(WORD_BITS - 24)


def bigram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """24 bits of the context, then 40 of the pair."""
    return (high_bits(context) << U64(40)) | (join2(context, word) >> U64(24))


def token_range(token: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of hashes; sorted hashes give sorted ranges."""
    return (((token >> U64(40)) * U64(n)) >> U64(24)).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, the highest byte of all first: sorted numbers compress well."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros(raw.shape[1], U64)
    for plane in raw:
        out = (out << U64(8)) | plane
    return out


def _counts(n: np.ndarray) -> bytes:
    """Counts below 255 as bytes; of larger ones 255, and the whole numbers after all bytes."""
    small = np.minimum(n, 255).astype(np.uint8)
    return small.tobytes() + n[small == 255].astype("<u8").tobytes()


def _uncounts(data: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=size).astype(np.int64)
    return out


def merge(key: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with their summed counts, and for each the values of one of its rows."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    return key[first], total, *(x[order][first] for x in more)


# --- files -----------------------------------------------------------------------------------------

KINDS = ("<u8", "<i8", "<u4", "|u1")


def _put(path: str, **arrays: np.ndarray) -> None:
    """One file of named arrays: how many, their lengths and kinds, then each at a multiple of eight bytes."""
    head = np.array([len(arrays), *(x for a in arrays.values() for x in (len(a), KINDS.index(a.dtype.str)))], np.int64)
    with writing(path) as f:
        f.write(head.tobytes())
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))


def _parse(buffer) -> list[np.ndarray]:
    head = np.frombuffer(buffer, np.int64, 1)
    head = np.frombuffer(buffer, np.int64, 1 + 2 * int(head[0]))
    at, out = head.nbytes, []
    for n, kind in head[1:].reshape(-1, 2).tolist():
        out.append(np.frombuffer(buffer, KINDS[kind], n, at))
        at += out[-1].nbytes + -out[-1].nbytes % 8
    return out


def _get(path: str) -> list[np.ndarray] | None:
    """The file's arrays, memory-mapped; None if the range is empty and has no file."""
    return opened(path, _parse)


# --- counting --------------------------------------------------------------------------------------

BLOCK = "kind int, part int, a binary, b binary, n binary"


def _block(rows: list[tuple[int, int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    kind, part, a, b, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in (a, b, n))], ["kind", "part", "a", "b", "n"]
    )


def _cells(part: np.ndarray):
    """(part, from, to) for sorted part numbers."""
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[s]), s, e


def _by_part(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.repartitionById(parts, F.greatest("part", F.lit(0))).select("part", "kind", "a", "b", "n").sortWithinPartitions("part")


def _rows(table: list[pa.RecordBatch]):
    for batch in table:
        yield from zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)


def count_tokens(texts: DataFrame, path: str, parts: int) -> tuple[int, int]:
    """Write the uni ranges: all tokens' hashes and counts. Returns the tokens and the distinct ones."""

    def count(batches):
        held = [(np.zeros(0, U64), np.zeros(0, np.int64))]

        def ship():
            key, n = merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held[:] = [(np.zeros(0, U64), np.zeros(0, np.int64))]
            rows = [(0, p, key[s:e].tobytes(), b"", _counts(n[s:e])) for p, s, e in _cells(token_range(key, parts))]
            return [_block(rows)] if rows else []

        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                held.append(np.unique(tokens(c)[0], return_counts=True))
                if sum(len(x[0]) for x in held) > 2 * HELD:
                    held[:] = [merge(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD:
                        yield from ship()
        yield from ship()

    def reduce(batches):
        for table in sorted_groups(batches, single=True):
            part = table[0].column(0)[0].as_py()
            found = [(np.frombuffer(a, U64), _uncounts(n, len(a) // 8)) for _, a, _, n in _rows(table)]
            key, n = merge(*(np.concatenate(x) for x in zip(*found, strict=True)))
            _put(f"{path}/{part}.uni", hash=key, count=n)
            yield pa.RecordBatch.from_arrays([pa.array([len(key)]), pa.array([int(n.sum())])], ["words", "tokens"])

    total = _by_part(texts.mapInArrow(count, BLOCK), parts).mapInArrow(reduce, "words long, tokens long").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))
    )
    return tuple(total.first())


def range_bounds(texts: DataFrame, parts: int, share: int = 64) -> np.ndarray:
    """Keys that cut the distinct bigrams into ranges of like size, from those of one text in `share`."""
    if parts == 1:
        return np.zeros(0, U64)

    def keys(batches):
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                key = np.unique(bigram_key(*pairs(*tokens(c)))) ^ U64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).mapInArrow(keys, "key long")
    found = sample.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    if found is None:
        return (np.arange(1, parts).astype(U64) << U64(40)) // U64(parts) << U64(24)
    return np.unique(np.array(found, np.int64).view(U64) ^ U64(1 << 63))


@dataclass
class Model:
    path: str
    parts: int
    bounds: np.ndarray
    train_tokens: int
    words: int
    discount: np.ndarray
    word_discount: np.ndarray
    word_total: int
    word_backoff: float
    #: contexts that several ranges share: context -> (total, once, twice, more)
    split: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)


def _stats(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct context, its total, and how many followers it has once, twice and more often."""
    order = np.argsort(context, kind="stable")
    key, n = context[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    cols = [np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)]
    return key[first], *cols


def count_bigrams(texts: DataFrame, path: str, parts: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int, dict]:
    """Write the bi and ctx ranges and the words' predecessors.

    Returns the counts of counts 1 to 4 of bigrams and of words, the distinct bigrams, how many words
    have three predecessors or more, and the contexts that lie in several ranges.
    """

    def count(batches):
        empty = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
        held = [empty]

        def ship():
            key, n, context, word = merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held[:] = [empty]
            part = np.searchsorted(bounds, key, "right")
            rows = [(1, p, _planes(context[s:e], WIDTH), _planes(word[s:e], WIDTH), _counts(n[s:e])) for p, s, e in _cells(part)]
            return [_block(rows)] if rows else []

        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                context, word = pairs(*tokens(c))
                key = bigram_key(context, word)
                held.append(merge(key, np.ones(len(key), np.int64), context, word))
                if sum(len(x[0]) for x in held) > 2 * HELD:
                    held[:] = [merge(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD:
                        yield from ship()
        yield from ship()

    def reduce(batches):
        for table in sorted_groups(batches, single=True):
            part = table[0].column(0)[0].as_py()
            found = []
            for _, a, b, n in _rows(table):
                context, word = _unplanes(a, WIDTH), _unplanes(b, WIDTH)
                found.append((bigram_key(context, word), _uncounts(n, len(context)), context, word))
            del table
            key, n, context, word = merge(*(np.concatenate(x) for x in zip(*found, strict=True)))
            del found
            small = np.minimum(n, 255).astype(np.uint8)
            stats = _stats(context, n)
            one, two, more = (x.astype(np.uint32) for x in stats[2:])
            _put(f"{path}/{part}.bi", key=key, count=small, large=n[small == 255], context=stats[0], total=stats[1], one=one, two=two, more=more)
            # what the neighbouring ranges may hold too
            high = high_bits(stats[0])
            edge = np.zeros(len(high), bool)
            for bound in (bounds[part - 1 : part], bounds[part : part + 1]):
                if len(bound):
                    edge |= high == bound[0] >> U64(40)
            shared = np.stack([x[edge].astype(np.int64) for x in stats])
            census = np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], np.int64)
            word, seen = np.unique(word, return_counts=True)
            rows = [(3, -1, census.tobytes(), shared.tobytes(), b"")]
            rows += [(2, p, _planes(word[s:e], WIDTH), b"", _counts(seen[s:e])) for p, s, e in _cells(token_range(word << CUT, parts))]
            yield _block(rows)

    def finish(batches):
        """Predecessors of the words of a range, beside their counts; the census goes on to the driver."""
        for table in sorted_groups(batches, single=True):
            part = table[0].column(0)[0].as_py()
            if part < 0:
                yield _block([(kind, part, a, b, n) for kind, a, b, n in _rows(table)])
                continue
            found = [(_unplanes(a, WIDTH), _uncounts(n, len(a) // WIDTH)) for _, a, _, n in _rows(table)]
            word, seen = merge(*(np.concatenate(x) for x in zip(*found, strict=True)))
            own = _parse(mapped(f"{path}/{part}.uni"))[0] >> CUT
            at = np.minimum(np.searchsorted(word, own), len(word) - 1)
            seen = np.where(word[at] == own, seen[at], 0)
            _put(f"{path}/{part}.before", before=seen.astype(np.uint32))
            census = np.array([(seen == k).sum() for k in (1, 2, 3, 4)] + [(seen >= 3).sum(), seen.sum()], np.int64)
            yield _block([(4, part, census.tobytes(), b"", b"")])

    blocks = _by_part(texts.mapInArrow(count, BLOCK), parts).mapInArrow(reduce, BLOCK)
    census = _by_part(blocks, parts).mapInArrow(finish, BLOCK).collect()
    pair_counts, word_counts = np.zeros(5, np.int64), np.zeros(6, np.int64)
    shared: dict[int, list[np.ndarray]] = {}
    for r in census:
        if r["kind"] == 3:
            pair_counts += np.frombuffer(r["a"], np.int64)
            for column in np.frombuffer(r["b"], np.int64).reshape(5, -1).T:
                shared.setdefault(int(column[0]), []).append(column[1:])
        else:
            word_counts += np.frombuffer(r["a"], np.int64)
    split = {k: tuple(int(v) for v in np.sum(x, axis=0)) for k, x in shared.items() if len(x) > 1}
    return pair_counts[:4], word_counts[:4], int(word_counts[5]), int(word_counts[4]), split


def discounts(counts: np.ndarray) -> np.ndarray:
    """D0 = 0, D1, D2, D3+ of modified Kneser-Ney from the numbers of things seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [0.0]
    for k, (this, then) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        value = k - (k + 1) * y * then / this if this else 0.5 * k
        out.append(min(max(value, 0.05), k - 0.05))
    return np.array(out)


def train(texts: DataFrame, tokens_per_range: int = TOKENS_PER_RANGE) -> Model:
    """Count the rows' `text` and write the model below the shared folder."""
    spark = texts.sparkSession
    path = fresh(spark, "lm")
    make_dirs(spark, path)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    parts = target_partitions(size // 6, tokens_per_range, 2)
    n_tokens, words = count_tokens(texts, path, parts)
    bounds = range_bounds(texts, parts)
    pair_counts, word_counts, total, many, split = count_bigrams(texts, path, parts, bounds)
    d, dw = discounts(pair_counts), discounts(word_counts)
    backoff = (dw[1] * word_counts[0] + dw[2] * word_counts[1] + dw[3] * many) / total if total else 1.0
    return Model(path, parts, bounds, n_tokens, words, d, dw, total, float(backoff), split)


# --- scoring ---------------------------------------------------------------------------------------


def _find(keys: np.ndarray, query: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The place of each query among sorted keys (-1: not there), and each column's value at it (0)."""
    at = np.minimum(np.searchsorted(keys, query), max(len(keys) - 1, 0))
    hit = keys[at] == query if len(keys) else np.zeros(len(query), bool)
    return np.where(hit, at, -1), *(np.where(hit, c[at], 0).astype(np.int64) if len(keys) else np.zeros(len(query), np.int64) for c in columns)


def find_words(model: Model, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts and numbers of predecessors of sorted distinct hashes."""
    count, before = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    for p, s, e in _cells(token_range(word, model.parts)):
        if (own := _get(f"{model.path}/{p}.uni")) is not None:
            seen = _get(f"{model.path}/{p}.before")
            _, count[s:e], before[s:e] = _find(own[0], word[s:e], own[1], seen[0] if seen is not None else np.zeros(len(own[0]), np.int64))
    return count, before


def find_contexts(model: Model, context: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """What sorted distinct contexts have in the given ranges: total, once, twice, more."""
    sums = [np.zeros(len(context), np.int64) for _ in range(4)]
    for p, s, e in _cells(part):
        if (own := _get(f"{model.path}/{p}.bi")) is not None:
            for x, y in zip(sums, _find(own[3], context[s:e], *own[4:])[1:], strict=True):
                x[s:e] = y
    return sums


def find_bigrams(model: Model, key: np.ndarray) -> np.ndarray:
    """The counts of sorted distinct keys."""
    n = np.zeros(len(key), np.int64)
    for p, s, e in _cells(np.searchsorted(model.bounds, key, "right")):
        if (own := _get(f"{model.path}/{p}.bi")) is not None:
            at, found = _find(own[0], key[s:e], own[1])
            if (large := found == 255).any():
                found[large] = own[2][np.searchsorted(np.flatnonzero(own[1] == 255), at[large])]
            n[s:e] = found
    return n


def score_chunk(model: Model, c: Chunk) -> tuple[np.ndarray, ...]:
    """Per row: tokens, known tokens, the base score and the model's score."""
    token, at = tokens(c)
    row = np.repeat(np.arange(c.rows), np.diff(at))
    unique, back = np.unique(token, return_inverse=True)
    count, before = find_words(model, unique)
    base = np.log10((count + 0.5) / (model.train_tokens + 0.5 * (model.words + 1)))
    total = max(model.word_total, 1)
    low = np.maximum(before - model.word_discount[np.minimum(before, 3)], 0) / total + model.word_backoff / (model.words + 1)

    context, word = pairs(token, at)
    ctx, ctx_back = np.unique(context, return_inverse=True)
    # a context's entries lie where its keys do: those that several ranges share come from `split`
    high = high_bits(ctx) << U64(40)
    part = np.searchsorted(model.bounds, high, "right")
    sums = find_contexts(model, ctx, part)
    last = np.searchsorted(model.bounds, high | U64((1 << 40) - 1), "right")
    for k in np.flatnonzero(part != last).tolist():
        own = model.split.get(int(ctx[k]))
        if own is None:
            for p in range(int(part[k]) + 1, int(last[k]) + 1):
                if sums[0][k]:
                    break
                for x, y in zip(sums, find_contexts(model, ctx[k : k + 1], np.array([p])), strict=True):
                    x[k] = y[0]
        else:
            for x, y in zip(sums, own, strict=True):
                x[k] = y
    d = model.discount
    whole = np.maximum(sums[0], 1)
    backoff = np.where(sums[0] > 0, (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / whole, 1.0)

    key, key_first, key_back = np.unique(bigram_key(context, word), return_index=True, return_inverse=True)
    n = find_bigrams(model, key)
    ctx_of = ctx_back[key_first]
    n = np.where(sums[0][ctx_of] > 0, n, 0)
    follows = np.maximum(n - d[np.minimum(n, 3)], 0) / whole[ctx_of]
    p = follows[key_back] + backoff[ctx_back] * low[back]
    rows = c.rows
    return (
        np.diff(at),
        np.bincount(row, weights=(count > 0)[back], minlength=rows).astype(np.int64),
        np.bincount(row, weights=base[back], minlength=rows),
        np.bincount(row, weights=np.log10(p), minlength=rows),
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, tokens_per_range: int = TOKENS_PER_RANGE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`.

    The model learns from the rows whose id's remainder is not 1. A null text is empty: its one token is
    the end. A null id counts as empty text in the remainder. Texts of any length are scored whole, as bytes.
    Repeated rows count each and are scored alike; an empty table gives no rows. With no training rows every
    token has probability 1. Only the id and the text are read, whatever other columns are called.
    """
    held_out = remainder(id_col, folds) == 1
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    model = train(docs.filter(~held_out).select(text), tokens_per_range)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out"), text)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for batch in batches:
            parts = [score_chunk(model, c) for c in chunks(batch.column(2), lower=True)]
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
            n, known, base, total = (pa.array(x) for x in found)
            train_tokens = pa.array(np.full(batch.num_rows, model.train_tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, known, train_tokens, base, total], names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
