"""Lookup and ranking.

Terms meet the dictionary first, which is far smaller than the postings: equalities by hash join,
prefixes, infixes and ranges by a broadcast of the query side, which is a block of bounded size; what
matches is joined to the postings on the term. A page's matches are bits of a number for each query, and its score
is the sum of what their terms add.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .index import Index, with_parts
from .query import SearchOptions, compile_terms, query_frame

#: Query terms that are broadcast at once; more are taken in blocks.
BLOCK_TERMS = 10_000
#: Matched terms, of 63 bytes at most each, that are broadcast to the postings.
BROADCAST_TERMS = 100_000
#: Tests that are put to the postings themselves where their terms are too many to broadcast.
DIRECT_TESTS = 8
#: Terms of a query whose matches are one number.
WORD_BITS = 62
#: Pages of one score that are numbered together.
CELL_PAGES = 50_000


def matches_text(kind_field: bool, mode: str, text: str, right_partial_only: bool = False) -> Column:
    """The predicate on dictionary rows for a text, or for a value within its field."""
    own = F.col("value") if kind_field else F.col("term")
    query = F.lit(text)
    if mode.endswith("_ci"):
        own, query = (F.lower(F.col("value")) if kind_field else F.col("term_lc")), F.lower(query)
    if mode.startswith("exact"):
        return own == query
    return own.startswith(query) if right_partial_only else own.contains(query)


def find(index: Index, text: str, mode: str = "infix", case_sensitive: bool = False, field: str | None = None) -> DataFrame:
    """The pages (page_id) with a term that matches: mode exact, prefix or infix, in one field if given."""
    compiled = "exact" if mode == "exact" else "partial"
    predicate = matches_text(field is not None, f"{compiled}_{'cs' if case_sensitive else 'ci'}", text, mode == "prefix")
    if field is not None:
        predicate = (F.col("field") == field) & predicate
    return pages_of(index, index.dictionary.filter(predicate))


def find_number(index: Index, name: str, sign: str, bound: str, case_sensitive: bool = True) -> DataFrame:
    """The pages with a meta value `name=n`, n strictly above (`>`) or below (`<`) the bound's leading number."""
    from ..functions.terms import bound_number

    own, query = (F.col("meta_name"), F.lit(name)) if case_sensitive else (F.lower("meta_name"), F.lower(F.lit(name)))
    limit = bound_number(F.lit(bound))
    inside = F.col("meta_num") > limit if sign == ">" else F.col("meta_num") < limit
    return pages_of(index, index.dictionary.filter((own == query) & inside))


def pages_of(index: Index, terms: DataFrame) -> DataFrame:
    return index.postings.join(terms.select("term"), "term", "left_semi").select("page_id").distinct()


class Block:
    """The compiled terms of one block, BLOCK_TERMS at most, on the driver: their size is known and no expression is carried on.

    A query's terms are bits of its words, WORD_BITS to each, so that a page's matches are a number for each query and word.
    Terms that match alike, in whichever queries, are one test.
    """

    def __init__(self, spark: SparkSession, table: pa.Table, schema: StructType):
        self.spark, self.schema, self.table = spark, schema, table
        self.rows = table.to_pylist()
        self.tests: dict[tuple, int] = {}
        #: the test of each row
        self.test: list[int] = []
        #: (query_id, ord) to its number in the query
        self.number: dict[tuple[int, int], int] = {}
        sizes: dict[int, int] = {}
        for r in self.rows:
            self.test.append(self.tests.setdefault(tuple(r[k] for k in ("kind", "mode", "text", "field", "value", "name", "bound")), len(self.tests)))
            if (r["query_id"], r["ord"]) not in self.number:
                self.number[r["query_id"], r["ord"]] = sizes.get(r["query_id"], 0)
                sizes[r["query_id"]] = sizes.get(r["query_id"], 0) + 1
        self.words = -(-max(sizes.values(), default=1) // WORD_BITS)

    def alone(self, i: int) -> Block:
        return Block(self.spark, self.table.slice(i, 1), self.schema)

    def twins(self) -> list[tuple[int, int, int]]:
        """(query_id, ord of a field term, ord of the plain term that its pages count for too)."""
        plain: dict[tuple[int, str, str], list[int]] = {}
        for r in self.rows:
            if r["kind"] == "word":
                plain.setdefault((r["query_id"], r["mode"], r["text"].lower()), []).append(r["ord"])
        return [
            (r["query_id"], r["ord"], base)
            for r in self.rows
            if r["kind"] == "field"
            for base in plain.get((r["query_id"], r["mode"], r["value"].lower()), [])
        ]

    def marks(self) -> DataFrame:
        """(test, query_id, word, mask): the bits of the terms of each test, with those of the plain terms that they count for too."""
        bases: dict[tuple[int, int], list[int]] = {}
        for query, own, base in self.twins():
            bases.setdefault((query, own), []).append(base)
        masks: dict[tuple[int, int, int], int] = {}
        for r, test in zip(self.rows, self.test, strict=True):
            query = r["query_id"]
            for k in (r["ord"], *bases.get((query, r["ord"]), [])):
                word, bit = divmod(self.number[query, k], WORD_BITS)
                masks[test, query, word] = masks.get((test, query, word), 0) | 1 << bit
        return self.local([(*key, mask) for key, mask in masks.items()], ["test", "query_id", "word", "mask"])

    def signs(self) -> tuple[DataFrame, int]:
        """(query_id, word, signs): what each bit of a word adds to a page's score; and the bits that any word has."""
        found: dict[tuple[int, int], list[int]] = {}
        for r in self.rows:
            word, bit = divmod(self.number[r["query_id"], r["ord"]], WORD_BITS)
            own = found.setdefault((r["query_id"], word), [])
            own.extend([0] * (bit + 1 - len(own)))
            own[bit] += r["signed"]
        bits = max(map(len, found.values()), default=0)
        columns = {
            "query_id": pa.array([q for q, _ in found], pa.int32()),
            "word": pa.array([w for _, w in found], pa.int32()),
            "signs": pa.array([x + [0] * (bits - len(x)) for x in found.values()], pa.list_(pa.int32())),
        }
        return F.broadcast(self.spark.createDataFrame(pa.table(columns), "query_id int, word int, signs array<int>")), bits

    def local(self, rows: list[tuple], names: list[str]) -> DataFrame:
        columns = [pa.array([r[k] for r in rows], pa.int64() if n == "mask" else pa.int32()) for k, n in enumerate(names)]
        return F.broadcast(self.spark.createDataFrame(pa.table(dict(zip(names, columns, strict=True)))))


def _test(r: dict, options: SearchOptions) -> Column:
    """The predicate of one compiled term on rows with the parts of their terms."""
    if r["kind"] == "all":
        return F.lit(True)
    if r["kind"] in ("word", "field"):
        own = matches_text(r["kind"] == "field", r["mode"], r["value"] if r["kind"] == "field" else r["text"], options.right_partial_only)
        return (F.col("field") == r["field"]) & own if r["kind"] == "field" else own
    sensitive = r["mode"].endswith("_cs")
    if r["kind"] == "eq":
        return matches_text(False, "exact_cs" if sensitive else "exact_ci", r["text"])
    name, query = (F.col("meta_name"), F.lit(r["name"])) if sensitive else (F.lower("meta_name"), F.lower(F.lit(r["name"])))
    bound = F.lit(r["bound"]).cast("bigint")
    return (name == query) & (F.col("meta_num") > bound if r["kind"] == "gt" else F.col("meta_num") < bound)


def _matched_terms(block: Block, dictionary: DataFrame, options: SearchOptions) -> DataFrame | None:
    """(test, term) for all terms but `*`: each way of matching that occurs is a join of the dictionary with its tests."""
    first = {test: r for r, test in zip(reversed(block.rows), reversed(block.test), strict=True)}
    present = {(r["kind"], r["mode"]) for r in block.rows}
    tests = pa.Table.from_pylist([{"test": t, **first[t]} for t in sorted(first)], pa.schema([pa.field("test", pa.int32()), *block.table.schema]))
    terms = block.spark.createDataFrame(tests, StructType([StructField("test", IntegerType()), *block.schema]))
    q = terms.select("test", "kind", "mode", F.col("text").alias("q_text"), F.lower("text").alias("q_lc"), F.col("field").alias("q_field"),
                     F.col("value").alias("q_value"), F.lower("value").alias("q_value_lc"), "name", "bound")

    def within(own: Column, query: Column) -> Column:
        return own.startswith(query) if options.right_partial_only else own.contains(query)

    field = F.col("q_field") == F.col("field")
    low = F.lower(F.col("value"))
    ways = {
        ("word", "exact_cs"): F.col("q_text") == F.col("term"),
        ("word", "exact_ci"): F.col("q_lc") == F.col("term_lc"),
        ("word", "partial_cs"): within(F.col("term"), F.col("q_text")),
        ("word", "partial_ci"): within(F.col("term_lc"), F.col("q_lc")),
        ("field", "exact_cs"): field & (F.col("q_value") == F.col("value")),
        ("field", "exact_ci"): field & (F.col("q_value_lc") == low),
        ("field", "partial_cs"): field & within(F.col("value"), F.col("q_value")),
        ("field", "partial_ci"): field & within(low, F.col("q_value_lc")),
    }
    for mode in ("exact", "partial"):
        ways["eq", f"{mode}_cs"] = ways["word", "exact_cs"]
        ways["eq", f"{mode}_ci"] = ways["word", "exact_ci"]
        for kind, inside in (("gt", F.col("meta_num") > F.col("bound")), ("lt", F.col("meta_num") < F.col("bound"))):
            ways[kind, f"{mode}_cs"] = (F.col("name") == F.col("meta_name")) & inside
            ways[kind, f"{mode}_ci"] = (F.lower("name") == F.lower("meta_name")) & inside
    out = []
    for kind, mode in sorted(present & set(ways)):
        own = q.filter((F.col("kind") == kind) & (F.col("mode") == mode))
        out.append(dictionary.join(F.broadcast(own), ways[kind, mode]).select("test", "term"))
    return reduce(DataFrame.unionByName, out) if out else None


def lookup(index: Index, block: Block, options: SearchOptions, dictionary: DataFrame | None = None) -> tuple[DataFrame, set[tuple[int, int]]]:
    """(query_id, word, page_id, mask), one row each: the bits of the terms that a page has, a plain term's also where it has its field twin; and the terms that have any page.

    The twin is a `FIELD:word` of the same query and mode whose value equals the plain term but for case.
    Few matched terms are broadcast to the postings. Of many, the tests that match most are put to the postings themselves, DIRECT_TESTS
    at most; only what is many still is joined by shuffle.
    """
    first = {test: r for r, test in zip(reversed(block.rows), reversed(block.test), strict=True)}
    direct = {t for t, r in first.items() if r["kind"] == "all"}
    have, parts = set(direct), []
    terms = _matched_terms(block, dictionary if dictionary is not None else index.dictionary, options)
    if terms is not None:
        some = terms.limit(BROADCAST_TERMS + 1).toArrow()
        if some.num_rows <= BROADCAST_TERMS:
            have |= set(some["test"].to_pylist())
        else:
            counts = {r["test"]: r["n"] for r in terms.groupBy("test").agg(F.count("*").alias("n")).toArrow().to_pylist()}
            # a term of the dictionary has a page, so that the postings need not be asked
            have |= set(counts)
            most = sorted(counts, key=lambda t: -counts[t])
            k = 0
            while k < min(DIRECT_TESTS, len(most)) and sum(counts[t] for t in most[k:]) > BROADCAST_TERMS:
                k += 1
            direct |= set(most[:k])
            terms = terms.filter(F.col("test").isin(most[k:]))
            some = terms.toArrow() if sum(counts[t] for t in most[k:]) <= BROADCAST_TERMS else None
        if some is None:
            parts.append(index.postings.select("term", "page_id").join(terms.hint("shuffle_hash"), "term").select("test", "page_id"))
        elif some.num_rows:
            own = F.broadcast(block.spark.createDataFrame(some, terms.schema))
            parts.append(index.postings.select("term", "page_id").join(own, "term").select("test", "page_id"))
    if direct:
        own = {t: _test(first[t], options) for t in sorted(direct)}
        tests = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in own.items()]))
        rows = with_parts(index.postings.select("term", "page_id")).filter(reduce(Column.__or__, own.values()))
        parts.append(rows.select("page_id", F.explode(tests).alias("test")).select("test", "page_id"))
    found = reduce(DataFrame.unionByName, parts) if parts else block.spark.createDataFrame([], "test int, page_id bigint")
    # a page's postings lie together where it was indexed, so that most of this is done before the shuffle
    found = found.join(block.marks(), "test").groupBy("query_id", "word", "page_id").agg(F.bit_or("mask").alias("mask"))
    return found, {(r["query_id"], r["ord"]) for r, test in zip(block.rows, block.test, strict=True) if test in have}


def rank(found: DataFrame, present: set[tuple[int, int]], block: Block, options: SearchOptions) -> DataFrame:
    """(query_id, page_id, score, threshold, max_quality) of the pages above their query's threshold, from what `lookup` gives.

    A query with a mandatory term that no page has gives nothing: `present` has the (query_id, ord) of the terms with pages of their own.
    """
    present = present | {(q, base) for q, own, base in block.twins() if (q, own) in present}
    signs, bits = block.signs()
    score = reduce(Column.__add__, [F.shiftright("mask", k).bitwiseAND(F.lit(1)).cast("int") * F.get("signs", F.lit(k)) for k in range(bits)], F.lit(0))
    scores = found.join(signs, ["query_id", "word"]).select("query_id", "page_id", score.alias("score"))
    if block.words > 1:
        scores = scores.groupBy("query_id", "page_id").agg(F.sum("score").cast("int").alias("score"))
    totals: dict[int, list[int]] = {}
    for r in block.rows:
        own = totals.setdefault(r["query_id"], [0, 0])
        own[0] += options.mandatory_bonus * (r["occ"] == "+")
        own[1] += r["weight"]
    missing = {r["query_id"] for r in block.rows if r["occ"] == "+" and (r["query_id"], r["ord"]) not in present}
    whole = [(q, *own) for q, own in totals.items() if q not in missing]
    return (
        scores.join(block.local(whole, ["query_id", "threshold", "max_quality"]), "query_id")
        .filter(F.col("score") > F.col("threshold"))
        .select("query_id", "page_id", "score", "threshold", "max_quality")
    )


def with_quality(ranked: DataFrame, limit: int = -1) -> DataFrame:
    """`ranked` with position (from 0, by score, then page) and quality_pct (1 to 100); the first `limit` of each query, or all.

    A page's quality is its share of the most that its query could give, drawn towards the mean of up to
    three pages before it, less a few points for late positions of long results.

    No task ever holds a query's whole result. The pages of one score lie in cells of page ids, some CELL_PAGES each;
    counting the cells gives where each begins, and what the three pages before its first one have. Only
    within a cell are pages numbered. `ranked` holds a block of queries, so a row for each is small.
    """
    q, n = F.col("q"), F.col("n")
    totals = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    width = F.expr("(high - low) div ceil(n / CELL) + 1".replace("CELL", str(CELL_PAGES)))
    rows = ranked.join(F.broadcast(totals.select("query_id", "n", "low", width.alias("width"))), "query_id")
    rows = rows.select("*", (F.col("score") - F.col("threshold")).alias("q"), F.expr("(page_id - low) div width").alias("cell")).drop("low", "width")

    cells = rows.groupBy("query_id", "score", "cell").agg(F.count("*").alias("size"), F.first("q").alias("q"))
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score"), "cell")
    # three cells hold the three pages before a cell's first one
    three = F.collect_list(F.struct("q", "size")).over(in_order.rowsBetween(-3, -1))
    values = F.flatten(F.transform(three, lambda x: F.array_repeat(x["q"], F.least(x["size"], F.lit(3)).cast("int"))))
    places = cells.select("query_id", "score", "cell", (F.sum("size").over(in_order) - F.col("size")).alias("before"), F.reverse(values).alias("last"))

    own = Window.partitionBy("query_id", "score", "cell").orderBy("page_id")
    df = rows.withColumn("number", F.row_number().over(own))
    if limit >= 0:
        df = df.filter(F.col("number") <= limit)
        places = places.filter(F.col("before") < limit)
    df = df.join(places, ["query_id", "score", "cell"]).withColumn("position", F.col("before") + F.col("number") - 1)
    if limit >= 0:
        df = df.filter(F.col("position") < limit)
    i = F.col("position")
    df = df.withColumn("alike", F.least(F.col("number") - 1, F.lit(3)).cast("int")).withColumn("k", F.least(i, F.lit(3)))
    others = F.aggregate(F.slice("last", F.lit(1), F.lit(3) - F.col("alike")), F.lit(0).cast("bigint"), lambda x, y: x + y)
    df = df.withColumn("sum", F.col("alike") * q + others)
    df = df.withColumn("gap", F.when(i > 0, F.expr("(sum div k - q) div (5 - k)")).otherwise(F.lit(0)))
    df = df.withColumn("base", F.when(n > 10000, 30).when(n > 5000, 20).otherwise(10))
    df = df.withColumn("weak", F.expr("least(10, (base * position) div n)"))
    df = df.withColumn("pct", F.expr("((q + gap) * 100) div max_quality"))
    quality = F.when(i == 0, F.col("pct")).otherwise(F.greatest(F.lit(1), F.col("pct") - F.col("weak")))
    return df.select("query_id", "page_id", "score", i.cast("int").alias("position"), quality.cast("int").alias("quality_pct"), "threshold", "max_quality")


def ranker_maximum(compiled: DataFrame, options: SearchOptions) -> DataFrame:
    """(query_id, maximum): the most that a page can score above its query's threshold."""
    mandatory = F.sum(F.when(F.col("occ") == "+", 1).otherwise(0)) * options.mandatory_bonus
    return compiled.groupBy("query_id").agg((F.sum(F.greatest("signed", F.lit(0))) - mandatory).cast("int").alias("maximum"))


def search(
    index: Index,
    query: str | list[str] | DataFrame,
    options: SearchOptions | None = None,
    weak_words: DataFrame | None = None,
    limit: int = -1,
    include_pending: bool = True,
    dictionary: DataFrame | None = None,
    cache: CachedSearch | None = None,
) -> DataFrame:
    """(query_id, page_id, score, position, quality_pct, ...) for one query, several, or a table of query terms.

    limit: the first so many results of each query, -1 for all. Without `include_pending` the index is
    searched as it will be after the purge, and `dictionary`, the index's own, is not used. A `cache` of the same index and options looks terms up that it has not kept.
    """
    options = options or SearchOptions()
    terms = query if isinstance(query, DataFrame) else query_frame(index.postings.sparkSession, query)
    if not include_pending:
        index, dictionary = index.purge(), None
    result = None
    for block in _blocks(terms, options, weak_words):
        found, present = cache.lookup(block) if cache is not None else lookup(index, block, options, dictionary)
        own = with_quality(rank(found, present, block, options), limit)
        result = own if result is None else result.unionByName(own)
    return result


def _blocks(terms: DataFrame, options: SearchOptions, weak_words: DataFrame | None) -> Iterator[Block]:
    """The compiled query terms in blocks; those of one query stay together."""
    compiled = compile_terms(terms, options, weak_words)
    first = compiled.limit(BLOCK_TERMS + 1).toArrow()
    if first.num_rows <= BLOCK_TERMS:
        yield Block(terms.sparkSession, first, compiled.schema)
        return
    blocks = -(-terms.count() // BLOCK_TERMS)
    for b in range(blocks):
        part = compile_terms(terms.filter(F.pmod(F.hash("query_id"), F.lit(blocks)) == b), options, weak_words)
        yield Block(terms.sparkSession, part.toArrow(), part.schema)


def render(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Result rows with the pages' metadata (page_id and whatever else `pages` has) and a shown index from 1."""
    return results.join(pages, "page_id", "left").withColumn("shown_index", F.col("position") + 1)


@dataclass
class CachedSearch:
    """Lookups of one index kept for `life` seconds from when they are read, with the counters of a four-level cache.

    `dictionary` is the index's own, where it is kept.
    """

    index: Index
    options: SearchOptions = field(default_factory=SearchOptions)
    life: float = 60.0
    _kept: dict[tuple[str, str], tuple[float, DataFrame]] = field(default_factory=dict)
    requests: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("exact_cs", "exact_ci", "partial_cs", "partial_ci"), 0))
    hits: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("exact_cs", "exact_ci", "partial_cs", "partial_ci"), 0))
    dictionary: DataFrame | None = None

    def find(self, text: str, mode: str = "partial_ci") -> DataFrame:
        """The pages of a word."""

        def look_up() -> DataFrame:
            style = "exact" if mode.startswith("exact") else "prefix" if self.options.right_partial_only else "infix"
            return find(self.index, text, style, mode.endswith("_cs"))

        self.invalidate(self.life)
        return self._get(mode, text, look_up)

    def lookup(self, block: Block) -> tuple[DataFrame, set[tuple[int, int]]]:
        """As `lookup`: the block's terms, each from the cache or looked up once."""
        self.invalidate(self.life)
        known, frames = set(self._kept), []
        for r, test, i in zip(block.rows, block.test, range(len(block.rows)), strict=True):
            pages = self._get(r["mode"], r["text"], lambda i=i: lookup(self.index, block.alone(i), self.options, self.dictionary)[0].select("page_id").distinct())
            frames.append(pages.select(F.lit(test).alias("test"), "page_id"))
        found = reduce(DataFrame.unionByName, frames) if frames else block.spark.createDataFrame([], "test int, page_id bigint")
        # their pages are kept, so that asking which terms have any reads no postings
        have = set(found.select("test").distinct().toArrow()["test"].to_pylist())
        self._filled(known)
        found = found.join(block.marks(), "test").groupBy("query_id", "word", "page_id").agg(F.bit_or("mask").alias("mask"))
        return found, {(r["query_id"], r["ord"]) for r, test in zip(block.rows, block.test, strict=True) if test in have}

    def _filled(self, known: set[tuple[str, str]]) -> None:
        """What was not `known` before is read by now, and is as old as that: a long reading takes nothing from its life."""
        for key in self._kept.keys() - known:
            self._kept[key] = (time.time(), self._kept[key][1])

    def _get(self, mode: str, text: str, look_up: Callable[[], DataFrame]) -> DataFrame:
        self.requests[mode] += 1
        if (mode, text) in self._kept:
            self.hits[mode] += 1
        else:
            self._kept[mode, text] = (time.time(), look_up().persist())
        return self._kept[mode, text][1]

    def invalidate(self, older_than: float = 0) -> None:
        """Drop what is older than so many seconds; 0 drops all."""
        for key, (at, df) in list(self._kept.items()):
            if not older_than or time.time() - at > older_than:
                df.unpersist()
                del self._kept[key]

    def metrics(self) -> DataFrame:
        """A row per level: size, requests, hits."""
        rows = [(mode, sum(k[0] == mode for k in self._kept), self.requests[mode], self.hits[mode]) for mode in self.requests]
        return self.index.postings.sparkSession.createDataFrame(rows, "level string, size int, requests int, hits int")


def cache_stats(metrics: DataFrame) -> DataFrame:
    """One row over the levels: size, requests and hits summed, the hit rate averaged."""
    rate = F.when(F.col("requests") > 0, F.col("hits") * 100.0 / F.col("requests")).otherwise(0.0)
    return metrics.agg(F.sum("size").alias("size"), F.sum("requests").alias("requests"), F.sum("hits").alias("hits"), F.avg(rate).alias("hitrate"))
