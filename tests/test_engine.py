"""Properties, goldens worked out by hand, and an independent model of scoring."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import terms as T
from quarry.operators import search as S
from quarry.operators.index import Index, build_index
from quarry.operators.query import QUERY_TERMS, SearchOptions, compile_terms
from quarry.sources import files, pages
from quarry.streaming.ingest import ingest, latest


def index_of(spark, rows):
    return Index.of(spark.createDataFrame(rows, "term string, page_id bigint"))


def ids(df):
    return sorted(r["page_id"] for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    rows = [("alpha", 1), ("beta", 1), ("beta", 2), ("alpha", 3), ("gamma", 3), ("TITLE:Alpha", 4), ("n=5", 1), ("n=-5", 2), ("n=3.14", 3), ("N=7", 4), ("alphabet", 0)]
    return index_of(spark, rows)


def test_hand_worked_ranking(spark):
    index = index_of(spark, [("alpha", 1), ("beta", 1), ("beta", 2), ("alpha", 3), ("gamma", 3)])
    got = S.search(index, "+alpha -gamma beta").collect()
    assert [(r["page_id"], r["score"], r["threshold"], r["max_quality"], r["quality_pct"]) for r in got] == [(1, 108, 100, 12, 66)]
    assert S.search(index, "-gamma").count() == 0
    assert S.search(index, "+missing alpha").count() == 0


def test_hand_worked_quality(spark):
    ranked = spark.createDataFrame([(0, k, s, 0, 12) for k, s in enumerate((12, 8, 4, 4))], "query_id int, page_id bigint, score int, threshold int, max_quality int")
    got = S.with_quality(ranked).orderBy("position").collect()
    assert [r["quality_pct"] for r in got] == [100, 73, 45, 43]


def test_weak_points_of_long_results(spark):
    ranked = spark.range(12_000).select(F.lit(0).alias("query_id"), F.col("id").alias("page_id"), F.lit(4).alias("score"), F.lit(0).alias("threshold"), F.lit(4).alias("max_quality"))
    got = {r["position"]: r["quality_pct"] for r in S.with_quality(ranked).filter("position in (0, 1, 400, 4000, 11999)").collect()}
    assert got == {0: 100, 1: 100, 400: 99, 4000: 90, 11999: 90}


def test_modes_widen(small):
    for text in ("alpha", "Alpha", "bet", "a"):
        exact, prefix, infix = (set(ids(S.find(small, text, m, True))) for m in ("exact", "prefix", "infix"))
        assert exact <= prefix <= infix
        for mode, own in (("exact", exact), ("prefix", prefix), ("infix", infix)):
            assert own <= set(ids(S.find(small, text, mode, False)))
    assert ids(S.find(small, "Alpha", "exact", True, field="TITLE")) == [4]


@pytest.mark.parametrize(
    ("name", "sign", "bound", "sensitive", "expected"),
    [("n", ">", "-6", True, [1, 2]), ("n", "<", "5", True, [2]), ("n", ">", "0", False, [1, 4]), ("n", ">", "abc", True, []), ("n", ">", "-0", True, []), ("n", ">", "4x", True, [1])],
)
def test_numbers(small, name, sign, bound, sensitive, expected):
    assert ids(S.find_number(small, name, sign, bound, sensitive)) == expected


def test_word_length_is_in_bytes(spark):
    docs = spark.createDataFrame([(1, "a" * 63), (2, "a" * 64), (3, "é" * 31), (4, "é" * 32), (5, None), (6, "")], "doc_id long, text string")
    assert ids(build_index(docs, "doc_id", "text").indexed_pages()) == [1, 3]


def model(rows, query, options=SearchOptions()):
    """Scores by plain loops; words only."""
    scores, threshold = {}, 0
    for raw in query:
        occ, text = (raw[0], raw[1:]) if raw[0] in "+-" else ("", raw)
        hit = {p for t, p in rows if (t == text if len(text) <= 3 else (text in t if text != text.lower() else text in t.lower()))}
        if occ == "+":
            threshold += 100
            if not hit:
                return {}
        for p in hit:
            scores[p] = scores.get(p, 0) + {"+": 104, "-": -500, "": 4}[occ]
    return {p: s for p, s in scores.items() if s > threshold}


def test_against_model(spark):
    rng = random.Random(5)
    words = ["abba", "Abba", "cab", "dabbat", "Ebb", "xyzzy", "zzy", "abbaxy"]
    rows = sorted({(rng.choice(words), rng.randrange(12)) for _ in range(60)})
    index = index_of(spark, rows)
    queries = [[rng.choice(["", "+", "-"]) + rng.choice([*words, "bb", "ABBA", "none"]) for _ in range(rng.randint(1, 4))] for _ in range(25)]
    terms = spark.createDataFrame([(q, k, raw) for q, ts in enumerate(queries) for k, raw in enumerate(ts)], QUERY_TERMS)
    got = {}
    for r in S.search(index, terms).collect():
        got.setdefault(r["query_id"], {})[r["page_id"]] = r["score"]
    for q, ts in enumerate(queries):
        assert got.get(q, {}) == model(rows, ts), ts
    turned = spark.createDataFrame([(q, -k, raw) for q, ts in enumerate(queries) for k, raw in enumerate(ts)], QUERY_TERMS)
    again = {(r["query_id"], r["page_id"]): r["score"] for r in S.search(index, turned).collect()}
    assert again == {(q, p): s for q, own in got.items() for p, s in own.items()}


def test_compile_quotes_and_modes(spark):
    raws = ["the", "Than", "than", '"than"', "'Than", "+x>y", "", "''", "*"]
    got = {r["ord"]: (r["kind"], r["mode"]) for r in compile_terms(spark.createDataFrame([(0, k, x) for k, x in enumerate(raws)], QUERY_TERMS)).collect()}
    assert got == {
        0: ("word", "exact_cs"), 1: ("word", "partial_cs"), 2: ("word", "partial_ci"), 3: ("word", "exact_ci"), 4: ("word", "exact_cs"),
        5: ("gt", "exact_cs"), 8: ("all", "exact_cs"),
    }


def test_replace_delete_purge(spark):
    index = index_of(spark, [("old", 1), ("keep", 2), ("gone", 3)])
    terms = spark.createDataFrame([("new", 1), ("fresh", 9)], "term string, page_id bigint")
    pending = index.replace_pages(terms).delete_pages(spark.createDataFrame([(3,)], "page_id bigint"))
    assert ids(S.find(pending, "old", "exact", True)) == [1] == ids(S.find(pending, "new", "exact", True))
    assert ids(S.find(pending, "gone", "exact", True)) == [3]
    purged = pending.purge()
    assert sorted((r["term"], r["page_id"], r["gen"]) for r in purged.postings.collect()) == [("fresh", 9, 0), ("keep", 2, 0), ("new", 1, 0)]
    assert sorted(purged.purge().postings.collect()) == sorted(purged.postings.collect())
    assert S.search(pending, "gone", include_pending=False).count() == 0


def test_merge_with_identity_is_union(spark, small):
    same = small.indexed_pages().select(F.col("page_id").alias("old_id"), F.col("page_id").alias("new_id"))
    assert sorted(small.merge(small, same).postings.collect()) == sorted(small.postings.collect())


def test_text_round_trip(spark, small):
    for runs in (False, True):
        lines = files.dump_text(index_of(spark, [(r["term"], r["page_id"]) for r in small.postings.collect() if " " not in r["term"]]), runs)
        assert sorted(files.parse_text(lines).collect()) == sorted((r["term"], r["page_id"]) for r in small.postings.collect())


def test_parquet_round_trip(spark, small, tmp_path):
    files.write_index(small, str(tmp_path / "index"), 3)
    assert sorted(files.read_index(spark, str(tmp_path / "index")).postings.collect()) == sorted(small.postings.collect())


def test_binary_formats(spark, tmp_path):
    postings = {b"alpha": [1, 5], b"alphabet": [2], b"z": [7], "été".encode(): [3]}
    (tmp_path / "a.ndx").write_bytes(files.encode_trie(postings))
    got = sorted((r["term"], r["page_id"]) for r in files.load_binary(spark, str(tmp_path / "a.ndx")).postings.collect())
    assert got == sorted((t.decode(), p) for t, ps in postings.items() for p in ps)
    # a node with two children, and a page that waits for a purge
    import struct

    def node(content, pages, children=()):
        return struct.pack("<i", len(content)) + content + struct.pack("<ii", len(children), len(pages)) + struct.pack(f"<{len(pages)}i", *pages) + b"".join(children)

    tree = node(b"lph", [], [node(b"a", [1, -4]), node(b"x", [2], [node(b"yz", [3])])])
    data = b"\x01" + b"".join(struct.pack("<i", 1) + tree if c == ord("a") else struct.pack("<i", 0) for c in range(256))
    assert sorted(files.decode_trie(data)) == [(b"alpha", 1, 0), (b"alpha", 4, 1), (b"alphx", 2, 0), (b"alphxyz", 3, 0)]
    letters = b"\x00" + b"a" + struct.pack(">ii", 1, 1) + struct.pack(">i", 9) + b"b" + struct.pack(">ii", 0, 2) + struct.pack(">ii", 1, -2)
    assert sorted(files.decode_letters(letters)) == [(b"a", 9, 0), (b"ab", 1, 0), (b"ab", 2, 1)]


def test_redirect_loops_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {r["src"]: r["target"] for r in pages.resolve_redirects(edges).collect()} == {"a": None, "b": None, "c": "e", "d": "e"}


def test_entities_round_trip(spark):
    df = spark.createDataFrame([("<a & b>",), ("&amp;lt;",)], "t string")
    assert [r[0] for r in df.select(T.decode_entities(T.encode_entities(F.col("t")))).collect()] == ["<a & b>", "&amp;lt;"]


def test_search_cache_counts(small):
    cached = S.CachedSearch(small)
    assert ids(cached.find("alpha")) == ids(cached.find("alpha"))
    row = S.cache_stats(cached.metrics()).first()
    assert (row["size"], row["requests"], row["hits"]) == (1, 2, 1)
    cached.invalidate()
    assert S.cache_stats(cached.metrics()).first()["size"] == 0


def test_config():
    assert files.read_config("A=1\n\nb = x=y\nnoise\n") == {"A": "1", "b": "x=y"}


def test_streaming_ingest_keeps_the_last_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number, rows in enumerate(([(1, "old words"), (2, "two")], [(1, "new words")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        ingest(stream, out, str(tmp_path / "state"), "doc_id", "text").awaitTermination()
        assert number >= 0
    assert sorted((r["term"], r["page_id"]) for r in latest(spark, out).postings.collect()) == [("new", 1), ("two", 2), ("words", 1)]


# --- ranking at scale ------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_prunes_before_the_shuffle(small):
    assert "WindowGroupLimit" in plan_of(S.search(small, "alpha beta", limit=3))


def test_no_window_over_a_whole_result(small):
    """Every window over pages is parted by the cell too; the others are over counted cells."""
    for limit in (-1, 3):
        for line in plan_of(S.search(small, "alpha beta", limit=limit)).splitlines():
            if "row_number()" in line and "Window [" in line:
                assert re.search(r"\[query_id#\d+, score#\d+, cell#\d+L?\]", line), line


@pytest.mark.parametrize("cell", [1, 3, 50_000])
def test_cells_do_not_change_the_ranking(spark, monkeypatch, cell):
    rng = random.Random(cell)
    rows = [(w, p) for p in rng.sample(range(10_000), 60) for w in ("alpha", "beta", "gamma", "delta") if rng.random() < 0.5]
    index = index_of(spark, rows)
    query = "alpha beta gamma -delta"
    monkeypatch.setattr(S, "CELL_PAGES", cell)
    got = [tuple(r) for r in S.search(index, query).orderBy("position").select("page_id", "score", "position", "quality_pct").collect()]
    held = {}
    for w, p in rows:
        held.setdefault(p, set()).add(w)
    scores = {p: sum(4 for w in ("alpha", "beta", "gamma") if w in ws) - 500 * ("delta" in ws) for p, ws in held.items()}
    order = sorted((-x, p) for p, x in scores.items() if x > 0)
    q = [-x for x, _ in order]
    expected = []

    def div(a, b):
        return int(a / b)

    for i, (x, p) in enumerate(order):
        k = min(i, 3)
        gap = div(div(sum(q[i - k : i]), k) - q[i], 5 - k) if i else 0
        # the query's most is the sum of the weights of its four terms
        pct = div((q[i] + gap) * 100, 16)
        expected.append((p, -x, i, pct if i == 0 else max(1, pct - min(10, div(10 * i, len(order))))))
    assert got == expected
    for limit in (0, 1, 5, 1000):
        assert sorted(tuple(r) for r in S.search(index, query, limit=limit).select("page_id", "score", "position", "quality_pct").collect()) == sorted(expected[:limit])


def test_ties_and_far_apart_ids(spark):
    index = index_of(spark, [("alpha", p) for p in (0, 5, 2**40, 2**40 + 1, 7)])
    assert [r["page_id"] for r in S.search(index, "alpha").orderBy("position").collect()] == [0, 5, 7, 2**40, 2**40 + 1]


# --- pages -----------------------------------------------------------------------------------------


def test_addresses(spark):
    cases = [
        ("http://h/a/b.html", "c.html", "http://h/a/c.html"), ("http://h/a/b.html", "../c", "http://h/c"), ("http://h", "c", "http://h/c"),
        ("http://h/a/?q=/x/y", "./c?d=../e#f", "http://h/a/c?d=../e#f"), ("https://h/a/", "//o/x", "https://o/x"), ("http://h/a", "mailto:x", "mailto:x"),
        ("http://h/a/b", "../../../c", "http://h/c"), ("http://h/a/b", "/d/", "http://h/d/"),
    ]
    df = spark.createDataFrame(cases, "base string, href string, expected string")
    for r in df.select("base", "href", "expected", pages.absolute(F.col("base"), F.col("href")).alias("got")).collect():
        assert r["got"] == r["expected"], r


def test_chains_of_any_length_end(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(100)] + [("x", "y"), ("y", "z"), ("z", "y")]
    got = {r["src"]: (r["target"], r["hops"]) for r in pages.resolve_redirects(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"n{k:03d}": ("n100", 100 - k) for k in range(100)} | dict.fromkeys("xyz", (None, None))


def test_files_as_pages_and_configuration(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.html").write_text("<title>é</title>")
    assert [r["html"] for r in files.file_source(spark, f"file://{tmp_path}/docs/,").collect()] == ["<title>é</title>"]
    xml = spark.createDataFrame([("<configurations><head><list>one; two;</list></head></configurations>",)], "xml string")
    assert [r["alias"] for r in files.configuration_aliases(xml).collect()] == ["one", "two"]


def test_cache_in_search_gives_the_same(small):
    cache = S.CachedSearch(small)
    for query in ("+alpha beta -gamma", "beta alpha", "TITLE:alpha alpha"):
        plain = sorted(map(tuple, S.search(small, query).collect()))
        assert sorted(map(tuple, S.search(small, query, cache=cache).collect())) == plain
    assert sum(cache.hits.values()) > 0


def test_streaming_empties_and_deletes(spark, tmp_path):
    def batch(k, rows):
        spark.createDataFrame(rows, "id long, text string, gone boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
        stream = spark.readStream.schema("id long, text string, gone boolean").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "check"), "id", "text", deleted=F.col("gone")).awaitTermination()

    batch(0, [(1, "old words", False), (2, "stays", False), (3, "goes", False)])
    batch(1, [(1, "", False), (3, "goes", True)])
    assert sorted((r["term"], r["page_id"]) for r in latest(spark, str(tmp_path / "out")).postings.collect()) == [("stays", 2)]


def test_cache_outlives_a_long_first_reading(small, monkeypatch):
    """The terms of one search are kept for the next, however long reading them took."""
    now = [0.0]

    class Clock:
        @staticmethod
        def time():
            now[0] += 45
            return now[0]

    monkeypatch.setattr(S, "time", Clock)
    cache = S.CachedSearch(small, life=1000)
    S.search(small, "+alpha beta -gamma", cache=cache)
    monkeypatch.setattr(Clock, "time", staticmethod(lambda: now[0]))
    first = {key: at for key, (at, _) in cache._kept.items()}
    assert min(first.values()) > 45 * 3
    now[0] = min(first.values()) + 900
    S.search(small, "+alpha beta -gamma", cache=cache)
    assert sum(cache.hits.values()) == 3
    now[0] += 1000
    S.search(small, "+alpha beta -gamma", cache=cache)
    assert sum(cache.hits.values()) == 3


@pytest.mark.parametrize(("broadcast", "direct", "bits"), [(100_000, 8, 62), (1, 8, 62), (1, 1, 2), (1, 0, 1)])
def test_many_matched_terms(spark, monkeypatch, broadcast, direct, bits):
    """Broadcast, put to the postings or joined by shuffle: the ranking is the same; and with a direct test no posting is shuffled."""
    monkeypatch.setattr(S, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(S, "DIRECT_TESTS", direct)
    monkeypatch.setattr(S, "WORD_BITS", bits)
    rows = [(w, p) for p, w in enumerate(("alpha", "alphabet", "beta", "betaal", "gamma", "TITLE:Alpha", "n=5", "N=-7", "the"))] + [("gamma", 0), ("the", 2), ("n=9", 2)]
    index = index_of(spark, rows)
    terms = [(0, k, t) for k, t in enumerate(("+alph", "bet", "-gamma"))] + [(1, k, t) for k, t in enumerate(("TITLE:alpha", "alpha", "alph", "*", "the", "n>6", "N<0"))]
    got = sorted(tuple(r)[:3] for r in S.search(index, spark.createDataFrame(terms, QUERY_TERMS)).collect())
    assert got == [(0, 1, 104), (0, 5, 104)] + [(1, p, s) for p, s in ((0, 12), (1, 12), (2, 12), (3, 4), (4, 4), (5, 22), (6, 4), (7, 8), (8, 8))]
    if direct == 8 and broadcast == 1:
        block = next(S._blocks(spark.createDataFrame([(0, 0, "alph"), (0, 1, "bet")], QUERY_TERMS), SearchOptions(), None))
        plan = plan_of(S.lookup(index, block, SearchOptions())[0])
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


# --- maintenance and files at scale ----------------------------------------------------------------


def test_few_pages_leave_the_postings_where_they_are(spark):
    """Replaced, purged, merged and written: the index's own postings are in no shuffle by page and made distinct nowhere."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('w', id % 7, ' x', id) AS text")
    index = build_index(docs, "doc_id", "text")
    terms = spark.createDataFrame([("new", 1), ("w1", 1), ("fresh", 9000)], "term string, page_id bigint")
    replaced = index.replace_pages(terms)
    purged = replaced.purge()
    merged = index.merge(Index.of(terms), spark.createDataFrame([(1, 8), (9000, 9001)], "old_id bigint, new_id bigint"))
    for own in (purged, merged):
        own_branch = plan_of(own.postings).split("Union")[1].split("\n   +- ")[0]
        assert "Range" in own_branch and "Exchange hashpartitioning" not in own_branch
    assert index.purge() is index
    assert index.delete_pages(terms.select("page_id")).purge() is not index
    old = {(t, i) for i in range(2000) for t in (f"w{i % 7}", f"x{i}")}
    assert {tuple(r)[:2] for r in purged.postings.collect()} == {(t, i) for t, i in old if i != 1} | {("new", 1), ("w1", 1), ("fresh", 9000)}
    assert sorted(tuple(r)[:2] for r in merged.postings.collect()) == sorted(old | {("new", 8), ("w1", 8), ("fresh", 9001)})
    assert replaced.postings.count() == 4000 + 3


def test_marked_postings_without_a_queue_stay_single(spark):
    """Files may hold a page in both generations; what a purge or a replacement leaves is distinct."""
    index = Index.of(spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 1, 1)], "term string, page_id bigint, gen int"))
    assert sorted(map(tuple, index.purge().postings.collect())) == [("a", 1, 0), ("b", 1, 0)]
    again = index.replace_pages(spark.createDataFrame([("b", 1)], "term string, page_id bigint"))
    assert sorted(map(tuple, again.postings.collect())) == [("a", 1, 0), ("a", 1, 1), ("b", 1, 1)]


def test_runs_need_no_distinct_rows(spark, monkeypatch):
    monkeypatch.setattr(files, "CELL_PAGES", 4)
    rows = [("a", p) for p in (0, 1, 2, 3, 4, 5, 7, 7, 8, 20, 20)] + [("b", 3), ("b", 3)]
    df = spark.createDataFrame(rows, "term string, page_id bigint")
    assert sorted(map(tuple, files.posting_runs(df).collect())) == [("a", 0, 5), ("a", 7, 8), ("a", 20, 20), ("b", 3, 3)]
    assert not any("HashAggregate" in line and "keys=[term#" in line and "page_id" in line.split("functions")[0] for line in plan_of(files.posting_runs(df)).splitlines())


def test_runs_are_found_without_aggregating_behind_a_window(spark):
    """Such an aggregation holds a row for each run and leaves the window no memory."""
    plan = plan_of(files.posting_runs(spark.range(1, 5000).selectExpr("concat('w', id % 7) AS term", "id AS page_id")))
    assert "Window" in plan and "Aggregate" not in plan


@pytest.mark.parametrize(("cell", "broadcast"), [(4, 100_000), (4, 3), (16, 100_000), (65_536, 100_000)])
def test_runs_over_borders_and_below_zero(spark, monkeypatch, cell, broadcast):
    monkeypatch.setattr(files, "CELL_PAGES", cell)
    monkeypatch.setattr(files, "BROADCAST_EDGES", broadcast, raising=False)
    rng = random.Random(cell)
    for dense in (0.3, 0.9):
        rows = [(t, p) for t in "abc" for p in range(-40, 60) if rng.random() < dense]
        held = set(rows)
        starts, ends = ([(t, p) for t, p in sorted(held) if (t, p + step) not in held] for step in (-1, 1))
        want = [(t, a, b) for (t, a), (_, b) in zip(starts, ends, strict=True)]
        df = spark.createDataFrame(rows + rows[::7], "term string, page_id bigint")
        assert sorted(map(tuple, files.posting_runs(df).collect())) == want


def test_dumped_runs_take_one_aggregation_and_no_window(spark, monkeypatch):
    monkeypatch.setattr(files, "CELL_PAGES", 8)
    rows = [("a", p) for p in (0, 1, 2, 5, 6, 8, 9, 10, 11, 15, 16)] + [("b", 7)]
    marked = spark.createDataFrame([(t, p, g) for t, p in rows for g in (0, 1)], "term string, page_id bigint, gen int")
    for index in (index_of(spark, rows), Index.of(marked)):
        dump = files.dump_text(index, runs=True)
        plan = plan_of(dump)
        assert "Window" not in plan and plan.count("ObjectHashAggregate") == 2
        assert sorted(r["value"] for r in dump.collect()) == ["a 0-2 5 6", "a 16", "a 8-11 15", "b 7"]
        assert sorted(map(tuple, files.parse_text(dump).collect())) == rows


def test_lines_are_legal_as_a_whole(spark):
    """A line is built once in its own loading, and dropped if any of its ids is none."""
    rng, ids = random.Random(5), ["1", "22", "3-5", "5-3", "4-4", "0007-9"]
    lines, want = ["", " ", "lonely", " 1 2", None], set()
    for k in range(600):
        own = rng.choices(ids, k=rng.randrange(1, 5)) + rng.choices(["-", "--", "1-", "-1", "1-2-3", "1--2", "x", "1x", "\u0663", "7\t", "5\n"], k=k % 2)
        rng.shuffle(own)
        word = f"{'é-'[k % 2]}{k}"
        lines.append(f"{word}{' ' * rng.randrange(1, 3)}{' '.join(own)}{rng.choice(['', ' ', chr(13)])}")
        if all(re.fullmatch("[0-9]+(-[0-9]+)?", x) for x in re.split(" +", lines[-1].rstrip("\r\n "))[1:]):
            want |= {(word, p) for x in own for p in range(int(x.partition("-")[0]), int(x.rpartition("-")[2]) + 1)}
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(map(tuple, files.parse_text(df).collect())) == sorted(want)
    plan = plan_of(files.parse_text(df.select(F.transform(F.array("value"), lambda x: x)[0].alias("value"))))
    assert plan.count("transform(") == 1


@pytest.mark.parametrize("older", [False, True])
def test_binary_files_of_ranges(spark, older):
    rows = sorted({(f"{'aé'[k % 2]}{k % 13}", k * 37 % 900) for k in range(3000)})
    index = index_of(spark, rows)
    written = files.binary_files(index, older, postings_per_file=500)
    for disjoint in (True, False):
        got = files.load_files(written, older, disjoint=disjoint)
        assert sorted(map(tuple, got.postings.collect())) == [(t, p, 0) for t, p in rows]
    with pytest.raises(OverflowError):
        files.encode_trie({b"a": [2**31]})
