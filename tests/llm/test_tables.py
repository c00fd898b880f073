"""The operators on tables: against SQL and brute force, and on nulls, empty tables, repeated rows and clashing columns."""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docmill.llm import encoding, percentiles, tokens
from docmill.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "page_results", "blocks", "chunks", "jobs", "uploads", "job_events", "name_lexicon", "lang_samples", "pack_sizes")
CLASH = ("item", "piece", "n", "word", "rest", "kind", "lang", "n_tokens", "bucket", "part", "rank", "src", "rec_key", "size", "overlap", "value", "day", "metric", "key", "row", "salt_", "container_name")
FOUND = {"p1_found": {"src", "rec_key", "pii_type"}, "p2_found": {"src", "rec_id", "lang"}, "p3_found": {"src", "rec_key"}, "p4_found": {"page_key"}, "p5_found": {"page_key", "noise_kind"}, "p7_found": {"metric", "queue", "day"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id"}}


@pytest.fixture(scope="module")
def odd(small, tmp_path_factory):
    """Folders of odd tables: empty, with nulls in every column and repeated rows, with columns of clashing names."""
    base = tmp_path_factory.mktemp("odd")

    def put(kind, name, table):
        os.makedirs(base / kind, exist_ok=True)
        pq.write_table(table, base / kind / f"{name}.parquet")

    for name in TABLES:
        t = pq.read_table(f"{small}/{name}.parquet")
        put("empty", name, t.slice(0, 0))
        rows = [t.slice(0, 25), t.slice(0, 25), pa.table([pa.nulls(1, f.type) for f in t.schema], schema=t.schema)]
        rows += [t.slice(0, 2).set_column(i, f, pa.nulls(min(2, t.num_rows), f.type)) for i, f in enumerate(t.schema)]
        put("nulls", name, pa.concat_tables(rows))
        for column in CLASH:
            t = t.append_column(column, pa.array(["zz"] * t.num_rows)) if column not in t.column_names else t
        put("clash", name, t)
    return str(base)


@pytest.mark.parametrize("kind", ["empty", "nulls", "clash"])
def test_odd_tables(spark, small, odd, kind):
    for name in QUERIES:
        rows = QUERIES[name](spark, f"{odd}/{kind}")
        n = rows.count()
        if kind == "empty":
            assert n == 0, name
        if name in FOUND:
            assert set(rows.columns) == FOUND[name]
    if kind == "clash":  # other columns change nothing
        for name in ("p3_found", "p7_found", "p10_found"):
            assert sorted(map(tuple, QUERIES[name](spark, f"{odd}/clash").collect())) == sorted(map(tuple, QUERIES[name](spark, small).collect()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_found_equals_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    mine = QUERIES[name](spark, small)
    sql = con.execute(ORACLES[name]).df()
    assert sorted(map(tuple, mine.select(*sql.columns).collect())) == sorted(map(tuple, sql.values.tolist()))


def test_token_tables_agree(spark, small):
    """Tries, memo counts and encoded ids give one truth; containers hold every token once and within capacity."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = {r["doc_id"]: r["ids"] for r in QUERIES["p8_ids"](spark, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all(v == [] for k, v in ids.items() if not texts[k]) and len(ids) == len(texts)
    for hot in (1, 100_000):
        counted = {r["doc_id"]: r["n_tokens"] for r in tokens.text_tokens(docs.select("doc_id", "text"), hot_pieces=hot).collect()}
        assert counted == {k: len(v) for k, v in ids.items()}
    back = tokens.decode_ids(QUERIES["p8_ids"](spark, small), "doc_id").collect()
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in back)
    placed = QUERIES["p9_containers"](spark, small).toPandas()
    sizes = {r["container_name"]: r["capacity_tokens"] for r in spark.read.parquet(f"{small}/pack_sizes.parquet").collect()}
    for name, capacity in sizes.items():
        own = placed[placed["container_name"] == name]
        assert own.groupby("container_id")["n_tokens"].sum().max() <= capacity
        per = own.groupby("doc_id")["n_tokens"].sum().to_dict()
        assert per == {k: len(v) for k, v in ids.items() if v}
        cut = own.groupby("doc_id").size()
        assert all(len(ids[k]) > capacity for k in cut[cut > 1].index)
    budget = QUERIES["p6_token_budget"](spark, small).filter("scope = 'document'").toPandas()
    assert budget["n_tokens"].sum() == sum(map(len, ids.values())) and budget["n_items"].sum() == len(ids)


def test_token_totals_stand_when_splits_change(spark, small):
    """The budget is built under one split of the input and read under another."""
    build = QUERIES["p6_token_budget"]
    expected = sorted(map(str, build(spark, small).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        budget = build(spark, small)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        assert sorted(map(str, budget.collect())) == expected
        assert sorted(map(str, build(spark, small).collect())) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_budget_equals_a_count_of_every_text(spark, small):
    from collections import Counter

    ids = pytest.importorskip("public_tokenizers") and tokens.encoder(tokens.vocabulary(spark).value)
    jobs = {}
    for r in sorted(spark.read.parquet(f"{small}/jobs.parquet").collect(), key=lambda r: r["loaded_at"]):
        jobs[r["id"]] = r
    kinds = {r["id"]: r["kind"] for r in spark.read.parquet(f"{small}/uploads.parquet").collect()}
    pages = {(r["job_id"], r["page_key"]): ids.count(r["text"]) for r in spark.read.parquet(f"{small}/page_results.parquet").collect()}
    per_job = Counter()
    for (job, _), n in pages.items():
        per_job[job] += n
    total = Counter()
    for job, n in per_job.items():
        if job in jobs and jobs[job]["status"] == "SUCCEEDED" and jobs[job]["cached_from_job_id"] is None:
            total[kinds.get(jobs[job]["document_id"])] += n
    found = Counter()
    for r in QUERIES["p6_token_budget"](spark, small).filter("scope = 'job'").collect():
        found[r["kind"]] += r["n_tokens"]
    assert found == total


def test_ranking_is_bounded(spark):
    from docmill.llm.ranking import collected, drawn, most_frequent

    counts = spark.createDataFrame([(f"w{i}", 1 + i) for i in range(1000)], "word string, n long").repartition(7)
    top = {r["n"] for r in most_frequent(counts, "n", 100).collect()}
    assert 50 <= len(top) <= 100 and min(top) > 1000 - len(top)
    assert most_frequent(counts, "n", 5000).count() == 1000 and most_frequent(counts.limit(0), "n", 5).count() == 0
    with pytest.raises(ValueError):
        collected(counts, 999, "words")
    rows = spark.createDataFrame([(lang, f"text {i}") for lang in ("en", "zu") for i in range(5001)], "lang string, text string")
    assert {r["lang"]: r["count"] for r in drawn(rows, "lang", "text", 1000).groupBy("lang").count().collect()} == {"en": 1000, "zu": 1000}


@pytest.mark.parametrize("most", [200_000, 3])  # keys brought to the texts; texts brought to the keys
def test_floor_of_limits_loses_nothing(spark, small, monkeypatch, most):
    from docmill.llm import split

    monkeypatch.setattr(split, "MOST_KEYS", most)
    tables = [spark.read.parquet(f"{small}/{t}.parquet") for t in ("blocks", "chunks", "jobs")]
    every = [sorted((r["src"], r["rec_key"], r["piece_no"]) for r in split.split_items(split.sized_items(*tables, buckets=n)).collect()) for n in (1, 7, split.BUCKETS)]
    assert every[0] == every[1] == every[2] != []


def test_a_tree_of_many_summaries_is_one_summary(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "FAN", 3)
    df = spark.createDataFrame([("q", None if i % 50 == 0 else f"d{i % 40}", float(i)) for i in range(9000)], "queue string, day string, x double").repartition(40)
    daily = percentiles.summaries(df, ["queue", "day"], "x")
    whole = percentiles.quantiles(percentiles.merge_summaries(daily, ["queue"]), {"p50": 0.5}).collect()
    assert daily.count() == 41 and len(whole) == 1 and whole[0]["n"] == 9000 and abs(whole[0]["p50"] - 4499.5) <= whole[0]["rank_error"] + 1


def test_daily_summaries_merge_into_whole(spark):
    rows = [("q", f"d{i % 7}", float(i % 997)) for i in range(5000)] + [("q", "d0", float("nan")), ("q", "d0", None), ("q", "d0", float("inf"))]
    df = spark.createDataFrame(rows, "queue string, day string, x double").repartition(5)
    daily = percentiles.summaries(df, ["queue", "day"], "x")
    whole = percentiles.quantiles(percentiles.merge_summaries(daily, ["queue"]), {"p50": 0.5, "p90": 0.9}).first()
    values = np.sort([r[2] for r in rows[:5000]])
    assert whole["n"] == 5000
    for q, name in ((0.5, "p50"), (0.9, "p90")):
        low, high = np.searchsorted(values, whole[name], "left"), np.searchsorted(values, whole[name], "right")
        assert low - whole["rank_error"] - 1 <= q * 5000 <= high + whole["rank_error"] + 1


def test_twins_teach_the_mapping(spark):
    words = ["reunión", "próximo", "señales", "también", "estación", "corazón", "árboles", "pequeño", "cañón", "jamón"]
    clean = [" ".join(words)] * 3 + ["Â and Ã are letters; £ and © are signs."]
    wrong = [encoding.read_wrong(" ".join(words[:7]), "cp1252"), encoding.read_wrong("otoño frío", "cp1252"), "lost refer�ncia"]
    pages = spark.createDataFrame(list(enumerate([*clean, *wrong, None, ""])), "page_key long, text string")
    found = {r["page_key"]: (r["recovered"], r["text"]) for r in encoding.repair_pages(pages).collect()}
    assert sorted(found) == [4, 5, 6] and found[5] == (True, "otoño frío") and found[6][0] is False


def test_scan_noise_end_to_end(spark):
    from docmill.llm import scan_noise

    body = "the ferry clerk keeps the spare keys under the stairs and nobody asked about the paper"
    rows = [(i, f"j{i}", f"{body}.\n{body}.") for i in range(60)]
    rows += [(100, "a", f"HARBOUR NOTES   7\n{body}.\nthe ware-\nhouse."), (101, "a", f"HARB0UR NOTES   8\n{body}."), (102, "b", "the ferry c1erk k e e p s the 5pare keys under the st@irs and n0body asked about"), (103, "c", None), (104, None, " \n")]
    pages = spark.createDataFrame(rows, "page_key long, job_id string, text string")
    found = {(r["page_key"], r["noise_kind"]) for r in scan_noise.noise(pages).collect()}
    assert {(100, "header"), (101, "header"), (100, "page_no"), (101, "page_no"), (100, "hyphen"), (102, "misread")} == found
    fixed = {r["page_key"]: r["text"] for r in scan_noise.repair(pages).collect()}
    assert fixed[100] == f"{body}. the warehouse." and "HARB" not in fixed[101] and re.search("keeps", fixed[102])


@pytest.mark.parametrize("few", [64, 0])  # all pairs of a job; blocks of a longer job
def test_running_lines_meet_every_near_spelling(spark, monkeypatch, few):
    """Spellings that share neither half, beside a frequent line that shares a half with one of them, and by brute force."""
    import random

    from docmill.llm import scan_noise

    monkeypatch.setattr(scan_noise, "FEW_SPELLINGS", few)
    r = random.Random(5)
    lines = [(1, "a", "The pelican of more papers today"), (2, "a", "Tbe pelicans of more papers to day"), (3, "b", "Toswerimi & Co. B0D-112A"), (4, "b", "Toswenmi & Co. B0D-112A"), (5, "c", "Quarry hall"), (6, "c", "Quarry hatl"), (7, "d", "Harbour rules"), (7, "d", "Harbour rule")]
    for i in range(60):
        word = "".join(r.choice("ad") for _ in range(r.randint(5, 20)))
        lines.append((100 + i, "e", word))
    rows = [("line", page, job, scan_noise.edges(f"{text}\n\nbody.")[0][0][1], text, None, None) for page, job, text in lines]
    found = {(x["page_key"], x["line"]) for x in scan_noise.running_lines(spark.createDataFrame(rows, scan_noise.ROW)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def near(a, b):
        return distance(a, b) <= max(1, int(0.12 * max(len(a), len(b))))

    truth = {(p, t) for p, job, t in lines if any(p != q and job == other and near(scan_noise.edges(f"{t}\n\nb.")[0][0][1], scan_noise.edges(f"{u}\n\nb.")[0][0][1]) for q, other, u in lines)}
    assert found == truth and {p for p, _ in found} >= {1, 2, 3, 4, 5, 6} and 7 not in {p for p, _ in found}


def test_first_lines_of_prose_do_not_run(spark):
    from docmill.llm import scan_noise

    assert scan_noise.edges("There were 26 boxes on the second shelf, and the\nnew clerk counted them again before the ferry\nleft.")[0] == []


def test_every_job_has_a_language(spark, small):
    from docmill.llm import language

    found = spark.createDataFrame([("a", "en", 0.9), ("x", "fr", 0.8)], "job_id string, lang string, confidence double")
    rows = [("a", None, 1), ("b", "a", 1), ("b", "x", 0), ("c", None, 1), ("d", "c", 1), (None, "a", 1)]
    jobs = spark.createDataFrame(rows, "id string, cached_from_job_id string, loaded_at int")
    every = sorted(map(tuple, language.every_job_language(jobs, found).collect()))
    assert every == [("a", "en", 0.9), ("b", "en", 0.9), ("c", "und", 0.0), ("d", "und", 0.0), ("x", "fr", 0.8)]
    pages = {r["page_key"]: r["text"] for r in spark.read.parquet(f"{small}/page_results.parquet").collect()}
    segments = QUERIES["p2_segments"](spark, small).collect()
    assert {r["page_key"] for r in segments} == {k for k, t in pages.items() if t and not t.isspace()}
    assert all(0 <= r["char_start"] < r["char_end"] <= len(pages[r["page_key"]]) and 0 <= r["confidence"] <= 1 for r in segments)
    jobs = {r["id"] for r in spark.read.parquet(f"{small}/jobs.parquet").collect()}
    assert {r["job_id"] for r in QUERIES["p2_job_languages"](spark, small).collect()} >= jobs


def test_broken_words_are_restored_from_their_only_twin(spark):
    clean = ["la petición de más papel, más tarde", "mês a mês", "größer"]
    wrong = ["la petici\ufffdn\tgr\ufffd\ufffder", "petici\ufffdn m\ufffds", "\ufffd und xyz\ufffd", "gr\ufffd\ufffder " + encoding.read_wrong("reunión", "cp1252")]
    words = ["reunión", "próximo", "señales", "también", "estación", "corazón"]
    teach = [" ".join(words), encoding.read_wrong(" ".join(words), "cp1252")]
    pages = spark.createDataFrame(list(enumerate([*clean, *wrong, *teach, None])), "page_key long, text string")
    found = {r["page_key"]: (r["recovered"], r["text"]) for r in encoding.restore(pages).collect()}
    assert found[3] == (True, "la petición\tgrößer") and found[6] == (True, "größer reunión")
    assert found[4] == (False, "petición m\ufffds") and found[5] == (False, wrong[2])
    assert sorted(found) == [3, 4, 5, 6, 8]
