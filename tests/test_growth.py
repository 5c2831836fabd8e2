"""Queries whose cost must not outgrow their input, and results where larger tables differed."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import extract
from quillspark.operators import anomaly, evaluate, geometry, spread
from quillspark.plans import core, registry

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_greedy_matches_of_many_pages_share_a_call(spark):
    rng = random.Random(1)
    rows = [(page, p, r, "a", "b", rng.choice((0.5, 0.6, 0.7, 1.0))) for page in range(60) for p in range(6) for r in range(6) if rng.random() < 0.4]
    rng.shuffle(rows)
    found = evaluate.greedy_matches(spark.createDataFrame(rows, "page_id long, p long, r long, p_kind string, r_kind string, iou double").repartition(5))
    assert "FlatMapGroupsInPandas" not in plan(found)
    expected = []
    for page in range(60):
        used_p, used_r = set(), set()
        for row in sorted((x for x in rows if x[0] == page), key=lambda x: (-x[5], x[2], x[1])):
            if row[1] not in used_p and row[2] not in used_r:
                used_p.add(row[1])
                used_r.add(row[2])
                expected.append(row)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert evaluate.greedy_matches(spark.createDataFrame([], "page_id long, p long, r long, iou double")).count() == 0


def test_rate_windows_round_seconds_as_the_sql_does(spark, tmp_path):
    times = ["2024-01-01 23:59:59.400000", "2024-01-01 23:59:59.500000", "2024-01-01 23:59:59.600000", "2024-01-02 23:59:59.500001", "2024-01-02 00:00:00", "2024-01-02 00:00:00.5", "1969-12-31 00:00:01"]
    events = pd.DataFrame([(k * 10 + n, pd.Timestamp(t), 1) for n in range(3) for k, t in enumerate(times)], columns=["event_id", "ts", "user_id"])
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet")
    got = core.rate_limit_over(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = con.execute(registry.oracle_sql()["rate_limit_over"]).df()
    columns = ["event_id", "user_id", "window_no", "number"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(expected[columns].itertuples(index=False, name=None))


def test_reading_order_of_many_pages_shares_a_call(spark):
    rng = random.Random(2)
    rows = [(f"p{page}", 100 * page + k, rng.randrange(5) * 10, rng.randrange(40), 5, rng.randrange(1, 20)) for page in range(60) for k in range(rng.randrange(1, 9))]
    found = geometry.reading_order(spark.createDataFrame(rows, "page_id string, box_id long, x long, y long, w long, h long").repartition(5))
    assert "FlatMapGroupsInPandas" not in plan(found)
    got = sorted(map(tuple, found.collect()))
    expected = []
    for page in {r[0] for r in rows}:
        lines = []
        for b in sorted((r for r in rows if r[0] == page), key=lambda r: (r[3], r[2], r[1])):
            for line in lines:
                if min(b[3] + b[5], line[1]) - max(b[3], line[0]) > 0.5 * min(b[5], line[1] - line[0]):
                    line[0], line[1] = min(line[0], b[3]), max(line[1], b[3] + b[5])
                    line[2].append(b)
                    break
            else:
                lines.append([b[3], b[3] + b[5], [b]])
        order = [b for line in lines for b in sorted(line[2], key=lambda b: (b[2], b[1]))]
        expected += [(page, b[1], k) for k, b in enumerate(order)]
    assert got == sorted(expected)


def test_names_in_blocks_give_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(anomaly, "NAME_BLOCK", 20)
    words = ["ann", "anna", "Böhm", "johann", "x" * 70, "x" * 69 + "y", "o" * 40, "o" * 38 + "pq", "Supplier#000000123", "Supplier#000000124", "Supplier#00000124", "😀 smile", "😀 smiles"]
    for _ in range(150):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "n", "7"])
        words.append("".join(w))
    rows = [(g, f" {w} ") for w in words for g in rng.sample((1, 2, 3, None), 2)]
    people = spark.createDataFrame(rows, "page_id long, raw_text string").repartition(3)
    names = {(g, w.strip(" ")) for g, w in rows if g is not None and w.strip(" ")}
    pairs = {(g, a, b) for g, a in names for h, b in names if g == h and a < b and 2 * min(len(a), len(b)) >= 0.75 * (len(a) + len(b))}
    assert sorted(map(tuple, anomaly.name_pairs(people).collect())) == sorted(pairs)
    found = anomaly.inconsistent_names_by_subsequence(people).collect()
    assert {tuple(r)[:3]: r.similarity for r in found} == {p: s for p in pairs if (s := evaluate.indel_similarity(p[1], p[2])) >= 0.75} and len(found) == len({tuple(r)[:3] for r in found})
    like = 1 - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b"))
    for least in (0.94, 0.8):
        by_edits = anomaly.inconsistent_names_by_edits(people, least=least)
        assert sorted(map(tuple, by_edits.collect())) == sorted(map(tuple, anomaly.inconsistent_names(people, like, least=least).collect()))
    units = anomaly.name_units(people.selectExpr("page_id", "trim(raw_text) AS name").distinct(), "page_id").collect()
    assert max(max(len(u.left), len(u.right)) for u in units) < 60 and len(units) > 15


def test_names_of_few_edits_do_not_meet_in_all_pairs(spark):
    """All names in one group: their pairs are far more than the candidates."""
    rows = spark.range(20_000).selectExpr("1L AS page_id", "concat('Supplier#', lpad(cast(id * 7919 % 1000000000 AS string), 9, '0')) AS raw_text")
    found = anomaly.inconsistent_names_by_edits(rows, least=0.94)
    names = [f"Supplier#{k * 7919 % 1000000000:09}" for k in range(20_000)]
    near = {(a, b) for a in names for i in range(9, 18) for c in "0123456789" if a < (b := a[:i] + c + a[i + 1 :])} & {(a, b) for known in [set(names)] for a in names for i in range(9, 18) for c in "0123456789" if (b := a[:i] + c + a[i + 1 :]) in known}
    assert {(r.name_a, r.name_b) for r in found.collect()} == near


@pytest.fixture
def small_tasks(monkeypatch):
    """A thousandth of the usual bytes for a task."""
    from quillspark.operators import spread

    monkeypatch.setattr(spread, "TASK_BYTES", 4 << 10)
    monkeypatch.setattr(spread.parts, "__kwdefaults__", {"each": 4 << 10})


def test_region_tasks_follow_the_input(spark, small_tasks):
    found = core.region_classify(spark, SF)
    n = found.rdd.getNumPartitions()
    assert n == spread.parts(found) > 4 * 4


def test_extraction_tasks_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(core, "tasks", lambda *frames, each: 37)
    assert core.extract_udtf(spark, SF).rdd.getNumPartitions() == 37


def test_extraction_of_odd_texts_through_arrow(spark):
    texts = [None, "", " ", "paid £6 3s 4d at Bombay", "5 July 1799"]
    got = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(zip(texts, (1.0, None, 2.0, None, 50.0)))], "k int, text string, ocr_confidence double")
    rows = [tuple(r) for r in extract.entities(got, parts=1).select("k", "entity_type", "normalized_value", "raw_text", "confidence", "start_char", "end_char").orderBy("k", "start_char").collect()]
    assert rows == [(3, *e) for e in extract.extract(texts[3])] + [(4, *e) for e in extract.extract(texts[4], 50.0)]


def test_cascade_tasks_follow_the_input(spark, small_tasks):
    plain = core.cascade_delete(spark, SF)
    assert plan(plain).count("REPARTITION_BY_NUM") >= 6


def test_detail_leaves_out_what_is_not_asked_for(spark):
    """Texts and names of the archive are neither read nor shuffled for positions and counts."""
    narrow = plan(core.document_detail_flat(spark, SF))
    assert "c_name" not in narrow and "l_returnflag" not in narrow and "l_extendedprice" not in narrow
