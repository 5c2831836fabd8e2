"""Case tables of the text, extraction, evaluation, geometry and image functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import extract as X
from quillspark.functions import text as T
from quillspark.kernels import image
from quillspark.operators import anomaly, control, evaluate, geometry, review, search
from quillspark.sources import files
from quillspark.streaming import ingest

ORDINALS = {1: "st", 2: "nd", 3: "rd", 21: "st", 22: "nd", 23: "rd", 31: "st"}
DAYS = [(1764, 2, 29), (1811, 7, 22), (1848, 11, 30), (1905, 5, 2), (2031, 10, 13)]


def written(year, month, day):
    """Ways to write a day, by rule."""
    name, ordinal = X.MONTHS[month - 1].capitalize(), f"{day}{ORDINALS.get(day, 'th')}"
    short = name[:3] + "." if name != "May" else name
    return [
        f"{day} {name} {year}", f"{ordinal} {name}, {year}", f"the {ordinal} of {name} {year}", f"{ordinal} day of {name.upper()}, {year}", f"{name} {day} {year}", f"{short} {ordinal}, {year}",
        f"{month}/{day}/{year}", f"{month:02}-{day:02}-{year}",
    ]


DATES = [(text, f"{y:04}-{m:02}-{d:02}") for y, m, d in DAYS for text in written(y, m, d)]
#: Digits as recognition reads them, days that no calendar has, and years out of bounds.
DATES += [
    ("2O August l7S4", "1754-08-20"), ("the Bth of June, 16|9", "1619-06-08"), ("Oct. lqth, 1702", "1702-10-19"), ("4/Z7/i866", "1866-04-27"), ("Febtuary 11, 1799", "1799-02-11"), ("the 7th of Jume 1644", "1644-06-07"),
    ("29 February 1763", None), ("April 31, 1820", None), ("13/30/1777", None), ("0/4/1777", None), ("5 July 987", None), ("5 July 2101", None), ("8 Smarch 1799", "1799-03-08"), ("6 Xyzzyq 1799", None),
]
#: (text, normal form or None, the text of the amount)
AMOUNTS = [
    ("a fee of $88 sharp", "USD 88.00", "$88"), ("$ 7,300,001.5 in all", "USD 7300001.50", "$ 7,300,001.5"), ("cost $0.75.", "USD 0.75", "$0.75"), ("some 41 dollars and 9 cents", "USD 41.09", "41 dollars and 9 cents"),
    ("1 Dollar", "USD 1.00", "1 Dollar"), ("9 dollars and 100 cents", None, None), ("3 dollars and 4 oxen", "USD 3.00", "3 dollars"), ("rent £48", "GBP 48.00", "£48"), ("£ 7 19s 11d", "GBP 8.00", "£ 7 19s 11d"),
    ("£2, 2 s. 4 d.", "GBP 2.12", "£2, 2 s. 4 d"), ("£9.8.7", "GBP 9.43", "£9.8.7"), ("L62 4s owed", "GBP 62.20", "L62 4s"), ("£l4 paid", "GBP 14.00", "£l4"), ("XL62", None, None), ("£6 20s", None, None), ("£6 3s 12d", None, None),
    ("£4,250", None, None), ("fined 15s", "GBP 0.75", "15s"), ("fined 8 s. 3d.", "GBP 0.41", "8 s. 3d"), ("22s", None, None), ("8sh", None, None), ("no sum", None, None),
]


@pytest.mark.parametrize("text,expected", DATES)
def test_dates(text, expected):
    found = [e for e in X.extract(f"Signed on {text} here") if e[0] == "date"]
    assert [e[1] for e in found] == ([expected] if expected else [])


@pytest.mark.parametrize("text,expected,raw", AMOUNTS)
def test_amounts(text, expected, raw):
    found = [(e[1], e[2]) for e in X.extract(text) if e[0] == "amount"]
    assert found == ([(expected, raw)] if expected else [])


PLACES = [("a ship out of Madras", "Chennai"), ("born in New  Amsterdam", "New York City"), ("letters from Leningrod", "Saint Petersburg"), ("he died near Whitby", "Whitby")]


@pytest.mark.parametrize("text,expected", PLACES)
def test_places(text, expected):
    found = [e for e in X.extract(text) if e[0] == "location"]
    assert [e[1] for e in found] == [expected]
    assert all(text[e[4] : e[5]] == e[2] for e in found)
    assert (found[0][3] == X.PLACE_OTHER) == (expected == "Whitby")


def test_people_and_confidence():
    text = "witnessed by Capt. Ann B. Porter-Lowe yesterday"
    whole, part = X.extract(text, 100.0), X.extract(text, 30.0)
    assert whole[0][:3] == ("person", "Ann B. Porter-Lowe", "Ann B. Porter-Lowe")
    assert part[0][3] == pytest.approx(0.3 * whole[0][3])
    assert X.extract("\n\t") == X.extract("") == X.extract(None) == []


def test_each_repair_costs_confidence():
    sure = [X.extract(t)[0][3] for t in ("19 October 1833", "1g October 1833", "1g October l833", "1g Octuber l833")]
    assert sure == pytest.approx([0.92, 0.77, 0.62, 0.47])
    assert [X.extract(t)[0][3] for t in ("8/19/1833", "8/1g/1833")] == pytest.approx([0.85, 0.7])


def test_spans_are_whole_tokens():
    for text in ("Paid £3 12th inst.", "on 4 May 1790.", "$5.129 each"):
        for _, _, raw, _, a, b in X.extract(text):
            assert text[a:b] == raw and (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())


def test_longest_spans_win():
    assert X.longest_first([(0, 5), (4, 20), (21, 22), (0, 5)]) == [(4, 20), (21, 22)]


def test_column_dates_agree_with_whole_text(spark):
    fuzzy = ("Febt", "Jume", "Smarch")
    cases = [c for c in DATES if not any(w in c[0] for w in fuzzy)]
    frame = spark.createDataFrame(cases, "text string, expected string")
    got = frame.select("text", "expected", F.coalesce(X.word_date(F.col("text"))["iso"], X.word_date(F.col("text"), True)["iso"], X.numeric_date(F.col("text"))["iso"]).alias("iso")).collect()
    assert [(r.text, r.iso) for r in got] == cases


def test_similarity(spark):
    pairs = [("Jon Smyth", "John Smyth", 0.6154), ("Jon Smyth", "John Smith", 0.3125), ("Calcuta", "Calcutta", 0.7), ("word", "two words", 0.3636), ("Zzqxw Ptrlmnop", "John Smith", 0.0), ("", "", 0.0)]
    frame = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = [r[0] for r in frame.select(F.round(T.similarity(F.col("a"), F.col("b")), 4)).collect()]
    assert got == [p[2] for p in pairs]


def test_error_rates(spark):
    rows = [("hello wrld", "hello world"), ("the slow fox", "the quick fox"), ("a\nb", "a b"), ("", ""), ("x", "")]
    frame = spark.createDataFrame(rows, "p string, r string")
    got = frame.select(T.character_error_rate(F.col("p"), F.col("r")), T.word_error_rate(F.col("p"), F.col("r"))).collect()
    assert got[0][0] == pytest.approx(1 / 11) and got[1][1] == pytest.approx(1 / 3)
    assert [tuple(r) for r in got[2:]] == [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_search_marks_hits_and_ranks(spark):
    pages = spark.createDataFrame([("p1", "Paid John Smith of Bombay in full"), ("p2", "John wrote to Bombay"), ("p3", "nothing")], "page_id string, full_text string")
    got = search.full_text(pages, "John Smith Bombay").collect()
    assert [r.page_id for r in got] == ["p1"] and got[0].rank > 0
    assert "<b>John</b>" in got[0].snippet and "<b>Bombay</b>" in got[0].snippet
    assert search.full_text(pages, "the of").count() == search.full_text(pages, "unknownword").count() == 0
    parts = spark.createDataFrame([(got[0].snippet,)], "s string").select(T.snippet_parts(F.col("s")).alias("p")).first().p
    assert "".join(x.text for x in parts) == "Paid John Smith of Bombay in full" and [x.text for x in parts if x.marked] == ["John", "Smith", "Bombay"]
    with pytest.raises(ValueError):
        search.check_page("", 20, 0)


def test_indel_similarity():
    assert evaluate.indel_similarity("John Smith", "John Smyth") == pytest.approx(0.9)
    assert evaluate.indel_similarity("abc", "xyz") == 0 and evaluate.indel_similarity("", "") == 1


def test_multiset_scores(spark):
    pred = spark.createDataFrame([("date", "a"), ("date", "a"), ("person", "x")], "entity_type string, value string")
    ref = spark.createDataFrame([("date", "a"), ("amount", "z")], "entity_type string, value string")
    got = {r.entity_type: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate.scores(evaluate.entity_counts(pred, ref)).collect()}
    assert got == {"date": (1, 1, 0, 0.5, 1.0), "person": (0, 1, 0, 0.0, 1.0), "amount": (0, 0, 1, 1.0, 0.0)}
    missed, spurious = evaluate.entity_diff(pred, ref)
    assert missed.collect() == [("amount", "z")] and sorted(map(tuple, spurious.collect())) == [("date", "a"), ("person", "x")]


def test_greedy_matching_takes_the_best(spark):
    schema = "page_id string, idx int, kind string, x int, y int, w int, h int"
    pred = spark.createDataFrame([("p", 0, "table", 0, 0, 10, 10), ("p", 1, "table", 2, 0, 10, 10)], schema)
    ref = spark.createDataFrame([("p", 0, "table", 2, 0, 10, 10)], schema)
    got = evaluate.greedy_matches(evaluate.box_pairs(pred, ref)).collect()
    assert [(r.p, r.r, r.iou) for r in got] == [(1, 0, 1.0)]
    score = evaluate.layout_score(evaluate.greedy_matches(evaluate.box_pairs(pred, ref)), pred, ref).first()
    assert (score.matched, score.error_count, score.recall, score.precision) == (1, 1, 1.0, 0.5)


def test_reading_order(spark):
    boxes = spark.createDataFrame([("p", 0, 700, 100, 200, 60), ("p", 1, 100, 105, 200, 60), ("p", 2, 100, 900, 200, 60)], "page_id string, box_id long, x long, y long, w long, h long")
    assert [r.box_id for r in geometry.reading_order(boxes).orderBy("reading_order").collect()] == [1, 0, 2]


def draw(*boxes, circle=None):
    page = np.full((1400, 1000), 255, np.uint8)
    for x, y, w, h in boxes:
        page[y : y + h, x : x + w] = 0
    if circle:
        cx, cy, r = circle
        y, x = np.ogrid[:1400, :1000]
        page[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = 0
    return page


LAYOUTS = [
    (draw(*((100, 300 + 30 * k, 600, 20) for k in range(5))), ["paragraph"]),
    (draw(*((200 + 55 * c, 400 + 30 * r, 40, 20) for r in range(4) for c in range(3))), ["table"]),
    (draw((700, 1300, 150, 25)), ["signature"]), (draw(circle=(150, 150, 40)), ["stamp"]), (draw((10, 500, 60, 15)), ["margin_annotation"]),
]


@pytest.mark.parametrize("page,kinds", LAYOUTS)
def test_region_types_of_drawn_pages(spark, tmp_path, page, kinds):
    (tmp_path / "p.png").write_bytes(image.write_png(page))
    found = files.list_documents(spark, str(tmp_path))
    comps, boxes = files.component_table(found), files.box_table(found)
    assert [r.region_type for r in geometry.classify_regions(boxes, comps).collect()] == kinds


def test_image_kernels():
    page = draw(*((100, 300 + 60 * k, 800, 20) for k in range(10)))
    assert abs(image.skew(image.rotate(page, 5.0, 255)) + 5.0) <= 1.0
    framed = np.pad(page, 30)
    assert image.auto_crop(framed).shape == page.shape
    assert (image.read_png(image.write_png(page)) == page).all()
    color = np.random.default_rng(0).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    assert (image.read_png(image.write_png(color)) == color).all()
    assert 0 <= image.quality(page) <= 1 and image.quality(page) > image.quality(np.full((50, 50), 200, np.uint8))
    with pytest.raises(ValueError):
        image.preprocess(page, ["no such step"])
    with pytest.raises(ValueError):
        image.gray(np.zeros((0, 3), np.uint8))
    assert image.header(b"II*\0\x08\0\0\0\x02\0\0\x01\x03\0\x01\0\0\0\x05\0\0\0\x01\x01\x03\0\x01\0\0\0\x07\0\0\0\0\0\0\0") == [(5, 7)]
    labels, n = image.label(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 1]], bool))
    assert n == 3 and labels[0, 0] == labels[0, 2] == labels[1, 1]


def test_listing_and_checks(spark, tmp_path):
    (tmp_path / "b.PNG").write_bytes(image.write_png(draw((1, 1, 5, 5))))
    (tmp_path / "a.pdf").write_bytes(b"x" * 20 + b"%PDF-1.4")
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.png").write_bytes(b"")
    found = files.list_documents(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.verdict for r in files.checked(found).collect()}
    assert got == {"b.PNG": "ok", "a.pdf": "ok", "bad.tif": "unreadable"}
    good, bad = files.ingest(found)
    assert good.count() == 2 and bad.count() == 1
    assert {r.id for r in good.collect()} == {r.id for r in files.ingest(found)[0].collect()}


def test_streaming_ingest_sees_a_file_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(image.write_png(draw((1, 1, 5, 5))))
    for expected in (1, 1):
        ingest.watch(spark, source, out, mark).awaitTermination()
        assert spark.read.parquet(f"{out}/documents").count() == expected
    (tmp_path / "in" / "b.png").write_bytes(image.write_png(draw((1, 1, 9, 5))))
    ingest.watch(spark, source, out, mark).awaitTermination()
    assert spark.read.parquet(f"{out}/documents").count() == 2


def test_ground_truth_keeps_null_apart_from_empty(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"id":"a","image":"a.png","status":"done","text":"t","entities":[],"regions":null,"page":1},{"id":"b","image":"a.png","status":"wrong","text":"","regions":[],"page":3}]')
    examples = files.ground_truth(spark, str(tmp_path / "g.json"))
    assert {r.id: r.regions for r in examples.collect()} == {"a": None, "b": []}
    images = spark.createDataFrame([("a.png", 2), ("z.png", 1)], "image string, pages int")
    got = files.drop_in(examples, images)
    assert got["done"].count() == 1 and [r.image for r in got["unlabelled"].collect()] == ["z.png"]
    assert sorted(r.problem for r in got["problems"].collect()) == ["no such page", "unknown status"]
    new, skipped = files.stubs(examples, images)
    assert sorted((r.image, r.page) for r in new.collect()) == [("a.png", 2), ("z.png", 1)] and skipped.count() == 0


def test_validation_and_unique_ids(spark):
    rows = spark.createDataFrame([("1", "d", 1, None), ("2", None, 2, None)], "id string, document_id string, page_number int, full_text string").withColumn("created_at", F.current_timestamp())
    good, bad = schemas.validate("pages", schemas.conform(rows, "pages"))
    assert good.count() == 1 and bad.first().problems == ["document_id is null"]
    wanted = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "id string, k int")
    taken = spark.createDataFrame([("x",), ("x-3",)], "id string")
    assert [r.unique_id for r in files.unique_ids(wanted, taken, "id", "k").orderBy("k").collect()] == ["x-2", "x-4", "y"]


def test_severity_and_detectors(spark):
    ocr = spark.createDataFrame([("p", "r1", 55.0, "text"), ("p", "r2", 5.0, "text"), ("p", "r3", 65.0, "hello world"), ("p", "r4", 70.0, "#%&*"), ("p", "r5", 85.0, "")], "page_id string, region_id string, ocr_confidence double, text string")
    words = spark.createDataFrame([("r3", "hello", 40.0), ("r3", "world", 90.0), ("r1", "text", 10.0)], "region_id string, text string, conf double")
    low = {(r.region_id, r.raw_text, r.severity) for r in anomaly.low_confidence(ocr, words).collect()}
    assert low == {("r1", "text", "low"), ("r3", "hello", "medium")}
    assert {r.region_id for r in anomaly.illegible(ocr).collect()} == {"r2", "r4"}


def test_client_ip_and_rates(spark):
    rows = spark.createDataFrame([("10.0.0.1", "9.9.9.9, 8.8.8.8"), ("5.5.5.5", "9.9.9.9"), ("10.0.0.1", "")], "peer string, fwd string")
    assert [r[0] for r in rows.select(control.client_ip(F.col("peer"), F.col("fwd"), ["10.0.0.1"])).collect()] == ["8.8.8.8", "5.5.5.5", "10.0.0.1"]
    assert control.parse_rate("60/minute") == (60, 60)


def test_corrections_update_typed_columns(spark):
    e = spark.sql("SELECT 1L AS entity_id, 'date' AS entity_type, 'x' AS raw_text, '1897-03-03' AS normalized_value, date'1897-03-03' AS date_value, CAST(NULL AS DECIMAL(14,2)) AS amount_value, CAST(NULL AS STRING) AS amount_currency")
    c = spark.sql("SELECT * FROM VALUES (1L, 1L, '1899-01-01', 1), (1L, 2L, '1900-02-03', 2) AS t(entity_id, correction_id, corrected_value, created_at)")
    got = review.apply_corrections(e, c).first()
    assert (got.normalized_value, str(got.date_value), got.raw_text, got.n_corrections) == ("1900-02-03", "1900-02-03", "x", 2)


def test_pounds_round_as_binary_values(spark):
    rows = spark.createDataFrame([("£3 12s 6d",), ("£3 25s",), ("none",)], "t string").select(X.pounds_text(X.pounds(F.col("t")).cast("struct<pounds:int,shillings:int,pence:int>")))
    assert [r[0] for r in rows.collect()] == ["GBP 3.62", None, None]


def test_pdf_mark_at_any_byte(spark):
    rows = [(b"%PDF-1.7",), (b"\x12%PDF-",), (b"\x02\x55\x04\x44\x62\xd0 %PDF-",), (b"x" * 1020 + b"%PDF-",), (b"x" * 1019 + b"%PDF-",), (b"\x02\x55\x04\x44\x62\xd0",), (b"",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "content binary").select(files.is_pdf(F.col("content"))).collect()]
    assert got == [True, True, True, False, True, False, False, None]


def test_words_and_listings_with_nulls(spark):
    words = spark.createDataFrame([("a", "9.5"), (" ", "1"), (None, "1"), ("b", "-1"), ("c", "x"), ("d", None), ("e", "NaN"), ("f", "0")], "text string, conf string")
    assert [(r.text, r.conf) for r in control.typed_words(words).collect()] == [("a", 9.5), ("f", 0.0)]
    listings = spark.createDataFrame([(1, "p"), (1, "p"), (2, "p"), (4, "p"), (4, "q")], "scan long, path string")
    assert sorted(map(tuple, control.arrivals(listings).collect())) == [(1, "p"), (4, "p"), (4, "q")]
