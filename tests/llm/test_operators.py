"""Operators over small Spark tables against brute force, with the cases that each must define."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, chroma, decontaminate, factorization, hmm, quality, repair, setsketch, words, wrappers

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, toxicity string"


def docs_of(spark, rows):
    """documents with two extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in rows], SCHEMA).repartition(3)


def some_texts(seed, n, vocabulary=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]


EDGES = [(None, "no id"), (7, None), (8, ""), (9, " \n\t "), (10, "one"), (10, "one"), (11, "ONE"), (12, "x " * 3000)]


def test_hmm_counts_and_base_score(spark):
    rows = [*EDGES, *((100 + i, t) for i, t in enumerate(some_texts(1, 60)))]
    got = hmm.score_documents(spark, docs_of(spark, rows), head=50, own=20, states=3, rounds=1, init_docs=20).toPandas()
    assert len(got) == len(rows)
    key = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in rows if key(i) % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = sorted((-1 if i is None else i, key(i) % 10 == 0, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5)) for i, t in rows)
    seen = sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got.itertuples())
    assert seen == expected
    assert np.isfinite(got.score).all() and (got.score < 0).all()


def test_hmm_scores_against_sums_over_state_paths(spark, monkeypatch):
    """The model that the operator trained, applied by a plain recursion over words; each class gives its words, known and
    not, probabilities that add up to one."""
    rows = [*((i, t) for i, t in enumerate(some_texts(2, 60, 40))), (900, ""), (901, "zzzz never seen"), (902, None), (903, "x " * 400)]
    spied, plain = {}, hmm.Scorer.score

    def spy(self, encoded, counts, model):
        spied.update(model=model, top=self.most_frequent(counts))
        return plain(self, encoded, counts, model)

    monkeypatch.setattr(hmm.Scorer, "score", spy)
    arguments = {"head": 15, "own": 6, "states": 3, "rounds": 2, "init_docs": 30}
    got = hmm.score_documents(spark, docs_of(spark, rows), **arguments).toPandas().set_index("doc_id").score
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in (t or "").lower().split())

    def scanned(word):
        (s,) = words.scan(pa.array([word]))
        return int(s.hashes[0]), int(hmm.tails(s, np.array([0]))[0])

    number = {int(np.int64(r.w).astype(np.uint64)): k for k, r in enumerate(spied["top"][:6])}
    symbol = {w: number.get(scanned(w)[0], -1) for w in {*count, *"zzzz never seen x".split()}}
    classes: dict = {}
    for w, c in count.items():
        if symbol[w] < 0:
            total = classes.setdefault(scanned(w)[1], [0.0, 0])
            total[0], total[1] = total[0] + c, total[1] + 1
    within = lambda w: (count[w] + 0.1) / (classes.get(k := scanned(w)[1], [0.0, 0])[0] + 0.1 * (classes.get(k, [0, 0])[1] + 1))
    for k, (total, distinct) in classes.items():
        known = [w for w in count if symbol[w] < 0 and scanned(w)[1] == k]
        assert len(known) == distinct and abs(sum(map(within, known)) + 0.1 / (total + 0.1 * (distinct + 1)) - 1) < 1e-9
    m = spied["model"]
    assert np.allclose([m.start.sum(), *m.move.sum(1), *m.emit.sum(0)], 1)
    for i, t in rows:
        state, log = m.start, 0.0
        for k, w in enumerate([*(t or "").lower().split(), None]):
            if k:
                state = state @ m.move
            own = w is None or symbol[w] >= 0
            state = state * (m.emit[0] if w is None else m.emit[symbol[w] + 1] if own else m.emit[7 + scanned(w)[1]] * within(w))
            log, state = log + math.log10(state.sum()), state / state.sum()
        assert abs(log - got[i]) < 1e-6 * max(1, abs(log)), (i, log, got[i])
    assert hmm.score_documents(spark, docs_of(spark, rows).where("false"), **arguments).count() == 0


def test_head_is_filled_where_counts_tie(spark):
    counts = spark.createDataFrame([(k, 3, 0) for k in range(50)] + [(100 + k, 9, 0) for k in range(4)], "w long, c long, bucket int")
    for head, want in ((2, [100, 101]), (4, [100, 101, 102, 103]), (7, [100, 101, 102, 103, 0, 1, 2]), (90, [100, 101, 102, 103, *range(50)])):
        assert [r.w for r in hmm.Scorer(spark, head, 1, 1, 1, 1, 0.0).most_frequent(counts)] == want


def test_chat_against_sql(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        turns = [("user" if t % 2 == 0 else "assistant", f"{rng.randint(0, 1)}" * (t + 1)) for t in range(rng.randint(1, 4))]
        rows += [(k, t, *turns[t]) for t in range(len(turns))]
    rows += [(90, None, None, None), (91, 0, "", "a"), (92, 0, "a", ""), (93, 0, "user", "0"), (93, 0, "user", "0"), (None, 0, "user", "x"), (None, 1, "user", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    got = chat.render(frame).toPandas()
    con = duckdb.connect()
    con.register("conversations", frame.drop("position").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(chat.ORACLE_SQL).df()
    norm = lambda d: sorted((-1 if pd.isna(r.conv_id) else int(r.conv_id), int(r.n_turns), int(r.copies), r.text) for r in d.itertuples())
    assert norm(got) == norm(want)
    assert chat.render(frame.where("false")).count() == 0


def test_pages_of_edge_cases(spark):
    body = "<html><body><nav>menu</nav><article><h1>T</h1><p>one &amp; two</p><p>three</p></article><footer>f</footer></body></html>"
    rows = [(1, "http://h.example/a", body), (2, "http://h.example/b", body.replace("<p>three</p>", "")), (3, None, body), (4, "http://h.example/c", None), (5, "http://h.example/d", ""), (1, "http://h.example/a", body)]
    got = wrappers.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).toPandas()
    texts = {r.page_id: r.text for r in got.itertuples()}
    assert texts == {1: "T\n\none & two\n\nthree", 2: "T\n\none & two", 3: "T\n\none & two\n\nthree", 4: "", 5: ""} and len(got) == 6
    assert all(r.n_chars == len(r.text) for r in got.itertuples())


def test_wrappers_join_when_they_are_too_many_to_broadcast(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/{k}", f"<article><p>text {k}</p></article>") for k in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert sorted(r.text for r in wrappers.main_text(spark, frame).collect()) == sorted(f"text {k}" for k in range(12))


def layouts(rng, pages, rare):
    """Pages of one host whose tags say nothing, a few of each of `rare` layouts, and their articles."""
    said = lambda k: f"{k} " + " ".join(rng.choice(["ore", "lind", "tam", "vess"]) for _ in range(rng.randint(8, 30)))
    for k in range(pages):
        parts = [said(k) for _ in range(rng.randint(3, 6))]
        own = f"<h{2 + k % 5}>{parts[1]}</h{2 + k % 5}><table><tr>" + f"<td>{parts[2]}</td>" * (1 + k // 5) + "</tr></table><dl></dl>" * (k % 3) if k < rare else f"<p>{parts[1]}</p><p>{parts[2]}</p>"
        html = f"<body><div>All rights kept</div><div class='k3'><i>{parts[0]}</i>{own}" + "".join(f"<p>{x}</p>" for x in parts[3:]) + "</div><div>Terms of use</div></body>"
        yield k, "http://one.example/", html


@pytest.mark.parametrize("streams", [None, 3])
def test_all_pages_of_a_host_give_its_wrapper(spark, monkeypatch, streams):
    if streams:
        monkeypatch.setattr(wrappers, "STREAMS", streams)
    rows = list(layouts(random.Random(33), 120, 15))
    frame = spark.createDataFrame(rows + rows[:5], "page_id long, url string, html string")
    got = wrappers.main_text(spark, frame).toPandas()
    assert len(got) == 125 and got.matched.all()
    assert not got.text.str.contains("All rights kept|Terms of use").any()
    # The counts of the wrapper are those of all different pages.
    ((_, wrapper),) = wrappers.wrappers(spark, frame.withColumn("host", wrappers.host_of())).collect()
    nodes, tally = json.loads(wrapper)[0], wrappers.Tally()
    for _, _, html in rows:
        page = wrappers.stream(wrappers.Page(html))
        tally.add(wrappers.places(wrappers.program(nodes), page.tags), page.kinds, page.hashes)
    assert tally.pages == 120 and wrappers.compiled((nodes, tally)) == wrapper


def test_template_is_judged_by_all_pages_of_a_host(spark):
    line = lambda k: f"By the writer {k}" if k in (31, 150) else "By the desk"
    rows = [(k, f"http://one.example/{k}", f"<article><h1>Title {k}</h1><p>{line(k)}</p><p>Some words of {k}, and more of them</p></article>") for k in range(200)]
    got = wrappers.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.split("\n\n")[1] == line(r.page_id) for r in got) and len(got) == 200  # not all pages have it


def toxic_rows():
    rng = random.Random(5)
    rows, labels = [], []
    for i, t in enumerate(some_texts(6, 600)):
        bad = i % 5 == 0
        rows.append((i, t + (" " + rng.choice(["idiot", "moron", "scum"]) + "!" if bad else "")))
        labels.append((i, int(len(t) > 100), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = factorization.toxicity(spark, docs_of(spark, [*rows, *((i and 10_000 + i, t) for i, t in EDGES)]), marks).toPandas()
    assert len(got) == len(rows) + len(EDGES) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 10_000)]
    want = held.doc_id.map({i: x for i, _, x in labels})
    assert len(held) > 60 and (held.predicted == want).mean() > 0.97
    assert (got.predicted == (got.score >= 0.5)).all()
    none = factorization.toxicity(spark, docs_of(spark, rows[:5]), marks.where("false")).toPandas()
    assert (none.predicted == 0).all()


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i, t in enumerate(some_texts(7, 500)):
        junk = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if junk else t, "en", "bad" if junk and i % 8 else f"site{rng.randint(0, 40)}", 0))
        labels.append((i, int(not junk), 0))
    frame = spark.createDataFrame([*rows, (None, None, None, None, None), (900, "", None, "lone", 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("path", F.lit("clash"))
    got = quality.quality(spark, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    known = got[got.doc_id < 500]
    assert (known.keep == known.doc_id.map({i: bool(q) for i, q, _ in labels})).mean() > 0.98
    lone = got[got.doc_id == 900].iloc[0]
    bad = got[got.doc_id == 4].iloc[0]
    assert bad.host_rate < lone.host_rate and len(got) == 502
    assert quality.quality(spark, frame.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_token_ids_come_back_in_order(spark):
    from tokenizers import Tokenizer

    rows = [*EDGES, (13, "end <|endoftext|> of"), *((200 - i, t) for i, t in enumerate(some_texts(8, 80)))]
    path = public_tokenizers.path("word_bpe_49k.json")
    blocks = repair.write(spark, docs_of(spark, rows), path, block=500)
    got = repair.digests(repair.read(spark, blocks)).toPandas().sort_values("start")
    library = Tokenizer.from_file(path)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (i, t), r in zip(ordered, got.itertuples(), strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids)) and (pd.isna(r.doc_id) if i is None else r.doc_id == i)
        start += len(ids) // 4
    assert blocks.count() > 3
    assert repair.read(spark, repair.write(spark, docs_of(spark, rows).where("false"), path)).count() == 0


def test_byte_bpe_digests(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = [*EDGES, *((300 + i, t) for i, t in enumerate(some_texts(9, 30)))]
    got = bpe.encode_decode(docs_of(spark, rows), path, public_tokenizers.PATTERN, step=7).collect()
    want = sorted((hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), t or "") for _, t in rows)
    assert sorted((r.ids_sha256, r.decoded_sha256, r.decoded) for r in got) == want


def test_decontamination_against_plain_scores(spark):
    rng = random.Random(11)
    items = [(k, " ".join("".join(rng.choice("abcdefghijkl") for _ in range(4)) for _ in range(rng.randint(8, 40)))) for k in range(30)]
    rows = [(i, t) for i, t in enumerate(some_texts(12, 60))]
    rows += [(1000 + k, rows[k][1] + " " + t.capitalize() + "! " + rows[k + 1][1]) for k, t in items]
    rows += [(2000 + k, " ".join(t.split()[: len(t.split()) // 3])) for k, t in items]
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, "zz yy xx ww")], "item_id long, text string")
    for shard in (7, 1000):
        got = decontaminate.contaminated(spark, docs_of(spark, [*rows, *EDGES]), bench, shard=shard).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1000 + k, k) for k, _ in items}
        named = [(7, t) for _, t in rows]  # one id for all: rows are judged by their texts
        left = decontaminate.clean(spark, docs_of(spark, [*named, (None, items[3][1])]), bench, shard=shard).collect()
        assert sorted(r.text for r in left) == sorted(t for i, t in rows if not 1000 <= i < 2000)
    assert decontaminate.contaminated(spark, docs_of(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.clean(spark, docs_of(spark, rows), bench.where("false")).count() == len(rows)


def test_hits_do_not_depend_on_shards(spark):
    """Parts of items near the threshold, items of several length classes and without an id; scores by plain BM25."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    items = [(k if k % 5 else None, " ".join(rng.choice(words) for _ in range(rng.choice([9, 30, 70, 150])))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for k, (_, text) in enumerate(items):
        part = text.split()
        size = int(len(part) * rng.uniform(0.8, 1.0))
        rows.append((k, " ".join([*(rng.choice(words) for _ in range(20)), *part[:size], *(rng.choice(words) for _ in range(20))])))
    found = []
    for shard in (3, 11, 1000):
        got = decontaminate.contaminated(spark, docs_of(spark, rows), bench, threshold=0.7, shard=shard).collect()
        found.append(sorted((r.doc_id, r.item_id if r.item_id is not None else -1, round(r.score, 6)) for r in got))
    assert found[0] == found[1] == found[2] and 10 < len(found[0]) < 200 and any(i == -1 for _, i, _ in found[0])
    texts = [t.split() for _, t in items]
    df, mean = Counter(w for t in texts for w in set(t)), sum(map(len, texts)) / len(texts)
    weight = lambda t, w: math.log1p((len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    best = {}
    for doc, text in rows:
        d = text.split()
        for k, t in enumerate(texts):
            size = max(64, 1 << (len(t) - 1).bit_length())
            total = sum(weight(t, w) for w in set(t))
            for at in range(0, len(d), size):
                passage = set(d[at : at + 2 * size])
                score = sum(weight(t, w) for w in set(t) & passage) / total
                best[doc, k] = max(best.get((doc, k), 0.0), score)
    reached = {(doc, round(v, 6)) for (doc, _), v in best.items() if v >= 0.7}
    assert {(d, s) for d, _, s in found[0]} <= reached
    assert {k for (k, j), v in best.items() if k == j and v >= 0.95} <= {d for d, *_ in found[0]}


def plain_components(rows, percent=85):
    """Brute force over all pairs: (id, set size, component, kept), null ids as -1 and never naming one."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((-1 if i is None else i, len(sets[k]), least.get(find(k), -1), i is not None and least.get(find(k)) == i) for k, (i, _) in enumerate(rows))


def mutated(rng, words, share):
    return " ".join(w if rng.random() > share else "".join(rng.choice("xyz") for _ in range(6)) for w in words)


def test_near_duplicates_against_brute_force(spark):
    """A source with many copies that link to it alone, chains, exact copies, short and empty texts."""
    rng = random.Random(13)
    words = [w for t in some_texts(14, 12) for w in t.split()][:200]
    rows = [(500 + i, mutated(rng, words, 0.012)) for i in range(60)] + [(560, " ".join(words))]
    chain = words[:]
    for k in range(15):
        chain = chain[:]
        chain[k * 10] = f"new{k}"
        rows.append((600 + k, " ".join(chain)))
    rows += [(700 + k, rows[0][1].upper()) for k in range(10)] + [(800 + i, t) for i, t in enumerate(some_texts(15, 80))] + EDGES
    got = setsketch.near_duplicates(spark, docs_of(spark, rows)).toPandas()
    seen = sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), int(r.n_shingles), -1 if pd.isna(r.component_id) else int(r.component_id), bool(r.kept)) for r in got.itertuples())
    assert seen == plain_components(rows)
    assert setsketch.near_duplicates(spark, docs_of(spark, rows).where("false")).count() == 0


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    from corpus_pipeline import drop_near_duplicates

    words = [f"w{i}" for i in range(100)]
    near = [{30: "x", 60: "y"}.get(i, w) for i, w in enumerate(words)]  # 86 of 106 shingles
    far = [{10: "x", 40: "y", 70: "z"}.get(i, w) for i, w in enumerate(f"v{i}" for i in range(100))]  # 81 of 111
    docs = docs_of(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"v{i}" for i in range(100))), (4, " ".join(far))])
    assert sorted(r.doc_id for r in drop_near_duplicates(spark, docs, "").collect()) == [1, 3, 4]
    assert sum(r.kept for r in setsketch.near_duplicates(spark, docs).collect()) == 4


def test_crossing_blocks_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    monkeypatch.setattr(setsketch, "COLUMNS", 16)
    rng = random.Random(16)
    words = [w for t in some_texts(17, 12) for w in t.split()][:150]
    rows = [(i, mutated(rng, words, 0.015)) for i in range(40)]
    got = setsketch.near_duplicates(spark, docs_of(spark, rows)).toPandas()
    assert sorted((int(r.doc_id), int(r.n_shingles), int(r.component_id), bool(r.kept)) for r in got.itertuples()) == plain_components(rows)


def test_keep_one_goes_by_rows(spark):
    """Ids that repeat, copies without an id, rows without words and equal rows."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black")
    rows = [(5, a), (10, a), (10, b), (None, a), (None, c), (None, c.upper()), (20, ""), (20, ""), (21, None), (None, " "), (30, "x y"), (30, "x y")]
    got = setsketch.keep_one(spark, docs_of(spark, rows).withColumn("mark", F.lit("clash")))
    found = sorted(((-1 if r.doc_id is None else r.doc_id), (r.text or "").lower()) for r in got.collect())
    assert found == sorted([(5, a), (10, b), (-1, c), (20, ""), (20, ""), (21, ""), (-1, " "), (30, "x y")])
    assert got.columns == [*docs_of(spark, rows).columns, "mark"]
    assert setsketch.keep_one(spark, docs_of(spark, rows).where("false")).count() == 0


def test_intersections_of_sets():
    rng = np.random.default_rng(6)
    left, right = ([np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in rng.integers(1, 60, 20)] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert setsketch.intersections(left, right).tolist() == want
    assert setsketch.intersections([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_audio_search_recall(spark):
    rng = np.random.default_rng(18)
    base = rng.normal(size=(40, 64))
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)]
    for k in range(120):
        rows.append((100 + k, (base[k % 40] + rng.normal(0, 0.03, 64)).tolist()))
    rows += [(400 + k, base[0].tolist()) for k in range(30)] + [(None, base[1].tolist()), (999, None), (998, [])]
    media = chroma.media(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = chroma.search(spark, media, every=10).toPandas()
    members = got[got.match_class_id.isna()]
    assert len(members) == len(rows)
    class_of = {int(r.id): int(r.class_id) for r in members.itertuples() if not pd.isna(r.id)}
    assert {class_of[400 + k] for k in range(30)} == {0}
    prints = {i: chroma.fingerprint(chroma.render(v)) for i, v in rows if i is not None}
    firsts = sorted(set(class_of.values()))
    asked = {c for i, c in class_of.items() if i % 10 == 0 and len(prints[i])}
    want = set()
    for a in asked:
        for b in firsts:
            if a != b and len(prints[b]):
                best = min((w / n for o in range(-60, 61) for w, n in [chroma.bit_errors(prints[a], prints[b], o)] if n >= 32 * 50), default=1.0)
                if best <= 0.1:
                    want.add((a, b))
    found = {(int(r.class_id), int(r.match_class_id)) for r in got[~got.match_class_id.isna()].itertuples()}
    assert want and len(found & want) >= 0.9 * len(want)
    for r in got[~got.match_class_id.isna()].itertuples():  # every match is one
        wrong, bits = chroma.bit_errors(prints[int(r.class_id)], prints[int(r.match_class_id)], int(r.offset))
        assert bits >= 32 * 50 and wrong / bits <= 0.1 and abs(wrong / bits - r.bit_error_rate) < 1e-12


def test_audio_search_with_heavy_integers_and_cut_recordings(spark, monkeypatch):
    """The same result where common integers are dealt out; shifted cuts of a recording match at their offset; two positions
    that agree by chance are no match; extra columns and empty tables."""
    rng = np.random.default_rng(19)
    base = [chroma.render(rng.normal(size=64)) for _ in range(6)]
    cut = base[0][2 * 128 * 8 :]  # eight notes later
    rows = [(k * 50, p) for k, p in enumerate(base)] + [(1001, cut), (1002, base[1][: 2 * 128 * 40]), (1003, base[2][: 2 * 700]), (1004, None)]
    media = spark.createDataFrame(rows, "id long, pcm binary").withColumn("print", F.lit("clash"))
    plain = sorted(map(tuple, chroma.search(spark, media).where("match_class_id is not null").collect()), key=str)
    monkeypatch.setattr(chroma, "HEAVY", 2)
    assert sorted(map(tuple, chroma.search(spark, media).where("match_class_id is not null").collect()), key=str) == plain
    found = {(r.class_id, r.match_class_id): r.offset for r in chroma.search(spark, media).where("match_class_id is not null").collect()}
    assert found[0, 1001] == -8 * 128 // chroma.HOP and found[50, 1002] == 0
    assert set(found) <= {(0, 1001), (50, 1002), (100, 1003)}
    assert chroma.search(spark, media.where("false")).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_rows()
    rows = [(i, t) for i, t in rows] + [(5000 + i, t) for i, t in rows[1:4]]
    items = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (1, "nu xi omicron pi rho sigma tau upsilon phi chi psi omega")]
    rows.append((6000, "words before " + items[0][1] + " words after"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i, _, x in labels if x}
    clean = [(i, t) for i, t in rows if i not in toxic]
    want = {i for i, _, _, kept in plain_components(clean) if kept} - {6000}
    assert not got & (toxic | {6000, 5000, 5001, 5002})
    assert len(want - got) <= 0.01 * len(want) and got <= want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "byte_bpe"]
