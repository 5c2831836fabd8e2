"""Kernels of the training-data operators against plain definitions."""

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import bpe, chroma, decontaminate, factorization, hmm, repair, setsketch, words, wrappers

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_words(text):
    return text.encode().lower().split()


def test_scan_agrees_with_split():
    texts = ["", "  a B\tc\n", "ÀÉ x", None, "one", "Z" * 50 + " " + "z" * 50, "\x0b\x0c"]
    seen = {}
    for s in words.scan(pa.array(texts)):
        for k, text in enumerate(texts[s.first : s.first + len(s.splits) - 1]):
            got = s.hashes[s.splits[k] : s.splits[k + 1]].tolist()
            expected = plain_words(text or "")
            assert len(got) == len(expected)
            for w, h in zip(expected, got, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_piece_table_starts_afresh_when_full():
    table = words.PieceTable(lambda found: (np.frombuffer(b"".join(p.ljust(8, b"_")[:8] for p in found), "<u4"), np.full(len(found), 2)), most=20)
    rng = random.Random(6)
    for _ in range(20):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(30)) for _ in range(3)]
        for s in words.scan(pa.array(texts)):
            ids, lengths = table.ids(s, np.arange(len(s.starts)))
            assert ids.tobytes() == b"".join(w.encode().ljust(8, b"_")[:8] for t in texts for w in t.split()) and set(lengths) == {2}


def test_hash_index_finds_all_and_only_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64) << np.uint64(1))
    index = words.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1)) == -1).all()


def test_transducer_equals_merges_and_library():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["", " ", "  two  spaces \n\n x", "don't I'll 's", "日本語 テスト", "a" * 400, "1234 56", " nbsp  ", "Thé é́ ñ", "x\n y\t\t z  "]
    texts += ["".join(rng.choice("the and on er  \n.é0ß") for _ in range(200)) for _ in range(50)]
    for text, ids in zip(texts, coder.encode_all(pa.array(texts)), strict=True):
        assert ids == coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    for word in (b" theation", "éééß".encode(), b"ononononon"):
        assert list(coder.machine.encode(word)) == coder.machine.merge(word)
        assert list(coder.machine.stream([word[:2], word[2:]])) == coder.machine.merge(word)


def test_transducer_meets_its_states_again():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    machine, rng = bpe.Transducer(ranks), random.Random(8)
    parts = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve".split()
    made = [(" " + "".join(rng.choices(parts, k=rng.randint(2, 7)))).encode() for _ in range(10000)]
    for word in made:
        assert list(machine.encode(word)) == machine.merge(word) == list(machine.stream([word[:3], word[3:]]))
    assert len(machine.states) < 0.2 * sum(map(len, made))
    states = len(machine.states)
    small = bpe.Transducer(ranks, max_states=50)
    assert [list(small.encode(word)) for word in made[:300]] == [list(machine.encode(word)) for word in made[:300]]
    assert len(machine.states) == states and len(small.states) < 1000


def test_utf8_stream_at_every_cut():
    text = "aé日𝄞b"
    data = text.encode()
    for i in range(len(data) + 1):
        machine = bpe.Utf8Stream()
        assert machine.feed(data[:i]) + machine.feed(data[i:]) + machine.finish() == text


def test_forward_equals_sum_over_paths():
    rng = np.random.default_rng(0)
    states, symbols = 3, 5
    model = hmm.Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T.copy())
    seqs = [rng.integers(0, symbols, n).astype(np.int32) for n in (1, 4, 6, 3)]
    got = np.zeros(len(seqs))
    for take, block, alive in hmm.batches(seqs):
        got[take] = hmm.forward(model, block, alive)[0]
    import itertools

    for s, g in zip(seqs, got, strict=True):
        total = 0.0
        for path in itertools.product(range(states), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert np.isclose(np.log(total), g)
    counts = hmm.expect(model, seqs)
    assert np.isclose(counts[:symbols].sum(), sum(map(len, seqs)))
    assert np.isclose(counts[symbols:-1].sum(), sum(len(s) - 1 for s in seqs))
    assert np.isclose(counts[-1].sum(), len(seqs))


def test_baum_welch_does_not_lower_likelihood():
    rng = np.random.default_rng(5)
    seqs = [np.concatenate([rng.integers(0, 4, 20) + 4 * (k % 2)]).astype(np.int32) for k in range(20)]
    prior = np.full(8, 1e-6)
    splits, symbol, share = hmm.profiles(seqs, 8)
    cells = np.zeros((len(seqs), 8))
    cells[np.repeat(np.arange(len(seqs)), np.diff(splits)), symbol] = share
    assert np.allclose((cells**2).sum(1), 1)
    seeds = hmm.farthest(cells, 2)
    assert len(set(hmm.nearest(seqs[::2], seeds).tolist())) == len(set(hmm.nearest(seqs[1::2], seeds).tolist())) == 1
    model = hmm.begin(hmm.assigned(seqs, seeds), prior)
    assert np.isclose(hmm.assigned(seqs, seeds).sum(), sum(map(len, seqs)))
    logs = []
    for _ in range(4):
        logs.append(sum(hmm.forward(model, b, a)[0].sum() for _, b, a in hmm.batches(seqs)))
        assert np.isclose(hmm.expected(model, seqs)[1], logs[-1])
        model = hmm.maximise(hmm.expect(model, seqs), prior)
    assert all(b >= a - 0.5 for a, b in zip(logs, logs[1:]))


@pytest.mark.parametrize("size", [0, 1, 2, 300, 5000])
def test_grammar_round_trip_and_random_access(size):
    rng = np.random.default_rng(size)
    docs = [np.append(rng.integers(3, 9, max(0, int(n))), 2) for n in rng.integers(0, 60, 1 + size // 20)]
    docs[0] = np.append(np.tile([5, 6], size // 2), 2)
    ids = np.concatenate(docs).astype(np.uint32)
    block = repair.Block(repair.write_block(ids, np.array([len(d) for d in docs]), 2))
    assert (block.ids() == ids).all()
    assert block.sizes().tolist() == [len(d) for d in docs]
    for k, d in enumerate(docs):
        assert block.document(k).tolist() == d.tolist()
        assert block.document(k, 1, 3).tolist() == d[1:4].tolist()
    if size == 5000:
        assert block.size < len(ids) / 2


@pytest.mark.parametrize("seed", range(6))
def test_grammar_goes_to_its_end(seed):
    """No pair within documents occurs three times without overlap, and rules refer to earlier rounds only."""
    rng = np.random.default_rng(seed)
    ids = rng.integers(2, 3 + seed, 4000).astype(np.uint32)
    ids[::97] = 2
    ids = np.concatenate((ids, np.full(50, 7, np.uint32), np.tile(np.array([3, 4, 5, 2], np.uint32), 30)))
    base, rounds, s = repair.compress(ids, 2)
    number, closed = base, {2}
    for part in rounds:
        assert part.max(initial=0) < number
        closed |= {number + k for k, (_, right) in enumerate(part.tolist()) if right in closed}
        assert not closed & set(part[:, 0].tolist())
        number += len(part)
    counts, last = {}, {}
    for i, pair in enumerate(zip(s.tolist(), s[1:].tolist())):
        if pair[0] not in closed and last.get(pair, -2) < i - 1:
            counts[pair] = counts.get(pair, 0) + 1
            last[pair] = i
    assert max(counts.values(), default=0) < repair.LEAST
    block = repair.Block(repair.write_block(ids, np.array([len(ids)]), 2))
    assert (block.ids() == ids).all()


def test_symbols_of_more_than_sixteen_bits_are_packed_in_planes():
    rng = np.random.default_rng(4)
    for bits in (16, 17, 21, 32):
        for n in (0, 1, 9, 1000):
            values = rng.integers(0, 1 << bits, n).astype(np.uint32)
            data = memoryview(repair._pack(values, bits))
            assert len(data) == repair._packed_size(n, bits)
            for a, b in ((0, n), (n // 3, n // 2), (n, n)):
                assert (repair._unpack(data, n, bits, a, b) == values[a:b]).all()


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(2)
    for j in (0.2, 0.6, 0.9):
        pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
        both = int(2000 * 2 * j / (1 + j))
        a, b = pool[:2000], np.concatenate((pool[:both], pool[2000 : 2000 + 2000 - both] if 4000 - both <= 3000 else rng.integers(0, 1 << 63, 2000 - both).astype(np.uint64)))
        r = setsketch.sketch([a, b]).astype(int)
        above, below = np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()])
        got = setsketch.estimate(above, below, setsketch.M - above - below, np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(got - j) < 0.2


def test_sketches_merge_by_maximum():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (40, 70))
    ra, rb, both = setsketch.sketch([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()


def test_block_max_wand_equals_exhaustive_scores():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary[: 10 + i]) for _ in range(rng.randint(5, 30)))) for i in range(50)]
    (index,) = decontaminate.build(items, 0.5)
    for threshold in (0.2, 0.5, 0.8):
        for _ in range(100):
            query = np.array(sorted(rng.sample(range(len(index.terms)), 15)))
            scores = np.zeros(len(items))
            for t in query:
                item, impact, _ = index.postings[t]
                scores[item] += impact
            expected = {int(i) for i in np.flatnonzero(scores >= threshold - 1e-9)}
            got = decontaminate.block_max_wand(index, query, threshold)
            assert {i for i, _ in got} == expected
            assert all(np.isclose(scores[i], s) for i, s in got)


def test_matcher_finds_planted_items_and_only_those():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(100 + i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(8)) + ".") for i in range(40)]
    matcher = decontaminate.Matcher(decontaminate.build(items, 0.5), 0.5, 0.5)
    clean = [" ".join(word() for _ in range(300)) for _ in range(20)]
    dirty = [c[:700] + " " + items[i][1].upper() + " " + c[700:] for i, c in enumerate(clean)]
    half = clean[0] + " " + items[3][1].split(".")[0]
    hits = matcher.documents(pa.array([*clean, *dirty, "", None, half]))
    assert {(row, item) for row, item, *_ in hits} == {(20 + i, 100 + i) for i in range(20)}


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for _ in range(1500):
        a, b = (rng.random(2) < 0.5).tolist()
        noise = rng.choice(np.arange(1000, 3000), 20, replace=False)
        docs.append(np.unique(np.concatenate((noise, [1] * a, [2] * b)).astype(np.int64)))
        labels.append(float(a and b))
    m = factorization.train(docs[:1200], np.array(labels[:1200]), l2=1e-4, epochs=30)
    right = 0
    for d, y in zip(docs[1200:], labels[1200:], strict=True):
        rows = m.row[d]
        rows = rows[rows >= 0]
        right += (m.margins(rows, np.array([0, len(rows)]))[0] > 0) == bool(y)
    assert right >= 295


def test_machine_learns_a_pair_of_words_that_are_neutral_alone():
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for _ in range(5000):
        one, two = (rng.random(2) < 0.1).tolist()
        insult = rng.random() < (0.01 if one != two else 0.11)
        noise = rng.choice(np.arange(1000, 3000), 20, replace=False)
        docs.append(np.unique(np.concatenate((noise, [1] * one, [2] * two, [3] * insult)).astype(np.int64)))
        labels.append(float(insult or (one and two)))
    labels = np.array(labels)
    known, truth = docs[:4000], labels[:4000]
    seen = np.bincount(np.concatenate(known), minlength=4)
    toxic = np.bincount(np.concatenate([d for d, y in zip(known, truth, strict=True) if y]), minlength=len(seen))
    assert factorization.association(toxic, seen, truth.sum(), len(truth))[[1, 2]].max() < 12
    m = factorization.train(known, truth)
    pairs = [d for d in docs[4000:] if {1, 2} <= set(d.tolist()) and 3 not in d]
    single = [d for d in docs[4000:] if len({1, 2} & set(d.tolist())) == 1 and 3 not in d]
    margin = lambda d: m.margins(r := m.row[d][m.row[d] >= 0], np.array([0, len(r)]))[0]
    assert len(pairs) >= 5 and all(margin(d) > 0 for d in pairs)
    assert len(single) > 100 and all(margin(d) < 0 for d in single)


PAGE = (
    "<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><ul>{nav}</ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1>{body}<form><input><label>Mail</label></form></article>"
    "<section id='comments'><article class='comment'><p>{long}</p></article></section><aside>Side</aside><footer>foot</footer></body></html>"
)


def page(k, n=3):
    return PAGE.format(nav="<li><a href='/x'>x</a></li>" * (k + 2), body="".join(f"<p>Par <b>{i}</b>\n of &eacute;{k}<br>end</p>" for i in range(n)), long="reply " * 500)


def test_page_main_text_and_wrapper():
    pages = [wrappers.Page(page(k, 2 + k)) for k in range(4)]
    expected = "A & B\n\n" + "\n\n".join(f"Par {i} of é1 end" for i in range(3))
    assert pages[1].text(pages[1].kinds) == expected
    wrapper = wrappers.compiled(wrappers.infer([wrappers.stream(p, k) for k, p in enumerate(pages)]))
    assert "+" in wrapper
    text, matched = wrappers.extract(wrappers.Page(page(1, 3)), wrapper)
    assert matched and text == expected
    text, matched = wrappers.extract(wrappers.Page("<table><tr><td>other"), wrapper)
    assert not matched and text == "other"


def nameless(rng, k, words=30):
    """A page whose tags and classes say nothing, and its article."""
    sentence = lambda: " ".join(rng.choice(["ore", "lind", "tam", "vess", "quo", "pel", "rast"]) for _ in range(rng.randint(5, words)))
    parts = [f"Title {k} {sentence()}", *(sentence() + f" {k}{j}" for j in range(rng.randint(1, 6)))]
    body = f"<div class='k3'><div class='q'>{parts[0]}</div>" + "".join(f"<p>{x}</p>" for x in parts[1:]) + "</div>"
    menu = "<div class='k1'>" + "".join(f"<span><a href='/{x}'>{x}</a></span>" for x in ("Home", "World", "Money", "Law")) + "</div>"
    return f"<body>{menu}<div class='k2'>All rights kept</div>{body}<div class='k4'><div>Call us</div><div>Terms of use</div></div></body>", "\n\n".join(parts)


def test_alignment_finds_the_template_where_names_say_nothing():
    rng = random.Random(31)
    pages = [nameless(rng, k) for k in range(40)]
    streams = [wrappers.stream(wrappers.Page(h), k) for k, (h, _) in enumerate(pages[:12])]
    wrapper = wrappers.compiled(wrappers.infer(streams))
    got = [wrappers.extract(wrappers.Page(h), wrapper) for h, _ in pages[12:]]
    assert sum(m for _, m in got) >= 25
    right = sum(text == want for (text, _), (_, want) in zip(got, pages[12:], strict=True))
    alone = sum(wrappers.extract(wrappers.Page(h), None)[0] == want for h, want in pages[12:])
    assert right >= 25 and alone == 0


def test_template_spares_other_texts_and_copies():
    rng = random.Random(32)
    pages = [nameless(rng, k) for k in range(12)]
    wrapper = wrappers.compiled(wrappers.infer([wrappers.stream(wrappers.Page(h), k) for k, (h, _) in enumerate(pages)]))
    other = pages[0][0].replace("All rights kept", "A new text in an old place")
    assert wrappers.extract(wrappers.Page(other), wrapper)[0] == "A new text in an old place\n\n" + pages[0][1]
    same = [pages[0][0].replace("</p></div>", f"</p><p>{k}</p></div>") for k in range(6)]  # one article, nearly
    wrapper = wrappers.compiled(wrappers.infer([wrappers.stream(wrappers.Page(h), k) for k, h in enumerate(same)]))
    assert pages[0][1] in wrappers.extract(wrappers.Page(same[1]), wrapper)[0]


def blocks(rng, most):
    out = []
    for _ in range(rng.randint(1, most)):
        kind = rng.randrange(8)
        body = [None] if kind < 5 else ["li", None, "/li"] * rng.randint(1, 4) if kind == 5 else [None, "b", None, "/b", None] if kind == 6 else ["br", *blocks(rng, 3)]
        out += [f"e{kind}", *body, f"/e{kind}"]
    return out


def test_wrapper_matches_every_page_it_grew_over_and_stays_small():
    rng = random.Random(34)
    pages = [blocks(rng, 30) for _ in range(400)]
    wrapper, grown = wrappers.grow(None, pages)
    steps = wrappers.program(wrapper)
    held = [wrappers.places(steps, p) for p in pages]
    assert all(h is not None and len(h) == p.count(None) for h, p in zip(held, pages, strict=True))
    assert len(grown) < 40 and len(steps) < 600
    more = [blocks(rng, 30) for _ in range(100)]
    wider, _ = wrappers.grow(wrapper, more)
    steps = wrappers.program(wider)
    assert all(wrappers.places(steps, p) is not None for p in pages + more)
    assert wrappers.places(wrappers.program([["*", [["?", ["a"]], ["*", ["b"]]]], "c"]), ["a", "b"] * 500) is None  # in time
    assert wrappers.places(wrappers.program([["*", ["p"]], "p", None]), ["p", "p", None]) == [0]


def test_article_passages_stay_whatever_their_ids_and_boilerplate_goes():
    source = (
        "<main><article><h2 id='related-work'>Related</h2><p>one</p><section id='discussion'><p id='social-effects'>two <math><mi>x</mi></math></p></section>"
        "<section class='search-methods'>three</section><div class='ad'>no</div><div class='share-buttons'>no</div><ul class='related-posts'><li>no</ul>"
        "<div id='comments'>no</div><form>no</form><p>four</p></article></main>"
    )
    p = wrappers.Page(source)
    assert p.text(p.kinds) == "Related\n\none\n\ntwo x\n\nthree\n\nfour"
    p = wrappers.Page("<body><h2 id='related-work'>Related</h2><p id='hidden-costs'>text</p><div id='sidebar'>no</div></body>")
    assert p.text(p.kinds) == "Related\n\ntext"


@pytest.mark.parametrize("source", ["", "<", "<p", "a<b>c", "<!-- x", "<script>", "<p><b>x<br><p>y</p>", "<div hidden>x</div>y", "&lt;&#233;&bogus;", "</p></div>"])
def test_broken_pages_do_not_fail(source):
    p = wrappers.Page(source)
    assert isinstance(p.text(p.kinds), str)


def test_near_vectors_have_near_fingerprints():
    rng = np.random.default_rng(3)
    v = rng.normal(size=64)
    same, near, far = (chroma.fingerprint(chroma.render(x)) for x in (v, v + rng.normal(0, 0.02, 64), rng.normal(size=64)))
    wrong, bits = chroma.bit_errors(same, near, 0)
    assert wrong / bits < 0.1
    wrong, bits = chroma.bit_errors(same, far, 0)
    assert wrong / bits > 0.3
    assert len(chroma.fingerprint(None)) == len(chroma.fingerprint(b"\0\0")) == 0
    assert chroma.bit_errors(same[5:], same, 5) == (0, 32 * (len(same) - 5))


def test_token_ids_need_one_core():
    """In a fresh process, as in a task: no threads beside it, and letters alone have the ids of the library."""
    code = """if True:
        import os, random
        import numpy as np, public_tokenizers, pyarrow as pa
        from quillspark.llm import repair
        path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(4)
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) + rng.choice(["", "", "7", "é", "'s", "!?"]) for _ in range(40)) for _ in range(60)]
        texts += ["a", "Q", "b" * 3000]
        coder = repair.WordCoder(path, 2)
        list(repair.scan(pa.array(texts), cuts=coder.cuts))
        threads = len(os.listdir("/proc/self/task"))
        got = list(coder.encode(pa.array(texts)))
        assert len(os.listdir("/proc/self/task")) == threads
        for text, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2], text
    """
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=Path(__file__).parents[2])


def test_token_ids_equal_the_library_as_it_is():
    """Whole texts against a tokenizer of its own: marks beside words and digits, short forms, added tokens, letters that
    compose or change by case, other white space, and words that are too long or too many for the table."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), repair.WordCoder(path, 2)
    texts = ["Hello  World don't", "", "ÀÉ x <|endoftext|>", "á b a\u0301, <\u0338 1\u0338", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|", "<|endoft", "ext|>", "it's 'start' ,'s ''s's I'LL 'RE5 x'\u00e9 12'34",
             "a\u00a0b\u2003c\u3000d \x1ce\x00f", "ΑΣ, ΣΑΣ. İstanbul ǅ", "x" * 3000 + " " + "x" * 3001, "日本語 テスト,が3月", "---...!!!???", "a1b2c3 4,5.6", None]
    rng = random.Random(11)
    alphabet = ["a", "B", "é", "́", "'", "s", "t", "re", "5", "1", ",", ".", "<", "|", ">", " ", "\n", "\u00a0", "İ", "日", "😀", "\x1f", "-"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    for _ in range(2):
        for text, got in zip(texts, coder.encode(pa.array(texts)), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], repr(text)
    coder.table = words.PieceTable(coder._ask, most=7)
    for text, got in zip(texts, coder.encode(pa.array(texts)), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


def test_long_words_do_not_share_hashes():
    """Two words that any polynomial modulo 2**64 maps to one number (the Thue-Morse word and its complement)."""
    bits = [bin(k).count("1") & 1 for k in range(4096)]
    pair = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    hashes = [s.hashes[0] for t in (*pair, pair[0].upper()) for s in words.scan(pa.array([t]))]
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
