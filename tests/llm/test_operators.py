"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, common, decontam, html, labelled_pages, lattice_lm, media, neardup, quality, sharding, sp_bpe, tokenfile
from siltstone.llm.common import tokenizer_path

WORDS = [a + b for a in ("th", "er", "on", "an", "re", "ti") for b in ("at", "es", "en", "or", "is", "ou")]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Plain texts, a copy, near copies, a repeated row, null and empty texts, a null id, a long text, clashing columns."""
    base = prose(0, 100).split()
    rows = [(i, prose(i)) for i in range(1, 30)]
    rows += [(40, " ".join(base)), (41, " ".join(base).upper()), (42, " ".join([*base[:50], "new", *base[51:]])), (43, " ".join([*base[:50], "new", *base[51:90], "more", *base[91:]]))]
    rows += [(50, None), (51, ""), (52, " \n\t "), (None, prose(3)), (5, prose(5)), (60, prose(60, 20000)), (61, "one two"), (62, "One  two"), (63, "a" * 5000 + " 字あ<|endoftext|>\\")]
    return spark.createDataFrame([(i, t, "x", i, "y") for i, t in rows], "doc_id long, text string, slot string, rep long, shard string")


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_sharding(docs):
    owner = sharding.lookup_table()
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    assert np.mean([a != b for a, b in zip(owner, less, strict=True)]) < 0.2
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == docs.count() and all(r["shard"] == sharding.SHARDS[owner[r["slot"]]] for r in rows)
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(table_size=100)


def test_decontamination(spark, docs):
    items = [(1, "Tom paid 12 dollars for 3 apples and then he paid 12 dollars again for the ripe fruit"), (2, prose(7, 30)), (3, ""), (4, None), (None, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaks = [(1, "before. " + items[0][1].replace("12", "99").replace("3", "7").replace("Tom", "Ann") + " after"), (2, items[0][1].replace("12", "99", 1)), (3, prose(99) + " " + items[1][1] + " " + prose(98)), (4, prose(97)), (5, None), (6, "")]
    found = spark.createDataFrame([(i, t, 0) for i, t in leaks], "doc_id long, text string, item_id int")
    got = {r["doc_id"]: r["items"] for r in decontam.find_contaminated(found, bench).collect()}
    assert got[1] == [1] and got[3] == [2] and 4 not in got and 5 not in got
    assert got == {r["doc_id"]: r["items"] for r in decontam.find_contaminated(found, bench, block_chars=40).collect()}
    assert {r["doc_id"] for r in decontam.keep_clean(found, bench).collect()} == {i for i, _ in leaks} - set(got)
    templates = next(decontam.blocks(bench))
    assert templates.match(items[0][1].replace("12 dollars", "99 dollars"))[0][1] > templates.match(items[0][1].replace("12", "99", 1))[0][1]  # a value that changes breaks its windows
    assert decontam.find_contaminated(found.limit(0), bench).count() == 0 and decontam.find_contaminated(found, bench.limit(0)).count() == 0


def found_items(text, *items):
    return [m[0] for m in decontam.Templates(list(enumerate(items))).match(text)]


def test_excerpts_of_long_items():
    words = [f"word{chr(97 + k // 20)}{chr(97 + k % 20)}" for k in range(400)]
    item, around = " ".join(words), (prose(1), prose(2))
    for n, want in ((30, [0]), (13, [0]), (12, [])):
        assert found_items(f"{around[0]} {' '.join(words[100 : 100 + n])} {around[1]}", item) == want
    paid = "she paid 12 euros for tea and 12 euros for cake and then went home with nothing left for the bus or " + item
    assert found_items("oh she paid 99 euros for tea and 99 euros for cake and then went on", paid) == [0]
    assert found_items("oh she paid 99 euros for tea and 98 euros for cake and then went on", paid) == []


def test_items_of_numbers_and_names():
    for item in ("What is 17 * 23 + 5?", "3 4 5 12 13 17 29 31", "17 mm 4 kg 12 s 9 mb", "40 + 2", "so Tom Dick Harry Ann Eve"):
        assert found_items(f"{prose(1)} {item} {prose(2)}", item) == [0]
    assert found_items(f"{prose(1)} What is 18 * 23 + 5? {prose(2)}", "What is 17 * 23 + 5?") == []
    mixed = "1 2 3 4 5 6 7 8 9 10 11 12 then the tall man ran home with 4 cats"  # other numbers: still found by its template windows
    assert found_items("31 32 33 34 35 36 37 38 39 30 21 22 then the tall man ran home with 40 cats", mixed) == [0]


def test_letter_case_of_items():
    item = "Yesterday Anna Keller met Peter Braun and Maria Lopez near Berlin before Otto Weiss drove Clara Stein to Hamburg for 12 euros"
    for copy in (item, item.lower(), item.upper(), item.title(), item.replace("Peter", "peter")):
        assert found_items(f"{prose(1)} {copy} {prose(2)}", item) == found_items(copy, item) == [0]
    assert found_items(item, item.lower()) == found_items(item.replace("Anna", "Tina"), item) == [0]
    assert found_items("tom DICK harry ANN eve", "so Tom Dick Harry Ann Eve") == [0]


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 65536])
def test_range_coder(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint16)
    blob = tokenfile.encode_ids(ids, [7, None, -3], np.array([n, 0, 0]))
    docs, lengths, back = tokenfile.decode_segment(blob)
    assert np.array_equal(back, ids) and docs == [7, None, -3] and lengths.tolist() == [n, 0, 0]
    for bad in (b"x" + blob[1:], blob[:-2], blob[:-4], blob[:20] + bytes([blob[20] ^ 1]) + blob[21:], blob[:-200] + bytes([blob[-200] ^ 1]) + blob[-199:] if n > 2000 and high > 2 else b"x"):
        with pytest.raises(ValueError):
            tokenfile.decode_segment(bad)


def test_blocks_side_by_side(monkeypatch):
    monkeypatch.setattr(tokenfile, "LANES", 3)
    monkeypatch.setattr(tokenfile, "SEGMENT", 3 * tokenfile.BLOCK)
    for n in (3 * 2048, 3 * 2048 + 1, 7 * 2048 - 5):
        ids = (np.random.default_rng(n).zipf(1.3, n) % 50000).astype(np.uint16)
        assert np.array_equal(tokenfile.decode_ids(tokenfile.encode_ids(ids)), ids)


def test_sharp_predictions():
    runs = np.r_[np.full(9000, 5), np.tile([1, 2, 3], 4000), np.full(50, 60000), np.full(9000, 5)].astype(np.uint16)
    blob = tokenfile.encode_ids(runs)
    assert np.array_equal(tokenfile.decode_ids(blob), runs) and len(blob) < len(runs) / 8


def test_bits_an_id():
    """Fewer bits than an adaptive order-0 coder that starts anew in each block, and than the shares of the whole."""
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(tokenizer_path(tokenfile.VOCABULARY)), random.Random(5)
    words = [prose(k, 1) + prose(k + 1, 1)[: k % 4] for k in range(500)]
    ids = np.array(library.encode(" ".join(r.choices(words, [1 / (k + 1) for k in range(500)], k=40000)), add_special_tokens=False).ids, np.uint16)
    adaptive = 0.0
    for at in range(0, len(ids), tokenfile.BLOCK):
        seen: dict[int, int] = {}
        for n, i in enumerate(ids[at : at + tokenfile.BLOCK].tolist()):
            adaptive -= math.log2((seen.get(i, 0) + 0.02) / (n + 0.02 * 50257))
            seen[i] = seen.get(i, 0) + 1
    share = np.bincount(ids) / len(ids)
    static = -np.log2(share[ids]).sum()
    assert 8 * len(tokenfile.encode_ids(ids)) < min(static, adaptive)


def test_token_file(docs):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(tokenizer_path(tokenfile.VOCABULARY)), 0, []
    for i, t in sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):  # rows with equal ids are equal here
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in tokenfile.read_documents(tokenfile.write_segments(docs)).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    assert tokenfile.read_documents(tokenfile.write_segments(docs.limit(0))).count() == 0


def test_parts_of_texts():
    import pyarrow as pa

    odd = ["", " ", "  a  b", "it's a <|endoftext|> b <|endoftext|>c d", "a\x1c b\x85 c\u3000 d ", "é 漢字 かな 😀 x", "a b\n c\n", "x" * 99 + " " + "y" * 99 + " z", "a <|endoftext|>", "a <|endoftext|>\n <|endoftext|>", "plain words only here"]
    encoder = tokenfile.PartEncoder(tokenizer_path(tokenfile.VOCABULARY), cache=12)
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in odd]

    def got(rows, end=None):
        ids, sizes = encoder.encode(pa.array(rows, pa.string()), end)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]

    for k in range(len(odd)):
        assert got(odd[k:] + odd[:k]) == want[k:] + want[:k]
        assert got(odd[k : k + 1]) == want[k : k + 1]
        assert got(odd[k : k + 3], 2) == [[*x, 2] for x in want[k : k + 3]]
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == []


def test_html():
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>A &amp;  b</h1><p>Some words\n of prose here<br>go on</p><div class='ad'>Buy now</div><script>x<y</script><p>The end of it &copy; is here</article><div id=comments><p>Nice page, I like it</p></div><footer>Imprint</footer>"
    assert html.main_text(page) == "A & b\nSome words of prose here go on\nThe end of it © is here"
    assert html.main_text("") == html.main_text("<p></p><!-- x") == "" and html.main_text("just words") == "just words"
    best, scores = html.region([1, -5, 3, -1, 2, -9, 1]), [1, -5, 3, -1, 2, -9, 1]
    assert sum(scores[slice(*best)]) == max(sum(scores[i:j]) for i in range(7) for j in range(i, 8))


def test_long_blocks_inside_main_text():
    lead, rest = prose(1, 20), prose(2, 80)
    blocks = ("<div class='ad'>" + prose(3, 60) + "</div>", "<nav><ul>" + "<li><a href=x>One two</a></li>" * 60 + "</ul></nav>", "<div class=newsletter><p>" + prose(4, 200) + "</p></div>")
    for block in blocks:
        for before, after in (("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<body><div>", "</div>"), ("", ""), ("<div>", "</div><aside>x</aside><article></article>")):
            for a, b in ((lead, rest), (rest, lead)):
                assert html.main_text(f"{before}<p>{a}</p>{block}<p>{b}</p>{after}") == f"{a}\n{b}"


def test_paragraphs_and_quotes():
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 20)
    for before, after in (("<article>", "</article>"), ("<main>", "</main>"), ("<body><div>", "</div>"), ("", "")):
        for block in (f"<p class='advert'>{c}</p>", f'<p class="comment">{c}', f"<p class=ad>{c}", f"<p id=cookie-notice hidden>{c}</p>"):
            assert html.main_text(f"{before}<p>{a}</p>{block}<p>{b}</p>{after}") == f"{a}\n{b}", (before, block)
            assert html.main_text(f"{before}<p>{a}{block}<div>{b}</div>{after}") == f"{a}\n{b}", (before, block)
        assert html.main_text(f"{before}<p>{a} <a title=it's href=x>in</a> {b}</p><p>{c}</p>{after}") == f"{a} in {b}\n{c}"
        assert html.main_text(f"{before}<p>{a} <a title=\"x href=x>in</a> {b}</p><p>{c}</p>{after}") == f"{a} in {b}\n{c}"
        assert html.main_text(f"{before}<p>{a} <img alt='a > b' src=x>{b}</p>{after}") == f"{a} {b}"
        assert html.main_text(f"{before}<p>{a}</p><aside>{prose(9, 200)}</aside><p>{c}</p>{after}") == f"{a}\n{c}"


def test_weights_of_labelled_pages():
    learned = html.weights()
    assert learned.words[""] > 0 and learned.words["main"] > 0 and all(learned.words[k] < 0 for k in ("menu", "ad", "comment", "side", "footer", "link")) and all(x < 0 for x in learned.tags.values())
    for seed in (1, 2):  # pages that nothing was learned from
        right = whole = 0
        for page in labelled_pages.labelled_pages(60, seed):
            want = " ".join(" ".join(re.sub(r"<[^>]*>", " ", x) for x, main in page if main).split())
            got = html.main_text("".join(x for x, _ in page)).split()
            whole += 1
            right += got == want.split()
        assert right / whole > 0.9
    own = [[(f"<div class=zone>{prose(k, 9)}</div>", False), (f"<p>{prose(k, 90)}</p>", True)] for k in range(9)]
    assert html.fit(own).names["zone"] < 0


def test_names_inside_main_text():
    a, b = prose(1, 30), prose(2, 30)
    for head in ("<h2 id='related-work'>One", "<h2 id='legal'>One", "<h3 class='header'>One", "<section id='search'><h2>One</h2></section", "<section id='cookies'><p>One</p></section", "<div class='post-header'><h1>One</h1></div", "<div id='search'>One</div", "<math><mi>One</mi></math", "<object data=x>One</object"):
        end = "</" + head[1:3] + ">" if head.startswith("<h") else ">"
        for before, after in (("<article>", "</article>"), ("<main>", "</main>"), ("<body>", "</body>")):
            if before != "<body>" or "<div id" not in head:
                assert "One" in html.main_text(f"{before}<p>{a}</p>{head}{end}<p>{b}</p>{after}"), (before, head)
    for block in ("<div class='ad'>Two</div>", "<div class='x newsletter-box'>Two</div>", "<ul class='share-buttons'><li>Two</ul>", "<div id='comments'>Two</div>", "<aside>Two</aside>", "<nav>Two</nav>", "<div id='cookie-notice'>Two</div>", "<section class='comments'>Two</section>", "<div role=dialog>Two</div>", "<p hidden></p><div hidden>Two</div>"):
        for before, after in (("<article>", "</article>"), ("<main>", "</main>"), ("<body>", "</body>")):
            assert html.main_text(f"{before}<p>{a}</p>{block}<p>{b}</p>{after}") == f"{a}\n{b}", (before, block)


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>hé", "x"), (2, None, "<p>hé", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(rows).collect()) == [(1, "", 0), (2, "hé", 2), (2, "hé", 2)]


def test_sentencepiece(docs):
    enc, r = sp_bpe.encoder(tokenizer_path(sp_bpe.MODEL)), random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["a", "e", "th", " ", "  ", "\n", "é", ".", "字", "😀", "▁", "0", "\0", "<s>", "<0x0A>"]) for _ in range(r.randint(0, 30)))
        assert enc.encode(t) == enc.library.encode(t)
    got = {(x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in sp_bpe.digests(docs).collect()}
    want = set()
    for i, t in texts(docs):
        ids = [*enc.library.encode(t), enc.end_id]
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.library.decode(ids).encode()).hexdigest()))
    assert got == want
    full = sp_bpe.encode_documents(docs)
    assert {(x["doc_id"], tuple(x["ids"])) for x in full.collect()} == {(i, (*enc.library.encode(t), enc.end_id)) for i, t in texts(docs)}
    assert sorted((x["doc_id"] or 0, x["text"]) for x in sp_bpe.decode_documents(full).collect()) == sorted((i or 0, enc.library.decode(enc.library.encode(t))) for i, t in texts(docs))
    assert sp_bpe.digests(docs.limit(0)).count() == sp_bpe.encode_documents(docs.limit(0)).count() == 0


def test_decoding_of_any_ids():
    enc, r = sp_bpe.encoder(tokenizer_path(sp_bpe.MODEL)), random.Random(3)
    lists = [[]] + [[r.choice((r.randrange(32000), r.randrange(260), enc.end_id, enc.id_of["▁"], enc.id_of["▁the"])) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    got = enc.decode(np.array([i for x in lists for i in x], np.int32), np.cumsum([len(x) for x in lists]))
    assert [g.decode() for g in got] == [enc.library.decode(x) for x in lists]


def test_lattice():
    grid = lattice_lm.lattice(tokenizer_path(lattice_lm.MODEL))
    weights = lattice_lm.Weights(grid.first, 0.3)

    def brute(x):
        if not x:
            return 1.0
        total = 0.0
        for k in range(1, len(x) + 1):
            if x[:k] in grid.automaton:
                total += math.exp(weights.piece[grid.automaton.get(x[:k])[0]]) * brute(x[k:])
            elif k == 1 and x[0] not in grid.single:
                total += math.exp(weights.byte * len(x[0].encode())) * brute(x[1:])
        return total

    words = ["the", "hat", "é字", "", "x😀a", "Zz"]
    assert np.allclose(lattice_lm.forward(words, grid, weights), [math.log(brute("▁" + w)) + weights.stop for w in words])


def test_nul_in_words(spark):
    grid = lattice_lm.lattice(tokenizer_path(lattice_lm.MODEL))
    weights, expected = lattice_lm.Weights(grid.first, 0.3), np.zeros(len(grid.first))
    words = ["the", "\0", "a\0b", "hat", "x\0", "\0\0y"]
    got = lattice_lm.forward(words, grid, weights, expected, np.ones(len(words)))
    assert np.isfinite(expected).all()
    three = lattice_lm.forward([w.replace("\0", "\ue000") for w in words], grid, weights)  # a character without a piece, of three bytes
    assert np.allclose(got, [x - 2 * weights.byte * w.count("\0") for w, x in zip(words, three, strict=True)])
    rows = [(i, prose(i, 20) + (" a\0b" if i % 2 else "")) for i in range(20)]
    for r in lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert -1e9 < r["score"] < 0 and -1e9 < r["word_score"] <= r["closed_score"] <= 0


def segmentations(word, grid):
    """All ways to cut a marked word into pieces (their numbers) and characters without a piece (None)."""
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in grid.automaton:
            yield from ((grid.automaton.get(word[:k])[0], *rest) for rest in segmentations(word[k:], grid))
        elif k == 1 and word[0] not in grid.single:
            yield from ((-len(word[0].encode()), *rest) for rest in segmentations(word[1:], grid))


@pytest.mark.parametrize("hot", [200_000, 3])
def test_scores_by_all_segmentations(spark, monkeypatch, hot):
    """Weights and scores from a list of every word's segmentations, on short words."""
    monkeypatch.setattr(lattice_lm, "HOT", hot)
    grid, r = lattice_lm.lattice(tokenizer_path(lattice_lm.MODEL)), random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "hat", "a字", "onion", "é", "In", "x\0y", "tin"]) for _ in range(r.randint(0, 9)))) for i in range(40)] + [(77, None), (78, "Quz")]
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    words = {i: (t or "").encode().lower().decode().split() for i, t in rows}
    count = {}
    for i, ws in words.items():
        for w in ws:
            count[w] = count.get(w, 0) + (not out[i])
    cuts = {w: list(segmentations("▁" + w, grid)) for w in count}

    def marginal(w, weights):
        return sum(math.exp(sum(weights.piece[i] if i >= 0 else -i * weights.byte for i in cut)) for cut in cuts[w])

    first = lattice_lm.Weights(grid.first, 0.3)
    pieces, n = grid.first * lattice_lm.PRIOR * 100, sum(count.values())
    for w, c in count.items():
        for cut in cuts[w]:
            share = c * math.exp(sum(first.piece[i] if i >= 0 else -i * first.byte for i in cut)) / marginal(w, first)
            for i in cut:
                if i >= 0:
                    pieces[i] += share
    stop = (n + 0.3) / (n + pieces.sum() - grid.first.sum() * lattice_lm.PRIOR * 100 + 1.0)
    fitted = lattice_lm.Weights(pieces, stop)
    ends = sum(not x for x in out.values())
    end = ends / (n + ends)
    got = lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = math.log10(end) + sum(math.log10((1 - end) * marginal(w, fitted) * stop) for w in words[r["doc_id"]])
        assert math.isclose(r["score"], want, rel_tol=1e-6), r


def test_lm_scores(docs):
    rows = lattice_lm.score_documents(docs).collect()
    train, n = {}, 0
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    for i, t in texts(docs):
        if not out(i):
            n += 1
            train[None] = train.get(None, 0) + 1
            for w in t.encode().lower().split():
                train[w] = train.get(w, 0) + 1
                n += 1
    base = {}
    for i, t in texts(docs):
        seq = [*t.encode().lower().split(), None]
        base[i] = (out(i), len(seq), sum(w in train for w in seq), n, round(sum(math.log10((train.get(w, 0) + 0.5) / (n + 0.5 * (len(train) + 1))) for w in seq), 5))
    assert len(rows) == len(texts(docs))
    for r in rows:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) == base[r["doc_id"]]
        assert -1e9 < r["score"] < 0 and -1e9 < r["word_score"] <= r["closed_score"] <= 0
    assert lattice_lm.score_documents(docs.limit(0)).count() == 0


def test_quality(spark, docs):
    rows = [(i, prose(i) if i % 3 else prose(i).upper().replace(" ", "!! "), "n") for i in range(600)]
    found = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(found, labels)
    got = quality.score_documents(found, model).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.98
    assert quality.keep_good(found, model).count() == sum(r["predicted"] for r in got)
    assert quality.score_documents(docs, model).count() == docs.count()
    assert quality.train(found, labels.limit(0)).score(quality.feature_matrix(["a", ""])).tolist() == [0.5, 0.5]


def test_media(docs):
    page = "<p>One</p><figure><img src='sha256:" + "0" * 64 + "'><figcaption>A &amp; b</figcaption></figure>two<br>three<img alt=\"c\" src=sha256:" + "1" * 64 + ">"
    items = media.parse(page)
    assert [(i["position"], i["text"], i["caption"]) for i in items] == [(0, "One", None), (1, None, "A & b"), (2, "twothree", None), (3, None, "c")]
    rows, stored = media.store(docs)
    assert stored.count() == stored.select("digest").distinct().count() == rows.select("digest").distinct().count() < rows.count()
    got = media.resolve(media.sequences(media.pages(rows), keep=("n_bytes",)), media.media_features(stored)).collect()
    want = []
    for i, t in texts(docs):
        b = t.encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        whole = b"P6\n64 %d\n255\n" % (len(p) // 192) + p
        grey = [p[k] + p[k + 1] + p[k + 2] for k in range(0, len(p), 3)]
        mean = sum(grey) / len(grey)
        cuts = [k * len(grey) // 64 for k in range(65)]
        bits = "".join(str(int(sum(grey[x:y]) / (y - x) > mean)) for x, y in zip(cuts, cuts[1:]))
        feature = f"{int(bits, 2):016x}:{mean / 3:.4f}:{math.sqrt(sum((g - mean) ** 2 for g in grey) / len(grey)) / 3:.4f}"
        for position, caption in ((1, media.OWN), (3, "again")):
            want.append((i or -1, position, caption, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(whole), hashlib.sha256(whole).hexdigest(), feature))
    assert sorted((r["doc_id"] or -1, r["position"], r["caption"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in got) == sorted(want)
    none = media.store(docs.limit(0))
    assert none[0].count() == none[1].count() == media.sequences(media.pages(none[0])).count() == 0
    with pytest.raises(ValueError, match="pixmap"):
        media.samples_of(b"P6\n64 2\n255\nabc")


def test_interleaved_references(spark):
    a, b, lost = "a" * 64, "b" * 64, "c" * 64
    page = f"<h1>One</h1><figure><img src='sha256:{a}'><img src='sha256:{b}'><figcaption>Both &lt;</figcaption></figure><p>Two<p>three <img alt='x' src=sha256:{a}> four <video src=\"sha256:{lost}\"></video>"
    rows = spark.createDataFrame([(1, page, "k"), (1, page, "k"), (None, f"<img src='sha256:{b}'>", None), (2, None, "k"), (3, "<p>words", "k")], "doc_id long, html string, extra string")
    found = media.sequences(rows, keep=("extra",))
    items = {r["doc_id"]: [(i["text"], i["digest"], i["caption"]) for i in r["items"]] for r in found.collect()}
    assert items[1] == [("One", None, None), (None, a, "Both <"), (None, b, "Both <"), ("Two", None, None), ("three", None, None), (None, a, "x"), ("four", None, None), (None, lost, None)]
    assert items[2] == [] and items[3] == [("words", None, None)] and items[None] == [(None, b, None)]
    known = spark.createDataFrame([(a, "A"), (b, "B"), ("d" * 64, "D")], "digest string, value string")
    got = sorted((r["doc_id"] or 0, r["position"], r["caption"] or "", r["value"] or "", r["extra"] or "") for r in media.resolve(found, known).collect())
    assert got == sorted([(1, 1, "Both <", "A", "k"), (1, 2, "Both <", "B", "k"), (1, 5, "x", "A", "k"), (1, 7, "", "", "k")] * 2 + [(0, 0, "", "B", "")])


def test_chat_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a<b>\\\\l"},{"content":null,"role":"assistant"}]}', "messages", [("user", "a<b>\\l"), ("assistant", "")]),
        ('{"response":"r","prompt":"p"}', "prompt", [("user", "p"), ("assistant", "r")]),
        ('{"output":"o","input":"i","instruction":"s"}', "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ('{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}', "dialogue", [("user", "x"), ("assistant", "y")]),
        ('{"messages":[]}', "no messages", []), ('{"other":1}', None, []), ("no json", None, []), (None, None, []),
    ]
    df = spark.createDataFrame([(k, r[0], "x") for k, r in enumerate(records)], "k int, record string, turns string")
    out = chat.format_turns(chat.canonical_turns(df, "record"))
    out = out.withColumn("back", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    for r in out.orderBy("k").collect():
        _, layout, turns = records[r["k"]]
        assert r["layout"] == layout and [tuple(t) for t in r["turns"]] == turns == [tuple(t) for t in r["back"]]
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")


def test_chat_packing(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, "x"), (3, 1, "assistant", "late"), (3, 0, "weird<role>", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.canonical_turns(chat.pack_records(df), "record", said="said").collect()}
    assert got == {1: [("user", "q"), ("assistant", "")], 2: [("user", "a"), ("user", "a")], None: [("", "x")], 3: [("weird<role>", ""), ("assistant", "late")]}


def test_long_chat(spark):
    n = 20_000_001
    rows = spark.createDataFrame([(1, 0, "user", "q", 1), (1, 1, "assistant", "b", n), (2, 0, "assistant", "c", n), (3, 0, "user", "q", 1), (3, 1, "assistant", "d", 1)], "conv_id long, turn long, role string, text string, n int")
    packed = chat.pack_records(rows.withColumn("text", F.expr("repeat(text, n)")))
    out = chat.format_turns(chat.canonical_turns(packed, "record", said="said"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    got = {r[0]: tuple(r)[1:] for r in out.select("conv_id", "layout", F.size("turns"), F.length(F.element_at("turns", -1)["text"]), F.length(loss), F.length("formatted")).collect()}
    head = len("<turn:user>q</turn>\n<turn:assistant></turn>\n")
    assert got == {1: ("prompt", 2, n, n, n + head), 2: ("messages", 1, n, n, n + len("<turn:assistant></turn>\n")), 3: ("prompt", 2, 1, 1, 1 + head)}
    foreign = spark.range(1).select(F.concat(F.lit('{"prompt":"p","response":"'), F.expr(f"repeat('x', {n})"), F.lit('"}')).alias("record"))
    with pytest.raises(Exception, match="too long"):
        chat.canonical_turns(foreign, "record").select(F.size("turns")).collect()
    broken = spark.createDataFrame([("no json", [("user", "x")])], "record string, said array<struct<role:string,text:string>>")
    with pytest.raises(Exception, match="can't be parsed"):
        chat.canonical_turns(broken, "record", said="said").collect()
    none = chat.format_turns(chat.canonical_turns(chat.pack_records(rows.select("conv_id", "turn", "role", "text").limit(0)), "record", said="said"))
    assert none.count() == 0


def test_very_long_chat(spark):
    n = 25_000_000
    rows = spark.createDataFrame([(1, 0, "user", "b", n), (1, 1, "assistant", "<", n)], "conv_id long, turn long, role string, text string, n int").withColumn("text", F.expr("repeat(text, n)"))
    out = chat.format_turns(chat.canonical_turns(chat.pack_records(rows), "record", said="said"))
    assert tuple(out.select("layout", F.size("turns"), F.length(F.element_at("turns", -1)["text"])).first()) == ("prompt", 2, n)


def test_near_duplicates(spark, docs):
    sets = {}
    for i, t in texts(docs):
        w = t.encode().lower().split()
        sets.setdefault(i, set()).update({tuple(w)} if 0 < len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)})
    best = {i: i for i in sets if i is not None}
    for _ in range(5):
        for i in best:
            for j in best:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    best[i] = min(best[i], best[j])
    for r in neardup.near_duplicates(docs, 4).collect():
        i = r["doc_id"]
        if i is None:
            assert (r["component_id"], r["kept"]) == (None, False)
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), best[i], best[i] == i)
    assert best[43] == best[42] == best[41] == 40 and best[62] == 61
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def components_of(rows, width):
    """Smallest id that each id reaches over brute-force links; rows of one id are one document."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
    best = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if best[j] < best[i] and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in a for y in b):
                    best[i], changed = best[j], True
    return best


def test_repeated_ids_of_near_duplicates(spark):
    cases = ([(3, "b"), (10, "a"), (10, "b")], [(3, "b"), (4, "a"), (10, "a"), (10, "b")], [(10, "a"), (10, "b"), (12, "b")], [(3, "b"), (10, "b"), (10, ""), (10, None), (11, "")], [(7, "a"), (7, "a"), (9, "b")], [(5, "a"), (5, "b"), (3, ""), (3, "b"), (2, "a")])
    rows = [(100 * k + i, prose(10 * k + ord(t) - 96) if t else t) for k, case in enumerate(cases) for i, t in case]
    want = components_of(rows, 5)
    assert (want[10], want[110], want[112 - 2], want[210], want[310], want[503]) == (3, 103, 103, 210, 303, 502)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_bloom_joins(spark):
    import functools

    df = spark.range(-500, 4500).select(F.when(F.col("id") < 4490, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    ids = spark.range(0, 4000, 3).toDF("doc_id")
    for f in (common.without_ids, functools.partial(common.without_ids, most=0)):
        left = [r["doc_id"] for r in f(df, ids).collect()]
        assert sorted(x for x in left if x is not None) == [i for i in range(-500, 4490) if not (0 <= i < 4000 and i % 3 == 0)] and left.count(None) == 10
    rows = ids.withColumn("n", F.col("doc_id") * 2)
    for most in (10**6, 0):
        assert sorted((r["doc_id"], r["n"]) for r in common.with_rows(df, rows, "doc_id", most).collect()) == [(i, 2 * i) for i in range(0, 4000, 3)]
    assert df.filter(common.possibly_among("doc_id", ids, 1334)).count() < 1334 + 20
    assert common.without_ids(df, ids.limit(0), most=-1).count() == 5000


def test_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_DEGREE", 3)
    edges = [(1, k) for k in range(2, 30)] + [(k, k + 1) for k in range(100, 120)] + [(120, 5)] + [(40, 41), (41, 42)]
    got = {r["node"]: r["component"] for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in [*range(1, 30), *range(100, 121)]}, **{k: 40 for k in (40, 41, 42)}}


def test_hot_keys(spark, monkeypatch):
    """Signatures that agree in their first chunk: its keys are hot, and no row is lost or made twice."""
    monkeypatch.setattr(neardup, "HOT_SHARE", 2)
    monkeypatch.setattr(neardup, "KEY_BLOCK", 64)
    r = np.random.default_rng(1)
    signatures = r.integers(0, 65536, (90, neardup.POSITIONS)).astype(np.uint16)
    signatures[:60, :6] = 7
    signatures[70] = signatures[71]
    classes = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(signatures)], "rep long, signature binary")
    keys = neardup.keys_of(signatures).view(np.int64)
    assert set(neardup._hot_keys(classes).tolist()) == set(keys[0, :15].tolist())
    found, times = np.unique(keys, return_counts=True)
    twice = set(found[times > 1].tolist())
    want = sorted((int(k), rep) for rep, row in enumerate(keys) for k in row if int(k) in twice)
    assert sorted(map(tuple, neardup._shared_keys(classes).collect())) == want and len(want) == 60 * 15 + 2 * 90


def test_pigeonhole():
    r = np.random.default_rng(0)
    for _ in range(200):
        a = r.integers(0, 65536, (1, neardup.POSITIONS)).astype(np.uint16)
        b = a.copy()
        b[0, r.choice(neardup.POSITIONS, neardup.DISTANCE, replace=False)] ^= 1
        assert (neardup.keys_of(a) == neardup.keys_of(b)).any()


def test_blocks_of_large_clusters(spark, monkeypatch):
    """Groups far smaller than the clusters: chains, whose ends aren't linked with the centre, and stars, ids repeated."""
    monkeypatch.setattr(neardup, "MEMBERS", 5)
    monkeypatch.setattr(neardup, "SET_BLOCK", 900)
    monkeypatch.setattr(neardup, "KEY_BLOCK", 4)
    base, rows = prose(0, 120).split(), []
    rows += [(i, " ".join([*base[:i], f"w{i}", *base[i + 1 :]])) for i in range(1, 25)]
    words = prose(5, 120).split()
    for i in range(30):  # each differs from the one before in one more word
        words[4 * i % 120] = f"v{i}"
        rows.append((100 + i, " ".join(words)))
    far = prose(8, 100).split()
    rows += [(200 + i, " ".join([*far[: 3 * i], *prose(50 + i, 12).split(), *far[3 * i + 12 :]])) for i in range(20)]
    rows += [(110, prose(70)), (3, prose(71)), (3, prose(71)), (129, None), (210, " ".join(base))]
    want = components_of(rows, 5)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert want[129] == 100 and want[24] == 1 and len(set(want.values())) < len(want) / 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(i) if i % 5 else prose(i).upper().replace(" ", "!! ")) for i in range(300)]
    bench = prose(1000, 30)
    rows += [(400, prose(7) + "\n" + bench), (401, prose(8)), (402, None)]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()}
    assert {i for i in range(300) if i % 5} - kept == set() and not kept & {i for i in range(0, 300, 5)} and not kept & {400, 401}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "encode"]


def test_words_and_their_signs_are_encoded_apart(monkeypatch):
    """A word goes through the model once, whatever signs follow it, and ids are the library's for every letter and sign."""
    path = tokenizer_path(tokenfile.VOCABULARY)
    encoder, seen = tokenfile.PartEncoder(path), []
    monkeypatch.setattr(encoder, "_words", lambda words, f=encoder._words: (seen.extend(words), f(words))[1])
    letters = [chr(c) for c in range(0x41, 0x450) if chr(c).isalpha()]
    texts = ["a word, word. word; word", "a word! word... other?!", *(f"a x{c}y{c}, {c}{c}{c}. {c}" for c in letters), *(f"a b{s}c d{s} e{s}'s {s}f g'{s} {s}" for s in map(chr, range(33, 127)))]
    texts += ["a b<|endoftext|> <|endoftext|>, c<| |endoftext|>", "a don't we'll. 'tis it's, x's' 12, 3.4. a1 b_2 -", "a ×x÷, µm. 中文, 日本 x́,"]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [e.ids for e in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert seen.count("word") == 1 and len(seen) == len(set(seen))
    again = encoder.encode(pa.array(["a word) other, fresh."]))[0].tolist()
    assert again == encoder.ids("a word) other, fresh.").tolist() and seen.count("word") == 1 and seen[-1] == "fresh"
