"""Decontamination, classifier and pipeline against plain re-statements of their rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import components_of, prose

from siltstone.llm import chat, decontam, html, lattice_lm, media, neardup, quality, sharding, sp_bpe, tokenfile
from siltstone.llm.common import tokenizer_path

NAMES = ["Tom", "Ann", "Keller", "Rosa", "Ivan"]


def kinds(text):
    """(token, template, plain): the words of a text with their placeholders, and with names as words."""
    found = decontam._TOKEN.findall(text)
    out = []
    for k, raw in enumerate(found):
        word = raw[next(i for i, c in enumerate(raw) if c.isalnum() or c == "_") :]
        begins = word != raw or (k == 0 and raw[0].isalpha())
        after_number = out and out[-1][1] == "#"
        low = word.lower()
        if word[0].isdigit():
            out.append((low, "#", "#"))
        elif low in decontam.UNITS and after_number and not (not begins and len(word) > 1 and word[0].isupper() and not word.isupper()):
            out.append((low, "unit", "unit"))
        elif not begins and len(word) > 1 and word[0].isupper() and not word.isupper():
            out.append((low, "Name", "unit" if after_number and low in decontam.UNITS else "w:" + low))
        else:
            out.append((low, "w:" + low, "w:" + low))
    return out


def telling(window, form):
    return sum(t[form].startswith("w:") for t in window) >= min(decontam.MIN_WORDS, len(window))


def windows(tokens, size):
    return [(k, tokens[k : k + size]) for k in range(len(tokens) - size + 1)]


def equal(a, b):
    """Forms of an item's window in which it stands in a document's: template, its very tokens, or names as words."""
    mine = {"template": [t[1] for t in a]} if telling(a, 1) else {}
    if not telling(a, 2):
        mine["exact"] = ["w:" + t[0] for t in a]
    elif "Name" in [t[1] for t in a]:
        mine["plain"] = [t[2] for t in a]
    theirs = [[t[1] for t in b], [t[2] for t in b]] + ([["w:" + t[0] for t in b]] if not telling(b, 2) else [])
    return [form for form, x in mine.items() if x in theirs]


def slots(a, b):
    return [((t[1], t[0]), (t[1], u[0])) for t, u in zip(a, b) if not t[1].startswith("w:")]


def agrees(pairs, there, back):
    ok = all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs)
    return ok and len({x for x, _ in pairs}) == len(set(pairs)) == len({y for _, y in pairs})


def contaminates(item, text):
    a, b = kinds(item), kinds(text)
    size = min(decontam.WINDOW, len(a))
    if not size:
        return False
    mine = windows(a, size)
    share_of, telling_of = set(), set()
    for shift in range(-len(a), len(b)):
        hits = [(k, w, equal(w, b[k + shift : k + shift + size])) for k, w in mine if 0 <= k + shift <= len(b) - size]
        hits = [h for h in hits if h[2]]
        for forms, into in ((("template", "plain", "exact"), share_of), (("template",), telling_of)):
            there, back = {}, {}
            for k, w, found in hits:
                pairs = slots(w, b[k + shift : k + shift + size])
                if set(found) & set(forms) and agrees(pairs, there, back):
                    there.update(pairs)
                    back.update((y, x) for x, y in pairs)
                    into.add(k)
        covered = sorted({q for k, _, _ in hits for q in range(k, k + size)})
        for first in covered:  # every stretch of covered tokens whose values agree
            there, back, q = {}, {}, first
            while q in covered:
                pairs = slots(a[q : q + 1], b[q + shift : q + shift + 1])
                if any(there.get(x, y) != y or back.get(y, x) != x for x, y in pairs):
                    break
                there.update(pairs)
                back.update((y, x) for x, y in pairs)
                q += 1
            if q - first >= decontam.RUN:
                return True
    with_templates = sum(telling(w, 1) for _, w in mine)
    return len(share_of) >= decontam.SHARE * len(mine) or len(telling_of) >= decontam.SHARE * max(1, with_templates)


def question(r, n):
    words = prose(r.randrange(10**6), n).split()
    for _ in range(n // 6):
        at = r.randrange(1, n - 1)
        words[at : at + 1] = r.choice(([str(r.randrange(30)), r.choice(["kg", "euros"])], [r.choice(NAMES)], [str(r.randrange(9))]))
    return " ".join(words)


def disguise(r, text):
    """A copy with other values, some of them wrong, in other letter case, or only a stretch of it."""
    words, change = text.split(), {}
    for k, w in enumerate(words):
        if w.isdigit():
            words[k] = change.setdefault(w, str(r.randrange(40))) if r.random() < 0.9 else str(r.randrange(40))
        elif w in NAMES:
            words[k] = change.setdefault(w, r.choice(NAMES))
        elif r.random() < 0.04:
            words[k] = "other"
    if r.random() < 0.4:
        a = r.randrange(len(words) // 2)
        words = words[a : a + r.randrange(4, 25)]
    copy = " ".join(words)
    return r.choice((copy, copy, copy.lower(), copy.upper()))


def test_decontamination_by_comparing_all_windows():
    r = random.Random(8)
    items = [question(r, r.choice((3, 6, 20, 40))) for _ in range(12)] + ["17 * 23 + 5", "Ann", "", items_repeat := question(r, 25), items_repeat]
    templates = decontam.Templates(list(enumerate(items)))
    caught = 0
    for _ in range(150):
        item = r.choice(items[:12])
        text = r.choice((prose(r.randrange(99), 20) + ". ", "")) + disguise(r, item) + r.choice((" " + prose(r.randrange(99), 20), "", " 17 * 23 + 5"))
        want = [k for k, x in enumerate(items) if contaminates(x, text)]
        assert [m[0] for m in templates.match(text)] == want, text
        caught += bool(want)
    assert 50 < caught < 150


def plain_features(text):
    import math

    raw = text.encode()
    n, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
    w, filled = max(1, len(words)), [x for x in lines if x]
    share = lambda chars: sum(b in chars.encode() for b in raw) / n
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / w, len(set(words)) / w, math.log1p(len(lines)),
        1 - len(set(filled)) / len(filled) if filled else 0.0, len(raw) / len(lines), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(" \t\n\r\v\f"),
        share(".,;:?'\""), share("#$%&*@^~+=_\\/`"), share("!"), share("|"), sum(b >= 128 for b in raw) / n, share("()[]{}<>"),
        sum(not x.isalnum() for x in words) / w, sum(x.isupper() for x in words) / w, sum(len(x) == 1 for x in words) / w,
    ]


ODD_TEXTS = ["", " ", "a", "ONE two\ntwo\n\n|x|", "é字 (1) {2}!!", "w " * 3000, "x" * 100_000, "\0\t\v"]


def test_scores_by_looking_up_each_table():
    texts = ODD_TEXTS + [prose(k, 5 + k) if k % 3 else prose(k, 9).upper().replace(" ", "!! ") for k in range(80)]
    y = np.array([k % 3 > 0 for k in range(len(texts))], float)
    model = quality.fit(quality.feature_matrix(texts), y)
    got = model.score(quality.feature_matrix(texts))
    for text, score in zip(texts, got):
        x = plain_features(text)
        assert np.allclose(x, quality.features(text))
        total = model.base
        place = lambda edges, v: sum(v >= e for e in edges)
        for j in range(len(x)):
            total += model.tables[j][place(model.edges[j], x[j])]
        for j, k, table in model.pairs:
            total += table[place(model.pair_edges[j], x[j]), place(model.pair_edges[k], x[k])]
        assert np.isclose(score, 1 / (1 + np.exp(-np.clip(total, -30, 30))))


def test_shallow_trees_by_trying_all_splits():
    r = np.random.default_rng(2)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + quality.RIDGE)
    for shape in ((1,), (7,), (4, 5)):
        for _ in range(20):
            g, h = r.normal(size=shape), r.random(shape)
            value, found = quality._tree(g, h, 1)
            best = gain(g, h)
            for axis in range(g.ndim):
                for at in range(1, shape[axis]):
                    (a, b), (c, d) = np.split(g, [at], axis), np.split(h, [at], axis)
                    best = max(best, gain(a, c) + gain(b, d))
            assert np.isclose(found, best) and value.shape == shape


def reference_pipeline(rows, labels, bench, model, spark):
    """The stages' rules, one document and one pair at a time."""
    docs = [(i, t) for i, t in rows if model.score(np.array([plain_features(t or "")]))[0] >= 0.5]
    best = components_of([x for x in docs if x[0] is not None], 5)
    kept = {}
    for i, t in docs:
        if i is not None and best[i] == i and (i not in kept or (t or "") < (kept[i] or "")):
            kept[i] = t
    out = list(kept.items()) + [(i, t) for i, t in docs if i is None]
    out = [(i, t) for i, t in out if not any(contaminates(b or "", t or "") for b in bench)]
    library = sp_bpe.encoder(tokenizer_path(sp_bpe.MODEL)).library
    return sorted(((i if i is not None else -1, [*library.encode(t or ""), library.eos_id()]) for i, t in out), key=str)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_by_brute_force(spark, tmp_path, empty):
    import corpus_pipeline

    r = random.Random(1)
    bench = [question(r, 20), prose(500, 30), None, ""]
    rows = [(i, prose(i, 40) if i % 5 else prose(i, 40).upper().replace(" ", "!! ")) for i in range(120)]
    for k in range(40):  # copies from far to near
        words = prose(k, 40).split()
        for _ in range(r.randrange(4)):
            words[r.randrange(40)] = "x"
        rows.append((200 + k, " ".join(words)))
    rows += [(300 + k, prose(900 + k, 20) + " " + disguise(r, bench[k % 2]) + " " + prose(800 + k, 20)) for k in range(15)]
    rows += [(400, None), (401, ""), (7, prose(7, 40)), (7, prose(77, 40)), (9, None), (None, prose(3, 40)), (None, None), (402, prose(1, 6000)), (403, "w " * 900)]
    labels = [(i, int(i % 5 > 0)) for i in range(120)]
    if empty:
        rows, labels, bench = [], [], []
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0, "q") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    model = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    got = sorted(((x["doc_id"] if x["doc_id"] is not None else -1, list(x["ids"])) for x in corpus_pipeline.run(spark, path).collect()), key=str)
    assert got == reference_pipeline(rows, labels, bench, model, spark)
    assert empty or 40 < len(got) < len(rows)


LONG = " ".join(prose(k, 400) for k in range(400))  # some 800,000 characters


def test_long_texts(spark):
    """Whole texts count, to their last word."""
    item = prose(5000, 30)
    docs = spark.createDataFrame([(1, LONG + " " + item), (2, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r["doc_id"], r["items"]) for r in decontam.find_contaminated(docs, bench).collect()] == [(1, [1])]
    assert [r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()] == [2]
    words = LONG.split()
    page = "<nav>" + "<a href=x>y</a> " * 3000 + "</nav><article>" + "".join(f"<p>{' '.join(words[k : k + 100])}</p>" for k in range(0, len(words), 100)) + "</article><footer>End</footer>"
    assert html.main_text(page) == "\n".join(" ".join(words[k : k + 100]) for k in range(0, len(words), 100))
    assert np.allclose(quality.features(LONG + "!!"), plain_features(LONG + "!!"))


def test_clashing_columns(spark):
    """Columns named like those of a result or of an inner step are left out or replaced."""
    clash = "held_out c lp wp row n word score share item_id n_windows items best_share digest signature rep key hashes cluster media payload p start n_tokens blob part segment first slot shard y x html turns layout record said formatted _n _h"
    rows = [(k, prose(k, 30)) for k in range(6)]
    docs = spark.createDataFrame([(*r, *["z"] * len(clash.split())) for r in rows], ["doc_id", "text", *clash.split()])
    plain = docs.select("doc_id", "text")
    bench = spark.createDataFrame([(1, rows[0][1], "z")], "item_id long, text string, doc_id string")
    model = quality.fit(np.empty((0, len(quality.FEATURES))), np.empty(0))
    both = [
        (f(docs), f(plain))
        for f in (
            sharding.assign_shards, lambda d: decontam.find_contaminated(d, bench), lambda d: tokenfile.read_documents(tokenfile.write_segments(d)), sp_bpe.digests, lattice_lm.score_documents,
            lambda d: quality.score_documents(d, model), lambda d: media.store(d)[0], neardup.near_duplicates,
        )
    ]
    for a, b in both:
        names = [c for c in b.columns if c != "text"]
        assert sorted(map(str, a.select(names).collect())) == sorted(map(str, b.select(names).collect()))
    assert decontam.keep_clean(docs, bench).columns == docs.columns and quality.keep_good(docs, model).count() == 6
    turns = spark.createDataFrame([(1, 0, "user", "q", "z", "z"), (1, 1, "assistant", "a", "z", "z")], "conv_id long, turn long, role string, text string, said string, turns string")
    out = chat.canonical_turns(chat.pack_records(turns).withColumn("turns", F.lit("z")).withColumn("layout", F.lit("z")), "record", said="said")
    assert [(r["layout"], len(r["turns"])) for r in out.collect()] == [("prompt", 2)]


def test_written_shards(spark, tmp_path):
    rows = spark.createDataFrame([(k, prose(k, 5)) for k in range(500)] + [(None, "x"), (7, "again")], "doc_id long, text string")
    path = str(tmp_path / "shards")
    sharding.write_shards(rows, path)
    back = spark.read.parquet(path)
    want = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(rows).collect()}
    assert back.count() == 502 and all(want[r["doc_id"]] == r["shard"] for r in back.collect())
