"""Each operator against brute force, a round trip or held-out accuracy, and on its defined cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from caselake.llm import bpe, common, exact_dedup, html_extract, line_dedup, ngram_join, packing, progressive_jpeg, quality_crf, suffix_dedup, warc_fixity

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdeéñ") for _ in range(RNG.randrange(2, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, row string, score string, id string, digest string"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def corpus():
    base = [prose(RNG.randrange(30, 160)) + "\n" + prose(RNG.randrange(5, 60)) for _ in range(40)]
    near = []
    for t in base[:15]:
        words = t.split(" ")
        words[RNG.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    passage = prose(60)
    shared = [prose(50) + " " + passage + " " + prose(40) for _ in range(6)]
    odd = [None, "", " ", "one", "two words", "\n\n", "x" * 5000, "ab " * 900, "日本 😀 ́a", "long " * 4000 + prose(3000)]
    return list(enumerate([*base, *near, *shared, *base[:10], *odd, *odd[:4]]))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "r", "s", "i", "d") for i, t in corpus()]
    return spark.createDataFrame([*rows, rows[3], (None, rows[5][1], None, None, None, None)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_exact_dedup(docs, empty):
    import re

    want = defaultdict(list)
    for i, t in rows_of(docs):
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.digest].append(r)
    assert set(by) == {hashlib.sha256(t.encode()).hexdigest() for t in want}
    for t, ids in want.items():
        least = min(i for i in ids if i is not None)
        got_rows = by[hashlib.sha256(t.encode()).hexdigest()]
        assert {(r.keep_id, r.group_size) for r in got_rows} == {(least, len(ids))}
        assert [r.id for r in got_rows if r.kept] == [least]
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_index_persists(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(docs, index=index, batches=1)
    n = index.rows().count()
    index.drop()
    again = exact_dedup.DigestIndex(spark, path, 4)
    new = spark.createDataFrame([(1000, "a new text"), (1001, "one")], "doc_id long, text string")
    got = {r.id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(new, index=again, batches=1).collect()}
    assert got[1000] == (1000, True) and not got[1001][1]
    assert again.rows().count() == n + 1


def test_warc_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", None if i == 4 else prose(RNG.randrange(1, 900)), "leaf") for i in range(700)] + [(None, None, "body", "x")], "page_id long, url string, html string, leaf string")
    good = common.stage(warc_fixity.records(pages), "good")
    assert {r.kind for r in warc_fixity.audit(good, good).collect()} == {"root"}
    bad = good.where("record_id <> 33").withColumn("leaf", F.when(F.col("record_id") == 650, "0").otherwise(F.col("leaf")))
    found = warc_fixity.audit(good, bad).collect()
    assert {(r.record_id, r.status) for r in found if r.kind == "record"} == {(33, "missing"), (650, "corrupt")}
    assert {r.archive: r.status for r in found if r.kind == "root"} == {-1: "intact", 0: "differs", 1: "differs"}
    assert warc_fixity.audit(good.limit(0), good.limit(0)).count() == 0


def test_bpe_as_tiktoken(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["  ", " a  b ", "a b", "x  y", "<|endoftext|> it's  \n\n a\tb", "́a é ", " " * 300, "a \x1c b\x85 c", "don'T we'll 's  're", "\r\n \r\n x​ y ﻿"]
    model = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for t in odd + [t for _, t in rows_of(docs)]:
        assert model.encode(t) == own.encode_ordinary(t)
    back = {r.id: r.text for r in bpe.decode(bpe.encode(docs.where("doc_id is not null"))).collect()}
    assert back == {i: t for i, t in rows_of(docs) if i is not None}
    assert all(r.exact for r in bpe.round_trip(docs).collect())
    assert bpe.round_trip(empty).count() == 0


def test_packing(docs, empty):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows_of(docs):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            want[i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)] += 1
    got = packing.pack(packing.pieces(docs), group=50).collect()
    assert Counter((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_fill_is_the_best_sum():
    for _ in range(200):
        lengths = {RNG.randrange(1, 30): RNG.randrange(1, 4) for _ in range(RNG.randrange(0, 5))}
        flat = [x for x, n in lengths.items() for _ in range(n)]
        best = max(sum(c) for k in range(len(flat) + 1) for c in combinations(flat, k) if sum(c) <= 37)
        taken = packing.fill(lengths, 37)
        assert sum(x * n for x, n in taken.items()) == best and all(n <= lengths[x] for x, n in taken.items())


def test_crf(spark, empty):
    good = [(i, prose(40) + ".\n" + prose(30) + ".") for i in range(300)]
    bad = [(1000 + i, "\n".join(w.upper() + "!! " + (w + " ") * 9 for w in RNG.sample(WORDS, 4))) for i in range(300)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in [*good, *bad]] + [(7, None)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels, 300)
    got = {r.doc_id: r.score for r in quality_crf.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
    held = [i for i in got if i < 2000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i < 1000) for i in held]) > 0.97
    assert quality_crf.score(empty, model).count() == 0
    assert quality_crf.accepted(empty, model).columns == empty.columns
    assert quality_crf.train(empty, labels.limit(0)).scores(["x"]) == [0.5]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    emit, move, n = rng.normal(size=4), rng.normal(size=(2, 2)), 4
    total, good = 0.0, np.zeros(n)
    for labels in range(2**n):
        y = [labels >> i & 1 for i in range(n)]
        p = np.exp(sum(emit[i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        good += p * np.array(y)
    m, _, _ = quality_crf.forward_backward(np.vstack([emit, emit]), move, np.array([4, 2]))
    assert np.allclose(m[0], good / total)


def test_jpeg_round_trip(docs, empty):
    payloads = [progressive_jpeg.payload_of(t)[0] for _, t in rows_of(docs)]
    payloads += [bytes(RNG.choice([0] * RNG.choice([1, 9, 60]) + [1, 255, 2, 200, 128]) for _ in range(64 * RNG.randrange(1, 30))) for _ in range(60)]
    media = progressive_jpeg.encode(payloads)
    images, coef, first = progressive_jpeg.coefficients(media)
    for p, i, a in zip(payloads, images, first.tolist(), strict=False):
        assert coef[a : a + i.payload].astype(np.int8).tobytes() == p
    assert media[3] == progressive_jpeg.encode([payloads[3]])[0]
    one, c, _ = progressive_jpeg.coefficients([media[3]])
    px = progressive_jpeg.pixels(images, coef, first)[first[3] : first[4]]
    assert (progressive_jpeg.rgb(one[0], px) == progressive_jpeg.rgb(one[0], progressive_jpeg.pixels(one, c, np.array([0, len(c)])))).all()
    with pytest.raises(ValueError):
        progressive_jpeg.parse(media[3][:-2])
    got = progressive_jpeg.store(docs, tensors=True).collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    assert progressive_jpeg.store(empty).count() == 0


def test_inverse_transform():
    block = np.zeros((1, 64))
    block[0, 0] = 64
    image = progressive_jpeg.parse(progressive_jpeg.encode([bytes(64)])[0])
    assert (np.unique(progressive_jpeg.pixels([image], np.repeat(block, image.blocks, 0), np.array([0, image.blocks]))) == [136]).all()


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(a, k):
    a = list(a)
    for _ in range(k):
        i = RNG.randrange(len(a) + 1)
        a[i : i + RNG.randrange(2)] = RNG.choice(["", "a", "b"])
    return "".join(a)


def test_band_and_segments():
    for _ in range(3000):
        a = "".join(RNG.choice("abc") for _ in range(RNG.randrange(0, 24)))
        b, k = changed(a, RNG.randrange(5)), RNG.randrange(4)
        near = distance(a, b) <= k
        assert line_dedup.within(a, b, k) == near
        if near and a != b and min(len(a), len(b)) > k:
            assert line_dedup.spanning_links([1, 2], [a, b], k) in ([(1, 2)], [(2, 1)])


def components_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_line_dedup(spark, empty):
    lines = [prose(9) for _ in range(40)]
    lines += [changed(x, 1) for x in lines[:10]] + [changed(x, 2) for x in lines[5:15]] + ["short", "", "  "]
    rows = [(i, "\n".join(RNG.choice(lines) for _ in range(RNG.randrange(1, 7)))) for i in range(60)] + [(90, None), (91, "")]
    all_lines = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip()})
    long = [x for x in all_lines if len(x) >= line_dedup.MIN_CHARS]
    cls = components_of(all_lines, [(a, b) for a, b in combinations(long, 2) if distance(a, b) <= 2])
    seen, want = set(), {}
    for i, t in sorted(rows):
        left = []
        for x in (t or "").split("\n"):
            if not x.strip() or cls[x] not in seen:
                left.append(x)
            if x.strip():
                seen.add(cls[x])
        want[i] = "\n".join(left)
    df = spark.createDataFrame([(i, t, "r", "k") for i, t in rows], "doc_id long, text string, row string, key string").repartition(3)
    got = line_dedup.clean(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: want[i] if t is not None else None for i, t in rows} | {90: None if want[90] is None else got.where("doc_id = 90").first().text}
    assert line_dedup.clean(empty).count() == 0


def test_suffix_dedup(docs, empty):
    rows = rows_of(docs)
    count = Counter(r[i : i + 200] for _, t in rows for r in [t.encode()] for i in range(len(r) - 199))
    want = Counter()
    for _, t in rows:
        r, gone = t.encode(), set()
        for i in range(len(r) - 199):
            if count[r[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        want[bytes(b for i, b in enumerate(r) if i not in gone).decode("utf-8", "ignore")] += 1
    assert Counter(r.text or "" for r in suffix_dedup.clean(docs).collect()) == want
    assert suffix_dedup.clean(empty).count() == 0
    assert suffix_dedup.clean(docs).columns == docs.columns


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, empty, words, percent):
    sets = {}
    for i, t in rows_of(docs):
        w = [x for x in t.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()]
        sets[-1 if i is None else i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    known = {i: s for i, s in sets.items() if i >= 0}
    want = components_of(known, [(a, b) for a, b in combinations(known, 2) if known[a] and known[b] and 100 * len(known[a] & known[b]) >= percent * len(known[a] | known[b])])
    got = ngram_join.jaccard_components(docs, words=words, percent=percent).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.n == len(sets[-1 if r.id is None else r.id])
        assert r.component == (want[r.id] if r.id is not None else want[5])
    assert ngram_join.jaccard_components(empty).count() == 0


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    base = prose(200).split(" ")
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(RNG.randrange(0, 9)):
            w[RNG.randrange(len(w))] = f"w{RNG.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split(" ")[k : k + 4]) for k in range(len(t.split(" ")) - 3)} for i, t in rows}
    want = components_of(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in ngram_join.jaccard_components(df, words=4, percent=85).collect()} == want


def test_html():
    w = {"w:p": 1.5, "w:h": 1.5, "w:a": -0.5, "w:never": -0.8, "t:p": -0.1, "t:/p": -0.1}
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>Home page</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><main><h1>Big &amp; bold</h1><p>First   para<br>of the text &#233;<div class="ad-box">Buy now</div><p>Second <b>para</b> with <a href=x>a link</a>
    and more words</p><form><input> name</form><aside>side</aside></main><div id="comments"><p>nice post, thanks</p></div><footer>(c)</footer></body></html>"""
    assert html_extract.extract(page, w) == "Big & bold\nFirst para of the text é\nSecond para with a link and more words"
    assert [html_extract.extract(x, w) for x in (None, "", "<p></p>", "<p>cut off <b", "plain words")] == ["", "", "", "cut off", "plain words"]


def test_html_table(spark):
    page = "<html><body><nav><a href=x>menu one</a></nav><article><h1>Head {0}</h1><p>{1}</p><p>{1}</p></article><footer>&copy; foot</footer></body></html>"
    rows = [(i, f"u{i}", page.format(i, "some plain words here"), "t") for i in range(30)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.main_text(df, html_extract.learn(df)).collect()}
    assert got[99] == "" and got[7] == "Head 7\nsome plain words here\nsome plain words here"
    assert html_extract.main_text(df.limit(0), html_extract.learn(df.limit(0))).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 150: 100, 200: 100}


def test_pipeline_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        now = common.stage(out, "test")
        assert now.count() <= docs.count()
    assert {r.doc_id for r in now.collect()} >= set(range(15, 40))
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= now.count()


def test_line_threshold_grows(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    lines = []
    for n in [7, 8, 8, 9, 10, 12, 17, 18, 18, 27, 28, 40, 48, 60, 130, 400]:
        base = [rng.choice(pool) for _ in range(n)]
        lines.append(" ".join(base))
        for more in (-1, 0, 1):
            w = list(base)
            for i in rng.sample(range(n), max(0, line_dedup.word_edits(n) + more)):
                w[i] = rng.choice(["", "changed", "two words"])
            lines.append(" ".join(x for x in w if x))
    lines += ["tenletters", "tenletterz", "tenlettersz", "nineletts", "ninelettz", "a line of twenty three.", "a line of twenty-three.", "a line of twenty--three.", "a line of twenty three..z"]

    def linked(a, b):
        short = min(len(a), len(b))
        chars = 2 if short >= line_dedup.MIN_CHARS else 1 if short >= 10 else 0
        return distance(a, b) <= chars or distance(a.split(), b.split()) <= line_dedup.word_edits(max(len(a.split()), len(b.split())))

    distinct = sorted(set(lines))
    cls = components_of(distinct, [(a, b) for a, b in combinations(distinct, 2) if linked(a, b)])
    assert [line_dedup.word_edits(n) for n in (7, 8, 18, 200)] == [0, 1, 2, 20]
    seen, want = set(), {}
    for i, x in enumerate(lines):
        want[i] = "" if cls[x] in seen else x
        seen.add(cls[x])
    got = line_dedup.clean(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_repeated_rows_lose_their_lines(spark, tmp_path):
    text = "a line that is repeated with its whole row\n\nand another one"
    rows = [(5, text, "x"), (5, text, "y"), (5, text, "y"), (None, "only null ids have this", "x"), (None, "only null ids have this", "x"), (7, "one two", "x"), (8, "", "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.clean(df).collect())
    assert got == [(0, ""), (0, "only null ids have this"), (5, ""), (5, ""), (5, text), (7, "one two"), (8, ""), (8, "")]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in found) == [(0, 1, 0), (0, 1, 1), (5, 3, 0), (5, 3, 2), (5, 3, 2), (7, 1, 0), (8, 1, 0), (8, 1, 0)]


def test_html_keeps_the_article_whole(spark):
    menu = "<nav><ul>" + "".join(f"<li><a href=x>Menu entry {i}</a></li>" for i in range(20)) + "</ul></nav>"
    plain = "<html><body>" + menu + "<article><h1>Head</h1><p>" + "some plain words of text " * 12 + "</p></article><footer>foot note</footer></body></html>"
    weights = html_extract.learn(spark.createDataFrame([(i, f"u{i}", plain) for i in range(30)], "page_id long, url string, html string"))
    lead, rest = " ".join(["lead"] * 45), " ".join(["rest"] * 90)
    form = "<form><input><select>" + "<option>one more choice</option>" * 40 + "</select></form>"
    advert = "<div class=advert>" + "buy <b>now</b> " * 60 + "</div>"
    for inner in (menu, menu * 3, "<aside><ul>" + "<li>a side remark of words</li>" * 30 + "</ul></aside>", form, advert):
        page = f"<html><body>{menu}<article><h1>Head line</h1><p>{lead}</p>{inner}<p>{rest}</p></article>{menu}</body></html>"
        assert html_extract.extract(page, weights) == f"Head line\n{lead}\n{rest}"
        page = f"<html><body>{menu}<article><p>{rest}</p>{inner}<p>{lead}</p></article><footer>foot note</footer></body></html>"
        assert html_extract.extract(page, weights) == f"{rest}\n{lead}"
    page = f"<html><body>{menu}<article><p>{lead}</p><ul><li>first item</li><li>second</li></ul><table><tr><td>one</td><td>two</td></tr><tr><td>three</td><td>four</td></tr></table></article>{menu}<footer>foot note</footer></body></html>"
    assert html_extract.extract(page, weights) == f"{lead}\nfirst item\nsecond\none two\nthree four"


def line_classes(lines):
    def linked(a, b):
        short = min(len(a), len(b))
        chars = 2 if short >= line_dedup.MIN_CHARS else 1 if short >= 10 else 0
        return distance(a, b) <= chars or distance(a.split(), b.split()) <= line_dedup.word_edits(max(len(a.split()), len(b.split())))

    distinct = sorted(set(lines))
    return components_of(distinct, [(a, b) for a, b in combinations(distinct, 2) if abs(len(a.split()) - len(b.split())) < 9 and linked(a, b)])


def test_large_buckets_of_lines(spark, monkeypatch):
    """Blocks of 6 lines and keys of 4 lines count as large, so each way round is taken."""
    monkeypatch.setattr(line_dedup, "BLOCK", 6)
    monkeypatch.setattr(line_dedup, "HOT_KEY", 4)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(500)]
    base, passage, lines = [rng.choice(pool) for _ in range(30)], [rng.choice(pool) for _ in range(15)], []
    for _ in range(25):
        w = list(base)
        for i in rng.sample(range(30), rng.randrange(0, 4)):
            w[i] = rng.choice(pool)
        lines.append(" ".join(w))
    lines += [" ".join(passage + [rng.choice(pool) for _ in range(12)]) for _ in range(25)]
    lines += ["a line of some " + rng.choice("abc") + rng.choice("abc") + "x" for _ in range(20)] + [f"another short one {i}" for i in range(15)]
    cls, seen, want = line_classes(lines), set(), {}
    for i, x in enumerate(lines):
        want[i] = "" if cls[x] in seen else x
        seen.add(cls[x])
    got = line_dedup.clean(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_lines_with_a_passage_in_common_make_no_bucket(spark, monkeypatch):
    """What a frequent passage joins and nothing else does, isn't fetched; near copies among these lines are found."""
    monkeypatch.setattr(line_dedup, "HOT_KEY", 20)
    rng, fetched, stage = random.Random(8), [], line_dedup.stage
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(2000)]
    passage = [rng.choice(pool) for _ in range(15)]
    lines = [" ".join([rng.choice(pool) for _ in range(rng.randrange(20, 40))] + passage) for _ in range(150)]
    lines += [x + " added" for x in lines[:3]]

    def counted(df, name, keep=False):
        out = stage(df, name, keep)
        fetched.extend([out.count()] if name == "bucket-lines" else [])
        return out

    monkeypatch.setattr(line_dedup, "stage", counted)
    got = line_dedup.clean(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.text for r in got.collect()} == dict(enumerate(lines[:150])) | {i: "" for i in (150, 151, 152)}
    assert 6 <= fetched[0] < 50


@pytest.mark.parametrize("live", [False, True])
def test_near_pairs_against_all_pairs(live):
    """With components that stay as they are all pairs of counts that are close, else as many as connect the same."""
    rng = np.random.default_rng(4)
    for mean, n in [(0.3, 300), (1, 700), (3, 500), (6, 400), (12, 30)]:
        base = rng.poisson(mean, (6, line_dedup.COUNTERS))
        counts = base[rng.integers(0, 6, n)] + rng.integers(-1, 2, (n, line_dedup.COUNTERS)) * (rng.random((n, line_dedup.COUNTERS)) < 0.1)
        counts, key = np.clip(counts, 0, 255).astype(np.uint8), rng.integers(0, 4, n).astype(np.uint64)
        words = counts.sum(axis=1).astype(np.int64)
        order = np.lexsort([words, key])
        counts, key, words = counts[order], key[order], words[order]
        want, got, root = [], [], np.arange(n)
        for i, j in combinations(range(n), 2):
            limit = max(line_dedup.word_edits(int(words[j])), 2)
            if key[i] == key[j] and words[j] - words[i] <= limit and np.abs(counts[i].astype(int) - counts[j]).sum() <= max(2 * limit, 6):
                want.append((i, j))
        for i, j in line_dedup.near_pairs(key, words, counts, 2, np.arange(n), root):
            got += zip(i.tolist(), j.tolist(), strict=True)
            for a, b in zip(root[i].tolist(), root[j].tolist(), strict=True) if live else ():
                a, b = root[a], root[b]
                root[root == max(a, b)] = min(a, b)
        assert set(got) <= set(want) and (live or set(got) == set(want))
        assert components_of(range(n), got) == components_of(range(n), want)


def test_hot_keys_are_dealt(monkeypatch):
    """What a Dealer sends out: each record once, hot ones apart, with a sign in the key's own partition."""
    dtype = np.dtype([("key", "<u8"), ("line", "<u8")])
    rows = np.zeros(30_000, dtype)
    rows["line"] = np.arange(30_000)
    rows["key"] = np.where(np.arange(30_000) < 20_000, 7 << 60, np.random.default_rng(3).integers(0, 1 << 63, 30_000, dtype=np.uint64) * np.uint64(2))
    dealer = common.Dealer(0, dtype, 5, 1, 2)
    out = [*dealer.add(rows), *dealer.flush()]
    got = defaultdict(list)
    for b in out:
        for part, kind, blob in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
            keys = np.frombuffer(blob, dtype if kind < 2 else dtype["key"])
            got[kind] += keys["line"].tolist() if kind < 2 else keys.tolist()
            if kind != 1:
                for k in (keys["key"] if kind == 0 else keys).tolist():
                    assert k * 5 >> 64 == part
    assert sorted(got[0] + got[1]) == list(range(30_000)) and len(got[1]) >= 20_000 and got[2] == [7 << 60]


def test_fixity_of_null_and_repeated_ids(spark, tmp_path):
    """Every record of the replica meets its own, whatever the ids: only the pages that the simulation damages are told."""
    rows = [(None, f"u{i}", f"seen body {i}") for i in range(6)] + [(7, "a", "one"), (7, "b", "other"), (7, "a", "one"), (13, "x", "eee"), (5, "gone", "body"), (13, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc_fixity.op2_warc_fixity(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.status) for r in got if r.kind == "record") == [(5, "missing"), (13, "corrupt")]
    assert {r.archive: r.status for r in got if r.kind == "root"} == {-1: "intact", 0: "differs"}


def test_links_of_repeated_ids(spark):
    """Rows of one id with different texts each keep the links of their text."""
    a, b = prose(60), prose(60)
    near_a, near_b = a + " more", b + " more"
    for rows in ([(3, a), (3, b), (7, near_b), (8, near_a)], [(3, b), (3, a), (8, near_a), (7, near_b)]):
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85)
        assert {(r.id, r.component) for r in got.collect()} == {(3, 3), (7, 3), (8, 3)}
    rows = [(None, a), (None, near_a), (None, b), (5, b), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df, words=4, percent=85).collect()
    assert sorted((r.id or 0, r.n, r.component or 0) for r in got) == [(0, 57, 0), (0, 57, 5), (0, 58, 0), (5, 57, 5), (6, 0, 6)]
    left = ngram_join.firsts(df).collect()
    assert len(left) == 3 and {(r.doc_id, r.text) for r in left} >= {(5, b), (6, "")}


def test_crf_scores_whole_chains(spark):
    """Each line of a long document counts, against one pass over the whole chain by hand."""
    rng = np.random.default_rng(4)
    model = quality_crf.LineCrf(rng.normal(size=quality_crf.SIZE), rng.normal(size=(2, 2)))
    text = "\n".join(prose(RNG.randrange(1, 5)) for _ in range(5000))
    lines = text.split("\n")
    emit = quality_crf.chain_features(quality_crf.line_features(lines)) @ model.weights
    good, _, _ = quality_crf.forward_backward(emit[None], model.move, np.array([len(lines)]))
    weigh = np.array([len(x) + 1 for x in lines])
    assert np.isclose(model.scores(["one", text])[1], (good[0] * weigh).sum() / weigh.sum())


def test_large_suffix_buckets(spark, monkeypatch):
    """With blocks of 2,000 bytes, buckets are sliced and windows counted; the query's columns against brute force."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(420))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 90))) + passage[rng.randrange(0, 90) : rng.randrange(290, 421)] + "".join(rng.choice("abc") for _ in range(60))) for i in range(60)]
    rows += [(100, "z" * 900), (101, "z" * 250), (102, None), (102, "é" * 140), (103, "xy" * 199), (103, "xy" * 199)]
    count = Counter(r[i : i + 200] for _, t in rows for r in [(t or "").encode()] for i in range(len(r) - 199))
    want = Counter()
    for i, t in rows:
        r, gone = (t or "").encode(), set()
        for k in range(len(r) - 199):
            if count[r[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        want[i, len(r), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(b for k, b in enumerate(r) if k not in gone)).hexdigest()] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = common.shared_folder(spark) + "/suffix-test"
    df.write.mode("overwrite").parquet(path + "/documents.parquet")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op8_suffix_dedup(spark, path).collect())
    assert got == want


def test_slabs_of_a_long_text(spark, monkeypatch):
    """A text cut into slabs gives the same as one that is not."""
    rows = [(1, "ab" * 700 + prose(300)), (2, prose(40) + "ab" * 300), (3, prose(200))]
    rows.append((4, rows[0][1][300:2900]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.text for r in suffix_dedup.clean(df).collect()}
    grams = suffix_dedup.Grams()
    whole = [grams.contexts(t.encode()) for _, t in rows]
    monkeypatch.setattr(suffix_dedup, "SLAB", 333)
    parts = [grams.contexts(t.encode()) for _, t in rows]
    for a, b, (_, t) in zip(whole, parts, rows, strict=True):
        n = len(t.encode()) - 199
        for x in (a, b):
            assert [(f, s) for f, s in zip(np.cumsum(x["span"]) - x["span"], x["span"])] == [(f, s) for f, s in zip(x["first"], x["span"])] and x["span"].sum() == n
        gram = lambda x: np.repeat(x["first"] + x["at"], x["span"])
        assert (gram(a) == gram(b)).all()
    assert want[3] == rows[2][1]


def test_best_run_is_the_maximum():
    rng = random.Random(8)
    for _ in range(300):
        w = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randrange(0, 25))]
        a, b = html_extract.best_run(w)
        best = max((sum(w[i:j]) for i in range(len(w) + 1) for j in range(i, len(w) + 1)), default=0)
        assert np.isclose(sum(w[a:b]), max(0, best))


PLAIN_PAGE = ("<html><head><title>The title of it</title></head><body><nav><ul>" + "".join(f"<li><a href=x>Menu entry {i}</a></li>" for i in range(6))
              + "</ul></nav><div class=\"ad\">Buy this or that now</div><article><h1>Head</h1><p>" + "some plain words of text " * 12 + "</p></article><footer>foot note</footer></body></html>")


def test_html_keeps_what_names_only_hint_at(spark):
    """Names lower a score and decide nothing: text of the article stays under them, and the scan alone finds the run."""
    weights = html_extract.learn(spark.createDataFrame([(i, f"u{i}", PLAIN_PAGE) for i in range(30)], "page_id long, url string, html string"))
    lead, rest = " ".join(["lead"] * 20), " ".join(["rest"] * 30)
    for odd in ('<section class="search-engines-history"><p>{}</p></section>', '<div id="form"><p>{}</p></div>', '<p><span class="header-note">{}</span></p>', "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>", "<hr>" * 30 + "<p>{}</p>"):
        page = f"<html><body><nav><a href=x>menu</a></nav><article><p>{lead}</p>{odd.format('odd text here')}<p>{rest}</p>{odd.format('and at the end')}</article><footer>foot</footer></body></html>"
        assert html_extract.extract(page, weights) == f"{lead}\nodd text here\n{rest}\nand at the end"
    page = f"<body><article><p>{lead}</p></article><div class=ad>buy</div><article><p>{rest}</p></article><div id=comments><p>nice post thanks</p></div></body>"
    assert html_extract.extract(page, weights) == f"{lead}\n{rest}"
    page = f"<body><div><a href=1>home</a> <a href=2>news</a></div><div><h1>Head</h1><p>{lead}</p><div class=advert><p>buy now</p></div><p>{rest}</p></div><div><a href=3>about us</a></div></body>"
    assert html_extract.extract(page, weights) == f"Head\n{lead}\n{rest}"
    parsed = html_extract.parse(PLAIN_PAGE)
    first, last = html_extract.best_run(html_extract.held_together(parsed, html_extract.scores(parsed, weights), html_extract.insertions(parsed)))
    outside = " ".join(t for k, t, _, _ in parsed.tokens[:first] + parsed.tokens[last:] if k[0] == "w")
    assert "title" in outside and "Menu" in outside and "foot" in outside and "Buy" in outside  # without the scan these would stay


def test_html_query(spark, tmp_path):
    rows = [(i, f"u{i}", PLAIN_PAGE.replace("Head", f"Head {i} &amp; more")) for i in range(40)] + [(40, "u", None), (None, None, "<p>only this"), (3, "again", PLAIN_PAGE)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = html_extract.op10_html_extract(spark, str(tmp_path)).collect()
    body = " ".join(["some plain words of text"] * 12)
    want = [(i, f"u{i}", f"Head {i} & more\n{body}") for i in range(40)] + [(40, "u", ""), (-1, "", "only this"), (3, "again", f"Head\n{body}")]
    assert sorted((-1 if r.page_id is None else r.page_id, r.url or "", r.text) for r in got) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got)
