"""Language ID, packing, quality, HTML, chat and mixing against brute force or held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quill.llm import chat, html, langid, mixing, packing, quality, queries, tokens

DATA = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


# Language ID ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def language_model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return langid.fit(langid.training_rows(docs))


def test_language_held_out_accuracy(spark):
    found = queries.op2_langid(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    both = found.merge(docs, on="doc_id")
    assert len(both) == len(docs) and both.score.between(0, 1).all()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98


def test_language_counts_match_brute_force(spark):
    rows = [("ab cd", "x"), ("ab", "x"), ("zz", "y"), (None, "y"), ("q", None)]
    names, probs = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert names == ["x", "y"]
    want = np.full((langid.BUCKETS, 2), langid.SMOOTH)
    for text, lang in rows:
        if text and lang:
            np.add.at(want[:, names.index(lang)], langid.trigrams(text), 1)
    assert np.allclose(probs, want / want.sum(0))


def test_language_edges(spark, language_model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "漢字"), (5, "the"), (5, "the"), (None, "the and of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = langid.identify(docs, language_model).collect()
    assert [r.lang_pred for r in got if r.id in (1, 2, 3)] == ["und"] * 3
    assert len(got) == len(rows) and len({r.lang_pred for r in got if r.id == 5}) == 1
    assert langid.identify(docs.limit(0), language_model).count() == 0
    kept = langid.known(docs, language_model)
    assert kept.columns == docs.columns and kept.count() == 4
    nothing = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_numerals_are_no_letters(language_model):
    for text in ("\u00b2", "\u00bd 12", "\u2167", "_ \u0663 \u2460"):
        assert langid.detect(text, *language_model) == ("und", 0.0, {})
    assert langid.detect("\u00b2 the and of", *language_model)[0] == "en"
    assert langid.detect("x\u00b2", *language_model)[0] != "und"


def test_language_mixture(spark, language_model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 1500")
    text = {lang: docs.filter(F.col("lang") == lang).orderBy("doc_id").first().text[:1500] for lang in ("en", "de")}
    _, _, mixture = langid.detect(text["en"] + "\n" + text["de"] + "\n" + text["en"][:750], *language_model)
    assert set(mixture) >= {"en", "de"} and abs(mixture["en"] - 0.6) < 0.15
    _, score, alone = langid.detect(text["de"], *language_model)
    assert score > 0.9 and max(alone, key=alone.get) == "de"


def test_language_blocks_and_em():
    text = "lorem ipsum dolor " * 200
    assert dict(zip(*langid.gram_counts(text), strict=True)) == dict(zip(*np.unique(
        langid.trigrams(text), return_counts=True), strict=True))
    rng = np.random.default_rng(0)
    like = rng.dirichlet(np.ones(300), 3).T
    counts = np.bincount(rng.choice(300, 4000, p=like @ [0.7, 0.3, 0.0]), minlength=300).astype(float)
    assert np.abs(langid.proportions(counts, like) - [0.7, 0.3, 0.0]).max() < 0.05


# Packing ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_unit_tokenizer_equals_tokenizer(spark, tokenizer):
    own = tokens.UnitTokenizer(BPE, room=500)  # small tables turn over
    assert own.by_unit
    r = random.Random(1)
    some = "ab éß.,!?'’\n\t    \x1c\u0085漢字१२½Ⅷª́<|endoftext|>😀_-12 I'll don't"
    texts = [x.text for x in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    texts += ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", " a", "a ", "a  b", "a \n b", "\n\n a", " " * 9, "x" * 500]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:80]


def test_unit_tokenizer_blocks(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "BLOCK", 50)
    text = "Some words, and  more\nwords. " * 40
    assert np.frombuffer(tokens.UnitTokenizer(BPE).encode(text), "<u4").tolist() == tokenizer.encode(
        text, add_special_tokens=False).ids


def test_other_tokenizers_take_the_plain_call():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokens.UnitTokenizer(path)
    assert not own.by_unit
    assert np.frombuffer(own.encode("Hello  World"), "<u4").tolist() == Tokenizer.from_file(path).encode(
        "Hello  World", add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(1, 4) == [(0, 1)]


def test_plan_uses_every_piece_once():
    r = random.Random(2)
    for _ in range(60):
        size = r.choice([5, 12, 40])
        counts = {r.randint(1, size): r.choice([1, 2, 5, 1000]) for _ in range(r.randint(0, 12))}
        made = packing.plan(counts, size)
        used: dict[int, int] = {}
        for parts, n in made:
            assert n > 0 and sum(parts) <= size
            for p in parts:
                used[p] = used.get(p, 0) + n
        assert used == counts
    # Gaps of 3, 4 and 7 are filled by one, two and three lengths.
    assert sorted(p for p, _ in packing.plan({9: 1, 3: 1}, 12)) == [(9, 3)]
    assert sorted(p for p, _ in packing.plan({8: 1, 3: 1, 1: 1}, 12)) == [(8, 3, 1)]
    assert sorted(p for p, _ in packing.plan({5: 1, 4: 1, 2: 1, 1: 1}, 12)) == [(5, 4, 2, 1)]


def test_index_of_sums_against_all_combinations():
    """Each gap is filled by the first of all combinations, by number, largest member and second member, until none is left."""
    import itertools

    r = random.Random(12)
    for _ in range(60):
        size = r.choice([15, 24, 40])
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, size), r.randint(2, 12))}
        sums = packing._Sums(counts, size)
        left = dict(counts)
        for gap in r.choices(range(1, size), k=80):
            fits = [c for k in (1, 2, 3) for c in itertools.combinations_with_replacement(sorted(left, reverse=True), k)
                    if sum(c) == gap and all(left[p] >= c.count(p) for p in c)]
            best = min(fits, key=lambda c: (len(c), [-p for p in c]), default=None)
            assert sums.filling(gap) == best
            if best:
                sums.take(best, 1)
                for p in best:
                    left[p] -= 1


def test_plan_is_near_the_best():
    r = random.Random(7)
    counts: dict[int, int] = {}
    for _ in range(20_000):
        length = min(2048, int(r.lognormvariate(5.5, 1.2)) + 1)
        counts[length] = counts.get(length, 0) + 1
    total = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in packing.plan(counts)) <= -(-total // 2048) * 1.005 + 1


def _packed_ok(docs, packed, size, tokenizer):
    texts = dict(docs)
    rows = sorted(packed, key=lambda r: (r.sequence_id, r.offset))
    for a, b in itertools.pairwise([None, *rows]):
        assert b.offset == (a.offset + a.length if a is not None and a.sequence_id == b.sequence_id else 0)
        assert b.offset + b.length <= size
    for i, text in texts.items():
        ids = np.array((tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [0], "<u4")
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cuts(len(ids), size)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own]


def test_pack_round_trip(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    docs += [(10_001, None), (10_002, ""), (10_003, "word " * 3000)] + [(20_000 + i, "same text") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    packed = packing.pack(frame.repartition(7), BPE, size=256).collect()
    _packed_ok(docs, packed, 256, tokenizer)
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= -(-total // 256) * 1.02 + 1
    assert packing.pack(frame.limit(0), BPE).count() == 0


# Quality ----------------------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    found = queries.op6_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()
    held = found[found.held_out].merge(labels, on="doc_id")
    rank = held.score.rank()
    good = held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98 and (held.predicted == held.quality).mean() > 0.96


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (4, "xyz " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert [r.score for r in got] == [0.5] * 5
    one = spark.createDataFrame([(3, 1, 0), (99, 0, 0)], none.schema)
    assert all(r.score > 0.9 for r in quality.score(docs, quality.fit(docs, one)).collect())
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_quality_whole_text_counts():
    sizer = quality.Sizer(b"the quick brown fox " * 20, b"### *** !!! " * 20)
    good, bad = "the quick brown fox " * 300, "### *** !!! " * 300
    assert sizer.evidence(good)[0] > sizer.evidence(good + bad)[0] > sizer.evidence(bad)[0]


def test_quality_signal_after_a_shared_header(spark, monkeypatch):
    monkeypatch.setattr(quality, "DICT_BYTES", 32 << 10)
    monkeypatch.setattr(quality, "DICT_ROWS", 100)
    rng = random.Random(8)
    words = {d: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)] for d in (0, 1, "both")}
    rows = [(i, " ".join(rng.choices(words["both"], k=300)) + " " + " ".join(rng.choices(words[i % 2], k=300)))
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    found = quality.score(docs, quality.fit(docs, labels)).filter("id >= 400").collect()
    assert np.mean([(r.score >= 0.5) == (r.id % 2 == 1) for r in found]) > 0.95


# HTML -------------------------------------------------------------------------------------------

PAGE = ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/x>"
        "Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>%s<aside>side</aside><div id=comments>"
        "<p>I liked this very much, thanks</p></div><footer>&copy; x</footer></body></html>")


@pytest.mark.parametrize(("body", "text"), [
    ("<article><h1>Head</h1><p>One &amp; two.\n  More<p>Short<br>line</article>", "Head\n\nOne & two. More\n\nShort line"),
    ("<article><p><b>un<b>closed<p>x</p></article>", "unclosed\n\nx"),
    ("<article><p>a</p><div class=ad>Buy now</div><p>b</p><form>f<input></form><p>c</article>", "a\n\nb\n\nc"),
    ("<main><p>Alpha</p><table><tr><td>1<td>2</table><!-- gone --></main>", "Alpha\n\n1\n\n2"),
    ("<div class=content><p>" + "Long text here. " * 9 + "</p><p>ok</p></div>", ("Long text here. " * 9).strip() + "\n\nok"),
    ("", ""), ("<article></article>", ""),
])
def test_html_blocks(body, text):
    assert html.extract(PAGE % body) == text


def test_html_short_parts_beside_a_box():
    box = "<div class=related>" + "<p><a href=/x>Another story</a></p>" * 4 + "</div>"
    story, close = "Long story. " * 170, "The end of it. " * 20
    out = f"{story.strip()}\n\n{close.strip()}"
    far = "<div><p><a href=/>Links</a><p><a href=/>Links</a><p><a href=/>Links</a></div><div><p>Far away</p></div>"
    for body in ("<div class=x><p>%s</p>%s<p>%s</p></div>", "<div class=x><section><p>%s</p></section>%s<section><p>%s</p></section></div>"):
        assert html.extract(PAGE % (body % (story, box, close) + far)) == out


def test_html_text_that_outweighs_the_marked_element():
    box = "<div class=related>" + "<p>Another story</p>" * 4 + "</div>"
    story = "Long story. " * 170
    teaser = f"<div><article><p>Read this too</p></article></div>{box}<div><p>{story}</p></div>"
    assert html.extract(PAGE % teaser) == f"Read this too\n\n{story.strip()}"
    lead = f"<div><p>The lead.</p><article><p>{story}</p></article></div>{box}<div><p>Not this</p></div>"
    assert html.extract(PAGE % lead) == f"The lead.\n\n{story.strip()}"


def test_html_edges(spark):
    assert html.extract(None) == html.extract("") == html.extract("<!-- open <p>x") == html.extract("<script>x") == ""
    assert html.extract("plain &lt;text&gt;") == "plain <text>"
    assert html.distribution([5, 0, 0, 0, 3], 3) == [5, 0, 3, 3, 3]
    assert html.regions([5, 0, 0, 0, 3, 1], 3) == [(0, 1), (4, 6)]
    rows = [(1, "u", None), (2, None, PAGE % "<article><p>" + "é" * 300_000 + "</article>"), (2, None, "x")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.n_chars for r in got] == [0, 300_000, 1]


LONG = "The river rose over its banks in the night and the town woke to water in every street of its lower quarter. "


def test_html_page_without_any_mark():
    story = [LONG * 3, LONG * 2 + "Nobody was hurt.", LONG * 4]
    page = ("<html><body><div><div>Home</div><div>Products</div><div>Contact us</div></div>"
            "<div><h1>Flood in the valley</h1>" + "".join(f"<p>{t}</p>" for t in story)
            + "</div><div>Copyright 2024 by us</div></body></html>")
    want = "\n\n".join(["Flood in the valley", *(t.strip() for t in story)])
    assert html.extract(page) == want
    # The same without an element around the story.
    flat = page.replace("<div><h1>", "<h1>").replace("</div><div>Copyright", "<div>Copyright")
    assert html.extract(flat) == want


@pytest.mark.parametrize("part, text", [
    ('<h2 id="search">Search</h2>', "Search"),
    ('<section id="advertising"><p>On adverts.</p></section>', "On adverts."),
    ('<div class="post-header"><h1>Title</h1></div>', "Title"),
    ('<p id="reply">A reply came.</p>', "A reply came."),
    ("<p>Let <math><mi>x</mi></math> be real.</p>", "Let x be real."),
    ('<div class="ad">Buy now</div>', None), ('<div class="comments"><p>First!</p></div>', None),
    ("<aside>Elsewhere</aside>", None), ("<form>Name</form>", None), ('<ul class="share-list"><li>Post it</li></ul>', None),
])
def test_html_parts_of_a_marked_article(part, text):
    page = f"<body><nav>Menu</nav><article><p>{LONG}</p>{part}<p>{LONG}</p></article><footer>End</footer></body>"
    assert html.extract(page) == "\n\n".join(x for x in (LONG.strip(), text, LONG.strip()) if x)


def brute_regions(weight):
    """Lines that the definition names: enough with the two lines behind, and with the two before."""
    n = len(weight)
    ahead = [sum(weight[i:i + html.WIDTH]) for i in range(n)]
    before = [sum(weight[max(0, i - html.WIDTH + 1):i + 1]) for i in range(n)]
    least = max(1, min(max(ahead, default=0) / 8, html.ENOUGH))
    return {i for i in range(n) if weight[i] and ahead[i] >= least and before[i] >= least}


def test_html_regions_match_their_definition():
    r = random.Random(8)
    for _ in range(400):
        weight = [r.choice([0, 0, 3, 12, 40, 90, 200, 900]) for _ in range(r.randint(0, 25))]
        found = html.regions(weight)
        assert all(weight[a] and weight[b - 1] for a, b in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
        assert {i for a, b in found for i in range(a, b) if weight[i]} == brute_regions(weight)


def test_html_time_grows_with_the_page():
    import time

    def seconds(n, unit):
        page = unit * n
        start = time.process_time()
        html.extract(page)
        return time.process_time() - start

    for unit in ("<div>x", "<div><td>x", "<b><p>x", "<div>x</section>", "<li>x", "<div><p>x<ul><li>y"):
        small, large = seconds(5_000, unit), seconds(50_000, unit)
        assert large < 40 * max(small, 0.02), unit
    assert seconds(100_000, "<div>x") < 20


def test_html_articles_of_the_pages(spark):
    import html as std
    import re

    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert html.extract(r.html) == "\n\n".join(b for b in (" ".join(std.unescape(p).split()) for p in parts) if b)


# Chat -------------------------------------------------------------------------------------------

def _cheapest(given, limit):
    """Least cost over all sequences of steps, by uniform-cost search without the automaton's shortcuts."""
    import heapq

    heap, seen = [(0.0, 0, "")], {}
    while heap:
        cost, i, roles = heapq.heappop(heap)
        legal = (roles.lstrip("s") == "ua" * (len(roles.lstrip("s")) // 2) and len(roles) - len(roles.lstrip("s")) <= 1
                 and len(roles.lstrip("s")) > 0)
        if i == len(given) and legal:
            return cost
        state = (i, roles[-1:], len(roles) > limit)
        if seen.get(state, 1e9) <= cost or len(roles) > limit:
            continue
        seen[state] = cost
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        for r in "uas":
            if r in ok:
                heapq.heappush(heap, (cost + chat.INSERT, i, roles + r))
            if i < len(given):
                fix = chat.role_cost(given[i], "uas".index(r))
                if r in ok:
                    heapq.heappush(heap, (cost + fix, i + 1, roles + r))
                if roles[-1:] == r:
                    heapq.heappush(heap, (cost + fix + chat.MERGE, i + 1, roles))
    return None


def test_repair_is_cheapest():
    r = random.Random(4)
    for n in range(7):
        for _ in range(25):
            given = [r.choice([0, 1, 2, None]) for _ in range(n)]
            assert chat.repair(given)[0] == _cheapest(given, 2 * n + 3), given


def _conversations(seed=6):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", "system", "Assistant", None, "bot"]), r.choice([None, "", f"m{c}.{t}", "x"]))
            for c in range(60) for t in range(r.randint(1, 12))]


@pytest.mark.parametrize("segment", [2048, 3])
def test_formatted_conversations(spark, segment):
    rows = _conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x"))
    got = chat.formatted(frame.repartition(5), segment=segment).collect()
    assert len(got) == len(rows)
    for c in {x[0] for x in rows}:
        own = sorted((x for x in got if x.conv == c), key=lambda x: x.place)
        turns = sorted(x for x in rows if x[0] == c)
        cost, _ = chat.repair([chat._given(x[2]) for x in turns])
        assert {x.cost for x in own} == {cost}
        whole = list(chat.turns_of(chat.rendered([x.rendered for x in own])))
        kinds = "".join(role[0] for role, _ in whole)
        assert kinds.lstrip("s") == "ua" * (len(kinds.lstrip("s")) // 2) and len(kinds) - len(kinds.lstrip("s")) <= 1
        said = [t for _, _, _, t in turns if t]
        assert [p for _, text in whole for p in text.split("\n") if p] == said


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, "assistant", "late"), (1, 5, "user", "x"),
            (2, 0, "user", "r"), (2, 0, "user", "r")]
    got = chat.formatted(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    assert "".join(x.rendered for x in sorted((x for x in got if x.conv is None), key=lambda x: x.place)) == (
        "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n")
    assert chat.formatted(spark.createDataFrame([], schema)).count() == 0


# Mixing -----------------------------------------------------------------------------------------

def _mix_rows():
    r = random.Random(9)
    words = {"a": [f"a{i}" for i in range(30)], "b": [f"b{i}" for i in range(30)], "c": [f"c{i}" for i in range(30)]}
    rows = []
    for i in range(300):
        d = r.choice("aaaabbc")
        n = r.randint(1, 60)
        rows.append((i, " ".join(r.choice(words[d if r.random() < 0.8 else r.choice("abc")]) for _ in range(n)), d))
    return rows


def test_rates_meet_targets(spark):
    rows = _mix_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, " \n")], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows if i % 3], "id long, domain string")
    found = mixing.rates(docs, labelled, {"a": 0.2, "b": 0.5, "c": 0.3}).toPandas().set_index("id")
    p = np.stack(found.posterior.values)
    assert np.allclose(p.sum(1), 1) and (found.rate >= 0).all()
    got = (p * (found.tokens * found.rate).values[:, None]).sum(0)
    assert np.allclose(got / found.tokens.sum(), [0.2, 0.5, 0.3], atol=1e-4)
    truth = {i: d for i, _, d in rows}
    right = [list("abc")[int(np.argmax(x))] == truth[i] for i, x in zip(found.index, p, strict=True) if i < 900 and i % 3 == 0]
    assert np.mean(right) > 0.85
    assert found.loc[[900, 901, 902]].tokens.tolist() == [0, 0, 0] and found.loc[[900, 901, 902]].rate.tolist() == [1, 1, 1]


def test_rates_with_a_very_long_document(spark):
    rng = random.Random(5)
    words = {d: [f"{d}{i}" for i in range(40)] for d in "ab"}
    rows = [(i, " ".join(rng.choices(words[d], k=30) + rng.choices(words["ab".replace(d, "")], k=6)), d)
            for i, d in enumerate("aaaabb" * 60)]
    rows.append((1000, " ".join(rng.choices(words["b"], k=3_000)), "b"))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows[:180]], "id long, domain string")
    found = mixing.rates(docs, labelled, {"a": 0.8, "b": 0.2}).toPandas()
    got = (np.stack(found.posterior.values) * (found.tokens * found.rate).values[:, None]).sum(0)
    assert (found.rate >= 0).all() and found.set_index("id").rate[1000] == 0
    assert np.allclose(got / found.tokens.sum(), [0.8, 0.2], atol=2 * mixing.TOLERANCE)


def _least_squares(load, aim, rounds=20_000):
    """Non-negative least squares by coordinate descent."""
    rate, total = np.ones(len(load)), load.sum(0)
    for _ in range(rounds):
        before = rate.copy()
        for d in np.flatnonzero((load ** 2).sum(1)):
            new = max(0.0, rate[d] - load[d] @ (total - aim) / (load[d] @ load[d]))
            total, rate[d] = total + (new - rate[d]) * load[d], new
        if np.abs(rate - before).max() < 1e-12:
            break
    return total


def test_targets_out_of_reach_give_least_squares(spark):
    docs = spark.createDataFrame([(1, "x y z"), (2, "x y w")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "a"), (2, "b")], "id long, domain string")
    with pytest.raises(ValueError, match="not met"):
        mixing.rates(docs, labelled, {"a": 1.0, "b": 0.0}, strict=True)
    rows = _mix_rows()[:60]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows], "id long, domain string")
    for targets in ({"a": 0.98, "b": 0.01, "c": 0.01}, {"a": 0.5, "b": 0.5, "c": 0.0}):
        group = f"mixing-{targets['a']}"
        spark.sparkContext.setJobGroup(group, group)
        found = mixing.rates(docs, labelled, targets).toPandas()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        assert jobs <= 4 * mixing.STEPS + 40
        tokens = found.tokens.sum()
        load = np.stack(found.posterior.values) * found.tokens.values[:, None]
        aim = np.array([targets[d] for d in found.domains[0]]) * tokens
        total = (load * found.rate.values[:, None]).sum(0)
        assert (found.rate >= 0).all()
        assert np.allclose(found.reached[0], total / tokens, atol=1e-9) and np.allclose(found.wanted[0], aim / tokens)
        best = _least_squares(load, aim)
        assert np.linalg.norm(total - aim) <= 1.02 * np.linalg.norm(best - aim) + 2 * mixing.TOLERANCE * tokens


def test_many_domains_are_refused(spark):
    rows = [(i, f"w{i} v{i}", f"d{i}") for i in range(70)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows], "id long, domain string")
    with pytest.raises(ValueError, match="domains"):
        mixing.rates(docs, labelled, {"d0": 1.0})


def test_posteriors_match_brute_force(spark):
    rows = _mix_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows], "id long, domain string")
    model = mixing.likelihoods(mixing.word_table(docs, labelled))
    got = {r.id: r.posterior for r in mixing.posteriors(docs, model).collect()}
    names, shares, logs = model
    table = {r.bucket: r for r in logs.collect()}
    every = {w for _, t, _ in rows for w in t.split()}
    place = {r.w: r.b for r in spark.createDataFrame([(w,) for w in every], "w string").select(
        "w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    for i, t, _ in rows[:60]:
        s = np.array([sum(round(table[place[w]][f"l{j}"], 4) for w in t.split()) / len(t.split()) ** mixing.SHRINK
                      + np.log(shares[j]) for j in range(len(names))])
        e = np.exp(s - s.max())
        assert np.allclose(got[i], e / e.sum(), atol=1e-9)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "x y", 3), (1, "x y", 3), (None, None, None)], "doc_id long, text string, rate int")
    none = spark.createDataFrame([], "id long, domain string")
    assert [r.rate for r in mixing.rates(docs, none, {"a": 1.0}).collect()] == [1.0] * 3
    assert mixing.mixed(docs, none, {"a": 1.0}).columns == docs.columns
    some = spark.createDataFrame([(1, "b")], none.schema)
    with pytest.raises(ValueError):
        mixing.rates(docs, some, {"a": 1.0})
    assert mixing.rates(docs.limit(0), none, {"a": 1.0}).count() == 0
    out = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n")).first()[0]
    assert abs(out - 1.3) < 0.02
