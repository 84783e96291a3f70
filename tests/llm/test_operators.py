"""The training-data operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lingospan.llm import (
    decontamination,
    fingerprints,
    language,
    mixing,
    near_duplicates,
    pages,
    personal,
    quality,
    repeats,
    sharding,
)

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = "the of and stone river lantern quiet harbor winter signal marble orchard copper thread hollow meadow".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing"]) + str(rng.randrange(40)) for _ in range(n))


def odd_texts(seed: int = 1) -> list[str | None]:
    """Plain, short, empty, null, blank, repeated and long texts, copies and near copies."""
    rng = random.Random(seed)
    plain = [prose(rng, rng.randrange(20, 160)) for _ in range(30)]
    words = plain[0].split()
    near = [" ".join(w if i != 7 * k + 3 else "changed" for i, w in enumerate(words)) for k in range(4)]
    return [
        None, "", " \t\n", "one", "two words", "ÄÖÜ straße café", *plain, plain[3], plain[3], plain[4].upper(), *near,
        "again and again " * 400, "x" * 3000, prose(rng, 6000), " non breaking space", "a\x0bb\x0cc d",
        "🙂" * 150,
    ]


def documents(spark, texts, extra=()):
    rows = [(3 * i, t, "en" if i % 3 else None, ["a", "b", "c", None][i % 4], 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS).repartition(5)


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- fingerprints ------------------------------------------------------------------------------------


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.op1_chunk_fingerprints(docs).collect()}
    assert len(got) == len(texts)
    whole = [t or "" for t in texts]
    for i, t in enumerate(whole):
        after = whole[(i + 1) % len(whole)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        row = got[3 * i]
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, later = fingerprints.chunk_sets([x.encode() for x in (t, edited, after)])
        assert row.fingerprint == fingerprints.fingerprint(own) and row.edited_fingerprint == fingerprints.fingerprint(other)
        assert row.near_edited == fingerprints.containment(own, other)
        assert row.near_next == fingerprints.containment(own, later)
        if len(t) > 800 and len(set(t.split())) > 50:
            assert 0.6 < row.near_edited < 0.85


def test_chunks_resist_a_shift(texts):
    text = texts[-4].encode()
    one, two = fingerprints.chunk_sets([text, b"a few bytes in front " + text])
    assert fingerprints.containment(one, two) > 0.98
    assert sum(int(x) & 0xFF for x in one) <= len(text)


def test_fingerprints_of_one_and_none(spark, empty):
    one = spark.createDataFrame([(5, "abcdefgh", "en", "s", 8)], DOCS)
    row = fingerprints.op1_chunk_fingerprints(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert fingerprints.op1_chunk_fingerprints(empty).count() == 0
    twice = one.union(one).unionByName(spark.createDataFrame([(None, "zz", "en", "s", 8)], DOCS))
    assert fingerprints.op1_chunk_fingerprints(twice).count() == 3


# ---- near-duplicates ---------------------------------------------------------------------------------


def shingles(text: str | None, size: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([b" ".join(words)])
    return frozenset(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def component_ids(rows, size: int, percent: int = 80) -> dict:
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for d in ids:
        groups[find(d)].append(d)
    return {d: (len(sets[d]), min(g)) for g in groups.values() for d in g}


def test_near_duplicates(docs, texts):
    want = component_ids([(3 * i, t) for i, t in enumerate(texts)], 4)
    got = {r.doc_id: r for r in near_duplicates.op2_forest_components(docs).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_a_large_region_of_near_copies(spark):
    """A chain: every text differs a little from the one before, the ends have nothing in common."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        words = [*words[1:], f"w{60 + i}"]
        rows.append((i, " ".join(words)))
    for i in range(250, 400):
        own = words.copy()
        own[rng.randrange(60)] = f"z{i}"
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(7), words=5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == component_ids(rows, 5)


def test_matrix_is_drawn_in_many_tasks(spark):
    counts = spark.range(4096).selectExpr("id AS part", "1 + id % 7 AS n")
    matrix = sharding.communication_matrix(counts, 4096, 24, 0)
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3
    got = {r.part: r.to for r in sharding.communication_matrix(counts.where("part < 256"), 256, 24, 0).collect()}
    assert all(sum(to) == 1 + part % 7 for part, to in got.items()) and len(got) == 256
    sums = [sum(to[j] for to in got.values()) for j in range(24)]
    assert max(sums) - min(sums) <= 1


def test_near_duplicates_of_odd_tables(spark, empty):
    assert near_duplicates.op2_forest_components(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "a b c d e", "z")], "doc_id BIGINT, text STRING, part STRING")
    assert {r.component_id for r in near_duplicates.near_duplicates(rows).collect()} == {1}
    kept = near_duplicates.keep_one(rows)
    assert kept.columns == rows.columns and [r.doc_id for r in kept.collect()] == [1]


def test_one_row_of_each_group_stays(spark):
    text, other = "a b c d e f g h", "quite another text with words of its own"
    rows = [(1, text), (2, text), (2, other), (2, None), (2, None), (5, "w " * 9), (5, "w " * 9), (None, text), (None, "x y z"), (None, "x y z"), (7, " "), (None, "")]
    docs = spark.createDataFrame([(*r, i, "r") for i, r in enumerate(rows)], "doc_id BIGINT, text STRING, rows INT, _row STRING").repartition(3)
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter({(1, text): 1, (2, other): 1, (2, None): 2, (5, "w " * 9): 1, (None, "x y z"): 1, (7, " "): 1, (None, ""): 1})


def test_a_large_group_is_paired_in_few_trees(spark, monkeypatch):
    rng = random.Random(12)
    words = prose(rng, 200).split()
    near = [" ".join(w if i != k else f"new{k}" for i, w in enumerate(words)) for k in range(200)]
    docs = documents(spark, near)
    asked = []
    whole = near_duplicates._confirmed
    monkeypatch.setattr(near_duplicates, "_confirmed", lambda pairs, *rest: asked.append(pairs.count()) or whole(pairs, *rest))
    assert {r.component_id for r in near_duplicates.near_duplicates(docs).collect()} == {0}
    assert sum(asked) < near_duplicates.TREES * len(near) / 5


def test_a_family_that_is_never_linked(spark):
    # Texts that share four fifths of their words, but are not alike enough.
    rng = random.Random(13)
    shared = prose(rng, 80)
    docs = documents(spark, [f"{shared} {prose(rng, 18)}" for _ in range(300)])
    assert all(r.doc_id == r.component_id for r in near_duplicates.near_duplicates(docs).collect())


# ---- pages -------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>
 line.<br>Second&nbsp;part<!-- no --></p><div class="share-buttons">Share</div><aside>Related</aside>
<p>Last &lt;line&gt;</p><section id="comments"><article>Nice one!</article></section></article>
<div class="cookie-notice">We use cookies</div><form><p>Mail</p><input value="x"></form><footer>End</footer></body></html>"""


def test_article_of_a_page():
    assert pages.main_text(PAGE, None) == "Title & more\nFirst bold line. Second part\nLast <line>"
    assert pages.main_text("", None) == "" and pages.main_text("<p", None) == "" and pages.main_text("a < b", None) == "a < b"
    assert pages.main_text("<p>one<p>two<div>three</div>four<script>x", None) == "one\ntwo\nthree\nfour"


def test_class_words_do_not_drop_the_article():
    body = "<h1>Title</h1><p>Body</p><div class='ad'>Buy</div><div class='share-buttons'>Share</div>"
    for open_, close in [
        ("<div class='layout has-sidebar'><article>", "</article></div>"),
        ("<div id='search-page'><main>", "</main></div>"),
        ("<div class='search'><div class='widget wide'><article>", "</article></div></div>"),
        ("<article class='post category-social'>", "</article>"),
        ("<article class='social'>", "</article>"),
        ("<main class='site-main widget-area'>", "</main>"),
        ("<div class=header><div role=main>", "</div></div>"),
        ("<div class='layout has-sidebar'>", "</div>"),
        ("<div id='search-page'>", "</div>"),
    ]:
        got = pages.main_text(f"<body><nav>Home</nav>{open_}{body}{close}<div class='site-nav'>Up</div></body>", None)
        assert got == "Title\nBody", open_
    # Teasers and comments beside the article are not the article.
    rest = "<div class='related'><article>Teaser</article></div><section class='comments-area'><article>Nice</article></section>"
    assert pages.main_text(f"<div class='widget-page'>Top<article><p>Body</p></article>{rest}</div>", None) == "Top\nBody"
    assert pages.main_text("<li class='comment'><article>Nice</article></li><p>Body</p>", None) == "Body"


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(14))]
        b = [rng.randrange(6) for _ in range(rng.randrange(14))]
        at = pages.aligned(a, b)
        assert len(at) == len(set(at)) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at)


def test_shared_lines_of_neighbours_go(spark):
    def page(body):
        return f"<html><body><p>Banner text</p><p>{body}</p><p>Imprint</p></body></html>"

    rows = [
        (1, "http://x.org/a/1", page("one")), (2, "http://x.org/a/2?q=1", page("two")), (3, "http://x.org/b/", page("three")),
        (4, "http://alone.org/", page("four")), (5, None, None), (6, "http://x.org/c", "<article>kept</article>"),
        (7, "http://x.org/a/1", page("one")),
    ]
    table = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumn("text", F.lit("old"))
    got = {r.page_id: r.text for r in pages.op3_nearest_url_difference(table).collect()}
    assert got[2] == "two" and got[3] == "three" and got[4] == "Banner text\nfour\nImprint"
    assert got[5] == "" and got[6] == "kept" and got[1] in ("", "one")
    assert pages.op3_nearest_url_difference(table.limit(0)).count() == 0
    mates = {r.key: r.mate for r in pages.with_neighbour(table.withColumn("key", F.col("page_id").cast("string")), "key", "url").collect()}
    assert mates["2"] in ("1", "7") and "4" not in mates and {mates["1"], mates["7"]} & {"1", "7"}


def test_differencing_decides_inside_articles_too(spark):
    def page(i):
        story = "".join(f"<p>Story {i} part {k} says {i * k}.</p>" for k in range(3))
        return f"<body><article><h1>Title {i}</h1><p>Read us by mail</p>{story}</article><div>Imprint</div><div>Open {i}</div></body>"

    rows = [(i, f"http://x.org/{i}", page(i)) for i in range(4)]
    copy = "<article><p>Long text of a mirrored page.</p><p>More of it.</p></article>"
    rows += [(10, "http://y.org/a", copy), (11, "http://y.org/b", copy)]
    body = "<article>Teaser</article><div><p>Top</p><p>Body {}</p></div>"
    rows += [(20, "http://z.org/a", body.format(1)), (21, "http://z.org/b", body.format(2))]
    table = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: r.text for r in pages.op3_nearest_url_difference(table).collect()}
    for i in range(4):
        assert got[i] == "\n".join([f"Title {i}", *(f"Story {i} part {k} says {i * k}." for k in range(3)), f"Open {i}"])
    assert got[10] == got[11] == "Long text of a mirrored page.\nMore of it."
    assert got[20] == "Teaser\nBody 1" and got[21] == "Teaser\nBody 2"


def test_lines_of_articles_are_treated_alike_on_a_host(spark):
    def page(*body):
        return f"<nav>Home</nav><article>{''.join(f'<p>{x}</p>' for x in body)}</article><div>Imprint</div>"

    # A passage that two neighbours quote stays; a line of six pages of ten goes from all six, wherever they lie.
    rows = [(i, f"http://x.org/{i}", page(f"Own {i}", f"More {i}", *["Subscribe"] * (i > 3), *["Quoted"] * (i in (1, 2)))) for i in range(10)]
    # One id, and none, with several pages.
    rows += [(50, f"http://y.org/{i}", page(f"Y {i}")) for i in range(3)] + [(None, f"http://y.org/n{i}", page(f"N {i}")) for i in range(2)]
    rows += [(50, "http://y.org/0", page("Y 0"))]
    table = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumn("_key", F.lit(1))
    got = sorted((r.page_id is None, r.page_id or 0, r.text) for r in pages.op3_nearest_url_difference(table).collect())
    texts = [(False, i, f"Own {i}\nMore {i}" + "\nQuoted" * (i in (1, 2))) for i in range(10)]
    texts += [(False, 50, t) for t in ("Y 0", "Y 0", "Y 1", "Y 2")] + [(True, 0, "N 0"), (True, 0, "N 1")]
    assert got == texts
    assert set(pages.extract(table).columns) == {"page_id", "url", "html", "_key", "text"}


@pytest.mark.parametrize("most", [0, pages.BROADCAST_HASHES])
def test_generated_sites_give_their_articles(spark, monkeypatch, most):
    """The whole digest on sites whose articles are known; articles draw some paragraphs from a common stock."""
    monkeypatch.setattr(pages, "BROADCAST_HASHES", most)
    rng = random.Random(11)
    stock = [f"Passage {i} that many articles quote." for i in range(40)]
    rows, truth = [], {}
    for host, n in (("a.org", 40), ("b.org", 12), ("c.org", 7), ("d.org", 1)):
        for i in range(n):
            body = [f"{host} {i} {k} {rng.random()}" for k in range(rng.randint(2, 6))] + rng.sample(stock, rng.randint(0, 4))
            rng.shuffle(body)
            inside = ["Read this by mail"] if host != "d.org" else []
            html = "".join(f"<p>{x}</p>" for x in [*body, *inside])
            top = f"<div>{host} news</div><ul class='menu'><li>Home</li></ul>" if host != "d.org" else ""
            rows.append((len(rows), f"https://{host}/{i % 3}/{i}?s=1", f"<body>{top}<main>{html}</main><div class='ads'>Buy</div></body>"))
            truth[rows[-1][0]] = "\n".join(body)
    long = [f"Line {k} of a very long page." for k in range(20_000)]
    rows.append((900, "https://c.org/long", "<div>c.org news</div><main>" + "".join(f"<p>{x}</p>" for x in long) + "</main>"))
    truth[900] = "\n".join(long)
    table = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").repartition(5)
    got = {r.page_id: (r.text, r.n_chars) for r in pages.op3_nearest_url_difference(table).collect()}
    assert got == {k: (v, len(v)) for k, v in truth.items()}


# ---- sharding ----------------------------------------------------------------------------------------


def test_shards(docs, texts):
    rows = sharding.op4_hypergeometric_shards(docs).collect()
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id // 3] or "").encode()
        assert r["size"] == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {len(rows) // 24, len(rows) // 24 + 1}
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.op4_hypergeometric_shards(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_keep_columns_and_rows(spark, empty):
    table = spark.createDataFrame([(i % 50, "x", i, 1) for i in range(300)], "doc_id BIGINT, _rank STRING, slot BIGINT, part INT")
    got = sharding.shuffle_into_shards(table, 7)
    assert got.columns == ["doc_id", "_rank", "part", "shard", "slot"]
    counts = Counter((r.shard, r.slot) for r in got.collect())
    assert len(counts) == 300 and {k[0] for k in counts} == set(range(7))
    assert sharding.shuffle_into_shards(empty, 7).count() == 0


def test_communication_matrix_has_its_margins_and_law(spark):
    """Margins are exact, and a cell follows the hypergeometric law over many seeds."""
    counts = spark.createDataFrame([(0, 30), (1, 0), (2, 12), (3, 8)], "part BIGINT, n BIGINT")
    cells = []
    for seed in range(30):
        rows = {r.part: r.to for r in sharding.communication_matrix(counts, 4, 5, seed).collect()}
        assert [sum(rows[p]) for p in range(4)] == [30, 0, 12, 8]
        assert [sum(rows[p][j] for p in range(4)) for j in range(5)] == [10] * 5
        cells += rows[0]
    mean = sum(cells) / len(cells)
    spread = sum((x - mean) ** 2 for x in cells) / len(cells)
    assert mean == 6 and 1.3 < spread < 2.8  # 10 of 50 drawn 30 times: variance 1.96


# ---- quality -----------------------------------------------------------------------------------------


def labelled(spark, n=900, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, poor, toxic = prose(rng, rng.randrange(30, 90)), 0, 0
        if i % 5 == 0:
            poor, text = 1, " ".join(w.upper() + "!!" for w in text.split())
        if i % 7 == 0:
            toxic, text = 1, text.replace("stone", "wretch").replace("river", "vermin") + " wretch vermin"
        rows.append((i, text, "en", f"s{i % 9}", len(text)))
        if i % 2:
            labels.append((i, 1 - poor, toxic))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.op5_hierarchical_quality(docs, labels).collect()}
    wrong = [i for i, r in got.items() if r.kept != (i % 5 > 0 and i % 7 > 0)]
    assert len(got) == 900 and len(wrong) <= 9
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())


def test_quality_shrinks_small_sites(spark):
    groups = spark.createDataFrame([(1, 1.0, 0.5), (2000, 200.0, 0.5), (2000, 1800.0, 0.5)], "n BIGINT, good DOUBLE, prior DOUBLE")
    strength = quality._strength(groups)
    assert 0 < strength < 100
    assert 0.5 < (0.5 * strength + 1) / (1 + strength) < 0.9


def test_quality_of_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    got = quality.op5_hierarchical_quality(docs, none).collect()
    assert {r.doc_id for r in got if not r.kept} >= {0, 3, 6} and sum(r.kept for r in got) >= len(got) - 5
    assert quality.op5_hierarchical_quality(empty, none).count() == 0
    nulls = spark.createDataFrame([(9, None, None), (None, 0, 1)], "doc_id BIGINT, quality INT, toxic INT")
    assert quality.op5_hierarchical_quality(docs, nulls).count() == len(got)


# ---- language ----------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": "th ing er wh ou st".split(), "bb": "ch sch ung ei keit ü".split(), "cc": "猫 犬 鳥 の は".split()}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(12)), lang, "s", 1))
    rows += [(900, None, "aa", "s", 0), (901, "123 !!", "aa", "s", 0), (902, "thing", None, "s", 0), (None, "ung", None, "s", 0)]
    got = {r.doc_id: r for r in language.op6_hyperdimensional_language(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].lang_pred == sorted(parts)[i % 3] and 0 < got[i].score <= 1 for i in range(300))
    assert [got[i].lang_pred for i in (900, 901, 902, None)] == ["und", "und", "aa", "bb"] and got[900].score == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))


def test_language_counts_each_gram_once():
    counts, grams = language._grams(["Abc abc", "", "é", "x1y"])
    seen = {tuple(map(int, g)): counts[:, k] for k, g in enumerate(grams)}
    a, b, c = map(ord, "abc")
    assert list(seen[a, b, c]) == [2, 0, 0, 0] and list(seen[0, ord("é"), 0]) == [0, 0, 1, 0] and counts.sum() == 9
    assert (0, ord("x"), 0) in seen and (0, ord("y"), 0) in seen


def test_language_without_teachers(empty, docs):
    assert language.op6_hyperdimensional_language(empty).count() == 0
    got = language.op6_hyperdimensional_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in got.collect()} == {"und"}


# ---- repeats -----------------------------------------------------------------------------------------


def removed(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(data, mask, strict=True) if not m)
        runs = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        out[d] = (len(data), sum(mask), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs, texts):
    rng = random.Random(8)
    shared = prose(rng, 60)
    more = [prose(rng, 5) + shared[i:] + prose(rng, 5) for i in range(0, 90, 9)] + ["ab" * 400, "ab" * 120 + shared]
    rows = list(enumerate([*texts, *more]))
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op7_prefix_free_repeats(table).collect()}
    assert got == removed(rows)


def test_repeats_in_small_pieces(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 900)
    rows = [(i, base[rng.randrange(2000) : rng.randrange(3000, 6000)] + prose(rng, 20)) for i in range(12)]
    monkeypatch.setattr(repeats, "STRETCH", 700)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op7_prefix_free_repeats(table).collect()}
    assert got == removed(rows)


def test_repeats_of_odd_tables(spark, empty):
    assert repeats.op7_prefix_free_repeats(empty).count() == 0
    rows = spark.createDataFrame([(None, "y" * 99), (1, None), (2, "y" * 99)], "doc_id BIGINT, text STRING")
    got = repeats.without_repeats(rows).collect()
    assert len(got) == 3 and all(r.n_removed == 0 for r in got) and {r.kept for r in got} == {b"y" * 99, b""}


@pytest.mark.parametrize("parts", [1, 5])
def test_repeats_of_repeated_and_null_ids(spark, monkeypatch, parts):
    """Earlier is a smaller (id, place); a null id is the least, equal (id, place) is not earlier."""
    rng = random.Random(10)
    a, b, c = prose(rng, 60), prose(rng, 30), prose(rng, 90)
    rows = [(5, a), (5, a), (5, a + " end"), (6, b), (6, b), (6, prose(rng, 9) + b), (7, b[:150]), (7, c), (7, "tiny"), (8, c + a)]
    rows += [(None, prose(rng, 40)), (None, prose(rng, 140)), (None, c[20:180]), (None, c[20:180]), (None, prose(rng, 2) + c[20:180])]
    if parts > 1:
        monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    least = {}
    for d, t in rows:
        for p in range(len(t) - 99):
            at = (-1 if d is None else d, p)
            least[t[p : p + 100]] = min(at, least.get(t[p : p + 100], at))
    want = Counter()
    for d, t in rows:
        gone = {q for p in range(len(t) - 99) if least[t[p : p + 100]] < (-1 if d is None else d, p) for q in range(p, p + 100)}
        want[d, len(t), "".join(x for q, x in enumerate(t) if q not in gone)] += 1
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(parts)
    got = repeats.without_repeats(table).collect()
    assert Counter((r.doc_id, r.n_bytes, r.kept.decode()) for r in got) == want
    assert want[5, len(a), a] == 2 and want[6, len(b), b] == 2


# ---- decontamination ---------------------------------------------------------------------------------


def weighted_best(items, document):
    """Best weighted similarity of any item-sized window of a document with each item, by trying every window."""

    def tokens(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def runs(words, size):
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}

    sets = {}
    for i, t in items:
        w = tokens(t)
        if w:
            sets[i] = (len(w), min(5, len(w)), runs(w, min(5, len(w))))
    frequency = Counter((s, x) for _, s, g in sets.values() for x in g)
    import math

    weight = lambda s, x: math.log(1 + len(sets) / frequency.get((s, x), 1))
    words, out = tokens(document), {}
    for i, (n, s, grams) in sets.items():
        for start in range(max(1, len(words))):
            window = runs(words[start : start + n], s)
            both = sum(weight(s, x) for x in window & grams)
            if both:
                best = both / sum(weight(s, x) for x in window | grams)
                out[i] = max(out.get(i, 0), best)
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(8, 40))) for i in range(25)]
    items += [(25, items[0][1]), (26, "short item here"), (27, ""), (28, None), (29, "Solo")]
    rows = [(i, prose(rng, 120)) for i in range(20)]
    for k in range(20):
        words = items[k][1].split()
        for at in rng.sample(range(len(words)), k % 4):
            words[at] = "edited"
        if k % 5 == 4:
            words.insert(len(words) // 2, "inserted")
        rows.append((100 + k, prose(rng, 30) + "\n" + " ".join(words).upper() + ", " + prose(rng, 30)))
    rows += [(200, items[3][1]), (201, None), (202, ""), (203, "A short, item: here!"), (204, "it was solo"), (205, items[0][1][:20])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminations(docs, bench).collect()}
    want = {(d, i): s for d, t in rows for i, s in weighted_best(items, t).items() if s >= 0.8}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    table = {r.doc_id: r for r in decontamination.op8_simhash_decontamination(docs, bench).collect()}
    assert len(table) == len(rows) and {d for d, r in table.items() if not r.kept} == {d for d, _ in want}
    assert table[200].item_ids == "3" and table[200].similarity == pytest.approx(1.0)
    kept = decontamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in table.values())


def test_blocks_find_all_prints_within_the_radius(spark):
    rng = random.Random(1)
    pairs = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontamination.RADIUS):
            b ^= 1 << bit
        pairs.append((i, a - 2**63, (b - 2**63)))
    df = spark.createDataFrame(pairs, "i BIGINT, a BIGINT, b BIGINT")
    same = F.size(F.array_intersect(decontamination.blocks(F.col("a")), decontamination.blocks(F.col("b"))))
    assert df.filter(same == 0).count() == 0


def test_decontamination_of_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id BIGINT, text STRING")
    bench = spark.createDataFrame([(1, "not in there at all today")], "item_id BIGINT, text STRING")
    assert decontamination.op8_simhash_decontamination(empty, bench).count() == 0
    for items in (none, bench):
        got = decontamination.op8_simhash_decontamination(docs, items).collect()
        assert len(got) == docs.count() and all(r.kept for r in got)


def test_decontamination_without_ids(spark):
    rng = random.Random(12)
    item = prose(rng, 20)
    rows = [(None, prose(rng, 10) + " " + item), (None, prose(rng, 30)), (0, prose(rng, 12)), (None, None), (1, item)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(7, item)], "item_id BIGINT, text STRING")
    got = decontamination.op8_simhash_decontamination(docs, bench).collect()
    assert Counter((r.doc_id, r.item_ids, r.kept) for r in got) == Counter(
        [(None, "7", False), (None, "", True), (None, "", True), (0, "", True), (1, "7", False)]
    )
    assert {r.text for r in decontamination.keep_clean(docs, bench).collect()} == {rows[1][1], rows[2][1], None}


# ---- mixing ------------------------------------------------------------------------------------------


def targets(sizes: dict) -> dict:
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix(docs, texts):
    got = mixing.op9_golden_mix(docs).collect()
    words = {3 * i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    source = {3 * i: ["a", "b", "c", None][i % 4] for i in range(len(texts))}
    sizes = Counter()
    for d, n in words.items():
        sizes[source[d]] += n
    want, taken = targets(sizes), Counter()
    assert len(got) == len(texts)
    for r in got:
        assert r["size"] == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op9_golden_mix(docs.repartition(2)).collect()))


def test_mix_with_a_hot_and_a_tiny_source(spark, empty):
    rows = [(i, "w " * 200, "en", "hot", 1) for i in range(400)] + [(1000, "one two", "en", "tiny", 1), (1001, None, "en", "void", 0)]
    table = spark.createDataFrame([*rows, (7, "w " * 200, "en", "hot", 1)], DOCS)
    got = mixing.op9_golden_mix(table).collect()
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
        assert r.taken <= 3 * r["size"]
    assert len(got) == 403 and taken[2] == 6 and taken[80200] == 80202 - 6 and taken[0] == 0
    assert mixing.op9_golden_mix(empty).count() == 0


def test_schedule_has_low_discrepancy(spark, docs):
    rows, slots = mixing.mix(docs, block_tokens=16)
    order = [r.sid for r in slots.orderBy("slot").collect()]
    total = Counter(order)
    seen = Counter()
    for k, sid in enumerate(order, 1):
        seen[sid] += 1
        assert all(abs(seen[s] - k * total[s] / len(order)) < 6 for s in total)


def test_a_mix_is_planned_in_parts(docs, capsys):
    mixing.mixed_documents(docs).explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and plan.count("Exchange") <= 4, plan.count("Exchange")


def test_mixed_documents_keep_columns(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert max(Counter(r.doc_id for r in mixed.select("doc_id").collect()).values()) <= 3


# ---- personal data -----------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def private_texts():
    rng = random.Random(11)
    pieces = [
        "a@b.com", "x.y+z@mail-1.example.co.uk", "a@b.com_c@d.org", "a@b@c.de", "@no", "1.2.3.4", "256.1.1.1", "007.1.1.255",
        "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "1234  5678", "9" * 40,
        "+1 (988) 555-2485", "+49.30.123456", "++1", "+1 2", "(988) 555-2485", "joe (at) example dot com", "3.14", "🙂é",
        "0049 301 234 5678", "10.0.0.1:80", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "+1 22 333 4444 " + "4111111111111111",
    ]
    texts = [" ".join(rng.choices([*pieces, "word", "phone", ",", "-"], k=rng.randrange(1, 14))) for _ in range(150)]
    texts += ["".join(rng.choices("0123456789 -.+()@ab", k=60)) for _ in range(150)]
    return [*texts, None, "", "1 " * 20_000, "1" * 60_000, "a" * 60_000 + "@", "b." * 30_000 + "@c" + ".d" * 20_000, "1." * 30_000]


def test_personal_data(spark):
    texts = private_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(5)
    got = {r.doc_id: r for r in personal.op10_boosted_personal_data(table).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t or "") if len(t or "") < 10_000 else None
        if want is None:
            continue
        joined = ",".join(f"{k}:{a}:{z}" for a, _, k, z in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        counts = Counter(k for _, _, k, _ in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(counts[k] for k in BASE)
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))


def test_redaction(spark):
    df = spark.createDataFrame([("call +1 (988) 555-2485 or a@b.com!",)], "text STRING").withColumn("doc_id", F.lit(1))
    spans = personal.personal_spans(df).select("doc_id", "base")
    out = df.join(spans, "doc_id").select(personal.redact(F.col("text"), F.col("base")).alias("text")).first()
    assert out.text == "call [phone] or [email]!"


def test_personal_data_of_odd_tables(spark, docs, empty, texts):
    assert personal.op10_boosted_personal_data(empty).count() == 0
    got = personal.op10_boosted_personal_data(docs.withColumn("start", F.lit(1)).withColumn("base", F.lit(2))).collect()
    assert len(got) == len(texts) and all(r.spans == "" for r in got)
