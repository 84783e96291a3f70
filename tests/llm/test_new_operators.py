"""Whitening, chat formatting and the divergence audit against plain versions on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tempfile
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lingospan.llm import chat, common, divergence, pages, personal, repeats, whitening

# Whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, n BIGINT, x STRING, index INT").repartition(4)


def table_of_vectors():
    rng = random.Random(3)
    base = [[rng.gauss(0, 1 + d) for d in range(6)] for _ in range(60)]
    rows = [(i, v, 1, "x", 2) for i, v in enumerate(base)]
    rows += [(100 + i, base[5], 1, "x", 2) for i in range(40)]  # copies
    rows += [(7, base[9], 0, None, None), (None, base[10], 0, None, None), (200, base[3][:4], 0, None, None), (201, [], 0, None, None)]
    rows += [(300, None, 0, None, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, None, None), (302, [float("nan")] * 6, 0, None, None)]
    return [*rows, (303, [float("inf")] + [0.0] * 5, 0, None, None)]


def expected_whitening(rows, components):
    padded = []
    for vec_id, v, *_ in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            padded.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (6 - len(v))))
    fit = sorted({tuple(x) for _, x in padded})
    n, sums = len(fit), np.sum(fit, axis=0)
    values, basis = np.linalg.eigh(np.cov(np.array(fit, float).T, bias=True))
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    out = defaultdict(list)
    for vec_id, x in padded:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        out[vec_id].append((deviation, (np.array(x) - sums / n) @ basis / np.sqrt(values)))
    return n, out, values / np.trace(np.cov(np.array(fit, float).T, bias=True))


def test_whitening_equals_numpy(spark):
    rows = table_of_vectors()
    got = whitening.op11_block_whitening(vectors(spark, rows)).collect()
    n, want, shares = expected_whitening(rows, 4)
    assert len(got) == 4 * sum(map(len, want.values()))
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        fits = [w for d, w in want[r.vec_id] if d == r.deviation]
        assert fits
        value = fits[0][r.component - 1]
        sign.setdefault(r.component, np.sign(value * r.whitened))
        assert any(abs(sign[r.component] * r.whitened - w[r.component - 1]) < 1e-9 for w in fits)
        assert abs(r.explained - shares[r.component - 1]) < 1e-9


def test_whitening_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 24)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    rows = table_of_vectors()
    found = whitening.whiten(vectors(spark, rows))
    assert found.identity_error < 1e-9 and len(found.values) == 6
    out = np.array([r.whitened for r in found.rows.collect()])
    assert out.shape == (104, 6)


def test_sums_and_deviations_beyond_a_long(spark):
    large = [(1, [3e37, 1.0], 0, "", 0), (2, [-3e37, 2.0], 0, "", 0), (3, [1e15, 3.0], 0, "", 0)]
    found = whitening.whiten(vectors(spark, large))
    limit = (1 << 63) - 1
    assert found.sums[0] == limit - limit - 1 + 256 * int(np.float32(1e15))
    assert {r.vec_id: r.deviation for r in found.rows.collect()} == {1: None, 2: None, 3: None}


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "", 0)], [(1, [1.0, 2.0], 0, "", 0)] * 3, [(1, [], 0, "", 0)]])
def test_whitening_without_components(spark, rows):
    got = whitening.op11_block_whitening(vectors(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


def test_whitening_of_flat_vectors_has_fewer_components(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0, "", 0) for i in range(9)]
    got = whitening.op11_block_whitening(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 for r in got)


# Chat


def conversations(spark, rows):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, node INT, START STRING"
    return spark.createDataFrame([(*r, 1, "s") for r in rows], schema).repartition(5)


def odd_conversations(seed=4):
    rng = random.Random(seed)
    said = ["hello", "", None, "<|im_end|>", r"<\|im_start|> <\\| <", "a\nb\r\n", "é🙂<", "|im_end|>\\", "x" * 70_000]
    rows = []
    for conv in range(40):
        rows.append((conv, 0, "system", "be brief") if conv % 3 else (conv, 0, "user", "hello"))
        for turn in range(1, rng.randrange(1, 7)):
            rows.append((conv, turn, "assistant" if turn % 2 else rng.choice(["user", None, "to\\ol\n<|x"]), rng.choice(said)))
    copied = [r for r in rows if r[0] == 5]
    rows += [(1000 + i, *r[1:]) for i in range(30) for r in copied]
    rows += [(1000 + 99, *r[1:]) for r in copied[:-1]]  # the start of another
    rows += [(2000, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]  # a long one
    rows += [(2001, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(200)] + [(2001, 200, "user", "other")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (50, None, "user", "no turn"), (50, 0, "assistant", "ok")]
    return [*rows, (51, 0, "assistant", "twice"), (51, 0, "assistant", "twice")]


def written(role, text):
    role, text = role or "", text or ""
    role = re.sub(r"<(\\*)\|", r"<\1\\|", role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"<|im_start|>{role}\n" + re.sub(r"<(\\*)\|", r"<\1\\|", text)


def in_order(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        w = written(role, text)
        by[conv].append((-1 if turn is None else turn, hashlib.md5(w.encode()).hexdigest(), role or "", text or "", w + "<|im_end|>\n"))
    return {conv: sorted(turns) for conv, turns in by.items()}


def test_chat_equals_brute_force(spark):
    rows = odd_conversations()
    got = {r.conv_id: r for r in chat.op12_prefix_tree_chat(conversations(spark, rows)).collect()}
    probe = "<|im_end|><|im_start|>assistant ok"
    want = in_order([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(t[4]) for t in turns)


def test_shared_turns_are_emitted_once_depth_first(spark):
    rows = odd_conversations()
    emitted, members = chat.format_conversations(conversations(spark, rows))
    nodes = sorted(emitted.collect(), key=lambda r: r.node)
    want = in_order(rows)
    prefixes = {tuple(t[4] for t in turns[: k + 1]) for turns in want.values() for k in range(len(turns))}
    assert len(nodes) == len(prefixes) and [r.node for r in nodes] == list(range(len(nodes)))
    stream = "".join(r.formatted for r in nodes)
    at = 0
    for r in nodes:
        assert (r.start, r.end) == (at, at + len(r.formatted))
        at = r.end
        path = "".join(stream[a.start : a.end] for a in r.attends)
        assert len(path) == r.position and r.attends == sorted(r.attends)
        turns = tuple(re.findall(r"<\|im_start\|>.*?<\|im_end\|>\n", path + r.formatted, re.DOTALL))
        assert turns in prefixes
        prefixes.remove(turns)
        assert (r.loss_start is not None) == (r.role == "assistant")
    # Depth first: a node's parent is the nearest node before it that is one turn shorter.
    for m in members.collect():
        whole = "".join(stream[i.start : i.end] for i in m.intervals)
        assert whole == "".join(t[4] for t in want[m.conv_id])
        assert "".join(r.formatted for i in m.intervals for r in nodes[i.node : i.node_end]) == whole
    depth = []
    for r in nodes:
        while depth and depth[-1][1] > r.position:
            depth.pop()
        assert r.position == 0 or any(end == r.position for _, end in depth)
        depth.append((r.node, r.position + r.end - r.start))


def test_chat_with_tokens(spark):
    rows = odd_conversations()
    words = lambda c: F.transform(F.split(c, " "), lambda w: (F.crc32(w) % 1000).cast("int"))
    emitted, members = chat.format_conversations(conversations(spark, rows), tokenize=words)
    for r in emitted.collect():
        assert len(r.tokens) == r.end - r.start and r.start >= 0
    assert members.count() == len(in_order(rows))


def test_deep_branching_takes_few_rounds(spark):
    # Conversation i follows i turns of the one before it and then goes its own way: a chain of branchings.
    rows = [(c, t, "user", f"t{t}" if t < c else f"own {c} {t}") for c in range(12) for t in range(c + 2)]
    emitted, _ = chat.format_conversations(conversations(spark, rows))
    got = emitted.collect()
    assert len(got) == len({tuple(x[4] for x in turns[: k + 1]) for turns in in_order(rows).values() for k in range(len(turns))})


def test_chat_of_an_empty_table(spark):
    got = chat.op12_prefix_tree_chat(conversations(spark, [])).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(-1, 2)]
    emitted, members = chat.format_conversations(conversations(spark, []))
    assert emitted.collect() == [] and members.collect() == []


# Divergence


def spoken(spark, rows):
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "text STRING, lang STRING, source STRING, count INT, term STRING").repartition(4)


def odd_speech(seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("stone", "River", "é", "日本", "ß", "ÄÖ") for b in ("", "s", "ing", "Ed")]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 60))), rng.choice(["en", "de"]), rng.choice("abcd")) for _ in range(90)]
    rows += [(None, "en", "a"), ("", "en", "empty"), ("123 -- \x00", "fr", "x"), ("seul", "fr", "y"), ("stone river", None, None)]
    return [*rows, *[("stone " * 5000, "en", "a")] * 3, ("x" * 50_000, "de", "a"), *[("only here", "xx", "s")] * 12]


def expected_divergences(rows, least, top):
    counts, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in terms]
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (at, t), n in docs.items() if at == lang and n >= least)
        sources = sorted(s for at, s in groups if at == lang)

        def weigh(found, kept=kept):
            whole = sum(found) + 2 * len(kept)
            return [1 + 10**9 * (c + 2) // whole for c in found]

        by = {s: [counts[lang, s, t] for t in kept] for s in sources}
        all_ = weigh([sum(by[s][i] for s in sources) for i in range(len(kept))])
        p = {s: weigh(by[s]) for s in sources}
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            terms = [(-((a - b) ** 2 // (a + b)), t.encode()) for t, c, a, b in zip(kept, by[s], p[s], all_, strict=True) if c and a > b]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(listed)}
    return out


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 3), (1000, 10)])
def test_divergences_equal_brute_force(spark, least, top):
    rows = odd_speech()
    got = divergence.divergences(spoken(spark, rows), least, top).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == expected_divergences(rows, least, top)


def test_divergences_in_small_pieces(spark, monkeypatch):
    for name, value in (("SLICE_BYTES", 100), ("HELD_ROWS", 20), ("SHARD_ROWS", 7), ("CELLS", 12)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_speech(6)
    got = divergence.divergences(spoken(spark, rows), 5, 4).collect()
    assert {tuple(r) for r in got} == expected_divergences(rows, 5, 4)


def test_weights_of_large_counts_are_exact():
    assert divergence._weights([10**15, 0], [3 * 10**15, 7]).tolist() == [1 + 10**9 * (10**15 + 2) // (3 * 10**15), 1 + 2 * 10**9 // 7]


def test_divergences_of_an_empty_table(spark):
    assert divergence.op13_arrow_divergence(spoken(spark, [])).collect() == []


def test_spans_and_surroundings_equal_slices_of_the_text(spark):
    rng = random.Random(1)
    bits = ["a@b.c", " ", "+49 123 456 7890", "1.2.3.4", "😀", "x [at] y.de", "4111 1111 1111 1111", "é", "\n", "word ",
            "a@b.cd@e.f", "12.3.4.5.6.7.8", " a long gap of more than some thirty letters ", "1:2:3:4:5:6:7:8"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["", "a@b.c", "a@b.c" * 30, " a@b.c" * (3 * personal.RUN), " a@b.c" * personal.RUN, "a@b.c " * (personal.RUN - 1)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    matches = 0
    for pattern in [*personal.STRICT.values(), *personal.LOOSE.values()]:
        for r in df.select("text", personal.found(F.col("text"), pattern).alias("found")).collect():
            assert [m.value for m in r.found] == [m[0] for m in regex.compile(pattern).finditer(r.text)]
            for m in r.found:
                assert (r.text[m.start : m.end], r.text[m.end : m.end + 1]) == (m.value, m.after)
                assert r.text[max(0, m.start - personal.AROUND) : m.start] == m.before
                matches += len(m.value) >= personal.SHORTEST
    assert matches > 2000


def test_all_candidates_teach(spark, monkeypatch):
    # The loose spelling is learned from documents that a bound would leave out.
    monkeypatch.setattr(personal, "SAMPLE_ROWS", 1, raising=False)
    pieces = ["call +1 (988) 555-2485 now", "ip 1.2.3.4", "no 300.1.1.1", "card 4111 1111 1111 1112", "a@b.com", "tel (988) 555-2485"]
    rows = [(i, " and ".join(pieces[: 1 + i % 6])) for i in range(600)]
    found = personal.op10_boosted_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    last = [r.spans.split(",")[-1] for r in found if r.doc_id % 6 == 5]
    assert len(last) == 100 and {s.split(":")[0] for s in last} == {"phone"}


def test_lessons_count_every_decided_candidate(spark):
    docs = spark.range(25_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("at 10.0.0."), F.col("id") % 500, F.lit(" or a@b.com")).alias("text")
    )
    rows = personal.lessons(personal.candidates(docs)).collect()
    counts = Counter()
    for r in rows:
        counts[r.kind, r.label] += r.n
    passed = sum(i % 500 <= 255 for i in range(25_000))
    assert counts == {("email", 1.0): 25_000, ("ip", 1.0): passed, ("ip", 0.0): 25_000 - passed}
    assert len(rows) < 100


def test_no_local_folder_on_a_cluster(spark):
    def session(master, **settings):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: settings))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session("spark://host:7077"))
    assert common.shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    assert common.shared_folder(session("local[2]")).startswith(tempfile.gettempdir())
    assert common.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_split_by_keys(spark):
    df = spark.createDataFrame([(i % 700 or None, str(i % 3), i) for i in range(5000)], "a bigint, b string, _part int")
    keys = spark.createDataFrame([(i, "1") for i in range(1, 700, 2)] + [(None, "0")], "a bigint, b string")
    may, rest = (set(map(tuple, x.collect())) for x in common.split_by_keys(df, keys, ["a", "b"]))
    wanted = {(i, "1") for i in range(1, 700, 2)} | {(None, "0")}
    assert not may & rest and may | rest == set(map(tuple, df.collect()))
    among = {r for r in may | rest if r[:2] in wanted}
    assert among <= may and len(may) <= len(among) + 50


@pytest.mark.parametrize("module", [pages, repeats])
def test_rows_that_lose_nothing_are_not_joined(spark, monkeypatch, module):
    parts = []

    def split(*args):
        parts.append(common.split_by_keys(*args))
        return parts[-1]

    monkeypatch.setattr(module, "split_by_keys", split)
    letters = random.Random(4)
    texts = ["".join(letters.choices("abcdefgh ", k=300)) for _ in range(40)]
    if module is pages:
        rows = [(i, f"http://h{i // 2}/a/{i}", f"<p>{t}</p><p>shared {i // 2}</p>" if i < 6 else f"<p>{t}</p>") for i, t in enumerate(texts)]
        got = pages.op3_nearest_url_difference(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {i: " ".join(t.split()) for i, t in enumerate(texts)}
    else:
        rows = [(i, t if i < 34 else texts[i - 34] + t) for i, t in enumerate(texts)]
        got = repeats.op7_prefix_free_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r.doc_id: r.n_removed for r in got} == {i: 300 * (i >= 34) for i in range(40)}
    touched, whole = parts[-1]
    assert (touched.count(), whole.count()) == (6, 34)
