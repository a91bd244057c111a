"""Operators against brute force on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SF, multiset, oracle
from pyspark.sql import functions as F

from meterflow.llm import ann, bpe, extraction, hmm_model, jaccard_join, mixing, quality_classifier, quality_rules, registry, substring_dedup, warc
from meterflow.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
rng = np.random.default_rng(3)
VOCAB = [f"w{i}" for i in range(400)] + ["été", "naïve,", "日本", "THE", "the", "…"]


def words(n):
    return [VOCAB[i] for i in rng.integers(0, len(VOCAB), n)]


BASE = words(300)
PASSAGE = words(60)


def _near(k):
    w = list(BASE)
    for i in rng.integers(0, len(w), k):
        w[i] = "changed"
    return " ".join(w)


ROWS = [
    (1, " ".join(BASE), "a"), (2, " ".join(BASE), "a"), (3, _near(1), None), (4, _near(2), "b"), (5, _near(9), "b"), (6, None, "b"), (7, "", "a"), (8, " \t\n", "c"),
    (9, " ".join(words(50) + PASSAGE + words(50)), "c"), (10, "\n".join([*words(20), " ".join(PASSAGE), *words(30)]), "a"), (11, "one two", "a"), (12, "One two", "a"), (13, "solo", None),
    (14, " ".join(["same"] * 100), "c"), (15, " ".join(words(9000)), "d"), (16, "x" * 40_000, "d"), (17, " ".join(PASSAGE[:34]), "d"), (1, " ".join(BASE), "a"), (None, " ".join(words(40)), "b"),
    (18, "\x1c a\x85b  c　d", "a"), (19, "a b c\r\n\r\na b c\n\na b c", "a"),
]
KINDS = "doc_id long, text string, source string, n_words string, kept string, lang string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", None, "en", 0) for r in ROWS], KINDS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def rows(df, *columns):
    return collections.Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


def test_oracle_queries(spark):
    for name, sql in registry.SQL.items():
        assert multiset(registry.QUERIES[name](spark, SF).toPandas()) == multiset(oracle(sql)), name


def test_substring_dedup(docs, none):
    got = rows(substring_dedup.dedup(docs).withColumn("sha", F.sha2("kept", 256)), "doc_id", "n_words", "n_removed", "sha")
    expected = substring_dedup.brute_force([r[1] for r in ROWS])
    assert got == collections.Counter((r[0], *e) for r, e in zip(ROWS, expected, strict=True))
    assert substring_dedup.dedup(none).count() == 0


def test_dedup_of_short_windows_is_exact(spark):
    texts = [" ".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 40, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = substring_dedup.dedup(df, window=6, gram=3, bits=16).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out] == substring_dedup.brute_force(texts, 6)


@pytest.mark.parametrize("hot_runs", [0, 3, 25])
def test_dedup_of_a_passage_of_many_texts(spark, hot_runs):
    own = lambda i: " ".join(f"{i}.{j}" for j in range(20))
    texts = [f"{own(i % 35)} {' '.join(PASSAGE)} {own(i)}" for i in range(40)] + [own(7), " ".join(PASSAGE), None, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = substring_dedup.dedup(df, hot_runs=hot_runs, bits=16).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out] == substring_dedup.brute_force(texts)


@pytest.mark.parametrize(("shingle", "threshold"), [(3, 90), (5, 80)])
def test_jaccard(docs, none, shingle, threshold):
    known = docs.where("doc_id IS NOT NULL")
    got = rows(jaccard_join.jaccard_components(known, shingle=shingle, threshold=threshold), "doc_id", "n_shingles", "component_id")
    mine = [r for r in ROWS if r[0] is not None]
    assert got == collections.Counter(jaccard_join.brute_force([r[0] for r in mine], [r[1] for r in mine], shingle, threshold))
    assert jaccard_join.jaccard_components(none).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == len(ROWS)


def test_jaccard_slices_and_chains(spark):
    chain = [list(BASE)]
    for i in range(40):
        w = list(chain[-1])
        w[7 * i % 300] = f"step{i}"
        chain.append(w)
    texts = [" ".join(w) for w in chain] + [" ".join(words(n)) for n in range(1, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(jaccard_join.jaccard_components(df, slice_rows=7), "doc_id", "n_shingles", "component_id")
    assert got == collections.Counter(jaccard_join.brute_force(list(range(len(texts))), texts))


def test_quality_rules(docs, none):
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs.where("doc_id > 1")).collect()}
    for i, text, _ in ROWS:
        if i in out:
            w = re.findall(WORD, text or "")
            grams = collections.Counter(zip(w, w[1:], w[2:]))
            hit = {p for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (k, k + 1, k + 2)}
            lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
            assert (out[i].n_words, out[i].word_chars, out[i].n_repeat_words, out[i].n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines))), i
            assert out[i].base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert out[6].kept is False and quality_rules.quality_rules(none).count() == 0


def test_mixing(docs, none):
    mix = mixing.Mix(docs, docs_per_block=2)
    first = rows(mix.placed(mix.sized), "doc_id", "_source", "_size", "_copies")
    again = mixing.Mix(docs, docs_per_block=2)
    count = lambda c: collections.Counter((*k[:3], len(k[3])) for k in c.elements())
    assert count(first) == count(rows(again.placed(again.sized), "doc_id", "_source", "_size", "_copies")) and sum(first.values()) == len(ROWS)
    assert all(len(k[3]) <= 3 for k in first)
    assert mixing.Mix(none).placed(mixing.Mix(none).sized).count() == 0
    assert mixing.mixed(none).count() == 0
    taken = sum(len(k[3]) * n for k, n in first.items())
    assert mixing.mixed(docs, docs_per_block=2).count() == taken


def _exchanges(plan):
    """The columns of each shuffle of a physical plan."""
    own = [{plan.output().apply(i).name() for i in range(plan.output().size())}] if plan.nodeName() == "Exchange" else []
    return own + [x for i in range(plan.children().size()) for x in _exchanges(plan.children().apply(i))]


def test_a_mix_moves_texts_once(spark, docs, monkeypatch):
    """Whole texts go through one shuffle, that to their shards; without tables for all tasks the mix is the same."""
    docs, key = written(docs, "t"), "spark.sql.autoBroadcastJoinThreshold"
    moves = lambda df: sum("text" in x for x in _exchanges(df._jdf.queryExecution().executedPlan().initialPlan()))
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        mix = mixing.mixed(docs, docs_per_block=2)
        assert moves(mix) == 1
        monkeypatch.setattr(mixing, "MOST_SENT", -1)
        plain = mixing.mixed(docs, docs_per_block=2)
        assert moves(plain) == 4 and rows(mix, *docs.columns) == rows(plain, *docs.columns)
    finally:
        spark.conf.set(key, before)


def test_targets_and_tree():
    goal = mixing.targets([10, 1000, 100], [5, 2, 1])
    assert goal[0] == 30 and math.isclose(sum(goal), 1110) and math.isclose(goal[1] / goal[2], 2) is False
    assert goal[2] == 300 and goal[1] == 780
    tree = mixing.splitting_tree([100, 37, 0, 5], 7, 1)
    assert tree.sum(axis=0).tolist() == [100, 37, 0, 5] and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 1
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    mix = mixing.Mix(docs, shard_words=1 << 14, docs_per_block=4)
    found = mix.placed(mix.sized).toPandas()
    found["taken"] = found._size * found._copies.map(len)
    for _, own in found.groupby("_source", dropna=False):
        assert abs(own.taken.sum() - own._target.iloc[0]) <= own._size.max()
    assert (found.taken <= 3 * found._size).all()
    blocks = mix.blocks.toPandas()
    per_shard = collections.Counter(s for x in blocks._shards for s in x)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) > 3
    out = mixing.op5_mix_sources(spark, SF).toPandas()
    assert len(out) == docs.count() and (out.taken == out["size"] * out.shards.map(len)).all()
    places = collections.defaultdict(list)
    for r in out.itertuples():
        for at in zip(r.shards, r.parts, r.places, strict=True):
            places[at[:2]].append(at[2])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in places.values())
    again = mixing.op5_mix_sources(spark, SF).toPandas()
    assert out.sort_values("doc_id").astype(str).values.tolist() == again.sort_values("doc_id").astype(str).values.tolist()


def test_draws_walk_to_the_shards_of_the_tree():
    quotas, shards = np.array([100, 37, 0, 5]), 7
    tree = mixing.splitting_tree(quotas.tolist(), shards, 1)
    source = np.repeat(np.arange(4), quotas)
    index = np.concatenate([np.arange(n) for n in quotas])
    order = rng.permutation(len(index))
    got = np.empty(len(index), np.int64)
    got[order] = mixing.shards_of(quotas, shards, 1, source[order], index[order])
    assert got.tolist() == [s for i in range(4) for s in range(shards) for _ in range(tree[s, i])]


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    own = Tokenizer.from_file(path)
    out = bpe.decode(bpe.encode(docs, path, leaf=500), path).collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == own.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(ids)
        assert r.decoded == (r.text or "") == own.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(none, path), path).count() == 0


def test_bpe_joins_are_exact():
    from tokenizers import Tokenizer

    own, c = Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path())
    bits = ["the", " ", "  ", "\n", "'", "'s", "'ll", "l", "!!", "é", "日本", "1", "22", "<|endoftext|>", "<|endof", "text|>", "a" * 30, "\t", "🙂", "　", "\r\n"]
    for _ in range(300):
        text = "".join(rng.choice(bits, int(rng.integers(2, 120))))
        leaf = int(rng.integers(1, 40))
        parts = [(text[i : i + leaf].encode(), c.encode(text[i : i + leaf])) for i in range(0, len(text), leaf)]
        assert bpe.joined(c, parts).tolist() == own.encode(text, add_special_tokens=False).ids


def test_hmm(docs, none):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*re.findall(WORD, (t or "").translate(fold)), None]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    df = docs.withColumn("held_out", hmm_model.held_out(F.col("doc_id")))
    model = hmm_model.LanguageModel(df.where("NOT held_out"), init_rounds=3)
    got = model.score(df, carry=("doc_id", "held_out")).collect()
    count = collections.Counter(w for i, t, _ in ROWS if not out_of(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = sorted(((i or -1), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in ROWS)
    assert sorted(((r.doc_id or -1), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert model.score(df.where("false"), carry=("doc_id",)).count() == 0
    bare = hmm_model.LanguageModel(none)
    assert {r.train_tokens for r in bare.score(docs).collect()} == {0}


def test_hmm_trains_on_texts_of_any_length(spark):
    texts = [" ".join(words(3000)) for _ in range(4)] + ["short one", ""]
    model = hmm_model.LanguageModel(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), init_rounds=3, rounds=0)
    blobs = [t.encode() for t in texts]
    _, at, sym = hmm_model.sequences(np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])]))
    share = np.full(hmm_model.END + 1, 1 / (hmm_model.END + 1))
    whole = hmm_model.seeded(share, 4, 5)
    for _ in range(3):
        whole = hmm_model.Hmm.from_counts(whole.counts(sym, at + np.arange(len(at))), share, 4)
    assert np.allclose(model.seen.move, whole.move) and np.allclose(model.seen.emit, whole.emit)


def test_hmm_emits_words(spark):
    number = lambda w: int(hmm_model.class_of(hmm_model.sequences(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[0])
    seen, pair = {}, None
    while pair is None:  # two words of one hash class
        w = f"q{len(seen)}"
        pair = next(((x, w) for x, c in seen.items() if c == number(w)), None)
        seen[w] = number(w)
    a, b = pair
    texts = [f"{a} x " * 40 + "x", f"{b} y " * 40 + "y", "x y", None, f"{a} {b}"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = hmm_model.LanguageModel(df, init_rounds=2, rounds=3, settled=-1)
    vocab = {w: i for i, w in enumerate([a, b, "x", "y"])}
    seqs = [[*(vocab[w] for w in (t or "").split()), 4] for t in texts]
    sym, at = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(q) for q in seqs])])
    odds = lambda x: (x + 1 / 4) / (x.sum(axis=0) + 6 / 4)
    whole, symbols = model.seen, np.array([*map(number, vocab), hmm_model.END])[sym]
    for i in range(4):  # the first round has the classes' odds and keeps the words' counts
        x, log = whole.expected(symbols if i == 0 else sym, at, sym, 5)
        assert math.isclose(log, model.likelihoods[i], rel_tol=1e-6)
        start, move = x[:4] + 1 / 4, x[4:20].reshape(4, 4) + 1 / 4
        whole = hmm_model.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), odds(x[20:].reshape(-1, 4)))
    got = model.score(df.withColumn("t", F.col("text")), carry=("t",)).collect()
    assert collections.Counter((r.t, round(r.score, 4)) for r in got) == collections.Counter((t, round(v / math.log(10), 4)) for t, v in zip(texts, whole.forward(sym, at)))
    assert np.abs(whole.emit[0] / whole.emit[0].sum() - whole.emit[1] / whole.emit[1].sum()).max() > 0.01
    own = hmm_model.LanguageModel(df, carry=("text",), init_rounds=2, rounds=3, settled=-1).scored(df.schema).collect()
    assert collections.Counter((r.text, round(r.score, 4)) for r in own) == collections.Counter((r.t, round(r.score, 4)) for r in got)
    flat = hmm_model.LanguageModel(df, states=1, init_rounds=1, rounds=1)
    assert all(math.isclose(r.score, r.base_score, rel_tol=1e-9) for r in flat.score(df, carry=("text",)).collect())


def test_hmm_recursions(monkeypatch):
    monkeypatch.setattr(hmm_model, "SEGMENT", 7)
    k = 3
    h = hmm_model.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm_model.END + 1), k).T)
    size = [1, 5, 20, 33, 7, 14]
    sym, at = rng.integers(0, hmm_model.END + 1, sum(size)), np.concatenate([[0], np.cumsum(size)])
    total, logs = 0, []
    for a, b in zip(at, at[1:]):
        s = sym[a:b]
        al, be = [h.start * h.emit[s[0]]], [np.ones(k)]
        for x in s[1:]:
            al.append((al[-1] @ h.move) * h.emit[x])
        for x in s[:0:-1]:
            be.append(h.move @ (h.emit[x] * be[-1]))
        be, z = be[::-1], al[-1].sum()
        move, emit = np.zeros((k, k)), np.zeros((hmm_model.END + 1, k))
        for t in range(len(s)):
            emit[s[t]] += al[t] * be[t] / z
            if t + 1 < len(s):
                move += np.outer(al[t], h.emit[s[t + 1]] * be[t + 1]) * h.move / z
        total = total + np.concatenate([al[0] * be[0] / z, move.ravel(), emit.ravel()])
        logs.append(math.log(z))
    assert np.allclose(h.forward(sym, at), logs) and np.allclose(h.counts(sym, at), total)


def test_classifier(spark, docs, none):
    good = [(i, " ".join(words(15)), 2) for i in range(1200)]
    loud = [(2000 + i, " ".join(w.upper() + "!!" for w in words(15)), 1) for i in range(400)]
    rude = [(3000 + i, " ".join(["awful", *words(15), "wretched"]), 0) for i in range(400)]
    df = spark.createDataFrame(good + loud + rude, "doc_id long, text string, grade int")
    model = quality_classifier.train(df.where("doc_id % 2 = 0"))
    assert (np.diff(model.cut) > 0).all()
    out = quality_classifier.classify(df.where("doc_id % 2 = 1"), model).collect()
    right = [r.kept == (r.grade == 2) for r in out]
    assert sum(right) / len(right) > 0.9
    assert all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in out)
    assert quality_classifier.classify(docs, model).count() == len(ROWS) and quality_classifier.classify(none, model).count() == 0
    empty = quality_classifier.train(df.where("false"))
    assert abs(quality_classifier.classify(docs, empty).first().expected_grade - 1) < 1e-9


def test_classifier_slopes():
    score, grade, cut = rng.normal(size=20), rng.integers(0, 3, 20), np.array([-0.4, 0.9])
    base, by_score, by_cut = quality_classifier.loss_and_slopes(score, grade, cut)
    for i in range(20):
        moved = score.copy()
        moved[i] += 1e-6
        assert abs((quality_classifier.loss_and_slopes(moved, grade, cut)[0] - base) / 1e-6 - by_score[i]) < 1e-4
    for i in range(2):
        moved = cut.copy()
        moved[i] += 1e-6
        assert abs((quality_classifier.loss_and_slopes(score, grade, moved)[0] - base) / 1e-6 - by_cut[i]) < 1e-4


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies and more cookies on this site, do you accept all of our cookies?</div><article><h1>Head &amp; line</h1>
<p>First   paragraph with <b>bold</b>&nbsp;text that is long enough to be the main text of this page.</p><p>Short.</p><script>var a="</p>";</script>
<p>Second paragraph, also of some length so that the window sums stay high until the end.</p><div class="comments"><p>A reader's comment that is also quite long and should not be kept here.</p></div></article>
<aside>Other stories that you may like and which have many words in them as well</aside><form><p>Subscribe</p></form><footer>&copy; Footer text that is long enough to look like text of an article, really.</footer></body></html>"""


def test_extraction(spark):
    assert extraction.main_text(PAGE).split("\n") == [
        "Head & line", "First paragraph with bold text that is long enough to be the main text of this page.", "Short.",
        "Second paragraph, also of some length so that the window sums stay high until the end.",
    ]
    for odd in (None, "", "<", "<p", "<!--", "plain text", "<script>x", '<a "' * 50, "<div>" * 2000):
        assert isinstance(extraction.main_text(odd), str)
    assert extraction.main_text("<body><p>Only words</p></body>") == "Only words"
    df = spark.createDataFrame([(1, None, None), (2, "u", PAGE), (2, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = extraction.extract(df).collect()
    assert sorted(r.n_chars for r in out) == [0, len(extraction.main_text(PAGE)), len(extraction.main_text(PAGE))]
    assert extraction.extract(df.where("false")).count() == 0


LONG = "A paragraph with enough words in it to be taken for the main text of a page by any rule whatever."


@pytest.mark.parametrize("page", [
    "<body><div class='content has-sidebar'><article><p>{}</p></article></div></body>", "<body><div class='no-sidebar'><p>{}</p></div></body>",
    "<body><div class='layout sidebar'><div><main><p>{}</p></main></div></div><div class=sidebar><p>gone</p></div></body>",
    "<body><article class='post comments-open'><p>{}</p></article></body>", "<body><article class='widget'><p>{}</p></article></body>",
    "<body><form id=aspnet><article><p>{}</p></article></form></body>", "<body><div class='social-effects'><p>{}</p></div></body>",
    "<body><article><section id='discussion'><p>{}</p></section><div class='related-posts'><p>gone</p></div></article></body>",
    "<body><div class='cookie-notice'><p>gone</p></div><div id='site-footer'><p>gone</p></div><p>{}</p></body>",
    "<body><div class='related'><article><p>gone</p></article></div><p>{}</p></body>",
    "<body><aside><article><p>gone</p></article></aside><p>{}</p></body>", "<body><div class='comments' style='display:none'><main>gone</main></div><p>{}</p></body>",
])
def test_extraction_drops_only_boilerplate(page):
    assert extraction.main_text(page.format(LONG)) == LONG


def test_extraction_keeps_headings_with_slug_ids():
    page = f"<article><h2 id='social-effects'>Social effects</h2><p>{LONG}</p><h2 id='related-work'>Related work</h2><h2 id=discussion>Discussion</h2><p>{LONG}</p></article>"
    assert extraction.main_text(page).split("\n") == ["Social effects", LONG, "Related work", "Discussion", LONG]


def test_extraction_keeps_all_lines_of_an_article():
    links = "".join(f"<li><a href=x>linked {i}</a></li>" for i in range(5))
    page = f"<body><p>out</p><article><h1>Headline</h1><div class=share>s</div><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p><aside>a</aside><p>Caption.</p><form>f</form><p>The end.</p><p><a href=x>Source</a></p></article></body>"
    assert extraction.main_text(page).split("\n") == ["Headline", LONG, *(f"linked {i}" for i in range(5)), LONG, "Caption.", "The end.", "Source"]


def test_warc(spark, tmp_path):
    long, short = "<p>" + "é" * 200, "<p>x"
    data = [(5, "u5", long), (3, None, long), (9, "a\nb%0A", long), (4, "s", short), (6, "s", short), (7, "n", None), (3, "again", long), (None, "z", long), (10, "big", "word " * 300_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    archives = warc.archive(pages, archive_bytes=1000)
    got = {(r.page_id, r.url): r for r in warc.read_archives(archives).collect()}
    assert len(got) == len(data)
    for i, url, html in data:
        raw = (html or "").encode()
        r = got[i, url]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = html == long and i != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload == (None if revisit else raw)
    assert warc.archive(pages.where("false")).count() == 0
    warc.save(archives, str(tmp_path))
    assert sum(len(list(warc.unpack(p.read_bytes()))) for p in tmp_path.glob("*.warc.zst")) == len(data)


def test_ann(spark):
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    vectors += [(300 + i, vectors[20][1]) for i in range(30)]  # ties
    vectors += [(400, None), (420, [0.0] * 8), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] * 8), (480, [float("inf")] + [0.0] * 7), (500, [1.0, 2.0]), (None, [1.0] * 8), (520, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, block=64, query_block=4)
    ok = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    expected = collections.Counter()
    for i, v in ok:
        if i % 20 == 0:
            near = sorted((-functools.reduce(lambda x, ab: x + ab[0] * ab[1], zip(v, w), 0.0), j) for j, w in ok if j != i and len(w) == len(v))[:20]
            expected.update((i, r, j, -s) for r, (s, j) in enumerate(near, 1))
    assert rows(got, "query_id", "rank", "vec_id", "score") == expected
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_linked_sets_share_a_signature():
    import numpy as np

    from meterflow.llm.jaccard_join import signatures

    rng = np.random.default_rng(5)
    for threshold in (80, 90):
        for n in [*range(1, 120), 400, 1500]:
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = int(rng.integers(0, n * (100 - threshold) // 100 + 1))
            b = np.sort(np.delete(a, rng.choice(n, gone, replace=False)))
            if 100 * len(b) >= threshold * n:
                sa, sb = (signatures(x, np.array([0, len(x)]), threshold)[0] for x in (a, b))
                assert np.intersect1d(sa, sb).size


def test_components(spark):
    from meterflow.llm import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(200, 201), (201, 200), (201, 201), (None, 3), (300, 299)]
    df = spark.createDataFrame([(u, v) for u, v in edges] * 2, "u long, v long").repartition(7)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200, 299: 299, 300: 299}
    assert components.components(df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_few_edges_end_in_one_task_and_give_what_stars_give(spark, kind):
    from meterflow.llm import components

    rng = np.random.default_rng(8)
    edges = [tuple(x) for x in rng.integers(0, 900, (500, 2)).tolist()]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5).selectExpr(*(f"CAST(CAST({c} AS STRING) AS {kind}) AS {c}" for c in "uv"))
    found = [collections.Counter((bytes(r.node), bytes(r.root)) if kind == "binary" else tuple(r) for r in components.components(df, alone=n).collect()) for n in (0, 1 << 18)]
    assert found[0] == found[1] and max(found[0].values()) == 1 and len(found[0]) > 300
    spark.sparkContext.setJobGroup(f"few-{kind}", "")
    try:
        components.components(df)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few-{kind}")) <= 3  # a round of stars alone has more
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sets_are_named_by_their_least_id(spark):
    from meterflow.llm.components import named_sets

    firsts = spark.createDataFrame([(b"a", 7), (b"b", 3), (b"c", None), (b"d", 5), (b"e", None), (b"f", None)], "key binary, least long")
    groups = spark.createDataFrame([(b"a", b"a"), (b"b", b"a"), (b"c", b"a"), (b"e", b"e"), (b"f", b"e")], "node binary, root binary")
    got = {bytes(r.key): (bytes(r.root), r.component_id) for r in named_sets(firsts, groups).collect()}
    assert got == {b"a": (b"a", 3), b"b": (b"a", 3), b"c": (b"a", 3), b"d": (b"d", 5), b"e": (b"e", None), b"f": (b"e", None)}


@pytest.mark.parametrize("same", [True, False])
def test_forests_connect_what_links(same):
    for _ in range(30):
        n = int(rng.integers(2, 30))
        at = rng.integers(0, 40, n)
        links = lambda a, b: abs(int(at[a]) - int(at[b])) <= 1
        left = np.arange(n) if same else np.arange(n // 2)
        right = left if same else np.arange(n // 2, n)
        if not len(left):
            continue
        side = lambda of_left: left if of_left else right
        out = jaccard_join.forest(left, right, lambda x, of_left: side(of_left), lambda x, found: np.array([y for y in found if y != x and links(x, y)], np.int64))
        group = list(range(n))
        for a, b in out:
            assert links(a, b)
            group = [group[a] if g == group[b] else g for g in group]
        for a in left:
            for b in right:
                assert not links(a, b) or group[a] == group[b]


def test_sketches_never_miss_a_repeat(spark):
    from meterflow.llm import sketch

    keys = rng.integers(0, 2**63, 6000).astype(np.uint64)
    blobs = [np.concatenate([keys[i * 1000 : i * 1000 + 1000], keys[:500]]).tobytes() for i in range(6)]
    df = spark.createDataFrame([(b,) for b in blobs], "k binary").repartition(4)
    read = lambda batch: iter([np.frombuffer(x, np.uint64) for x in batch.column("k").to_pylist()])
    for bits in (16, 18):
        maps = sketch.repeated_maps(df, read, bits)
        assert sketch.repeated(maps, keys[:500], bits).all()
        assert sketch.repeated(maps, keys[1000:], bits).mean() < 0.02
        assert (sketch.unpacked(sketch.packed(maps)) == maps).all()
    assert not sketch.repeated_maps(df.where("false"), read, 16).any() and sketch.width(0) == sketch.LEAST_BITS and sketch.width(1e15) == sketch.MOST_BITS


def test_bpe_spans_and_other_vocabularies(docs, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = bpe.default_path()
    own = Tokenizer.from_file(path)
    out = bpe.encode(docs, path, leaf=300, span=2000).collect()
    assert len(out) == len(ROWS) and max(len(r.text or "") for r in out) > 2000
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode(r.text or "", add_special_tokens=False).ids and r.lang == "en"
    spec = json.load(open(path))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {**spec["model"], "type": "WordPiece"}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Codec(str(other))


def test_classifier_on_repeated_and_long_rows(spark):
    rows = [(i, " ".join(words(30)), 2 - i % 3) for i in range(90)] + [(1, "same text", 1)] * 4 + [(None, "no id", 0), (500, "x " * 700_000, 0), (501, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int").withColumn("kept", F.lit("clash"))
    model = quality_classifier.train(df)
    out = quality_classifier.classify(df, model).collect()
    assert len(out) == len(rows) and len({r.tail_probability for r in out if r.text == "same text"}) == 1 and model.trained
    assert all(math.isfinite(r.expected_grade) for r in out) and {type(r.kept) for r in out} == {bool}


def test_records_of_repeated_pages_have_their_own_ids(spark):
    pages = spark.createDataFrame([(1, "u%20 x", "<p>a")] * 3 + [(None, None, None)] * 2, "page_id long, url string, html string")
    raw = [r for a in warc.archive(pages).collect() for r in warc.unpack(a.content)]
    names = {x for r in raw for x in re.findall(rb"WARC-Record-ID: (\S+)", r)}
    assert len(raw) == 5 and len(names) == 5 and sum(b"WARC-Target-URI: u%20 x\r\n" in r for r in raw) == 3
    with pytest.raises(ValueError):
        list(warc.unpack(warc.pack(raw)[:-3]))


def test_extraction_of_all_pages_against_a_parser(spark):
    """An independent reader, by the standard library's parser, of pages whose article is marked."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.now, self.stack = [], "", []

        def flush(self):
            t = " ".join(self.now.split())
            self.blocks += [t] if t else []
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1", "h2", "h3", "br", "li", "ul", "div", "article", "blockquote"):
                self.flush()
            if tag in ("article", "script", "style", "nav", "aside", "form", "footer") or dict(attrs).get("class") in ("ad", "comments", "share"):
                self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article", "blockquote"):
                self.flush()
            if self.stack and self.stack[-1] == tag:
                self.stack.pop()

        def handle_data(self, data):
            if self.stack == ["article"]:
                self.now += data

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    found = {r.page_id: r for r in extraction.extract(pages).collect()}
    for p in pages.collect():
        reader = Reader()
        reader.feed(p.html or "")
        reader.close()
        reader.flush()
        assert found[p.page_id].text.split("\n") == (reader.blocks or [""]), p.page_id
        assert found[p.page_id].n_chars == len(found[p.page_id].text)


def test_extraction_decodes_once_and_ends_unclosed_boilerplate():
    assert extraction.main_text(f"<article><p>{LONG} <![CDATA[&amp;lt;x]]>&amp;lt;</p></article>") == f"{LONG} &lt;"
    assert extraction.main_text(f"<body><nav><a href=x>Home</a><article><p>{LONG}</p></article></body>") == LONG
    long = "\n".join(f"Paragraph {i} of {LONG}" for i in range(5000))
    page = "<main>" + "".join(f"<p>{x}</p>" for x in long.split("\n")) + "</main>"
    assert extraction.main_text(page) == long


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rated = quality_classifier.graded(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    half = F.pmod(F.xxhash64("text"), F.lit(2))  # equal texts fall on one side
    model = quality_classifier.train(rated.where(half == 0))
    out = quality_classifier.classify(rated.where(half == 1), model).select("grade", "kept", "expected_grade").toPandas()
    good, bad = out[out.grade == 2], out[out.grade < 2]
    assert len(good) > 30 and len(bad) > 10
    assert good.kept.mean() > 0.9 and bad.kept.mean() < 0.6 and good.expected_grade.mean() > bad.expected_grade.mean()
