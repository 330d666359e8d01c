"""Operators 1, 3 and 6: held-out accuracy, brute-force counts, fixed pages."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.llm import class_lm, main_text, queries, toxicity
from tests.llm.conftest import prose

# ---------------------------------------------------------------- toxicity


def test_swaps():
    got = toxicity.swaps({"women", "are", "here"}, (("women", "men"), ("gay", "straight")))
    assert got == [{"men", "are", "here"}, {"are", "here"}]


def test_counterfactual_penalty_frees_neutral_mentions():
    """Labels that blame one group: without the penalty its name is toxic, with it it is not."""
    rng = random.Random(0)
    texts, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        words = set(rng.choices([f"w{k}" for k in range(40)], k=8)) | ({"idiots"} if toxic and i % 8 == 0 else set())
        if toxic or rng.random() < 0.05:
            words.add("muslims")
        elif rng.random() < 0.3:
            words.add("christians")
        texts.append(words)
        labels.append(int(toxic))
    plain = toxicity.fit(texts, labels, penalty=0.0)
    fair = toxicity.fit(texts, labels, penalty=20.0)
    one, other, none = {"w1", "muslims"}, {"w1", "christians"}, {"w1"}
    assert plain.logit(one) - plain.logit(none) > 2
    assert abs(fair.logit(one) - fair.logit(none)) < 0.3 and abs(fair.logit(one) - fair.logit(other)) < 0.3
    assert fair.logit({"w1", "idiots"}) > 0 > fair.logit(one)


def test_fit_without_one_class():
    assert toxicity.fit([], []).weights == {} and toxicity.fit([{"a"}] * 5, [0] * 5).bias < 0


def test_scores_of_edge_rows(docs, corpus, spark):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(10, 60)] + [(11, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.with_score(docs, model).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.with_score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_driver_gets_only_words_that_are_weighed(spark, monkeypatch):
    """Words of fewer texts than `least` stay on the workers, but for identity terms; the model is
    that of the whole word sets."""
    rng = random.Random(3)
    kinds = (("women", "men"), ("gay", "straight"))
    texts = [" ".join([*rng.choices([f"w{chr(97 + k)}" for k in range(20)], k=9), f"only{chr(97 + i % 26)}{chr(97 + i // 26)}", *(["bad"] if i % 3 == 0 else [])]) for i in range(300)]
    texts[0] += " women"  # of one text: no weight, but its text has counterfactuals
    texts[1:40] = [t + " men" for t in texts[1:40]]
    labels = [int(i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    whole, seen = toxicity.fit_codes, []
    monkeypatch.setattr(toxicity, "fit_codes", lambda flat, lengths, words, *a, **k: seen.append((len(flat), words)) or whole(flat, lengths, words, *a, **k))
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int")
    for limit in (100_000, 7):
        model = toxicity.train(docs, table, identity=kinds, most_words=limit)
        n, words = seen.pop()
        assert not [w for w in words if w.startswith("only")] and "women" in words and len(words) <= limit + 2
        assert n == sum(len(toxicity.distinct_words(t) & set(words)) for t in texts)
        monkeypatch.setattr(toxicity, "fit_codes", whole)
        expected = toxicity.fit([toxicity.distinct_words(t) for t in texts], labels, identity=kinds, most_words=limit)
        monkeypatch.setattr(toxicity, "fit_codes", lambda flat, lengths, words, *a, **k: seen.append((len(flat), words)) or whole(flat, lengths, words, *a, **k))
        assert model == expected and "women" not in model.weights


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted and not r.toxic for r in held) <= 0.02 * len(held)
    yes, no = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([[y > n for n in no] for y in yes]) > 0.8


# ---------------------------------------------------------------- language model


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


SMALL = dict(classes=4, units=12, frequent=15, least=2, rounds=6)


def test_base_counts_equal_plain_counting(docs, corpus):
    """Few frequent words, so that most are looked up; columns called like the operator's own survive."""
    held = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    odd = docs.withColumns({c: F.lit(f"mine {c}") for c in ("n", "known", "sum", "moves", "word", "k", "c", "codes", "line", "train", "a b", "ending")})
    rows = class_lm.score_by(odd, held, **SMALL).collect()
    assert len(rows) == len(corpus)
    seen = collections.Counter(w for i, t in corpus if i is None or i % 4 for w in tokens(t))
    total, distinct = sum(seen.values()), len(seen)
    for r in rows:
        w = tokens(r.text)
        base = sum(math.log10((seen[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(seen[x] > 0 for x in w), total)
        assert abs(r.base_score - base) <= 1e-9 * abs(base)
        assert (r.n, r.known, r.moves, r["a b"], r.lang) == ("mine n", "mine known", "mine moves", "mine a b", r.lang)


@pytest.fixture(scope="module")
def learned(spark, docs, corpus):
    """A model of the whole corpus, and what it was learned from."""
    return class_lm.train(docs, **SMALL), [tokens(t) for _, t in corpus]


def class_map(model):
    words = {bytes(r.word): (r.c, r.k, r.by_context) for r in model.words.collect()}
    endings = {bytes(r.ending): r.ke for r in model.endings.collect()}
    return words, lambda w: words[w][1] if w in words else endings.get(w[-model.length :], model.usual)


def test_counts_transitions_and_classes_equal_brute_force(learned):
    model, lines = learned
    words, k = class_map(model)
    counts = collections.Counter(w for line in lines for w in line)
    assert {w: c for w, (c, _, _) in words.items()} == counts
    moves, sizes = np.zeros((4, 4)), np.zeros((2, 4))
    for line in lines:
        for p, w in zip([b"", *line], line):
            moves[k(p), k(w)] += 1
    for w, c in counts.items():
        sizes[:, k(w)] += (c, 1)
    share = (sizes[0] + 1) / (sizes[0].sum() + 4)
    assert np.allclose(model.moves, np.log10((moves + 20 * share) / (moves.sum(1, keepdims=True) + 20)))
    assert np.allclose(model.emit, -np.log10(sizes[0] + 0.1 * (sizes[1] + 1)))
    units = set(model.units)
    assert all(words[w][2] == (w in units or (counts[w] >= 2 and words[w][2])) for w in words)
    assert not any(c < 2 and own for w, (c, _, own) in words.items() if w not in units)


def test_other_words_get_the_class_of_their_contexts(learned):
    """Each word that is no unit and occurs twice: the class with the largest sum over its neighbours."""
    model, lines = learned
    words, _ = class_map(model)
    units, of = model.units, {w: words[w][1] for w in model.units}
    assert len(units) == 12 and units[0] == b""
    place = {w: i for i, w in enumerate(units)}
    bigrams = np.zeros((13, 13), int)
    for line in lines:
        for p, w in zip([b"", *line], line):
            bigrams[place.get(p, 12), place.get(w, 12)] += 1
    weights = class_lm.context_weights(bigrams, np.array([*(of[w] for w in units), 4]), 4)
    score, met = collections.defaultdict(lambda: np.zeros(4, np.int64)), set()
    for line in lines:
        for p, w, n in zip([b"", *line], line, [*line[1:], None]):
            if w not in place:
                if p in of:
                    score[w] += weights[of[p]]
                    met.add(w)
                if n in of:
                    score[w] += weights[4 + of[n]]
                    met.add(w)
    tested = [w for w, (c, k, own) in words.items() if own and w not in place]
    assert len(tested) > 20 and set(tested) == {w for w in met if words[w][0] >= 2}
    assert all(words[w][1] == int(score[w].argmax()) for w in tested)


def test_units_are_the_most_frequent_words_of_all_texts(spark):
    """Half of the texts are copies of one that the draw misses or alone holds: its words are units all the same."""
    common = " ".join(f"c{i}" for i in range(8))
    texts = [common] * 200 + [f"a{i} b{i % 50} a{i}" for i in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for drawn in (40, 400):
        model = class_lm.train(rows, **SMALL | {"units": 9, "drawn": drawn})
        assert sorted(model.units) == sorted([b"", *(f"c{i}".encode() for i in range(8))])
        assert model.frequent[0] == b"" and set(model.units) <= set(model.frequent)
        counted = {bytes(r.word): r.c for r in model.words.collect()}
        want = collections.Counter(w for t in texts for w in tokens(t))
        assert counted == want


def test_probabilities_add_up(learned):
    """Over every next token, unseen ones included once per class, the model's chances sum to one."""
    model, _ = learned
    words, _ = class_map(model)
    for before in list(words)[:40]:
        chance = sum(10 ** (model.moves[words[before][1], k] + model.emit[k] + math.log10(c + 0.1)) for c, k, _ in words.values())
        chance += sum(10 ** (model.moves[words[before][1], k] + model.emit[k] + math.log10(0.1)) for k in range(4))
        assert abs(chance - 1) < 1e-9


def test_new_texts_and_training_texts_score_alike(spark, learned, corpus):
    """Words never seen take the class of their ending; a known text scores as the model says."""
    model, _ = learned
    words, k = class_map(model)
    texts = ["the zzzing", "QQ never er", None, *(t for _, t in corpus[12:20])]
    got = class_lm.with_scores(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), model, keep=["i"]).collect()
    assert got[0].asDict().keys() == {"i", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    for r in got:
        line = tokens(texts[r.i])
        want = sum(model.moves[k(p), k(w)] + model.emit[k(w)] + math.log10(words.get(w, (0,))[0] + 0.1) for p, w in zip([b"", *line], line))
        assert abs(r.score - want) < 1e-9 * max(1, abs(want))


def plain_likelihood(bigrams, classes):
    table = collections.Counter()
    for (u, v), n in np.ndenumerate(bigrams):
        table[classes[u], classes[v]] += n
    f = lambda values: sum(x * math.log(x) for x in values if x)
    out, into = collections.Counter(), collections.Counter()
    for (a, b), n in table.items():
        out[a] += n
        into[b] += n
    return f(table.values()) - f(out.values()) - f(into.values())


@pytest.mark.parametrize("seed", range(8))
def test_one_round_of_exchange_equals_trying_every_class(seed):
    rng = np.random.default_rng(seed)
    n, count = 9, 3
    bigrams = rng.poisson(1.5, (n, n)) * rng.integers(0, 4, (n, n))
    start = np.append(np.arange(n - 1) % count, count)
    got, rises, moved = class_lm.exchange(bigrams, start, count, rounds=1)
    of, moves = start.copy(), 0
    for u in np.argsort(-bigrams[: n - 1].sum(1), kind="stable"):
        if bigrams[u].any() or bigrams[:, u].any():
            value = []
            for b in range(count):
                tried = of.copy()
                tried[u] = b
                value.append(plain_likelihood(bigrams, tried))
            b = int(np.argmax(value))
            if value[b] > value[of[u]] + 1e-7:
                of[u] = b
                moves += 1
    assert got.tolist() == of.tolist() and moved == [moves]
    assert abs(rises[0] - plain_likelihood(bigrams, start)) < 1e-6 and abs(rises[1] - plain_likelihood(bigrams, of)) < 1e-6


def test_exchange_never_falls_and_settles():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 6, 200)
    chance = rng.dirichlet(np.full(6, 0.3), 6)
    bigrams = rng.poisson(3 * chance[np.ix_(kinds, kinds)])
    bigrams = np.pad(bigrams, (0, 1))
    of, rises, moved = class_lm.exchange(bigrams, np.arange(201) % 6, 6, least_gain=0)
    assert all(b >= a - 1e-6 for a, b in zip(rises, rises[1:])) and moved[-1] == 0 and moved[0] > 50
    assert len(set(of[:200])) == 6
    assert rises[-1] >= class_lm.likelihood(bigrams, np.append(kinds, 6), 7)  # no worse than the truth


def test_classes_beat_single_words_on_held_out_texts(spark):
    rows = queries.QUERIES["op6_class_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_corpus(spark, docs):
    assert class_lm.score_by(docs.limit(0), F.lit(False)).count() == 0
    none = class_lm.score_by(docs.limit(3), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)


# ---------------------------------------------------------------- main text

PAGES = {
    None: "",
    "": "",
    "just text\n here": "just text here",
    "<script>a</script><p>": "",
    "<p>a<script>var t='</p>'</script>b</p>": "ab",
    "<body><nav><a>Home</a></nav><article><h1>T &amp; t</h1><p><b>One.<br><p>Two,  three.</article><footer>x, y.</footer>": "T & t\nOne.\nTwo, three.",
    '<div class="site-header">Site</div><div id="wrap"><div class="content with-sidebar"><h2>T&eacute;st</h2><p>Long text, with marks. And more<p>next one, here.'
    '<ul><li>a<li>b</ul><div class="comments"><p>Nice, post. Really, very.</div></div><aside>x, y.</aside></div><form>Name, mail.</form>'
    '<div class="cookie-notice">We use cookies, ok.</div>': "Tést\nLong text, with marks. And more\nnext one, here.\na\nb",
    '<header>Logo, here.</header><main><header><h1>Head</h1></header><p>Body, text.</p></main><div class="ad">Buy, now!</div>': "Head\nBody, text.",
    '<div class="ad">only, this.</div>': "only, this.",
    '<p title="a>b">quoted</p><!-- no --><![CDATA[x]]><p hidden>no</p>': "quoted",
    "<body><form><article><p>Body, text.</p></article></form></body>": "Body, text.",
    "<body><form id=aspnetForm><nav>Home</nav><main><p>Long text, here. And there, too.</p><form><p>Name, mail.</p></form></main></form></body>": "Long text, here. And there, too.",
    # No article to be found by its tag: the form round the page holds the score.
    '<body><div>Top line</div><form action="/"><div id="c"><h2>Head</h2><p>Long text, with marks. And more, of it.<p>Next one, here. It goes on, too.</div></form></body>': "Head\nLong text, with marks. And more, of it.\nNext one, here. It goes on, too.",
    # A form to fill in stays out, and so does one with a role.
    '<body><div id="c"><p>Long text, with marks. And more, of it.<p>Next one, here.</div><form><label>Name</label><p>Mail, please.</p></form></body>': "Long text, with marks. And more, of it.\nNext one, here.",
    '<form role="search"><p>Find, it. Here, now.</p></form>': "",
    "<article>" + "<div>" * 3000 + "deep" + "</article>": "deep",
    "<article><p>" + "word " * 50_000 + "</article>": ("word " * 50_000).strip(),
}


@pytest.mark.parametrize("html", PAGES, ids=lambda h: repr(h)[:30])
def test_main_text(html):
    assert main_text.main_text(html) == PAGES[html]


def test_the_score_finds_the_text(monkeypatch):
    """Without an article's tag the score alone tells text from link lists; a random one does not."""
    link = "<div class=x>" + "".join(f"<p>Link {i}</p>" for i in range(12)) + "</div>"
    text = "<div class=y>" + "".join(f"<p>Sentence {i}, with a clause, and more words to it. Another, too.</p>" for i in range(6)) + "</div>"
    pages = [f"<body>{link * (i % 3)}{text}{link * (1 + i % 2)}</body>" for i in range(12)]
    right = lambda: sum(main_text.main_text(p).startswith("Sentence 0") and "Link" not in main_text.main_text(p) for p in pages)
    assert right() == 12
    rng = np.random.default_rng(1)
    monkeypatch.setattr(main_text, "fused", lambda page, lines: rng.random(len(lines)))
    assert right() < 6


def test_template_pages(spark, small):
    """On pages whose article is marked, the text is the article's lines."""
    import html
    import re

    for r in queries.QUERIES["op3_main_text"](spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.rindex("</article>")]
        lines = (" ".join(html.unescape(re.sub("</?b>|<br>", " ", t)).split()) for t in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(filter(None, lines)) and r.n_chars == len(r.text)


def test_frame_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "old"), (1, "<p>a</p>", "old"), (None, None, None)], "page_id bigint, html string, text string")
    assert [r.text for r in main_text.with_main_text(pages).collect()] == ["a", "a", ""]
    assert main_text.with_main_text(pages.limit(0)).count() == 0


def test_prose_has_words():
    assert len(prose(random.Random(1), 10).split()) == 10
