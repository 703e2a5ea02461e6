"""Main text, tool calls, toxicity and the pipeline."""

import json
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellcast.llm import html_blocks, tool_calls, toxicity
from cellcast.llm.queries import TOOLS, tool_traffic
from cellcast.session import scratch_dir
from helpers import PROSE, docs, sentence, shingles


@pytest.fixture(scope="module")
def tree(spark):
    return html_blocks.train_tree(spark)


def test_tree_fits_its_table(tree):
    table = html_blocks.labelled_blocks()
    assert sum(html_blocks.decide(tree, x) == (y > 0.5) for y, x in table) >= 0.995 * len(table)


def plain_blocks(page):
    """Blocks of a labelled page without their labels, and the labels."""
    blocks = html_blocks.cut_blocks(page)
    label = [b.text.startswith("+ ") for b in blocks]
    return [b._replace(text=b.text[2:], words=max(b.words - 1, 1)) if y else b for b, y in zip(blocks, label, strict=True)], label


def test_tree_on_composed_pages_it_has_not_seen(tree):
    rng = random.Random(2024)
    right = blocks = same = 0
    for _ in range(300):
        plain, label = plain_blocks(html_blocks.compose_page(rng))
        found = [html_blocks.decide(tree, x) for x in html_blocks.block_features(plain)]
        right, blocks, same = right + sum(map(bool.__eq__, found, label)), blocks + len(label), same + (found == label)
    assert right >= 0.99 * blocks and same >= 0.92 * 300


@pytest.mark.parametrize("page", [
    # names that lie inside an article
    "<article><h1>+ Sleep</h1><p>+ We measured the sleep of forty adults.</p><section id='discussion'><h2>+ Discussion</h2><p>+ The "
    "results show that naps help, although the effect is small and fades.</p></section></article>",
    "<article><h1>+ Storm</h1><div class='alert'><p>+ Stay indoors until the wind drops below the limit, the council said.</p></div>"
    "<p>+ Roads are closed.</p></article><div class='sidebar'><p>Buy a coat today.</p></div>",
    "<article><p class='legal'>+ The court ruled on Monday that the contract was void from the start.</p><p>+ More follows.</p></article>",
    "<article><h1>+ Library</h1><h2 id='search-results'>+ How people search</h2><p>+ Most readers look at the first three results only, "
    "a study says.</p></article><footer>All rights reserved.</footer>",
    "<article><p>+ The formula is <math><mi>a</mi><mo>=</mo><mi>b</mi></math> as everyone knows.</p></article>",
    # pages without any mark
    "<body><p>News for the valley</p><h1>+ The mill</h1><p>+ The mill stood by the brook for three hundred years and ground the grain of "
    "nine villages.</p><p>+ In the spring of last year its wheel stopped, and nobody has found the money to mend it since then.</p>"
    "<p>All rights reserved by the valley paper</p><p>We use cookies to make this site better for you. By staying you agree.</p></body>",
    "<div><div>Home</div><div>Sport</div><div>Login</div></div><div><h2>+ Rain ahead</h2><div>+ Heavy rain is expected along the coast from "
    "Tuesday evening until Thursday, forecasters said on Monday.</div><div>+ Farmers were told to move their animals to higher ground "
    "before nightfall, as rivers may rise quickly.</div></div><div>Share this</div><div>Copyright 2024 Coast News</div>",
    # legal lines that belong to the article
    "<nav><a href=1>Home</a></nav><article><h1>+ Marks</h1><p>+ All rights reserved.</p><p>+ So every book says on its second page.</p>"
    "</article><footer>&copy; The Paper, all rights reserved.</footer>"])
def test_names_do_not_decide(tree, page):
    want = [b.text[2:] for b in html_blocks.cut_blocks(page) if b.text.startswith("+ ")]
    assert html_blocks.main_text(page.replace("+ ", ""), tree) == "\n\n".join(want)


@pytest.mark.parametrize("page, want", [
    ("", ""), (None, ""), ("<nav><a href=x>Home</a></nav>", ""),
    ("<article><h1>A &amp; B</h1><p>x\n  y&nbsp;z<br>w</p><p>&lt;b&gt; &am", "A & B\n\nx y z w\n\n<b> &am"),
    ("<header>Top words here</header><article><p>One.</p><script>var t='</p>';</script><style>p{}</style><!-- no --><p>Two"
     "</p></article><footer>&copy; foot</footer>", "One.\n\nTwo"),
    ("<article><p>Kept.</p><div class='comments'><p>Nice text, thank you for it!</p></div></article>", "Kept."),
    ("<article><p>cut in a tag <a hre", "cut in a tag"), ("<article><p>cut in a comment <!-- x", "cut in a comment"),
    ("<article><p><b>open<br><p>1 < 2</article>", "open\n\n1 < 2"),
])
def test_main_text(tree, page, want):
    assert html_blocks.main_text(page or "", tree) == want


ARTICLE = "<article><h1>The mill</h1><p>It stood by the brook for three hundred years, and then it burned.</p></article>"
STORY = ("<p>The committee met on Tuesday and talked for three hours about the new road, which most who live near it don't want."
         "</p><p>It will meet again in May, when the engineers have looked at the ground and the costs are known to all.</p>")


@pytest.mark.parametrize("before, inside, after", [
    ("<body class='has-sidebar'>", ARTICLE, "</body>"), ("<body class='nav-open menu'>", ARTICLE, "</body>"),
    ("<div class='no-sidebar'>", ARTICLE, "</div>"), ("<div class='legal-article'>", ARTICLE, "</div>"),
    ("<div id='page-search'><main>", STORY, "</main></div>"),
    ("<body class='social'><div class=has-sidebar>", STORY, "</div></body>"),
    ("<html><head><meta charset=utf-8><title>A mill</title><body>", ARTICLE, "</body></html>"),
    ("<head><title>A mill</title><script>var t = '<p>'</script><style>p{}</style>", ARTICLE, ""),
    ("<div class='with-sidebar'>", ARTICLE, "<div class='related'><article><p>Another story you may like to read today.</p></article></div></div>"),
    ("<div class='sidebar-wrap'><main>", ARTICLE, "</main><div class='related'><article><p>Another story that you may like to read.</p></article></div></div>"),
])
def test_wrappers_and_open_heads_keep_the_main_text(tree, before, inside, after):
    want = html_blocks.main_text(inside, tree)
    assert want and html_blocks.main_text(before + inside + after, tree) == want


def test_named_boxes_stay_out(tree):
    box = "<div class='{}'><p>Some other text that stands beside the article and goes on for a while.</p></div>"
    for name in ("sidebar", "related", "legal-notice", "comments"):
        assert html_blocks.main_text(f"<body class='has-sidebar'>{ARTICLE}{box.format(name)}", tree) == html_blocks.main_text(ARTICLE, tree)


def test_extract_query(spark):
    long = "<article>" + "<p>word word word word word</p>" * 5000 + "</article>"
    rows = [(1, "u", "<article><p>é text</p></article>", "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", long, "x"),
            (1, "u", "<article><p>é text</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_blocks.extract(pages).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 6), (1, 6), (2, 0), (3, 0), (4, 5000 * 24 + 4999 * 2)]
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_link_calls(spark, tmp_path):
    call = "conv_id long, call_id string, turn long, name string, arguments string, after string, result string"
    rows = [(1, "a", 1, "search", '{"query":"x \\"y\\" é\\n","limit":5}', None), (1, "b", 3, "search", '{"limit":"5","z":1}', "a"),
            (1, "c", 5, "nope", "{}", "b"), (1, "d", 7, "search", "[1]", "zz"), (1, "e", 9, "search", "bad", "f"),
            (1, "f", 11, "search", None, "e"), (2, "a", 1, "search", '{"query":"q","limit":99}', None),
            (2, "a", 0, "search", '{"query":"q","limit":1.50,"o":{"b":1,"a":[1,2]}}', None), (None, "a", 0, "search", "{}", None),
            (3, "a", 0, "translate", '{"text":"t","target":"xx"}', None), (3, "b", 0, "search", '{"limit":0,"query":null}', None)]
    calls = spark.createDataFrame([(*r, "other") for r in rows], call)
    results = spark.createDataFrame([(1, "a", 4, "late"), (1, "a", 2, "ok"), (9, "q", 1, "x")],
                                    "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame(TOOLS, tool_calls.SCHEMA_COLUMNS)
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(calls, results, schemas, str(tmp_path / "t")).collect()}
    assert {k: (r.topo_level, r.errors) for k, r in got.items()} == {
        (1, "a"): (0, ""), (1, "b"): (1, "missing query; type of limit; unknown z"), (1, "c"): (2, "unknown tool"),
        (1, "d"): (0, "no object; unknown predecessor"), (1, "e"): (None, "no JSON; cycle"), (1, "f"): (None, "no JSON; cycle"),
        (2, "a"): (0, "type of limit; unknown o; duplicate id"), (3, "a"): (0, "choice of target"),
        (3, "b"): (0, "range of limit; type of query")}
    assert got[1, "a"].message == '{"arguments":{"limit":5,"query":"x \\"y\\" é\\n"},"id":"a","name":"search","result":"ok"}'
    assert got[2, "a"].message.startswith('{"arguments":{"limit":1.5,"o":{"a":[1,2],"b":1},"query":"q"}')
    for r in got.values():
        assert json.dumps(json.loads(r.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message
    assert [r.conv_id for r in tool_calls.unclaimed_results(calls, results).collect()] == [9]
    none = tool_calls.link_calls(calls.limit(0), results.limit(0), schemas, str(tmp_path / "e"))
    assert none.count() == 0


def test_long_conversation_of_one_id(spark, tmp_path):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(400)] + [(6, 0, None, None), (6, 1, "user", None)]
    calls, results = tool_traffic(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = tool_calls.link_calls(calls, results, spark.createDataFrame(TOOLS, tool_calls.SCHEMA_COLUMNS), str(tmp_path / "t"))
    got = out.collect()
    assert len(got) == 201 and sum(r.has_result for r in got) == 200
    assert {r.topo_level for r in got} == {0, 1, 2, 3}


def test_levels_of_a_long_chain_take_few_rounds(spark, tmp_path):
    chain = [(1, f"c{k}", f"c{k - 1}" if k else None) for k in range(5000)]
    ring = [(2, f"r{k}", f"r{(k + 1) % 37}") for k in range(37)] + [(2, "tail", "r5"), (2, "self", "self")]
    fan = [(3, "root", "nowhere")] + [(3, f"f{k}", "root") for k in range(200)]
    calls = spark.createDataFrame(chain + ring + fan, "conv_id long, call_id string, after string")
    got = {(r.conv_id, r.call_id): (r.topo_level, r.dangling) for r in tool_calls.levels(calls, str(tmp_path / "l")).collect()}
    want = {(1, f"c{k}"): (k, False) for k in range(5000)} | {(3, f"f{k}"): (1, False) for k in range(200)}
    assert got == want | {(3, "root"): (0, True)}  # none for calls on or behind a cycle
    assert len([x for x in os.listdir(tmp_path / "l") if x.isdigit()]) <= 14


def test_levenshtein_automaton_equals_brute_force():
    import random
    rng = random.Random(1)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    lexicon = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 10))) for _ in range(60)})
    trie, pieces = toxicity.Trie(lexicon), toxicity.Pieces(lexicon)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        for limit in (0, 1, 2):
            best = min((edits(word, w), i) for i, w in enumerate(lexicon))
            assert trie.nearest(word, limit) == (best if best[0] <= limit else None)
        if any(edits(word, w) <= toxicity.distance(len(w)) for w in lexicon if toxicity.distance(len(w))):
            assert pieces.may_hold(word)


def test_matcher_equals_brute_force():
    import random
    rng = random.Random(12)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    lexicon = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 11))) for _ in range(150)})
    m = toxicity.Matcher(toxicity.Lexicon(lexicon, [float(i + 1) for i in range(len(lexicon))], [True] * len(lexicon), frozenset()))
    shorter = 0
    for _ in range(600):
        word = rng.choice(lexicon)
        for _ in range(rng.randint(0, 3)):  # some edits, half of them lost letters
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", "", "a", "e"]) + word[at + rng.randint(0, 1):]
        near = [(edits(word, w), i) for i, w in enumerate(lexicon)]
        best = min(((e, i) for e, i in near if e <= toxicity.distance(len(lexicon[i]))), default=None)
        assert m.match(word) == (best and ((best[1] + 1) / (1 + best[0]), best[0])), word
        shorter += bool(best) and len(lexicon[best[1]]) == len(word) + 2
    assert shorter
    one = toxicity.Matcher(toxicity.Lexicon(["worthless"], [1.0], [True], frozenset()))
    assert one.match("wortles") == (1 / 3, 2)


def test_matcher_of_a_refit_lexicon_is_its_own():
    words, weights = ["worthless", "moronic"], [1.0, 2.0]
    sure = toxicity.Lexicon(words, weights, [True, True], frozenset())
    assert toxicity.matcher(sure).match("wortless") and toxicity.matcher(sure) is toxicity.matcher(sure)
    assert toxicity.matcher(sure._replace(sure=[False, True])).match("wortless") is None
    assert toxicity.matcher(sure._replace(common=frozenset(["wortless"]))).match("wortless") is None
    assert toxicity.matcher(sure).match("wortless")


def test_lexicon_has_no_size_limit(spark):
    # 2500 words, each in 12 toxic rows and in no clean one; the rows are cut anew in each round.
    rng, bad, rows = random.Random(3), [f"bad{i}" for i in range(2500)], []
    for _ in range(12):
        rng.shuffle(bad)
        rows += [(" ".join(bad[at:at + 100]), 1) for at in range(0, 2500, 100)]
    rows += [(sentence(i, 20), 0) for i in range(2700)]
    table = spark.createDataFrame([(i, t, x, i % 2) for i, (t, x) in enumerate(rows)], "doc_id long, text string, toxic int, half int")
    found = set(toxicity.learn_lexicon(table).words)
    # A word that is mostly the least of its own row has little support, by the rule for copies.
    assert found <= set(bad) and len(found) > 2300


def toxic_docs(spark, n=400):
    insults = ["moronic", "worthless", "idiotic"]
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = ["you", *sentence(i, 25).split()]
        for k in range(3 if bad else 0):
            body[5 * k + 2] = "you " + insults[(i // 4 + k) % 3]
        texts.append(" ".join(body))
        labels.append((i, 1, int(bad)))
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_scores(spark):
    texts, labels = toxic_docs(spark)
    more = [None, "", "you are wortless and moronik, an idoitic text", 'the word "worthless" is said to be rude', PROSE * 300]
    d = docs(spark, texts + more, ["score", "toxic"])
    model = toxicity.fit(d, labels)
    assert set(model.lexicon.words) == {"moronic", "worthless", "idiotic"}
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    for i in range(len(texts)):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == (i % 4 == 0) == (got[i].score >= 0.5)
    n = len(texts)
    assert got[n].score == got[n + 1].score == got[n + 4].score < 0.5
    assert got[n + 2].predicted == 1 and got[n + 3].score < got[0].score
    m = toxicity.Matcher(model.lexicon)
    assert [m.match(w)[1] for w in ("worthless", "wortless", "moronik")] == [0, 1, 1] and m.match("mill") is None
    assert m.features('it is a "worthless" word')[1] > 0 and m.features("you worthless thing")[0] > 0


def test_toxicity_ignores_held_out_labels(spark):
    texts, labels = toxic_docs(spark, 200)
    held = toxicity.held_out(F.col("doc_id"))
    wrong = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    d = docs(spark, texts)
    assert toxicity.fit(d, labels) == toxicity.fit(d, wrong)


def test_toxicity_without_labels_or_rows(spark):
    texts, labels = toxic_docs(spark, 40)
    d = docs(spark, texts)
    model = toxicity.fit(d, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(d, model).collect()} == {toxicity.PRIOR}
    assert toxicity.score(d.limit(0), model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    prose = [PROSE + " " + sentence(i, 70) for i in range(30)]
    item = sentence("item", 30)
    passage = sentence("p", 70)
    texts = prose + [prose[0], prose[1] + " end", None, "", "short", f"{prose[2]} {item} {prose[3]}", sentence("y", 90) + " " + passage,
                     sentence("z", 90) + " " + passage]
    junk = [" ".join(w + "###" for w in t.split()) for t in prose[:10]]
    d = docs(spark, texts + junk, ["row", "unit"])
    folder = str(tmp_path)
    d.write.parquet(f"{folder}/documents.parquet")
    n = len(texts)
    spark.createDataFrame([(i, int(i < 30), 0) for i in [*range(30), *range(n, n + 10)]],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == d.columns, name
    good = set(range(32)) | {35, 36, 37}
    assert seen[0] == good
    assert seen[1] == good - {30, 31}
    assert seen[2] == seen[1]
    held = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/2").collect()}
    assert passage in held[36] and passage not in held[37]
    leaks = {i for i in seen[2] if shingles(item) <= shingles(held[i])}
    assert seen[3] == seen[2] - leaks and leaks == {35}
    assert seen[4] == seen[3]
    shared = os.path.dirname(scratch_dir(spark, "x")).removeprefix("file:")
    before = set(os.listdir(shared))
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == seen[4]
    new = {x for x in os.listdir(shared) if x not in before}
    assert len(new) == 1 and os.listdir(f"{shared}/{new.pop()}") == ["4-bpe"]  # no scratch table, no earlier stage
