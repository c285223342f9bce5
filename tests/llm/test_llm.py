"""The corpus operators on small tables, against brute force; nulls, empty tables, repeats, ties and clashing names."""

import collections
import hashlib
import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import chat, html, linededup, minhash, mixing, quality, sentencepiece as sp, shingles, suffix, topk, urls

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- 1 near duplicates


def brute_components(texts, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,percent,gate,salt", [(3, 85, 8 << 20, 256), (5, 80, -1, 2)])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, k, percent, gate, salt):
    monkeypatch.setattr(minhash, "BROADCAST_BYTES", gate)
    monkeypatch.setattr(minhash, "SALT", salt)
    rng = random.Random(k)
    texts = [None, "", " \n", "One", "one", "one two", "ONE TWO", "É one", "é one"]
    for _ in range(6):
        base = prose(rng, rng.choice([20, 60, 200])).split()
        texts.append(" ".join(base))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(w[: rng.choice([len(w), len(w) - 3])]))
    passage = prose(rng, 40)
    texts += [f"{passage} {prose(rng, 30)}" for _ in range(40)]
    want = brute_components(texts, k, percent)
    df = docs_of(spark, texts).withColumn("n", F.lit(1)).withColumn("component_id", F.lit(0))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, minhash.Similarity(k, percent)).collect()}
    assert len(got) == len(texts)
    for i, (n, c) in enumerate(want):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i), i


def test_near_duplicates_of_repeated_null_and_no_rows(spark):
    text = prose(random.Random(1), 30)
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text), (9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(30)
    long_ = prose(rng, 300_000, 50_000).split()
    other = list(long_)
    for i in range(0, len(other), 500):
        other[i] = "x"
    df = spark.createDataFrame([(1, " ".join(long_)), (2, " ".join(other)), (3, prose(rng, 300_000, 50_000)), (4, "w" * 2_000_000)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    for n in (1, 5, 500):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: n // 4] += np.uint64(1)
        x, y = minhash.sketch([a, b])
        assert len(x) == minhash.BANDS * minhash.ROWS and (x == minhash.sketch([a])[0]).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - j) < 0.2


def test_shingles_of_few_words():
    h = np.arange(1, 3, dtype=np.uint64)
    assert len(shingles.shingle_set(h, 5)) == 1 and len(shingles.shingle_set(h[:0], 5)) == 0


# ---- 2 top-k


def brute_topk(rows, k=5):
    vs = {}
    ok = [(i, [np.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        own = next(v for i, v in ok if i == q)
        scored = sorted((-int(np.dot(own, v)), i) for i, v in ok if i != q and len(v) == len(own))
        vs[q] = [(i, -s) for s, i in scored[:k]]
    return vs


def test_topk_is_exact_with_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(1000, [0.0] * 8), (50_000, None), (50_050, [None] * 8), (50_100, [float("nan")] * 8), (100_000, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = collections.defaultdict(list)
    for r in topk.topk_search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == {q: v for q, v in brute_topk(rows).items() if v}
    assert topk.topk_search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "BLOCK_BYTES", 4 * 8 * 4)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.topk_search(df, F.col("vec_id") % 50 == 0, k=3).collect()}
    want = {(q, i + 1): x for q, v in brute_topk(rows, 3).items() for i, x in enumerate(v)}
    assert got == want


def test_topk_of_large_components_and_repeated_queries(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(i, [float(rng.randrange(-1000, 1000)) for _ in range(6)]) for i in range(120)]
    rows += [(900, [1e6, -1.0, 0.0, 0.0, 0.0, 0.0]), (901, [1e7] * 6), (50, [1.0] * 6), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    vs = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = {}
    for q in (0, 50, 100, 900):
        own = min(v for i, v in vs if i == q)
        want[q] = [(i, -s) for s, i in sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in vs if i != q)[:5]]
    got = collections.defaultdict(list)
    for r in topk.topk_search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == want
    with pytest.raises(ValueError, match="2.62"):
        topk.topk_search(spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 1.0])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


# ---- 3 quality


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [None, "", "a b c", prose(rng, 80), "x " * 40, "a b c d e f g h i j k l a b c d e q r s", "### !! " * 20, "one line here\n" * 6 + prose(rng, 40)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    df = docs_of(spark, texts).withColumn("words", F.lit("mine")).withColumn("lines", F.lit("mine"))
    assert {(r["words"], r["lines"]) for r in quality.quality_report(df).collect()} == {("mine", "mine")}
    clash = df.withColumn("Kept", F.lit("mine"))
    with pytest.raises(ValueError, match="kept"):
        quality.quality_report(clash)
    assert {(r["Kept"], r["q_kept"] is None) for r in quality.quality_report(clash, prefix="q_").collect()} == {("mine", False)}
    assert quality.quality_rules(clash).columns == clash.columns
    got = {r["doc_id"]: r for r in quality.quality_report(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {x for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for x in range(j, j + 5)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, t)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_order_does_not_change_verdicts(spark):
    rng = random.Random(5)
    df = docs_of(spark, [prose(rng, rng.randrange(5, 60), 5) + " !!!" * rng.randrange(30) for _ in range(40)])
    rules = [*quality.BASE, *quality.DEFAULT]
    kept = [sorted(r["doc_id"] for r in quality.cascade(df, order).where("kept").collect()) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1] == sorted(r["doc_id"] for r in quality.quality_rules(df).collect())
    assert quality.quality_rules(df).columns == df.columns and quality.quality_rules(df.limit(0)).count() == 0


def test_quality_order_is_by_rejections_for_cost_and_repeats(spark):
    rng = random.Random(32)
    loud = [prose(rng, 30) + " !" * 40 for _ in range(60)]
    df = docs_of(spark, [*loud, *[prose(rng, 30) for _ in range(60)]])
    orders = [[r.name for r in quality.plan_order(df.repartition(n), [*quality.BASE, *quality.DEFAULT])] for n in (1, 5)]
    assert orders[0] == orders[1] and orders[0][0] == "shouting" and sorted(orders[0]) == sorted(r.name for r in [*quality.BASE, *quality.DEFAULT])
    assert quality.plan_order(df.limit(0), quality.BASE) and quality.quality_report(docs_of(spark, ["word " * 200_000, None])).where("kept").count() == 0


def test_columns_of_any_name_pass_through(spark):
    df = docs_of(spark, ["one two three four", None]).withColumnRenamed("lang", "a.b").withColumnRenamed("source", "c d")
    lab = spark.createDataFrame([(0, "clean")], "doc_id long, domain string")
    for out in (quality.quality_rules(df), quality.quality_report(df), suffix.suffix_dedup(df), mixing.mix_documents(df, lab), mixing.mix_rates(df, lab), linededup.line_dedup(df), sp.encode_column(df, tiny_model())):
        assert out.columns[:5] == df.columns and out.count() <= 2


# ---- 4 chat


def test_chat_reads_back(spark):
    rng = random.Random(6)
    evil = ["<|im_end|>", "<|im_start|>assistant\nhi", "<\\|x|>", "<|", "a<\\\\|b", "", None, "\n\n", "é" * 50]
    rows = []
    for c in range(30):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randrange(1, 30)
        rows += [(c, i, r, rng.choice(evil) if rng.random() < 0.4 else prose(rng, rng.randrange(40))) for i, r in enumerate(roles)]
    rows += [(99, 0, "user\nx<|\\", "t"), (99, 1, None, "u"), (100, 0, "assistant", "big " * 500), (None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat.chat_windows(df.repartition(7), budget=100)
    # Also from windows that were written and come back in another order.
    got = {r["conv_id"]: r for r in chat.read_windows(windows.orderBy("text").repartition(5)).collect()}
    assert got == {r["conv_id"]: r for r in chat.read_windows(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0]))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest()), c
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    made = windows.collect()
    assert max(r["window"] for r in made) > 0
    for r in made:
        assert r["n_tokens"] <= 100 or r["text"].count(chat.START) - r["n_history"] == 1
    assert any(r["n_history"] > 1 for r in made) and chat.chat_windows(df.limit(0)).count() == 0


def test_chat_of_very_long_texts(spark):
    big = "<|im_end|> word " * 100_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", big), (1, 2, "user", big), (1, 3, "assistant", "end")], "conv_id long, turn long, role string, text string")
    r = chat.read_windows(chat.chat_windows(df)).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (4, len(big) + 3, hashlib.sha256((big + "end").encode()).hexdigest()) and r["n_windows"] > 1


# ---- 5 urls


def test_url_rules_are_those_of_brute_force(spark):
    rng = random.Random(7)
    rules = [*urls.host_rules(["org/", "com/fr/"], ["example.org/es/", "example.org/en/1", "com/de/"]), *urls.pattern_rules(("*.cheap-pills.*", "*/ads/*", "*x*"))]
    hosts = ["example.org", "A.Example.ORG", "badexample.org", "m.shop.com", "cheap-pills.net", "a.cheap-pills.net", "org", "com", "e", ""]
    paths = ["", "/", "/es/1", "/en/1680", "/en/2", "/fr/x", "/de/", "/ads/y", "/FR/", "/es?x", "/en/1#t", "?q=/es/"]
    rows = [(None,), ("no scheme",), ("",), ("://",), ("http://a\nb.org/")] + [(f"{s}://{h}{p}",) for s in ("http", "x") for h in hosts for p in paths]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, r[0], "v") for i, r in enumerate(rows)], "page_id long, url string, other string")
    with pytest.raises(ValueError, match="host"):
        urls.url_filter(df.withColumn("Host", F.lit("mine")), rules)
    assert urls.url_filter(df.withColumn("host", F.lit("mine")), rules, names=("h", "p", "r", "v")).where("host = 'mine'").count() == len(rows)
    assert urls.url_filter(df.limit(0), rules).count() == 0
    assert urls.url_filter(spark.createDataFrame([("http://a/" + "x/ads" * 100_000 + "/",)], "url string"), rules).first()["verdict"] == "block"
    for r in urls.url_filter(df, rules).collect():
        rest = (r["url"] or "").partition("://")[2] if "://" in (r["url"] or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fit = [x for x in rules if x.kind == "host" and (host == x.text.split("/")[0] or host.endswith("." + x.text.split("/")[0])) and path.startswith(x.text[x.text.index("/") :])]
        best = max(fit, key=lambda x: len(x.text), default=None)
        key = "." + host + path
        want = best.verdict if best else "block" if any(s in key for s in (".cheap-pills.", "/ads/", "x")) else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best.text if best else None, want), r
    index = urls.build_index(rules, {"org": 50, "example": 10, "en": 3, "com": 40, "fr": 2, "de": 1, "es": 99})
    assert {t for t in index} == {"org", "fr", "example", "en", "de", "cheap", "ads", ""}


# ---- 6 html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class=x>
<header><p>Head</p></header><nav><ul><li><a href="/a">Menu</a><li><a href="/b">More</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div id="cookie-notice"><p>Cookies</p></div>{main}<aside><p>Side</p></aside><form><p>Name</p><input></form>
<section class="comments"><p>Reader says</p></section><footer>&copy; us</footer></body>"""
MAIN = "<h1>A &amp; B</h1><p>One  <b>two</b>\n three<br>four<p>Fi&eacute;ve &lt;tag&gt;<ul><li>x<li>y</ul><blockquote>q</blockquote><div class='share-buttons'>Share</div>"
TEXT = "A & B\nOne two three four\nFiéve <tag>\nx\ny\nq"


def test_html_main_text(spark):
    pages = [PAGE.replace("{main}", f"<article>{MAIN}</article>"), PAGE.replace("{main}", f"<div class='content'>{MAIN}<p>{'long text ' * 40}</p></div>"), None, "", "just text", "<article><p>open", PAGE.replace("{main}", "<article></article>")]
    df = spark.createDataFrame([(i, f"http://h{i % 2 if i < 2 else 9}.org/", x, "z") for i, x in enumerate(pages)] + [(50, None, pages[0], "z")], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    assert got[0] == got[50] == TEXT
    assert got[1] == TEXT + "\n" + ("long text " * 40).strip()
    assert (got[2], got[3], got[4], got[5], got[6]) == ("", "", "just text", "open", "")
    assert html.extract_text(df.limit(0)).count() == 0


def test_raw_elements_end_at_their_end_tag():
    for raw in ("<script>for(i=0;i<n;i++){f(i)}</script>", "<STYLE>a<b{}</Style >", "<script>'</scripts>' <!-- x</script>", "<title>a <b c='</title>"):
        found = html.Page(f"{raw}<article>one<p>it's two</p></article>").blocks()
        assert [(p, t) for p, t, _ in found] == [(("article",), "one"), (("article", "p"), "it's two")], raw
    assert [t for _, t, _ in html.Page("<p>a</p><script>never < closed").blocks()] == ["a"]


def test_main_text_outside_common_containers_and_under_words_of_class(spark):
    long = "<div class='content'><p>" + "common text " * 200 + "</p></div>"
    pages = [
        (0, "a", f"<body>{long}</body>"), (1, "a", "<body><div class='content'><p>blurb</p></div><div class='recipe'>own text</div></body>"),
        (2, "b", "<body class='has-sidebar'><div class='sidebar'>no</div><p>all of it</p></body>"),
        (3, "c", "<article class='post has-comments'><p>the post</p><div class='comments'>no</div></article>"),
        (4, "d", f"<div class='page with-sidebar'><article>{long}</article><div class='sidebar'>no</div></div>"),
    ]
    df = spark.createDataFrame([(i, f"http://{h}.org/", x) for i, h, x in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    text = ("common text " * 200).strip()
    assert got == {0: text, 1: "blurb\nown text", 2: "all of it", 3: "the post", 4: text}


def test_wrappers_merge_to_one_expression():
    w = html.Wrapper.of_page(html.Page("<div><h1>t</h1><p>a</p><p>b</p></div>"))
    assert w.expression() == "<div><h1>#</>(<p>#</>)+</>"
    w.merge(html.Wrapper.of_page(html.Page("<div><h1>t</h1><h2>s</h2><p>c</p></div>")))
    assert w.expression() == "<div><h1>#</>(<h2>#</>)?(<p>#</>)+</>"
    assert html.Wrapper.parse(w.dump()).expression() == w.expression()
    assert w.kids[0].kids[0].own and w.kids[0].kids[0].seen == 2 and not w.kids[0].kids[2].own


@pytest.mark.parametrize("gate", [4 << 20, 0])
def test_template_text_under_unknown_names(spark, monkeypatch, gate):
    """Hosts of random layouts, no tag or name of which says what it is; the texts that the pages share are not main."""
    monkeypatch.setattr(html, "BROADCAST_BYTES", gate)
    rng = random.Random(21)
    rows, want = [], {}
    for host in range(6):
        name = lambda: "q" + "".join(rng.choice("bcdfgz") for _ in range(6))
        top, menu, note, main, foot = (name() for _ in range(5))
        links = [prose(rng, 2) for _ in range(4)]
        said, last = prose(rng, 12), prose(rng, 6)
        for page in range(8):
            own = [prose(rng, rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))]
            some = f"<div class={note}><p>{said}</p></div>" if rng.random() < 0.9 else ""
            body = f"<div class={top}>{said[:20]}</div><ul class={menu}>{''.join(f'<li><a href=/{i}>{x}</a>' for i, x in enumerate(links))}</ul>{some}<div class={main}>{''.join(f'<p>{x}</p>' for x in own)}</div><div class={foot}>{last}</div>"
            rows.append((100 * host + page, f"http://h{host}.org/{page}", f"<html><body>{body}</body></html>"))
            want[rows[-1][0]] = "\n".join(own)
        rows.append((100 * host + 50, f"http://h{host}.org/50", rows[-1][2]))
        want[rows[-1][0]] = want[100 * host + 7]
    # Copies of one page, and two pages, are no template.
    rows += [(900 + i, "http://copies.org/", "<body><div>all of it</div></body>") for i in range(9)] + [(950 + i, "http://two.org/", f"<body><p>same</p><p>own {i}</p></body>") for i in range(2)]
    want |= {900 + i: "all of it" for i in range(9)} | {950 + i: f"same\nown {i}" for i in range(2)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in html.extract_text(df).collect()} == want


def test_articles_keep_what_all_pages_share(spark):
    rows = [(i, "http://a.org/", f"<div class=zz>shared</div><article><h2>Sources</h2><p>own {i}</p></article>") for i in range(5)]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"Sources\nown {i}" for i in range(5)}


def test_broken_and_deep_pages_take_linear_time(spark):
    began = time.perf_counter()
    deep = "<div>" * 100_000 + "low" + "</div>" * 100_000 + "<p>after"
    pages = {deep: "low\nafter", '<a "' * 100_000: None, '<p>x</p>"' + "<b " * 100_000: None, "<a '" * 50_000 + ">" + "<p>end": None, "</i2>" * 50_000 + "t": "t", "<!-- " * 50_000: "", "<" * 200_000: "<" * 200_000, "<p>a" * 50_000: None}
    for x, text in pages.items():
        got = html.main_text(x, None)
        assert text is None or got == text, x[:20]
        w = html.Wrapper.of_page(html.Page(x))
        w.merge(html.Wrapper.parse(html.Wrapper.of_page(html.Page(x)).dump()))
        html.judge(w, 3)
    assert time.perf_counter() - began < 60
    df = spark.createDataFrame([(1, "http://a.org/", deep), (2, "http://a.org/", deep.replace("low", "lower"))], "page_id long, url string, html string")
    assert [r["text"] for r in html.extract_text(df).orderBy("page_id").collect()] == ["low\nafter", "lower\nafter"]
    with pytest.raises(ValueError, match="text"):
        html.extract_text(df.withColumn("Text", F.lit("mine")))


def test_tags_are_those_of_a_plain_reader():
    """Random markup against a quadratic reader of the same rules: a name goes on to white space, / or >, quotes included."""
    tag = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
    open_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>")

    def plain(page):
        out, at, shown = [], 0, 0
        while (at := page.find("<", at)) >= 0:
            m = tag.match(page, at) or open_tag.match(page, at)
            if not m:
                at += 1
                continue
            if at > shown:
                out.append(("text", "", page[shown:at]))
            if m.lastindex:
                out.append(("end" if m[1] else "start", m[2].lower(), m[3]))
            at = shown = m.end()
        return [*out, ("text", "", page[shown:])] if shown < len(page) else out

    rng = random.Random(22)
    for _ in range(3000):
        page = "".join(rng.choice(["<", ">", '"', "'", "p", " ", "/", "<b ", "<p>", "</p>", "<!--", "-->", "<!", "x"]) for _ in range(rng.randrange(1, 25)))
        assert list(html._tokens(page)) == plain(page), page


# ---- 7 pieces


def tiny_model():
    pieces = ["<unk>", "<s>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "▁a", "bc", "▁▁", "c", "é"]
    n = len(pieces) - 258
    scores = [0.0] * 258 + [-3.0, -2.0, -2.5, -3.2, -2.2, -2.8, -4.0, -2.4, -1.0]
    return sp.Model.of(pieces, scores, [False] * 258 + [True] * n, list(range(2, 258)), 0)


def best_score(m, text):
    s = (" " + text).replace(" ", sp.MARK)
    unk = min(x for x, ok in zip(m.scores, m.matched) if ok) - 10
    at = {p: x for p, x, ok in zip(m.pieces, m.scores, m.matched) if ok}
    best = [0.0] + [-1e99] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in at:
                best[j] = max(best[j], best[i] + at[s[i:j]])
        if s[i] not in at:
            best[i + 1] = max(best[i + 1], best[i] + unk)
    return best[-1]


def test_pieces_are_the_best_path():
    m, rng = tiny_model(), random.Random(8)
    enc, dec = sp.Encoder(m), sp.Decoder(m)
    unk = min(x for x, ok in zip(m.scores, m.matched) if ok) - 10
    for _ in range(300):
        text = "".join(rng.choice("ab c  é😀\n") for _ in range(rng.randrange(1, 14)))
        ids = enc.encode(text)
        assert dec.decode(ids) == text
        raw = [i for i in ids if i >= 258]
        chars = len((" " + text)) - sum(len(m.pieces[i]) for i in raw)
        assert abs(sum(m.scores[i] for i in raw) + chars * unk - best_score(m, text)) < 1e-6
        assert list(enc.viterbi((" " + text).replace(" ", sp.MARK))) == ids


@pytest.mark.skipif(not os.path.exists(PIECES), reason="no piece file")
def test_real_pieces_are_the_best_path_of_log_scores():
    m, rng = sp.Model.load(PIECES), random.Random(33)
    own = [x for x, ok in zip(m.scores, m.matched) if ok]
    assert abs(sum(map(math.exp, own)) - 1) < 1e-9 and max(own) == m.scores[m.pieces.index("▁t")]
    enc, dec = sp.Encoder(m), sp.Decoder(m)
    unk = min(own) - 10
    alphabet = "etaoin shrdlu,.  éß漢😀\n"
    texts = ["The quick brown fox jumps over the lazy dog.", "  two  spaces", *["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(60)]]
    for text in texts:
        ids = enc.encode(text)
        assert dec.decode(ids) == text
        raw = [i for i in ids if m.matched[i]]
        chars = len(text) + 1 - sum(len(m.pieces[i]) for i in raw)
        assert abs(sum(m.scores[i] for i in raw) + chars * unk - best_score(m, text)) < 1e-6


def test_double_array_holds_exactly_its_keys():
    rng = random.Random(9)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5))) for _ in range(500)})
    t = sp.DoubleArray(keys)

    def find(k):
        s = 0
        for c in k:
            n = t.base[s] + c
            if n >= len(t.check) or t.check[n] != s:
                return -1
            s = n
        return t.value[s]

    assert all(find(k) == i for i, k in enumerate(keys))
    assert all((find(k) >= 0) == (k in set(keys)) for k in (bytes(rng.randrange(256) for _ in range(3)) for _ in range(500)))


def test_piece_columns(spark):
    m = tiny_model()
    df = docs_of(spark, [None, "", "ab c", "é" * 3000, "ab c", "ab " * 300_000])
    with pytest.raises(ValueError, match="ids"):
        sp.encode_column(df.withColumn("IDS", F.lit(1)), m)
    assert sp.encode_column(df.withColumn("ids", F.lit(1)), m, out="pieces").columns == [*df.columns, "ids", "pieces"]
    got = sp.decode_column(sp.encode_column(df, m), m, out="back").orderBy("doc_id").collect()
    assert [r["back"] for r in got] == [r["text"] for r in got] and got[0]["ids"] is None and got[1]["ids"] == []
    assert sp.encode_column(df.limit(0), m).count() == 0


# ---- 8 mixing


@pytest.mark.parametrize("gate", [8 << 20, 0])
def test_mixing_meets_its_targets(spark, monkeypatch, gate):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", gate)
    rng = random.Random(10)
    kinds = ["clean"] * 6 + ["junk"] * 2 + ["toxic"]
    rows, labels = [], []
    for i in range(900):
        d = kinds[i % 9]
        words = prose(rng, 40, 60) + {"clean": "", "junk": " ### |" * 12, "toxic": " scum pathetic"}[d]
        rows.append((i, words))
        labels.append((i, int(d != "junk"), int(d == "toxic")))
    df = spark.createDataFrame([*rows, (None, None), (5, rows[5][1])], "doc_id long, text string").withColumn("mix", F.lit(1))
    lab = spark.createDataFrame([*labels[:600], (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    mix = mixing.Mix(targets={"clean": 0.8, "junk": 0.15, "toxic": 0.05}, steps=200, tolerance=1e-7, ridge=1e-3)
    out = mixing.mix_rates(df, mixing.label_domains(lab), mix).collect()
    whole = sum(r["mix_tokens"] for r in out)
    for i, d in enumerate(mix.names):
        share = sum(r["mix_rate"] * r["mix_tokens"] * r["mix_share"][i] for r in out) / whole
        assert abs(share - mix.targets[d]) < 0.01, d
    # Held-out documents are told apart, and the rates are the solution of the bounded least squares in numpy.
    right = [max(range(3), key=lambda k, r=r: r["mix_share"][k]) == mix.names.index(kinds[r["doc_id"] % 9]) for r in out if r["doc_id"] is not None and r["doc_id"] >= 600]
    assert sum(right) / len(right) > 0.95
    p, n = np.array([r["mix_share"] for r in out]), np.array([r["mix_tokens"] for r in out]) / whole
    first, t, x = n @ p, np.array([mix.targets[d] for d in mix.names]), np.ones(len(out))
    for _ in range(5000):
        x = np.maximum(0, x - 0.5 * (p @ (((n * x) @ p - t) / first) + mix.ridge * (x - 1)))
    assert np.abs(x - [r["mix_rate"] for r in out]).max() < 0.02
    copies = {r["doc_id"]: r["mix_copies"] for r in out}
    docs = mixing.mix_documents(df, mixing.label_domains(lab), mix)
    assert docs.columns == df.columns and docs.where("doc_id = 9").count() == copies[9]
    assert mixing.mix_rates(df.limit(0), mixing.label_domains(lab), mix).count() == 0
    assert mixing.mix_rates(df.limit(9), mixing.label_domains(lab).limit(0), mix).count() == 9


def test_default_mix_meets_its_targets_by_true_posteriors(spark):
    rng = random.Random(14)
    kinds = ["clean"] * 12 + ["junk"] * 6 + ["toxic"] * 2
    rows = [(i, prose(rng, 40, 60) + {"clean": "", "junk": " ### |" * 12, "toxic": " scum pathetic"}[kinds[i % 20]]) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(kinds[i % 20] != "junk"), int(kinds[i % 20] == "toxic")) for i in range(600)], "doc_id long, quality int, toxic int")
    mix = mixing.Mix()
    shares = mixing.mixed_shares(mixing.mix_rates(df, mixing.label_domains(lab), mix), mix)
    for d, t in mix.targets.items():
        assert abs(shares[d] - t) < 0.001 * t, shares


def test_classifier_weighs_every_telling_token(spark):
    """Held against naive Bayes in plain Python, on the model's own choice of smoothing and temperature."""
    rng = random.Random(19)
    marks = {"clean": [f"good{i}" for i in range(200)], "junk": [f"bad{i}" for i in range(200)], "toxic": [f"vile{i}" for i in range(200)]}
    kinds = [rng.choice(["clean", "clean", "junk", "toxic"]) for _ in range(700)]
    texts = [prose(rng, 30, 300) + " " + " ".join(rng.sample(marks[d], 12)) for d in kinds]
    df = docs_of(spark, texts)
    lab = spark.createDataFrame([(i, d) for i, d in enumerate(kinds[:500])], "doc_id long, domain string")
    mix = mixing.Mix()
    model = mixing.fit_posterior(df, lab, mix)
    # Far more tokens tell than any short list would hold.
    assert len(model.tokens) > 300 and model.temperature in mix.temperatures
    keyed = df.select("doc_id", "text", *mixing._keys(F.col("text")))
    rows = keyed.join(mixing.posteriors(df.unionByName(df.limit(9)), model), ["t1", "t2"]).orderBy("doc_id")
    rows = rows.select("p", "copies", F.transform(mixing.tokens_of(F.col("text"), mixing.words(F.col("text"))), lambda t: F.xxhash64(t)).alias("h")).collect()
    assert sum(r["copies"] for r in rows) == 709
    got = [r["p"] for r in rows]
    at = {t: i for i, t in enumerate(model.tokens)}
    for r in rows:
        logs = np.array([b + sum(w[at[t]] for t in set(r["h"]) if t in at) for b, w in zip(model.base, model.weight, strict=True)]) / model.temperature
        want = np.exp(logs - logs.max())
        assert np.allclose(r["p"], want / want.sum(), atol=1e-9)
    names = mix.names
    right = [names[int(np.argmax(p))] == d for p, d in zip(got[500:], kinds[500:], strict=True)]
    assert sum(right) / len(right) > 0.95


def test_mixing_refuses_names_that_are_there(spark):
    df = docs_of(spark, ["a b"]).withColumn("mix_rate", F.lit(1))
    lab = spark.createDataFrame([(0, "clean")], "doc_id long, domain string")
    with pytest.raises(ValueError, match="mix_rate"):
        mixing.mix_rates(df, lab)
    assert mixing.mix_documents(df, lab).columns == df.columns


# ---- 9 lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("k,small,gate", [(2, 16, 24 << 20), (1, 2, 0)])
def test_line_dedup_is_that_of_brute_force(spark, monkeypatch, k, small, gate):
    """Also with every bucket dealt anew on two segments, and with shuffles in place of broadcasts."""
    monkeypatch.setattr(linededup, "SMALL", small)
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", gate)
    rng = random.Random(11 + k)
    bases = ["".join(rng.choice("abcdefé ") for _ in range(rng.randrange(20, 40))) for _ in range(8)]

    def vary(x):
        x = list(x)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randrange(2)] = [rng.choice("abcz")] * rng.randrange(2)
        return "".join(x)

    texts = ["\n".join(vary(rng.choice(bases)) if rng.random() < 0.7 else rng.choice(["", "short", " "]) for _ in range(rng.randrange(8))) for _ in range(60)]
    texts += [None, "", "\n", texts[0]]
    near = linededup.Near(k, 16)
    df = docs_of(spark, texts)
    ts = {r["doc_id"]: r["t"] for r in df.select("doc_id", F.xxhash64("text").alias("t")).collect()}
    occ = [((i, ts[i], p), x) for i, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n")) if len(x) >= 16]
    kinds = sorted({x for _, x in occ})
    top = {x: x for x in kinds}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                top[find(a)] = find(b)
    first = {}
    for at, x in sorted(occ):
        first.setdefault(find(x), at)
    gone = {(at[0], at[2]) for at, x in occ if first[find(x)] != at}
    got = {r["doc_id"]: r for r in linededup.line_dedup(df, near, removed="n_gone").collect()}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert got[i]["text"] == want and got[i]["n_gone"] == sum(d == i for d, _ in gone), i
    assert linededup.line_dedup(df, near).columns == df.columns and linededup.line_dedup(df.limit(0), near).count() == 0


def test_a_family_of_lines_is_not_expanded_into_its_pairs(spark, monkeypatch):
    rng = random.Random(20)
    base = "".join(rng.choice("abcdef ") for _ in range(60))
    family = {base} | {base[:i] + c + base[i + 1 :] for i in range(60) for c in "ghijklmnopqrstuvwxyz"}
    compared = []
    real = linededup._links
    monkeypatch.setattr(linededup, "_links", lambda pairs, *a: (compared.append(pairs.count()), real(pairs, *a))[1])
    texts = sorted(family)
    got = linededup.line_dedup(docs_of(spark, texts), removed="gone").agg(F.sum("gone")).first()[0]
    assert got == len(texts) - 1 and sum(compared) < 15 * len(texts), (len(texts), compared)


def test_a_very_long_text_of_lines(spark):
    text = "\n".join(f"line {i % 50_000} {i % 50_000 * 7919 % 100_003:x} {i % 50_000 * 104_729 % 1_000_003:x}" for i in range(100_000))
    got = linededup.line_dedup(docs_of(spark, [text, "x" * 1_000_000, "x" * 999_999]), linededup.Near(max_edits=0), removed="gone").orderBy("doc_id").collect()
    assert [r["gone"] for r in got] == [50_000, 0, 0]


def test_equal_lines_of_every_length_are_removed(spark):
    texts = ["All rights reserved.\n\nend\n \nshort one 1", "é\nAll rights reserved.\n\nend\n \nshort one 22", "é\nAll rights reserve\nends\nend", None]
    got = [r["text"] for r in linededup.line_dedup(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], "é\n\n ", "ends", None]


def test_automaton_is_the_edit_distance(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = [rng.choice("abé")] * rng.randrange(2)
        rows.append((a, "".join(b) or "a"))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        got = [r["x"] for r in df.select(linededup.within_edits(F.col("a"), F.col("b"), k).alias("x")).collect()]
        assert got == [distance(a, b) <= k for a, b in rows]


# ---- 10 suffixes


def brute_removed(texts, n):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("part,shard", [(4096, 2_000_000), (3, 2_000)])
def test_suffix_dedup_is_that_of_brute_force(spark, monkeypatch, part, shard):
    monkeypatch.setattr(suffix, "PART", part)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    rng = random.Random(13)
    passages = [prose(rng, 60, 50) for _ in range(4)]
    texts = [prose(rng, rng.randrange(5, 120), 50) for _ in range(30)]
    for _ in range(40):
        p = rng.choice(passages)
        i = rng.randrange(len(p) // 2)
        texts.append(prose(rng, rng.randrange(10), 50) + "é " + p[i : i + rng.randrange(80, 200)] + prose(rng, rng.randrange(10), 50))
    texts += [None, "", "aa" * 300, "a" * 450, texts[35], "ab" * 60 + prose(rng, 30) + "ab" * 60, passages[0] + " - " + passages[0]]
    n = 80
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in suffix.suffix_dedup(df, length=n).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, brute_removed(raw, n), strict=True)):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], len(r["removed"])) == (len(t), int(gone.sum()), runs), i
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffix.suffix_dedup(df.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(14)
    for n in (1, 2, 50, 300):
        data = np.frombuffer(bytes(rng.choice(b"ab\0") for _ in range(n)), dtype=np.uint8)
        sa, place = suffix.suffix_array(data)
        raw = data.tobytes()
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = suffix.common_prefixes(data, suffix.packed(data), sa, place, np.array([0]), np.array([n]), 40)
        for r in range(1, n):
            a, b = raw[sa[r - 1] :], raw[sa[r] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            # Beyond the end there are zeros, which only longer prefixes than asked for can reach.
            assert lcp[r] == min(same, 40) or lcp[r] > same and same == min(len(a), len(b))


@pytest.mark.parametrize("alphabet", [b"\0", b"a\0", b"ab\0", b"abc"])
def test_shards_of_texts_with_nul_bytes(alphabet):
    rng = random.Random(15)
    for _ in range(60):
        n = rng.randrange(2, 9)
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(n, 4 * n))) for _ in range(rng.randrange(1, 7))]
        shard = suffix.Shard(parts, np.ones(len(parts)), n)
        got = [np.zeros(len(p), dtype=bool) for p in parts]
        for p, a, b in shard.spans():
            got[p][a : b - 1 + n] = True
        for x, y, p in zip(got, brute_removed(parts, n), parts, strict=True):
            assert (x == y).all(), (parts, p, n)


def test_suffix_dedup_at_400_with_nul_null_and_very_long_texts(spark):
    rng = random.Random(16)
    passage = "".join(rng.choice("ab\0é") for _ in range(300))
    texts = [None, "", "\0" * 399, "\0" * 400, "\0" * 900, "x" + "\0" * 500, passage, "p" + passage + "q", passage[:250] + "z", "\0" * 500 + passage[40:], "a\0" * 300]
    df = docs_of(spark, texts)
    raw = [(t or "").encode() for t in texts]
    got = {r["doc_id"]: r for r in suffix.suffix_dedup(df, kept="left").collect()}
    for i, (t, gone) in enumerate(zip(raw, brute_removed(raw, 400), strict=True)):
        assert bytes(got[i]["left"]) == bytes(b for b, g in zip(t, gone, strict=True) if not g), i
        assert got[i]["n_removed"] == int(gone.sum())
    # Ten megabytes at random repeat nothing but what is planted.
    chars = np.random.default_rng(17).integers(97, 123, 10_000_000, dtype=np.uint8)
    chars[7_000_000:7_001_000] = chars[1000:2000]
    chars[5_000_000:5_000_399] = chars[9_000_000:9_000_399]  # too short
    long_ = chars.tobytes().decode()
    texts = [long_, "-" + long_[3_000_000:3_000_450] + "-", None]
    got = {r["doc_id"]: r for r in suffix.suffix_dedup(docs_of(spark, texts), kept="left").collect()}
    assert [(x["a"], x["b"]) for x in got[0]["removed"]] == [(1000, 2000), (3_000_000, 3_000_450), (7_000_000, 7_001_000)]
    assert bytes(got[1]["left"]) == b"--" and got[2]["n_bytes"] == 0


def test_suffix_dedup_refuses_names_that_are_there(spark):
    df = docs_of(spark, ["a"]).withColumn("Removed", F.lit(1))
    with pytest.raises(ValueError, match="removed"):
        suffix.suffix_dedup(df)
    out = suffix.suffix_dedup(df, names=("b", "r", "spans", "sha"))
    assert out.columns == [*df.columns, "b", "r", "spans", "sha"] and out.first()["Removed"] == 1
