import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from text_data import pairs

import corpus_pipeline
from rasterloom.llm import chat_format, decontaminate, host_rules, queries, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ chat

def plain_digest(rows):
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for role, text in rows:
        turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
    return len(rows), turns.hexdigest(), sum(len(t) for r, t in rows if r == "assistant"), loss.hexdigest()


def test_chat_query_equals_plain_digest(spark):
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op8(spark, SMALL).collect()}
    convs = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    text = "\\### Assistant: </turn> ok"
    convs[-7] = [("user", text), ("assistant", text)]
    assert got == {k: plain_digest(v) for k, v in convs.items()}


def test_chat_round_trip_and_order(spark):
    nasty = ["", "\\", "###", "####: ", "</turn>\n### User: x", "\\</turn>", "=: \\:", "#" * 9, "a\r\nb\x00"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate([(r, t) for t in nasty for r in ("user", "assistant")])]
    rows += [(2, 0, "assistant", "first"), (2, 1, "to:ol\\", "x"), (2, 2, None, None), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 1, "user", "u"), (None, None, "user", "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    formatted = chat_format.format_turns(df)
    t = chat_format.Template()
    back = [(r.conv_id, *t.parse([(s.text, s.loss) for s in r.segments])[:2]) for r in formatted.collect()]
    want = [(-(2**63) if c is None else c, role or "", text or "") for c, _, role, text in rows]
    assert sorted(back) == sorted(want)
    assert not any("##" in t.escape(x) or "</" in t.escape(x) for x in nasty)
    bad = {r.conv_id: r.n_invalid for r in chat_format.read_back(formatted).collect()}
    assert bad == {1: 0, 2: 3, 3: 1, None: 0}
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


# ------------------------------------------------------------------ host rules

def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures(rng):
    texts = ["", " \n", "a b c a b c a", "é ü\n\né ü\n#$|<>", "x " * 100] + [" ".join(rng.choice(list("ab\nc"), 200)) for _ in range(20)]
    assert [host_rules.measure(t.encode()) for t in texts] == [plain_measures(t) for t in texts]


def test_host_verdicts_shrink_and_join(spark, odd):
    bad, text = "x", " ".join(f"w{i}" for i in range(60))
    rows = [(100 * h + k, bad if k < h % 4 else text, f"h{h}") for h in range(12) for k in range(10)]
    rows += [(2000 + k, bad if k < 19 else text, "bad") for k in range(20)]
    rows += [(3000, bad, "new"), (3001, text, None), (None, bad, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in host_rules.judge(df).collect()}
    assert out[9].kept and out[3001].kept and not out[None].kept
    assert out[2019].host_rejected and not out[2019].base_failed and not out[2019].kept
    v = {r.host: r for r in host_rules.host_verdicts(host_rules.document_metrics(df)).collect()}
    # one failure of one document says little; many say much
    assert v["new"].base_rate < 0.9 and v["bad"].base_rate > 0.85 and 0 < v["h0"].base_rate < 0.1
    assert host_rules.judge(odd).count() == odd.count() and host_rules.judge(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ urls

def plain_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    best = None
    for kind, rule in rules:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = kind, rule
    return host, path, best


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/1", "http://www.example.com/en/x?y://z", "http://a.example.com", "http://com/", "https://x.net/es/1#f", "https://x.net/esp", "ftp://x.net?/fr/", "http://blog.cheap-pills.org/en/4", "http://library.org/en/4", "http://ÄB.com/\n/x", "http://xcom/"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, score string, features string").union(spark.createDataFrame([(None, "http://a.com/", None, None)] * 2, "page_id long, url string, score string, features string"))
    rows = url_filter.judge(df, queries.URL_RULES, url_filter.labelled_urls(spark)).collect()
    by_id = {r.page_id: r for r in rows}
    assert len(rows) == len(urls) + 2 and by_id[None].rule == "com/"
    for i, u in enumerate(urls):
        host, path, best = plain_rule(u, queries.URL_RULES)
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[0] if best else "block" if r.score >= 0.5 else "allow")
    assert by_id[11].verdict == "block" and by_id[12].verdict == "allow"
    one = url_filter.judge(df, [], url_filter.labelled_urls(spark).where("label = 1"))
    assert {r.verdict for r in one.collect()} == {"block"}
    assert url_filter.judge(df.limit(0), queries.URL_RULES, url_filter.labelled_urls(spark).limit(0)).count() == 0


def test_url_model_on_held_out_words(spark):
    labelled = url_filter.labelled_urls(spark)
    held = labelled.where("url LIKE '%casino%' OR url LIKE '%museum%'")
    out = url_filter.judge(held.selectExpr("monotonically_increasing_id() page_id", "url", "label"), [], labelled)
    right = out.join(held.selectExpr("monotonically_increasing_id() page_id", "label"), "page_id").selectExpr("avg(CAST((verdict = 'block') = (label = 1) AS INT)) a").first().a
    assert right > 0.95


# ------------------------------------------------------------------ toxicity

def test_toxicity_learns_from_documents_and_finds_sentences():
    r = np.random.default_rng(3)
    plain = [f"plain{i}" for i in range(400)]

    def doc(bad):
        s = [" ".join(r.choice(plain, 8)) + "." for _ in range(r.integers(2, 12))]
        if bad:
            k = r.integers(len(s))
            s[k] = s[k][:-1] + f" {r.choice(['vile', 'nastyish', 'nastyest'])} end."
        return " ".join(s)

    y = [i % 3 == 0 for i in range(900)]
    texts = [doc(b) for b in y]
    model = toxicity.train(texts[:600], y[:600])
    s = model.scorer()
    assert np.mean([(s.score(t) >= 0.7) == b for t, b in zip(texts[600:], y[600:], strict=True)]) > 0.97
    t = "Plain1 plain2 plain3. This is vile indeed!\nplain4 plain5."
    assert [t[a:b].strip() for a, b, _ in s.sentences(t)] == ["This is vile indeed!"]
    assert s.score("") == 0 and 0 <= s.score(" ".join(plain) * 50) < 0.7


def test_toxicity_edges(spark, odd):
    assert toxicity.train([], []).scorer().score("words") < 0.01
    assert toxicity.train(["a b"], [1]).scorer().score("words") > 0.9
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    out = toxicity.score_documents(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_documents(odd.limit(0), model).count() == 0
    kept = toxicity.keep_clean(odd, toxicity.Model())
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op1(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL")
    assert out.selectExpr("avg(CAST(predicted = toxic AS INT)) a").first().a > 0.93


# ------------------------------------------------------------------ decontamination

def test_common_subsequence(rng):
    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(0, 80)).tolist(), rng.integers(0, 6, rng.integers(0, 80)).tolist()
        assert decontaminate.common_subsequence(a, b) == table(a, b)


def test_latent_axes_match_a_full_decomposition(spark, sample):
    words = decontaminate.hashed_documents(sample)
    space = decontaminate.latent_space(words, features=64, rank=64)
    a = []
    for r in words.collect():
        for _, _, m in decontaminate._blocks([bytes(r.words)], decontaminate.BLOCK * decontaminate.PASSAGE, 64):
            m = m * space.idf
            a.append(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))
    s = np.linalg.svd(np.concatenate(a), compute_uv=False)
    assert np.allclose(space.values[:20], s[:20], rtol=0.01)
    # a small test matrix finds the leading values from below
    few = decontaminate.latent_space(words, features=64, rank=10).values
    assert np.allclose(few[:1], s[:1], rtol=0.02) and (few <= s[: len(few)] * 1.001).all()


def test_leaks_copies_paraphrases_and_clean_documents(spark, rng, odd):
    vocabulary = [f"term{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [text(25) + "? " + text(8) + "." for _ in range(20)] + ["tiny item", "", None, "..."]
    rows = [(i, text(rng.integers(1, 900))) for i in range(150)]
    want = set()
    for i in range(20):
        w = items[i].split()
        rows.append((200 + i, f"{text(300)} {items[i].upper()} {text(250)}"))
        w[3], w[9] = "other", "changed"
        del w[15]
        rows.append((300 + i, f"{text(37 * i)} {' '.join(w)} {text(400)}"))
        want |= {(200 + i, i), (300 + i, i)}
    rows.append((400, f"{text(50)} tiny item {text(10)}"))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(items)], "item_id long, text string, cosine string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert want <= got <= want | {(400, 20)}
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - 40 - ((400, 20) in got)
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.without_leaks(odd.limit(0), bench).count() == 0


def test_every_exact_copy_is_a_candidate(spark):
    """Each item pasted unchanged at random places of real documents, and items cut to few words."""
    from rasterloom.llm.decontaminate import Item, _candidates, _queries, hashed_documents, judge, latent_space, read_item

    rng, d = np.random.default_rng(5), "/root/testdata/sf0.01"
    words = hashed_documents(spark.read.parquet(f"{d}/documents.parquet"))
    space = latent_space(words)
    texts = [w for r in words.collect() if len(w := np.frombuffer(r.words, "<u4")) > 300]
    items = [read_item(i, r.text.encode()) for i, r in enumerate(spark.read.parquet(f"{d}/benchmark.parquet").collect())]
    items += [Item(len(items) + i, x.words[:n], x.words[n - 1 : n]) for i, x in enumerate(items[::2]) for n in (5, 8)]
    rows, owner = [], []
    for k, item in enumerate(items):
        for _ in range(20):
            at = rng.integers(0, 300)
            w = texts[rng.integers(len(texts))]
            rows.append(np.r_[w[:at], np.array(item.words, "<u4"), w[at : at + 300]])
            owner.append(k)
    table = np.vstack([space.axes, np.zeros((1, space.axes.shape[1]), np.float32)])
    found = _candidates(rows, _queries(items, space), table, decontaminate.COSINE)
    assert all((r, k) in found for r, k in enumerate(owner))
    assert all(judge(items[k], rows[r].tolist())[0] for r, k in enumerate(owner))


def test_long_passages_of_items_are_leaks(rng):
    from rasterloom.llm.decontaminate import Item, judge

    for n, lo, k in ((59, 14, 30), (500, 120, 250), (500, 0, 30)):
        words = rng.integers(1, 2**31, n).tolist()
        around = rng.integers(1, 2**31, 100).tolist()
        item = Item(1, words, words[-5:])
        assert judge(item, around + words[lo : lo + k] + around)[0]
        assert not judge(item, around + words[lo : lo + 20] + around)[0]
    changed = words[64:192]
    changed[::8] = around[:16]  # one word in eight is another
    assert judge(item, changed)[0]


def test_copy_in_the_only_passage_is_found(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 7)]


# ------------------------------------------------------------------ pipeline

@pytest.mark.parametrize("name", [s[0] for s in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.select("doc_id", "text", "lang", "source").selectExpr("*", "CAST(NULL AS LONG) n_chars")
    out = stage(spark, docs, SMALL)
    if name != "encode":
        assert out.columns == docs.columns
    assert 0 < out.count() <= docs.count()
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_pipeline_equals_its_stages_by_plain_means(spark):
    import brute
    from rasterloom.llm import bpe_stream
    import public_tokenizers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    s = model.scorer()
    rows = [(i, t) for i, t in pairs(docs) if s.score(t or "") < 0.7]
    kept = {r[0] for r in brute.near_duplicates(rows) if r[3]}
    rows = [(i, t) for i, t in rows if i in kept]
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(least.get(b[k : k + 50], i), i)
    cut = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        cut.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in cut if not any(b in t for _, b in bench)]
    t = bpe_stream.Tokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {i: hashlib.sha256(t.encode(x)).hexdigest() for i, x in rows}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()}
    # a leak in other words may be found beyond the literal ones
    assert set(got) <= set(want) and len(want) - len(got) <= 0.02 * len(want)
    assert all(want[i] == h for i, h in got.items())


@pytest.mark.parametrize("opening,closing", [("### ", "</turn>\n"), ("<|im|>", "<|end|>"), ("[[", "]]x"), ("ab", "cd")])
def test_template_escapes_follow_its_control_strings(opening, closing):
    """Random texts over the characters of the control strings come back, and
    no control string is left in them or arises where they end."""
    t = chat_format.Template(opening=opening, closing=closing)
    rng = random.Random(1)
    letters = sorted(set(opening + closing + "\\:=/ x"))
    texts = ["", opening, closing, "\\" + closing, closing * 3, opening[:1] * 9]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000)]
    for text in texts:
        assert opening not in t.escape(text) and closing not in t.escape(text)
        for role in ("assistant", text):
            parts = t.segments(role, text)
            whole = "".join(x for x, _ in parts)
            assert whole.count(opening) == 1 and whole.count(closing) == 1 and whole.endswith(closing)
            assert t.parse(parts) == (role, text, text if role == "assistant" else "")


@pytest.mark.parametrize("wrong", [
    {"opening": "#"}, {"closing": "<<"}, {"opening": " ##"}, {"closing": "a:b"}, {"closing": "a\\b"}, {"opening": "a=b"},
    {"roles": {"user": ("A", False), "assistant": ("A", True)}}, {"roles": {"user": ("x</turn>\n", False)}}])
def test_ambiguous_templates_are_refused(wrong):
    with pytest.raises(ValueError):
        chat_format.Template(**wrong)
