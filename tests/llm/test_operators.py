"""Every operator against a brute-force version on odd rows, and on empty tables."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from odd_rows import none, odd, odd_texts  # noqa: F401

from tallygrade.llm import coder, cotrain, decontamination, html, ids, language, maxent, packing, rules, secrets
from tallygrade.llm.entries import vocabulary
from tallygrade.llm.texts import filled, hashed, split_words
from tallygrade.llm.tokens import encoded, load

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int, text string"


def by(rows, *names):
    """The rows as sorted tuples, nulls as texts."""
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def labels(spark, texts):
    rows = [(i, int(len(t or "") % 3 > 0), 0, "t") for i, t in texts] + [(None, 1, 0, "t"), (3, None, 1, "t"), (999, 0, 0, "t")]
    return spark.createDataFrame(rows, LABELS)


# 1


def test_language(spark):
    parts = {"aa": "bada kuna moli taro ", "bb": "xerq wump yilz vrog "}
    rows = [(i, (parts[lang] * 9)[i % 7 :] + str(i % 3), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "", None), (502, "12 !", "bb"), (None, parts["bb"] * 3, None), (503, "bada kuna moli", None), (503, "bada kuna moli", None)]
    got = language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    known = {i: lang for i, _, lang in rows}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 500:
            assert r.lang_pred == known[r.doc_id]
    assert {r.doc_id: r.lang_pred for r in got if (r.doc_id or 0) >= 500} == {500: "und", 501: "und", 502: "und", 503: "aa"}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["bb"]


def test_language_without_labels(spark, odd, none):
    bare = odd.withColumn("lang", odd["lang"].cast("string")).na.replace("en", None, "lang")
    assert {r.lang_pred for r in language.language_id(bare).collect()} == {"und"}
    assert language.language_id(none).collect() == []


# 2 and 5


def base(text):
    words = WORDS.findall(text or "")
    count, hit = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if count[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_rules(spark, odd, odd_texts, none):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    marks = labels(spark, odd_texts)
    got = rules.quality_rules(odd, marks).collect()
    assert by(got, *names) == sorted(((i, *base(t)) for i, t in odd_texts), key=repr)
    assert all(r.kept == (not r.base_failed and r.quality >= rules.KEEP) for r in got)
    kept = rules.passing(odd, marks)
    assert kept.columns == odd.columns
    assert by(kept.collect(), "doc_id") == by([r for r in got if r.kept], "doc_id")
    assert all(r.kept != r.base_failed for r in rules.quality_rules(odd, marks.limit(0)).collect())
    assert rules.quality_rules(none, marks).collect() == []


def junk(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"{'qz' if bad and j % 2 else 'ba'}{(i * 31 + j * j) % 97}{'***' if bad else ''}" for j in range(40)]
        rows.append((i, " ".join(words), "en", "s", 1, "k", "n", "w", 1, "l"))
        marks.append((i, int(not bad), 0, "t"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, n string, words string, start long, label string"), marks


def test_scores_are_sums_over_vectors(odd_texts, monkeypatch):
    texts = filled(pa.array([t for _, t in odd_texts], pa.string()))
    words = split_words(texts)
    weights = np.random.default_rng(3).normal(size=rules.FAMILIES * rules.SIZE)
    expected = rules.vectors(texts).times(weights)
    for stretch in (997, 1 << 20):
        monkeypatch.setattr(rules, "STRETCH", stretch)
        assert np.allclose(rules.logits(texts, words, hashed(words.uniques)[words.ids], weights), expected, atol=1e-5)


def test_models_learn(spark):
    docs, marks = junk(spark)
    known = spark.createDataFrame([m for m in marks if m[0] % 3], LABELS)
    for got in (rules.quality_rules(docs, known).collect(), cotrain.cotrained(docs, known).collect()):
        held = [r for r in got if r.doc_id % 3 == 0]
        assert sum(r.kept == (r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held)


def test_cotraining_odd_rows(spark, odd, odd_texts, none):
    marks = labels(spark, odd_texts)
    got = cotrain.cotrained(odd, marks).collect()
    assert by(got, "doc_id") == sorted(((i,) for i, _ in odd_texts), key=repr)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= cotrain.KEEP) for r in got)
    assert len(cotrain.cotrained(odd, marks.limit(0)).collect()) == len(odd_texts)
    assert cotrain.cotrained(none, marks).collect() == []


# 3


@pytest.mark.parametrize("n, most", [(0, 10), (1, 10), (4095, 3), (4096, 65536), (4097, 50), (30_000, 1000)])
def test_coder_round_trip(n, most):
    values = np.random.default_rng(n).zipf(1.4, n) % most
    frame = coder.encode(values)
    assert (coder.decode(frame) == values).all()
    if n > 10:
        for at in (len(frame) - 3, len(frame) // 2):
            broken = bytearray(frame)
            broken[at] ^= 4
            with pytest.raises(ValueError):
                coder.decode(bytes(broken))
        with pytest.raises(ValueError):
            coder.decode(frame[:-2])
        assert (coder.decode(coder.encode(values, block=257)) == values).all()


def test_coder_packs():
    values = np.tile(np.arange(300), 100)
    assert len(coder.encode(values)) < 0.25 * 2 * len(values)
    with pytest.raises(ValueError):
        coder.encode(np.array([1 << 16]))


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(odd_texts, name, spaces):
    tokenizer = load(vocabulary(name))
    texts = [t for _, t in odd_texts] + ["  a  b", "a \n b", "<|endoftext|> x<|startoftext|>y", "it's  we'll 12 3", "　a  b", "e ́", "  a", "a\x1c b \x85 c"]
    flat, counts = encoded(tokenizer, pa.array(texts, pa.string()), spaces)
    ends = np.cumsum(counts)
    assert [flat[e - c : e].tolist() for e, c in zip(ends, counts)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("most", [1 << 22, 50])
def test_token_ids(spark, odd, odd_texts, none, tmp_path, most):
    ids.write_ids(odd, f"{tmp_path}/a", vocabulary("byte_bpe_50k.json"), 2, most)
    got = ids.read_ids(spark, f"{tmp_path}/a").collect()
    tokenizer, at, expected = load(vocabulary("byte_bpe_50k.json")), 0, []
    for i, t in sorted(odd_texts, key=lambda r: -1 if r[0] is None else r[0]):
        x = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert by(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    ids.write_ids(none, f"{tmp_path}/b", vocabulary("byte_bpe_50k.json"), 2)
    assert ids.read_ids(spark, f"{tmp_path}/b").collect() == []


# 4


def test_lm(spark, odd, odd_texts, none):
    got = maxent.lm_scores(odd).collect()
    tokens = [(i, [*WORDS.findall((t or "").translate(LOW)), "\n"], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in odd_texts]
    counts = Counter(w for _, words, held in tokens if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i, held, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, w, held in tokens), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == expected
    assert all(r.score < 0 for r in got)
    assert maxent.lm_scores(none).collect() == []


def test_lm_is_a_distribution():
    """After any context all words, with one unknown, have probability one together."""
    heads = [(i * 7 + 1, 5000 - i) for i in range(2048)]
    model = maxent.initial(heads, sum(n for _, n in heads) + 900, 2048 + 300)
    rng = np.random.default_rng(0)
    model.first += rng.normal(size=model.first.shape).astype(np.float32)
    model.second += rng.normal(size=model.second.shape).astype(np.float32)
    words = np.array([w for w, _ in heads], np.int64).view(np.uint64)
    kind, at = model.place(words)
    one, two = np.full(2048, 5, np.uint64), np.full(2048, 9, np.uint64)
    first = maxent.log_shares(model.first, maxent.rows_of(one, two, None))
    inner = maxent.log_shares(model.second, maxent.rows_of(one, two, kind))
    total = np.exp(first[np.arange(2048), kind] + inner[np.arange(2048), at]).sum() + np.exp(first[0, maxent.CLASSES])
    assert abs(total - 1) < 1e-3


def test_lm_learns_contexts(spark):
    rows = [(i, " ".join(["red", "car", "blue", "sky"][(j + i % 2 * 2) % 4] for j in range(40))) for i in range(200)]
    got = maxent.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_lm_learns_from_every_place(spark):
    """Texts of four tokens: with every fourth token as a target only the first word of a text would be learned."""
    rows = [(i, ["red car moves", "blue sky falls"][i % 2]) for i in range(400)]
    got = maxent.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


@pytest.mark.parametrize("listed", [18, 3])
def test_lm_knows_all_words_apart(monkeypatch, listed):
    """All words after the heads have probability one together after any context, and their counted shares before anything is learned."""
    monkeypatch.setattr(maxent, "LISTED", listed)
    heads = maxent.CLASSES * maxent.WIDE
    counts, often = np.array([900, 41, 40, 7, 3, 2, 1]), np.array([heads - 5, 9, 1, 60, 130, 700, 1500])
    order = maxent.Order(counts, often)
    ranks = np.arange(heads, often.sum())
    mass = np.repeat(counts, often)[heads:] + 0.5
    one, two, steep = np.full(len(ranks), 5, np.uint64), np.full(len(ranks), 9, np.uint64), order.steep(ranks)
    deep = np.zeros(maxent.DEEP, np.float32)
    logs = lambda: maxent.deep_logs(deep, order, ranks, steep, one, two)
    assert np.allclose(np.exp(logs()), mass / mass.sum(), rtol=1e-3)
    some = slice(1000, 1001)
    before = logs()[some]
    for _ in range(20):
        maxent.deep_step(deep, np.zeros(maxent.DEEP, np.float32), order, ranks[some], steep[:, some], one[some], two[some])
    assert logs()[some] > before + 3 and abs(np.exp(logs()).sum() - 1) < 1e-3
    deep += np.random.default_rng(0).normal(size=len(deep)).astype(np.float32)
    assert abs(np.exp(logs()).sum() - 1) < 1e-3


def test_lm_learns_contexts_of_rare_words(spark):
    """Words after the 2048 most frequent ones are told apart by the word before them."""
    heads = " ".join(f"h{i}" for i in range(2048))
    rows = [(i, heads) for i in range(100)]
    pair = lambda i, shift: f"a{i % 150} b{(i + shift) % 150}"
    held = [i for i in range(1000, 8000) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows += [(i, pair(i, 0)) for i in range(1000, 8000) if i not in set(held)] + [(i, pair(i, i % 2)) for i in held]
    got = {r.doc_id: r.score for r in maxent.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mean = [np.mean([got[i] for i in held if i % 2 == odd]) for odd in (0, 1)]
    assert mean[0] > mean[1] + 0.5


# 6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets(spark, odd_texts, none):
    made = hashlib.sha256(b"x").hexdigest()
    extra = [
        (70, f"é\U0001f600 PassWord = '{made}' and AKIA{'Q7' * 9}, token: short; api_key:{'z' * 12}"), (71, made[:16] + " " + made[:15] + " " + made), (72, "token=token=abcdefghijklmn secret = "),
        (73, "key xK9vQ2mZ7pLw4TtR8bNc1YhD5sGf0JjU here"), (74, "an ordinary internationalization counterrevolutionary sentence"), (75, "AKIAAKIA" + "B" * 15), (76, f"{made} " * 300),
    ]
    texts = odd_texts + extra + [(100 + i, "plain ordinary words understanding responsibility characteristically notwithstanding") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in texts], "doc_id long, text string, k string, n_chars long")
    got = secrets.secret_scan(docs).collect()
    expected = []
    for i, t in texts:
        found = base_spans(t or "")
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in found)
        expected.append((i, *[sum(k == kind for _, k, _ in found) for kind in range(3)], hashlib.sha256(written.encode()).hexdigest()))
    assert by(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(expected, key=repr)
    said = {r.doc_id: r.spans for r in got}
    assert said[73] == "random:4:36" and said[74] == ""
    clean = {i: t for i, t in ((r.doc_id, r.text) for r in secrets.redacted(docs).collect())}
    assert clean[73] == "key [SECRET] here" and clean[74] == extra[4][1] and clean[1] is None
    assert clean[70].startswith("é\U0001f600 [SECRET]' and [SECRET], token: short; [SECRET]")
    assert secrets.redacted(docs).columns == docs.columns and secrets.redacted(docs).count() == len(texts)
    assert secrets.secret_scan(none).collect() == []


# 7


def test_packing(spark, odd, odd_texts, none):
    capacity = 64
    got = packing.best_fit_packing(odd, vocabulary("word_bpe_49k.json"), capacity=capacity).collect()
    tokenizer, expected = load(vocabulary("word_bpe_49k.json")), []
    for i, t in odd_texts:
        x = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i, k, a, len(x[a : a + capacity]), zlib.crc32(x[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(x), capacity))]
    assert by(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(expected, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plain_best_fit([e[3] for e in expected], capacity)
    assert packing.best_fit_packing(none, vocabulary("word_bpe_49k.json")).collect() == []


def plain_best_fit(lengths, capacity):
    room, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        if at < len(room):
            left = room.pop(at) - n
        else:
            left, used = capacity - n, used + 1
        bisect.insort(room, left)
    return used


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_of_counts(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 300))
    lengths = Counter((rng.integers(1, capacity + 1, 2000) ** 2 // capacity + 1).clip(1, capacity).tolist())
    runs = packing.best_fit(lengths, capacity)
    fill, placed = Counter(), Counter()
    starts = {(r[0], r[1]): r for r in runs}
    for length, n in lengths.items():
        mine = sorted(r for r in starts.values() if r[0] == length)
        for rank in range(n):
            run = [r for r in mine if r[1] <= rank][-1]
            step = rank - run[1]
            fill[run[2] + step // run[3]] += length
            placed[length] += 1
    assert placed == lengths and max(fill.values()) <= capacity
    assert len(fill) == plain_best_fit(list(lengths.elements()), capacity)


# 9


def test_html_pages():
    page = """<!DOCTYPE html><html><body><header class=site><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <div class="sidebar"><p>Side text is here</p></div><div class="cookie-notice">We use cookies</div>
    <div id=content><h1>Title  here</h1><p>First <b>para</b> with <a href=y>a link</a> &amp; more&nbsp;text.<p>Second para is long enough to count.</p><ul><li>One<li>Two</ul>
    <div class="ad">Buy</div><form><p>Name</p></form><!-- <p>no</p> --><script>x = "</p><p>no";</script></div>
    <section class=comments><p>Nice post, a reader says many words in here which are long and dense.</p></section><footer>foot</footer></body></html>"""
    assert html.main_text(page) == "Title here\nFirst para with a link & more text.\nSecond para is long enough to count.\nOne\nTwo"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain  words", "plain words"), ("<p>a<p>b", "a\nb"), ("<div", ""), ("<!-- x", ""), ("<script>x", ""), ("<a href='>'>t</a>", "t"), ("a &lt;b&gt; &#233;", "a <b> é"),
        ("<article><h1>T</h1><p>x<br>y</p><table><tr><td>1<td>2</table></article><p>outside</p>", "T\nx y\n1\n2"), ("</p></div>x<p", "x"), ("<body><p hidden>no</p><p>yes</p>", "yes"),
    ],
)
def test_html_odd_pages(page, text):
    assert html.main_text(page) == text


def test_html_density_chooses():
    """A small <article> beside or inside the dense part doesn't take its place; without the tag the same text is found."""
    long = [f"Sentence {i} of the text that readers came for, with many words and no link in it." for i in range(8)]
    paragraphs = "".join(f"<p>{x}</p>" for x in long)
    teaser = "<article><h2>Also</h2><p>Short hint.</p></article>"
    assert html.main_text(f"<body>{teaser}<div id=x>{paragraphs}</div></body>") == "\n".join(long)
    assert html.main_text(f"<body><div id=x>{paragraphs}{teaser}</div><p>By</p></body>") == "\n".join([*long, "Also", "Short hint."])
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Head</h1>{paragraphs}</article><div>Buy now</div></body>"
    assert html.main_text(page) == html.main_text(page.replace("article>", "div>")) == "\n".join(["Head", *long])
    wrapped = f"<body><article><h1>Head</h1><div>{paragraphs}</div></article></body>"
    assert html.main_text(wrapped) == "\n".join(["Head", *long])


def test_html_rows(spark):
    rows = [(1, "u", "<p>é</p>", "x"), (1, "u", "<p>é</p>", "x"), (None, None, None, "x"), (2, "v", "<p>" + "long " * 50_000, None)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert by(got, "page_id", "url", "n_chars") == sorted([(1, "u", 1), (1, "u", 1), (None, None, 0), (2, "v", 249_999)], key=repr)
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# 10


def test_decontamination(spark, odd, odd_texts, none):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(LOW))
    long = split(odd_texts[4][1])
    items = [
        (1, " ".join(long[100:130])), (2, "X"), (3, None), (4, "!!"), (None, "x"), (11, " ".join(split(odd_texts[5][1])[:12]).upper()), (5, "one two THREE four five six seven eight nine one two"),
        (1, "eta zeta"), (6, "never seen words at all in any document here or there"), (7, "全角"), (8, "one two three four five six seven eight nine one two"),
    ]
    bench = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, k string")
    windows = {}
    for i, t in items:
        w = split(t)
        if i is not None and w:
            for a in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    expected = []
    for i, t in odd_texts:
        w, hit, found = split(t), set(), set()
        for m in {len(x) for x in windows}:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in windows:
                    hit |= set(range(a, a + m))
                    found |= windows[tuple(w[a : a + m])]
        expected.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    got = decontamination.contamination(odd, bench).collect()
    assert by(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(expected, key=repr)
    left = decontamination.without_contaminated(odd, bench)
    assert left.columns == odd.columns and by(left.collect(), "doc_id") == sorted(((e[0],) for e in expected if not e[-1]), key=repr)
    assert not any(r.contaminated for r in decontamination.contamination(odd, bench.limit(0)).collect())
    assert decontamination.contamination(none, bench).collect() == []


def test_maxent_in_stretches_is_that_of_whole_batches():
    import tracemalloc

    rng = np.random.default_rng(5)
    n = 3 * maxent.STRETCH + 7
    table = rng.normal(size=(maxent.ROWS, maxent.WIDE)).astype(np.float32)
    rows = np.minimum(rng.zipf(1.3, (4, n)), maxent.ROWS) - 1
    rows[0] = rng.integers(0, 3, n)
    target = rng.integers(0, maxent.WIDE, n)
    z = table[rows[0]] + table[rows[1]] + table[rows[2]] + table[rows[3]]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(maxent.log_shares(table, rows), z, atol=1e-5)
    tracemalloc.start()
    got = maxent.log_share_of(table, rows, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, z[np.arange(n), target], atol=1e-5) and peak < z.nbytes
    g = np.exp(z)
    g[np.arange(n), target] -= 1
    sums, often = np.zeros(table.shape), np.bincount(rows.ravel(), minlength=maxent.ROWS)
    for r in rows:
        np.add.at(sums, r, g)
    sums /= np.maximum(often[:, None] ** 0.5, 1)
    squares = (sums * sums).mean(axis=1)
    moved, seen = table.copy(), np.zeros(maxent.ROWS, np.float32)
    maxent.step(moved, seen, rows, target)
    assert np.allclose(seen, squares, rtol=1e-3, atol=1e-6)
    assert np.allclose(moved, table - maxent.RATE * sums / np.sqrt(squares + 1)[:, None], atol=1e-3)
    assert np.array_equal(moved[often == 0], table[often == 0])


def test_slices_give_back_what_a_task_freed():
    import subprocess
    import sys
    from pathlib import Path

    # a fresh process, as what this one holds depends on the tests before
    source = """if True:
        import pyarrow as pa
        from tallygrade.llm.texts import filled, slices, split_words

        def held():
            return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon"))

        texts = pa.array([" ".join(str(i * 7919 % 1000003) for i in range(k, k + 4000)) for k in range(0, 800000, 4000)])
        given = [pa.record_batch([texts], ["text"])]
        before = held()
        for part in slices(given, "text", 2 << 20):
            words = split_words(filled(part.column("text")))
            lists = words.uniques.to_pylist()
            del words, lists
        print(held() - before)
    """
    root = Path(__file__).resolve().parents[2]
    kept = int(subprocess.run([sys.executable, "-c", source], cwd=root, capture_output=True, text=True, check=True).stdout)
    assert kept < 2 << 10


def test_fit_holds_a_stretch_beside_its_rows():
    import tracemalloc

    from tallygrade.llm import linear

    r = np.random.default_rng(5)
    sizes = np.concatenate([r.integers(0, 2000, 900), [(1 << 18) + 9, 0]])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    given = linear.Sparse(starts, r.integers(0, 1000, starts[-1]).astype(np.int32), r.random(starts[-1]).astype(np.float32))
    y, order = (r.random(len(sizes)) < 0.6).astype(float), r.permutation(len(sizes))
    tracemalloc.start()
    x = given.rows(order)
    own = x.index.nbytes + x.value.nbytes
    w, b = linear.fit(x, y, 1000, rounds=3)
    z = x.times(w)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < own + (48 << 18) < own + 20 * len(x.index)
    # the same, with all pairs at a time
    take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order])
    assert np.array_equal(x.index, given.index[take]) and np.array_equal(x.value, given.value[take])
    owner = np.repeat(np.arange(len(y)), sizes[order])
    plain, bias, squares, square = np.zeros(1000), float(np.log(y.mean() / (1 - y.mean()))), np.full(1000, 1e-8), 1e-8
    for _ in range(3):
        error = (linear.sigmoid(np.bincount(owner, plain[x.index] * x.value, len(y)) + bias) - y) / len(y)
        grad = np.bincount(x.index, x.value * error[owner], 1000) + 1e-4 * plain / len(y)
        squares += grad * grad
        plain -= 0.3 * grad / np.sqrt(squares)
        square += error.sum() ** 2
        bias -= 0.3 * error.sum() / np.sqrt(square)
    assert np.allclose(w, plain) and np.isclose(b, bias)
    assert np.allclose(z, np.bincount(owner, plain[x.index] * x.value, len(y)))
