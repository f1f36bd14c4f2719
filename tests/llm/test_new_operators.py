"""WARC archives, conversation repair and spelling variants against brute force, on odd rows and on empty tables."""

import glob
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from odd_rows import none, odd, odd_texts  # noqa: F401

from tallygrade.llm import spelling, turns, warc

PAGES = "page_id long, url string, html string, value string, file string, digest string"
TALKS = "conv_id long, turn long, role string, text string, letters string, place long, audit string"
FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# 11


def pages(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = "x" * rng.randint(0, 300)
        t = rng.choice([
            t, None, "a" * 150, "b" * 99, t + FAKE * rng.randint(1, 3) + "y" * rng.randint(0, 20), "\r\n" * rng.randint(1, 5) + t + "\r\n" * rng.randint(1, 5),
            "é全\n" * rng.randint(1, 90) + "\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n", "WARC/1.1\r\nContent-Length: 7\r\n",
        ])
        rows.append((None if i in (7, 9) else i // 2 if i < 12 else i, "u\r\nContent-Length: 1" if i % 3 else None, t, "v", "f", "d"))
    return rows


def expected_pages(rows):
    first = {}
    for i, _, t, *_ in rows:
        b = (t or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, t, *_ in rows:
        b = (t or "").encode()
        again = b in first and i != first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return key(out)


@pytest.mark.parametrize("files, size", [(1, "128m"), (3, "128m"), (1, "2000")])
def test_archives(spark, tmp_path, files, size):
    rows = pages(files, 60) + [(1000, "long", "<p>" + "word " * 60_000 + "</p>", "v", "f", "d")]
    rows += rows[-1:]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(files), path)
    sizes = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
    if size == "2000":
        rows = [r for r in rows if r[0] != 1000]
        path = str(tmp_path / "small")
        warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        records = warc.read_archives(spark, path)
        got = warc.page_facts(records).collect()
        uris = {r.uri for r in records.select("uri").distinct().collect()}
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert key(got) == expected_pages(rows)
    assert uris <= {None, "u%0D%0AContent-Length: 1", "long"}


def test_archives_empty_and_broken(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.page_facts(warc.read_archives(spark, path)).collect() == []
    path = str(tmp_path / "broken")
    warc.write_archives(spark.createDataFrame(pages(5, 20), PAGES).coalesce(1), path)
    (name,) = glob.glob(f"{path}/*.txt")
    whole = open(name, "rb").read()
    open(name, "wb").write(whole[: len(whole) // 2])
    (check,) = glob.glob(f"{path}/.*.txt.crc")
    open(check, "wb").write(b"")
    with pytest.raises(Exception):
        warc.page_facts(warc.read_archives(spark, path)).collect()


# 12


def cheapest(letters):
    """(cost, audit) by a search over (row, state) in order of cost, then audit."""
    todo, seen = [(0, "", 0, 0)], set()
    while todo:
        cost, audit, i, state = heapq.heappop(todo)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(letters) and state in (0, 3):
            return cost, audit
        after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(todo, (cost + 3, audit + "I", i, after))
        if i < len(letters):
            role, fault = divmod(ord(letters[i]) - 97, 4)
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state))
            if fault in (0, 3):
                more = 3 if fault else 0
                heapq.heappush(todo, (cost + 3 + more, audit + "R", i + 1, after))
                if role == 0 and state == 0:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, 1))
                if role in (1, 2) and after == role + 1:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, after))


def test_cheapest_edits(monkeypatch):
    rng, repair = random.Random(3), turns.Repair()
    for n in range(600):
        letters = "".join(rng.choice("abcdefghijklmnop") * rng.choice([1, 1, 2, 9]) for _ in range(rng.randint(0, 9)))
        assert repair.edits(letters) == cheapest(letters), letters
    monkeypatch.setattr(turns, "CHUNK", 7)
    for letters in ("e" * 50, "i" * 31 + "h" * 64 + "ei" * 20, "m" * 15 + "l" * 22):
        assert turns.Repair().edits(letters) == cheapest(letters)


def test_long_conversation():
    cost, audit = turns.Repair().edits("ei" * 50_000 + "e" * 200_001)
    assert len(audit) >= 300_001 and cost == turns.Repair().edits("e" * 200_001)[0]


def repaired(rows):
    """What the contract asks for, conversation by conversation."""
    out, talks = [], {}
    for conv, turn, role, text, *_ in rows:
        talk = talks.setdefault(conv, [])
        one = lambda x: " " if x is None else str(x)
        role, text = one(role), one(text)
        k = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            talk += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, letters = set(), ""
        for _, role, text in talk:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            letters += chr(97 + 4 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + fault)
        cost, audit = cheapest(letters)
        at, state, lines = 0, 0, []
        for edit in audit:
            if edit == "D":
                at += 1
                continue
            _, role, text = talk[at] if at < len(talk) else (0, "", "")
            if edit == "K" and role[:1] == "s":
                state = 1
            else:
                state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                role, text = (role if edit == "K" else ("user", "assistant")[state - 2]), "" if edit == "I" else text
            at += edit != "I"
            lines.append(f"{role}:{text}")
        known = {t for t, *_ in talk if t is not None}
        initials = [r[:1] for _, r, _ in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        faults = [(ord(c) - 97) % 4 for c in letters]
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return key(out)


@pytest.mark.parametrize("chunk", [1 << 16, 3])
def test_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(turns, "CHUNK", chunk)
    rng, rows = random.Random(chunk), []
    for conv in [None, *range(30)]:
        for turn in range(rng.choice([1, 2, 4, 9, 30])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if conv and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            text = rng.choice(["hi.", "hi.", "so?", "é 全!", "open", " \n", "", None, "a\nb. ", "word " * 2000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text, "x", 1, "y"))
    rows += rows[:20]
    rows += [(99, 10**6 + t, "user" if t % 3 else "assistant", f"t{t % 50}.", "x", 1, "y") for t in range(1500)]
    table = spark.createDataFrame(rows, TALKS)
    got = turns.repaired(table, turns.damaged(table)).collect()
    assert key(got) == repaired(rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], TALKS)
    assert turns.repaired(none, turns.damaged(none)).collect() == []
    only = spark.createDataFrame([(5, 1, "user", "x.", "", 0, "")], TALKS)
    (row,) = turns.repaired(only, turns.damaged(only).where("false")).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# 13


def grouped(counts):
    known = {w: n for w, n in counts.items() if n >= 3}
    letters = sorted({c for w in known for c in w})

    def near(w):
        cuts = {w[:i] + w[i + 1 :] for i in range(len(w))}
        puts = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        swaps = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return sorted(((-known[v], v) for v in (cuts | puts | swaps) - {w} if v in known))

    form, size = {}, {}
    for w in known:
        best = near(w)
        size[w] = len(best)
        form[w] = best[0][1] if best and -best[0][0] >= 2 * known[w] else None
    out = []
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, known[w], size[w], known[form[w]] if form[w] else None))
    return key(out)


def test_spelling(spark, odd_texts):
    rng = random.Random(7)
    base = ["aabbaab", "internationally", "internationallyx", "éééén", "wordword", "zzzzzz", "mañana", "configuration"]
    words = []
    for _ in range(900):
        w = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            i, how = rng.randint(0, len(w)), rng.randint(0, 2)
            w = w[:i] + ("" if how == 0 else rng.choice("abzéÿn")) + w[i + (how > 0 and how - 1) :] if how else w[: max(0, i - 1)] + w[i:]
        words += [w] * rng.choice([1, 2, 3, 3, 7, 20])
    words += ["q" * 3000] * 4 + ["q" * 2999] * 9 + ["", None, None]
    got = spelling.spelling_groups(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert key(got) == grouped(Counter(w for w in words if w))
    assert any(r.form and r.root != r.form for r in got)


def test_runs(spark, odd, odd_texts):
    def runs(rows):
        for i, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                run = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 5:
                    yield run

    assert Counter(r.word for r in spelling.damaged_runs(odd).collect()) == Counter(runs(odd_texts))
    many = [(i, "Straße Überfluß NAÏVE×÷ kleiner größer") for i in range(300)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in many], "doc_id long, text string, word string, n int")
    want = Counter(runs(many))
    assert len(want) > 5 and Counter(r.word for r in spelling.damaged_runs(table).collect()) == want


def test_no_words(spark, none):
    assert spelling.spelling_groups(spelling.damaged_runs(none)).collect() == []


# columns of callers that are named like those of an operator


def test_callers_columns_stay(spark):
    from tallygrade.llm import decontamination, secrets

    kinds = "doc_id long, text string, n_chars int, k_ string, runs_ string, row_ string, k string, start string"
    secret = "password = abcDEF123456789xyz"
    rows = [(1, f"see {secret} here", 99, "a", "b", "c", "d", "e"), (2, None, None, "a", "b", "c", "d", "e"), (3, "plain words", 11, "a", "b", "c", "d", "e")]
    table = spark.createDataFrame(rows, kinds)
    got = {r.doc_id: tuple(r) for r in secrets.redacted(table).collect()}
    assert got[1] == (1, "see [SECRET] here", 17, *rows[0][3:]) and got[2] == rows[1] and got[3] == rows[2]
    benchmark = spark.createDataFrame([(1, "plain words"), (2, None)], "item_id long, text string")
    assert key(decontamination.without_contaminated(table, benchmark).collect()) == key(rows[:2])


# 9: pages on which names mislead


PARA = "This is a fairly long paragraph of plain text with many words in it, so that its density is high enough to win."


@pytest.mark.parametrize("page, lines", [
    (f'<article><div class="entry-header"><h1>Head</h1></div><p>{PARA}</p></article>', ["Head", PARA]),
    (f'<div class="layout with-sidebar"><div><h2>T</h2><p>{PARA}</p><p>{PARA}</p></div><div class="sidebar"><p>Side text</p></div></div>', ["T", PARA, PARA]),
    (f'<article><p>{PARA}</p><ul><li><a href=a>First reference</a></li><li><a href=b>Second one</a></li></ul><p><a href=c>nearly all is a link</a> x</p></article>', [PARA, "First reference", "Second one", "nearly all is a link x"]),
    (f'<article><p>Let <math><mi>x</mi></math> be <label>that</label>. {PARA}</p><div class="social-history"><p>{PARA}</p></div></article>', [f"Let x be that. {PARA}", PARA]),
    (f'<article><p>{PARA}</p><div class="ad-box"><p>Buy</p></div><div class="comment-list"><p>{PARA}</p></div><div id="related-posts">More</div><div class="cookie-notice">Ok</div></article>', [PARA]),
])
def test_names_do_not_take_text_away(page, lines):
    from tallygrade.llm import html

    assert html.main_text(f"<html><body>{page}</body></html>") == "\n".join(lines)


def test_deep_pages_take_linear_time():
    import time

    from tallygrade.llm import html

    started = time.time()
    for inner in ("<b>" * 100_000 + PARA + "</b>" * 100_000, "<div>" * 30_000 + PARA, "<article>" * 20_000 + PARA, "<p>" * 50_000 + PARA):
        assert html.main_text(f"<body><p>{inner}</body>").endswith(PARA)
    assert time.time() - started < 20
