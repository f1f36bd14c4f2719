"""The pipeline against brute force, stage by stage, and its entry points."""

import random
import re

import corpus_pipeline
import __spark_entry__ as project
from test_jaccard import expected
from test_operators import LOW, base_spans

from tallygrade.llm import rules

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    """Good and bad documents, near copies, benchmark passages and secrets."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(18)) for i in range(6)]
    rows = [(i, prose(rng.randint(25, 120))) for i in range(150)]
    rows += [(200 + i, " ".join(w + "***" for w in prose(60).split())) for i in range(50)]
    for i in range(40):  # near copies
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w)))
    rows += [(400 + i, f"{prose(30)} {items[i % 6][1]} {prose(10)}") for i in range(12)]
    rows += [(500 + i, f"{prose(30)} token = '{rng.getrandbits(128):032x}' {prose(5)}") for i in range(8)]
    rows += [(600, None), (601, ""), (602, "too short"), (None, prose(40))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 200 <= i < 300), 0) for i, _ in rows if i is not None and i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in rules.quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.kept}
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        results.append(docs.collect())
        if k < 4:
            assert docs.dtypes == spark.read.parquet(f"{folder}/documents.parquet").dtypes
    one = [(i, t) for i, t in rows if i in kept]
    assert {r.doc_id for r in results[0]} == kept and not any(200 <= (i or 0) < 300 for i in kept)
    assert sum(i is not None and i < 150 for i in kept) >= 148
    groups = expected([(i, t) for i, t in one if i is not None], 5, 80)
    two = [(i, t) for i, t in one if i is None or groups[i][1] == i]
    assert sorted((r.doc_id, r.text) for r in results[1] if r.doc_id is not None) == sorted(x for x in two if x[0] is not None)
    assert len(two) < len(one) and len(results[1]) == len(two)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    windows = {tuple(w[a : a + 10]) for w in (split(t) for _, t in items) for a in range(len(w) - 9)}
    three = [(i, t) for i, t in two if not any(tuple(split(t)[a : a + 10]) in windows for a in range(len(split(t))))]
    assert sorted(((r.doc_id or -1), r.text) for r in results[2]) == sorted(((i or -1) if i != 0 else -1, t) for i, t in three)
    four = {}
    for i, t in three:
        for a, _, z in reversed(merged(base_spans(t))):
            t = t[:a] + "[SECRET]" + t[z:]
        four[i] = t
    assert {r.doc_id: (r.text, r.n_chars) for r in results[3]} == {i: (t, len(t)) for i, t in four.items()}
    assert {r.doc_id for r in results[4]} == set(four)
    again = corpus_pipeline.run(spark, folder)
    names = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted((tuple(r[n] for n in names) for r in again.collect()), key=repr) == sorted((tuple(r[n] for n in names) for r in results[4]), key=repr)


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path / "none")
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def merged(spans):
    out = []
    for a, k, z in spans:
        if out and a <= out[-1][2]:
            out[-1] = (out[-1][0], k, max(z, out[-1][2]))
        else:
            out.append((a, k, z))
    return out


def test_registered():
    known = project.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in known if re.match(r"op\d+_", k)}
    assert "pipeline" in known and set(project.oracle_sql()) <= set(known)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
