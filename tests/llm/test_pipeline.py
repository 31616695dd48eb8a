import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import test_contamination
import test_jaccard
import test_lines
import test_quality
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import contamination, quality
from scriptorium.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage keeps the columns, its decisions hold for its whole input, and run() is their composition."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), before.schema)
        assert docs.columns == columns and 0 < docs.count() <= count, name
        count = docs.count()
        if name == "quality rules":
            assert docs.count() == quality.judge(before, quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))).filter("kept").count()
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for r in docs.collect() for b in bench)
    assert contamination.clean(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == count
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, run)) == sorted(map(str, last))


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 8))) for _ in range(n))


def fixture():
    """Documents with near copies, runs of lines, benchmark passages, bad and very long texts, and labels."""
    rng = random.Random(12)
    runs = [[words(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(5, 9))] for _ in range(4)]
    bench = [(f"q{i}", words(rng, 18) + "? " + words(rng, 8) + ".") for i in range(6)] + [(None, None)]
    texts = []
    for i in range(130):
        body = [words(rng, rng.randrange(8, 25)) for _ in range(rng.randrange(2, 6))]
        if i % 4 == 0:
            body[1:1] = rng.choice(runs)
        if i % 13 == 0:
            body.insert(0, rng.choice(bench[:6])[1])
        texts.append("\n".join(body))
        if i % 9 == 0:  # near copies: a word or two changed, so no line run of theirs is left but the similarity stands
            for _ in range(2):
                w = " ".join(body).split()
                w[rng.randrange(len(w))] = "changed"
                texts.append(" ".join(w))
    texts += [words(rng, 4), "", None, "##$ %% " * 40, " ".join(f"{x}### $$$ %%%" for x in words(rng, 30).split()), words(rng, 3000), texts[3], texts[3]]
    docs = [(i, t, f"s{i % 3}", len(t or ""), "mine", i) for i, t in enumerate(texts)]
    docs += [(5, texts[5], "s1", 1, "again", 0)]
    labels = [(i, 1) for i in range(60)] + [(len(texts) - 5, 0), (len(texts) - 4, 0), (None, 1), (2, None)]
    return docs, labels, bench


def test_against_brute_force(spark, tmp_path):
    """run() against plain Python: forests' paths walked one by one, every chunk by bytes, all pairs of shingle sets, every passage, and the mix by SQL."""
    docs, labels, bench = fixture()
    schema = "doc_id long, text string, source string, n_chars int, kept string, `_id` long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "source", "n_chars", "kept", "_id", "copy"]
    got = Counter((r["doc_id"], r["text"], r["source"], r["kept"], r["_id"]) for r in got.collect())

    forests = quality.fit(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int"))

    def good(t):
        c = np.array([quality.statistics((t or "").encode())])
        x = quality.features(c)[0]
        odd = lambda f: 2.0 ** (-(sum(test_quality.path(f, k, x) for k in range(len(f.feature))) / len(f.feature)) / f.norm)
        return not quality.failed(c)[0] and all(int(odd(f) * quality.BINS) < f.step for f in forests or [])

    rows = [r for r in docs if good(r[1])]
    assert 0 < len(rows) < len(docs)
    left = test_lines.brute([(r[0], r[1]) for r in rows])
    rows = [(r[0], left[r[0], r[1]], *r[2:]) for r in rows if left[r[0], r[1]].split()]
    assert any(r[1] != docs[r[0]][1] for r in rows)
    first, unique = test_jaccard.roots(list({(r[0], r[1]) for r in rows})), {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if first[r[0]] == r[0]:
            unique.setdefault(r[0], r)
    assert len(unique) < len({r[0] for r in rows})
    rows = [r for r in unique.values() if not test_contamination.brute(bench, r[1])]
    assert len(rows) < len(unique)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    cursor = db.execute(ORACLES["op2_mix"])
    names = [c[0] for c in cursor.description]
    mixed = {x[names.index("doc_id")]: x for x in cursor.fetchall()}
    want = {}
    for r in rows:
        x = mixed[r[0]]
        if x[names.index("taken")]:
            want[r[0]] = x[names.index("taken")] // x[names.index("size")]
    assert {k[0]: n for k, n in got.items()} == want
    assert all(k[1] == unique[k[0]][1] and k[3] in ("mine", "again") for k in got)


def test_names(spark, tmp_path):
    """Every stage hands back the table's own columns and values, also where they are called as its own are."""
    docs, labels, bench = fixture()
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["_id", "_gone", "Size", "kept", "anomaly", "n_words", "N_Lines", "target", "_matches", "found", "box", "id", "fp", "h", "key"]
    own = spark.createDataFrame([(*r[:3], *(f"{n}{r[0]}" for n in names)) for r in docs], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, own, str(tmp_path))
        last = name == corpus_pipeline.STAGES[-1][0]
        assert out.columns == own.columns + ["copy"] * last, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name


def test_empty(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_small_arrow_batches(spark, tmp_path):
    """What a stage hands to Python workers at once stays small, however much a task reads."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 200000)").alias("text"))
    spark.createDataFrame([(1, "a benchmark item of a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == 24
    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 24 and max(r["bytes"] for r in got) <= 2 * corpus_pipeline.ARROW_BYTES


def test_tasks_of_small_tables(spark):
    """Near-duplicates of a small table take few tasks, however many partitions a shuffle has: each task writes files of its own."""
    rows, n, held = test_jaccard.rows_of(), 32, {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, sc = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        sc.setJobGroup("near-duplicates of few rows", "")
        kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, test_jaccard.SCHEMA), SF).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert kept == set(test_jaccard.roots(rows).values())
    told = sc.statusTracker()
    stages = {s for job in told.getJobIdsForGroup("near-duplicates of few rows") for s in told.getJobInfo(job).stageIds}
    assert 0 < sum(x.numCompletedTasks for x in map(told.getStageInfo, stages) if x) <= 150 * n
