"""The pipeline's stages against what its operators decide one by one."""

import random

import corpus_pipeline
from cairn.llm import line_dedup, quality_rules, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    (_, quality), (_, lines), (_, near), (_, scan), (_, pack) = corpus_pipeline.STAGES
    one = quality(spark, docs, sf).cache()
    assert one.columns == columns
    assert {r[0] for r in one.select("doc_id").collect()} == {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    two = lines(spark, one, sf).cache()
    gone = {r["doc_id"]: {int(x) for x in r["removed_lines"].split(",") if x} for r in line_dedup.report(one).collect()}
    want = {}
    for r in one.collect():
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone[r["doc_id"]])
        if not gone[r["doc_id"]] or text.split():
            want[r["doc_id"]] = (text, len(text) if gone[r["doc_id"]] else r["n_chars"])
    assert two.columns == columns and {r["doc_id"]: (r["text"], r["n_chars"]) for r in two.collect()} == want
    three = near(spark, two, sf).cache()
    assert {r[0] for r in three.select("doc_id").collect()} == {r["component_id"] for r in simhash.near_duplicates(two).collect()}
    four = scan(spark, three, sf).cache()
    assert four.columns == columns and four.count() == three.count()
    five = pack(spark, four, sf)
    assert {r["doc_id"] for r in five.collect()} == {r[0] for r in four.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf).count() == five.count()


def test_near_copies_beyond_two_bits_go(spark):
    """Documents whose five-word shingles have Jaccard 0.8 or more, though their fingerprints are further apart."""
    rnd, rows = random.Random(21), []
    for i in range(20):
        words = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        rows.append((i, " ".join(words[:50]) + "\n" + " ".join(words[50:])))
        for at in range(rnd.randrange(2), 100, 50):
            words[at] = "changed"
        rows.append((100 + i, " ".join(words)))
        rows.append((200 + i, " ".join(words[:60] + [f"w{rnd.randrange(5000)}" for _ in range(40)])))
    sets = {k: {tuple(t.split()[j : j + 5]) for j in range(96)} for k, t in rows}
    prints = {k: simhash.fingerprint(t) for k, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(similar(i, 100 + i) and not similar(100 + i, 200 + i) and not similar(i, 200 + i) for i in range(20))
    assert any(bin((prints[i] ^ prints[100 + i]) & (1 << 64) - 1).count("1") > 2 for i in range(20))
    df = spark.createDataFrame(rows + [(None, rows[0][1])], "doc_id long, text string")
    _, near = corpus_pipeline.STAGES[2]
    assert {r[0] for r in near(spark, df, "").select("doc_id").collect()} == {None} | set(range(20)) | set(range(200, 220))
