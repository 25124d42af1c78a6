import base64
import random

import public_tokenizers as P
import tiktoken

import __spark_entry__
import corpus_pipeline


def fixture(spark, folder):
    """Clean texts, junk, copies and texts with a benchmark passage, by doc_id."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("the", "an", "wor", "sto", "hou") for b in ("se", "ne", "ld", "ther", "ing")]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    passage = prose(14)
    docs = {i: prose(rng.randint(50, 90)) for i in range(120)}
    docs |= {200 + i: " ".join(w.upper() + "!!##%%" for w in rng.choices(words, k=60)) for i in range(10)}
    docs |= {300 + i: docs[i] for i in range(5)}  # exact copies
    docs |= {400 + i: docs[i] + " these" for i in range(5)}  # near copies
    docs |= {500 + i: f"{prose(40)} {passage} {prose(40)}" for i in range(4)}
    docs |= {600: None, 601: ""}
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_take_effect(spark, tmp_path):
    docs = fixture(spark, str(tmp_path))
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), []
    rows = table
    for name, stage in list(stages.items())[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == table.columns, name
        kept.append({r["doc_id"] for r in rows.select("doc_id").collect()})
    junk, copies, leaks = set(range(200, 210)), {*range(300, 305), *range(400, 405), 601}, set(range(500, 504))
    assert kept[0] == set(docs) - junk, kept[0] ^ (set(docs) - junk)
    assert kept[1] == kept[0] - copies, kept[1] ^ (kept[0] - copies)
    assert kept[2] == kept[1] - leaks
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out.keys() == kept[2]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r["ids"] == library.encode_ordinary(docs[i] or "") and r["n_tokens"] == len(r["ids"]) for i, r in out.items())


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, "other words stand in here now")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_no_documents(spark, tmp_path):
    fixture(spark, str(tmp_path))
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    none.write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
