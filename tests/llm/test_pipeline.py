"""The pipeline on planted cases: each stage on what its predecessor kept."""

import numpy as np
import pytest

import corpus_pipeline
from folio.llm import packing
from folio.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(seed, n, words=1200):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnoprstuvw"))
    vocabulary = ["".join(letters[np.random.default_rng(k).integers(0, 22, 5)]) for k in range(words)]
    return " ".join(vocabulary[k] for k in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Ids by case; texts have three lines each."""
    rows, labels = {}, []
    body = lambda k: "\n".join(prose(10 * k + j, 30) for j in range(3))
    for k in range(300):
        rows[k] = body(k)
        if k % 5 == 0:
            words = rows[k].split(" ")
            marks = ["stupidly", "moronic", "pathetic", "worthless"]
            words[::6] = [marks[j % 4] for j in range(len(words[::6]))]
            rows[k] = " ".join(words)
        labels.append((k, 1, int(k % 5 == 0)))
    item = prose(99_999, 40)
    leaks, copies, marked = [1001, 1002], [301, 1011, 1012, 1013], list(range(1020, 1030))
    rows |= {i: body(i) + " " + item.upper() + " " + prose(i, 20) for i in leaks}
    rows |= {i: body(301) for i in copies}
    rows[1013] = rows[1013] + " tail"
    notice = "Copyright 2020 by the makers of this page"
    rows |= {i: f"{prose(7000 + i, 25)}\n{notice}\n{prose(8000 + i, 25)}" for i in marked}
    rows |= {1040: "", 1041: None}
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    clean = [k for k in range(300) if k % 5] + marked + [301, 1040, 1041]
    return {"dir": str(path), "rows": rows, "toxic": [k for k in range(300) if k % 5 == 0], "clean": clean, "leaks": leaks, "copies": copies, "marked": marked, "notice": notice}


def test_stages(spark, planted, tmp_path):
    docs = spark.read.parquet(f"{planted['dir']}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, planted["dir"])
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[k] = docs.collect()
    ids = {k: {r["doc_id"] for r in rows} for k, rows in seen.items()}
    everything = set(planted["rows"])
    assert everything - ids[0] == set(planted["toxic"])
    texts = {r["doc_id"]: r["text"] for r in seen[1]}
    assert ids[1] == ids[0]
    assert all(texts[i] == planted["rows"][i].replace(planted["notice"] + "\n", "") for i in planted["marked"])
    assert all(texts[i] == planted["rows"][i] for i in ids[0] - set(planted["marked"]))
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in seen[1])
    assert ids[1] - ids[2] == set(planted["copies"][1:])
    assert ids[2] - ids[3] == set(planted["leaks"])
    assert ids[3] == set(planted["clean"])
    encode = packing.Tokenizer(tokenizer_path()).encode
    tokens = sum(len(encode(r["text"] or "")) + 1 for r in seen[3])
    assert ids[4] == ids[3] and sum(r["length"] for r in seen[4]) == tokens


def test_run_gives_the_stages_result(spark, planted):
    got = corpus_pipeline.run(spark, planted["dir"])
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == set(planted["clean"])


def test_run_of_an_empty_table(spark, planted, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted['dir']}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
