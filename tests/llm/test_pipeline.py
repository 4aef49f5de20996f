import numpy as np

import corpus_pipeline
from gondola.llm.runtime import written


def prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def test_stages_take_effect_in_order(spark, tmp_path, rows_of):
    rng = np.random.default_rng(1)
    docs = [(i, prose(rng, 150)) for i in range(120)]
    toxic = {i for i in range(120) if i % 4 == 0}
    docs = [(i, t + " vilescum horridfool" if i in toxic else t) for i, t in docs]
    passage, question = prose(rng, 60), prose(rng, 30)
    docs += [(200, docs[1][1]), (201, docs[2][1].replace(docs[2][1].split()[70], "changed", 1)), (202, f"{prose(rng, 80)} {passage} {prose(rng, 80)}"), (203, f"{prose(rng, 90)} {passage} {prose(rng, 70)}")]
    docs += [(204, f"{prose(rng, 80)} {question} {prose(rng, 90)}"), (205, None), (206, "ünïcode é" * 3)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", question)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontamination", "bpe"]
    at, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, str(tmp_path)), name)
        left[name] = {r["doc_id"]: r for r in rows_of(at)}
        if name != "bpe":
            assert at.columns == frame.columns
    everything = {i for i, _ in docs}
    assert set(left["toxicity"]) == everything - toxic
    assert set(left["simhash"]) == everything - toxic - {200, 201}
    removed = {i: t for i, t in docs if i in left["suffix_dedup"] and left["suffix_dedup"][i]["text"] != t}
    assert set(removed) == {203} and passage not in left["suffix_dedup"][203]["text"] and passage in left["suffix_dedup"][202]["text"]
    assert set(left["decontamination"]) == everything - toxic - {200, 201, 204}
    assert set(left["bpe"]) == set(left["decontamination"])
    assert {r["doc_id"] for r in rows_of(corpus_pipeline.run(spark, str(tmp_path)))} == set(left["bpe"])


def test_contamination_is_decided_by_row(spark, tmp_path, rows_of):
    rng = np.random.default_rng(2)
    question = prose(rng, 30)
    bad = f"{prose(rng, 20)} {question}"
    clean = [prose(rng, 60) for _ in range(4)]
    docs = [(None, bad), (None, clean[0]), (None, clean[1]), (None, None), (7, clean[2]), (7, bad), (8, clean[3]), (8, clean[3]), (9, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    spark.createDataFrame([("b1", question)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(r["doc_id"], r["text"]) for r in rows_of(corpus_pipeline.drop_contaminated(spark, frame, str(tmp_path)))]
    assert sorted(left, key=str) == sorted([d for d in docs if d[1] != bad], key=str)


def test_stages_on_odd_rows(spark, odd, none, tmp_path, rows_of):
    """Nulls, empty and long texts, repeated rows and ids, extra columns, empty tables."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "One two"), (None, None), ("c", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = odd.selectExpr("*", "1 as score", "'x' as kept", "2 as n_removed", "3 as _hash", "4 as component_id")
    rows = sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows_of(odd)), key=str)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and out.schema["text"].dataType.simpleString() == "string"
        left[name] = sorted((tuple(r) for r in out.collect()), key=str)
        assert rows_of(stage(spark, none, str(tmp_path))) == []
    assert left["toxicity"] == rows  # nothing was labelled toxic and no
    ids = [r[0] for r in left["simhash"]]
    assert {3, 1, 5, 6} & set(ids) == {3, 1, 6} and len([i for i in ids if i == 2]) == 0
    assert left["decontamination"] == [r for r in rows if (r[1] or "").lower() != "one two"]
    assert len(rows_of(corpus_pipeline.encode(spark, more, str(tmp_path)))) == len(rows)


def test_repeats_by_brute_force(spark, odd, rows_of):
    """Every row of the stage by plain loops over bytes and characters."""
    bad = "caf� �kept? "
    shared = "".join(f"€{i}" for i in range(40))
    docs = [(r["doc_id"], r["text"]) for r in rows_of(odd)] + [(500, f"x{shared}y"), (501, f"{bad}{shared} two�"), (502, shared), (503, f"é{shared[1:]}")]
    frame = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for at in range(len(raw) - 49):
            first[raw[at : at + 50]] = min(key(i), first.get(raw[at : at + 50], key(i)))
    expected = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 49):
            if first[raw[at : at + 50]] < key(i):
                gone[at : at + 50] = True
        out, at = "", 0
        for c in t or "":
            out += "" if gone[at : at + len(c.encode())].any() else c
            at += len(c.encode())
        if not gone.any():
            expected.append((i, t, 7))
        elif out:
            expected.append((i, out, len(out)))
    found = [(r["doc_id"], r["text"], r["n_chars"]) for r in rows_of(corpus_pipeline.drop_repeats(spark, frame, ""))]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert any(r[0] == 501 and r[1].startswith(bad) and r[1].endswith("�") for r in found) and not any(r[0] == 502 for r in found)
