import random
import re

from gondola.llm import license_scan, queries

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def matches(docs, out):
    texts = sorted((str(r["doc_id"]), base(r["text"])) for r in docs)
    return texts == sorted((str(r["doc_id"]), (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in out)


def test_query(spark, sf_dir, rows_of):
    out = rows_of(queries.op4_license_scan(spark, sf_dir))
    assert matches(rows_of(queries.table(spark, sf_dir, "documents")), out)
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)
    assert any(r["n_base"] for r in out)


def test_fuzzy_notices(spark, rows_of):
    texts = ["Permission is herby granted, free of charge, to any persn obtaining a copy", "the APACHE   LICENSE apache license", "smit license", "GNU lesser generl public license", "mité license", "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in rows_of(license_scan.labelled(license_scan.scan_notices(df)))}
    assert out[0]["labels"] == "mit" and out[0]["n_base"] == 0 and 0 < out[0]["score"] < 1
    assert [s["edits"] for s in out[0]["spans"]] == [2]
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["last_word"]) == (2, 1, 3)
    assert out[2]["n_base"] == out[4]["n_base"] == out[5]["n_base"] == 0
    assert "lgpl" in out[3]["labels"] and out[5]["labels"] == "" and out[5]["score"] == 0


def test_odd_rows(odd, none, rows_of):
    assert matches(rows_of(odd), rows_of(license_scan.labelled(license_scan.scan_notices(odd))))
    assert rows_of(license_scan.scan_notices(none)) == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def naive(line, known):
    """Labels of notices within their edits of some run of whole words."""
    words = line.split(" ")
    runs = [" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)]
    return {n.label for n in known if any(abs(len(r) - len(n.words)) <= n.edits and n.telling.issubset(r.split(" ")) and distance(r, n.words) <= n.edits for r in runs)}


def test_edited_notices_against_edit_distance():
    rng, known = random.Random(6), license_scan.notices()
    scanner = license_scan.Scanner(known)
    for _ in range(150):
        notice = rng.choice(known)
        text = list(notice.words)
        for _ in range(rng.randint(0, notice.edits + 1)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
        line = " ".join(["ab", "cde"] * rng.randint(0, 2) + ["".join(text)] + ["zz", "of"] * rng.randint(0, 2))
        line = " ".join(line.split())
        expected = naive(line, known)
        found = {known[i].label for i, _, _, edits, whole in scanner.spans(line) if edits or whole}
        exact = {n.label for n in known if f" {n.words} " in f" {line} "}
        assert found <= expected and exact <= found and (exact or found == expected), line


def test_false_notices(spark, rows_of):
    texts = ["a unit license was issued", "so it licensed under", "visit license plate", "licensed under CC BY-NC 4.0", "licensed under CC-BY-SA 4.0", "licensd under CC BY-NC 4.0", "keit licensed under"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["labels"] for r in rows_of(license_scan.labelled(license_scan.scan_notices(df)))}
    assert out == {0: "", 1: "", 2: "", 3: "cc-by-nc", 4: "cc-by-sa", 5: "cc-by-nc", 6: ""}
