from pyspark.sql import functions as F

from gondola.llm import chat, queries


def render(turns):
    text, spans = "", []
    for _, role, said in turns:
        head = f"<|{role or ''}|>\n"
        line = f"{head}{said or ''}<|end|>\n"
        if role == "assistant":
            spans.append((len(text) + len(head), len(text) + len(line)))
        text += line
    return text, spans


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1
    chosen, cs = render(a[n:])
    rejected, rs = render(b[n:])
    return n, render(a[:n])[0], chosen, cs, rejected, rs


def flat(r):
    spans = lambda x: [(s["start"], s["end"]) for s in x]
    return r["n_prompt_turns"], r["prompt"], r["chosen"], spans(r["chosen_spans"]), r["rejected"], spans(r["rejected_spans"])


def pairs(df):
    return chat.preference_pairs(df, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 != 0)


def test_query(spark, sf_dir, rows_of):
    turns = {}
    for r in sorted(rows_of(queries.table(spark, sf_dir, "conversations")), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    expected = {c // 2: brute(turns[c], turns[c + 1]) for c in turns if c % 2 == 0 and c + 1 in turns}
    assert {r["pair_id"]: flat(r) for r in rows_of(pairs(queries.table(spark, sf_dir, "conversations")))} == expected

    ids = sorted(c for c in turns if any(r == "assistant" for _, r, _ in turns[c]))
    last = {c: max((t, x) for t, r, x in turns[c] if r == "assistant") for c in ids}
    swap = lambda c, o: [(t, r, last[o][1]) if r == "assistant" and (t, x) == last[c] else (t, r, x) for t, r, x in turns[c]]
    expected = {c: brute(turns[c], swap(c, o)) for c, o in zip(ids, ids[1:] + ids[:1], strict=True)}  # one bucket
    out = {r["pair_id"]: r for r in rows_of(queries.op6_preference_format(spark, sf_dir))}
    text = lambda spans: ",".join(f"{a}:{b}" for a, b in spans)
    assert {i: tuple(r[c] for c in ("n_prompt_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans")) for i, r in out.items()} == {i: (*e[:3], text(e[3]), e[4], text(e[5])) for i, e in expected.items()}
    assert all(r["n_prompt_turns"] > 0 for r in out.values())


def test_swapped_replies_of_odd_rows(spark, rows_of):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 0, "user", "alone"), (None, 0, "assistant", "z"), (4, None, "assistant", "y"), (4, None, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = [tuple(r.values()) for r in rows_of(chat.swapped_replies(df.withColumn("rejected", F.lit(1))))]
    assert sorted(out, key=str) == sorted([(1, False, 0, "user", "a"), (1, False, 1, "assistant", None), (1, True, 0, "user", "a"), (1, True, 1, "assistant", "x"), *2 * [(2, False, 0, "assistant", "x"), (2, True, 0, "assistant", "y")], (4, False, None, "assistant", "y"), (4, True, None, "assistant", None), (4, False, None, None, "n"), (4, True, None, None, "n")], key=str)
    assert rows_of(chat.swapped_replies(df.limit(0))) == rows_of(chat.swapped_replies(df.where("conv_id = 1"))) == []


def test_prefixes_and_odd_rows(spark, rows_of):
    rows = [
        (0, 0, "user", "hi", "x"), (0, 1, "assistant", "yes", "x"), (1, 0, "user", "hi", "x"), (1, 1, "assistant", "no", "x"),
        (2, 0, "user", None, "x"), (3, 0, "user", "", "x"), (4, 0, "user", "a", "x"), (5, 0, "user", "a", "x"), (5, 1, None, "b", "x"),
        (6, 0, "user", "alone", "x"), (None, 0, "user", "z", "x"), (8, 0, "user", "é", "x"), (9, 0, "user", "é", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    out = {r["pair_id"]: flat(r) for r in rows_of(pairs(df))}
    conv = lambda c: [(t, r, x) for i, t, r, x, _ in rows if i == c]
    assert out == {p: brute(conv(2 * p), conv(2 * p + 1)) for p in (0, 1, 2, 4)}
    assert out[0][0] == 1 and out[1][0] == 0 and out[4][2] == out[4][4] == ""
    assert rows_of(pairs(df.limit(0))) == []


def test_main_path_is_native(spark, sf_dir):
    plan = queries.op6_preference_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
