"""The operators' queries over the whole test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import bpe, chat, decontam, divergence, license_scan, part_codes, repeated_windows, sharding, simhash, suffix_dedup, token_store, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.interleave_shards(narrow, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels").where(toxicity.learnable()))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", "predicted", "n_matches")


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable("embedding"))
    return topk.top_k(vectors.select("vec_id", topk.quantised("embedding").alias("v")), F.col("vec_id") % 20 == 0)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.labelled(license_scan.scan_notices(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation chosen; rejected with the last reply of another."""
    turns = chat.swapped_replies(table(spark, sf_dir, "conversations"))
    made = chat.preference_pairs(turns, F.col("conv_id"), F.col("rejected"))
    return made.select("pair_id", "n_prompt_turns", "prompt", "chosen", chat.span_text("chosen_spans").alias("chosen_spans"), "rejected", chat.span_text("rejected_spans").alias("rejected_spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    found = decontam.contamination(decontam.search(index, table(spark, sf_dir, "benchmark")))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_store.read_tokens(manifest)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, smoothing=5, top=50)


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_windows.remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_stratified_shards,
        op2_toxicity,
        op3_pivot_top_k,
        op4_license_scan,
        op5_bpe_round_trip,
        op6_preference_format,
        op7_decontamination,
        op8_simhash_components,
        op9_repeated_passages,
        op10_token_files,
        op11_source_divergence,
        op12_part_codes,
        op13_repeated_windows,
    )
}

# Fixed value: what is no word of a lower-cased text.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Fixed value: what is no letter of a lower-cased text, of ASCII.
_TERMS = _WORDS.replace(r"\x00-\x2F\x3A-\x60\x7B-\x7F", r"\x00-\x40\x5B-\x60\x7B-\x7F")


def _rate(count: str, keys: str) -> str:
    return f"cast(1 + (1000000000::hugeint * ({count} + 5)) // (sum({count}) over (partition by {keys}) + 5 * count(*) over (partition by {keys})) as bigint)"


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and replacement, each as two named tables."""
    near = "(select p, part, any_value(w) as w, min({{'d': list_inner_product(part, part) - 2 * list_inner_product(part, c) + list_inner_product(c, c), 'k': k}}) as m from d join b{0} using (p) group by p, part)"
    out = []
    for r in range(rounds):
        out.append(f"a{r} as materialized {near.format(r)}")
        mean = f"select p, k, list(c order by i) as c from (select p, k, i, floor(sum(w * c) / sum(w)) as c from (select p, m.k as k, w, unnest(part) as c, generate_subscripts(part, 1) as i from a{r}) group by p, k, i) group by p, k"
        out.append(f"b{r + 1} as materialized (select p, k, coalesce(n.c, b{r}.c) as c from b{r} left join ({mean}) n using (p, k))")
    return ",\n".join([*out, f"a{rounds} as materialized {near.format(rounds)}"])


ORACLES: dict[str, str] = {
    "op3_pivot_top_k": """with e as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s qualify rank <= 20""",
    "op7_decontamination": f"""with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
i as (select distinct coalesce(cast(item_id as varchar), 'null') as item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as line from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as k from (select *, least(13, len(w)) as n from i where len(w) > 0))),
pl as (select r, k, n, array_to_string(w[k:k + n - 1], ' ') as line from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from win) where len(w) >= n)),
hit as (select r, k, n, item_id from pl join win using (n, line)),
cover as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hit) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hit) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cover using (r) left join items using (r)""",
    "op9_repeated_passages": """with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as h from documents),
s as (select r, doc_id, k, h[k + 1:k + 50] as piece from (select r, doc_id, h, unnest(range(0, octet_length(h) - 49)) as k from d where octet_length(h) >= 50)),
low as (select piece, min(doc_id) as first from s group by piece having count(*) > 1),
hit as (select r, k, lag(k) over (partition by r order by k) as before from s join low using (piece) where first < doc_id),
run as (select r, min(k) as a, max(k) + 50 as z from (select r, k, count(*) filter (before is null or before + 50 < k) over (partition by r order by k) as g from hit) group by r, g),
cut as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as left_at from run),
kept as (select r, sum(z - a) as n_removed, count(*) as n_spans, string_agg(hex(h[left_at + 1:a]), '' order by a) || hex(any_value(h)[max(z) + 1:octet_length(any_value(h))]) as line from cut join d using (r) group by r)
select doc_id, octet_length(h) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(line, hex(h)))) as kept_sha256
from d left join kept using (r)""",
    "op11_source_divergence": f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS} as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as total from t group by all having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from t group by all),
g as (select distinct lang, source from d),
grid as (select lang, source, term, coalesce(n, 0) as n, total from g join kept using (lang) left join c using (lang, source, term)),
p as (select *, {_rate('n', 'lang, source')} as p, {_rate('total', 'lang, source')} as q from grid),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
v as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank from v qualify part = 'pair' or rank <= 50""",
    "op12_part_codes": f"""with e as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
x as materialized (select r, vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] as part from e, (select unnest(range(4)) as p)),
d as materialized (select p, part, count(*) as w from x group by all),
b0 as materialized (select p, row_number() over (partition by p order by vec_id, r) - 1 as k, part as c from x qualify k < 256),
{_lloyd(4)},
s as (select sha256(string_agg(array_to_string(list_transform(c, lambda y: cast(cast(y as bigint) as varchar)), ','), ',' order by p, k)) as codebooks_sha256 from b4),
o as (select r, vec_id, label, string_agg(printf('%02x', m.k), '' order by p) as code, cast(sum(m.d) as bigint) as error from x join a4 using (p, part) group by all)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from o, s""",
    "op13_repeated_windows": r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, doc_id, k, array_to_string(w[k:k + 49], ' ') as line from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as k from d where len(w) >= 50)),
low as (select line, min(doc_id) as first from win group by line),
cover as (select distinct r, unnest(range(k, k + 50)) as i from win join low using (line) where first < doc_id),
gone as (select r, count(*) as n from cover group by r),
stay as (select r, string_agg(x, ' ' order by i) as line from (select r, unnest(w) as x, generate_subscripts(w, 1) as i from d) anti join cover using (r, i) group by r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(line, '')) as kept_sha256
from d left join gone using (r) left join stay using (r)""",
}
