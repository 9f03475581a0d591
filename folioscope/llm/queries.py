"""Query forms of the operators of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import embeddedup, filteraudit, htmltext, langid, merkle, mixing, pii, postings, secrets, spans
from folioscope.llm.bpecodec import encode_decode
from folioscope.llm.minhash import near_duplicates
from folioscope.llm.tokencount import count_tokens
from folioscope.llm.topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept out of training: crc32 of its id, as text, mod 3 is 1; not so without an id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~held_out()))
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def _digests(found: str, names: tuple[str, ...], base: int) -> list[Column]:
    """Counts of the base kinds, the hash of the base spans, and all spans."""
    kept = F.filter(found, lambda s: s["kind"] < base)
    counts = [spans.count(F.col(found), k).alias(f"n_{names[k]}") for k in range(base)]
    return [*counts, F.sha2(spans.joined(kept, names), 256).alias("base_sha256"), spans.joined(F.col(found), names).alias("spans")]


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    models = secrets.fit(secrets.labelled_sample(spark).union(secrets.ordinary_identifiers(documents)))
    found = secrets.scan(documents, models)
    return found.select("doc_id", *_digests("secrets", secrets.KINDS, 3))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "title", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.fit(documents))
    return found.select("doc_id", *_digests("pii", pii.KINDS, pii.BASE))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor gives the largest long for what is beyond it, which would be another vector
    within = F.forall(value, lambda x: F.abs(x * 64) < F.lit(2.0**63))
    whole = F.when(finite, F.when(within, F.transform(value, lambda x: F.floor(x * 64))).otherwise(F.raise_error(F.lit("a component times 64 is beyond the range of long")).cast("array<bigint>")))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector"))
    return top_k(vectors, "vec_id % 20 = 0", k=20)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at least once, and small sources up to twice."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    return mixing.mix(documents, F.col("words"), max_repeats=2.0).select("doc_id", "source", "mix_tokens", "mix_pass", "mix_end")


def op11_ann_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.approximate_neighbours(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering: half the documents, by crc32 of the id, lose their line feeds."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered={"text": text})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_html_text": op7_html_text,
    "op8_pii": op8_pii,
    "op9_exact_topk": op9_exact_topk,
    "op10_source_mixing": op10_source_mixing,
    "op11_ann_postings": op11_ann_postings,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_minhash_dedup": """
with recursive w as (
    select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] as words
    from documents),
sets as (
    select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
        else list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]) end as s
    from w),
sized as (select doc_id, len(s) as n from sets),
held as (select doc_id, unnest(s) as shingle from sets),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from held a join held b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join sized p on x = p.doc_id join sized q on y = q.doc_id where 100 * c >= 85 * (p.n + q.n - c)),
edges as (select x, y from links union select y, x from links union select doc_id, doc_id from sized),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x),
found as (select x as doc_id, min(y) as component_id from reach group by 1)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sized join found using (doc_id)
""",
    "op5_embedding_dedup": """
with recursive v as (
    select vec_id, cast(embedding as double[]) as e from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
edges as (select x, y from links union select vec_id, vec_id from embeddings),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x),
found as (select x as vec_id, min(y) as component_id from reach group by 1),
counted as (select x as vec_id, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from found left join counted using (vec_id)
""",
    "op9_exact_topk": """
with v as (
    select vec_id, [floor(64 * cast(x as double)) for x in embedding] as e
    from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
    from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
    from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
""",
    "op12_merkle_manifest": """
with recursive hashed as (
    select doc_id, source, text, crc,
        sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
        case when crc % 2 = 0 and text like '%' || chr(10) || '%' then sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) end as tampered
    from (
        select doc_id, source, text,
            coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
            xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(doc_id::varchar, '')]),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) as crc
        from documents)),
placed as (select *, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as w from hashed),
tree(source, level, i, h, w) as (
    select source, 0, i, leaf, w from placed
    union all
    select source, level + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((w + 2) // 3) from tree where w > 1 group by source, level, i // 3),
subroots as (select source, h, row_number() over (order by source nulls first) - 1 as i, count(*) over () as w from tree where w = 1),
top(level, i, h, w) as (
    select 0, i, h, w from subroots
    union all
    select level + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((w + 2) // 3) from top where w > 1 group by level, i // 3),
low_runs as (select source, level, i // 3 as j, list(h order by i) as hs from tree where w > 1 group by all),
top_runs as (select level, i // 3 as j, list(h order by i) as hs from top where w > 1 group by all),
climb(doc_id, source, level, i, folded, siblings) as (
    select doc_id, source, 0, i, coalesce(tampered, leaf), '' from placed
    union all
    select c.doc_id, c.source, c.level + 1, c.i // 3, sha256(array_to_string(r.hs[: c.i % 3] || [c.folded] || r.hs[c.i % 3 + 2 :], '')), c.siblings || array_to_string(r.hs[: c.i % 3] || r.hs[c.i % 3 + 2 :], '')
    from climb c join low_runs r on r.source is not distinct from c.source and r.level = c.level and r.j = c.i // 3),
climbed as (select doc_id, source, arg_max(folded, level) as folded, arg_max(siblings, level) as siblings from climb group by all),
over_it(doc_id, level, i, folded, siblings) as (
    select c.doc_id, 0, s.i, c.folded, c.siblings from climbed c join subroots s on s.source is not distinct from c.source
    union all
    select c.doc_id, c.level + 1, c.i // 3, sha256(array_to_string(r.hs[: c.i % 3] || [c.folded] || r.hs[c.i % 3 + 2 :], '')), c.siblings || array_to_string(r.hs[: c.i % 3] || r.hs[c.i % 3 + 2 :], '')
    from over_it c join top_runs r on r.level = c.level and r.j = c.i // 3),
ended as (select doc_id, arg_max(folded, level) as folded_root, sha256(arg_max(siblings, level)) as proof_sha256 from over_it group by all)
select p.doc_id, p.leaf, s.h as subroot, t.h as root, proof_sha256, folded_root, folded_root = t.h as verified
from placed p join ended using (doc_id) join subroots s on s.source is not distinct from p.source cross join (select h from top where w = 1) t
""",
    "op13_filter_audit": """
with read as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
        [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] as words
    from documents),
told as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1),
judged as (
    select part, n_fails, coalesce(quality, 0) = 1 as good, coalesce(toxic, 0) = 1 as bad from (
        select doc_id, part,
            (case when len(words) < 50 then 1 else 0 end)
            + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
            + (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 4 else 0 end)
            + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
            + (case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end) as n_fails
        from read) left join told using (doc_id)),
kinds as (select part, n_fails as m, good, bad, count(*) as n from judged group by all),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
    select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps as (
    select filter_order, step, l.bit, coalesce((select sum(p.bit) from letters p where instr(filter_order, p.letter) < step), 0)::bigint as before
    from orders, range(1, 6) r(step), letters l where l.letter = substr(filter_order, step, 1)),
counted as (
    select part, filter_order, step, s.bit,
        sum(case when m & (before | s.bit) = 0 then n else 0 end) as kept,
        sum(case when m & before = 0 and m & s.bit <> 0 then n else 0 end) as removed,
        sum(case when m & before <> 0 and m & s.bit <> 0 then n else 0 end) as redundant,
        sum(case when m = s.bit then n else 0 end) as unique_fails,
        sum(case when m & before = 0 and m & s.bit <> 0 and good then n else 0 end) as good_lost,
        sum(case when m & before = 0 and m & s.bit <> 0 and bad then n else 0 end) as toxic_lost
    from kinds, steps s group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
    cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
    cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from counted
""",
}
