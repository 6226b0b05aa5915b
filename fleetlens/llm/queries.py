"""The registered queries: one per operator, over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_recipes import exact_dedup
from .common import table, text_or_empty
from .cotraining import cotrained_quality
from .decontam import contaminated
from .lexical import lexical_search
from .line_dedup import MIN_CHARS, UNIT, line_dedup
from .merkle import LEAF, PARAGRAPH, SECTION, SENTENCE, neighbour_fingerprints
from .mixing import temperature_mix
from .page_diff import page_diff
from .periodic import collapse_runs
from .secret_scan import BASE, MORE, secret_scan
from .simhash import simhash_dedup
from .suffix_dedup import suffix_dedup
from .warc import warc_round_trip


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``removed`` as text: unit:start:end:first_doc:first_unit, comma-joined."""
    spans = F.transform("removed", lambda g: F.concat_ws(":", g["unit"], g["start"], g["end"], g["first_doc"], g["first_unit"]))
    return line_dedup(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join(spans, ","))


def op2_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrained_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op7_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is left; the spans and bytes themselves are the operator's."""
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix(table(spark, sf_dir, "documents"), budget="cover", max_passes=MIX_PASSES)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the periodic tails of the query's contract: one document in ten repeats its words from ``a`` on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    found = F.regexp_extract_all(text_or_empty("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    picked = docs.select("doc_id", "text", F.when(h % 10 == 0, found).alias("found"), F.floor(h / 10).alias("g"))
    n = F.size("found")
    tail = picked.select("*", F.when(n > 0, F.col("g") % n).alias("a")).select(
        "*", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).alias("p")
    )
    moved = F.transform("found", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("found", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    ))
    return tail.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(collapsed: DataFrame) -> DataFrame:
    """The greatest run (ties: smallest start, then period) and digests of all runs and of the text that is left."""
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, period: long, length: long>"), lambda b, r: F.when(
        b.isNull() | (r["length"] > b["length"]), r).otherwise(b))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return collapsed.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(F.transform("runs", line), "").alias("listed"), "text",
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(collapse_runs(planted_runs(table(spark, sf_dir, "documents"))))


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


MIX_PASSES = 2.0

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chunk_recipes": op2_chunk_recipes,
    "op3_secret_scan": op3_secret_scan,
    "op4_cotraining": op4_cotraining,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_page_diff": op7_page_diff,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_temperature_mix": op9_temperature_mix,
    "op10_simhash": op10_simhash,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_fingerprints": op13_merkle_fingerprints,
}

_UNITS = rf"""
with units as (
    select doc_id, generate_subscripts(parts, 1) - 1 as unit, unnest(parts) as raw
    from (select doc_id, regexp_extract_all(coalesce(text, ''), '{UNIT}') as parts from documents)
), normed as (
    select *, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as norm,
        coalesce(sum(length(raw)) over before, 0) as start, coalesce(sum((raw = chr(10))::int) over before, 0) as line
    from units window before as (partition by doc_id order by unit rows between unbounded preceding and 1 preceding)
), part as (select *, length(norm) >= {MIN_CHARS} as takes_part from normed
), ranked as (
    select *, first_value(doc_id) over w as first_doc, first_value(unit) over w as first_unit,
        takes_part and row_number() over w > 1 as gone
    from part window w as (partition by norm, takes_part order by doc_id, unit)
), lines as (
    select doc_id, line, string_agg(raw, '' order by unit) filter (not gone and raw <> chr(10)) as left_over, bool_or(gone) as touched,
        count(*) filter (raw <> chr(10)) as n, count(*) filter (gone) as n_gone,
        string_agg(unit || ':' || start || ':' || (start + length(raw)) || ':' || first_doc || ':' || first_unit, ',' order by unit) filter (gone) as spans
    from ranked group by doc_id, line
), ends as (select doc_id, 1 + max(line) as line from ranked group by doc_id having max_by(raw, unit) = chr(10)
), texts as (
    select doc_id, coalesce(string_agg(coalesce(left_over, ''), chr(10) order by line) filter (left_over is not null or not touched), '') as text,
        sum(n) as n, sum(n_gone) as n_gone, string_agg(spans, ',' order by line) as spans
    from (select * from lines union all select doc_id, line, null, false, 0, 0, null from ends) group by doc_id
)
"""

ORACLE_SQL = {
    "op1_line_dedup": _UNITS + """
select doc_id, coalesce(t.text, '') as text, coalesce(n, 0)::bigint as n_units, coalesce(n_gone, 0)::bigint as n_removed,
    coalesce(spans, '') as removed, coalesce(length(t.text), 0)::bigint as n_chars
from documents left join texts t using (doc_id)
""",
    "op2_chunk_recipes": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
    doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t
""",
}


def _spans_sql() -> str:
    """Spans as in the operator: lengths of the pieces between matches and of the matches, added up."""
    def one(order: int, rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
    select doc_id, {order} as ord, '{rule.kind}' as kind, {rule.min_chars} as least,
        regexp_extract_all(text, '{pattern}', 0) as whole, regexp_extract_all(text, '{pattern}', {rule.group}) as part,
        regexp_split_to_array(text, '{pattern}') as gap
    from t"""

    found = "\n    union all".join(one(i, r) for i, r in enumerate((*BASE, *MORE)))
    counts = ",\n    ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    spans = "string_agg(kind || ':' || a || ':' || b, ',' order by a, ord)"
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents), m as ({found}
), e as (select *, unnest(range(1, len(whole) + 1)) as i from m where len(whole) > 0
), p as (
    select doc_id, ord, kind, length(part[i]) as n, least, length(whole[i]) as size,
        list_sum(list_transform(gap[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) as start
    from e
), h as (select doc_id, ord, kind, start::bigint as a, (start + size)::bigint as b from p where n >= least)
select doc_id, {counts},
    sha256(coalesce({spans} filter (ord < {len(BASE)}), '')) as base_sha256, coalesce({spans}, '') as spans
from t left join h using (doc_id) group by doc_id
"""


ORACLE_SQL["op3_secret_scan"] = _spans_sql()
ORACLE_SQL["op6_warc"] = """
with p as (
    select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n,
        max(page_id) over (partition by coalesce(html, '')) as last
    from pages
)
select page_id, n::bigint as payload_bytes, sha1(body) as payload_digest,
    case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
    case when n >= 1000 and page_id <> last then last end as refers_to
from p
"""

ORACLE_SQL["op11_lexical_search"] = r"""
with words as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents
), cells as (select doc_id, term, count(*) as tf from words group by doc_id, term
), docs as (select doc_id, sum(tf)::bigint as n from cells group by doc_id
), total as (select count(*) as docs, sum(n)::bigint as terms from docs
), asked as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
), weights as (
    select term, floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
    from cells cross join total where term in (select term from asked) group by term
), scored as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total.docs) // total.terms))))::bigint as score
    from asked join weights using (term) join cells using (term) join docs using (doc_id) cross join total
    group by item_id, doc_id
), ranked as (
    select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""

ORACLE_SQL["op13_merkle_fingerprints"] = f"""
with d as (select doc_id, coalesce(text, '') as text from documents
), n as (
    select doc_id, text, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as following from d
), e as (
    select doc_id, text, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) as edited from n
), t as (select doc_id, 'own' as kind, text as body from e union all select doc_id, 'edited', edited from e
), trees as (
    select doc_id, kind, list_transform(regexp_extract_all(body, '{SECTION}'), lambda s: list_transform(regexp_extract_all(s, '{PARAGRAPH}'),
        lambda p: array_to_string(list_transform(regexp_extract_all(p, '{SENTENCE}'), lambda x: sha256(x) || '-' || length(x)), ','))) as tree
    from t
), digests as (
    select *, list_transform(tree, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(p)), ''))) as sums from trees
), prints as (
    select doc_id, kind, sha256(array_to_string(sums, '')) || ':' || coalesce(array_to_string(list_transform(list_zip(sums, tree), lambda z: z[1][1:12] || '=' ||
        regexp_replace(array_to_string(z[2], '/'), '([0-9a-f]{{8}})[0-9a-f]{{56}}', '\\1', 'g')), ';'), '') as print
    from digests
), sets as (select *, list_distinct(regexp_extract_all(print, '{LEAF}')) as leaves from prints
), own as (
    select doc_id, print, leaves, coalesce(lead(print) over (order by doc_id desc), first_value(print) over (order by doc_id desc)) as next_print
    from sets where kind = 'own'
), other as (
    select o.doc_id, o.print, o.leaves, s.print as edited_print, s.leaves as edited_leaves, o.next_print,
        list_distinct(regexp_extract_all(o.next_print, '{LEAF}')) as next_leaves
    from own o join sets s on s.doc_id = o.doc_id and s.kind = 'edited'
), near as (
    select *, list_transform([edited_leaves, next_leaves], lambda x: coalesce(list_sum(list_transform(list_intersect(leaves, x), lambda y: split_part(y, '-', 2)::bigint)), 0)) as common,
        list_transform([leaves, edited_leaves, next_leaves], lambda x: coalesce(list_sum(list_transform(x, lambda y: split_part(y, '-', 2)::bigint)), 0)) as sizes
    from other
)
select e.doc_id, length(e.text)::bigint as n_chars, sha256(e.edited) as edited_sha256, print as fingerprint, edited_print as edited_fingerprint,
    case when split_part(print, ':', 1) = split_part(edited_print, ':', 1) then 1.0 else 2.0 * common[1]::double / (sizes[1] + sizes[2]) end as near_edited,
    case when split_part(print, ':', 1) = split_part(next_print, ':', 1) then 1.0 else 2.0 * common[2]::double / (sizes[1] + sizes[3]) end as near_next
from e join near using (doc_id)
"""
