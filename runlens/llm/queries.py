"""The queries of this subpackage over the test tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import common, licences, lm, merkle, mixing, packing, periods, pii, positive, quality, simhash, tokens, vectors, wrapper


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder)).drop("source", "identity", "removed")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder))


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.spans(documents(spark, folder), ["doc_id"])
    counts = [pii.count(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE]
    base = F.sha2(pii.listed(F.col("spans"), pii.BASE), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.listed(F.col("spans")).alias("spans"))


def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as files: a folder per source, language and hundred of documents."""
    docs = documents(spark, folder)
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scanned(docs.withColumn("path", path), "doc_id")


def op7_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.extracted(spark.read.parquet(f"{folder}/pages.parquet"))


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return lm.scored(documents(spark, folder), held_out)


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def checked(key: str = "doc_id") -> Column:
    """Unsigned CRC-32 of the id in decimal; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def op11_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return positive.scored(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), checked() % 4 == 2)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf and proof; documents whose checksum 5 divides are presented in lower case."""
    docs = documents(spark, folder)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    lower = F.when(checked() % 5 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", merkle.leaf([*columns, F.col("text")]).alias("leaf"), merkle.leaf([*columns, lower]).alias("presented"))
    found = merkle.manifest(common.saved(rows, "digests"), "doc_id", "source", "leaf", "presented")
    told = lambda c: F.lower(F.hex(c))
    siblings = F.array_join(F.transform("proof", lambda step: told(step["siblings"])), "")
    root = F.lit(found.root.hex() if found.root else None).cast("string")
    return merkle.audited(found).select(
        F.col("key").alias("doc_id"), told(F.col("leaf")).alias("leaf"), told(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), told(F.col("folded_root")).alias("folded_root"), (told(F.col("folded_root")) == root).alias("verified"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, after the words of those whose checksum 10 divides were made to repeat."""
    docs = documents(spark, folder).select("doc_id", "text", checked().alias("h"))
    made = (F.col("h") % 10 == 0) & F.col("doc_id").isNotNull()
    loops = periods.looped(docs.where(made).withColumn("g", F.expr("h div 10")), "g")
    found = periods.found_runs(docs.where(~made | F.col("doc_id").isNull()).select("doc_id", "text").unionByName(loops))
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.when(F.size("runs") > 0, F.reduce(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), better))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_best_fit_packing, op3_simhash, op4_token_counts, op5_personal_data, op6_licence_scan, op7_embedding_duplicates, op8_html_extraction, op9_language_model, op10_source_mix,
    op11_quality_classifier, op12_merkle_manifest, op13_periodic_runs)} | {"pipeline": corpus_pipeline.run}

SEP = r"\x20\x09-\x0D"

#: Words and lines of documents, the counts within a document, and the lines above the limit. `docs` is to be defined before.
QUALITY_SQL = rf"""
w as (select doc_id, source, coalesce(text, '') body, regexp_extract_all(coalesce(text, ''), '[^{SEP}]+') w from docs),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)),
twice as (select doc_id, g from grams group by all having count(*) > 1),
rep as (select doc_id, count(distinct i + k) n from grams join twice using (doc_id, g) cross join (values (0), (1), (2)) t(k) group by 1),
lines as (select doc_id, source, line, len(regexp_extract_all(line, '[^{SEP}]+')) words,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789' || chr(9) || chr(11) || chr(12) || chr(13),
      'abcdefghijklmnopqrstuvwxyz0000000000    '), '  +', ' ', 'g'), ' ') norm
  from (select doc_id, source, unnest(string_split(body, chr(10))) line from w)),
filled as (select * from lines where words > 0),
dup as (select doc_id, count(*) - count(distinct line) n from filled group by 1),
frequent as (select source, norm from filled join (select source, count(*) docs from w group by 1) h using (source)
  group by source, norm, docs having count(distinct doc_id) > 20 and count(distinct doc_id) > 0.01 * docs),
lost as (select doc_id, sum(words) n from filled join frequent using (source, norm) group by 1),
base as (select w.doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(lost.n, 0)::bigint removed_words
  from w left join rep using (doc_id) left join dup using (doc_id) left join lost using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed_words <= 0.5 * n_words kept from base)"""

TEMPLATE_ROWS = ", ".join(f"('{a}', '{b.lower()}')" for a, b in licences.TEMPLATES)
LICENCE_SQL = f"""
with tmpl as (select row_number() over (order by body) t, licence, body from (values {TEMPLATE_ROWS}) v(licence, body)),
tterm as (select t, licence, unnest(regexp_extract_all(body, '[a-z0-9]+(?:[.][0-9]+)?')) term from tmpl),
idf as (select term, ln((1.0 + {len(licences.TEMPLATES)}) / (1 + count(distinct t))) + 1 idf from tterm group by 1),
tw as (select t, licence, term, (1 + ln(count(*))) * any_value(idf) w from tterm join idf using (term) group by 1, 2, 3),
tn as (select t, licence, term, w / sqrt(sum(w * w) over (partition by t)) v from tw),
files as (select doc_id, source || '/' || lang || '/' || (doc_id // 100) || '/' || doc_id || '.txt' path,
  source || '/' || lang || '/' || (doc_id // 100) dir, coalesce(text, '') body from documents),
sent as (select distinct doc_id, s from (select doc_id,
    unnest(string_split(regexp_replace(lower(body), '([.;!?])[ \t\r]+', '\\1' || chr(10), 'g'), chr(10))) s from files)
  where regexp_matches(s, '{licences.NOTICE}')),
sw as (select s, term, (1 + ln(count(*))) * any_value(coalesce(idf, ln(1.0 + {len(licences.TEMPLATES)}) + 1)) w
  from (select s, unnest(regexp_extract_all(s, '[a-z0-9]+(?:[.][0-9]+)?')) term from (select distinct s from sent)) left join idf using (term) group by 1, 2),
sn as (select s, term, w / sqrt(sum(w * w) over (partition by s)) w from sw),
best as (select s, licence, score from (select s, licence, round(sum(w * v), 6) score from sn join tn using (term) group by s, t, licence)
  where score >= {licences.LEAST} qualify row_number() over (partition by s order by score desc, licence) = 1),
own as (select doc_id, licence own_licence, score own_score,
    len(regexp_extract_all(s, '[^{SEP}]+')) / len(regexp_extract_all(body, '[^{SEP}]+')) share
  from sent join best using (s) join files using (doc_id)
  qualify row_number() over (partition by doc_id order by score desc, licence, share desc) = 1),
holder as (select dir holder, own_licence from own join files using (doc_id) where share >= {licences.FILE_SHARE}
  qualify row_number() over (partition by dir order by own_score desc, own_licence) = 1),
up as (select dir, holder, own_licence inherited from (select distinct dir from files) join holder on starts_with(dir || '/', holder || '/')
  qualify row_number() over (partition by dir order by length(holder) desc) = 1)
select doc_id, path, own_licence, own_score, coalesce(own_licence, inherited) licence,
  case when own_licence is null then holder end from_directory
from files left join own using (doc_id) left join up using (dir)"""

#: Unsigned CRC-32, bit by bit with its reversed polynomial.
CRC_SQL = """
registers as (select doc_id, list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
  lambda crc, b: list_reduce([xor(crc, b)] || list_transform(range(8), lambda i: 0::bigint),
    lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) register from documents)"""

#: Trees as recursive aggregation: sixteen nodes become one until one is left; a walk up from each leaf gathers and folds.
MERKLE_SQL = f"""
with recursive {CRC_SQL.strip()},
rows as (select d.doc_id, source, (coalesce(strlen(d.doc_id::varchar) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) head, text,
    case when xor(register, 4294967295) % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end shown
  from documents d join registers c on c.doc_id = d.doc_id),
leaves as (select doc_id, dense_rank() over (order by source nulls first) - 1 tree, row_number() over (partition by source order by doc_id) - 1 pos,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf, sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) shown from rows),
nodes(tree, level, pos, digest, n) as (
  select tree, 0, pos, leaf, count(*) over (partition by tree) from leaves
  union all
  select tree, level + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), (max(n) + 15) // 16 from nodes where n > 1 group by tree, level, pos // 16),
subroots as (select tree, digest from nodes where n = 1),
upper(level, pos, digest, n) as (
  select 0, tree, digest, count(*) over () from subroots
  union all
  select level + 1, pos // 16, sha256(string_agg(digest, '' order by pos)), (max(n) + 15) // 16 from upper where n > 1 group by level, pos // 16),
families as (select tree, level, pos // 16 parent, list(digest order by pos) children from nodes where n > 1 group by all),
upper_families as (select level, pos // 16 parent, list(digest order by pos) children from upper where n > 1 group by all),
walk(doc_id, tree, level, pos, digest, seen) as (
  select doc_id, tree, 0, pos, shown, '' from leaves
  union all
  select doc_id, tree, level + 1, parent, sha256(array_to_string(children[:pos % 16] || [digest] || children[pos % 16 + 2:], '')),
    seen || array_to_string(children[:pos % 16] || children[pos % 16 + 2:], '')
  from walk join families using (tree, level) where parent = pos // 16),
inner_end as (select doc_id, tree, digest, seen from walk qualify row_number() over (partition by doc_id order by level desc) = 1),
climb(doc_id, level, pos, digest, seen) as (
  select doc_id, 0, tree, digest, seen from inner_end
  union all
  select doc_id, level + 1, parent, sha256(array_to_string(children[:pos % 16] || [digest] || children[pos % 16 + 2:], '')),
    seen || array_to_string(children[:pos % 16] || children[pos % 16 + 2:], '')
  from climb join upper_families using (level) where parent = pos // 16),
ends as (select doc_id, digest folded_root, sha256(seen) proof_sha256 from climb qualify row_number() over (partition by doc_id order by level desc) = 1),
top as (select digest root from upper where n = 1)
select doc_id, leaf, s.digest subroot, root, proof_sha256, folded_root, folded_root = root verified
from leaves join subroots s using (tree) join ends using (doc_id) cross join top"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": f"with docs as (select * from documents), {QUALITY_SQL} select * from judged",
    "op6_licence_scan": LICENCE_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
}
