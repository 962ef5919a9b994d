"""The registered queries of the genomic operators, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import geo, scores as score_fn, sequence as S, tokens, variants as V
from lociflow.functions.splits import assign_split
from lociflow.operators import effects, ensemble, genotypes, guards, intervals, loocv, metrics, prepare, windows
from lociflow.operators.shared import spread
from lociflow.plans import adapters as A
from lociflow.plans.adapters import CONFIG
from lociflow.sources import assemblies, corpus, fasta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def _r(c, digits: int = 6):
    return F.round(c, digits)


# Common table expressions of the SQL side. Upper case of sharp s is written out, since DuckDB keeps the letter.
NORMAL = r"""norm AS (
    SELECT doc_id, lang, source, regexp_replace(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]', '', 'g'), '[^ACGT\P{L}]', 'N', 'g'), '[-?.]', 'N', 'g') AS n
    FROM documents
)"""
SEQS = (
    NORMAL
    + r""", seqs AS (
    SELECT doc_id::VARCHAR AS sample_id, lang AS individual_id, source AS contig, regexp_replace(n, '[^ACGTN]', '', 'g') AS sequence FROM norm
), judged AS (
    SELECT *, length(sequence) AS len,
        CASE WHEN length(regexp_replace(sequence, 'N', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(sequence, '[^GC]', '', 'g'))::DOUBLE / length(regexp_replace(sequence, 'N', '', 'g')) END AS gc,
        CASE WHEN length(sequence) = 0 THEN 0.0 ELSE length(regexp_replace(sequence, '[^N]', '', 'g'))::DOUBLE / length(sequence) END AS amb
    FROM seqs
), reasoned AS (
    SELECT *, CASE WHEN len < 200 THEN 'short_sequence' WHEN amb > 0.8 THEN 'high_ambiguity' END AS reason FROM judged
)"""
)
BLOCKS = (
    SEQS
    + r""", blk AS (
    SELECT sample_id, individual_id, contig, b * 1024 AS block_start, b * 1024 + 1024 AS block_end, substr(sequence, b * 1024 + 1, 1024) AS bases, b * 1024 AS os, least(b * 1024 + 1024, len) AS oe
    FROM (SELECT *, unnest(range(0, (len + 1023) // 1024)) AS b FROM reasoned WHERE reason IS NULL)
), blocks AS (
    SELECT *, contig || ':' || block_start || '-' || block_end AS locus_id,
        CASE WHEN ('0x' || substr(sha256('feline-locus-split-v1:' || contig || ':' || block_start || '-' || block_end), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.8 THEN 'train' ELSE 'validation' END AS split
    FROM blk WHERE oe - os >= 64
)"""
)
WINDOWS = (
    BLOCKS
    + r""", w0 AS (
    SELECT *, os + 48 * k AS window_start, os + 48 * k + 64 AS window_end, substr(bases, 48 * k + 1, 64) AS wseq
    FROM (SELECT *, unnest(range(0, (oe - os - 64) // 48 + 1)) AS k FROM blocks)
), wins AS (
    SELECT sample_id, individual_id, contig, locus_id, split, block_start, block_end, window_start, window_end, wseq,
        length(regexp_replace(wseq, '[^N]', '', 'g'))::DOUBLE / 64 AS amb,
        CASE WHEN length(regexp_replace(wseq, 'N', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(wseq, '[^GC]', '', 'g'))::DOUBLE / length(regexp_replace(wseq, 'N', '', 'g')) END AS gc
    FROM w0 WHERE length(regexp_replace(wseq, '[^N]', '', 'g'))::DOUBLE / 64 <= 0.8
)"""
)
SPANS = r"""spans AS (
    SELECT (l_orderkey % (SELECT greatest(count(*), 1) FROM documents))::VARCHAR AS sample_id, l_linenumber::BIGINT * 40 AS s, l_linenumber::BIGINT * 40 + trunc(l_quantity)::BIGINT AS e,
        CASE l_returnflag WHEN 'A' THEN 'filtered' WHEN 'N' THEN 'no_call' ELSE 'other' END AS category
    FROM lineitem
)"""
OVERLAPS = (
    WINDOWS
    + ", "
    + SPANS
    + r""", few AS (
    SELECT DISTINCT sample_id, contig, window_start, window_end, wseq FROM wins
), ov AS (
    SELECT f.*, s.category, CASE WHEN s.s IS NOT NULL THEN greatest(s.s, window_start) END AS a, CASE WHEN s.s IS NOT NULL THEN least(s.e, window_end) END AS b
    FROM few f LEFT JOIN (SELECT * FROM spans WHERE e > s) s ON f.sample_id = s.sample_id AND s.s < f.window_end AND s.e > f.window_start
)"""
)
CALLS = r"""calls AS (
    SELECT l_returnflag AS contig, l_partkey AS pos, l_suppkey::VARCHAR AS sample_id, 'A' AS ref, ['T', 'C', 'G', 'AT', 'T,G', '.'][l_partkey % 6 + 1] AS alt,
        CASE WHEN status = 'O' THEN 'PASS' WHEN l_partkey % 7 = 0 THEN 'LowQual' ELSE '.' END AS filter,
        ['0/0', '0/1', '1|1', './.', '1/1', '0|1', '1/0', '0/0'][(ln + l_suppkey) % 8 + 1] AS gt
    FROM (SELECT l_returnflag, l_partkey, l_suppkey, min((l_orderkey, l_linenumber, l_linestatus))[2] AS ln, min((l_orderkey, l_linenumber, l_linestatus))[3] AS status FROM lineitem GROUP BY ALL)
), snps AS (
    SELECT *, contig || ':' || pos AS locus_key, CASE gt WHEN '0/0' THEN 0 WHEN './.' THEN NULL WHEN '1|1' THEN 2 WHEN '1/1' THEN 2 ELSE 1 END AS g
    FROM calls WHERE filter IN ('PASS', '.') AND alt IN ('T', 'C', 'G')
)"""
PEOPLE = r"""people AS (
    SELECT s_suppkey::VARCHAR AS individual_id, r_name AS biome, n_nationkey * 1.5::DOUBLE - 30 + (s_suppkey % 10) * 0.1::DOUBLE AS latitude, n_nationkey * 0.7::DOUBLE - 60 + (s_suppkey % 7) * 0.2::DOUBLE AS longitude
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
PLACED = (
    PEOPLE
    + r""", placed AS (
    SELECT p.individual_id, p.biome AS true_biome, p.latitude AS true_lat, p.longitude AS true_lon,
        CASE WHEN n > 1 THEN (t.lat - p.latitude) / (n - 1) ELSE p.latitude END AS pred_lat, CASE WHEN n > 1 THEN (t.lon - p.longitude) / (n - 1) ELSE p.longitude END AS pred_lon
    FROM people p JOIN (SELECT biome, sum(latitude) AS lat, sum(longitude) AS lon, count(*) AS n FROM people GROUP BY biome) t USING (biome)
), hav AS (
    SELECT *, 12742.0::DOUBLE * asin(sqrt(least(greatest(pow(sin((radians(pred_lat) - radians(true_lat)) / 2), 2) + cos(radians(true_lat)) * cos(radians(pred_lat)) * pow(sin((radians(pred_lon) - radians(true_lon)) / 2), 2), 1e-7::DOUBLE), 1 - 1e-7::DOUBLE))) AS km
    FROM placed
)"""
)
SCORES = r"""ves AS (SELECT vec_id AS locus_idx, embedding[(vec_id * 7 + 3) % 64 + 1]::DOUBLE - embedding[vec_id % 64 + 1]::DOUBLE AS score FROM embeddings)"""
PAIRS = r"""pairs AS (SELECT vec_id, label::INT AS label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS predicted FROM embeddings)"""
TRIALS = r"""tp AS (
    SELECT vec_id AS individual_id, t AS trial, CASE WHEN embedding[t * 10 + 1]::DOUBLE > 0.1::DOUBLE THEN 'a' WHEN embedding[t * 10 + 2] > 0 THEN 'b' ELSE 'c' END AS pred_biome,
        embedding[t * 10 + 3]::DOUBLE * 10 AS pred_lat, embedding[t * 10 + 4]::DOUBLE * 10 AS pred_lon, embedding[t * 10 + 5]::DOUBLE AS l0, embedding[t * 10 + 6]::DOUBLE AS l1, embedding[t * 10 + 7]::DOUBLE AS l2
    FROM embeddings, range(0, 6) r(t)
)"""


# --- sequences -------------------------------------------------------------


@query(f"WITH {NORMAL} SELECT doc_id, n AS normalized FROM norm")
def seq_normalize(spark, d):
    docs = spread(A.table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", S.normalize(F.col("text")).alias("normalized"))


@query(f"WITH {NORMAL} SELECT doc_id, regexp_extract(n, '[^ACGTN]') AS unsupported FROM norm")
def seq_unsupported(spark, d):
    docs = spread(A.table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", S.unsupported(S.normalize(F.col("text"))).alias("unsupported"))


@query(f"WITH {SEQS} SELECT sample_id, round(gc, 6) AS gc_fraction FROM judged")
def seq_gc(spark, d):
    return prepare.judged(A.raw_sequences(spark, d), CONFIG).select("sample_id", _r("gc_fraction").alias("gc_fraction"))


@query(f"WITH {SEQS} SELECT sample_id, round(amb, 6) AS ambiguity_fraction FROM judged")
def seq_ambiguity(spark, d):
    return prepare.judged(A.raw_sequences(spark, d), CONFIG).select("sample_id", _r("ambiguity_fraction").alias("ambiguity_fraction"))


@query(f"WITH {SEQS} SELECT sample_id, contig, reason, len AS sequence_length, round(amb, 6) AS ambiguity_fraction FROM reasoned WHERE reason IS NOT NULL")
def seq_filter_reasons(spark, d):
    _, rejected = prepare.prepare(A.raw_sequences(spark, d), CONFIG)
    return rejected.select("sample_id", "contig", "reason", "sequence_length", _r("ambiguity_fraction").alias("ambiguity_fraction"))


@query(f"WITH {SEQS} SELECT count(*) AS retained, round(coalesce(avg(gc), 0), 6) AS mean_gc_fraction, round(coalesce(avg(amb), 0), 6) AS mean_ambiguity_fraction FROM reasoned WHERE reason IS NULL")
def prep_report(spark, d):
    retained, _ = prepare.prepare(A.raw_sequences(spark, d), CONFIG)
    return prepare.report(retained).select("retained", _r("mean_gc_fraction").alias("mean_gc_fraction"), _r("mean_ambiguity_fraction").alias("mean_ambiguity_fraction"))


@query("SELECT o_orderkey AS k, CASE WHEN ('0x' || substr(sha256('feline-locus-split-v1:' || o_orderkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.8 THEN 'train' ELSE 'validation' END AS split FROM orders")
def locus_split(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), assign_split(F.col("o_orderkey").cast("string")).alias("split"))


# --- windows ---------------------------------------------------------------


def _blocks(spark, d):
    retained, _ = prepare.prepare(A.raw_sequences(spark, d), CONFIG)
    return windows.blocks(retained, CONFIG)


def _windows(spark, d):
    return windows.windows(_blocks(spark, d), CONFIG)


@query(f"WITH {BLOCKS} SELECT sample_id, locus_id, split, block_start, oe - os AS n FROM blocks")
def blocks(spark, d):
    return _blocks(spark, d).select("sample_id", "locus_id", "split", "block_start", (F.col("overlap_end") - F.col("overlap_start")).alias("n"))


@query(f"WITH {WINDOWS} SELECT sample_id, locus_id, split, window_start, window_end, wseq AS sequence, round(gc, 6) AS gc_fraction, round(amb, 6) AS ambiguity_fraction FROM wins")
def sliding_windows(spark, d):
    return _windows(spark, d).select("sample_id", "locus_id", "split", "window_start", "window_end", "sequence", _r("gc_fraction").alias("gc_fraction"), _r("ambiguity_fraction").alias("ambiguity_fraction"))


@query(f"WITH {WINDOWS} SELECT sample_id, window_start, sha256(wseq) AS sequence_hash FROM wins")
def window_hash(spark, d):
    return _windows(spark, d).select("sample_id", "window_start", "sequence_hash")


@query(f"WITH {WINDOWS} SELECT s.split, coalesce(count(w.split), 0) AS windows, coalesce(sum(length(wseq)), 0)::BIGINT AS bases FROM (VALUES ('train'), ('validation')) s(split) LEFT JOIN wins w ON w.split = s.split GROUP BY s.split")
def split_counts(spark, d):
    return windows.split_counts(_windows(spark, d))


@query(f"WITH {WINDOWS} SELECT DISTINCT locus_id, contig, block_start, block_end, split FROM wins")
def split_manifest(spark, d):
    return windows.split_manifest(_windows(spark, d))


@query(f"WITH {WINDOWS}, planted AS (SELECT locus_id, CASE WHEN sample_id::BIGINT % 50 = 0 AND split = 'train' THEN 'validation' ELSE split END AS split FROM wins) SELECT locus_id, count(DISTINCT split) AS splits FROM planted GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leak_locus(spark, d):
    """One document in fifty puts its windows into the other split: its shared loci are found."""
    moved = (F.col("sample_id").cast("long") % 50 == 0) & (F.col("split") == "train")
    return guards.loci_in_two_splits(_windows(spark, d).withColumn("split", F.when(moved, "validation").otherwise(F.col("split"))))


LEAKY = r"""e AS (SELECT DISTINCT event_type AS contig, user_id * 5 AS window_start, user_id * 5 + 12 AS window_end, CASE WHEN user_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split FROM events)"""


@query(f"WITH {LEAKY} SELECT l.contig, l.window_start AS window_start_l, l.window_end AS window_end_l, l.split AS split_l, r.window_start AS window_start_r, r.window_end AS window_end_r, r.split AS split_r FROM e l JOIN e r ON l.contig = r.contig AND l.split < r.split AND l.window_start < r.window_end AND r.window_start < l.window_end")
def leak_overlap(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_type").alias("contig"), (F.col("user_id") * 5).alias("window_start"), (F.col("user_id") * 5 + 12).alias("window_end"), F.when(F.col("user_id") % 3 == 0, "validation").otherwise("train").alias("split"))
    return guards.overlaps_across_splits(e, 64)


@query("SELECT source AS contig, count(DISTINCT lang) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def contig_collision(spark, d):
    return guards.shared_contigs(A.table(spark, d, "documents").select(F.col("source").alias("contig"), F.col("lang").alias("species")))


@query("WITH n AS (SELECT DISTINCT o_orderpriority || ':' || (o_custkey % 500) AS locus_id, CASE WHEN o_custkey % 2 = 0 THEN 'train' ELSE 'validation' END AS split FROM orders), s AS (SELECT DISTINCT o_orderpriority || ':' || (o_custkey % 500) AS locus_id, CASE WHEN o_custkey % 3 = 0 THEN 'train' ELSE 'validation' END AS stored_split FROM orders WHERE o_orderkey % 2 = 0) SELECT locus_id, split, stored_split FROM n JOIN s USING (locus_id) WHERE split <> stored_split")
def manifest_conflicts(spark, d):
    o = A.table(spark, d, "orders").withColumn("locus_id", F.concat("o_orderpriority", F.lit(":"), (F.col("o_custkey") % 500).cast("string")))
    side = lambda k: F.when(F.col("o_custkey") % k == 0, "train").otherwise("validation").alias("split")
    return guards.manifest_conflicts(o.select("locus_id", side(2)), o.where(F.col("o_orderkey") % 2 == 0).select("locus_id", side(3)).distinct())


# --- intervals -------------------------------------------------------------


def _overlaps(spark, d):
    """Windows of every block with the spans of their document."""
    few = _windows(spark, d).select("sample_id", "contig", "window_start", "window_end", "sequence").distinct()
    return intervals.overlap_join(few, A.spans(spark, d), ["sample_id"], CONFIG.window_size)


@query(f"WITH {OVERLAPS} SELECT sample_id, window_start, coalesce(sum(CASE WHEN category = 'filtered' THEN b - a END), 0)::BIGINT AS filtered_bases, coalesce(sum(CASE WHEN category = 'no_call' THEN b - a END), 0)::BIGINT AS no_call_bases, coalesce(sum(CASE WHEN category = 'other' THEN b - a END), 0)::BIGINT AS other_masked_bases FROM ov GROUP BY ALL")
def mask_overlap(spark, d):
    return intervals.category_sums(_overlaps(spark, d), ["sample_id", "window_start"])


@query(
    f"""WITH {OVERLAPS}, st AS (SELECT *, max(b) OVER (PARTITION BY sample_id, window_start ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ov),
    u AS (SELECT sample_id, window_start, any_value(wseq) AS wseq, sum(CASE WHEN a IS NULL THEN 0 ELSE greatest(0, b - greatest(a, coalesce(pm, a))) END)::BIGINT AS covered FROM st GROUP BY ALL)
    SELECT sample_id, window_start, covered AS covered_bases, CASE WHEN sample_id::BIGINT % 2 = 0 THEN covered ELSE greatest(covered, length(regexp_replace(wseq, '[^N]', '', 'g'))) END AS masked_bases FROM u"""
)
def mask_unique(spark, d):
    u = intervals.union_lengths(_overlaps(spark, d), ["sample_id", "window_start"], keep=("sequence",))
    source = F.when(F.col("sample_id").cast("long") % 2 == 0, "consensus").otherwise("reference")
    return u.select("sample_id", "window_start", "covered_bases", intervals.source_aware(source, F.col("covered_bases"), F.col("sequence")).alias("masked_bases"))


# --- tokens and corpus -----------------------------------------------------


#: Tokens of the stand-in that reads known bases only, so that windows differ in their number.
KNOWN_TOKENS = "greatest(1, length(regexp_replace(wseq, 'N', '', 'g')) // 6)"


@query(f"WITH {WINDOWS} SELECT sample_id, window_start, {KNOWN_TOKENS}::INT AS token_count, round({KNOWN_TOKENS} / 64.0, 6) AS token_to_base_ratio FROM wins")
def token_stats(spark, d):
    t = tokens.tokenize(_windows(spark, d), tokens.known_base_tokenizer)
    return t.select("sample_id", "window_start", "token_count", _r("token_to_base_ratio").alias("token_to_base_ratio"))


@query("SELECT vec_id, list_sum([x::DOUBLE for x in embedding[1:16]]) > 0 AS positive, len(embedding[1:16])::INT AS n FROM embeddings")
def token_truncate(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", tokens.truncated(F.col("embedding"), 16).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return e.select("vec_id", (total > 0).alias("positive"), F.size("x").alias("n"))


@query(f"WITH {WINDOWS} SELECT least(8, {KNOWN_TOKENS})::INT AS n, split, count(*) AS rows FROM wins GROUP BY ALL")
def corpus_roundtrip(spark, d):
    import uuid

    from lociflow.operators.shared import settled
    from lociflow.plans.contracts import Export, Tokenizer

    rows = corpus.exported(tokens.tokenize(_windows(spark, d), tokens.known_base_tokenizer), Export(), Tokenizer())
    settled(spark.range(1))  # makes sure that the shared folder is set
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    corpus.write(rows, folder, Export())
    got = [corpus.read(spark, folder, split, max_tokens=8).select(F.size("input_ids").alias("n"), F.lit(split).alias("split")) for split in ("train", "validation")]
    return got[0].unionByName(got[1]).groupBy("n", "split").agg(F.count("*").alias("rows"))


@query(f"WITH {WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY contig, block_start, window_start, sample_id) - 1 AS i FROM wins) SELECT sample_id, window_start, split, i // 1000 AS shard, i % 1000 AS member FROM r")
def webdataset_shards(spark, d):
    return corpus.shard_numbers(_windows(spark, d), 1000).select("sample_id", "window_start", "split", "shard", "member")


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|3|' || o_orderkey), o_orderkey) - 1 AS position FROM orders) SELECT o_orderkey, position, position % 4 AS worker FROM n")
def shuffle_order(spark, d):
    return corpus.shuffled(A.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, 3, workers=4)


# --- variants --------------------------------------------------------------


GT_CASES = "['0/0', '0/1', '1|0', '1/1', './.', '0/.', '', '1', '0/1/1', '1/2', 'a/1', '.', '0/', '/1']"


@query(f"SELECT l_orderkey, l_linenumber, {GT_CASES}[(l_partkey % 14) + 1] AS gt, CASE (l_partkey % 14) WHEN 0 THEN '0,0' WHEN 1 THEN '0,1' WHEN 2 THEN '1,0' WHEN 3 THEN '1,1' WHEN 7 THEN '1' WHEN 8 THEN '0,1,1' WHEN 9 THEN '1,2' WHEN 10 THEN 'a,1' WHEN 12 THEN '0,' WHEN 13 THEN ',1' END AS tokens, (l_partkey % 14) IN (10, 12, 13) AS malformed FROM lineitem")
def gt_parse(spark, d):
    t = _gt_cases(spark, d)
    return t.select("l_orderkey", "l_linenumber", "gt", F.when(V.gt_tokens(F.col("gt")).isNotNull(), F.concat_ws(",", V.gt_tokens(F.col("gt")))).alias("tokens"), V.malformed_gt(F.col("gt")).alias("malformed"))


def _gt_cases(spark, d):
    cases = GT_CASES.strip("[]").replace("'", "").split(", ")
    l = A.table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(F.array(*map(F.lit, cases)), (F.col("l_partkey") % 14 + 1).cast("int")).alias("gt"))


@query("SELECT l_orderkey, l_linenumber, ([0, 1, 1, 2, -1, -1, -1, -1, -1, 3, -1, -1, -1, -1])[(l_partkey % 14) + 1]::TINYINT AS g FROM lineitem")
def gt_encode(spark, d):
    return _gt_cases(spark, d).select("l_orderkey", "l_linenumber", V.encoded(F.col("gt")).alias("g"))


@query(f"WITH {CALLS} SELECT contig, filter, alt, count(*) AS n FROM snps GROUP BY ALL")
def vcf_filter(spark, d):
    from lociflow.operators.variants import passing_snps

    return passing_snps(A.calls(spark, d)).groupBy("contig", "filter", "alt").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS} SELECT contig, pos, sample_id, (row_number() OVER (PARTITION BY contig, pos, sample_id ORDER BY k) - 1)::INT AS allele_no, allele, het AS is_heterozygous FROM (SELECT *, k, CASE WHEN het AND k = 0 THEN ref ELSE alt END AS allele FROM (SELECT *, g = 1 AS het, unnest(CASE WHEN g = 1 THEN [0, 1] WHEN g = 2 THEN [0] ELSE [] END) AS k FROM snps))")
def het_double(spark, d):
    from lociflow.operators.variants import passing_snps

    c = passing_snps(A.calls(spark, d)).withColumn("gt", V.format_value(F.col("format"), F.col("field")))
    c = c.select("contig", "pos", "sample_id", F.posexplode(V.carried_alleles(F.col("gt"), F.col("ref"), F.col("alt"))).alias("allele_no", "a"))
    return c.select("contig", "pos", "sample_id", "allele_no", "a.allele", "a.is_heterozygous")


def _loci_on_documents(spark, d):
    from lociflow.operators.variants import with_reference

    ref = A.raw_sequences(spark, d).select(F.col("sample_id").alias("contig"), "sequence")
    tiles = fasta.tiles(ref, A.TILE, 512)
    l = A.with_document(spark, d, A.table(spark, d, "lineitem"), "contig")
    loci = l.select("contig", F.col("l_partkey").alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt")).distinct()
    return with_reference(loci, tiles, A.TILE)


LOCI = SEQS + r""", loci AS (SELECT DISTINCT (l_orderkey % (SELECT greatest(count(*), 1) FROM documents))::VARCHAR AS contig, l_partkey AS pos FROM lineitem), located AS (SELECT l.contig, l.pos, s.sequence, s.len FROM loci l JOIN judged s ON s.sample_id = l.contig WHERE l.pos BETWEEN 1 AND s.len)"""


@query(f"WITH {LOCI} SELECT contig, pos, substr(sequence, pos - 256, 256) || 'T' || substr(sequence, pos + 1, 255) AS sequence FROM located WHERE pos > 256 AND pos + 255 <= len")
def locus_window(spark, d):
    p = _loci_on_documents(spark, d)
    return p.select("contig", "pos", V.centred_window(F.col("bases"), F.col("tile_start"), F.col("pos"), F.col("alt"), F.col("contig_length")).alias("sequence")).where("sequence IS NOT NULL")


@query(f"WITH {LOCI} SELECT contig, pos, substr(sequence, pos, 1) AS base FROM located WHERE substr(sequence, pos, 1) <> 'A'")
def ref_base_mismatch(spark, d):
    p = _loci_on_documents(spark, d)
    return guards.reference_mismatches(p.where(F.col("pos") <= F.col("contig_length"))).select("contig", "pos", "base")


# --- genotypes -------------------------------------------------------------


@query(f"WITH {PEOPLE}, v AS (SELECT DISTINCT l_suppkey::VARCHAR AS sample_id FROM lineitem WHERE l_suppkey % 10 <> 3) SELECT sample_id, biome, round(latitude, 6) AS latitude FROM v JOIN people ON individual_id = sample_id")
def sample_join(spark, d):
    matched, _, _ = _samples(spark, d)
    return matched.select("sample_id", "biome", _r("latitude").alias("latitude"))


def _samples(spark, d):
    v = A.table(spark, d, "lineitem").where(F.col("l_suppkey") % 10 != 3).select(F.col("l_suppkey").cast("string").alias("sample_id")).distinct()
    return genotypes.matched_samples(v, A.individuals(spark, d))


@query(f"WITH {PEOPLE}, v AS (SELECT DISTINCT l_suppkey::VARCHAR AS sample_id FROM lineitem WHERE l_suppkey % 10 <> 3) SELECT individual_id AS sample_id, 'metadata' AS side FROM people WHERE individual_id NOT IN (SELECT sample_id FROM v) UNION ALL SELECT sample_id, 'calls' FROM v WHERE sample_id NOT IN (SELECT individual_id FROM people)")
def sample_anti(spark, d):
    _, calls_only, metadata_only = _samples(spark, d)
    return metadata_only.select("sample_id", F.lit("metadata").alias("side")).unionByName(calls_only.select("sample_id", F.lit("calls").alias("side")))


def _matrix(spark, d):
    m = genotypes.long_matrix(A.calls(spark, d), A.individuals(spark, d))
    return m.withColumn("locus_key", F.concat_ws(":", "contig", F.col("pos").cast("string")))


@query(f"WITH {CALLS} SELECT sample_id, md5(string_agg(coalesce(g, -1)::VARCHAR, ',' ORDER BY pos, contig)) AS digest, count(*)::INT AS n FROM snps GROUP BY 1")
def geno_dense(spark, d):
    m = _matrix(spark, d).withColumn("o", F.struct("pos", "contig"))
    rows = genotypes.dense_rows(m, "sample_id", "o")
    return rows.select("sample_id", F.md5(F.concat_ws(",", F.transform("genotypes", lambda g: g.cast("string")))).alias("digest"), F.size("genotypes").alias("n"))


@query(f"WITH {CALLS} SELECT locus_key, round(CASE WHEN count(g) = 0 THEN 0 ELSE sum(g) / (2.0::DOUBLE * count(g)) END, 6) AS frequency, count(g) AS known FROM snps GROUP BY 1")
def allele_freq(spark, d):
    f = genotypes.allele_frequency(_matrix(spark, d))
    return f.select("locus_key", _r("frequency").alias("frequency"), "known")


LOO = CALLS + r""", loo AS (SELECT s.*, CASE WHEN n - (g IS NOT NULL)::INT = 0 THEN 0 ELSE (t - coalesce(g, 0)) / (2.0::DOUBLE * (n - (g IS NOT NULL)::INT)) END AS frequency FROM snps s JOIN (SELECT locus_key, coalesce(sum(g), 0) AS t, count(g) AS n FROM snps GROUP BY 1) USING (locus_key))"""


@query(f"WITH {LOO} SELECT sample_id, locus_key, round(frequency, 6) AS frequency FROM loo")
def allele_freq_loo(spark, d):
    return genotypes.leave_one_out_frequency(_matrix(spark, d)).select("sample_id", "locus_key", _r("frequency").alias("frequency"))


@query(f"WITH {LOO} SELECT sample_id, locus_key, (coalesce(g, (('0x' || substr(md5('11|' || sample_id || '|' || locus_key || '|0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < frequency)::INT + (('0x' || substr(md5('11|' || sample_id || '|' || locus_key || '|1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < frequency)::INT))::INT AS g_imputed FROM loo")
def impute(spark, d):
    cells = genotypes.leave_one_out_frequency(_matrix(spark, d))
    return genotypes.imputed(cells, 11).select("sample_id", "locus_key", "g_imputed")


# --- effect scores ---------------------------------------------------------


@query(f"WITH {SCORES} SELECT locus_idx, round(score, 6) AS score FROM ves")
def ves_score(spark, d):
    return A.scores(spark, d).select("locus_idx", _r("score").alias("score"))


@query(f"WITH {SCORES}, f AS (SELECT locus_idx % 17 = 0 AS failed, CASE WHEN locus_idx % 17 = 0 THEN 0 ELSE score END AS score FROM ves) SELECT count(*) FILTER (WHERE NOT failed) AS scored, count(*) FILTER (WHERE failed) AS failed, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(min(score), 6) AS min, round(max(score), 6) AS max FROM f")
def ves_stats(spark, d):
    """One locus in seventeen has failed and scores 0."""
    failed = F.col("locus_idx") % 17 == 0
    s = effects.stats(A.scores(spark, d).select(failed.alias("failed"), F.when(failed, 0.0).otherwise(F.col("score")).alias("score")))
    return s.select("scored", "failed", *(_r(c).alias(c) for c in ("mean", "sd", "min", "max")))


@query(f"WITH {SCORES} SELECT locus_idx, round((locus_idx % 3) * abs(score), 6) AS weighted FROM ves")
def ves_weight(spark, d):
    return A.scores(spark, d).select("locus_idx", _r(score_fn.weighted(F.col("locus_idx") % 3, F.col("score"))).alias("weighted"))


@query(f"WITH {SCORES} SELECT locus_idx, round(score, 6) AS score FROM ves ORDER BY abs(score) DESC, locus_idx LIMIT 50")
def ves_topk(spark, d):
    return effects.top(A.scores(spark, d), 50).select("locus_idx", _r("score").alias("score"))


@query(f"WITH {SCORES}, l AS (SELECT locus_idx, ln(greatest(abs(score), 1e-8::DOUBLE)) AS l FROM ves) SELECT locus_idx, round((l - (SELECT avg(l) FROM l)) / greatest((SELECT stddev_samp(l) FROM l), 1e-6::DOUBLE) * 2, 6) AS gate FROM l")
def ves_gate(spark, d):
    return effects.gate_init(A.scores(spark, d)).select("locus_idx", _r("gate").alias("gate"))


@query("SELECT page_id, CASE WHEN 256 < len0 THEN 0 WHEN 256 < len0 + 100 THEN 1 END::INT AS centre FROM (SELECT page_id, (page_id * 37) % 400 AS len0 FROM pages)")
def centre_token(spark, d):
    p = A.table(spark, d, "pages").select("page_id", ((F.col("page_id") * 37) % 400).alias("n"))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    zero = F.lit(0).cast("long")
    return p.select("page_id", score_fn.centre_token(F.array(span(zero, F.col("n")), span(F.col("n"), F.col("n") + 100))).alias("centre"))


# --- assignment metrics ----------------------------------------------------


@query(f"WITH {PEOPLE} SELECT round(avg(latitude), 6) AS lat_mean, round(greatest(coalesce(stddev_samp(latitude), 0), 1e-6), 6) AS lat_std, round(avg(longitude), 6) AS lon_mean, round(greatest(coalesce(stddev_samp(longitude), 0), 1e-6), 6) AS lon_std FROM people")
def coord_stats(spark, d):
    return metrics.coordinate_stats(A.individuals(spark, d)).select(*(_r(c).alias(c) for c in ("lat_mean", "lat_std", "lon_mean", "lon_std")))


def _placed(spark, d):
    return metrics.with_distance(loocv.centroid_baseline(A.individuals(spark, d)))


@query(f"WITH {PLACED} SELECT individual_id, round(km, 6) AS haversine_km FROM hav")
def haversine(spark, d):
    return _placed(spark, d).select("individual_id", _r("haversine_km").alias("haversine_km"))


@query(f"WITH {PLACED} SELECT round(avg(abs(pred_lat - true_lat)), 6) AS mae_lat_deg, round(avg(abs(pred_lon - true_lon)), 6) AS mae_lon_deg, round(avg(km), 6) AS haversine_km_mean, round(quantile_disc(km, 0.5), 6) AS haversine_km_median FROM hav")
def geo_errors(spark, d):
    return metrics.geo_errors(_placed(spark, d)).select(*(_r(c).alias(c) for c in ("mae_lat_deg", "mae_lon_deg", "haversine_km_mean", "haversine_km_median")))


@query(f"WITH {PLACED} SELECT round(avg(CASE WHEN km <= 250 THEN 1.0 ELSE 0 END), 6) AS within_250km, round(avg(CASE WHEN km <= 500 THEN 1.0 ELSE 0 END), 6) AS within_500km, round(avg(CASE WHEN km <= 1000 THEN 1.0 ELSE 0 END), 6) AS within_1000km FROM hav")
def geo_thresholds(spark, d):
    return metrics.within(_placed(spark, d)).select(*(_r(f"within_{t}km").alias(f"within_{t}km") for t in metrics.THRESHOLDS_KM))


@query(f"WITH {PLACED} SELECT true_biome, count(*) AS n, round(quantile_disc(km, 0.5), 6) AS median_km, round(avg(km), 6) AS mean_km, round(avg((individual_id::INT % 3 > 0)::INT), 6) AS accuracy FROM hav GROUP BY 1")
def geo_by_biome(spark, d):
    p = _placed(spark, d).withColumn("pred_biome", F.when(F.col("individual_id").cast("int") % 3 > 0, F.col("true_biome")).otherwise("?"))
    g = metrics.by_class(p)
    return g.select("true_biome", "n", *(_r(c).alias(c) for c in ("median_km", "mean_km", "accuracy")))


@query(
    f"""WITH {PAIRS}, c AS (SELECT k AS class, (SELECT count(*) FROM pairs WHERE label = k AND predicted = k) AS tp, (SELECT count(*) FROM pairs WHERE label <> k AND predicted = k) AS fp, (SELECT count(*) FROM pairs WHERE label = k AND predicted <> k) AS fn FROM range(0, 12) r(k)),
    m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS r FROM c)
    SELECT class::INT AS class, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m"""
)
def class_f1(spark, d):
    s = metrics.class_scores(A.class_pairs(spark, d), list(range(12)))
    return s.select("class", "tp", "fp", "fn", *(_r(c).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {PAIRS} SELECT round(avg((label = predicted)::INT), 6) AS accuracy FROM pairs")
def accuracy(spark, d):
    return metrics.accuracy(A.class_pairs(spark, d)).select(_r("accuracy").alias("accuracy"))


@query(f"WITH {PAIRS} SELECT vec_id, predicted::INT AS predicted FROM pairs")
def argmax(spark, d):
    return A.class_pairs(spark, d).select("vec_id", "predicted")


@query(f"WITH {PAIRS} SELECT predicted::INT AS predicted, count(*) AS n FROM pairs GROUP BY 1")
def pred_hist(spark, d):
    return metrics.histogram(A.class_pairs(spark, d))


@query(f"WITH {TRIALS}, v AS (SELECT individual_id, pred_biome, count(*) AS votes, min(trial) AS first FROM tp GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY individual_id ORDER BY votes DESC, first) AS i FROM v) SELECT individual_id, pred_biome, votes FROM w WHERE i = 1")
def ensemble_vote(spark, d):
    return ensemble.majority_vote(A.trial_predictions(spark, d))


@query(f"WITH {TRIALS} SELECT individual_id, round(avg(pred_lat), 6) AS pred_lat, round(avg(pred_lon), 6) AS pred_lon, round(avg(l0), 6) AS l0, round(avg(l2), 6) AS l2 FROM tp GROUP BY 1")
def ensemble_mean(spark, d):
    p = A.trial_predictions(spark, d)
    j = ensemble.mean_coordinates(p).join(ensemble.mean_logits(p), "individual_id")
    return j.select("individual_id", _r("pred_lat").alias("pred_lat"), _r("pred_lon").alias("pred_lon"), _r(F.get("logits", F.lit(0))).alias("l0"), _r(F.get("logits", F.lit(2))).alias("l2"))


@query("WITH t AS (SELECT p_size AS trial, round(avg(p_retailprice), 2) AS objective FROM part GROUP BY 1) SELECT trial, objective FROM t ORDER BY objective, trial LIMIT 1")
def best_trial(spark, d):
    t = A.table(spark, d, "part").groupBy(F.col("p_size").alias("trial")).agg(F.round(F.avg("p_retailprice"), 2).alias("objective"))
    return ensemble.best_trial(t)


@query("SELECT n_nationkey, 'https://ftp.ncbi.nlm.nih.gov/genomes/all/GCF/018/350/1' || lpad(n_nationkey::VARCHAR, 2, '0') || '/GCF_0183501' || lpad(n_nationkey::VARCHAR, 2, '0') || '.1_' || n_name || '/GCF_0183501' || lpad(n_nationkey::VARCHAR, 2, '0') || '.1_' || n_name || '_genomic.fna.gz' AS url FROM nation")
def url_build(spark, d):
    n = A.table(spark, d, "nation")
    acc = F.concat(F.lit("GCF_0183501"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(".1"))
    return n.select("n_nationkey", assemblies.fasta_url(acc, F.col("n_name")).alias("url"))


@query("SELECT conv_id, turn, round(exp(least(length(text) / 10.0::DOUBLE, 20)), 4) AS perplexity FROM conversations")
def perplexity(spark, d):
    c = A.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.round(score_fn.perplexity(F.length("text") / 10.0), 4).alias("perplexity"))


@query("SELECT conv_id, round(CASE WHEN count(*) FILTER (WHERE role <> 'system') = 0 THEN 'nan'::DOUBLE ELSE count(*) FILTER (WHERE role <> 'system' AND length(text) % 2 = 0)::DOUBLE / count(*) FILTER (WHERE role <> 'system') END, 6) AS token_accuracy FROM conversations GROUP BY 1")
def token_accuracy(spark, d):
    """Turns as tokens: those of the system don't count, those of even length are right."""
    counted = F.col("role") != "system"
    c = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(counted).alias("total"), F.count_if(counted & (F.length("text") % 2 == 0)).alias("correct"))
    return c.select("conv_id", _r(score_fn.token_accuracy(F.col("correct"), F.col("total"))).alias("token_accuracy"))


@query(
    f"""WITH {PAIRS}, c AS (SELECT k, (SELECT count(*) FROM pairs WHERE label = k AND predicted = k) AS tp, (SELECT count(*) FROM pairs WHERE label <> k AND predicted = k) AS fp, (SELECT count(*) FROM pairs WHERE label = k AND predicted <> k) AS fn FROM range(0, 12) r(k))
    SELECT round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM c"""
)
def macro_f1(spark, d):
    return metrics.macro_f1(metrics.class_scores(A.class_pairs(spark, d), list(range(12)))).select(_r("macro_f1").alias("macro_f1"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE * 12.5::DOUBLE - 20, 6) AS latitude FROM embeddings")
def denormalised(spark, d):
    return A.table(spark, d, "embeddings").select("vec_id", _r(geo.denormalize(F.get("embedding", F.lit(0)).cast("double"), F.lit(-20.0), F.lit(12.5))).alias("latitude"))


@query("SELECT n_nationkey, CASE r_name WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END::INT AS class FROM nation JOIN region ON n_regionkey = r_regionkey")
def class_index(spark, d):
    n = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", score_fn.class_index(F.col("r_name"), ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")).alias("class"))


@query("WITH c AS (SELECT p_partkey, trim(regexp_replace(lower('Build ' || p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS evidence FROM part) SELECT p_partkey, evidence, contains(evidence, 'bolt') AND contains(evidence, 'build') AND NOT contains(evidence, 'small') AS matches FROM c")
def reference_evidence(spark, d):
    header = F.concat(F.lit("Build "), F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")"))
    return A.table(spark, d, "part").select("p_partkey", V.canonical_evidence(header).alias("evidence"), V.evidence_matches(header, ("bolt", "build"), ("small",)).alias("matches"))


# --- guards ----------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 2 = 0 THEN 'consensus' ELSE 'reference' END AS source FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0")
def unapproved_sources(spark, d):
    i = F.col("doc_id")
    label = F.when(i % 5 == 0, F.lit(None)).when(i % 3 == 0, F.col("source")).when(i % 2 == 0, "consensus").otherwise("reference")
    return guards.unapproved_sources(A.table(spark, d, "documents").select("doc_id", label.alias("source")))


@query("WITH n AS (SELECT greatest(count(*), 1) AS ids FROM documents) SELECT DISTINCT (l_orderkey % (ids + 50))::VARCHAR AS contig FROM lineitem, n WHERE l_orderkey % (ids + 50) NOT IN (SELECT doc_id FROM documents)")
def unknown_contigs(spark, d):
    docs = A.table(spark, d, "documents")
    n = docs.agg((F.greatest(F.count("*"), F.lit(1)) + 50).alias("ids"))
    loci = A.table(spark, d, "lineitem").crossJoin(F.broadcast(n)).select((F.col("l_orderkey") % F.col("ids")).cast("string").alias("contig"))  # one row
    return guards.unknown_contigs(loci, docs.select(F.col("doc_id").cast("string").alias("contig")))


@query("SELECT count(DISTINCT role) AS tokenizers FROM conversations HAVING count(DISTINCT role) > 1")
def mixed_tokenizers(spark, d):
    return guards.mixed_tokenizers(A.table(spark, d, "conversations").select(F.col("role").alias("tokenizer")))


FOREIGN = CALLS + r""", odd AS (SELECT *, CASE WHEN pos % 11 = 0 THEN 'X' ELSE alt END AS a, pos % 5 <> 0 AS keyed FROM calls)"""


def _odd_calls(spark, d):
    """Calls of which some have a foreign letter, and some no GT in FORMAT."""
    c = A.calls(spark, d)
    return c.withColumn("alt", F.when(F.col("pos") % 11 == 0, "X").otherwise(F.col("alt"))).withColumn("format", F.when(F.col("pos") % 5 == 0, "DP").otherwise(F.col("format")))


@query(f"WITH {FOREIGN} SELECT contig, a AS alt, count(*) AS n FROM odd WHERE filter IN ('PASS', '.') AND a IN ('T', 'C', 'G') GROUP BY ALL")
def foreign_alleles(spark, d):
    from lociflow.operators.variants import passing_snps

    return passing_snps(_odd_calls(spark, d), "skip").groupBy("contig", "alt").agg(F.count("*").alias("n"))


@query(f"WITH {FOREIGN} SELECT contig, count(*) AS cells, count(CASE gt WHEN './.' THEN NULL ELSE 1 END) AS known FROM odd WHERE filter IN ('PASS', '.') AND a IN ('T', 'C', 'G') AND keyed AND sample_id IN (SELECT s_suppkey::VARCHAR FROM supplier) GROUP BY 1")
def keyless_format(spark, d):
    m = genotypes.long_matrix(_odd_calls(spark, d), A.individuals(spark, d))
    return m.groupBy("contig").agg(F.count("*").alias("cells"), F.count("g").alias("known"))


# --- corpus counts and trials ----------------------------------------------


@query(f"WITH {WINDOWS} SELECT split, count(*) AS record_count FROM wins GROUP BY 1")
def corpus_files(spark, d):
    """Records by split as the written corpus's list of files has them."""
    import uuid

    from lociflow.operators.shared import settled
    from lociflow.plans.contracts import Export, Tokenizer

    rows = corpus.exported(tokens.tokenize(_windows(spark, d), tokens.known_base_tokenizer), Export(), Tokenizer())
    settled(spark.range(1))  # makes sure that the shared folder is set
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    corpus.write(rows, folder, Export(), windows.split_manifest(_windows(spark, d)))
    head = corpus.head(spark, folder)
    listed = spark.read.json(f"{folder}/{head['files']}")
    return listed.groupBy("split").agg(F.sum("record_count").alias("record_count"))


OBJECTIVES = "t AS (SELECT p_size AS trial, round(avg(p_retailprice), 2) AS objective FROM part GROUP BY 1)"


@query(f"WITH {OBJECTIVES} SELECT trial, objective FROM t ORDER BY objective, trial LIMIT 5")
def top_trials(spark, d):
    t = A.table(spark, d, "part").groupBy(F.col("p_size").alias("trial")).agg(F.round(F.avg("p_retailprice"), 2).alias("objective"))
    return ensemble.top_trials(t)


@query(f"WITH {PLACED}, e AS (SELECT quantile_disc(km, 0.5) AS m FROM hav WHERE individual_id::INT % 2 = 0), b AS (SELECT quantile_disc(km, 0.5) AS m FROM hav WHERE individual_id::INT % 2 = 1) SELECT round(e.m, 6) AS ensemble_median, round(b.m, 6) AS best_median, CASE WHEN e.m < b.m THEN 'ensemble' ELSE 'best_trial' END AS adopted FROM e, b")
def adopted(spark, d):
    """Individuals of even number as the ensemble's result, the others as the best trial's."""
    p, even = _placed(spark, d), F.col("individual_id").cast("int") % 2 == 0
    return ensemble.adopted(p.where(even), p.where(~even)).select(_r("ensemble_median").alias("ensemble_median"), _r("best_median").alias("best_median"), "adopted")


@query("SELECT * FROM (VALUES ('DNAZOO_Panthera_onca_HiC', 9690), ('GCF_000181335.3', 9685), ('GCF_000464555.1', 74533), ('GCF_001857705.1', 9691), ('GCF_003327715.1', 9696), ('GCF_018350215.1', 9689)) v(identifier, tax_id)")
def assembly_registry(spark, d):
    return assemblies.registry(spark).select("identifier", "tax_id")
