"""One query for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import alignment, bpe, divergence, gam, langid, linededup, mixing, packing, quality_rules, sharding, simhash, topk, warc
from .common import crc_mod, scratch_path, table

SHARDS = 24
SEQUENCE_TOKENS, END_ID = 4096, 1


def vocabulary_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_json(path: str | None = None) -> str:
    with open(path or vocabulary_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tokenizer_json()
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), spec), spec)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    return dealt.select("doc_id", sharding.text_size().alias("size"), crc, "law", "shard", "slot", "grown_shard")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    model = quality_rules.train(docs, learned)
    return quality_rules.apply_rules(quality_rules.measure(docs, model))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def tokenizer_pair() -> tuple[str, bytes]:
    with open(vocabulary_file("piece_bpe_32k.model"), "rb") as f:
        return tokenizer_json(vocabulary_file("byte_bpe_50k.json")), f.read()


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = tokenizer_pair()
    aligned = alignment.align(table(spark, sf_dir, "documents"), *pair)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = aligned.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "links", digest)
    return alignment.with_counts(rows, *pair)


def with_ids_crc32(df: DataFrame) -> DataFrame:
    """df with `ids_crc32`, of the token ids as little-endian unsigned 32-bit numbers, in the place of `token_ids`."""
    names = [c for c in df.columns if c != "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(names))
            data = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
            ends = ids.offsets.to_numpy() * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    df = df.select(*names, "token_ids")
    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("ids_crc32", T.LongType())]))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_json(), SEQUENCE_TOKENS, END_ID)
    return packing.pack(with_ids_crc32(pieces), SEQUENCE_TOKENS)


def learn_languages(docs: DataFrame) -> list:
    return langid.train(docs.where(crc_mod("doc_id", 4) != 2), langid.vocabulary_pieces(vocabulary_file("piece_bpe_32k.model")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.classify(docs.select("doc_id", "text"), learn_languages(docs))
    return told.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", F.col("__deleted_lines").cast("long").alias("deleted_lines"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.records(warc.read_chunks(spark, path)).drop("record_id")


def op10_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    scored = gam.score(docs, gam.train(docs, learned))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_topk, op3_sharding, op4_simhash, op5_quality_rules, op6_langid, op7_line_dedup, op8_mixing, op9_warc, op10_gam, op11_divergence, op12_alignment, op13_packing)}

ORACLES = {
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(text) AS chars, text,
                          (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
             k AS (SELECT *, -ln(u) / (CASE WHEN chars / greatest(size, 1) BETWEEN 3 AND 9 THEN 1.0 ELSE 0.25 END)::DOUBLE AS key FROM d),
             s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
             w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM s),
             p AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS stop FROM w),
             l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                          / sum(w) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p),
             t AS (SELECT source, source_size, least(cap, (max(level) OVER ()) * w) AS target FROM l),
             e AS (SELECT *, floor(target / greatest(source_size, 1)) AS epochs, target - floor(target / greatest(source_size, 1)) * source_size AS rest FROM t),
             r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.rest,
                          coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                   FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target,
               (size * least(2, epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             g AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN strlen(h) >= 1000 AND n > 1 AND page_id IS DISTINCT FROM kept AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(h) >= 1000 AND n > 1 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
        FROM g""",
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
             o AS (SELECT r, lang, source, unnest(t) AS term FROM d),
             kept AS (SELECT lang, term, count(*) AS all_n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
             langs AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM kept GROUP BY 1),
             n AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
             g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(source_n, 0) AS source_n
                   FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS source_n FROM n GROUP BY 1, 2) USING (lang, source)),
             p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (g.source_n + 2 * g.v) AS p,
                          1 + (1000000000::HUGEINT * (k.all_n + 2)) // (g.lang_n + 2 * g.v) AS q
                   FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
             pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
             every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
                       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
                       UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every QUALIFY part = 'pair' OR rank <= 10""",
}
