"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornlake.llm.shared import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from hornlake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm import language_id as L

    docs = table(spark, sf_dir, "documents")
    dictionaries = L.fit_dictionaries(docs, ~L.held_out())
    rows = docs.select("doc_id", "text", L.held_out().alias("held_out"))
    return L.identify(rows, dictionaries).drop("text")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm.source_mix import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm.pii import KINDS, find_pii, fit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    joined = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm import warc
    from hornlake.llm.shared import scratch

    pages, path = table(spark, sf_dir, "pages"), scratch(spark, "archive")
    warc.write_archive(pages, path)
    return warc.page_captures(warc.assemble(warc.read_records(spark, path)))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_embeddings": op4_embeddings,
    "op5_source_mix": op5_source_mix,
    "op6_decontaminate": op6_decontaminate,
    "op7_licenses": op7_licenses,
    "op8_pii": op8_pii,
    "op9_substrings": op9_substrings,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op5_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                 md5(coalesce(doc_id::VARCHAR, '')) AS key
          FROM documents),
        s AS (
          SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
                 ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
          FROM d GROUP BY source),
        r AS (
          SELECT *, cap / weight AS ratio,
                 ((sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT) AS level
          FROM s WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        free AS (SELECT level FROM r WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
        t AS (
          SELECT r.source, r.source_size,
                 CASE WHEN r.ratio < free.level THEN r.cap::DOUBLE ELSE r.weight * free.level END AS target
          FROM r CROSS JOIN free),
        -- where each source's share of 65,536 cells ends, and the van der Corput slots (bit-reversed cells) in it, ranked
        c AS (
          SELECT *, least(65536, ceil(sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () * 65536))::BIGINT AS cell_end
          FROM t WHERE target > 0),
        e AS (SELECT *, coalesce(lag(cell_end) OVER (ORDER BY source NULLS LAST), 0) AS cell FROM c),
        u AS (
          SELECT source, round(target)::BIGINT AS line, unnest(CASE WHEN cell_end > cell THEN range(cell, cell_end) ELSE [-1] END) AS cell FROM e),
        v AS (
          SELECT source, line,
                 CASE WHEN cell < 0 THEN 65536 ELSE list_sum([((cell >> b) & 1) << (15 - b) for b in range(16)]) END::BIGINT AS slot
          FROM u),
        w AS (
          SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank,
                 ceil(line / count(*) OVER (PARTITION BY source))::BIGINT AS block, line
          FROM v),
        b AS (SELECT source, slot, rank, rank * block AS from_word, least((rank + 1) * block, line) AS to_word FROM w WHERE rank * block < line),
        p AS (
          SELECT d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS line, row_number() OVER () AS row,
                 (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (
          SELECT row, source, start + n * source_size AS first, least(start + n * source_size + size, line) AS last
          FROM (SELECT *, unnest(range(4)) AS n FROM p WHERE size > 0) WHERE start + n * source_size < line),
        x AS (SELECT source, max(to_word - from_word) AS block FROM b GROUP BY source),
        y AS (
          SELECT q.*, unnest(range(first // block, (last - 1) // block + 1)) AS at
          FROM q JOIN x ON q.source IS NOT DISTINCT FROM x.source),
        f AS (
          SELECT row, sum(least(last, to_word) - greatest(first, from_word))::BIGINT AS taken,
                 arg_min(struct_pack(slot, rank, o := greatest(first, from_word) - from_word), (slot, greatest(first, from_word))) AS h
          FROM y JOIN b ON y.at = b.rank AND y.source IS NOT DISTINCT FROM b.source GROUP BY row)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken,
               h.slot::BIGINT AS first_slot, h.rank::BIGINT AS first_rank, h.o::BIGINT AS first_offset
        FROM p LEFT JOIN f USING (row)""",
    "op6_decontaminate": r"""
        WITH d AS (
          SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
          FROM documents),
        i AS (
          SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        k AS (
          SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM i WHERE len(w) > 0)),
        g AS (
          SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
        m AS (SELECT g.doc_id, g.p, g.n, k.item_id FROM g JOIN k USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS x FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op2_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM m""",
}
