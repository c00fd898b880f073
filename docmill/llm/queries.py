"""Queries of the training-data operators and the SQL of those that SQL can express."""

from docmill.llm import encoding, language, percentiles, personal, scan_noise, spam, split, tokens

QUERIES = {
    "p10_found": spam.p10_found,
    "p10_lines": spam.p10_lines,
    "p1_found": personal.p1_found,
    "p1_redacted": personal.p1_redacted,
    "p2_found": language.p2_found,
    "p2_job_languages": language.p2_job_languages,
    "p2_segments": language.p2_segments,
    "p3_found": split.p3_found,
    "p3_pieces": split.p3_pieces,
    "p4_found": encoding.p4_found,
    "p4_repaired": encoding.p4_repaired,
    "p5_found": scan_noise.p5_found,
    "p5_repaired": scan_noise.p5_repaired,
    "p6_document_tokens": tokens.p6_document_tokens,
    "p6_token_budget": tokens.p6_token_budget,
    "p7_found": percentiles.p7_found,
    "p7_percentiles": percentiles.p7_percentiles,
    "p8_ids": tokens.p8_ids,
    "p9_containers": tokens.p9_containers,
}
#: SQL over the same tables, for the operators it can express.
ORACLES = {
    "p3_found": """
WITH j AS (SELECT id, arg_max(options, loaded_at) AS options FROM jobs WHERE id IS NOT NULL GROUP BY id),
i AS (SELECT 'block' AS src, block_key AS rec_key, job_id, text FROM blocks
      UNION ALL SELECT 'chunk', chunk_key, job_id, text FROM chunks)
SELECT DISTINCT src, rec_key FROM i LEFT JOIN j ON j.id = i.job_id
WHERE length(text) // 4 > greatest(coalesce(options.chunk_size_tokens, 512), 32)""",
    "p7_found": """
WITH c AS (SELECT id, max_by(struct_pack(s := status, c := cached_from_job_id, q := queue, t := created_at,
           duration_s := duration_s, queue_wait_s := queue_wait_s), loaded_at) AS r FROM jobs WHERE id IS NOT NULL GROUP BY id),
v AS (SELECT 'duration_s' AS metric, r.q AS queue, strftime(r.t AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, r.duration_s AS x FROM c WHERE r.s = 'SUCCEEDED' AND r.c IS NULL
      UNION ALL SELECT 'queue_wait_s', r.q, strftime(r.t AT TIME ZONE 'UTC', '%Y-%m-%d'), r.queue_wait_s FROM c WHERE r.s = 'SUCCEEDED' AND r.c IS NULL),
w AS (SELECT * FROM v WHERE x > 0 AND isfinite(x)),
a AS (SELECT metric, queue, median(x) AS m FROM w GROUP BY ALL),
d AS (SELECT metric, queue, day, median(x) AS m, count(*) AS n FROM w GROUP BY ALL)
SELECT d.metric, d.queue, d.day FROM d JOIN a USING (metric, queue) WHERE d.n >= 10 AND d.m >= 3 * a.m""",
}
