"""The opN queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import ann, bpe, context_tree, exact_dedup, html_main, importance, license_scan, near_dedup, packing, periodic_runs, quality, token_counts, two_fit_packing
from tallyglass.llm.storage import table


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, quality.graded(table(spark, sf_dir, "labels"))))


def op2_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


def op3_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op5_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": exact_dedup.full_hash()})


def op9_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages"))


def op10_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_fit_packing.pack_whole(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("op")}

ORACLES = {
    "op4_chosen_path_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id AND r.c < l.y)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)""",
}

_PHRASES = ", ".join(f"({i}, '{label}', {i < len(license_scan.PHRASES)}, '{words}')".lower() for i, (label, words) in enumerate([*license_scan.PHRASES, *license_scan.NOTICES]))

ORACLES["op7_license_diagonals"] = rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    phrase AS (SELECT template, label, is_phrase, string_split(p, ' ') AS tw FROM (VALUES {_PHRASES}) v(template, label, is_phrase, p)),
    known AS (SELECT template, label, is_phrase, len(tw) - 2 AS grams, t, array_to_string(tw[t + 1:t + 3], ' ') AS gram FROM phrase, unnest(range(0, len(tw) - 2)) u(t)),
    rolling AS (SELECT doc_id, p, array_to_string(words[p + 1:p + 3], ' ') AS gram FROM w, unnest(range(0, greatest(0, len(words) - 2))) u(p)),
    diagonals AS (SELECT doc_id, template, label, is_phrase, grams, p - t AS diagonal, list(DISTINCT t) AS ts, min(p) AS low, max(p) AS high FROM rolling JOIN known USING (gram) GROUP BY ALL),
    turns AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) <= {license_scan.SLACK} AND low - lag(high) OVER o <= {license_scan.REACH} THEN 0 ELSE 1 END AS turn FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY low, diagonal)),
    parts AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id, template ORDER BY low, diagonal ROWS UNBOUNDED PRECEDING) AS span, is_phrase AND len(ts) = grams AS whole FROM turns),
    spans AS (SELECT doc_id, label, len(list_distinct(flatten(list(ts)))) / grams::DOUBLE AS coverage, count(*) FILTER (whole) AS places, min(diagonal) FILTER (whole) AS first, max(diagonal) FILTER (whole) AS last FROM parts GROUP BY doc_id, template, label, grams, span),
    found AS (SELECT doc_id, sum(places) AS n_base, min(first) AS first_word, max(last) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (places > 0)), ',') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label) FILTER (places > 0 OR coverage >= {license_scan.COVERAGE})), ',') AS labels, max(CASE WHEN coverage >= {license_scan.COVERAGE} THEN coverage ELSE 0 END) AS score FROM spans GROUP BY doc_id)
    SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN found ON w.doc_id = found.doc_id"""

#: A word's CRC-32 from a table of bytes, which the first two expressions make from the polynomial.
ORACLES["op13_importance_resampling"] = r"""
    WITH RECURSIVE byte AS (SELECT i AS b, i::BIGINT AS c, 0 AS step FROM range(256) r(i)
        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM byte WHERE step < 8),
    crc AS (SELECT list(c ORDER BY b) AS t FROM byte WHERE step = 8),
    split AS (SELECT doc_id, true AS ours, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        UNION ALL SELECT NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    feature AS (SELECT doc_id, ours, w, count(*) AS n FROM (SELECT doc_id, ours, unnest(words) AS w FROM split) GROUP BY ALL),
    word AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM feature)),
    bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b FROM word, crc),
    counted AS (SELECT b, sum(n) FILTER (ours) AS s, sum(n) FILTER (NOT ours) AS t FROM feature JOIN bucket USING (w) GROUP BY b),
    total AS (SELECT coalesce(sum(s), 0)::DOUBLE + 10000 AS s_all, coalesce(sum(t), 0)::DOUBLE + 10000 AS t_all FROM counted),
    gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * s_all / ((coalesce(s, 0)::DOUBLE + 1) * t_all)))::BIGINT AS g FROM counted, total),
    weight AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM feature JOIN bucket USING (w) JOIN gain USING (b) WHERE ours GROUP BY doc_id),
    scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents d LEFT JOIN weight w ON d.doc_id = w.doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed"""
