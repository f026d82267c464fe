"""One query per operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import alignment, decontaminate, exact_dedup, html_text, near_dedup, packing, prefix_counts, quality_rules, secret_scan, spelling, token_files, toxicity, warc
from simloom.llm.shared import table

TOKEN_LIMIT = 4096


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), changes=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_entries(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("file", "offset")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, files = table(spark, sf_dir, "documents"), (tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    aligned = alignment.align(docs, *files, alignment.count_pairs(docs, *files))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and name[2].isdigit()
}

# CRC-32 by half bytes: a table ``nibbles`` with one row, the bytes of a string, and the sum of a column of bytes ``b`` (unsigned).
NIBBLES = """nibbles AS (
            SELECT list(list_reduce(range(4), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS t FROM range(16) r(k))"""


def _bytes(value: str) -> str:
    digit = lambda at: f"strpos('0123456789ABCDEF', substr(hex({value}), {at}, 1))"
    return f"list_transform(range(1, strlen({value}) + 1), lambda k: {digit('2 * k - 1')} * 16 + {digit('2 * k')} - 17)"


def _crc32(column: str) -> str:
    low = "xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1])"
    return f"xor(list_reduce({column}, lambda c, b: xor({low} >> 4, t[({low} & 15) + 1]), 4294967295), 4294967295)"


ORACLES: dict[str, str] = {
    "op11_spelling_variants": f"""
        WITH RECURSIVE {NIBBLES}, runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS name,
                   translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents),
        counted AS (SELECT name || ':' || run AS label, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
        bytes AS (SELECT run, n, {_bytes("label")} AS bytes FROM counted),
        hashed AS (SELECT run, n, {_crc32("bytes")} AS h FROM bytes, nibbles),
        damaged AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        holes AS (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
        pairs AS (
            SELECT DISTINCT a.word AS word, b.word AS near FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word FROM holes a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word FROM holes a JOIN words b ON a.rest = b.word),
        near AS (
            SELECT p.word, count(*) AS n_near, arg_min(struct_pack(w := p.near, n := o.n), (-o.n, p.near)) AS best
            FROM pairs p JOIN words o ON p.near = o.word GROUP BY p.word),
        formed AS (
            SELECT w.word, CASE WHEN best.n >= 10 * w.n THEN best.w END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n
            FROM words w LEFT JOIN near USING (word)),
        steps AS (
            SELECT word, word AS at FROM formed
            UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON s.at = f.word WHERE f.form IS NOT NULL),
        roots AS (SELECT s.word, s.at AS root FROM steps s JOIN formed f ON s.at = f.word WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)""",
    "op12_quality_rules": f"""
        WITH {NIBBLES}, docs AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents),
        lists AS (
            SELECT row, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
                   len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
                   list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM docs),
        placed AS (SELECT row, doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM docs),
        windows AS (
            SELECT row, i, [w, lead(w, 1) OVER t, lead(w, 2) OVER t, lead(w, 3) OVER t, lead(w, 4) OVER t] AS five, lead(i, 4) OVER t AS last
            FROM placed WINDOW t AS (PARTITION BY row ORDER BY i)),
        again AS (
            SELECT row, i, lag(i + 5) OVER (PARTITION BY row ORDER BY i) AS covered
            FROM (SELECT row, i, count(*) OVER (PARTITION BY row, five) AS n FROM windows WHERE last IS NOT NULL) WHERE n > 1),
        repeated AS (SELECT row, sum(i + 5 - greatest(i, coalesce(covered, 0)))::BIGINT AS n FROM again GROUP BY row),
        base AS (
            SELECT l.row, doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM lists l LEFT JOIN repeated r ON l.row = r.row),
        failing AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
        bytes AS (SELECT w, {_bytes("w")} AS bytes FROM (SELECT DISTINCT w FROM placed)),
        codes AS (SELECT w, {_crc32("bytes")} & 65535 AS code FROM bytes, nibbles),
        coded AS (SELECT row, doc_id, i, code FROM placed JOIN codes USING (w)),
        pairs AS (SELECT row, doc_id, code, lead(code) OVER (PARTITION BY row ORDER BY i) AS following FROM coded),
        grams AS (
            SELECT row, doc_id, code AS bucket FROM coded
            UNION ALL SELECT row, doc_id, (code * 1000003 + following) % 65536 FROM pairs WHERE following IS NOT NULL),
        ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS word FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
        id_bytes AS (SELECT doc_id, {_bytes("word")} AS bytes FROM ids),
        trusted AS (SELECT doc_id, {_crc32("bytes")} % 2 = 1 AS aside FROM id_bytes, nibbles),
        counted AS (
            SELECT bucket, count(*) AS r, count(*) FILTER (t.doc_id IS NOT NULL) AS t
            FROM grams g LEFT JOIN (SELECT doc_id FROM trusted WHERE NOT aside) t ON g.doc_id = t.doc_id GROUP BY bucket),
        ratios AS (
            SELECT bucket, CASE WHEN sum(t) OVER () > 0 THEN round(ln(((t + 0.5::DOUBLE) / (sum(t) OVER () + 32768.0::DOUBLE)) / ((r + 0.5::DOUBLE) / (sum(r) OVER () + 32768.0::DOUBLE))) * 4096) ELSE 0 END::BIGINT AS ratio
            FROM counted),
        scored AS (SELECT row, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM grams JOIN ratios USING (bucket) GROUP BY row),
        judged AS (SELECT f.*, score FROM failing f LEFT JOIN scored s ON f.row = s.row),
        known AS (SELECT score, rank() OVER (ORDER BY score) - 1 AS below, count(*) OVER () AS total FROM judged JOIN (SELECT doc_id FROM trusted WHERE aside) USING (doc_id) WHERE NOT base_failed),
        cut AS (SELECT coalesce(max(score), -(1::BIGINT << 62)) AS threshold FROM known WHERE below <= 0.01::DOUBLE * total)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND score >= threshold, FALSE) AS kept,
               score / 4096.0::DOUBLE AS score
        FROM judged, cut""",
    "op3_exact_duplicates": """
        WITH normed AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM normed WINDOW same AS (PARTITION BY norm)""",
}
