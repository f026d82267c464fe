"""Sequence records: parsing, cleaning, deduplication and hit tables as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.catalog.networks import _histogram_sql
from simloom.catalog.registry import Tables, query, sql
from simloom.functions import headers, positions, residues
from simloom.operators import network, sanitize
from simloom.sources import fasta, hits

# Whole texts as sequences: lines stripped and joined, then cleaned.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RECORDS = rf"""
    records AS (
      SELECT doc_id AS ord, source || ' ' || lang AS header,
             regexp_replace(text, '^{_SPACE}+|{_SPACE}*[\n\r]{_SPACE}*|{_SPACE}+$', '', 'g') AS sequence
      FROM documents)"""
_V = "[ACDEFGHIKLMNPQRSTVWYBZJXUO]"
# Full Unicode upper case turns one ß into two letters; this SQL dialect keeps it as one.
_UPPER = "upper(replace(sequence, 'ß', 'SS'))"
_CORE = f"regexp_extract({_UPPER}, '{_V}.*{_V}|{_V}')"
_CLEANED = _RECORDS + rf""",
    cleaned AS (
      SELECT ord, header AS raw_header, sequence AS raw_sequence,
             regexp_replace(replace(trim(regexp_replace(regexp_replace(translate(header, '[]{{}}', '()()'),
               '[?*"#%@$/\\]', '_', 'g'), '{_SPACE}+', ' ', 'g')), ' ', '_'), '_+', '_', 'g') AS header,
             regexp_replace({_CORE}, '[^ACDEFGHIKLMNPQRSTVWYBZJXUO]', 'X', 'g') AS sequence
      FROM records)"""
_DISTINCT = _CLEANED + """,
    per_header AS (SELECT sequence, header, count(*) AS copies, min(ord) AS ord FROM cleaned WHERE sequence <> '' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY length(header) DESC, header) AS rn,
                      sum(copies) OVER (PARTITION BY sequence) AS records, count(*) OVER (PARTITION BY sequence) AS headers,
                      min(ord) OVER (PARTITION BY sequence) AS first_ord FROM per_header),
    uniq AS (SELECT sequence, header, records, headers, first_ord FROM ranked WHERE rn = 1)"""


@query("src_1_fasta_records", f"WITH {_RECORDS} SELECT ord, header, md5(sequence) AS digest, length(sequence) AS size FROM records")
def fasta_records(t: Tables):
    """Whole texts read as FASTA bodies: lines stripped and joined."""
    return t.records.select("ord", "header", F.md5("sequence").alias("digest"), F.length("sequence").alias("size"))


@query("san_1_clean_header", f"WITH {_CLEANED} SELECT ord, header FROM cleaned")
def clean_header(t: Tables):
    return sanitize.cleaned_records(t.records).select("ord", "header")


@query(
    "san_1_clean_url_header",
    rf"""SELECT page_id, regexp_replace(replace(trim(regexp_replace(regexp_replace(translate(url, '[]{{}}', '()()'),
           '[?*"#%@$/\\]', '_', 'g'), '{_SPACE}+', ' ', 'g')), ' ', '_'), '_+', '_', 'g') AS header FROM pages""",
)
def clean_url(t: Tables):
    """Header rules on texts that are full of reserved characters."""
    return t.table("pages").select("page_id", headers.clean_header(F.col("url")).alias("header"))


@query("san_2_clean_sequence", f"WITH {_CLEANED} SELECT ord, md5(sequence) AS digest, length(sequence) AS size FROM cleaned")
def clean_sequence(t: Tables):
    cleaned = sanitize.cleaned_records(t.records)
    return cleaned.select("ord", F.md5("sequence").alias("digest"), F.length("sequence").alias("size"))


@query(
    "san_3_preferred_headers",
    f"""WITH {_DISTINCT} SELECT first_ord, header, CAST(records AS BIGINT) AS records, headers, md5(sequence) AS digest FROM uniq""",
)
def preferred_headers(t: Tables):
    distinct = sanitize.distinct_sequences(sanitize.cleaned_records(t.records))
    return distinct.select("first_ord", "header", "records", "headers", F.md5("sequence").alias("digest"))


_SANITIZED = _DISTINCT + """,
    placed AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY first_ord) AS rank,
                      count(*) OVER (PARTITION BY header) AS members, min(first_ord) OVER (PARTITION BY header) AS head_ord FROM uniq),
    sanitized AS (SELECT row_number() OVER (ORDER BY head_ord, first_ord) - 1 AS ord,
                         CASE WHEN members = 1 THEN header ELSE header || '_' || rank END AS header, sequence FROM placed)"""


@query("san_6_sanitized_records", f"WITH {_SANITIZED} SELECT ord, header, md5(sequence) AS digest FROM sanitized")
def sanitized(t: Tables):
    """Cleaned, deduplicated and renamed records in output order."""
    return sanitize.sanitized_records(t.records).select("ord", "header", F.md5("sequence").alias("digest"))


# Conversation turns as headers "conv_<n>_<m>": numbered names that already exist must be skipped.
_CLASHES = """
    WITH heads AS (SELECT DISTINCT CASE WHEN turn % 3 = 0 THEN 'conv' ELSE 'conv_' || (conv_id * 2) END AS header FROM conversations),
    shared AS (SELECT header, conv_id * 1000 + turn AS first_ord FROM (
                 SELECT *, CASE WHEN turn % 3 = 0 THEN 'conv' ELSE 'conv_' || (conv_id * 2) END AS header FROM conversations)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY first_ord) AS rank, count(*) OVER (PARTITION BY header) AS members FROM shared),
    free AS (SELECT header, n, row_number() OVER (PARTITION BY header ORDER BY n) AS rank
             FROM (SELECT DISTINCT header FROM placed WHERE members > 1), (SELECT unnest(range(1, (SELECT 2 * count(*) + 2 FROM conversations))) AS n)
             WHERE header || '_' || n NOT IN (SELECT header FROM heads))
    SELECT p.first_ord, CASE WHEN members = 1 THEN p.header ELSE p.header || '_' || f.n END AS new_header
    FROM placed p LEFT JOIN free f ON p.header = f.header AND p.rank = f.rank"""


@query("san_4_unique_headers", _CLASHES)
def unique_headers(t: Tables):
    """One header shared by a third of all records, with numbered names partly taken."""
    named = t.table("conversations").select(
        F.when(F.col("turn") % 3 == 0, "conv")
        .otherwise(F.concat(F.lit("conv_"), (F.col("conv_id") * 2).cast("string")))
        .alias("header"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("first_ord"),
    )
    return sanitize.unique_headers(named).select("first_ord", "new_header")


@query(
    "san_5_header_filter",
    f"WITH {_RECORDS} SELECT ord, header FROM records WHERE NOT contains(header, 'src1')",
)
def header_filter(t: Tables):
    return sanitize.without_headers_containing(t.records, "src1").select("ord", "header")


@query(
    "san_6_counters",
    f"""WITH {_DISTINCT}, m AS (SELECT header, count(*) AS members FROM uniq GROUP BY header)
    SELECT (SELECT count(*) FROM cleaned) AS original_records,
           (SELECT count(*) FROM cleaned WHERE header <> raw_header) AS headers_modified,
           (SELECT count(*) FROM cleaned WHERE sequence <> raw_sequence) AS sequences_modified,
           (SELECT count(*) FROM cleaned WHERE sequence = '') AS empty_sequences_removed,
           (SELECT CAST(sum(records - headers) AS BIGINT) FROM uniq) AS exact_duplicates_removed,
           (SELECT CAST(sum(headers - 1) AS BIGINT) FROM uniq) AS different_headers_merged,
           (SELECT CAST(sum(members) AS BIGINT) FROM m WHERE members > 1) AS headers_renamed,
           (SELECT count(*) FROM uniq) AS final_records""",
)
def counters(t: Tables):
    return sanitize.sanitize_counters(t.records)


@query(
    "san_7_length_filter",
    f"WITH {_CLEANED} SELECT ord, length(sequence) AS size FROM cleaned WHERE length(sequence) BETWEEN 200 AND 2000",
)
def length_filter(t: Tables):
    cleaned = sanitize.cleaned_records(t.records).select("ord", "sequence")
    return sanitize.length_between(cleaned, 200, 2000).select("ord", F.length("sequence").alias("size"))


@query(
    "san_7_length_counters",
    f"""WITH {_CLEANED} SELECT count(*) FILTER (length(sequence) < 200) AS too_short,
        count(*) FILTER (length(sequence) > 2000) AS too_long FROM cleaned""",
)
def length_counters(t: Tables):
    return sanitize.length_counters(sanitize.cleaned_records(t.records), 200, 2000)


@query(
    "san_8_converted_symbols",
    f"""WITH {_RECORDS} SELECT symbol, count(*) AS count FROM (
          SELECT unnest(string_split(regexp_replace({_CORE}, '{_V}', '', 'g'), '')) AS symbol FROM records)
        WHERE symbol <> '' GROUP BY symbol""",
)
def converted(t: Tables):
    return sanitize.symbol_histogram(t.records, "converted")


@query(
    "san_8_stripped_symbols",
    f"""WITH {_RECORDS}, cut AS (SELECT {_UPPER} AS u, {_CORE} AS core FROM records)
        SELECT symbol, count(*) AS count FROM (
          SELECT unnest(string_split(CASE WHEN core = '' THEN u ELSE
             left(u, instr(u, core) - 1) || substr(u, instr(u, core) + length(core)) END, '')) AS symbol FROM cut)
        WHERE symbol <> '' GROUP BY symbol""",
)
def stripped(t: Tables):
    return sanitize.symbol_histogram(t.records, "stripped")


@query(
    "san_9_clean_aligned",
    f"""WITH {_RECORDS} SELECT ord, md5(upper(regexp_replace(translate(regexp_replace(sequence, '{_SPACE}', '', 'g'), '.', '-'),
          '[^A-Za-z-]', 'X', 'g'))) AS digest FROM records""",
)
def clean_aligned(t: Tables):
    """Aligned-residue rules keep every position."""
    return t.records.select("ord", F.md5(residues.clean_aligned(F.col("sequence"))).alias("digest"))


@query(
    "san_14_model_alphabet",
    f"""WITH {_RECORDS} SELECT ord, md5(regexp_replace({_CORE}, '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g')) AS digest FROM records""",
)
def model_alphabet(t: Tables):
    return t.records.select("ord", F.md5(residues.clean_for_model(F.col("sequence"), "protbert")).alias("digest"))


@query(
    "san_13_short_labels",
    sql(
        "nodes",
        r"""SELECT node_id, coalesce(nullif(regexp_extract(header, '\b([A-Z]{2}_\d+(?:\.\d+)?|[A-Z]{3}\d{5,7}(?:\.\d+)?)\b', 1), ''),
              regexp_extract(header, '(\S+)', 1)) AS label FROM nodes""",
    ),
)
def short_labels(t: Tables):
    return t.nodes.select("node_id", headers.simple_label(F.col("header")).alias("label"))


@query("san_15_safe_names", r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS name FROM pages""")
def safe_names(t: Tables):
    return t.table("pages").select("page_id", headers.safe_file_name(F.col("url")).alias("name"))


@query("agg_20_length_histogram", _histogram_sql("", f"SELECT CAST(length(sequence) AS DOUBLE) AS v FROM (WITH {_CLEANED} SELECT sequence FROM cleaned WHERE sequence <> '')", 50))
def length_histogram(t: Tables):
    cleaned = sanitize.cleaned_records(t.records).where("sequence <> ''")
    bins = network.histogram(cleaned, F.length("sequence"), 50)
    return bins.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(
    "arr_19_standard_codes",
    sql(
        "aligned",
        """SELECT row_id, k AS col, instr('ACDEFGHIKLMNPQRSTVWY', substr(sequence, k + 1, 1)) - 1 AS code
           FROM (SELECT row_id, sequence, unnest(range(length(sequence))) AS k FROM aligned)""",
    ),
)
def standard_codes(t: Tables):
    codes = residues.standard_codes(F.col("sequence"))
    return t.aligned.select("row_id", F.posexplode(codes).alias("col", "code"))


@query(
    "str_1_label_order",
    """WITH l AS (SELECT DISTINCT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.' || l_linenumber AS label FROM lineitem)
       SELECT label, row_number() OVER (ORDER BY CAST(split_part(label, '.', 1) AS INTEGER), CAST(split_part(label, '.', 2) AS INTEGER)) AS place FROM l""",
)
def label_order(t: Tables):
    """Display order of at most 350 position labels: 188.10 follows 188.6."""
    from pyspark.sql import Window

    label = F.concat_ws(".", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"))
    labels = t.table("lineitem").select(label.alias("label")).distinct()
    order = Window.orderBy(*positions.label_order(F.col("label")))
    return labels.select("label", F.row_number().over(order).alias("place"))


@query(
    "str_5_label_offset",
    """SELECT DISTINCT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.' || l_linenumber AS label,
              CAST(CAST(l_quantity AS INTEGER) - 30 AS VARCHAR) || '.' || l_linenumber AS shifted FROM lineitem""",
)
def label_offset(t: Tables):
    label = F.concat_ws(".", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"))
    labels = t.table("lineitem").select(label.alias("label")).distinct()
    return labels.select("label", positions.shifted_label(F.col("label"), -30).alias("shifted"))


@query(
    "str_7_crop_offsets",
    """SELECT doc_id, instr(text, word) - 1 AS start,
              (length(text) - length(replace(text, word, ''))) // length(word) > 1 AS repeated
       FROM (SELECT doc_id, text, regexp_extract(text, '(\\S+)', 1) AS word FROM documents) WHERE word <> ''""".replace("\\\\", "\\"),
)
def crop_offsets(t: Tables):
    """Where a cropped sequence (here the first word) starts in the full one."""
    from simloom.operators.embeddings import crop_positions

    full = t.table("documents").select("doc_id", "text", F.regexp_extract("text", r"(\S+)", 1).alias("word"))
    found = crop_positions(F.col("text"), F.col("word"))
    return full.where("word <> ''").select("doc_id", found["start"].alias("start"), found["repeated"].alias("repeated"))


# Hit tables as text lines in the 12-column layout of aligners.
_HIT_LINES = """
    CAST(l_partkey AS VARCHAR) || chr(9) || CAST(l_suppkey AS VARCHAR) || chr(9) || '98.5' || chr(9) || CAST(l_linenumber AS VARCHAR)
    || chr(9) || '0' || chr(9) || '0' || chr(9) || '1' || chr(9) || '9' || chr(9) || '1' || chr(9) || '9' || chr(9) ||
    CASE WHEN l_returnflag = 'R' THEN 'bad' WHEN l_discount = 0 THEN '0.0' ELSE '1e-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END
    || chr(9) || '50.1'"""


def _hit_lines(t: Tables):
    evalue = (
        F.when(F.col("l_returnflag") == "R", "bad")
        .when(F.col("l_discount") == 0, "0.0")
        .otherwise(F.concat(F.lit("1e-"), F.col("l_quantity").cast("int").cast("string")))
    )
    fixed = [F.lit(v) for v in ("0", "0", "1", "9", "1", "9")]
    ids = [F.col(c).cast("string") for c in ("l_partkey", "l_suppkey")]
    line = F.concat_ws("\t", *ids, F.lit("98.5"), F.col("l_linenumber").cast("string"), *fixed, evalue, F.lit("50.1"))
    return t.table("lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), line.alias("value")
    )


_PARSED = f"""
    parsed AS (SELECT string_split(value, chr(9)) AS f FROM (SELECT {_HIT_LINES} AS value FROM lineitem)),
    typed AS (SELECT TRY_CAST(f[1] AS BIGINT) AS i, TRY_CAST(f[2] AS BIGINT) AS j, TRY_CAST(f[11] AS DOUBLE) AS e FROM parsed),
    bound AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
    good AS (SELECT i, j, -log10(e + 1e-300) AS score FROM typed, bound WHERE e >= 0 AND i < n AND j < n)"""


@query(
    "src_9_strict_hit_table",
    f"""WITH {_PARSED} SELECT least(i, j) AS i, greatest(i, j) AS j, round(max(score), 4) AS score FROM good WHERE i <> j GROUP BY 1, 2""",
)
def strict_hits(t: Tables):
    """Numeric-id hit lines to canonical edges; bad lines are left out."""
    bound = t.table("supplier").agg(F.max("s_suppkey") + 1).scalar()
    parsed = hits.parse_numeric_hits(_hit_lines(t), bound)
    edges = network.canonical_edges(parsed.where("ok"))
    return edges.select("i", "j", F.round("score", 4).alias("score"))


@query(
    "src_9_mismatch_count",
    f"""WITH {_PARSED} SELECT (SELECT count(*) FROM typed) AS lines, (SELECT count(*) FROM typed) - (SELECT count(*) FROM good) AS mismatches""",
)
def mismatches(t: Tables):
    bound = t.table("supplier").agg(F.max("s_suppkey") + 1).scalar()
    return hits.parse_numeric_hits(_hit_lines(t), bound).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("ok")).alias("mismatches")
    )


@query(
    "src_11_evalue_column",
    f"""WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS line, {_HIT_LINES} AS value FROM lineitem),
        f AS (SELECT line, string_split(value, chr(9)) AS f FROM l),
        c AS (SELECT line, k - 1 AS pos, f[k] AS token FROM f, unnest(range(3, 13)) AS u(k)),
        n AS (SELECT pos, count(*) AS n, min(line) AS seen FROM c
              WHERE regexp_full_match(token, '-?\\d+(\\.\\d+)?[eE][+-]?\\d+') OR token = '0.0' GROUP BY pos)
        SELECT pos AS column FROM n ORDER BY n DESC, seen, pos LIMIT 1""",
)
def evalue_column(t: Tables):
    """Which column of an unknown hit table holds the E-value."""
    return hits.evalue_column(_hit_lines(t))


@query(
    "join_9_first_appearance_ids",
    """WITH seen AS (
         SELECT name, min(place) AS place FROM (
           SELECT c_mktsegment || '-' || c_nationkey AS name, c_custkey * 2 AS place FROM customer
           UNION ALL SELECT c_mktsegment || '-' || (c_nationkey * 7 % 25), c_custkey * 2 + 1 FROM customer) GROUP BY name)
       SELECT name AS header, row_number() OVER (ORDER BY place) - 1 AS node_id FROM seen""",
)
def first_appearance(t: Tables):
    """Node ids of text ids in order of first appearance, query side before subject side."""
    lines = t.table("customer").select(
        F.col("c_custkey").alias("line"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("query"),
        F.concat_ws("-", "c_mktsegment", (F.col("c_nationkey") * 7 % 25).cast("string")).alias("subject"),
    )
    return hits.first_appearance_ids(lines)
